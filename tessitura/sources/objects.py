"""Objects as tagged JSON: what they are is named in the data, but only classes that the caller registers are ever made of it.

A dataclass becomes a dict with its name under _target_ (fields that are null by default and null are left out), an enum member one of
_enum_ and _name_, a path one of _target_ and *args. Lists, dicts with atomic keys and atoms stay what they are.
"""

from __future__ import annotations

import dataclasses
import json
import os
import tempfile
from collections.abc import Mapping
from enum import Enum
from pathlib import Path
from typing import Any

_ATOMS = (str, int, float, bool, type(None))
_PATH = "pathlib.Path"


def name_of(cls: type) -> str:
    return f"{cls.__module__}.{cls.__qualname__}"


def to_tagged(obj: Any) -> Any:
    """Data for JSON of an object; TypeError for what has no form there."""
    if isinstance(obj, Enum):
        return {"_enum_": name_of(type(obj)), "_name_": obj.name}
    if dataclasses.is_dataclass(obj) and not isinstance(obj, type):
        own = ((f, getattr(obj, f.name)) for f in dataclasses.fields(obj))
        return {"_target_": name_of(type(obj))} | {f.name: to_tagged(v) for f, v in own if not (f.default is None and v is None)}
    if isinstance(obj, Path):
        return {"_target_": _PATH, "*args": [str(obj)]}
    if type(obj) in _ATOMS:
        return obj
    if type(obj) is list:
        return [to_tagged(x) for x in obj]
    if type(obj) is dict:
        if bad := [k for k in obj if type(k) not in _ATOMS]:
            raise TypeError(f"a key that is no atom: {bad[0]!r}")
        return {k: to_tagged(v) for k, v in obj.items()}
    raise TypeError(f"no tagged form of {obj!r}")


def from_tagged(data: Any, classes: Mapping[str, type] | list[type] = (), lenient: bool = False) -> Any:
    """The object of tagged data. A class that is not registered raises LookupError, or (lenient) leaves its dict as it is."""
    known = dict(classes) if isinstance(classes, Mapping) else {name_of(c): c for c in classes}
    if type(data) is list:
        return [from_tagged(x, known, lenient) for x in data]
    if type(data) is not dict:
        return data
    tag = data.get("_enum_", data.get("_target_"))
    content = {k: from_tagged(v, known, lenient) for k, v in data.items() if k not in ("_enum_", "_target_", "_name_" if "_enum_" in data else None)}
    if tag is None:
        return content
    if tag == _PATH:
        return Path(*content["*args"])
    if tag not in known:
        if lenient:
            return content | {k: data[k] for k in ("_enum_", "_name_", "_target_") if k in data}
        raise LookupError(f"{tag} is not registered")
    if "_enum_" in data:
        return known[tag][data["_name_"]]
    return known[tag](*content.pop("*args", []), **content)


def save_tagged(obj: Any, path: str | Path) -> None:
    """Writes an object, whole or not at all: to a file beside, which then takes the name."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(to_tagged(obj), indent=4, ensure_ascii=False)
    handle, temporary = tempfile.mkstemp(dir=path.parent, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def load_tagged(path: str | Path, classes: Mapping[str, type] | list[type] = (), lenient: bool = False) -> Any:
    return from_tagged(json.loads(Path(path).read_text(encoding="utf-8")), classes, lenient)
