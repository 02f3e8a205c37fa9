"""Unicode-aware tokenization as JVM expressions, and the same rules for Python kernels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The punctuation that the default tokenizer tells from words and symbols.
PUNCT = ".,!?:;…-–—'\"‘“”«»()[]{}"
WILDCARD = "<*>"
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"


def _escaped(chars: str) -> str:
    return "".join("\\" + c if c in "[]{}()-^.?" else c for c in chars)


#: Java and RE2 patterns; the wildcard is recognised first by all of them.
PATTERNS = {
    ("default", True): rf"<\*>|{WORD}+|[^\s\p{{Z}}\p{{L}}\p{{N}}_{_escaped(PUNCT)}]+",
    ("default", False): rf"<\*>|{WORD}+|[^\s\p{{Z}}\p{{L}}\p{{N}}_{_escaped(PUNCT)}]+|[{_escaped(PUNCT)}]+",
    ("wordpunct", True): rf"<\*>|{WORD}+",
    ("wordpunct", False): rf"<\*>|{WORD}+|[^\s\p{{Z}}\p{{L}}\p{{N}}_]+",
    ("space", True): r"[^\s\p{Z}]+",
    ("space", False): r"[^\s\p{Z}]+",
}


def pattern(method: str = "default", drop_punct: bool = True) -> str:
    if (method, drop_punct) not in PATTERNS:
        raise ValueError(f"no tokenizer {method!r}")
    return PATTERNS[method, drop_punct]


def normalize(text: Column, lower: bool = True, ru_tweaks: bool = True) -> Column:
    text = F.lower(text) if lower else text
    return F.translate(text, "ёЁ", "еЕ") if ru_tweaks else text


def tokenize(text: Column, method: str = "default", drop_punct: bool = True, lower: bool = True, ru_tweaks: bool = True) -> Column:
    """Array of tokens of a text; null for null."""
    return F.regexp_extract_all(normalize(text, lower, ru_tweaks), F.lit(pattern(method, drop_punct)), F.lit(0))


_PY = {k: re.compile(p.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{Z}", "").replace(rf"{WORD}", r"\w")) for k, p in PATTERNS.items()}


def tokens_py(text: str, method: str = "default", drop_punct: bool = True, lower: bool = True, ru_tweaks: bool = True) -> list[tuple[str, int, int]]:
    """(token, start, end) for kernels: Python's own word and space classes are the ones the patterns spell out."""
    out = []
    for m in _PY[method, drop_punct].finditer(text):
        t = m[0]
        if t != WILDCARD:
            t = t.lower() if lower else t
            t = t.replace("ё", "е").replace("Ё", "Е") if ru_tweaks else t
        out.append((t, m.start(), m.end()))
    return out
