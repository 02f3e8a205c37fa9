"""Ground truths with several accepted variants: {a|b} blocks and the wildcard <*>.

Every element of a parsed truth is a block, a list of options, which are lists of tokens; a plain token is a block of one option.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.tokenize import WILDCARD, tokens_py

TOKEN = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("is_any", T.BooleanType()), T.StructField("uid", T.IntegerType()),
    T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()),
])
BLOCK = T.StructType([
    T.StructField("options", T.ArrayType(T.ArrayType(TOKEN))), T.StructField("is_mv", T.BooleanType()), T.StructField("pos_start", T.IntegerType()), T.StructField("pos_end", T.IntegerType()),
])
PARSED = T.StructType([T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("error", T.StringType())])

_BLOCKS = re.compile(r"\{([^{}]*)\}")
_REPEAT = re.compile(r"(\w)\+")
_SUFFIX = re.compile(r"(\w+)<(\w+)>")


class MultivariantError(ValueError):
    """A truth that breaks the rules of blocks."""


def _variants(option: str) -> list[str]:
    """What one written option stands for: {o+} for one to four letters, {base<suf>} for three spellings."""
    bare = option.strip()
    if m := _REPEAT.fullmatch(bare):
        return [m[1] + m[1].lower() * n for n in range(4)]
    if m := _SUFFIX.fullmatch(bare):
        return [m[1], m[1] + m[2], f"{m[1]}-{m[2]}"]
    return [option]


def parse(text: str, method: str = "default", drop_punct: bool = True, lower: bool = True, ru_tweaks: bool = True) -> list[dict]:
    """Blocks of a truth, tokens numbered as they are written. Raises MultivariantError for nested, glued, empty or unbalanced blocks."""
    blocks, uid, pos = [], 0, 0

    def tokens(part: str, shift: int) -> list[dict]:
        nonlocal uid
        out = []
        for value, a, b in tokens_py(part, method, drop_punct, lower, ru_tweaks):
            out.append({"value": value, "is_any": value == WILDCARD, "uid": uid, "start_pos": a + shift, "end_pos": b + shift})
            uid += 1
        return out

    def plain(part: str, shift: int) -> None:
        if "{" in part or "}" in part:
            raise MultivariantError("braces do not match")
        for t in tokens(part, shift):
            blocks.append({"options": [[t]], "is_mv": False, "pos_start": t["start_pos"], "pos_end": t["end_pos"]})

    for m in _BLOCKS.finditer(text):
        plain(text[pos : m.start()], pos)
        pos = m.end()
        if (m.start() and not text[m.start() - 1].isspace()) or (pos < len(text) and not text[pos].isspace()):
            raise MultivariantError("a block needs a space on both sides")
        options, at = [], m.start() + 1
        for written in m[1].split("|"):
            for v in _variants(written):
                options.append(tokens(v, at))
            at += len(written) + 1
        if len(options) == 1:
            if not options[0]:
                raise MultivariantError("empty block")
            options.append([])
        blocks.append({"options": options, "is_mv": True, "pos_start": m.start(), "pos_end": pos})
    plain(text[pos:], pos)
    return blocks


@F.pandas_udf(PARSED)
def parse_multivariant(text: pd.Series) -> pd.DataFrame:
    """(blocks, error) of a truth: one of them is null; both are for a null text."""
    blocks, errors = [], []
    for t in text:
        try:
            blocks.append(None if t is None else parse(t))
            errors.append(None)
        except MultivariantError as e:
            blocks.append(None)
            errors.append(str(e))
    return pd.DataFrame({"blocks": blocks, "error": errors})


# Declared so that a filter on the error does not make it run twice.
parse_multivariant = parse_multivariant.asNondeterministic()


def render(blocks: list[dict]) -> str:
    """Text of blocks: tokens joined by spaces, variants as {a|b}."""
    join = lambda option: " ".join(t["value"] for t in option)
    return " ".join("{" + "|".join(map(join, b["options"])) + "}" if b["is_mv"] else join(b["options"][0]) for b in blocks)


def resolve(blocks: list[dict], choice: list[int]) -> list[dict]:
    """The single-variant tokens under one choice of option for each block of several, in order."""
    picks = iter(choice)
    out = []
    for b in blocks:
        k = next(picks) if b["is_mv"] else 0
        if not 0 <= k < len(b["options"]):
            raise IndexError("no such option")
        out += b["options"][k]
    if next(picks, None) is not None:
        raise IndexError("more choices than blocks")
    return out


def starting_part(blocks: list[dict], time: float) -> list[dict]:
    """What of a timed truth was said by ``time``: tokens carry start_time and end_time.

    A token under way becomes {token|}; in a block under way every option is cut to the tokens begun, and once more without
    the one under way.
    """
    out = []
    for b in blocks:
        filled = [o for o in b["options"] if o]
        start = min((o[0]["start_time"] for o in filled), default=float("inf"))
        end = max((o[-1]["end_time"] for o in filled), default=float("-inf"))
        if start >= time:
            break
        if end <= time:
            out.append(b)
            continue
        options = []
        for o in b["options"] if b["is_mv"] else [b["options"][0], []]:
            begun = [t for t in o if t["start_time"] < time]
            options.append(begun)
            if b["is_mv"] and begun and begun[-1]["end_time"] > time:
                options.append(begun[:-1])
        out.append({"options": options, "is_mv": True, "pos_start": b["pos_start"], "pos_end": b["pos_end"]})
        break
    return out
