"""Optimal alignment of a hypothesis with a ground truth of variants and wildcards.

Best is least in (word errors, character errors, minus correct words), in this order. The truth is compiled to a graph:
token nodes with one successor, branch nodes with one successor for each option. A first pass over (node, position in the
hypothesis) finds the fewest word errors from each state to the end, a row at a time; only states that lie on a best path
enter the second pass, which counts characters. Ties go to match, insertion, deletion, absorption by a wildcard, in this
order, and to the first option.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.multivariant import MultivariantError, parse
from tessitura.functions.tokenize import tokens_py

MATCH = T.StructType([
    T.StructField("true_uid", T.IntegerType()), T.StructField("pred_uid", T.IntegerType()), T.StructField("true", T.StringType()), T.StructField("pred", T.StringType()),
    T.StructField("is_any", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("n_char_errors", T.IntegerType()),
])
ALIGNED = T.StructType([
    T.StructField("n_word_errors", T.IntegerType()), T.StructField("n_char_errors", T.IntegerType()), T.StructField("n_correct", T.IntegerType()), T.StructField("true_len", T.IntegerType()),
    T.StructField("options", T.ArrayType(T.IntegerType())), T.StructField("matches", T.ArrayType(MATCH)), T.StructField("error", T.StringType()),
])


@lru_cache(maxsize=1 << 16)
def char_distance(a: str, b: str) -> int:
    """Unit-cost edit distance in characters, by the bits of one number."""
    return edit_errors(a, b)


class Graph:
    """Nodes in order from the end (node 0) to the start (the last): each knows what follows it."""

    def __init__(self, blocks: list[dict]):
        self.token: list[dict | None] = [None]
        self.next: list[int] = [-1]
        self.branch: list[list[int] | None] = [None]
        at = 0
        for b in reversed(blocks):
            starts = []
            for option in b["options"]:
                k = at
                for t in reversed(option):
                    k = self._add(t, k, None)
                starts.append(k)
            at = self._add(None, -1, starts) if b["is_mv"] else starts[0]
        self.start = at

    def _add(self, token, following, branch) -> int:
        self.token.append(token)
        self.next.append(following)
        self.branch.append(branch)
        return len(self.token) - 1


def align(blocks: list[dict], pred: list[str]) -> dict:
    """Best alignment as a dict of the fields of ALIGNED, without error. pred tokens are literal text, never wildcards."""
    g = Graph(blocks)
    n = len(pred)
    ids = {w: i for i, w in enumerate(dict.fromkeys(pred))}
    seq = np.array([ids[w] for w in pred], np.int64)
    step = np.arange(n + 1)
    words = [n - step]
    for k in range(1, len(g.token)):
        if g.branch[k] is not None:
            words.append(np.minimum.reduce([words[s] for s in g.branch[k]]))
            continue
        t, after = g.token[k], words[g.next[k]]
        free = t["is_any"]
        best = after + (0 if free else 1)
        if n:
            best[:-1] = np.minimum(best[:-1], after[1:] + (0 if free else (seq != ids.get(t["value"], -1))))
        words.append(np.minimum.accumulate(best[::-1])[::-1] if free else np.minimum.accumulate((best + step)[::-1])[::-1] - step)
    words = [w.tolist() for w in words]
    # States on some best path, from the start on.
    reach: list[set[int]] = [set() for _ in words]
    reach[g.start].add(0)
    for k in range(len(words) - 1, 0, -1):
        here = words[k]
        if g.branch[k] is not None:
            for j in reach[k]:
                for s in g.branch[k]:
                    if words[s][j] == here[j]:
                        reach[s].add(j)
            continue
        t, nxt = g.token[k], g.next[k]
        after, free, value = words[nxt], t["is_any"], t["value"]
        todo = sorted(reach[k], reverse=True)
        while todo:
            j = todo.pop()
            if j < n:
                if after[j + 1] + (0 if free or pred[j] == value else 1) == here[j]:
                    reach[nxt].add(j + 1)
                if here[j + 1] + (0 if free else 1) == here[j] and j + 1 not in reach[k]:
                    reach[k].add(j + 1)
                    todo.append(j + 1)
            if after[j] + (0 if free else 1) == here[j]:
                reach[nxt].add(j)
    lengths = [len(w) for w in pred]
    suffix = [0] * (n + 1)
    for j in range(n - 1, -1, -1):
        suffix[j] = suffix[j + 1] + lengths[j]
    cost: list[dict[int, tuple[int, int]]] = [{j: (suffix[j], 0) for j in reach[0]}]
    move: list[dict[int, object]] = [{}]
    for k in range(1, len(words)):
        here, c, mv = words[k], {}, {}
        if g.branch[k] is not None:
            for j in reach[k]:
                best = None
                for i, s in enumerate(g.branch[k]):
                    if words[s][j] == here[j] and (best is None or cost[s][j] < best):
                        best, mv[j] = cost[s][j], i
                c[j] = best
        else:
            t, nxt = g.token[k], g.next[k]
            after, free, value = words[nxt], t["is_any"], t["value"]
            for j in sorted(reach[k], reverse=True):
                best = None
                if j < n:
                    same = pred[j] == value
                    if after[j + 1] + (0 if free or same else 1) == here[j]:
                        x, y = cost[nxt][j + 1]
                        best, mv[j] = ((x, y) if free else (x, y - 1) if same else (x + char_distance(value, pred[j]), y)), "match"
                    if not free and here[j + 1] + 1 == here[j]:
                        x, y = c[j + 1]
                        if best is None or (x + lengths[j], y) < best:
                            best, mv[j] = (x + lengths[j], y), "insert"
                if after[j] + (0 if free else 1) == here[j]:
                    x, y = cost[nxt][j]
                    if best is None or (x + (0 if free else len(value)), y) < best:
                        best, mv[j] = (x + (0 if free else len(value)), y), "delete"
                if free and j < n and here[j + 1] == here[j] and (best is None or c[j + 1] < best):
                    best, mv[j] = c[j + 1], "absorb"
                c[j] = best
        cost.append(c)
        move.append(mv)
    matches, options, k, j, true_len = [], [], g.start, 0, 0
    while k:
        step_ = move[k][j]
        if g.branch[k] is not None:
            options.append(step_)
            k = g.branch[k][step_]
            continue
        t = g.token[k]
        if step_ == "insert":
            matches.append(_match(None, j, pred[j]))
            j += 1
            continue
        took = step_ in ("match", "absorb")
        matches.append(_match(t, j if took else None, pred[j] if took else None))
        j += took
        if step_ != "absorb":
            k = g.next[k]
            true_len += not t["is_any"]
    matches += [_match(None, i, pred[i]) for i in range(j, n)]
    chars, minus = cost[g.start][0]
    return {"n_word_errors": words[g.start][0], "n_char_errors": chars, "n_correct": -minus, "true_len": true_len, "options": options, "matches": matches}


def _match(t: dict | None, j: int | None, p: str | None) -> dict:
    if t is None:
        status, chars = "insertion", len(p)
    elif t["is_any"] or t["value"] == p:
        status, chars = "correct", 0
    else:
        status, chars = ("deletion", len(t["value"])) if p is None else ("replacement", char_distance(t["value"], p))
    return {"true_uid": t and t["uid"], "pred_uid": j, "true": t and t["value"], "pred": p, "is_any": bool(t and t["is_any"]), "status": status, "n_char_errors": chars}


_FIELDS = [f.name for f in ALIGNED.fields]


def align_texts(truth: str | None, pred: str | list[str] | None) -> dict:
    """Alignment of a truth's text with a hypothesis, a text or a list of words; unreadable truths give their error."""
    if truth is None or pred is None:
        return dict.fromkeys(_FIELDS)
    try:
        return align(parse(truth), [t for t, _, _ in tokens_py(pred)] if isinstance(pred, str) else list(pred)) | {"error": None}
    except MultivariantError as e:
        return dict.fromkeys(_FIELDS) | {"error": str(e)}


@F.pandas_udf(ALIGNED)
def aligned(truth: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """Alignment of a truth (a text, with variants) and a hypothesis (a text or an array of words). Null for a null text; a truth that cannot be read gives its error."""
    return pd.DataFrame([align_texts(a, b) for a, b in zip(truth, pred)], columns=_FIELDS)


# Declared so that a filter on its result (readable truths) is not moved below it, which would make it run twice.
aligned = aligned.asNondeterministic()


def edit_errors(truth: Sequence[str], pred: Sequence[str]) -> int:
    """Fewest errors between two sequences, a column of the table at a time as bits of one number."""
    m = len(truth)
    if not m:
        return len(pred)
    at: dict[str, int] = {}
    for i, w in enumerate(truth):
        at[w] = at.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, errors = full, 0, m
    for w in pred:
        same = at.get(w, 0)
        diagonal = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(across | up))
        minus = up & across
        errors += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) | 1, minus << 1
        up = full & (minus | ~(diagonal | plus))
        down = plus & diagonal & full
    return errors


@F.pandas_udf(T.IntegerType())
def _edit_errors(truth: pd.Series, pred: pd.Series) -> pd.Series:
    got = [None if a is None or b is None else edit_errors(list(a), list(b)) for a, b in zip(truth, pred)]
    return pd.Series(got, dtype="Int32")


def word_errors(truth: Column, pred: Column) -> Column:
    """Word errors between two token arrays of any length; equal arrays do not leave the JVM."""
    return F.when(truth == pred, F.lit(0)).otherwise(_edit_errors(truth, pred))


def positions(matches: list[dict], times: Sequence, processed: float) -> list[tuple[str, float, float]]:
    """(status, start_time, end_time) of each match of an alignment with a timed truth; times by the number of the truth's word.

    Missing words at the end are 'not_yet'. An insertion lies between the words of the truth around it, from 0 to what was processed.
    """
    head = len(matches)
    while head and matches[head - 1]["status"] == "deletion":
        head -= 1
    span = lambda m: (times[m["true_uid"]]["start_time"], times[m["true_uid"]]["end_time"])
    right, rights = processed, [0.0] * head
    for i in range(head - 1, -1, -1):
        rights[i] = right
        if matches[i]["true_uid"] is not None:
            right = min(right, span(matches[i])[0])
    out, left = [], 0.0
    for i, m in enumerate(matches):
        if m["true_uid"] is None:
            out.append((m["status"], left, rights[i]))
            continue
        s, e = span(m)
        left = max(left, e)
        out.append(("not_yet" if i >= head else m["status"], s, e))
    return out


def capped_errors(matches: Column, most: int = 4) -> Column:
    """Word errors where each run of insertions counts at most ``most``."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("run"))

    def add(s, m):
        ins = m["status"] == "insertion"
        run = F.when(ins, s["run"] + 1).otherwise(F.lit(0))
        return F.struct((s["n"] + F.when(ins, (run <= most).cast("int")).otherwise((m["status"] != "correct").cast("int"))).alias("n"), run.alias("run"))

    return F.aggregate(matches, state, add, lambda s: s["n"])
