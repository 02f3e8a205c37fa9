"""Sequence expressions and kernels: CTC, forced alignment, chunking, timings, text packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(v: Column) -> Column:
    """Index of the largest, the first of equals; null for null and empty arrays."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def ctc_collapse(symbols: Column, blank: Column) -> Column:
    """Runs of a symbol made one, then blanks dropped."""
    return F.filter(F.filter(symbols, lambda x, i: (i == 0) | (x != F.get(symbols, i - 1))), lambda x: x != blank)


def chunk_bounds(length: Column, segment: int, shift: int, same_shift: bool = False) -> Column:
    """Array of (a, b) that cover [0, length) in pieces of ``segment``, ``shift`` apart; whole numbers.

    The last piece is as long as the others and ends with the audio, or starts one shift after the one before (same_shift).
    """
    n = F.ceil((length - segment) / F.lit(shift)).cast("bigint")
    starts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))), lambda i: i * shift)
    pieces = F.transform(starts, lambda s: F.struct(s.alias("a"), (s + segment).alias("b")))
    tail = n * shift if same_shift else length - segment
    long = F.concat(pieces, F.array(F.struct(tail.cast("bigint").alias("a"), length.cast("bigint").alias("b"))))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), length.cast("bigint").alias("b")))
    return F.when(length <= segment, whole).otherwise(long)


def forced_alignment(logp: np.ndarray, tokens: list[int], blank: int) -> list[tuple[int, int, int]]:
    """(token index, first frame, frame after the last) of the most probable CTC path through these tokens.

    Viterbi over blanks and tokens in turn, a frame at a time. Raises ValueError if there are too few frames, or a blank among the tokens.
    """
    if blank in tokens:
        raise ValueError("a blank among the tokens")
    frames, states = len(logp), 2 * len(tokens) + 1
    need = len(tokens) + sum(a == b for a, b in zip(tokens, tokens[1:]))
    if frames < need:
        raise ValueError("too few frames")
    if not tokens:
        return []
    label = np.full(states, blank)
    label[1::2] = tokens
    leap = np.zeros(states, bool)  # from the token before, over the blank
    leap[3::2] = label[3::2] != label[1:-2:2]
    score = np.full(states, -np.inf)
    score[:2] = logp[0, label[:2]]
    back = np.zeros((frames, states), np.int8)
    for t in range(1, frames):
        one = np.concatenate([[-np.inf], score[:-1]])
        two = np.where(leap, np.concatenate([[-np.inf, -np.inf], score[:-2]]), -np.inf)
        options = np.stack([score, one, two])
        back[t] = options.argmax(0)
        score = options.max(0) + logp[t, label]
    s = states - 1 if score[-1] > score[-2] else states - 2
    path = []
    for t in range(frames - 1, -1, -1):
        path.append(s)
        s -= int(back[t, s])
    path.reverse()
    spans = []
    for t, s in enumerate(path):
        if s % 2:
            k = s // 2
            if spans and spans[-1][0] == k:
                spans[-1] = (k, spans[-1][1], t + 1)
            else:
                spans.append((k, t, t + 1))
    return spans


#: Signs of currency that may stand before or behind an amount.
CURRENCIES = ("$", "€", "¥", "£", "₽", "₹")


def propagate_times(known: list[tuple[str, float, float]], words: list[str]) -> list[tuple[float, float]]:
    """Times of an option's words from those of a timed option: equal head and tail words share theirs; of what is left, one
    word's time is split evenly over several, or one word takes the span of several, or a sign of currency changes its place.
    Raises ValueError where that says nothing, as where words stand against none."""
    if words and not known:
        raise ValueError("no times to take over")
    head = 0
    while head < min(len(known), len(words)) and known[head][0] == words[head]:
        head += 1
    tail = 0
    while tail < min(len(known), len(words)) - head and known[-1 - tail][0] == words[-1 - tail]:
        tail += 1
    a, b = known[head : len(known) - tail], words[head : len(words) - tail]
    if not b:
        middle = []
    elif not a:
        raise ValueError("words without a counterpart")
    elif len(a) == 1:
        step = (a[0][2] - a[0][1]) / len(b)
        middle = [(a[0][1] + i * step, a[0][1] + (i + 1) * step) for i in range(len(b))]
    elif len(b) == 1:
        middle = [(a[0][1], a[-1][2])]
    elif len(a) == len(b) and b[0] in CURRENCIES and a[-1][0] == b[0]:
        middle = [(s, e) for _, s, e in a[:-1]]
        middle.insert(0, middle[0])
    else:
        raise ValueError("more than one word on both sides")
    return [(s, e) for _, s, e in known[:head]] + middle + [(s, e) for _, s, e in known[len(known) - tail :]]


def baseline_option(block: dict) -> int:
    """The option that a truth is timed by: the longest, a single word before as long a one of several."""
    length = lambda o: len(" ".join(t["value"] for t in o)) + 0.5 * (len(o) == 1)
    return max(range(len(block["options"])), key=lambda i: (length(block["options"][i]), -i))


def baseline_words(blocks: list[dict]) -> list[dict]:
    """The words that a truth is timed by, in order; a wildcard has no sound of its own. Raises ValueError for one among the options of a block."""
    for b in blocks:
        if b["is_mv"] and any(t["is_any"] for o in b["options"] for t in o):
            raise ValueError("a wildcard among variants")
    return [t for b in blocks for t in b["options"][baseline_option(b)] if not t["is_any"]]


def _time_options(options: list[list[dict]], base: int, spans: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """Times of all options from one: first to options of as many words, then to the others, from any that has its times already."""
    done: dict[int, list[tuple[float, float]]] = {base: spans} | {i: [] for i, o in enumerate(options) if not o}
    for same_length in (True, False):
        found = True
        while found:
            found = False
            for i in [i for i in done if options[i]]:
                for j in (j for j in range(len(options)) if j not in done):
                    if same_length and len(options[i]) != len(options[j]):
                        continue
                    try:
                        known = [(t["value"], *x) for t, x in zip(options[i], done[i])]
                        done[j] = propagate_times(known, [t["value"] for t in options[j]])
                    except ValueError:
                        continue
                    found = True
                    break
                if found:
                    break
    if len(done) < len(options):
        raise ValueError("no times for " + " ".join(t["value"] for t in next(o for i, o in enumerate(options) if i not in done)))
    return [done[i] for i in range(len(options))]


def fill_times(blocks: list[dict], times: list[tuple[float, float]], finish: float | None = None) -> list[dict]:
    """Times for all tokens of a multivariant truth, given those of ``baseline_words``.

    A wildcard takes all time between its neighbours, from 0 and to ``finish`` (else the last time known) at the ends. Raises ValueError
    where an option cannot be timed, or two wildcards stand side by side.
    """
    words = baseline_words(blocks)
    if len(words) != len(times):
        raise ValueError(f"{len(times)} times for {len(words)} words")
    it, out = iter(times), []
    finish = (times[-1][1] if times else 0.0) if finish is None else finish
    for b in blocks:
        if not b["is_mv"] and b["options"][0][0]["is_any"]:
            out.append(b)
            continue
        base = baseline_option(b)
        spans = _time_options(b["options"], base, [next(it) for _ in b["options"][base]])
        out.append(b | {"options": [[t | {"start_time": s, "end_time": e} for t, (s, e) in zip(o, x)] for o, x in zip(b["options"], spans)]})
    edge = lambda b, pick, key: pick((t[key] for o in b["options"] for t in o if key in t), default=None)
    for i, b in enumerate(out):
        if b["is_mv"] or not b["options"][0][0]["is_any"]:
            continue
        left = edge(out[i - 1], max, "end_time") if i else 0.0
        right = edge(out[i + 1], min, "start_time") if i + 1 < len(out) else finish
        if left is None or right is None or (i and not out[i - 1]["is_mv"] and out[i - 1]["options"][0][0]["is_any"]):
            raise ValueError("a wildcard without neighbours")
        out[i] = b | {"options": [[b["options"][0][0] | {"start_time": left, "end_time": right}]]}
    return out


def merge_sentences(parts: list[str], most: int, smaller_than: int | None = None) -> list[str]:
    """Neighbours joined by a space, the shortest pair first (the first of equals), while it fits and one of them is short."""
    parts = list(parts)
    while True:
        best = None
        for i in range(len(parts) - 1):
            n = len(parts[i]) + len(parts[i + 1]) + 1
            small = smaller_than is None or min(len(parts[i]), len(parts[i + 1])) < smaller_than
            if n <= most and small and (best is None or n < best[0]):
                best = (n, i)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [f"{parts[i]} {parts[i + 1]}"]


def pack_by_space(text: Column, most: int) -> Column:
    """Words packed from left to right into parts of at most ``most`` characters; a longer word stands alone."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, w):
        fits = (F.size(acc) > 0) & (F.length(last(acc)) + 1 + F.length(w) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", last(acc), w)))).otherwise(F.concat(acc, F.array(w)))

    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
        F.aggregate(F.slice(words, 2, F.size(words)), F.array(F.get(words, F.lit(0))), add)
    )


def splice(text: Column, corrections: Column) -> Column:
    """text with (start_pos, end_pos, value) put in, from right to left so that positions stay true."""
    order = F.sort_array(corrections, asc=False)
    return F.aggregate(order, text, lambda s, c: F.concat(F.substr(s, F.lit(1), c["start_pos"]), c["value"], F.substr(s, c["end_pos"] + 1)))
