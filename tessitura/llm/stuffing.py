"""Pages that are repeated keywords, lists of links or product tags rather than sentences.

The words of a page form a suffix automaton, here in array form for many pages at once: the prefixes of each page sorted by their
ends. What two neighbours in that order share is the length of a state, and the longer of a prefix's two is the longest
repeated stretch that ends at its last word; the union of these stretches is what the page says over and over.

Repetition alone condemns nothing (refrains, glossaries and templates repeat as well), so it is combined with what a clause
shows in any language, without word lists: several words, most of which are new where they stand. A keyword comes back within a few
words; a sentence does not repeat itself, whatever function words it has, since these are short and what counts is characters. A
sentence said again word for word counts as it did the first time. Only characters that are repeated, or belong to a link, a
tag or an enumeration, in a stretch of text without clauses count. A page is stuffed if more than half of its characters count.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.session import at_least_parallel

#: What a clause needs: this many words, and at least this share of its characters in words that are no keywords there.
CLAUSE_WORDS, FRESH_SHARE = 5, 0.5
#: Below this share a clause is sure only beside another. No clause has more than this share in words that come back, however often they stand in the page.
SURE_SHARE, DOUBLED_SHARE = 0.75, 0.67
#: A keyword stands so often in the page, and comes back within so many words.
OFTEN, NEAR = 3, 6
#: A line that does not end as sentences do needs this many words.
OPEN_WORDS = 8
#: A stretch without clauses counts whole once this share of it is repeated, linked or tagged; below, only that share counts.
LIST_SHARE = 1 / 3
#: An enumeration has at least so many items of at most so many words on average.
LIST_ITEMS, ITEM_WORDS = 5, 6

LINK = r"""<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s)\]>|;,"']+"""
#: What is listed rather than said: links and tags.
LISTED = regex.compile(LINK + r"|(?<![\w&/])[#@][\p{L}\p{N}_]+", regex.I)
LISTED_MARKS = ("#", "@", "://", "www.", "](", "<a", "WWW.", "<A")
#: Ends of sentences before a space within a line.
SENTENCE = regex.compile(r"[.!?…。！？][\"'”»)]*\s+(?=\S)")
END_SIGNS, CLOSERS = tuple(".!?…。！？"), "\"'”») \t\r\f\v"
CUE = regex.compile(r"^\s*(?:\d+|[\d:.,]+\s*-->\s*[\d:.,]+)\s*$")
SPEECH = regex.compile(r"^\s*(?:[-–—•*>]+\s+|[\p{L}][\p{L}\p{M}\p{N} _.-]{0,30}\s?:\s+(?!https?://|www\.|<a\s|\[)|[\p{L}][\p{L}\p{M}\p{N} _]{0,30}\s[-–—]\s+)")
ANSWER = regex.compile(r"^[^.!?…\n|/;,]{1,40}[.!?…]+\s*$|^\([^()\n]*\)\s*$")

#: Classes of characters, as bits.
_WORD, _LETTER, _DIGIT, _JOIN, _SPACE, _BREAK, _POINT, _SIGN, _ALONE = 1, 2, 4, 8, 16, 32, 64, 128, 256
#: Scripts written without spaces, as beginnings of the names of their characters: each character is a word.
UNSPACED = ("CJK ", "HIRAGANA ", "KATAKANA ", "THAI ", "LAO ", "KHMER ", "MYANMAR ")
#: Characters handled at once (arrays that stay in a core's cache); a longer page is handled alone.
CHUNK = 200_000


def _scrambled(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (a finalizer of multiplications and shifts)."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Characters:
    """Class and lower case of every character met so far."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        self.kind = np.zeros(0x110000, np.uint16)
        self.fold = np.arange(0x110000, dtype=np.uint32)

    def learn(self, codes: np.ndarray) -> None:
        for c in np.flatnonzero(np.bincount(codes, minlength=0x110000).astype(bool) & ~self.known).tolist():
            s, cat = chr(c), unicodedata.category(chr(c))
            k = _WORD if cat[0] in "LMN" or s == "_" else 0
            k |= _LETTER if cat[0] in "LN" else 0
            k |= _DIGIT if cat == "Nd" else 0
            k |= _JOIN if s in "'’.,-" else 0
            k |= _SPACE if s.isspace() else 0
            k |= _BREAK if s in ";," else 0
            k |= _POINT if s in ".," else 0
            k |= _SIGN if s in "/|•·*–—-" else 0
            k |= _ALONE if cat == "Lo" and unicodedata.name(s, "").startswith(UNSPACED) else 0
            low = s.casefold()
            self.kind[c], self.fold[c], self.known[c] = k, ord(low) if len(low) == 1 else c, True


_CHARACTERS = _Characters()


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1] & False, x[:-1]])


def _after(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[1:], x[:1] & False])


def longest_repeats(ids: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """For each word the length of the longest stretch that ends there and occurs in its page once more.

    ids and pages are whole numbers, pages in ascending order. Prefixes are ranked by their last 1, 2, 4, ... words until all
    differ; only those still tied are sorted again. The ranks of each width then give, from wide to narrow, how much two neighbours share.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(pages.astype(np.int64) << 32 | ids, return_inverse=True)
    first = np.searchsorted(pages, pages)  # the page's first word
    at = np.arange(n)
    ranks, width = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while True:
        now = ranks[-1][order]
        same = np.concatenate([[False], now[1:] == now[:-1]])
        tied = same | np.concatenate([same[1:], [False]])
        # Prefixes shorter than the width are ranked already: they come first among their equals.
        if not tied.any() or width > n:
            break
        rows = order[tied]
        back = rows - width
        second = np.where(back >= first[rows], ranks[-1][np.maximum(back, 0)].astype(np.int64) + 1, 0)
        key = now[tied].astype(np.int64) << 32 | second
        by = np.argsort(key, kind="stable")
        order[tied] = rows[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # A rank is the place of the first of its equals in the order, so that ranks of the untied stay true.
        place = np.flatnonzero(tied)
        mine = place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        nxt = ranks[-1].copy()
        if width == 1:
            lead = np.maximum.accumulate(np.where(~same, at, 0))
            nxt[order] = lead
        nxt[order[tied]] = mine
        ranks.append(nxt)
        width *= 2
    # What neighbours in the order share: step back by the widest stretch they have in common, then by half of it, and so on.
    p, q = order[1:].copy(), order[:-1].copy()
    shared = np.zeros(n - 1, np.int64)
    alive = np.ones(n - 1, bool)
    for k in range(len(ranks) - 1, -1, -1):
        w = 1 << k
        whole = alive & (p - w + 1 >= first[np.maximum(p, 0)]) & (q - w + 1 >= first[np.maximum(q, 0)]) & (pages[order[1:]] == pages[order[:-1]])
        eq = whole & (ranks[k][np.maximum(p, 0)] == ranks[k][np.maximum(q, 0)])
        shared[eq] += w
        p[eq] -= w
        q[eq] -= w
        alive &= (p >= first[order[1:]]) & (q >= first[order[:-1]])
    out = np.zeros(n, np.int64)
    np.maximum.at(out, order[1:], shared)
    np.maximum.at(out, order[:-1], shared)
    return out


def covered(longest: np.ndarray) -> np.ndarray:
    """Which words lie in one of the stretches that end at, and have the lengths, given."""
    n = len(longest)
    starts = np.arange(n) - longest + 1
    return np.minimum.accumulate(starts[::-1])[::-1] <= np.arange(n) if n else np.zeros(0, bool)


class _Units:
    """Lines, and the sentences in them, of a group of pages: offsets into the joined text."""

    def __init__(self):
        #: start, end, line, head, ended, cue and page of each unit, one after the other.
        self.flat: list[int] = []
        self.lines = 0

    def add_page(self, page: int, text: str, base: int) -> None:
        at = base
        for line in text.split("\n"):
            if line and not line.isspace():
                self._line(page, line, at)
            at += len(line) + 1

    def _line(self, page: int, line: str, at: int) -> None:
        first, start = line.lstrip()[0], line[:40]
        cue = first.isdigit() and CUE.match(line) is not None
        head = 0
        if not cue and (":" in start or not first.isalnum() or " - " in start or " – " in start or " — " in start) and (m := SPEECH.match(line)):
            head = m.end()
        x, flat = 0, self.flat
        # A label of one who speaks, or a glossary's entry, goes with what follows.
        for m in SENTENCE.finditer(line):
            y = m.end()
            if y > head:
                flat += (at + x, at + y, self.lines, at + head, True, cue, page)
                x = y
        if x < len(line):
            flat += (at + x, at + len(line), self.lines, at + head, line.rstrip(CLOSERS)[-1:] in END_SIGNS, cue, page)
        self.lines += 1


def stuffed_shares(texts: list[str | None]) -> list[float]:
    """Share of each page's visible characters that are stuffing; 0 for null, empty and blank texts."""
    out, group, size = [0.0] * len(texts), [], 0
    for i, t in enumerate(texts):
        if t is None or not t or t.isspace():
            continue
        if group and size + len(t) > CHUNK:
            _shares(group, texts, out)
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    if group:
        _shares(group, texts, out)
    return out


def _shares(group: list[int], texts: list[str | None], out: list[float]) -> None:
    units, base = _Units(), 0
    link_at: list[int] = []
    link_to: list[int] = []
    bases = []
    for k, i in enumerate(group):
        t = texts[i]
        bases.append(base)
        units.add_page(k, t, base)
        if any(m in t for m in LISTED_MARKS) or "HTTP" in t.upper():
            for m in LISTED.finditer(t):
                link_at.append(base + m.start())
                link_to.append(base + m.end())
        base += len(t) + 1
    text = "\n".join([texts[i] for i in group])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _CHARACTERS.learn(codes)
    kind = _CHARACTERS.kind[codes]
    has = lambda bit: (kind & bit) != 0
    word, space = has(_WORD), has(_SPACE)
    token = word | (has(_JOIN) & _before(word) & _after(has(_LETTER)))
    digit = has(_DIGIT)
    number = digit | (has(_POINT) & _before(digit) & _after(digit))
    alone = has(_ALONE)
    opens = token & (~_before(token) | alone | _before(alone))
    where = np.flatnonzero(opens)
    n = len(where)
    if not n:
        return
    till = np.flatnonzero(token & (~_after(token) | alone | _after(alone))) + 1
    length = till - where
    # Prices and model numbers count as one: a run of digits is one sign.
    kept = token & ~(number & _before(number) & ~opens)
    keep = np.flatnonzero(kept)
    owner = np.cumsum(opens)[keep] - 1
    begins = np.cumsum(kept)[where] - 1
    rank = np.arange(len(keep)) - begins[owner]
    sign = _scrambled(np.where(number[keep], ord("0"), _CHARACTERS.fold[codes[keep]]))
    step = np.full(int(rank.max()) + 1, 0xD1342543DE82EF95, np.uint64)
    step[0] = 1
    hashes = np.add.reduceat(sign * np.cumprod(step)[rank], begins)
    digits = np.concatenate([[0], np.cumsum(number)])
    figure = digits[till] - digits[where] == length
    _, ids = np.unique(hashes, return_inverse=True)
    page = np.searchsorted(np.array(bases), where, "right") - 1
    linked = np.zeros(n, bool)
    if link_at:
        k = np.searchsorted(np.array(link_at), where, "right") - 1
        linked = (k >= 0) & (where < np.array(link_to)[np.maximum(k, 0)])
    longest = longest_repeats(ids, page)
    again = covered(longest)

    # Units as ranges of words.
    a, b, line, head, ended, cue, upage = np.array(units.flat).reshape(-1, 7).T
    ended, cue = ended.astype(bool), cue.astype(bool)
    lo, hi = np.searchsorted(where, a), np.searchsorted(where, b)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    between = lambda s: s[hi] - s[lo]
    spoken = ~linked
    words, chars = between(sums(spoken)), between(sums(length * spoken))
    # Refrains: units that lie in a repeated stretch and were said before in this page; they are as they were the first time.
    size = hi - lo
    full = (size >= 3) & (longest[np.maximum(hi - 1, 0)] >= size)
    told = np.arange(len(a))
    rows = np.flatnonzero(full)
    if len(rows):
        every = np.repeat(np.arange(len(rows)), size[rows])
        off = np.arange(len(every)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
        step = np.full(int(size[rows].max()) + 1, 0xA0761D6478BD642F, np.uint64)
        key = np.add.reduceat(_scrambled(ids[lo[rows][every] + off]) * np.cumprod(step)[off], np.cumsum(size[rows]) - size[rows])
        key = key ^ _scrambled(upage[rows])
        _, earliest, inverse = np.unique(key, return_index=True, return_inverse=True)
        told[rows] = rows[earliest[inverse]]
    once = np.ones(n, bool)
    for u in np.flatnonzero(told != np.arange(len(a))).tolist():
        once[lo[u] : hi[u]] = False
    # Words that come back within a few words, links and refrains left out.
    stream = np.flatnonzero(once & spoken)
    near = np.zeros(n, bool)
    if len(stream):
        own = page[stream].astype(np.int64) << 32 | ids[stream]
        by = np.argsort(own, kind="stable")
        close = (own[by][1:] == own[by][:-1]) & (by[1:] - by[:-1] <= NEAR)
        near[stream[by[1:][close]]] = True
        near[stream[by[:-1][close]]] = True
    _, which, often = np.unique(page.astype(np.int64) << 32 | ids, return_inverse=True, return_counts=True)
    doubled = between(sums(length * (near & spoken)))
    driven = between(sums(length * (near & spoken & (often[which] >= OFTEN))))
    blank = _before(space) & space
    gap = (has(_BREAK) & _after(space)) | (has(_SIGN) & _before(space) & _after(space)) | (blank & ~_before(blank)) | (codes == 9)
    gaps = np.concatenate([[0], np.cumsum(gap)])
    items = gaps[b] - gaps[a] + 1
    listed = (items >= LIST_ITEMS) & (size <= ITEM_WORDS * items)
    # Links inside a sentence belong to it; a list has few words for each.
    links = np.searchsorted(np.array(link_at), b) - np.searchsorted(np.array(link_at), a)
    clause = (words >= np.where(ended, CLAUSE_WORDS, OPEN_WORDS) * np.maximum(links, 1)) & (driven <= (1 - FRESH_SHARE) * chars) & (doubled <= DOUBLED_SHARE * chars) & ~(listed & ~ended)
    # One that repeats itself a little goes with its neighbours: among keywords, and beside no sure clause, it is none.
    doubt = clause & (doubled > (1 - SURE_SHARE) * chars)
    keywords = ~clause & ~cue & (words > 1) & (head <= a) & (2 * between(sums(length * again)) >= between(sums(length)))
    spot = np.flatnonzero(~cue)
    sure, driving, own = (clause & ~doubt)[spot], keywords[spot], upage[spot]
    beside = own[1:] == own[:-1]
    supported, pressed = np.zeros(len(spot), bool), np.zeros(len(spot), bool)
    for here, there in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        supported[here] |= beside & sure[there]
        pressed[here] |= beside & driving[there]
    clause[spot] &= ~doubt[spot] | supported | ~pressed
    clause = clause[told]

    columns = [a, b, line, head, cue, clause, listed, size]
    columns += [between(sums(x)) for x in (figure, length * (again | linked), length, again, linked)]
    first = np.searchsorted(upage, np.arange(len(group) + 1))
    for k in np.unique(upage[~clause & ~cue]).tolist():
        out[group[k]] = _page_share(text, list(zip(*[c[first[k] : first[k + 1]].tolist() for c in columns])))


def _page_share(text: str, rows: list[tuple]) -> float:
    """Share of one page from its units: stretches between clauses count by what of them is repeated, linked, tagged or enumerated."""
    total = stuffed = block = hit = every = 0.0

    def close() -> float:
        share = hit / every if every else 0.0
        return block * (1.0 if share >= LIST_SHARE else share)

    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][2] == rows[i][2]:
            j += 1
        line, i = rows[i:j], j
        width = len(text[line[0][0] : line[-1][1]].strip())
        if line[0][4]:  # a caption's number or time
            continue
        total += width
        numbers = sum(u[8] for u in line)
        if numbers >= 3 and 2 * numbers >= sum(u[7] for u in line):  # a row of figures
            continue
        alone, among = len(line) == 1, any(u[5] for u in line)
        for a, b, _, head, _, clause, listed, size, _, hits, chars, repeats, links in line:
            # Links inside a sentence belong to it; so do short answers that stand alone or among sentences.
            said = not clause and (alone or (among and 2 * repeats < size))
            if clause or (said and not links and ANSWER.match(text[max(a, head) : b].strip())):
                stuffed += close()
                block = hit = every = 0.0
                continue
            block += len(text[a:b].strip())
            every += chars
            hit += chars if listed else hits
    stuffed += close()
    return stuffed / total if total else 0.0


def stuffed_share(text: str | None) -> float:
    """Share of one page."""
    return stuffed_shares([text])[0]


@F.pandas_udf(T.DoubleType())
def _share(text: pd.Series) -> pd.Series:
    return pd.Series(stuffed_shares(text.tolist()), dtype="float64")


def stuffing(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, share): the share of each page that is stuffing. A page is read whole and alone, so no shuffle is needed.

    The function is declared nondeterministic so that a later filter neither makes it run twice nor moves it to fewer tasks.
    """
    return at_least_parallel(df.select(F.col(ident).alias("__i"), F.col(text).alias("__t"))).select(F.col("__i").alias(ident), _share.asNondeterministic()("__t").alias("share"))


def stuffed_pages(df: DataFrame, ident: str = "doc_id", text: str = "text", over: float = 0.5) -> DataFrame:
    return stuffing(df, ident, text).filter(F.col("share") > over)
