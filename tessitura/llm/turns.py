"""Raw timed transcripts into clean, ordered speaker turns.

Timed texts are swept in order of start_time within slots of a recording's time, so that no task holds a whole recording: each
slot finds its own runs, and only the first and last run of a slot meet those of its neighbours.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.asof import overlap_pairs
from tessitura.operators.intervals import speaker_periods, to_ms
from tessitura.operators.windows import previous, running
from tessitura.session import at_least_parallel, materialize

#: Words that say a bracket holds a sound or a transcriber's note, as beginnings of words in lower case.
SOUNDS = (
    "laugh", "chuckl", "giggl", "cough", "sneez", "sigh", "breath", "inhal", "exhal", "gasp", "groan", "yawn", "sob", "cry", "whistl", "hum", "clap", "applau", "cheer",
    "music", "sing", "song", "jingle", "nois", "silen", "paus", "crosstalk", "overlap", "inaudib", "unintellig", "unclear", "indistinct", "background", "static", "beep", "phone", "ring", "knock", "door", "click", "throat",
    "lach", "gelächter", "hust", "nies", "seufz", "atm", "stöhn", "gähn", "beifall", "applaus", "klatsch", "musik", "rausch", "geräusch", "stille", "unverständlich", "durcheinander", "räusper", "klingel", "hintergrund",
    "rire", "applaud", "musique", "toux", "tousse", "soupir", "bruit", "inaudible", "chuchot", "risa", "ríe", "aplaus", "música", "tos", "suspir", "ruido", "silencio", "ininteligible", "murmull",
    "смех", "смеёт", "смеет", "кашел", "кашля", "вздох", "вздых", "вдох", "выдох", "дыхан", "аплодисмент", "хлоп", "музык", "шум", "пауз", "тишин", "неразборчив", "звон", "стук", "фон", "зева", "помех",
)
#: Words before a speaker's number.
SPEAKER_WORDS = ("speaker", "спикер", "sprecher", "spk", "s")
#: Words that show a text is English, where a bare "er" or "um" is a filler; elsewhere they may be words.
ENGLISH = frozenset(("the", "a", "an", "and", "of", "to", "is", "it", "that", "we", "you", "this", "was", "for", "with", "they", "every", "please", "my", "our", "yes", "right", "my", "what", "because", "are", "were", "not", "from", "says", "could", "would", "had", "have", "nobody"))
WORDLIKE = frozenset(("er", "um"))
#: A note has at most so many words, in square or angle brackets without a word for a sound; with one, so many.
NOTE_WORDS, SOUND_WORDS = 2, 4

_FILLER = r"(?:u+h+m*|u+m+|e+r+m+|er+|h+m+|m+h+m*|m{2,}|ä+h+m*|ö+h*m*|э+(?:-э+)*м*|м{2,}|хм+)"
FILLERS = re.compile(rf"(?<![\w-]){_FILLER}(?![\w-])(?:\.{{2,}}|…|,)?", re.I)
_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_FULL = r"\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?"
STAMPS = re.compile(rf"(?:[\[(<]\s*(?:{_CLOCK}|\d+(?:[.,]\d+)?\s*s)\s*(?:-->?\s*{_CLOCK}\s*)?[\])>]|{_FULL}(?:\s*-->(?:\s*{_FULL})?)?)\s*")
NOTES = re.compile(r"\(\([^()]*\)\)|\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\*+[^*]+\*+|[♪♫][^♪♫]*[♪♫]|[♪♫]")
SOUND = re.compile(rf"(?<!\w)(?:{'|'.join(SOUNDS)})", re.I)
MARKS = re.compile(r"[\[(<*♪♫:]")
WORD = re.compile(r"\w")
WORDS = re.compile(r"\w+")
SPACES = re.compile(r"\s+")
BEFORE_MARK = re.compile(r"\s+([,.;:!?…])")
LOOSE_MARKS = tuple(f" {c}" for c in ",.;:!?…")
NUMBERED = re.compile(rf"(?:{'|'.join(SPEAKER_WORDS)})[\s_]*#?\s*(\d{{1,9}})", re.I)


def _noted(m: re.Match) -> str:
    """What stays of a bracket: nothing of a note on a sound, the words of emphasis, the whole of a remark somebody spoke."""
    whole = m[0]
    if whole[0] in "♪♫":
        return " "
    words = WORDS.findall(whole)
    if not words or (len(words) <= SOUND_WORDS and SOUND.search(whole)) or (whole[0] in "[<" and len(words) <= NOTE_WORDS):
        return " "
    return f" {whole.strip('*')} " if whole[0] == "*" else whole


@dataclass
class Parsed:
    speaker: int | None
    text: str
    spoken: bool


class Grammar:
    """Reads the head of a text (timestamps and at most one speaker label, in either order) and cleans the rest.

    aliases maps lower-case names to speaker numbers. A label is a name or a numbered speaker that stands in square, round
    or angle brackets, or after '>>' and before a colon, or before a colon or a dash with a space on both sides.
    """

    def __init__(self, aliases: dict[str, int]):
        self.aliases = aliases
        most = max([30, *map(len, aliases)])
        held = {"[": (r"\[", r"\]", r"\[\]"), "(": (r"\(", r"\)", "()"), "<": ("<", ">", "<>")}
        self.held = {k: re.compile(rf"{a}\s*([^{no}]{{1,{most}}}?)\s*{z}\s*:?\s*") for k, (a, z, no) in held.items()}
        self.quoted = re.compile(rf">>\s*([^:]{{1,{most}}}?)\s*:\s*")
        self.bare = re.compile(rf"([\w#][\w# .'-]{{0,{most}}}?)\s*:(?!\d)\s*"), re.compile(rf"([\w#][\w# .']{{0,{most}}}?)\s+[-–—](?:\s+|$)")

    def who(self, name: str) -> int | None:
        name = SPACES.sub(" ", name.lower())
        found = self.aliases.get(name)
        if found is None and (m := NUMBERED.fullmatch(name)):
            found = int(m[1])
        return found if found is None or found < 2**31 else None

    def label(self, text: str, pos: int) -> tuple[int, int] | None:
        """(speaker, end of the label), if there is one here."""
        first = text[pos : pos + 1]
        if first in self.held:
            tries = (self.held[first],)
        elif first == ">":
            tries = (self.quoted,)
        else:
            tries = self.bare
        for pattern in tries:
            if (m := pattern.match(text, pos)) and (speaker := self.who(m[1])) is not None:
                return speaker, m.end()
        return None

    def parse(self, text: str | None) -> Parsed:
        if text is None:
            return Parsed(None, "", False)
        pos, speaker = len(text) - len(text.lstrip()), None
        while pos < len(text):
            if (text[pos] in "[(<" or text[pos].isdigit()) and (m := STAMPS.match(text, pos)):
                pos = m.end()
            elif speaker is None and (found := self.label(text, pos)):
                speaker, pos = found
            else:
                break
        body = text[pos:]
        if MARKS.search(body):
            body = NOTES.sub(_noted, STAMPS.sub(" ", body))
        if FILLERS.search(body):
            bare = FILLERS.sub(" ", body)
            if WORD.search(bare) and not any(w in ENGLISH for w in WORDS.findall(bare.lower())):
                bare = FILLERS.sub(lambda m: m[0] if m[0].lower() in WORDLIKE else " ", body)
            body = bare
        if not WORD.search(body):
            return Parsed(speaker, "", False)
        body = " ".join(body.split())
        if any(m in body for m in LOOSE_MARKS):
            body = BEFORE_MARK.sub(r"\1", body)
        return Parsed(speaker, body, True)


def repeated_words(before: list[str], words: list[str]) -> int:
    """How many first words of a text repeat the last ones before it: the longest suffix of one that is a prefix of the other.

    One repeated word alone is no roll ("Yes." after "Yes." was said twice); linear, by the prefix function. Only as many words as the
    text has can matter of what came before.
    """
    if len(words) < 2:
        return 0
    key = [w.casefold() for w in words]
    seq = [*key, None, *(w.casefold() for w in before[-len(words) :])]
    fail = [0] * len(seq)
    for i in range(1, len(seq)):
        k = fail[i - 1]
        while k and seq[i] != seq[k]:
            k = fail[k - 1]
        fail[i] = k + (seq[i] == seq[k])
    k = fail[-1] if before else 0
    return k if k >= 2 else 0


def fresh_words(before: str, text: str) -> str:
    """text without the words that repeat the end of what came before (rolling captions)."""
    words = text.split()
    k = repeated_words(before.split(), words)
    return " ".join(words[k:]) if k else text


PARSED = T.StructType([T.StructField("speaker", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("spoken", T.BooleanType())])
#: An alias table is a dictionary of names: more rows than this are no alias table and raise an error.
MAX_ALIASES = 10_000


def alias_map(speaker_alias: DataFrame) -> dict[str, int]:
    rows = speaker_alias.select("alias", "speaker_idx").dropna().limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} speaker aliases")
    return {SPACES.sub(" ", r["alias"].strip().lower()): r["speaker_idx"] for r in sorted(rows, key=lambda r: -r["speaker_idx"]) if r["alias"].strip()}


def spoken_texts(timed_text: DataFrame, aliases: dict[str, int]) -> DataFrame:
    """rec_id, seg_id, start_time, end_time, label, clean: the texts with a spoken word, parsed."""

    @F.pandas_udf(PARSED)
    def parse(text: pd.Series) -> pd.DataFrame:
        grammar = Grammar(aliases)
        got = [grammar.parse(t) for t in text]
        return pd.DataFrame({"speaker": pd.array([p.speaker for p in got], "Int32"), "text": [p.text for p in got], "spoken": [p.spoken for p in got]})

    rows = timed_text.filter("rec_id is not null and seg_id is not null and text is not null").select("rec_id", "seg_id", "start_time", "end_time", "text")
    rows = at_least_parallel(rows).select("rec_id", "seg_id", "start_time", "end_time", parse.asNondeterministic()("text").alias("p"))
    return rows.filter("p.spoken").select("rec_id", "seg_id", "start_time", "end_time", F.col("p.speaker").alias("label"), F.col("p.text").alias("clean"))


def covering_speaker(texts: DataFrame, periods: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """rec_id, seg_id, heard: the speaker whose periods cover most of each text's time; equal covers go to the lower number."""
    raw = texts.select("rec_id", "seg_id", to_ms(F.col("start_time")).alias("s"), to_ms(F.col("end_time")).alias("e")).filter("e > s")
    # Read for the join and for its levels: written once, the periods are found once.
    p = materialize(periods.filter("kind = 'period'").select("rec_id", "speaker_idx", F.col("start_ms").alias("rs"), F.col("end_ms").alias("re")), "periods")
    total = overlap_pairs(raw.distinct(), p, ["rec_id"], bin_ms, (raw, p)).groupBy("rec_id", "seg_id", "speaker_idx").agg(F.sum("overlap").alias("ms"))
    best = total.groupBy("rec_id", "seg_id").agg(F.max(F.struct("ms", (-F.col("speaker_idx")).alias("minus"))).alias("m"))
    return best.select("rec_id", "seg_id", (-F.col("m.minus")).cast("int").alias("heard"))


def calibrated_pause(timed_text: DataFrame, quantile: float = 0.95, slot_s: float = 600.0) -> float:
    """Seconds of pause that only 1 - quantile of all neighbouring texts exceed, over the whole table."""
    rows = timed_text.filter("rec_id is not null and seg_id is not null and start_time is not null").select("rec_id", "seg_id", "start_time", "end_time").distinct()
    rows = running(rows, ["rec_id"], ["start_time", "seg_id"], F.floor(F.col("start_time") / slot_s), {"said": ("max", F.col("end_time"))}, inclusive=False)
    got = rows.select((F.col("start_time") - F.col("said")).alias("pause")).filter("pause > 0").agg(F.percentile_approx("pause", quantile, 10_000)).first()[0]
    return float("inf") if got is None else float(got)


@F.pandas_udf(T.IntegerType())
def _rolled(before: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([0 if a is None or b is None else repeated_words(a.split(" "), b.split(" ")) for a, b in zip(before, text)], dtype="Int32")


def rolling_captions(timed_text: DataFrame, slot_s: float = 600.0) -> DataFrame:
    """rec_id, seg_id, n_repeated: how many first words of each text roll on from the text before it, as written, in order of start_time, then seg_id.

    Null texts, and rows without rec_id, seg_id or start_time, do not count; repeated rows count once.
    """
    rows = timed_text.filter("rec_id is not null and seg_id is not null and start_time is not null and text is not null").select("rec_id", "seg_id", "start_time", "text").distinct()
    rows = previous(rows, ["rec_id"], ["start_time", "seg_id", "text"], F.floor(F.col("start_time") / slot_s), {"before": "text"})
    return rows.select("rec_id", "seg_id", _rolled("before", "text").alias("n_repeated"))


@F.pandas_udf(T.StringType())
def _joined(parts: pd.Series) -> pd.Series:
    """Texts of one turn, in order, without what rolling captions repeat."""
    out = []
    for p in parts:
        said: list[str] = []
        for t in p:
            words = t.split()
            said += words[repeated_words(said, words) :]
        out.append(" ".join(said))
    return pd.Series(out)


def speaker_turns(timed_text: DataFrame, diarization_segment: DataFrame, speaker_alias: DataFrame, pause: float | None = None, slot_s: float = 600.0, with_text: bool = True) -> DataFrame:
    """rec_id, speaker_idx, first_seg_id, last_seg_id, start_time, n_texts, text: the clean turns of each recording (text: if asked for).

    Texts go in order of start_time, then seg_id. Texts without a spoken word belong to no turn and interrupt none. The speaker
    is the one labelled at the head of the text, else the one whose periods cover most of its time; where neither is known
    (no label, no end_time or nobody heard) it is null, and such texts make turns of their own. A turn ends where the speaker
    changes and, with ``pause`` (seconds, see ``calibrated_pause``), where nothing was spoken for longer than that.

    A null start_time comes first. Rows with a null rec_id or seg_id do not count; repeated rows count once; empty tables give
    no rows. Extra columns, of any name, are ignored.

    Runs of one speaker are found within each slot and written once; one row per slot then tells where the turns of its first and its last
    run began, and texts are joined per turn only at the end.
    """
    # Two branches read the parsed texts below: written once, they are parsed once.
    texts = materialize(spoken_texts(timed_text, alias_map(speaker_alias)), "spoken-texts")
    heard = covering_speaker(texts.filter("label is null"), speaker_periods(diarization_segment))
    rows = texts.join(heard, ["rec_id", "seg_id"], "left")
    slot = F.coalesce(F.floor(F.col("start_time") / slot_s), F.lit(-(2**50))).cast("bigint")
    rows = rows.select("rec_id", "seg_id", "start_time", "end_time", F.coalesce("label", "heard").alias("who"), slot.alias("slot"), *(["clean"] if with_text else []))
    late = F.lit(False)
    if pause is not None:
        rows = running(rows, ["rec_id"], ["start_time", "seg_id"], F.col("slot"), {"said": ("max", F.col("end_time"))}, inclusive=False)
        late = F.coalesce(F.col("start_time") - F.col("said") > pause, F.lit(False))
    order = W.partitionBy("rec_id", "slot").orderBy("start_time", "seg_id")
    rows = rows.withColumn("late", late)
    rows = rows.withColumn("dup", F.coalesce(F.lag("seg_id").over(order) == F.col("seg_id"), F.lit(False)))
    fresh = ~F.col("who").eqNullSafe(F.lag("who").over(order)) | (F.row_number().over(order) == 1)
    rows = rows.withColumn("run", F.sum(((fresh | F.col("late")) & ~F.col("dup")).cast("int")).over(order)).filter("not dup")
    at = F.struct("start_time", "seg_id")
    runs = rows.groupBy("rec_id", "slot", "run").agg(
        F.first("who").alias("who"), F.min_by("late", at).alias("late"), F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("n"),
        *([F.array_sort(F.collect_list(F.struct("start_time", "seg_id", "clean"))).alias("parts")] if with_text else []),
    )
    runs = materialize(runs, "runs")
    # One row for each slot: whether its first run goes on with the last one of the slot before, and where the turn of its last run began.
    ends = runs.groupBy("rec_id", "slot").agg(F.min_by(F.struct("who", "late"), "run").alias("head"), F.max_by(F.struct("who", "a"), "run").alias("tail"), F.max("run").alias("last"))
    by = W.partitionBy("rec_id").orderBy("slot")
    past = by.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("on", F.lag("last").over(by).isNotNull() & F.col("head.who").eqNullSafe(F.lag("tail.who").over(by)) & ~F.col("head.late"))
    began = F.when(~F.col("on") | (F.col("last") > 1), F.col("tail.a"))
    ends = ends.withColumn("since", F.last(began, ignorenulls=True).over(past))
    ends = ends.filter("on").select("rec_id", "slot", F.lit(1).alias("run"), "since")
    turns = runs.join(ends, ["rec_id", "slot", "run"], "left").withColumn("turn", F.coalesce("since", "a"))
    turns = turns.groupBy("rec_id", "turn").agg(
        F.first("who").alias("who"), F.max("z").alias("z"), F.sum("n").alias("n"), *([F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts")] if with_text else [])
    )
    return turns.select(
        "rec_id", F.col("who").alias("speaker_idx"), F.col("turn.seg_id").alias("first_seg_id"), F.col("z.seg_id").alias("last_seg_id"), F.col("turn.start_time").alias("start_time"),
        F.col("n").alias("n_texts"), *([_joined(F.transform("parts", lambda x: x["clean"])).alias("text")] if with_text else []),
    )
