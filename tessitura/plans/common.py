"""Inputs that several plans share, in Spark and as SQL of the checking engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.multivariant import MultivariantError, parse
from tessitura.functions.tokenize import pattern, tokenize
from tessitura.session import table
from tessitura.sources.registry import get_dataset

#: The derived hypotheses; each damages every k-th word of the truth in its own way.
PIPELINES = {"drop7": 7, "dup9": 9, "swap5": 5}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_tokens(text: str, method: str = "default", drop_punct: bool = True) -> str:
    return f"regexp_extract_all(translate(lower({text}), 'ёЁ', 'еЕ'), {quoted(pattern(method, drop_punct))})"


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return get_dataset("recordings")(spark, sf)


#: What the derived hypotheses say in place of a wildcard.
WILD_WORDS = " uh well "


def spoken(text: Column) -> Column:
    """Words of a truth as somebody may have said them: the first option of each block, and two words for each wildcard."""
    first = F.regexp_replace(text, r"\{([^{}|]*)[^{}]*\}", "$1")
    return tokenize(F.regexp_replace(first, r"<\*>", WILD_WORDS))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """rec_id, dataset_name, sample_idx, lang, text, t, pipeline, h: truth, its words as written, and hypothesis words of each pipeline."""
    t = truth(spark, sf).select("rec_id", "dataset_name", "sample_idx", "lang", "text", tokenize(F.col("text")).alias("t"), spoken(F.col("text")).alias("s"))
    made = F.array(
        F.struct(F.lit("drop7").alias("pipeline"), F.filter("s", lambda x, i: (i + 1) % 7 != 0).alias("h")),
        F.struct(F.lit("dup9").alias("pipeline"), F.flatten(F.transform("s", lambda x, i: F.when((i + 1) % 9 == 0, F.array(x, x)).otherwise(F.array(x)))).alias("h")),
        F.struct(F.lit("swap5").alias("pipeline"), F.transform("s", lambda x, i: F.when((i + 1) % 5 == 0, F.concat(x, F.lit("x"))).otherwise(x)).alias("h")),
    )
    return t.select("*", F.explode(made).alias("p")).select("rec_id", "dataset_name", "sample_idx", "lang", "text", "t", "p.pipeline", "p.h")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType())])))
def _times(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Times of a truth's words, all options included, in the order of their numbers; null for an unreadable truth.

    spans: start_pos, end_pos, start_time, end_time of the timed pieces of the text. Words of one piece share its time evenly; a
    word without a piece lies at the end of the word before it.
    """
    out = []
    for t, pieces in zip(text, spans):
        try:
            words = [(w["start_pos"], w["end_pos"]) for b in parse(t) for o in b["options"] for w in o]
        except MultivariantError:
            out.append(None)
            continue
        pieces = sorted((p["start_pos"], p["end_pos"], p["start_time"], p["end_time"]) for p in pieces)
        held, k = [], 0
        for a, b in words:
            while k < len(pieces) and pieces[k][1] <= a:
                k += 1
            held.append(k if k < len(pieces) and pieces[k][0] < b else None)
        times, end = [], 0.0
        for i, k in enumerate(held):
            if k is None:
                times.append((end, end))
                continue
            n, at, (_, _, s, e) = held.count(k), i - held.index(k), pieces[k]
            times.append((s + (e - s) * at / n, e if at + 1 == n else s + (e - s) * (at + 1) / n))
            end = times[-1][1]
        out.append([{"start_time": s, "end_time": e} for s, e in times])
    return pd.Series(out)


def timed_truths(spark: SparkSession, sf: str) -> DataFrame:
    """rec_id, truth, times: truths with the times of all their words, variants and wildcards included, for timed recordings."""
    t = table(spark, sf, "transcript_token").filter("rec_id is not null and start_pos is not null and end_pos is not null and start_time is not null and end_time is not null")
    t = t.select("rec_id", "start_pos", "end_pos", "start_time", "end_time").groupBy("rec_id").agg(F.collect_set(F.struct("start_pos", "end_pos", "start_time", "end_time")).alias("spans"))
    r = truth(spark, sf).select("rec_id", F.col("text").alias("truth")).distinct().join(t, "rec_id")
    return r.select("rec_id", "truth", _times("truth", "spans").alias("times"))


SQL_TRUTH = """truth as (
  select distinct rec_id, dataset_name, split_name, sample_idx, lang, transcription as text
  from recording where transcription is not null and rec_id is not null)"""

SQL_PREDICTIONS = f"""{SQL_TRUTH},
words as (select rec_id, dataset_name, sample_idx, lang, text, {sql_tokens("text")} as t,
  {sql_tokens(r"replace(regexp_replace(text, '\{([^{}|]*)[^{}]*\}', '\1', 'g'), '<*>', '" + WILD_WORDS + "')")} as s from truth),
pred as (
  select * exclude (s), 'drop7' as pipeline, list_filter(s, lambda x, i: i % 7 <> 0) as h from words
  union all select * exclude (s), 'dup9', flatten(list_transform(s, lambda x, i: case when i % 9 = 0 then [x, x] else [x] end)) from words
  union all select * exclude (s), 'swap5', list_transform(s, lambda x, i: case when i % 5 = 0 then x || 'x' else x end) from words)"""


def sql_distance(a: str, b: str) -> str:
    """Edit distance in characters: the engine's own counts bytes, so both are spelled in one-byte signs of the pair's own alphabet first."""
    sign = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(cast(33 + list_position(list_distinct(string_split({a} || {b}, '')), c) as integer))), '')"
    return f"case when strlen({a} || {b}) = length({a} || {b}) then levenshtein({a}, {b}) else levenshtein({sign(a)}, {sign(b)}) end"


#: The kernel's scores of every prediction as a recursive query, variants and wildcards included. Each choice of options gives one
#: reading of the truth; r is the row of its edit table after i words of the hypothesis, in which one number holds (word errors,
#: character errors, minus correct words) in this order; the cheapest reading counts, the first of equals.
SQL_SCORES = "recursive " + SQL_PREDICTIONS + f""",
cut as (select distinct rec_id, text, regexp_extract_all(text, '\\{{[^{{}}]*\\}}') as blocks, regexp_split_to_array(text, '\\{{[^{{}}]*\\}}') as parts,
  regexp_replace(text, '\\{{[^{{}}]*\\}}', chr(1), 'g') as bare from truth),
readable as (select * from cut where not regexp_matches(bare, '[{{}}]|[^\\s\\p{{Z}}]\\x01|\\x01[^\\s\\p{{Z}}]')),
reading as (
  select rec_id, text, blocks, parts, 0 as n, {sql_tokens("parts[1]")} as toks, cast([] as bigint[]) as choice from readable
  union all
  select rec_id, text, blocks, parts, n + 1, list_concat(list_concat(toks, {sql_tokens("o")}), {sql_tokens("parts[n + 2]")}), list_append(choice, i)
  from (select *, unnest(opts) as o, unnest(range(0, len(opts))) as i from
    (select *, case when contains(blocks[n + 1], '|') then string_split(blocks[n + 1][2:-2], '|') else [blocks[n + 1][2:-2], ''] end as opts from reading where n < len(blocks)))),
tried as (select p.rec_id, p.pipeline, p.h, r.toks as t, r.choice, list_transform(r.toks, lambda x: x = '<*>') as wild,
    list_transform(range(0, len(r.toks) + 1), lambda k: cast(coalesce(list_sum(list_transform(r.toks[:k], lambda x: case when x = '<*>' then 0 else 100000000000 + 100000 * length(x) end)), 0) as bigint)) as gone
  from pred p join reading r on p.rec_id = r.rec_id and p.text = r.text where r.n = len(r.blocks)),
dp as (
  select *, 0 as i, gone as r from tried
  union all
  select rec_id, pipeline, h, t, choice, wild, gone, i + 1, list_transform(range(0, len(t) + 1), lambda j: gone[j + 1] + list_min(base[:j + 1])) from
    (select *, list_transform(range(0, len(t) + 1), lambda k: least(
      r[k + 1] + case when k > 0 and wild[k] then 0 else 100000000000 + 100000 * length(h[i + 1]) end,
      case when k > 0 then r[k] + case when wild[k] then 0 when t[k] = h[i + 1] then -1 else 100000000000 + 100000 * ({sql_distance("t[k]", "h[i + 1]")}) end end) - gone[k + 1]) as base
    from dp where i < len(h))),
best as (select rec_id, pipeline, t, h, choice, r[len(t) + 1] + 99999 as x from dp where i = len(h)
  qualify row_number() over (partition by rec_id, pipeline order by x, choice) = 1),
scored as (select rec_id, pipeline, t, h, choice, cast(x // 100000000000 as integer) as n_word_errors, cast(x % 100000000000 // 100000 as integer) as n_char_errors,
  cast(99999 - x % 100000 as integer) as n_correct, cast(len(list_filter(t, lambda w: w <> '<*>')) as integer) as true_len from best)"""


def _sql_cell(cost: str, path: str) -> str:
    return f"{{'c': {cost}, 'p': {path}, 'd': 0}}"


#: The matches of every prediction's alignment with the reading it took. Rows of the edit table from the last word of the hypothesis to the
#: first, cells from the last word of the truth to the first: the cost to the end, and the moves (a match, b insertion, c deletion, d
#: absorption by a wildcard) of which the first in this order is taken at every step among the cheapest.
SQL_MATCHES = SQL_SCORES + f""",
ways as (
  select rec_id, pipeline, t, h, len(t) as m, len(h) as i,
    list_transform(range(0, len(t) + 1), lambda k: {_sql_cell("cast(coalesce(list_sum(list_transform(t[len(t) - k + 1:], lambda x: case when x = '<*>' then 0 else 100000000000 + 100000 * length(x) end)), 0) as bigint)", "repeat('c', k)")}) as r
  from scored
  union all
  select rec_id, pipeline, t, h, m, i - 1, list_reduce(list_prepend([{_sql_cell("r[1].c + 100000000000 + 100000 * length(h[i])", "'b' || r[1].p")}], list_transform(list_transform(range(1, m + 1), lambda k: {{
      'go': least({{'c': r[k].c + case when t[m - k + 1] = '<*>' then 0 when t[m - k + 1] = h[i] then -1 else 100000000000 + 100000 * ({sql_distance("t[m - k + 1]", "h[i]")}) end, 'p': 'a' || r[k].p}},
        case when t[m - k + 1] = '<*>' then {{'c': r[k + 1].c, 'p': 'd' || r[k + 1].p}} else {{'c': r[k + 1].c + 100000000000 + 100000 * length(h[i]), 'p': 'b' || r[k + 1].p}} end),
      'd': case when t[m - k + 1] = '<*>' then 0 else 100000000000 + 100000 * length(t[m - k + 1]) end}}), lambda z: [{{'c': z.go.c, 'p': z.go.p, 'd': z.d}}])),
    lambda done, y: list_append(done, least({_sql_cell("y[1].c", "y[1].p")}, {_sql_cell("done[-1].c + y[1].d", "'c' || done[-1].p")})))
  from ways where i > 0),
way as (select rec_id, pipeline, t, h, r[m + 1].p as p from ways where i = 0),
moves as (select *, unnest(range(1, length(p) + 1)) as s from way),
placed as (select rec_id, pipeline, s - 1 as i, p[s] as move, length(regexp_replace(p[1:s - 1], '[^ac]', '', 'g')) as ti, t[length(regexp_replace(p[1:s - 1], '[^ac]', '', 'g')) + 1] as w,
  case when p[s] <> 'c' then h[length(regexp_replace(p[1:s - 1], '[^abd]', '', 'g')) + 1] end as pred from moves),
matches as (select rec_id, pipeline, i, ti, case when move <> 'b' then w end as true, pred,
  case when move = 'b' then 'insertion' when w = '<*>' or w = pred then 'correct' when move = 'c' then 'deletion' else 'replacement' end as status,
  case when move = 'b' then length(pred) when w = '<*>' or w = pred then 0 when move = 'c' then length(w) else {sql_distance("w", "pred")} end as n_char_errors from placed)"""
#: Slots of the alignments: 2i + 1 for what met truth word i, 2i for what came before it.
SQL_BUCKETS = SQL_MATCHES + """,
buckets as (select rec_id, pipeline, case when status = 'insertion' then 2 * ti else 2 * ti + 1 end as slot, any_value("true") as "true", coalesce(string_agg(pred, ' ' order by i), '') as words, bool_or(status <> 'correct') as has_error
  from matches group by 1, 2, 3)"""
