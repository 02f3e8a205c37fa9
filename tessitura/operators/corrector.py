"""Vocabularies of a domain and correction of words by them; lemmas, inflected forms and frequencies come as lookup tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.operators.fuzzy import edit_neighbours

#: Edits allowed by the length of a word; beyond the list it is the last.
EDITS = (0, 0, 0, 1, 1, 1, 2, 2, 2, 3)
#: Copies of a small table of words that many rows look up, so that one frequent word is no hot key.
SALTS = 16
SEGMENTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def plain_form(word: Column) -> Column:
    """How words are compared: in lower case, ё as е."""
    return F.translate(F.lower(word), "ё", "е")


def looked_up(df: DataFrame, column: str, table: DataFrame | None) -> DataFrame:
    """df with a column's values replaced by those of a lookup table (columns form, value); values it does not have stay."""
    if table is None:
        return df
    t = table.groupBy(F.col("form").alias("__form")).agg(F.min("value").alias("__value"))
    return df.join(t, F.col(column) == F.col("__form"), "left").withColumn(column, F.coalesce("__value", column)).drop("__form", "__value")


def domain_words(words: DataFrame, frequency: DataFrame, below: float, lemmas: DataFrame | None = None, mode: str = "add") -> DataFrame:
    """w: the distinct words of a domain (column w) in lower case, with those that have ё also written with е, their lemmas added (or in
    their place: mode 'replace'), as far as they are rarer than ``below`` on the scale of ``zipf`` (frequency: w, zipf)."""
    w = words.select(F.explode(F.array(F.lower("w"), plain_form(F.col("w")))).alias("w")).filter("w is not null").distinct()
    if lemmas is not None and mode != "no":
        lemma = looked_up(w, "w", lemmas).distinct()
        w = lemma if mode == "replace" else w.union(lemma).distinct()
    return w.join(frequency.filter(F.col("zipf") >= below).select("w"), "w", "left_anti")


def zipf(count: Column, total: Column) -> Column:
    """log10 of how often a word comes in a billion."""
    return F.log10(count / total * 1e9)


def word_corrections(words: DataFrame, domain: DataFrame, frequency: DataFrame, above: float = 1.0, lemmas: DataFrame | None = None, inflect: DataFrame | None = None) -> DataFrame:
    """w, correction: of the distinct words (w, as spoken) those that have one nearest word of the domain (w) within the edits their length allows.

    A word is compared by its lemma; one whose lemma is more frequent than ``above`` is right as it is. A correction takes the word's form
    from the table ``inflect`` (lemma, like, value: lemma in the form of the word like); where the table is given and has no form, there is no
    correction. A capital stays a capital.
    """
    edits = F.get(F.array(*map(F.lit, EDITS)), F.least(F.length("w"), F.lit(len(EDITS) - 1)))
    w = words.select("w").distinct().filter(edits > 0).withColumn("lemma", plain_form(F.col("w")))
    w = looked_up(w, "lemma", lemmas).join(frequency.filter(F.col("zipf") > above).select(F.col("w").alias("lemma")), "lemma", "left_anti")
    d = domain.select(F.col("w").alias("entry"), plain_form(F.col("w")).alias("plain")).distinct()
    near = edit_neighbours(w.select("lemma").distinct(), d.select("plain").distinct(), "lemma", "plain", max(EDITS))
    near = near.join(d, "plain").groupBy("lemma", "dist").agg(F.count("*").alias("n"), F.min("entry").alias("entry"))
    best = near.groupBy("lemma").agg(F.min(F.struct("dist", "n", "entry")).alias("m")).filter("m.n = 1").select("lemma", "m.dist", "m.entry")
    out = w.join(best, "lemma").filter((F.col("dist") <= edits) & (F.col("entry") != F.col("lemma")))
    if inflect is not None:
        forms = inflect.select(F.col("lemma").alias("entry"), F.col("like").alias("w"), F.col("value").alias("form"))
        out = out.join(forms, ["entry", "w"]).withColumn("entry", F.col("form"))
    first = F.substr(F.col("w"), F.lit(1), F.lit(1))
    capital = F.concat(F.upper(F.substr("entry", F.lit(1), F.lit(1))), F.lower(F.substr(F.col("entry"), F.lit(2))))
    return out.select("w", F.when(first != F.lower(first), capital).otherwise(F.col("entry")).alias("correction"))


def correct_texts(texts: DataFrame, ident: str, text: str, corrections: DataFrame) -> DataFrame:
    """ident, text: every word that has a correction (w, correction) replaced where it stands; all else, spaces and signs too, stays.

    Each text's distinct words meet the corrections once, salted, and the text is put together again in the row. Null texts stay null.
    """
    t = texts.select(F.col(ident).alias("__id"), F.col(text).alias("__text")).distinct().withColumn("__parts", F.regexp_extract_all("__text", F.lit(SEGMENTS), F.lit(0)))
    words = t.select("__id", F.explode(F.array_distinct("__parts")).alias("w")).filter(F.col("w").rlike(r"^[\p{L}\p{N}_]")).withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)))
    c = corrections.select("w", "correction", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("__salt"))
    found = words.join(c, ["w", "__salt"]).distinct().groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("w", "correction"))).alias("__c"))
    t = t.join(found, "__id", "left")
    mended = F.array_join(F.transform("__parts", lambda x: F.coalesce(F.element_at("__c", x), x)), "")
    return t.select(F.col("__id").alias(ident), F.when(F.col("__c").isNull(), F.col("__text")).otherwise(mended).alias(text))


def substitute(text: Column, phrases: Mapping[str, str]) -> Column:
    """text with phrases replaced, the longest first, in two passes: what was put in for one phrase is never taken for another."""
    keys = sorted(phrases, key=lambda k: (-len(k), k))
    for i, k in enumerate(keys):
        text = F.replace(text, F.lit(k), F.lit(f"\ue000{i}\ue001"))
    for i, k in enumerate(keys):
        text = F.replace(text, F.lit(f"\ue000{i}\ue001"), F.lit(phrases[k]))
    return text


def without_titles(df: DataFrame, title: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose title holds none of these parts, in any case; rows without a title stay."""
    held = F.lit(False)
    for p in parts:
        held = held | F.contains(F.lower(title), F.lit(p.lower()))
    return df.filter(~F.coalesce(held, F.lit(False)))
