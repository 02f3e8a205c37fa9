"""Text that looks the same in one consistent form.

A text's look is its skeleton: composed accents taken apart, widths folded, spaces of any sort made plain, what is invisible
removed, and each letter that has the shape of a letter of another script put by one sign. Per token the scripts in which the
whole look can be spelled are intersected; a token in letters of several scripts ('mixed') and one that could as well be
spelled wholly in another script ('whole') are told apart, and the token is written in its consistent script: the only
one possible, else the one that the text's other tokens settle, else Latin before Cyrillic before Greek. Since all of this
is decided on the skeleton, texts that look the same get the same form, and only those.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.session import materialize

#: Letters of the same shape, as Latin, Cyrillic, Greek; '.' where the script has none.
SAME_SHAPE = """
A А Α
B В Β
C С .
E Е Ε
H Н Η
I І Ι
J Ј .
K К Κ
M М Μ
N . Ν
O О Ο
P Р Ρ
S Ѕ .
T Т Τ
X Х Χ
Y У Υ
Z . Ζ
Q Ԛ .
W Ԝ .
G Ԍ .
a а α
c с .
d ԁ .
e е .
h һ .
i і ι
j ј .
l ӏ .
o о ο
p р ρ
q ԛ .
s ѕ .
v ѵ ν
w ԝ .
x х χ
y у γ
. Г Γ
. П Π
. Ф Φ
. Л Λ
"""
#: Letters of further scripts with the shape of a Latin capital, in the order of LATIN ('.': none).
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LISU = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑ.ꓣꓢꓔꓴꓦꓪꓫꓬꓜ"
CHEROKEE = "ᎪᏴᏟᎠᎬ.ᏀᎻ.ᎫᏦᏞᎷ..Ꮲ.ᏒᏚᎢ.ᏙᎳ..Ꮓ"
COPTIC = "ⲀⲂⲤ....ⲎⲒ.Ⲕ.ⲘⲚⲞⲢ...Ⲧ...Ⲭ..".ljust(26, ".")
#: Signs with the look of another sign (left as written: right).
SIGNS = "‐:- ‑:- ⁃:- ˗:- ’:' ‘:' ‛:' ʼ:' ʹ:' ′:' “:\" ”:\" ‟:\" ″:\" ⁄:/ ∕:/ ․:. ∶:: ꞉:: ǃ:! ∣:| ǀ:|"
#: Further letters of one script with the shape of another letter (left as written: right).
ALSO = "ɡ:g ɑ:a ı:i Ү:Y ү:y ϲ:c Ϲ:C ϳ:j υ:u ս:u օ:o ո:n Օ:O Տ:S Լ:L հ:h ց:g զ:q ѡ:w ϒ:Y ꓲ:I ꓳ:O ꓢ:S ꓮ:A"
#: Invisible characters besides those of Unicode's format category (Cf) and variation selectors.
INVISIBLE = "­͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ⠀"
SCRIPTS = ("Latin", "Cyrillic", "Greek")
PREFERENCE = {s: i for i, s in enumerate(SCRIPTS)}
#: Compatibility forms that look like what they stand for; others (superscripts, fractions, circles) look different. Of those the Unicode
#: data only calls compatible, the same look have those with these words in their names.
COMPATIBLE = ("ROMAN NUMERAL", "LIGATURE", "LEADER", "ELLIPSIS", "DIGRAPH", "LETTER DZ", "LETTER LJ", "LETTER NJ", "DOUBLE EXCLAMATION", "DOUBLE QUESTION", "QUESTION EXCLAMATION", "EXCLAMATION QUESTION", "MICRO SIGN")
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

_ROWS = [row.split() for row in SAME_SHAPE.split("\n") if row.strip()]
#: sign -> {script: letter}; the sign of a shape is its first letter in order of SCRIPTS.
SHAPES = {next(c for c in row if c != "."): {s: c for s, c in zip(SCRIPTS, row) if c != "."} for row in _ROWS}
_SIGN = {c: sign for sign, forms in SHAPES.items() for c in forms.values()} | {x[0]: x[2:] for x in (*ALSO.split(), *SIGNS.split())}
_SIGN |= {c: sign for row in (LISU, CHEROKEE, COPTIC) for c, sign in zip(row, LATIN) if c != "."}
_SCRIPT_OF = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in (*SCRIPTS, "Armenian", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari")]
LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
PLAIN = regex.compile(r"[\x20-\x7e]*")


@lru_cache(maxsize=None)
def _fold(c: str) -> str:
    """What one character contributes to the skeleton; the cache is bounded by the characters there are."""
    if c in INVISIBLE or unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if c.isspace() or unicodedata.category(c) == "Zs":
        return " "
    if c < "\x80":
        return c
    d = unicodedata.decomposition(c)
    if d.startswith(SAME_LOOK) or (d.startswith("<compat>") and any(w in unicodedata.name(c, "") for w in COMPATIBLE)):
        return "".join(_fold(x) for x in unicodedata.normalize("NFKD", c))
    if d and not d.startswith("<"):
        return "".join(_fold(x) for x in unicodedata.normalize("NFD", c))
    return _SIGN.get(c, c)


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _fold(chr(code))
        return out


_FOLDS = _Folds()


def skeleton(text: str) -> str:
    """The look of a text: equal for texts that look the same, and only for those."""
    if PLAIN.fullmatch(text):
        return text
    return unicodedata.normalize("NFD", text.translate(_FOLDS))


@lru_cache(maxsize=None)
def _script(c: str) -> str | None:
    return next((s for s, p in _SCRIPT_OF if p.match(c)), None)


@lru_cache(maxsize=200_000)
def _mixed(token: str) -> bool:
    """Whether the letters of a token, as written, are of several scripts."""
    return len({s for c in token if (s := _script(c)) is not None}) > 1


@lru_cache(maxsize=None)
def scripts_of(sign: str) -> frozenset[str] | None:
    """The scripts in which a sign of the skeleton can be written; None: any (digits, accents, signs of no script)."""
    if sign in SHAPES:
        return frozenset(SHAPES[sign])
    s = _script(sign)
    return None if s is None else frozenset((s,))


def resolved_scripts(token: str) -> frozenset[str] | None:
    """Intersection of the scripts of all signs of a skeleton token: None if it has no letters, empty if no script can write all of it."""
    out = None
    for sign in set(token):
        s = scripts_of(sign)
        if s is not None:
            out = s if out is None else out & s
    return out


def _spell(token: str, script: str) -> str:
    return "".join(SHAPES[c].get(script, c) if c in SHAPES else c for c in token)


def consistent(text: str) -> tuple[str, int, int]:
    """(consistent form, number of tokens in mixed scripts, number of tokens that another script can spell wholly).

    Two passes: tokens that only one script can write settle the text's script; then every token is written. A token that no
    single script can write keeps, sign by sign, the script of most of its settled letters where possible.
    """
    look = skeleton(text)
    if look.isascii() and text.isascii():
        words = LETTERS.findall(look)
        return look, 0, sum(1 for w in words if (s := _resolved(w)) is not None and len(s) > 1)
    weight: dict[str, int] = {}
    words = LETTERS.findall(look)
    for w in words:
        s = _resolved(w)
        if s is not None and len(s) == 1:
            (only,) = s
            weight[only] = weight.get(only, 0) + len(w)
    order = sorted(SCRIPTS, key=lambda s: (-weight.get(s, 0), PREFERENCE[s]))
    whole = sum(1 for w in words if (s := _resolved(w)) is not None and len(s) > 1)
    # Mixed as written: no single script holds all letters of the token, though they may all have the shapes of one.
    shown = unicodedata.normalize("NFC", "".join([c for c in text if _FOLDS[ord(c)] != ""]))
    mixed = sum(map(_mixed, LETTERS.findall(shown)))
    order = tuple(order)
    return unicodedata.normalize("NFC", LETTERS.sub(lambda m: _written(m[0], order), look)), mixed, whole


@lru_cache(maxsize=200_000)
def _written(w: str, order: tuple[str, ...]) -> str:
    """A skeleton token in its script: the first of the order that can write it, else that of most of its settled letters."""
    s = _resolved(w)
    if s is None:
        return w
    if s:
        return _spell(w, next((x for x in order if x in s), min(s)))
    count: dict[str, int] = {}
    for c in w:
        if (k := scripts_of(c)) is not None and len(k) == 1:
            (only,) = k
            count[only] = count.get(only, 0) + 1
    best = max(sorted(count, key=lambda x: PREFERENCE.get(x, 9)), key=lambda x: count[x]) if count else order[0]
    return _spell(w, best)


@lru_cache(maxsize=200_000)
def _resolved(token: str) -> frozenset[str] | None:
    return resolved_scripts(token)


FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("mixed", T.IntegerType()), T.StructField("whole", T.IntegerType())])


@F.pandas_udf(FORM)
def _consistent(text: pd.Series) -> pd.DataFrame:
    codes, distinct = pd.factorize(text, use_na_sentinel=True)
    got = [*map(consistent, distinct), (None, None, None)]  # nulls have the code -1
    return pd.DataFrame([got[k] for k in codes], columns=["form", "mixed", "whole"]).astype({"mixed": "Int32", "whole": "Int32"})


def consistent_form(text: Column) -> Column:
    """Column form of ``consistent``; null stays null. Declared nondeterministic so that a filter on it does not make it run twice."""
    return _consistent.asNondeterministic()(text)


def consistent_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys..., text, form, mixed, whole: every row's text in its consistent form. Nulls stay null, empty texts empty."""
    return df.select(*keys, F.col(text).alias("text"), consistent_form(F.col(text)).alias("f")).select(*keys, "text", "f.*")


#: Rows of a class that meet all others of it in one task.
ROWS = 2_000


def lookalike_classes(df: DataFrame, within: list[str], ident: str, text: str) -> DataFrame:
    """within..., id, text, class_id, n_rows, n_links: rows whose text has the look of another row's and is not the same string.

    One row for each (id, text); a class is all rows of one look that are written in several ways, class_id its smallest id. n_links
    counts the rows of the class that are written differently. Null texts and ids, texts with nothing to see and rows with a null in
    ``within`` are no case; repeated rows count once.

    Copies fold in the partial aggregate before every shuffle. Whether a look has several spellings is known from the least and the
    greatest hash of its strings, so no list of a class is gathered, and only rows of such classes go on.
    """
    by = [f"__w{i}" for i in range(len(within))]
    rows = df.select(*[F.col(k).alias(b) for b, k in zip(by, within)], F.col(ident).alias("id"), F.col(text).alias("text")).dropna().filter("text != ''").distinct()
    rows = rows.withColumn("__form", consistent_form(F.col("text"))["form"]).filter("trim(__form) != ''")
    # Read by two branches: written once, the forms are made once.
    rows = materialize(rows.withColumn("__look", F.xxhash64("__form")).drop("__form").withColumn("__h", F.xxhash64("text")), "looks")
    look = [*by, "__look"]
    several = rows.groupBy(*look).agg(F.min("__h").alias("__lo"), F.max("__h").alias("__hi"), F.min("id").alias("class_id"), F.count("*").alias("n_rows")).filter("__lo != __hi").drop("__lo", "__hi")
    out = rows.join(several, look)
    same = out.groupBy(*look, "__h").agg(F.count("*").alias("__same"))
    out = out.join(same, [*look, "__h"]).withColumn("n_links", F.col("n_rows") - F.col("__same"))
    return out.select(*[F.col(b).alias(k) for b, k in zip(by, within)], "id", "text", "class_id", "n_rows", "n_links")


def lookalike_pairs(df: DataFrame, within: list[str], ident: str, text: str) -> DataFrame:
    """within..., id_a, id_b (id_a < id_b): the classes of ``lookalike_classes`` as pairs of rows that are not the same string.

    A class of more than ROWS rows is cut into so many parts, each of which meets all of it in a task of its own, so one look with
    many rows is no hot key.
    """
    rows = materialize(lookalike_classes(df, within, ident, text).select(*within, "id", "class_id", "n_rows", F.xxhash64("text").alias("__h")), "lookalikes")
    parts = F.ceil(F.col("n_rows") / ROWS).cast("int")
    a = rows.select(*within, "class_id", F.col("id").alias("id_a"), F.col("__h").alias("__ha"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("__part"))
    b = rows.select(*within, "class_id", F.col("id").alias("id_b"), F.col("__h").alias("__hb"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    return a.join(b, [*within, "class_id", "__part"]).filter("id_a < id_b and __ha != __hb").select(*within, "id_a", "id_b")
