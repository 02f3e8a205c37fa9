import random

import pytest

from tessitura.llm.encode import default_tokenizer, encode_corpus, encoder, glued, leaves

BITS = ["'s", "'re", "a", "1", " ", "  ", "\n", "\t", ".", "é", "測", "'", " ", "　", "the", "Z", "😀", "<|endoftext|>"]


@pytest.fixture(scope="module")
def enc():
    return encoder(default_tokenizer())


def apart(enc, text, leaf, word):
    return glued(enc, [(p, enc.piece(b) if p else enc.text(b.decode())) for p, b in leaves(text, leaf, word)])


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        k = rng.random()
        if k < 0.3:
            yield "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 900)))
        elif k < 0.5:
            yield rng.choice(["a", "=", "-", "ab", "測", "é", "🎧", " ", "\n"]) * rng.randrange(1, 900)
        else:
            yield "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 300)))


@pytest.mark.parametrize("leaf,word", [(4, 8), (16, 8), (64, 16), (300, 40)])
def test_cut_and_glued_is_exact(enc, leaf, word):
    for t in texts(150, leaf):
        assert apart(enc, t, leaf, word) == enc.text(t), repr(t[:80])


def test_round_trip(enc):
    for t in texts(60, 5):
        assert enc.spelled(enc.text(t)).decode() == t


def test_same_ids_as_the_other_library(enc):
    """The vocabulary's other file, read by a library of its own, gives the same ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    other.encode_special_tokens = True
    for t in [*texts(200, 7), "<|endoftext|>", ""]:
        assert other.encode(t, add_special_tokens=False).ids == enc.text(t)


def test_corpus(spark, enc):
    odd = [None, "", " ", "\n\n", "<|endoftext|>", "word " * 4000, "x" * 30_000, "測試" * 9000, ("=-" * 9000) + " end", "same", "same", "long " * 5000, "long " * 5000]
    rows = [(i if i < 10 else 9, t, "extra", "row") for i, t in enumerate(odd)] + [(None, "null id", "e", "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, row string")
    got = sorted((str(r.doc_id), r.ids) for r in encode_corpus(df).collect())
    want = sorted((str(i), enc.text(t or "")) for i, t, *_ in rows)
    assert got == want
    assert dict(got)["0"] == [] and dict(got)["1"] == [] and dict(got)["4"] != [50256]
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
