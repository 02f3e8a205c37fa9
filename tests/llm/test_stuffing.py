import random

import numpy as np
import pytest

from tessitura.llm.stuffing import covered, longest_repeats, stuffed_pages, stuffed_share, stuffed_shares, stuffing


def brute(tokens):
    """Length of the longest stretch that ends at each word and occurs once more."""
    n, out = len(tokens), []
    for end in range(1, n + 1):
        best = 0
        for size in range(1, end + 1):
            part = tokens[end - size : end]
            if sum(tokens[i : i + size] == part for i in range(n - size + 1)) > 1:
                best = size
        out.append(best)
    return out


def test_repeats_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        pages = [[rng.randrange(rng.randrange(1, 9)) for _ in range(rng.randrange(0, 16))] for _ in range(rng.randrange(1, 5))]
        pages += pages[:1]  # copies of a page repeat nothing in it
        ids, of = np.array([t for p in pages for t in p], np.int64), np.array([k for k, p in enumerate(pages) for _ in p], np.int64)
        assert longest_repeats(ids, of).tolist() == [x for p in pages for x in brute(p)]
    t = [rng.randrange(400) for _ in range(3000)] + [500] * 600
    longest = longest_repeats(np.array(t), np.zeros(len(t), np.int64))
    assert longest[-1] == 599 and longest[3000] == 1
    assert covered(longest).tolist() == [t.count(x) > 1 for x in t]
    assert longest_repeats(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    # A page far beyond any automaton of objects: one block of words said twice.
    big = np.concatenate([np.arange(200_000), np.arange(200_000)])
    assert longest_repeats(big, np.zeros(len(big), np.int64))[-1] == 200_000


FRENCH = "Le vieux pêcheur rentrait au port avant la tombée de la nuit. Sa fille l'attendait toujours sur le quai avec une lanterne. Personne ne savait pourquoi il restait si longtemps en mer."
SPANISH = "Los vecinos del pueblo construyeron la escuela con sus propias manos. Nadie recordaba cuándo había empezado la obra ni quién la pagaba. Ahora los niños aprenden allí a leer y a escribir."
POLISH = "Stary zegar na wieży zatrzymał się dokładnie o północy. Mieszkańcy miasta długo szukali kogoś, kto umiałby go naprawić. Dopiero wnuk zegarmistrza znalazł zgubioną sprężynę."
CHINESE = "老渔夫在天黑以前回到了港口。他的女儿总是提着灯笼在码头上等他。没有人知道他为什么在海上待那么久。"
BEST = "the best and cheap shoes are the best and cheap shoes that you can buy"

STUFFED = [
    "karaoke set  karaoke set best  online karaoke set  free shipping karaoke set  karaoke set cheap",
    "Buy! noise floor for beginners? noise floor, near me. Cheap microphone online for microphone 2025. Sale noise floor, noise floor best.",
    "boom arm: https://tags-590.example/notes/a\nheadset: www.desk-510.example/forum/b\nlapel mic: https://radio-314.example/talks/c",
    "#NoiseFilter #PopShield #AudioCable #NoiseFilterBuy #PopShieldOnline #BoomArm",
    "Petlichka 278\nNoise Filter 85.99\nBoom Arm 335 €\nPetlichka 314 €\nNoise Filter 201\nBoom Arm 62.99 EUR",
    "купить петличка недорого петличка цена петличка оптом петличка отзывы петличка скидка петличка",
    " ".join([BEST] * 20), ". ".join([BEST] * 20), "\n".join([BEST.capitalize() + "."] * 20),
    "acheter chaussures pas cher chaussures en ligne chaussures femme acheter chaussures soldes chaussures homme chaussures pas cher",
    "Tanie buty damskie, buty damskie online. Buty damskie promocja, najlepsze buty damskie. Kup buty damskie tanio, buty damskie sklep.",
    "\n".join(f"Comprar zapatos {c} zapatos baratos {c}" for c in ("Madrid", "Sevilla", "Bilbao", "Vigo", "Lugo", "Murcia")),
]
FINE = [
    "", " ", None, "- Yes.\n- No.\n- Yes.\n- (and so on)\n- No.\n- Yes.", "Host: Right.\nGuest: Why?\nHost: Right.\nGuest: Why?",
    "1\n00:00:01,227 --> 00:00:03,403\nIn the studio it was broken.\n\n2\n00:00:04,659 --> 00:00:07,421\nIn the studio it was broken.\n",
    "If you order now, the voice recorder comes with a voice recorder, but nobody could tell us why (https://a.example/b).",
    "noise floor - This is the level that remains when nobody speaks.\nnoise floor - This is the level that remains when nobody speaks.",
    "Der Rekorder prüft 294 Sätze in der Fähre. Warum trennt der Wortschatz so viele Wörter selten?\n#Kanal #Audiokabel",
    "Почему микрофон склеивает микрофон почти всегда? Этот тихий сегмент обычно считает эталон снова.",
    FRENCH, SPANISH, POLISH, CHINESE, " ".join([FRENCH] * 6), "\n".join([SPANISH] * 6), " ".join([POLISH] * 6), "".join([CHINESE] * 6),
    "one two three four five six seven eight nine ten eleven twelve went to the market and never came back home again",
]


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed(text):
    assert stuffed_share(text) > 0.5


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert stuffed_share(text) <= 0.5


def test_a_page_is_judged_alone():
    pages = [*STUFFED, *FINE]
    assert stuffed_shares(pages) == [stuffed_share(t) for t in pages]
    assert stuffed_shares([]) == [] and stuffed_shares([None, "", " \n"]) == [0.0] * 3


def test_column(spark):
    rows = [(i, t, 0.5) for i, t in enumerate([*STUFFED, *FINE, "x" * 200_000, "word " * 150_000])] + [(0, STUFFED[0], 0.1), (None, STUFFED[0], 0.1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    got = [r.doc_id for r in stuffed_pages(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*range(len(STUFFED)), len(STUFFED) + len(FINE) + 1, 0, None]))
    assert stuffing(df).count() == len(rows)
    assert stuffing(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
