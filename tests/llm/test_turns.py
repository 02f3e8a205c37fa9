import random

import pytest

from tessitura.llm.turns import Grammar, calibrated_pause, fresh_words, rolling_captions, speaker_turns

ALIASES = {"host": 0, "moderator": 0, "ведущий": 0, "a": 0, "speaker a": 0, "guest": 1, "b": 1, "gast": 1, "speaker b": 1}
TXT = "rec_id bigint, seg_id bigint, start_time double, end_time double, text string, who string"
DIA = "rec_id bigint, diar_id bigint, start_time double, end_time double, speaker_idx int, kind string"


@pytest.mark.parametrize("text,speaker,clean", [
    ("[00:00:00]  SPEAKER 1 -  Speaker changes are hm... hard. uhh, *sighs*", 1, "Speaker changes are hard."),
    ("(2:51) Наш протокол", None, "Наш протокол"), ("<00:07.2> СПИКЕР0: Да.", 0, "Да."), ("00:00:11,990 --> <spk0> Yes.", 0, "Yes."),
    (">> Gast: Ja.", 1, "Ja."), (">> B: 00:03:17,948 --> Exactly.", 1, "Exactly."), ("[165.51s]  Каждый [МУЗЫКА] журнал", None, "Каждый журнал"),
    ("spk_0 -  Uh —", 0, None), ("S1:", 1, None), ("[SPEAKER A] Hm —", 0, None), ("(A): Of course.", 0, "Of course."), ("Speaker 2 was late.", None, "Speaker 2 was late."),
    ("Remember: it stays.", None, "Remember: it stays."), ("Nothing at 10:30.", None, "Nothing at 10:30."), ("(and so on)", None, "(and so on)"), ("(laughs)", None, None),
    ("Erst um 10:30.", None, "Erst um 10:30."), ("SPEAKER_03: no", 3, "no"), ("GUEST —  Why?", 1, "Why?"), ("э-э э-э эээ —", None, None),
    ("er kommt um acht", None, "er kommt um acht"), ("um drei Uhr", None, "um drei Uhr"), ("Um, the end um of it", None, "the end of it"), ("Um, er", None, None), ("*really* good", None, "really good"),
    ("(the music was loud, she said)", None, "(the music was loud, she said)"), ("[we all agreed]", None, "[we all agreed]"), ("[rires] Bonjour", None, "Bonjour"), ("(aplausos)", None, None), ("[música]", None, None),
    ("[background music]", None, None), ("((crosstalk)) so", None, "so"), ("♪ la la ♪", None, None), ("♪ ♪", None, None), ("...", None, None), ("", None, None), (None, None, None),
])
def test_grammar(text, speaker, clean):
    p = Grammar(ALIASES).parse(text)
    assert (p.speaker, p.spoken) == (speaker, clean is not None)
    if clean is not None:
        assert p.text == clean


def test_rolling():
    assert fresh_words("we have to go", "have to go home now") == "home now"
    assert fresh_words("we have to go", "have to go") == ""
    assert fresh_words("Yes. Yes.", "Yes.") == "Yes."
    assert fresh_words("", "a b") == "a b" and fresh_words("x a", "a b") == "a b"


def test_a_long_caption_rolls_on_over_a_short_one(spark):
    w = [f"w{i}" for i in range(105)]
    captions = [w[:50], w[48:52], w[2:]]
    rows = [(1, i, float(i), float(i) + 1, "host: " + " ".join(c), "x") for i, c in enumerate(captions)]
    alias = spark.createDataFrame([("host", 0)], "alias string, speaker_idx int")
    (turn,) = speaker_turns(spark.createDataFrame(rows, TXT), spark.createDataFrame([], DIA), alias).collect()
    assert turn.text == " ".join(w) and turn.n_texts == 3
    rows = [(1, i, 400.0 * i, None, " ".join(c), "x") for i, c in enumerate([*captions, ["W104", "end"], ["end"]])] + [(2, 9, 0.0, None, "w0 w1", "x"), (2, 10, 1.0, None, None, "x"), (None, 1, 0.0, None, "a b", "x")]
    got = {(r.rec_id, r.seg_id): r.n_repeated for r in rolling_captions(spark.createDataFrame(rows + rows[:2], TXT)).collect()}
    assert got == {(1, 0): 0, (1, 1): 2, (1, 2): 0, (1, 3): 0, (1, 4): 0, (2, 9): 0}


def brute(texts, dia, g, pause=None):
    periods = {}
    for rec, _, s, e, sp, _ in set(dia):
        if None not in (rec, s, e, sp) and round(e * 1000) > round(s * 1000):
            periods.setdefault(rec, {}).setdefault(sp, set()).update(range(round(s * 1000) // 10, round(e * 1000) // 10))
    out = []
    for rec in {t[0] for t in texts if t[0] is not None}:
        run, heard = None, None
        for t in sorted({t for t in texts if t[0] == rec and t[1] is not None}, key=lambda t: (t[2] is not None, t[2] or 0, t[1])):
            p = g.parse(t[4])
            if not p.spoken:
                continue
            who = p.speaker
            if who is None and t[3] is not None and t[2] is not None:
                own = range(round(t[2] * 1000) // 10, round(t[3] * 1000) // 10)
                n = {sp: sum(x in c for x in own) for sp, c in periods.get(rec, {}).items()}
                if n and max(n.values()) > 0:
                    who = min(n, key=lambda k: (-n[k], k))
            late = pause is not None and heard is not None and t[2] is not None and t[2] - heard > pause
            heard = t[3] if heard is None else heard if t[3] is None else max(heard, t[3])
            if run and run[1] == who and not late:
                run[3] = t[1]
            else:
                run = [rec, who, t[1], t[1]]
                out.append(run)
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("slot", [600.0, 7.0])
def test_against_brute_force(spark, slot):
    rng = random.Random(9)
    say = ["Yes.", "(laughs)", None, "", "Speaker 1: we go", "host: well now", "[B] no", "uh,", "we have to go", "have to go home"]
    texts, dia = [], []
    for rec in range(6):
        for i in range(40):
            s = rng.randrange(0, 4000) / 100
            texts.append((rec, rec * 100 + i, rng.choice([s, s, s, s, s, float(round(s)), None]), rng.choice([None, s + rng.randrange(0, 900) / 100]), rng.choice(say), "x"))
            s = rng.randrange(0, 4000) / 100
            if rec:
                dia.append((rec, rec * 100 + i, s, rng.choice([None, s + rng.randrange(-50, 300) / 100]), rng.choice([0, 1, 2, None]), "k"))
    texts += rng.choices(texts, k=30) + [(None, 1, 0.0, 1.0, "Yes.", "x"), (1, None, 0.0, 1.0, "Yes.", "x")]
    dia += rng.choices(dia, k=30)
    alias = spark.createDataFrame([(*x, "z") for x in [*ALIASES.items(), (None, 3)]], "alias string, speaker_idx int, clean string")
    got = speaker_turns(spark.createDataFrame(texts, TXT), spark.createDataFrame(dia, DIA), alias, slot_s=slot)
    rows = got.collect()
    assert sorted(((r.rec_id, r.speaker_idx, r.first_seg_id, r.last_seg_id) for r in rows), key=str) == brute(texts, dia, Grammar(ALIASES))
    assert all(r.text for r in rows)
    for pause in (0.05, 0.3):
        got = speaker_turns(spark.createDataFrame(texts, TXT), spark.createDataFrame(dia, DIA), alias, pause=pause, slot_s=slot, with_text=False).collect()
        assert sorted(((r.rec_id, r.speaker_idx, r.first_seg_id, r.last_seg_id) for r in got), key=str) == brute(texts, dia, Grammar(ALIASES), pause)


def test_pause_and_empty(spark):
    alias = spark.createDataFrame([("host", 0)], "alias string, speaker_idx int")
    none = spark.createDataFrame([], DIA)
    texts = spark.createDataFrame([(1, i, float(s), float(s) + 1, "host: go on", "") for i, s in enumerate([0, 1, 2, 30, 31, 700])], TXT)
    assert speaker_turns(texts, none, alias).count() == 1
    for slot in (600.0, 10.0):
        assert speaker_turns(texts, none, alias, pause=5.0, slot_s=slot).count() == 3
    assert calibrated_pause(texts) == 668.0 and calibrated_pause(texts, 0.5) == 27.0
    assert calibrated_pause(texts, slot_s=10.0) == 668.0  # over slots
    far = spark.createDataFrame([(1, 1, 0.0, 9e11, "go", ""), (1, 2, 5.0, 6.0, "on", "")], TXT)
    heard = spark.createDataFrame([(1, 1, 0.0, 8e11, 3, ""), (1, 2, 4.0, 7.0, 2, "")], DIA)
    assert [(r.speaker_idx, r.n_texts) for r in speaker_turns(far, heard, alias).collect()] == [(3, 1), (2, 1)]
    assert speaker_turns(spark.createDataFrame([], TXT), none, alias).count() == 0
    assert calibrated_pause(spark.createDataFrame([], TXT)) == float("inf")
