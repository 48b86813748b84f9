import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexicarta.llm import leaks, mixing, text_quality
from lexicarta.llm.words import word_codes
from tests.conftest import rows


def brute(docs, items, n):
    docs, items = [d for d in docs if d[0] is not None], [i for i in items if i[0] is not None]
    grams = lambda t: {tuple(w[i : i + n]) for w in [(t or "").lower().split()] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, p in items if grams(t) & grams(p)}


def test_leaks_by_both_joins(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(12)] + [(None, "w1 w2 " * 9), (50, None), (51, ""), (52, "too short"), (53, " ".join(["ja"] * 20))]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=60)
        if d % 2:
            p = (items[rng.randrange(12)][1]).split()
            a, n = rng.randrange(10), rng.randint(4, 14)
            words[20:20] = p[a : a + n]
        docs.append((d, " ".join(words)))
    docs += [(None, items[0][1]), (900, None), (901, ""), (902, items[0][1].upper()), (902, items[0][1]), (903, " ".join(["ja"] * 300))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("passage", F.lit("x"))
    i = spark.createDataFrame(items, "item_id bigint, passage string").withColumn("text", F.lit("y"))
    args = (d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("passage"), 8)
    near, far = leaks.leaks(*args), leaks.leaks(*args, broadcast_words=0)
    assert set(rows(near, "doc_id", "item_id")) == brute(docs, items, 8)
    assert set(rows(near)) == set(rows(far))
    assert near.where("doc_id = 902 and coverage < 1").count() == 0 and near.where("doc_id = 903").first().covered == 20
    assert leaks.leaks(d, F.col("doc_id"), F.col("text"), i.where("false"), F.col("item_id"), F.col("passage")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 5))
def test_tiles_are_maximal_and_do_not_overlap(x, y, least):
    a, b = word_codes([" ".join(x)])[0], word_codes([" ".join(y)])[0]
    found = leaks.tiles(a, b, least)
    left, right = [None] * len(x), [None] * len(y)
    for i, j, n in found:
        assert n >= least and x[i : i + n] == y[j : j + n]
        assert left[i : i + n] == [None] * n and right[j : j + n] == [None] * n
        left[i : i + n] = right[j : j + n] = ["m"] * n
    free = lambda marks, at: marks[at : at + least] == [None] * least
    assert not any(x[i : i + least] == y[j : j + least] and free(left, i) and free(right, j) for i in range(len(x) - least + 1) for j in range(len(y) - least + 1))


def test_budgets_prefer_siblings():
    leaves = [(("d", "a"), 1.0, 10.0), (("d", "b"), 1.0, 100.0), (("e", "c"), 2.0, 1000.0)]
    assert mixing.budgets(leaves, 100) == pytest.approx({("d", "a"): 10, ("d", "b"): 40, ("e", "c"): 50})
    assert mixing.budgets([(("d", "a"), 1.0, 10.0), (("e", "c"), 1.0, 1000.0)], 100) == pytest.approx({("d", "a"): 10, ("e", "c"): 90})
    assert mixing.budgets(leaves, 10_000) == pytest.approx({("d", "a"): 10, ("d", "b"): 100, ("e", "c"): 1000})
    assert mixing.budgets([], 5) == {}


def test_mix_keeps_repeats_and_reports_shares(spark):
    docs = [(i, 10, "big", "en" if i % 2 else "de") for i in range(100)] + [(200 + i, 10, "small", "en") for i in range(5)] + [(300, 10, None, "en"), (301, 0, "big", "en"), (302, 10, "untold", None)]
    counted = spark.createDataFrame(docs, "doc_id bigint, tokens bigint, source string, language string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mix(counted, ["source", "language"], targets, total=500)
    got = {r.source: r for r in shares.collect()}
    assert (got["small"].tokens, got["small"].most_times, got["big"].tokens, got["absent"].tokens) == (150, 3, 340, 0)
    assert abs(got["small"].actual_share - 150 / 490) < 1e-9
    assert taken.where("source = 'small' and times <> 3").count() == 0 and taken.select("doc_id").distinct().count() == taken.count()
    same, _ = mixing.mix(counted, ["source", "language"], targets, total=500)
    assert rows(same) == rows(taken)
    other, _ = mixing.mix(counted, ["source", "language"], targets, seed=18, total=500)
    assert rows(other) != rows(taken)
    none, empty = mixing.mix(counted.where("false"), ["source", "language"], targets)
    assert none.count() == 0 and empty.count() == 3


def test_mix_over_a_tree_of_three_levels(spark):
    data = [(i, 10, s, d, l) for i, (s, d, l) in enumerate([("a", "x", "en")] * 40 + [("b", "x", "en")] * 10 + [("a", "x", "de")] * 10 + [("c", "y", "en")] * 40)]
    counted = spark.createDataFrame(data, "doc_id bigint, tokens bigint, source string, domain string, language string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mix(counted, ["domain", "language", "source"], targets, total=600)
    got = {r.source: r for r in shares.collect()}
    # b has 200 tokens at most of its 240; its sibling in domain and language takes the rest, c keeps its own
    assert (got["b"].tokens, got["b"].most_times, got["c"].tokens) == (200, 2, 180)
    assert got["a"].budget == 220 and 220 - 2 * 10 < got["a"].tokens <= 220  # less than a document short in each of its two leaves
    assert taken.where("times > 2").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(counted, ["domain", "language", "source"], targets, most_leaves=3)


def test_reordered_passages_are_found_by_their_coverage(spark):
    passage = [f"w{i}" for i in range(40)]
    parts = [passage[i : i + 8] for i in range(0, 40, 8)]
    shuffled = [w for n, k in enumerate((3, 0, 4, 1, 2)) for w in [f"x{n}", *parts[k]]]
    docs = [(1, " ".join(["a"] * 9 + shuffled)), (2, " ".join(["a"] * 9 + passage[4:17])), (3, " ".join(passage[:6] + ["b"] * 30)), (4, " ".join(passage))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(passage))], "item_id bigint, passage string")
    found = leaks.leaks(df, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("passage"), least_words=5, least_run=12, least_coverage=0.5)
    assert rows(found, "doc_id", "tiles", "longest", "covered") == [(1, 5, 8, 40), (2, 1, 13, 13), (4, 1, 40, 40)]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world, hello!"), (2, None), (3, "")], "id bigint, text string")
    assert [r[1] > 0 for r in rows(mixing.token_counts(df, F.col("text"), {"id": F.col("id")}), "id", "tokens")] == [True, False, False]


PROSE = "The pump moved every valve of the old plant, and the crew read the meter. "
TEXTS = [
    (PROSE * 4, "prose"),
    (PROSE.lower().replace(".", "").replace(",", "") * 4, "prose"),
    (PROSE.upper() * 3, "prose"),
    ("The pump moved every valve of the old plant, and the\ncrew read the meter while the shift was over and the\nvalves of the plant were closed by the crew again.", "prose"),
    ("> Die Pumpe liefert das Wasser in das Lager, während der\n> Zähler die Menge misst. Das Ventil schließt nach der\n> Prüfung, weil der Druck steigt.", "prose"),
    ("\n".join(f"- how to open the valve {i}" for i in range(8)), "list"),
    ("\n".join(f"Notes on the old pump {w}" for w in ("one", "two", "three", "four", "five")), "list"),
    ("a,b,12,9\nc,in the pump,3,4\nd,5,6,7\n", "table"),
    ("| a | b |\n| --- | --- |\n| in the pump | 3 |\n| x | y |", "table"),
    ("<tr><td>in the pump</td><td>3</td></tr>\n<tr><td>x</td><td>9</td></tr>\n<tr><td>of a</td><td>7</td></tr>", "table"),
    ("pump            12              valve\nmeter           9               in the plant\n", "table"),
    ("00000010  d9 28 ba 78 5e 00 6c 22 ae 36 99 93 f9 6a ce 74\n00000020  9e e7 f3 c6 a2 0f 5a 07 88 0d c4 4f 14 2d 1d 92", "encoded"),
    ("the the of pump a the is valve the and old the of the meter the a read every the in the plant the by the crew each the of", "scrambled"),
    ("============\n------------\n************", "other"),
]


WORDS = {
    "en": "the of and to in a is that for with on by this be are it was were while how again over".split(),
    "de": "der die das und in zu den ist von mit des im nach weil während nicht".split(),
}
FOLLOWERS = [("en", w, 100, 1, 0) for w in ("the", "a")] + [("en", w, 100, 60, 0) for w in ("of", "and", "to", "in")] + [("en", "", 0, 0, 1500)]
FOLLOWERS += [("de", w, 100, 0, 0) for w in ("der", "die", "das")] + [("de", w, 100, 50, 0) for w in ("und", "in")] + [("de", "", 0, 0, 1500)]
START = text_quality.Profiles.start(WORDS, FOLLOWERS)


@pytest.mark.parametrize(("text", "kind"), TEXTS)
def test_profiles(text, kind):
    found = text_quality.assess([text], START)
    assert (found["prose_share"][0] >= 0.5) == (kind == "prose")
    if kind != "other":
        assert text_quality.KINDS[found["kind"][0]] == kind


def test_mixed_text_is_measured_by_its_parts():
    rows_ = "\n".join(f"{i},{i * 7},valve,{i * 3}" for i in range(60))
    found = text_quality.assess([PROSE * 3 + "\n\n" + rows_], START)
    assert 0.1 < found["prose_share"][0] < 0.5


def test_quality_figures(spark):
    df = spark.createDataFrame([(1, "One two. Three!\nfour"), (2, None), (3, " \n "), (4, "x" * 200_000)], "doc_id bigint, text string").withColumn("kind", F.lit("x"))
    words = spark.createDataFrame([("en", "two"), ("en", None), (None, "x")], "lang string, word string")
    got = {r.doc_id: r for r in text_quality.quality(df, F.col("doc_id"), F.col("text"), words).collect()}
    assert got[1].common_words == 0.25
    assert text_quality.quality(df.where("false"), F.col("doc_id"), F.col("text"), words.where("false")).count() == 0
    assert (got[1].n_words, got[1].ended_lines) == (4, 0.5) and got[1].mean_word_length == pytest.approx(3.75)
    assert got[2].kind is None and got[3].kind is None and got[3].n_words == 0 and got[4].n_words == 1


def test_profiles_are_learned_from_the_documents(spark):
    import random

    rng = random.Random(2)
    nouns = [f"{a}{b}" for a in ("pum", "val", "met", "cre", "pla") for b in ("po", "vi", "ter", "lan", "mo", "ga")]

    def sentence():
        return f"The {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.choice(nouns)}s a {rng.choice(nouns)} and the {rng.choice(nouns)} to the {rng.choice(nouns)}. "

    def salad():
        return " ".join(rng.choice(nouns) for _ in range(60))

    def shuffled():
        words = "".join(sentence() for _ in range(5)).split()
        rng.shuffle(words)
        return " ".join(words)

    def rows_():
        return "\n".join(f"{rng.choice(nouns)},{rng.randrange(99)},{rng.choice(nouns)},{rng.randrange(99)}" for _ in range(12))

    made = [("prose", lambda: "".join(sentence() for _ in range(5)))] * 7 + [("no", salad), ("no", shuffled), ("no", rows_)]
    data = [(i, *(lambda k, f: (k, f()))(*rng.choice(made))) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id bigint, truth string, text string")
    words = spark.createDataFrame([("en", w) for w in ("the", "a", "of", "and", "to", "in")] + [("fr", w) for w in ("le", "la", "de")], "lang string, word string")
    p = text_quality.learn(df.where("doc_id < 300"), F.col("text"), words)
    assert p.determiners[p.languages.index("en")] >= {"the", "a"}
    held = df.where("doc_id >= 300")
    got = text_quality.quality(held, F.col("doc_id"), F.col("text"), words, p).join(held, "doc_id").select("truth", (F.col("prose_share") >= 0.5).alias("prose")).collect()
    right = sum((r.truth == "prose") == r.prose for r in got)
    assert right >= 0.95 * len(got) == 0.95 * 300


def test_every_document_counts_in_the_fit(spark):
    # a determiner of 24 documents among 12,000; a sample of a third sees it too seldom
    line = "The old house of the town and the garden to the north. "
    data = [(i, line + ("Yon gate and the wall. " if i % 500 == 0 else "") + f"Row{i}") for i in range(12_000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    words = spark.createDataFrame([("en", w) for w in ("the", "yon", "of", "and", "to")], "lang string, word string")
    p = text_quality.learn(df, F.col("text"), words)
    assert {"the", "yon"} <= p.determiners[p.languages.index("en")]
    again = text_quality.learn(df.repartition(5), F.col("text"), words)  # the same whatever the parts
    assert np.array_equal(p.prose, again.prose) and np.array_equal(p.other, again.other)


def test_no_call_is_made_for_each_word():
    # calls a word were much of the CPU seconds of p9_found, 1,211 a GB by the projection to 30 GB
    def calls(texts):
        text_quality.assess(texts, START)  # what is made once
        seen, before = 0, sys.getprofile()

        def count(*_):
            nonlocal seen
            seen += 1

        sys.setprofile(count)
        try:
            text_quality.assess(texts, START)
        finally:
            sys.setprofile(before)
        return seen

    short, long = ("The pump of the plant is in the garden. " * n for n in (2, 40))
    assert calls([long] * 20) < 1.2 * calls([short] * 20)


def test_bulk_counts_equal_those_word_by_word(monkeypatch):
    rng = random.Random(5)
    atoms = ["the", "The", "of", "der", "und", "DIE", "pump", "a", "12", "don't", "x_y", "_", "²", "Ⅷ", "ß", "日本", "İn", "ΑΣ'Α", "ΟΔΟΣ", "ʰ", "\xa0", "\x1c", "\U0001f600", "𝒜b", ". ", "!", "”", "- of"]
    texts = ["".join(rng.choice(atoms) + rng.choice([" ", " ", " ", ""]) for _ in range(rng.randint(1, 30))) for _ in range(300)] + [None, "", " \n "]
    whole = text_quality.segments(texts, START), text_quality.assess(texts, START)
    monkeypatch.setattr(text_quality, "_BLOCK", 60)
    counts, language, sizes, owner = text_quality.segments(texts, START)
    figures = text_quality.assess(texts, START)
    assert all(np.array_equal(a, b) for a, b in zip(whole[0], (counts, language, sizes, owner))) and all(np.array_equal(whole[1][k], v) for k, v in figures.items())
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got, expected, every = Counter(), Counter(), START.every_word()
    for part in text_quality._followers(START)(iter([batch])):
        for lang, word, *n in zip(*(c.to_pylist() for c in part.columns)):
            got.update({(lang, word, k): v for k, v in enumerate(n)})
    for i, text in enumerate(texts):
        words = text_quality.WORD.findall((text or "").lower())
        votes = [sum(w in known for w in words) for known in START.words]
        lang = votes.index(max(votes))
        known, lead = ([w in s[lang] for w in words] for s in (START.words, START.determiners))
        expected.update([(START.languages[lang], "", 2)] * len(words))
        for w, k, after in zip(words, known, known[1:]):
            expected.update({(START.languages[lang], w, 0): k, (START.languages[lang], w, 1): k and after})
        plain = text_quality.WORD.findall(text or "")
        assert (figures["n_words"][i], figures["common_words"][i]) == (len(plain), sum(w.lower() in every for w in plain) / max(1, len(plain)))
        if text and not text.isspace():
            (at,) = np.flatnonzero(owner == i)
            follow = [k for d, k in zip(lead, known[1:]) if d]
            assert (language[at], sizes[at]) == (lang, sum(map(len, text.split())))
            assert counts[at, 7:].tolist() == [sum(lead), sum(known) - sum(lead), len(words) - sum(known) or int(not words), len(follow), sum(follow)]
    assert +got == +expected


def test_one_round_of_the_fit_by_hand():
    counts, language, sizes, _ = text_quality.segments([PROSE * 2, "a,1,b,2\nc,3,d,4\ne,5,f,6", PROSE], START)
    x = START.expanded(counts, language)
    kind = START.distances(x, language).argmin(1)
    fitted = START.moved(START.sums(x[:1], language[:1], sizes[:1]) + START.sums(x[1:], language[1:], sizes[1:]), prior=10.0)
    shares = np.concatenate([x[:, a:b] / x[:, a:b].sum(1, keepdims=True) for a, b in ((0, 4), (4, 7), (7, 10), (10, 12))], axis=1)
    mean = lambda mine, first: ((shares[mine] * sizes[mine, None]).sum(0) + 10 * first) / (sizes[mine].sum() + 10)
    assert np.allclose(fitted.prose[language[0]], mean((kind == 0) & (language == language[0]), mean(kind == 0, text_quality.SEEDS[0])), atol=1e-6)
    assert all(np.allclose(fitted.other[k - 1], mean(kind == k, text_quality.SEEDS[k]), atol=1e-6) for k in range(1, len(text_quality.SEEDS)))
