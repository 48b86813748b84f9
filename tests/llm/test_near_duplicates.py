import random
import re

import pytest

from lexicarta.llm import near_duplicates as nd
from tests.conftest import rows

WORD = re.compile(r"[^\W_]+")


def similar(texts, threshold, width, min_words):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").lower())
        if len(w) >= min_words and len(w) >= width:
            sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    texts, fixed = {}, " ".join(rng.choices(words, k=14))
    for i in range(n):
        if i and rng.random() < 0.6:
            t = (texts[rng.randrange(i)] or "x").split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[len(t) // 2 :] + t[: len(t) // 2]
        else:
            t = rng.choices(words, k=rng.randint(3, 40))
            if rng.random() < 0.5:
                t += fixed.split()  # a passage that many texts share
        texts[i] = " ".join(t)
    texts |= {900: None, 901: "", 902: "one", 903: "Same WORDS here, same words there", 904: "same words here same words there"}
    return texts


@pytest.mark.parametrize(("seed", "threshold", "width", "occurrences"), [(1, 0.6, 3, 4), (2, 0.8, 5, 2), (3, 0.6, 3, 1)])
def test_pairs_are_those_of_brute_force(spark, seed, threshold, width, occurrences):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, i, t, "x") for i, t in texts.items()] + [(None, 1, "one two three four five six", "x")], "id bigint, row_key bigint, content string, cls string")
    members, links = nd.similar_classes(df, threshold, width, 5, occurrences)
    got = set(rows(nd.similar_rows(members, links)))
    assert got == similar(texts, threshold, width, 5)


def test_a_hot_shingle_and_long_lists_in_blocks(spark):
    rng = random.Random(11)
    texts = {}
    for i in range(240):
        own = [f"v{rng.randrange(400)}" for _ in range(rng.randint(4, 12))]
        texts[i] = " ".join(own + ("the same legal notice on every page".split() if i % 3 == 0 else []))
        if i % 10 == 9:
            texts[i] = texts[i - rng.choice([3, 6])] + " x"
    df = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "id bigint, row_key bigint, content string")
    for block in (3, 7, 2048):
        members, links = nd.similar_classes(df, 0.5, 2, 2, 2, block)
        assert set(rows(nd.similar_rows(members, links, block))) == similar(texts, 0.5, 2, 2)
    copies = spark.createDataFrame([(i, i, "a b c d e f") for i in range(50)], "id bigint, row_key bigint, content string")
    members, links = nd.similar_classes(copies, 0.8, 5, block=4)
    assert nd.similar_rows(members, links, 4).distinct().count() == nd.similar_rows(members, links, 4).count() == 50 * 49 // 2


def test_rows_of_one_key_are_no_pair(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, 7, text), (2, 7, text), (3, 8, text), (4, 8, text + " i")], "id bigint, row_key bigint, content string")
    members, links = nd.similar_classes(df, 0.6, 3)
    assert rows(nd.similar_rows(members, links)) == [(1, 3), (1, 4), (2, 3), (2, 4)]
    assert rows(nd.groups(members, links)) == [(1, 1, 3, 1), (2, 1, 3, 1), (3, 1, 3, 1), (4, 1, 1, 1)]


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(5)
    texts = [(i, i, "the same page again and again in every file of this corpus" if i % 3 == 0 else " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30))) for i in range(600)]
    members, links = nd.similar_classes(spark.createDataFrame(texts, "id bigint, row_key bigint, content string"))
    got = nd.groups(members, links)
    assert got.where("copies = 200").count() == 200 and got.select("group_id").distinct().count() == 401


def test_every_id_has_a_group(spark):
    texts = {1: "Intentionally blank", 2: "intentionally, blank!", 3: "blank intentionally", 4: "one", 5: None, 6: "", 7: None, 8: " * * *", 9: "* * *", 10: "a b c d e", 11: "a b c d", 12: "A B C D"}
    df = spark.createDataFrame([(i, i, t) for i, t in texts.items()] + [(None, 1, "one")], "id bigint, row_key bigint, content string")
    members, links = nd.similar_classes(df)
    got = {r.id: (r.group_id, r.copies, r.links) for r in nd.groups(members, links, df).collect()}
    assert got == {1: (1, 2, 0), 2: (1, 2, 0), 3: (3, 1, 0), 4: (4, 1, 0), 5: (5, 1, 0), 6: (6, 1, 0), 7: (7, 1, 0), 8: (8, 2, 0), 9: (8, 2, 0), 10: (10, 1, 0), 11: (11, 2, 0), 12: (11, 2, 0)}


def test_no_rows(spark):
    members, links = nd.similar_classes(spark.createDataFrame([], "id bigint, row_key bigint, content string"))
    assert members.count() == links.count() == nd.groups(members, links).count() == nd.similar_rows(members, links).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40) if i % 7] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(30)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    parent = {x: x for e in edges for x in e}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(rows(nd.components(spark.createDataFrame(edges, "cls_a bigint, cls_b bigint")), "cls", "root"))
    assert got == {x: find(x) for x in parent}
