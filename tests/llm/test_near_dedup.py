"""Components and near duplicates against brute force."""

import random

import pytest

from spanloom.llm.components import components
from spanloom.llm.near_dedup import BATCH, MISS, SIZE, least_matches, near_duplicates


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def plain_components(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    for links in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(r.randrange(200), r.randrange(200)) for _ in range(110)]):
        df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
        nodes = {n for link in links if link[0] != link[1] for n in link}
        assert {x.node: x.label for x in components(df).collect()} == plain_components(nodes, [x for x in links if x[0] != x[1]])


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def plain(rows, percent):
    sets = {k: shingles(t) for k, t in rows}
    keys = [k for k in sets if sets[k]]
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    whole = plain_components(list(sets), links)
    return {k: (len(sets[k]), whole[k], whole[k] == k) for k in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_against_brute_force(spark, percent):
    r = random.Random(percent)
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (906, "É x"), (907, "é x")]
    for g in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([8, 60, 200]))]
        for _ in range(25):
            words = list(base)
            for _ in range(r.randrange(6)):
                at = r.randrange(len(words))
                r.choice([lambda w, a: w.__setitem__(a, f"x{r.random()}"), lambda w, a: w.insert(a, f"y{r.random()}"), lambda w, a: w.pop(a)])(words, at)
            rows.append((len(rows), " ".join(words)))
        rows += [(len(rows) + i, " ".join(base)) for i in range(5)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, component_id string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(df, percent).collect()}
    assert got == plain(rows, percent)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "z y")], "doc_id long, text string")
    got = sorted(near_duplicates(df, 85).collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0))
    assert [(x.doc_id, x.component_id, x.kept) for x in got] == [(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert near_duplicates(df.where("false"), 85).count() == 0


def test_pairs_at_the_threshold_survive():
    from math import comb

    for percent in (80, 85):
        t = percent / 100 + (1 - percent / 100) / 256
        for k, m in enumerate(least_matches(percent), 1):
            n = k * BATCH
            assert sum(comb(n, i) * t**i * (1 - t) ** (n - i) for i in range(m)) < 10 * MISS and 0 < m < n <= SIZE
