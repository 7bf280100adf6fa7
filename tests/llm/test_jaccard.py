"""The exact join against all pairs, also with every region cut by pivots and by blocks."""

import itertools
import random
import re

import numpy as np
import pytest

from llm import jaccard as J
from llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    """(doc_id, size, least doc_id of the component) with all pairs of distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, groups=6, size=25, words=60):
    """Groups around a base text with a few replaced words, and a passage that unrelated texts share."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(words)] = f"x{r.randrange(10**6)}"
            rows.append(t)
        rows.append([f"u{r.randrange(10**6)}" for _ in range(30)] + passage)
    r.shuffle(rows)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("tuned", [{}, {"REGION": 4, "HOT_LIST": 3, "BLOCK": 5, "PIVOTS": 2, "DEPTH": 1}, {"REGION": 6, "HOT_LIST": 8, "BLOCK": 4, "PIVOTS": 4, "DEPTH": 0}])
def test_components_equal_all_pairs(spark, monkeypatch, tuned):
    for k, v in tuned.items():
        monkeypatch.setattr(J, k, v)
    rows = near_copies(len(tuned))
    got = {tuple(r) for r in J.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in J.components_of(odd, 4, 85, 100).collect()), key=str)
    by = {}
    for d, n, c in got:
        by.setdefault(d, set()).add((n, c))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[10] == {(0, 10)} and by[9] == {(1, 9)}
    assert by[5] == by[6] == {(77, 5)} and by[7] == {(78, 5)}
    assert by[None] == {(77, 5), (0, None)} and len(got) == 12
    assert J.components_of(empty).count() == 0


def test_one_of_each(odd, empty):
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 8, 9, 10, 11] or ids == [1, 2, 5, 8, 9, 10, 11]
    assert J.one_of_each(empty).count() == 0


def test_prefix_lengths():
    for n in range(1, 300):
        k, share = J._prefix(n, 85, 100)
        assert 1 <= k <= n and k >= min(n, n - -(-85 * n // 100) + share)


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_inseparable_group_is_not_replicated(spark, monkeypatch):
    """Texts around one base, too far apart for links to the pivots and too near to be separated by them."""
    for k, v in {"REGION": 8, "HOT_LIST": 3, "BLOCK": 16, "PIVOTS": 8, "DEPTH": 1}.items():
        monkeypatch.setattr(J, k, v)
    r = random.Random(5)
    rows = []
    for i in range(120):
        t = [f"w{k}" for k in range(120)]
        for _ in range(r.randrange(2, 9)):
            t[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    replicas, old = [], J._block_pairs

    def counted(members, distance):
        replicas.append(members.count() / members.select("rid").distinct().count())
        return old(members, distance)

    monkeypatch.setattr(J, "_block_pairs", counted)
    got = {tuple(r) for r in J.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)
    assert replicas and max(replicas) < 2.1


def test_short_texts_that_share_passages_are_no_group(spark, monkeypatch):
    """900 short texts hang together by passages, three of 90 each; they share too few regions to be one group, and copies are found."""
    r = random.Random(4)
    passages = [" ".join(f"p{p}w{i}" for i in range(9)) for p in range(90)]
    texts = list({" ".join(r.sample(passages, 3)) for _ in range(900)})
    rows = [(i, t) for i, t in enumerate([*texts, *(f"{t} end" for t in texts[:20])])]
    monkeypatch.setattr(J, "REGION", 64)
    cut = []
    monkeypatch.setattr(J, "_cut", lambda *a: cut.append(a[0].count()) or [])
    got = {tuple(x) for x in J.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert not cut and got == brute(rows, 4, 85, 100) and sum(c < i for i, _, c in got) >= 20


def test_frequent_classes_are_found_in_any_number_of_rare_shingles():
    total = np.random.default_rng(1).poisson(6000, 20_000)
    total[:50] += 3000
    assert J._common(total)[:50].all() and J._common(total).sum() < 200
    assert not J._common(np.zeros(100, np.int64)).any()


def test_partners_share_their_regions():
    """Of two sets at the least similarity the first parts of the order share as many shingles as a pair is asked for."""
    for n in range(1, 200):
        for num, den in ((85, 100), (4, 5)):
            k, share = J._prefix(n, num, den)
            least = -(-num * n // den)  # a partner's shingles, all of them common
            assert 1 <= share <= least and k - (n - least) >= share  # the others may all come first
            assert J._share(n - 1, num, den) <= share
