"""The LSH forest against all pairs, also with every group compared by probes and blocks."""

import random

import numpy as np
import pytest

from llm import forest as L

from test_jaccard import brute, near_copies, shingles


def found(df, *how):
    return {tuple(r) for r in L.near_copies(df, *how).collect()}


def wanted(rows, n, num, den):
    return {(i, size, root, i == root) for i, size, root in brute(rows, n, num, den)}


@pytest.mark.parametrize("tuned", [{}, {"GROUP": 4, "PROBES": 2, "ROUNDS": 1, "REGION": 6, "ENDS": 3}, {"GROUP": 10, "PROBES": 1, "ROUNDS": 2, "REGION": 12}])
def test_components_equal_all_pairs(spark, monkeypatch, tuned):
    for k, v in tuned.items():
        monkeypatch.setattr(L, k, v)
    rows = near_copies(20 + len(tuned))
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100) == wanted(rows, 3, 85, 100)


def test_given_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, 3, 85, 100) == wanted(rows, 3, 85, 100)


def test_chain_in_a_dense_group(spark):
    """A chain that hangs on one member of a group of copies of a passage all of them share."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for _ in range(150):
        t = list(base)
        for _ in range(3):
            t[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append(t)
    t = list(rows[70])
    for k in range(12):  # each step is a link, the ends are not
        for j in range(3):
            t[k * 9 + j] = f"y{k}{j}"
        rows.append(list(t))
    rows += [base[:60] + [f"z{r.randrange(10**6)}" for _ in range(60)] for _ in range(100)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 3, 85, 100) == wanted(rows, 3, 85, 100)


def test_repeated_id_with_two_texts_keeps_both_links(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(10):
        a = " ".join([f"g{g}", *base[:30], *(f"{g}a{i}" for i in range(40))])
        b = " ".join([f"g{g}", *base[:30], *(f"{g}b{i}" for i in range(40))])
        rows += [(g * 10 + 5, a), (g * 10 + 5, b), (g * 10 + 1, a + " end"), (g * 10 + 7, b + " end")]
    got = {(i, c) for i, _, c, _ in found(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)}
    assert got == {(g * 10 + k, g * 10 + 1) for g in range(10) for k in (1, 5, 7)}


def test_odd_rows(odd, empty):
    got = L.near_copies(odd, 3, 85, 100).collect()
    by = {}
    for d, n, c, k in got:
        by.setdefault(d, set()).add((n, c, k))
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[10] == {(0, 10, True)} and by[9] == {(1, 9, True)}
    assert by[5] == {(78, 5, True)} and by[6] == {(78, 5, False)} and by[7] == {(79, 5, False)}
    assert by[None] == {(78, 5, False), (0, None, True)} and len(got) == 12
    assert L.near_copies(empty).count() == 0


def test_signatures_agree_as_often_as_sets_do():
    r = np.random.RandomState(1)
    for share in (0.5, 0.85):
        both = []
        for _ in range(40):
            x = r.randint(1, 1 << 62, 400, dtype=np.int64).astype(np.uint64)
            same = int(400 * 2 * share / (1 + share))
            y = np.concatenate([x[:same], r.randint(1, 1 << 62, 400 - same, dtype=np.int64).astype(np.uint64)])
            s = L.signatures([np.sort(x), np.sort(y)])
            both.append((s[0] == s[1]).mean())
        assert abs(np.mean(both) - share) < 0.03


def test_regions_adapt_their_depth():
    common = np.array([3, 3, 1, 2, 5, 5, 5, 5])
    some, cuts = L.regions(common, 9, 4, start=2)
    assert (0, 3) in some and (4, 9) in some or cuts.size  # the second stretch has six rows: it goes deeper
    assert all(j - i <= 4 for i, j in some)
    some, _ = L.regions(np.full(20, L.VALUES), 21, 6, start=2)
    assert some[0] == (0, 6) and some[-1][1] == 21 and all(b < c for (_, c), (b, _) in zip(some, some[1:], strict=False))


def test_shingles_are_the_brute_ones():
    assert len(shingles("a b c d", 3)) == 2


def test_stars_of_a_task_keep_components():
    from llm.components import least_labels

    r = np.random.RandomState(2)
    a, b = r.randint(0, 400, 300), r.randint(0, 400, 300)
    nodes, root = least_labels(np.maximum(a, b), np.minimum(a, b))
    want = {i: i for i in range(400)}
    for _ in range(400):
        for x, y in zip(a, b, strict=True):
            want[x] = want[y] = min(want[x], want[y])
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_streamed_stars_find_components(spark, seed):
    from llm import stars

    r = random.Random(seed)
    edges = [(r.randrange(500), r.randrange(500)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2001 + i) for i in range(300)] + [(7, 7), (None, 3)]
    want = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    while True:
        new = dict(want)
        for x, y in edges:
            if x in want and y in want:
                new[x] = new[y] = min(new[x], new[y])
        if new == want:
            break
        want = new
    got = stars.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
    assert len(got) == len(want) and {x.node: x.root for x in got} == want
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0
