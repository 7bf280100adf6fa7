"""Exact Jaccard join of documents as sets of word shingles, by pivots and Voronoi regions.

Jaccard distance is a metric, so a document within ``r`` of another differs from it by at most ``r`` in its distance to
any pivot. The join works in two levels of pivots:

1. *Shingles as pivots.* The pivot of shingle s is the set {s}; a document is nearer than 1 to it only if it has s. All
   pivots share one order, and a document belongs to the regions of its first ``|A| - ceil(t|A|) + l`` pivots: two linked
   documents then share ``l`` regions at least, so a pair that shares fewer is no link. ``l`` is ``SHARED`` for short texts:
   with one region in common most short texts of a large corpus hang together. Very frequent shingles, known from
   a count over all documents, come last in the order. This cuts the corpus into groups that share no link.
2. *Documents as pivots.* A group that is too large for one task is cut again: its most central documents are pivots,
   every document goes to the Voronoi region of its nearest one and, as a boundary document, to each region whose pivot
   is at most ``2r`` farther. A document within ``r`` of a pivot is linked to it at once; regions in which all are linked
   already are done. Regions that are still too large are cut again. A group whose regions together have more than a
   quarter of its pairs is not separated by its pivots (most distances are within ``2r``): its rows stay in one cell, not
   one for each region, and are joined by pairs of blocks, ordered by distance to a pivot so that far blocks are left out.

Regions of bounded size are joined exactly in a task. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import words as W
from llm.components import components
from llm.store import small_batches, written

COUNTERS = 1 << 18  # of the count of frequent shingles: fixed size, so its broadcast is 32 KB whatever the input
HOT_LIST = 256  # documents of a shingle's region whose pairs are counted; a larger region is one group
SHARED = 8  # regions that two linked documents share at least, as far as they have as many: fewer join unlike short texts
REGION, REGION_SHINGLES, PIVOTS, DEPTH, BLOCK = 512, 1 << 21, 16, 3, 1024
WORTH = 4  # regions are used if they have at most 1 / WORTH of their group's pairs; then they hold it 2.1 times at most
CHOSEN = "s long, k1 long, n int, near boolean, hot long, l long, central double"
FAR = 0.7  # a document farther than this from every pivot stays for other pivots


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles: two sums of two different bijections."""
    with np.errstate(over="ignore"):
        a, b = W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), W.mix(s + np.uint64(0x14057B7EF767814F)).sum()
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, its distinct shingles ascending)"""
    for part in W.slices(batch.column("text")):
        for i, s in enumerate(W.shingle_sets(part, part.hashes(lower=True), n)):
            yield part.first + i, s


def _share(size, num: int, den: int):
    """Regions that a document of ``size`` shingles shares with any partner of that size or more; never falls with the size."""
    size = np.asarray(size, np.int64)
    return np.minimum(-(-num * size // den), np.maximum(SHARED, size // 20))


def _prefix(size: int, num: int, den: int) -> tuple[int, int]:
    """Length of the part of the order in which a document has regions, and the regions it shares with any larger partner."""
    share = int(_share(size, num, den))
    return size - (num * size + den - 1) // den + share, share


def _common(total: np.ndarray) -> np.ndarray:
    """Classes with far more than the rest: the rest of a class is a sum of rare shingles, near the median whatever the input's size."""
    middle = np.median(total)
    return total > middle + max(HOT_LIST, 9 * np.median(np.abs(total - middle)))


def _narrow(n: int):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch.column("text")):
                sets = list(W.shingle_sets(part, part.hashes(lower=True), n))
                keys = [_key(s) if len(s) else (None, None) for s in sets]
                rows = batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())],
                    ["doc_id", "rid", "n_shingles", "k1", "k2"],
                )

    return run


def _class(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)


def _counts(n: int):
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in W.slices(batch.column("text")):
                sets = list(W.shingle_sets(part, part.hashes(lower=True), n))
                total += np.bincount(_class(np.concatenate(sets)), minlength=COUNTERS)
        for c, x in enumerate(np.split(total, 64)):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([x.astype(np.int32).tobytes()], pa.binary())], ["chunk", "counts"])

    return run


def _heavy(docs: DataFrame, n: int) -> bytes:
    """A bit for each of COUNTERS classes of shingles: those in far more documents than other classes."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // 64, np.int64)
        for x in pdf.counts:
            total += np.frombuffer(x, np.int32)
        return pd.DataFrame({"chunk": [pdf.chunk.iloc[0]], "counts": [total.tobytes()]})

    tables = docs.select("text").mapInArrow(_counts(n), "chunk long, counts binary").groupBy("chunk").applyInPandas(add, "chunk long, counts binary").collect()
    total = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(tables, key=lambda r: r.chunk)] or [np.zeros(COUNTERS, np.int64)])
    return np.packbits(_common(total)).tobytes()


def _entries(n: int, num: int, den: int, heavy: bytes):
    def run(batches):
        last = np.unpackbits(np.frombuffer(heavy, np.uint8))[:COUNTERS].astype(bool)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, sizes, shingles, lengths = [], [], [], []
            for _, s in _sets(batch, n):
                if not len(s) or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                behind = last[_class(s)]
                s = np.concatenate((s[~behind], s[behind])) if behind.any() else s
                k, _ = _prefix(len(s), num, den)
                keys.append(key[0])
                sizes.append(len(s))
                lengths.append(k)
                shingles.append(s[:k])
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], ["s", "k1", "n"]
                )
            if len(seen) > 2_000_000:  # only saves rows; a copy that comes again is dropped in its list
                seen.clear()

    return run




def _whole_runs(key: str, columns: list[str], work, passed=None):
    """Batches sorted by key as calls of work(arrays) on whole runs of the key, some hundred thousand rows at a time. A
    run that alone fills the buffer goes piece by piece to passed(arrays, first row of the run)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, first = 0, None
        for batch in batches:
            held.append(batch.select(columns))
            rows += batch.num_rows
            if rows < 300_000:
                continue
            at = {c: x.to_numpy() for c, x in zip(columns, pa.Table.from_batches(held).columns, strict=True)}
            cut, start = int(np.searchsorted(at[key], at[key][-1])), 0
            if first is not None:
                start = int(np.searchsorted(at[key], first[0], side="right"))
                yield from passed({c: x[:start] for c, x in at.items()}, first[1]) if start else ()
            if start < len(at[key]) and cut > start:
                yield from work({c: x[start:cut] for c, x in at.items()})
                first = None
            elif start == len(at[key]):
                cut = start
            elif passed is not None:
                first = (at[key][start], {c: x[start] for c, x in at.items()})
                yield from passed({c: x[start:] for c, x in at.items()}, first[1])
                cut = len(at[key])
            else:
                cut = start
            held = [pa.RecordBatch.from_arrays([pa.array(at[c][cut:]) for c in columns], columns)]
            rows = len(at[key]) - cut
        if rows:
            at = {c: x.to_numpy() for c, x in zip(columns, pa.Table.from_batches(held).columns, strict=True)}
            start = int(np.searchsorted(at[key], first[0], side="right")) if first is not None else 0
            yield from passed({c: x[:start] for c, x in at.items()}, first[1]) if start else ()
            if start < rows:
                yield from work({c: x[start:] for c, x in at.items()})

    return run


def _record(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _begins(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def _shared(at: dict) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (s, k1): those whose region has two documents or more, with the region's size."""
    keep = np.ones(len(at["s"]), bool)
    keep[1:] = (at["s"][1:] != at["s"][:-1]) | (at["k1"][1:] != at["k1"][:-1])
    at = {c: x[keep] for c, x in at.items()}
    begin = _begins(at["s"])
    length = np.diff(np.append(begin, len(at["s"])))
    many = np.repeat(length, length)
    yield _record({c: x[many > 1] for c, x in at.items()} | {"l": many[many > 1]})


def _shared_long(at: dict, first: dict) -> Iterator[pa.RecordBatch]:
    yield _record(at | {"l": np.full(len(at["s"]), 1 << 40)})


def _chosen(num: int, den: int):
    """Of entries sorted by (k1, l, s): those of documents that share enough regions to have a partner at all. near marks
    a document's regions but for its largest ones, which may be as many as a partner shares at least less one: two linked
    documents have a near region in common. hot counts its regions of more than HOT_LIST documents."""

    def work(at):
        begin = _begins(at["k1"])
        m = np.diff(np.append(begin, len(at["k1"])))
        need = np.maximum(1, _share(at["n"][begin].astype(np.int64) * num // den, num, den))
        hot = np.add.reduceat((at["l"] > HOT_LIST).astype(np.int64), begin)
        central = np.add.reduceat(np.minimum(at["l"], 1 << 20), begin) / m
        near = np.arange(len(at["k1"])) - np.repeat(begin, m) < np.repeat(m - need + 1, m)
        keep = np.repeat(m >= need, m)
        yield _record({"s": at["s"][keep], "k1": at["k1"][keep], "n": at["n"][keep], "near": near[keep], "hot": np.repeat(hot, m)[keep], "l": at["l"][keep], "central": np.repeat(central, m)[keep]})

    return work


def _lists(num: int, den: int):
    """From chosen entries sorted by (s, k1), rows (a, b, shared, need, central): a pair and the regions it shares, of
    which it needs ``need``; a star of the near members of a hot region (need 0)."""

    def star(at, anchor):
        some = at["near"] & (at["k1"] != anchor["k1"])
        return _rows(at["k1"][some], np.full(some.sum(), anchor["k1"]), np.ones(some.sum()), np.zeros(some.sum()))

    def pairs(at, i, j):
        k, n, hot = at["k1"], at["n"].astype(np.int64), at["hot"]
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (low * den >= high * num) & (k[i] != k[j])
        i, j, low = i[ok], j[ok], low[ok]
        need = np.maximum(1, _share(low, num, den) - np.minimum(hot[i], hot[j]))
        x, y = np.minimum(k[i], k[j]), np.maximum(k[i], k[j])
        order = np.lexsort((y, x))
        x, y, need = x[order], y[order], need[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        return _rows(x[first], y[first], np.diff(np.append(first, len(x))), need[first])

    def regions(at):
        begin = _begins(at["s"])
        length = np.diff(np.append(begin, len(at["s"])))
        place = np.arange(len(at["s"])) - np.repeat(begin, length)
        is_hot = at["l"] > HOT_LIST
        for b, m in zip(begin[is_hot[begin]], length[is_hot[begin]], strict=True):
            part = {c: x[b : b + m] for c, x in at.items()}
            if part["near"].any():
                yield star(part, {"k1": part["k1"][np.flatnonzero(part["near"])[0]]})
        many = np.repeat(length, length)
        i, waiting = [], 0
        left = np.flatnonzero((many >= 2) & ~is_hot)
        for d in range(1, HOT_LIST):
            left = left[place[left] + d < many[left]]
            if not len(left):
                break
            i.append((left, d))
            waiting += len(left)
            if waiting > 300_000:
                yield pairs(at, np.concatenate([x for x, _ in i]), np.concatenate([x + d for x, d in i]))
                i, waiting = [], 0
        if i:
            yield pairs(at, np.concatenate([x for x, _ in i]), np.concatenate([x + d for x, d in i]))

    def long(at, first):
        yield star(at, first)
        yield star({c: x[:1] for c, x in at.items()} | {"near": np.array([True])}, first)

    return _whole_runs("s", ["s", "k1", "n", "near", "hot", "l"], regions, long)


def _rows(a, b, shared, need) -> pa.RecordBatch:
    a = np.asarray(a, np.int64)
    b = pa.array(np.asarray(b, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.asarray(shared, np.int64)), pa.array(np.asarray(need, np.int64))], ["a", "b", "shared", "need"])


def _member_sets(n: int):
    """The set of each row whose text has the keys that the row names."""

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            keep, sets = [], []
            for i, s in _sets(batch, n):
                if len(s) and _key(s) == (k1[i], k2[i]):
                    keep.append(i)
                    sets.append(s.tobytes())
            some = batch.select(["grp", "rid", "central", "large"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sets, pa.binary())], ["grp", "rid", "central", "large", "s"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets."""
    joined = np.concatenate(sets)
    u, at, df = np.unique(joined, return_inverse=True, return_counts=True)
    column = np.cumsum(df > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    both = df[at] > 1
    row, at = row[both], column[at[both]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, (c, c + width))
        x = np.zeros((len(sets), min(width, int(at[-1]) + 1 - c)), np.float32)
        x[row[i:j], at[i:j] - c] = 1
        out += x @ x.T
    out[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return out  # whole numbers, exact in 24 bits


def _exact(num: int, den: int):
    """Links that span the components of each group of rows sorted by grp."""

    def links(rids, sets):
        first = {}
        for r, s in zip(rids, sets, strict=True):
            first.setdefault(r, s)
        rids, sets = list(first), [np.frombuffer(s, np.uint64) for s in first.values()]
        if len(sets) < 2:
            return
        size = np.array([len(s) for s in sets])
        inter = overlaps(sets)
        seen = np.zeros(len(sets), bool)
        for i in range(len(sets)):
            if seen[i]:
                continue
            seen[i], front = True, [i]
            while front:
                x = front.pop()
                new = np.flatnonzero(((num + den) * inter[x].astype(np.int64) >= num * (size[x] + size)) & ~seen)
                seen[new] = True
                front.extend(new.tolist())
                for y in new:
                    yield rids[x], rids[y]

    def run(batches):
        group, rids, sets = None, [], []
        for batch in batches:
            out = []
            for g, r, s in zip(batch.column("grp").to_pylist(), batch.column("rid").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if g != group:
                    out += links(rids, sets)
                    group, rids, sets = g, [], []
                rids.append(r)
                sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])
        out = list(links(rids, sets))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return run


def _join_exactly(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside each bounded group (grp, rid, s)."""
    return groups.select("grp", "rid", "s").repartition("grp").sortWithinPartitions("grp").mapInArrow(_exact(num, den), "a long, b long")


def _distances(num: int, den: int):
    """Each row's Jaccard distance to its group's pivots: links, Voronoi region, boundary regions, distance to pivot 0."""
    r = 1 - num / den

    def run(batches):
        group, pivots = None, None
        for batch in batches:
            out = []
            for g, rid, s, p in zip(*(batch.column(c).to_pylist() for c in ("grp", "rid", "s", "pivots")), strict=True):
                if g != group:
                    group, ids = g, [x["rid"] for x in p]
                    sets = [np.frombuffer(x["s"], np.uint64) for x in p]
                    joined = np.concatenate(sets)
                    order = np.argsort(joined, kind="stable")
                    pivots = joined[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], np.array([len(x) for x in sets])
                x = np.frombuffer(s, np.uint64)
                low, high = np.searchsorted(pivots[0], x), np.searchsorted(pivots[0], x, side="right")
                hits = np.repeat(low, high - low) + (np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low))
                inter = np.bincount(pivots[1][hits], minlength=len(ids))
                union = len(x) + pivots[2] - inter
                d = 1 - inter / union
                near = den * inter >= num * union
                home = int(d.argmin()) if d.min() <= FAR else -1
                far = min(d.min() + 2 * r, FAR + r) + 1e-9
                regions = np.flatnonzero(d <= far).tolist() + ([-1] if home < 0 else [])
                out.append((g, rid, sum(1 << int(k) for k in np.flatnonzero(near)), [ids[k] for k in np.flatnonzero(near) if ids[k] != rid], home, regions, float(d[0])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["grp", "rid", "mask", "linked", "home", "regions", "d"])

    return run


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one group's distinct masks: those of the largest part that the pivots' links join."""
    parts: list[list] = []
    for mask, n in zip(pdf["mask"].tolist(), pdf.n.tolist(), strict=True):
        if mask:
            same = [p for p in parts if p[0] & mask]
            parts = [p for p in parts if not p[0] & mask] + [[mask | sum_bits([p[0] for p in same]), n + sum(p[1] for p in same)]]
    most = max(parts, key=lambda p: p[1], default=[0, 0])[0]
    return pdf.assign(settled=[bool(m & most) for m in pdf["mask"]])[["grp", "mask", "settled"]]


def sum_bits(masks: list[int]) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def _cut(members: DataFrame, num: int, den: int, depth: int) -> list[DataFrame]:
    """Links of groups (grp, rid, central, s) too large for a task, by pivots, Voronoi regions and boundary windows."""
    size = members.groupBy("grp").agg(F.count("*").alias("size"))
    order = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("central"), "rid"))
    chosen = members.select("grp", "rid", "central").withColumn("k", order).where(F.col("k") <= PIVOTS)
    pivots = chosen.join(members.select("grp", "rid", "s"), ["grp", "rid"]).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("k", "rid", "s"))).alias("pivots"))
    seen = written(members.select("grp", "rid", "s").join(pivots, "grp").mapInArrow(_distances(num, den), "grp long, rid long, mask long, linked array<long>, home long, regions array<long>, d double"))
    out = [seen.select(F.col("rid").alias("a"), F.explode("linked").alias("b"))]
    settled = seen.groupBy("grp", "mask").agg(F.count("*").alias("n")).groupBy("grp").applyInPandas(_settled, "grp long, mask long, settled boolean")
    # two settled rows need not meet; a settled and an open one meet in the settled row's own region, since windows are
    # wide enough on either side: only open rows are replicated
    where = F.when(F.col("settled"), F.array("home")).otherwise(F.col("regions"))
    seen = written(seen.join(settled, ["grp", "mask"]).select("grp", "rid", "settled", "d", where.alias("regions")))
    alike = seen.groupBy("grp", "regions").agg(F.count("*").alias("n"), F.max(~F.col("settled")).alias("open"))
    cells = alike.select("grp", "n", "open", F.explode("regions").alias("region")).groupBy("grp", "region").agg(F.sum("n").alias("n"), F.max("open").alias("open"))
    cells = cells.where("open").join(size, "grp").withColumn("pairs", F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("grp")))
    kind = F.when(F.col("pairs") * WORTH > F.col("size") * F.col("size"), 3).when(F.col("n") <= REGION, 0).when(F.lit(depth < DEPTH), 1).otherwise(2)
    cells = written(cells.select("grp", "region", kind.alias("kind")))
    kinds = {r.kind for r in cells.select("kind").distinct().collect()}
    sets = members.select("rid", "central", "s").dropDuplicates(["rid"])
    stuck = []
    if 3 in kinds:  # regions share so many rows that they are no less work: the group is one cell, no row is replicated
        stuck.append(seen.join(cells.where("kind = 3").select("grp").distinct(), "grp").select("grp", "rid", "settled", "d"))
    if kinds & {0, 1, 2}:
        few = seen.join(cells.where("kind != 3").select("grp").distinct(), "grp", "left_semi")
        near = few.select("grp", "rid", "settled", "d", F.explode("regions").alias("region")).join(cells, ["grp", "region"])
        cell = F.xxhash64("grp", "region").alias("grp")
        if 0 in kinds:
            out.append(_join_exactly(near.where("kind = 0").select(cell, "rid").join(sets, "rid"), num, den))
        if 1 in kinds:
            out += _cut(written(near.where("kind = 1").select(cell, "rid").join(sets, "rid")), num, den, depth + 1)
        if 2 in kinds:
            stuck.append(near.where("kind = 2").select(cell, "rid", "settled", "d"))
    for rows in stuck:
        out.append(_join_exactly(_block_pairs(rows, 1 - num / den).join(sets, "rid"), num, den))
    return out


def _block_pairs(rows: DataFrame, r: float) -> DataFrame:
    """(grp, rid): each row once for every pair of blocks it is in. Blocks hold about BLOCK rows at one distance from a
    pivot; blocks more than r apart are not paired, nor two in which all rows are linked already."""
    rows = written(rows.withColumn("ring", F.floor(F.col("d") / (0.501 * r))))
    rings = rows.groupBy("grp", "settled", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = rows.join(rings, ["grp", "settled", "ring"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    other = rings.select("grp", F.col("settled").alias("settled2"), F.col("ring").alias("ring2"), F.col("blocks").alias("blocks2"))
    near = rows.join(other, "grp").where("abs(ring - ring2) <= 2 AND NOT (settled AND settled2)")
    near = near.withColumn("block2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks2") - 1)))
    one, two = F.concat_ws("/", "settled", "ring", "block"), F.concat_ws("/", "settled2", "ring2", "block2")
    return near.select(F.xxhash64("grp", F.least(one, two), F.greatest(one, two)).alias("grp"), "rid")


def components_of(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    The set of a text: its distinct ``words``-word shingles, A-Z lower-cased; fewer words are one shingle. Texts link
    when ``den * |A and B| >= num * |A or B|``; component_id is the least doc_id that links reach.

    * null or blank text: no shingles, linked with nothing, its own component
    * null doc_id: never the least of a component that has an id; a component without ids has null
    * a doc_id on several rows: each row has its own set, and all of them are one node
    * repeated texts are one node throughout; other columns are not read
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("rid"), "text")
    rows = written(docs.mapInArrow(_narrow(words), "doc_id long, rid long, n_shingles long, k1 long, k2 long"))
    entries = docs.select("text").mapInArrow(_entries(words, num, den, _heavy(docs, words)), "s long, k1 long, n int")
    shared = entries.repartition("s").sortWithinPartitions("s", "k1").mapInArrow(_whole_runs("s", ["s", "k1", "n"], _shared, _shared_long), "s long, k1 long, n int, l long")
    chosen = shared.repartition("k1").sortWithinPartitions("k1", "l", "s").mapInArrow(_whole_runs("k1", ["s", "k1", "n", "l"], _chosen(num, den)), CHOSEN)
    chosen = written(chosen)
    found = chosen.repartition("s").sortWithinPartitions("s", "k1").mapInArrow(_lists(num, den), "a long, b long, shared long, need long")
    found = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need")
    groups = components(found).select(F.col("node").alias("k1"), F.col("root").alias("grp"))
    central = chosen.groupBy("k1").agg(F.first("central").alias("central"))
    nodes = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    nodes = written(nodes.join(groups, "k1", "left"))
    size = nodes.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    large = (F.col("members") > REGION) | (F.col("shingles") > REGION_SHINGLES)
    close = nodes.join(size.where("members > 1").select("grp", large.alias("large")), "grp").join(central, "k1", "left").select("grp", "rid", "k1", "k2", F.coalesce("central", F.lit(0.0)).alias("central"), "large")
    sets = written(docs.select("rid", "text").join(close, "rid").mapInArrow(_member_sets(words), "grp long, rid long, central double, large boolean, s binary"))
    links = [_join_exactly(sets.where("NOT large"), num, den)]
    if sets.where("large").limit(1).count():
        links += _cut(sets.where("large").dropDuplicates(["grp", "rid"]), num, den, 0)
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    roots = components(every)
    nodes = nodes.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select("k1", "k2", F.coalesce("root", "rid").alias("root"), "least")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("k1", "k2", "component_id")
    out = rows.join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each component: its least doc_id. Texts without words all stay.

    Rows without doc_id are known by their text, so equal ones are one node; of several rows with one doc_id the one with
    the least text stays. Own columns may have any names: they ride along in one struct."""
    surrogate = F.coalesce("doc_id", -F.abs(F.shiftright(F.xxhash64("text"), 1)) - (1 << 62))
    keyed = docs.select(surrogate.alias("node"), "text", F.struct("*").alias("whole"))
    found = written(components_of(keyed.select(F.col("node").alias("doc_id"), "text"), words, num, den))
    kept = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("node")).agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    kept = written(kept.withColumn("one", (F.col("rows") == 1) | (F.col("n") == 0)))
    out = keyed.join(kept.where("one").select("node"), "node").select("whole.*")
    if kept.where("NOT one").limit(1).count():  # else the texts would travel once more for nothing
        several = keyed.join(kept.where("NOT one").select("node"), "node")
        several = several.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("text")))
        out = out.union(several.where("nth = 1").select("whole.*"))
    return out
