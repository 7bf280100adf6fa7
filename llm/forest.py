"""MinHash near-duplicates by an LSH forest.

Each distinct shingle set has one signature of ``TREES * DEPTH`` minimum hashes. A tree is the signature read from a place
of its own on, cyclically; all trees are one table sorted by (tree, signature), range-partitioned, so that a dense part of
a tree spreads over tasks. Neighbours by longest common prefix are candidates, and the depth adapts to each region: a
region is the stretch that shares ``START`` values, or as many more as it takes to leave ``REGION`` rows. Rows at the ends
of a task are compared with those of the next task once more. Within a region, rows whose signatures agree as often as sets
at the threshold do (less five standard deviations) are tied together.

Ties only tell where to look: the sets of each tied group are confirmed in full. A group of bounded size is one matrix of
intersections. A larger one is compared with some of its members first; what these join needs no further pairs, and what
they leave is compared with all of the group in blocks, so no link of a group is left out.

Two sets at a similarity of 0.85 share a region of depth d in one tree with probability 0.85 ** d, and miss each other in
all trees with (1 - 0.85 ** d) ** TREES: 1e-9 at depth 2, 3e-7 at depth 3, 1e-4 at 5. Deeper regions are those of many
similar sets, where a set is tied to its group through any of its near relations there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm import words as W
from llm.jaccard import overlaps
from llm.stars import components
from llm.store import small_batches, written

TREES, DEPTH, START = 16, 5, 2
REGION = 512  # rows of a region that are all compared; a larger one goes deeper
ENDS = 256  # rows at each end of a task that are compared again with the next task's
GROUP, SHINGLES = 512, 1 << 20  # documents and shingles of a matrix of intersections
PROBES, ROUNDS = 16, 2  # members that a large group is compared with first, and how often
VALUES = TREES * DEPTH
_RANDOM = np.random.RandomState(20260302)
_FLIP = _RANDOM.randint(1, 1 << 62, VALUES, dtype=np.int64).astype(np.uint64)
_TIMES = _RANDOM.randint(1, 1 << 62, VALUES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
WALKED = "a long, b long, cut long, tree int, key binary, n int"


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles: two sums of two different bijections."""
    with np.errstate(over="ignore"):
        a, b = W.mix(s ^ np.uint64(0x3C79AC492BA7B653)).sum(), W.mix(s + np.uint64(0x1C69B3F74AC4AE35)).sum()
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each minimum hash: a row for each set, none of them empty."""
    joined = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), VALUES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(VALUES):
            out[:, k] = (W.mix(np.minimum.reduceat((joined ^ _FLIP[k]) * _TIMES[k], begin)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _signed(n: int):
    """Size, key and signature of each row's set; a task signs each set once."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in W.slices(batch.column("text")):
                sets = list(W.shingle_sets(part, part.hashes(lower=True), n))
                keys = [set_key(s) if len(s) else (None, None) for s in sets]
                new = []
                for i, k in enumerate(keys):
                    if len(sets[i]) and k not in seen:
                        seen.add(k)
                        new.append(i)
                signed = [None] * len(sets)
                if new:
                    for i, row in zip(new, signatures([sets[i] for i in new]), strict=True):
                        signed[i] = row.tobytes()
                if len(seen) > 1_000_000:  # only signs some sets twice
                    seen.clear()
                rows = batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(signed, pa.binary())],
                    ["doc_id", "rid", "n_shingles", "k1", "k2", "signature"],
                )

    return run


def tree_keys(signature: np.ndarray, tree: int) -> np.ndarray:
    """Bytes by which a tree is sorted: DEPTH values in full from its own place on, one byte of each other value."""
    turned = np.roll(signature, -tree * DEPTH, axis=1)
    full = turned[:, :DEPTH].astype(">u2").view(np.uint8).reshape(len(signature), 2 * DEPTH)
    return np.concatenate([full, (turned[:, DEPTH:] & 0xFF).astype(np.uint8)], axis=1)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
        for t in range(TREES):
            keys = tree_keys(signature, t)
            width = keys.shape[1]
            offsets = pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * np.int32(width))
            key = pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(np.ascontiguousarray(keys))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), key, batch.column("node"), batch.column("n")], ["tree", "key", "node", "n"])


def prefixes(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values that each row shares with the next one, as a prefix."""
    same = keys[1:] == keys[:-1]
    values = np.concatenate([same[:, 0 : 2 * DEPTH : 2] & same[:, 1 : 2 * DEPTH : 2], same[:, 2 * DEPTH :]], axis=1)
    common = np.where(values.all(axis=1), values.shape[1], values.argmin(axis=1))
    return np.where(tree[1:] == tree[:-1], common, 0)


def regions(common: np.ndarray, rows: int, limit: int, start: int = START) -> tuple[list[tuple[int, int]], np.ndarray]:
    """[begin, end) of each region of two rows or more, and the rows at which a larger one was cut."""
    out: list[tuple[int, int]] = []
    cuts: list[np.ndarray] = []
    todo, depth = [(0, rows)], start
    while todo:
        deeper = []
        for i, j in todo:
            ends = i + 1 + np.flatnonzero(common[i : j - 1] < depth)
            edges = np.concatenate([[i], ends, [j]])
            size = np.diff(edges)
            if depth > start:
                cuts.append(ends)
            some = np.flatnonzero((size > 1) & (size <= limit))
            out.extend(zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True))
            deeper.extend((int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(size > limit))
        depth += 1
        if depth > VALUES:  # equal signatures throughout: overlapping stretches
            for i, j in deeper:
                out.extend((k, min(k + limit, j)) for k in range(i, j - 1, max(1, limit // 2)))
            deeper = []
        todo = deeper
    return out, np.concatenate(cuts) if cuts else np.zeros(0, np.int64)


def ties(keys: np.ndarray, n: np.ndarray, some: list[tuple[int, int]], cuts: np.ndarray, least: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that hold each region's similar rows together: at most seven to a row, mostly one."""
    sketch = np.concatenate([keys[:, 1 : 2 * DEPTH : 2], keys[:, 2 * DEPTH :]], axis=1)

    def alike(i, j):
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        return (low * den >= high * num) & ((sketch[i] == sketch[j]).sum(axis=1) >= least)

    left, right = [], []
    small = [(i, j) for i, j in some if j - i <= 8]
    begin, end = np.array([i for i, _ in small], np.int64), np.array([j for _, j in small], np.int64)
    pairs = [(cuts - 1, cuts)] if len(cuts) else []
    for d in range(1, 8):
        for k in range(8 - d):
            ok = begin + k + d < end
            if ok.any():
                pairs.append((begin[ok] + k, begin[ok] + k + d))
    for i, j in pairs:
        for at in range(0, len(i), 20_000):
            ok = alike(i[at : at + 20_000], j[at : at + 20_000])
            left.append(i[at : at + 20_000][ok])
            right.append(j[at : at + 20_000][ok])
    for i, j in some:
        if j - i <= 8:
            continue
        rest = np.arange(i, j)
        while len(rest) > 1:  # a tree of ties over each similar part of the region
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                ok = alike(np.full(len(rest), x), rest)
                new, rest = rest[ok], rest[~ok]
                left.append(np.full(len(new), x))
                right.append(new)
                front.extend(new.tolist())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def agreement(num: int, den: int) -> int:
    """Values of a signature in which two sets at the threshold agree, less five standard deviations."""
    t = num / den
    return int(np.floor(VALUES * (t - 5 * np.sqrt(t * (1 - t) / VALUES))))


def _walked(num: int, den: int, ends: int, limit: int):
    """Ties of rows sorted by (tree, key); with ends, the rows at the ends of the task too, by the cut they lie at."""
    least = agreement(num, den)

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        rows, first, last = 0, None, None

        def work(table: pa.Table, final: bool) -> tuple[pa.RecordBatch, pa.Table]:
            tree = table.column("tree").to_numpy()
            keys = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(len(tree), -1)
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            common = prefixes(tree, keys)
            some, cuts = regions(common, len(tree), limit)
            i, j = ties(keys, n, some, cuts, least, num, den)
            keep = len(tree)
            if not final:  # the last region may go on; of a very long one, the last rows do
                open_ = np.flatnonzero(common < START)
                keep = max(int(open_[-1]) + 1 if len(open_) else 0, len(tree) - limit)
            return _walk_row(np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), table.slice(keep)

        for batch in batches:
            if not batch.num_rows:
                continue
            if ends:
                first = batch.slice(0, ends) if first is None else first
                last = pa.Table.from_batches([*([] if last is None else last.to_batches()), batch.slice(max(0, batch.num_rows - ends))])
                last = last.slice(max(0, last.num_rows - ends))
            held.append(batch)
            rows += batch.num_rows
            if rows >= 60_000:
                out, rest = work(pa.Table.from_batches(held).combine_chunks(), False)
                yield out
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield work(pa.Table.from_batches(held).combine_chunks(), True)[0]
        if ends and first is not None:
            for cut, some in ((part - 1, first), (part, last)):
                null = pa.nulls(some.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [_flat(some.column("node")), null, pa.array(np.full(some.num_rows, cut, np.int64)), _flat(some.column("tree")), _flat(some.column("key")), _flat(some.column("n"))], ["a", "b", "cut", "tree", "key", "n"]
                )

    return run


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _walk_row(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32())], ["a", "b", "cut", "tree", "key", "n"])


def tied(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate edges (a, b) of nodes(node, n, signature)."""
    entries = nodes.select("node", "n", "signature").mapInArrow(_trees, "tree int, key binary, node long, n int")
    sorted_ = entries.repartitionByRange("tree", "key").sortWithinPartitions("tree", "key")
    walked = written(sorted_.mapInArrow(_walked(num, den, ENDS, REGION), WALKED))
    ends = walked.where("cut IS NOT NULL").select((F.col("cut") * TREES + F.col("tree")).cast("int").alias("tree"), "key", F.col("a").alias("node"), "n", "cut")
    ends = ends.repartition("cut").sortWithinPartitions("tree", "key").select("tree", "key", "node", "n")
    again = ends.mapInArrow(_walked(num, den, 0, REGION), WALKED)
    return walked.where("cut IS NULL").union(again).where("a != b").select("a", "b")


def _sets(n: int):
    """The set of each row whose text has the keys that the row names; a task gives each node once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            k1, k2, node = (batch.column(c).to_numpy() for c in ("k1", "k2", "node"))
            keep, sets = [], []
            for part in W.slices(batch.column("text")):
                for i, s in enumerate(W.shingle_sets(part, part.hashes(lower=True), n), part.first):
                    if len(s) and node[i] not in seen and set_key(s) == (k1[i], k2[i]):
                        seen.add(node[i])
                        keep.append(i)
                        sets.append(s.tobytes())
            if len(seen) > 1_000_000:  # a node that comes again is passed over where it is compared
                seen.clear()
            some = batch.select(["grp", "node", "large"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sets, pa.binary())], ["grp", "node", "large", "s"])

    return run


def _confirmed(num: int, den: int):
    """Links that span the components of each group of rows sorted by (grp, node)."""

    def links(nodes, sets):
        if len(sets) < 2:
            return
        sets = [np.frombuffer(s, np.uint64) for s in sets]
        size = np.array([len(s) for s in sets])
        inter = overlaps(sets)
        seen = np.zeros(len(sets), bool)
        for i in range(len(sets)):
            front = [] if seen[i] else [i]
            seen[i] = True
            while front:
                x = front.pop()
                new = np.flatnonzero(((num + den) * inter[x].astype(np.int64) >= num * (size[x] + size)) & ~seen)
                seen[new] = True
                front.extend(new.tolist())
                for y in new:
                    yield nodes[x], nodes[y]

    def run(batches):
        group, nodes, sets = None, [], []
        for batch in batches:
            out = []
            for g, r, s in zip(batch.column("grp").to_pylist(), batch.column("node").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if g != group:
                    out += links(nodes, sets)
                    group, nodes, sets = g, [], []
                if not nodes or nodes[-1] != r:
                    nodes.append(r)
                    sets.append(s)
            yield _pair_row(out)
        yield _pair_row(list(links(nodes, sets)))

    return run


def _pair_row(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])


def _join(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside each bounded group of (grp, node, s)."""
    return groups.select("grp", "node", "s").repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(_confirmed(num, den), "a long, b long")


def _probed(num: int, den: int):
    """Which probes of its group each row is linked to, as links and as bits; a probe is linked to itself."""

    def run(batches):
        group, probes = None, None
        for batch in batches:
            masks, linked = [], []
            for g, node, s, p in zip(*(batch.column(c).to_pylist() for c in ("grp", "node", "s", "probes")), strict=True):
                if g != group:
                    group, probes = g, [(x["node"], np.frombuffer(x["s"], np.uint64)) for x in p]
                x = np.frombuffer(s, np.uint64)
                near = []
                for k, (other, y) in enumerate(probes):
                    if other == node or min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
                        both = len(x) if other == node else len(np.intersect1d(x, y, assume_unique=True))
                        if other == node or (num + den) * both >= num * (len(x) + len(y)):
                            near.append(k)
                masks.append(sum(1 << k for k in near))
                linked.append([probes[k][0] for k in near if probes[k][0] != node])
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("node"), batch.column("open"), pa.array(masks, pa.int64()), pa.array(linked, pa.list_(pa.int64()))], ["grp", "node", "open", "mask", "linked"])

    return run


def _main_part(reach: list[int], rows: list[int]) -> int:
    """Bits of the part of a group that is settled: of bits that rows tie together, those with the settled ones (the last
    bit), or else with the probe that most rows are linked to."""
    seed = len(reach) - 1 if rows[-1] else int(np.argmax(rows))
    main, before = 1 << seed, 0
    while main != before:
        before = main
        for k, bits in enumerate(reach):
            if main >> k & 1:
                main |= bits
    return main


def _mains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mains = [_main_part([x or 0 for x in reach], rows) for reach, rows in zip(batch.column("reach").to_pylist(), batch.column("rows").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(mains, pa.int64())], ["grp", "main"])


def _large(sets: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Links of groups (grp, node, s) too large for one matrix.

    Rounds of probes join most of a near-copy group: what rows tie together among its probes is settled. Then only the
    other rows are open: they are compared with all of the group, in pairs of blocks."""
    size = sets.groupBy("grp").agg(F.count("*").alias("m"), F.sum(F.length("s") / 8).alias("shingles"))
    size = written(size.select("grp", F.ceil(F.greatest(F.col("m") / GROUP, F.col("shingles") / SHINGLES)).cast("long").alias("salts")))
    sets = written(sets.join(size, "grp").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))))
    out: list[DataFrame] = []
    state, some = None, sets.select("grp", "salt", "node", "s", F.lit(True).alias("open"))
    for turn in range(ROUNDS):
        lot = F.xxhash64("node", F.lit(turn))
        chosen = some.where("open").groupBy("grp", "salt", F.pmod(F.xxhash64("node", F.lit(-1 - turn)), F.lit(PROBES)).alias("k")).agg(F.min_by(F.struct("node", "s"), lot).alias("x"))
        rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64(F.col("x.node"), F.lit(turn))))
        probes = chosen.select("grp", "x").withColumn("r", rank).where(F.col("r") <= PROBES).groupBy("grp").agg(F.collect_list("x").alias("probes"))
        spread = probes.join(size, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
        seen = written(some.join(spread, ["grp", "salt"]).select("grp", "node", "open", "s", "probes").mapInArrow(_probed(num, den), "grp long, node long, open boolean, mask long, linked array<long>"))
        out.append(seen.select(F.col("node").alias("a"), F.explode("linked").alias("b")))
        bits = F.col("mask") + F.when(F.col("open"), 0).otherwise(1 << PROBES)
        has = [bits.bitwiseAND(F.lit(1 << k)) != 0 for k in range(PROBES + 1)]
        reach = seen.groupBy("grp").agg(F.array(*[F.bit_or(F.when(h, bits)) for h in has]).alias("reach"), F.array(*[F.count_if(h) for h in has]).alias("rows"))
        mains = reach.mapInArrow(_mains, "grp long, main long")
        now = seen.join(mains, "grp").select("grp", "node", (bits.bitwiseAND(F.col("main")) == 0).alias("open"))
        # a group without open rows has had no probes in this round and is not in ``seen``
        state = written(now if state is None else now.union(state.join(mains.select("grp"), "grp", "left_anti")))
        if not state.where("open").limit(1).count():
            return out
        some = sets.join(state, ["grp", "node"])
    count = state.groupBy("grp").agg(F.count_if("open").alias("o"))
    parts = written(size.join(count, "grp").where("o > 0").select("grp", F.greatest(F.lit(1), F.least(F.col("salts"), F.ceil(F.col("o") * 2 / GROUP))).cast("long").alias("bo"), F.greatest(F.lit(1), F.col("salts") * 2).cast("long").alias("bm")))
    rows = sets.join(state, ["grp", "node"]).join(parts, "grp")
    block = F.pmod(F.xxhash64("node", F.lit(99)), F.when(F.col("open"), F.col("bo")).otherwise(F.col("bm")))
    to = F.lit(0).cast("long")
    other = F.sequence(to, F.col("bo") - 1)
    # an open block meets every open block and every settled one; two settled blocks need not meet
    o_pairs = F.concat(
        F.transform(other, lambda k: F.concat_ws("/", F.lit("o"), F.least(k, F.col("block")), F.greatest(k, F.col("block")))),
        F.transform(F.sequence(to, F.col("bm") - 1), lambda k: F.concat_ws("/", F.lit("m"), F.col("block"), k)),
    )
    m_pairs = F.transform(other, lambda k: F.concat_ws("/", F.lit("m"), k, F.col("block")))
    rows = rows.withColumn("block", block).withColumn("meets", F.explode(F.when(F.col("open"), o_pairs).otherwise(m_pairs)))
    out.append(_join(rows.select(F.xxhash64("grp", "meets").alias("grp"), "node", "s"), num, den))
    return out


def near_copies(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    The set of a text: its distinct ``words``-word shingles, A-Z lower-cased; fewer words are one shingle. Texts link when
    ``den * |A and B| >= num * |A or B|``; component_id is the least doc_id that links reach, kept whether it is doc_id.

    * null or blank text: no shingles, linked with nothing, its own component and kept
    * null doc_id: never the least of a component that has an id; a component without ids has null, and kept is then true
      for all of its rows
    * a doc_id on several rows: each row has its own set, and all of them are one node
    * repeated texts are one node throughout; other columns are not read
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"), "text")
    rows = written(docs.mapInArrow(_signed(words), "doc_id long, rid long, n_shingles long, k1 long, k2 long, signature binary"))
    nodes = rows.where("signature IS NOT NULL").groupBy("k1", "k2", F.col("n_shingles").cast("int").alias("n"), "signature").agg(F.min("rid").alias("rid"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    named = written(rows.select("doc_id", "n_shingles", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").select("doc_id", "n_shingles", "node"))
    groups = components(tied(nodes, num, den)).select("node", F.col("root").alias("grp"))
    members = nodes.select("node", "k1", "k2", "n", "rid").join(groups, "node")
    size = members.groupBy("grp").agg(((F.count("*") > GROUP) | (F.sum("n") > SHINGLES)).alias("large"))
    wanted = members.join(size, "grp").select("rid", "grp", "node", "k1", "k2", "large")
    sets = written(docs.select("rid", "text").join(wanted, "rid").mapInArrow(_sets(words), "grp long, node long, large boolean, s binary"))
    links = [_join(sets.where("NOT large"), num, den)]
    if sets.where("large").limit(1).count():
        links += _large(sets.where("large").dropDuplicates(["grp", "node"]), num, den)
    several = named.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi").select("doc_id", "b")
    every = named.join(several, "doc_id").select(F.col("node").alias("a"), "b")
    for x in links:
        every = every.union(x)
    roots = components(every)
    part = named.where("node IS NOT NULL").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = part.groupBy("node", "root").agg(F.min("doc_id").alias("least"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = least.join(whole, "root").select("node", "component_id")
    out = named.join(answer, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
