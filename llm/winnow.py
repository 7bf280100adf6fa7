"""Document fingerprints by winnowing.

The hash of every k consecutive code points is rolled over the text. In each window of w hashes the least one is a mark,
the rightmost on ties, and a mark is kept once with its place. Two texts that share k + w - 1 consecutive code points
share a mark; no match shorter than k counts. A text with fewer than k code points is one gram, an empty text has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.words import mix, powers

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def gram_hashes(text: str, k: int) -> np.ndarray:
    """Hash of each k consecutive code points, from one running sum of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points) * powers(_BASE, n), out=total[1:])
        return mix((total[k:] - total[: n + 1 - k]) * powers(_INVERSE, n + 2 - k)[: n + 1 - k])


def marks(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the marks of a text, by place. Fewer than w hashes are one window."""
    h = gram_hashes(text, k)
    n = len(h)
    if n == 0:
        return h, np.zeros(0, np.int64)
    w = min(w, n)
    # least of each window with its place, from windows of 1, 2, 4, ... hashes; on ties the right half wins
    least, place, width = h, np.arange(n, dtype=np.int32), 1
    while width < w:
        step = min(width, w - width)
        right = least[step:] <= least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    keep = np.ones(len(place), bool)
    keep[1:] = place[1:] != place[:-1]
    place = place[keep]
    return h[place], place.astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets of mark hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _digest(h: np.ndarray, place: np.ndarray) -> str:
    return hashlib.blake2b(h.tobytes() + b"|" + place.tobytes(), digest_size=16).hexdigest()


def fingerprints(docs: DataFrame, k: int = 24, w: int = 24) -> DataFrame:
    """docs(doc_id, text) with ``marks``, an array of (hash, place). Null text: empty; every row has its own fingerprint,
    whatever repeats; other columns are kept unless called marks."""
    docs = docs.drop("marks")

    def run(batches):
        for batch in batches:
            found = [marks(t or "", k, w) for t in batch.column("text").to_pylist()]
            rows = [[{"hash": int(x), "place": int(p)} for x, p in zip(h.view(np.int64), at, strict=True)] for h, at in found]
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(rows, pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int64())])))], ["whole", "marks"])

    whole = docs.select(F.struct("*").alias("whole"), "text")
    kind = f"whole {whole.schema['whole'].dataType.simpleString()}, marks array<struct<hash: bigint, place: bigint>>"
    return whole.mapInArrow(run, kind).select("whole.*", "marks")


def _neighbours(docs: DataFrame, per_part: int) -> DataFrame:
    """docs(doc_id, text) in parts of about per_part rows by ascending doc_id, each row also in the part before if it is
    the first of its part, so that a part holds the next row of each of its own.

    The bounds are quantiles of doc_id, one for each part; a repeated doc_id stays in one part, where rows are read one
    after another. Null ids come first."""
    n = docs.count()
    cuts = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / max(1, n // per_part) for i in range(1, n // per_part)], 0.1 / max(1, n // per_part)) if n >= 2 * per_part else []
    cuts = sorted({int(c) for c in cuts})
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    def part_of(batches):
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(bounds.value, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int64)), *batch.columns[1:]], ["doc_id", "part", *batch.schema.names[1:]])

    ids = docs.select("doc_id").mapInArrow(part_of, "doc_id long, part long")
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("least"))
    # parts without rows are passed over
    firsts = firsts.withColumn("before", F.lag("part").over(Window.orderBy("part")))
    table = {r["part"]: (r["least"], r["before"]) for r in firsts.select("part", "least", "before").collect()}
    ghosts = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            at = np.searchsorted(bounds.value, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right").tolist()
            row, part, ghost = [], [], []
            for i, (d, p) in enumerate(zip(ids.to_pylist(), at, strict=True)):
                row.append(i)
                part.append(p)
                ghost.append(False)
                least, before = ghosts.value[p]
                if before is not None and d == least:
                    row.append(i)
                    part.append(before)
                    ghost.append(True)
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(ghost), *taken.columns], ["part", "ghost", *taken.schema.names])

    return docs.select("doc_id", "text").mapInArrow(place, "part long, ghost boolean, doc_id long, text string")


def edited(docs: DataFrame, k: int = 24, w: int = 24, per_part: int = 4000) -> DataFrame:
    """Fingerprints of docs(doc_id, text), of their edited texts, and the likeness of each to its edited text and to the
    next document by ascending doc_id; after the last comes the first.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document.
    Null text: empty, n_chars 0. Null doc_id: before all others. Rows with one doc_id follow each other by text. An empty
    table has no rows; a single row is its own next. The text is shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in docs.orderBy(F.asc_nulls_first("doc_id"), "text").limit(1).collect()])
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks long, n_edited_marks long"
    names = [x.split(" ")[0] for x in kind.split(", ")]

    def known(text):
        h, at = marks(text, k, w)
        return text, np.unique(h), _digest(h, at), len(at)

    def pair(doc_id, now, after):
        text, own, digest, n = now
        m = len(text) // 4
        changed = text[: len(text) - m] + after[0][:m]
        h, at = marks(changed, k, w)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest, _digest(h, at), likeness(own, np.unique(h)), likeness(own, after[1]), n, len(at)

    def run(batches):
        part, held = None, None  # held: (doc_id, what is known of its text) of the last row, which waits for its next
        last = None
        for batch in batches:
            out = []
            for p, ghost, d, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")), strict=True):
                if p != part and held is not None:
                    last, held = held, None
                    out.append(pair(last[0], last[1], known(first.value[0][1])))
                part = p
                if ghost and held is None:
                    continue
                now = known(text)
                if held is not None:
                    out.append(pair(held[0], held[1], now))
                held = None if ghost else (d, now)
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names)
        if held is not None:
            columns = [[x] for x in pair(held[0], held[1], known(first.value[0][1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names)

    rows = _neighbours(docs, per_part).repartition("part").sortWithinPartitions("part", "ghost", F.asc_nulls_first("doc_id"), "text")
    return rows.mapInArrow(run, kind)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
