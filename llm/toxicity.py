"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of adjacent words and pairs with one word between, hashed into a fixed
number of coordinates. Words are runs of letters and digits, lower-cased; a word also counts as its stems, its first few
bytes, so that inflected forms share weights. Every coordinate has a step size of its own, and
the L1 term leaves few weights that are not 0, so that the model is small enough to broadcast at any size of the corpus.
The model is fitted in shards whose states are averaged after each round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import words as W
from llm.store import small_batches, written

BITS = 22  # of a coordinate: at most 2^22 weights, 16 MB, whatever the corpus
SAMPLE = 20_000  # labelled documents at most that the model is fitted on
SEEN = 20  # documents of the sample that a coordinate needs, in a small sample one in 500
STEMS = (4, 7)  # bytes
SHARDS, ROUNDS, PASSES = 4, 4, 1
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0


@dataclass
class Weights:
    at: np.ndarray  # coordinates, ascending
    w: np.ndarray
    bias: float


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _coordinates(part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, pair and skip pair of a slice."""
    h, row = part.hashes(lower=True), part.row
    with np.errstate(over="ignore"):
        rows, found = [row] * (1 + len(STEMS)), [h, *(W.mix(part.hashes(lower=True, first=k) + np.uint64(k)) for k in STEMS)]
        for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                rows.append(row[gap:][same])
                found.append(W.mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(batches):
    for batch in batches:
        for part in W.slices(batch.column("text"), between=W.NO_LETTER):
            row, at = _coordinates(part)
            key = np.unique(row << BITS | at)
            bounds = np.searchsorted(key >> BITS, np.arange(part.rows + 1))
            key = (key & ((1 << BITS) - 1)).astype(np.int32)
            out = [key[bounds[i] : bounds[i + 1]].tobytes() for i in range(part.rows)]
            some = batch.slice(part.first, part.rows)
            yield pa.RecordBatch.from_arrays([some.column("label"), some.column("place"), pa.array(out, pa.binary())], ["label", "place", "features"])


CHUNKS = 64


def _document_counts(batches):
    total = np.zeros(1 << BITS, np.uint16)
    for batch in batches:
        for f in batch.column("features"):
            at = np.frombuffer(f.as_py(), np.int32)
            total[at] = np.minimum(total[at], 65534) + 1
    for i, x in enumerate(np.split(total, CHUNKS)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["i", "counts"])


def _known(least: int):
    """Of one chunk of coordinates: those in ``least`` documents or more."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << BITS) // CHUNKS, np.int64)
        for x in pdf.counts:
            total += np.frombuffer(x, np.uint16)
        i = int(pdf.i.iloc[0])
        return pd.DataFrame({"i": [i], "known": [(np.flatnonzero(total >= least) + i * len(total)).astype(np.int32).tobytes()]})

    return add


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _packed(known):
    """One row for a shard of the sample: its labels, and its rows' places in the known coordinates behind each other."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        place = np.full(1 << BITS, -1, np.int32)
        place[known.value] = np.arange(len(known.value))
        pdf = pdf.sort_values("place")
        at = [place[np.frombuffer(f, np.int32)] for f in pdf.features]
        at = [np.append(x[x >= 0], len(known.value)).astype(np.int32) for x in at]
        return pd.DataFrame({"labels": [pdf.label.to_numpy(np.float64).tobytes()], "sizes": [np.array([len(x) for x in at], np.int64).tobytes()], "at": [np.concatenate(at).tobytes()]})

    return pack


def _fit_shards(state):
    """FTRL over each shard, from the averaged state (z, n) of the round before; the bias is behind the last coordinate."""

    def fit(frames):
        for pdf in frames:
            out = []
            for y, sizes, at in pdf[["labels", "sizes", "at"]].itertuples(index=False):
                z, n = (x.copy() for x in state.value)
                rows = np.split(np.frombuffer(at, np.int32), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
                for _ in range(PASSES):
                    for i, label in zip(rows, np.frombuffer(y), strict=True):
                        zi, ni = z[i], n[i]
                        w = _weights(zi, ni)
                        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
                        z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                        n[i] = ni + g * g
                out.append((z.tobytes(), n.tobytes()))
            yield pd.DataFrame(out, columns=["z", "n"])

    return fit


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from docs(doc_id, text) and labels(doc_id, label): of the labelled rows the first ``sample`` in hash order.

    Null labels and ids are left out; without rows of both labels every score is below one half.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    chosen = chosen.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` narrow rows
    rows = written(rows.select("label", "place", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_features, "label double, place long, features binary"))
    seen = {r.label for r in rows.select("label").distinct().collect()}
    if seen != {0.0, 1.0}:
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0)
    least = max(2, min(SEEN, rows.count() // 500))
    counted = rows.mapInArrow(_document_counts, "i long, counts binary").groupBy("i").applyInPandas(_known(least), "i long, known binary").collect()
    known = np.concatenate([np.frombuffer(r.known, np.int32) for r in sorted(counted, key=lambda r: r.i)]).astype(np.int64)
    places = docs.sparkSession.sparkContext.broadcast(known)
    shards = written(rows.groupBy(F.pmod("place", F.lit(SHARDS))).applyInPandas(_packed(places), "labels binary, sizes binary, at binary"))
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for _ in range(ROUNDS):
        state = docs.sparkSession.sparkContext.broadcast((z, n))
        # a few rows, each of at most 2^BITS numbers
        states = shards.mapInPandas(_fit_shards(state), "z binary, n binary").collect()
        z, n = (np.mean([np.frombuffer(r[c]) for r in states], axis=0) for c in ("z", "n"))
        state.destroy()
    w = _weights(z, n)
    at = np.flatnonzero(w[:-1])
    return Weights(known[at], w[at].astype(np.float32), float(w[-1]))


def _scores(rows: DataFrame, weights: Weights, keep_text: bool) -> DataFrame:
    """rows(whole, text) with score; whole is any struct."""
    model = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = np.zeros(1 << BITS, np.float32)
        w[model.value.at] = model.value.w
        for batch in batches:
            for part in W.slices(batch.column("text"), between=W.NO_LETTER):
                row, at = _coordinates(part)
                found = w[at] != 0
                key = np.unique(row[found] << BITS | at[found])
                total = np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)], part.rows) + model.value.bias
                some = batch.slice(part.first, part.rows)
                score = pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))
                yield pa.RecordBatch.from_arrays([some.column("whole"), *([some.column("text")] if keep_text else []), score], ["whole", *(["text"] if keep_text else []), "score"])

    kind = f"whole {rows.schema['whole'].dataType.simpleString()}, " + "text string, " * keep_text + "score double"
    return rows.mapInArrow(run, kind)


def scored(docs: DataFrame, weights: Weights) -> DataFrame:
    """docs(text, ...) with score (0 to 1): a null or empty text has the score of the bias alone. Columns of any name are
    kept, but a column score is replaced."""
    docs = docs.drop("score")
    others = [c for c in docs.columns if c != "text"]
    whole = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    out = _scores(docs.select(whole.alias("whole"), "text"), weights, True)
    return out.select(*[F.col("text") if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns], "score")


def toxic_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = labels.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    weights = fit(docs, rows)
    whole = F.struct("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    out = _scores(docs.select(whole.alias("whole"), "text"), weights, False).select("whole.*", "score")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
