"""Document quality by Bradley-Terry pairwise ranking.

A labelled document of quality 1 is preferred to one of quality 0. Its chance to win is the logistic function of the
difference of two scores, which are linear in the documents' features: so a logistic regression without intercept on
differences of features learns the scores. The cut between good and bad is a quantile of the scores of the labelled
documents: the share of those with label 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import signals as S
from llm import words as W
from llm.store import written
from llm.toxicity import remainder

RANGE = 20_000  # labelled documents, in the mean, of a range of hashes that is numbered by itself
BINS, FEW = 1 << 12, 10_000  # of a round of a search for an order statistic; scores that are looked at themselves
PARTNERS = 8  # preference pairs for each document of the rarer label
STEEP = 2.0  # scores of the labelled documents, in deviations, for which the chance moves from 1/2 to 0.88

_CLASSES = [S.SYMBOL, S.flags(range(65, 91)), S.flags(range(48, 58)), S.flags(range(128, 256)), S.flags(b"."), S.flags(b","), S.flags(b"!"), S.flags(b"?"), S.flags(b"|"), S.flags(b"\n"), S.flags(b"{}()[]\\/=_@:;~^+-\"'`")]


def features(part: W.Slice) -> np.ndarray:
    """A row of features for each text: shares of kinds of bytes, words and lines, and the square roots of them."""
    base = S.base(part)
    n, size = np.maximum(base["n_words"], 1), np.maximum(np.diff(part.offsets), 1)
    length = part.end - part.start
    per = lambda mask: np.bincount(part.row[mask], minlength=part.rows) / n
    h = part.hashes()
    first = S.repeats(part.row, h)[0] == 0 if len(h) else np.zeros(0, bool)
    shares = [S.per_row(part, c) / size for c in _CLASSES]
    shares += [base["n_dup_lines"] / n, base["n_repeat_words"] / n, per(first), per(length <= 3), per(length >= 12), per(length >= 25), per(length == 1)]
    last = part.data[part.end - 1] if len(part.end) else np.zeros(0, np.uint8)
    shares += [per(S.SYMBOL[last]), per(S.flags(b"!?")[last]), per(S.flags(b".")[last])]
    x = np.stack(shares, 1)
    more = np.stack([np.log1p(base["n_words"]), base["word_chars"] / n, np.minimum(1, base["n_words"] / 50)], 1)
    return np.concatenate((x, np.sqrt(x), more), 1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    spread: float


def _rows(batches):
    for batch in batches:
        for part in W.slices(batch.column("text")):
            some = batch.slice(part.first, part.rows)
            yield pa.RecordBatch.from_arrays([some.column("whole"), pa.array(list(features(part)), pa.list_(pa.float64()))], ["whole", "x"])


def measured(rows: DataFrame) -> DataFrame:
    """rows(whole, text) as a written table of whole and x, the features."""
    return written(rows.select("whole", "text").mapInArrow(_rows, f"whole {rows.schema['whole'].dataType.simpleString()}, x array<double>"))


def order_statistic(scores: DataFrame, k: int) -> float:
    """The value with ``k`` smaller or equal ones before it in column s: counts by equal bins, then again inside one bin,
    until few are left."""
    while True:
        low, high, n = scores.agg(F.min("s"), F.max("s"), F.count("s")).first()
        if low == high:
            return low
        if n <= FEW:
            return sorted(r.s for r in scores.select("s").collect())[k]
        at = F.floor((F.col("s") - low) / (high - low) * BINS)
        counts = scores.groupBy(at.alias("bin")).count().orderBy("bin").collect()  # at most ``BINS`` + 1 rows
        for r in counts:
            if k < r["count"]:
                scores = scores.where(at == r["bin"])
                break
            k -= r["count"]


def quantile(scores: DataFrame, share: float) -> float:
    """The exact quantile of column s with linear interpolation."""
    place = share * (scores.count() - 1)
    low, high = (order_statistic(scores, k) for k in (math.floor(place), math.ceil(place)))
    return low + (place - math.floor(place)) * (high - low)


def numbered(rows: DataFrame, n: int) -> DataFrame:
    """rows(label, place, ...), ``n`` in all, with nth: from 0 for each label in order of place. Ranges of places are
    numbered each by itself; their counts, a few thousand rows, give the offsets."""
    bits = max(1, math.ceil(math.log2(max(1, n / RANGE))))
    rows = rows.withColumn("range", F.shiftright("place", 64 - bits))
    before = F.sum("count").over(Window.partitionBy("label").orderBy("range")) - F.col("count")
    offsets = rows.groupBy("label", "range").count().select("label", "range", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("label", "range").orderBy("place")) - 1
    out = rows.withColumn("inside", inside).join(F.broadcast(offsets), ["label", "range"])
    return out.withColumn("nth", F.col("inside") + F.col("before")).drop("range", "inside", "before")


def fit(docs: DataFrame, labels: DataFrame) -> Ranking | None:
    """Scores from docs(doc_id, text) and labels(doc_id, label), all labelled rows. None if one of the labels is missing;
    null labels and ids are left out."""
    return _fit(measured(docs.select(F.struct("doc_id").alias("whole"), "text")), labels)


def _fit(table: DataFrame, labels: DataFrame) -> Ranking | None:
    """The same from the written features of documents, whole.doc_id and x."""
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    rows = table.select("whole.doc_id", "x").join(chosen, "doc_id")
    rows = written(rows.select("label", F.xxhash64("doc_id").alias("place"), "x"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    width = len(rows.first().x)
    stats = rows.agg(*[f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(stats[0::2]), np.maximum(np.array(stats[1::2]), 1e-9)
    scaled = F.transform("x", lambda v, i: (v - F.element_at(F.array(*map(F.lit, mean.tolist())), i + 1)) / F.element_at(F.array(*map(F.lit, scale.tolist())), i + 1))
    rows = rows.withColumn("x", scaled)
    ranked = numbered(rows, n[0] + n[1])
    few, many = sorted((0, 1), key=lambda k: n[k])
    k = F.explode(F.sequence(F.lit(0), F.lit(PARTNERS - 1)))
    left = ranked.where(F.col("label") == few).select("x", "nth", k.alias("k")).withColumn("other", F.pmod(F.col("nth") * PARTNERS + F.col("k"), F.lit(n[many])))
    right = ranked.where(F.col("label") == many).select(F.col("x").alias("y"), F.col("nth").alias("other"))
    better, worse = ("x", "y") if few == 1 else ("y", "x")
    pairs = left.join(right, "other").select(F.zip_with(better, worse, lambda a, b: a - b).alias("d"), F.pmod(F.col("nth") + F.col("k"), F.lit(2)).alias("side"))
    # every other pair the other way round, so that both outcomes occur
    pairs = pairs.select(array_to_vector(F.when(F.col("side") == 0, F.col("d")).otherwise(F.transform("d", lambda v: -v))).alias("features"), F.when(F.col("side") == 0, 1.0).otherwise(0.0).alias("label"))
    w = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60).fit(written(pairs)).coefficients.toArray()
    score = sum(F.element_at("x", i + 1) * float(v) for i, v in enumerate(w))
    scores = written(rows.select(score.alias("s")))
    cut, spread = quantile(scores, n[0] / (n[0] + n[1])), scores.agg(F.stddev_pop("s")).first()[0]
    return Ranking(mean, scale, w, cut, max(spread, 1e-9))


def _chances(x: np.ndarray, r: Ranking | None) -> np.ndarray:
    if r is None:
        return np.full(len(x), 0.5)
    s = (((x - r.mean) / r.scale) @ r.w - r.cut) / r.spread * STEEP
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _scores(rows: DataFrame, ranking: Ranking | None) -> DataFrame:
    """rows(whole, text) with score; whole is any struct."""
    model = rows.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch.column("text")):
                some = batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays([some.column("whole"), some.column("text"), pa.array(_chances(features(part), model.value))], ["whole", "text", "score"])

    kind = f"whole {rows.schema['whole'].dataType.simpleString()}, text string, score double"
    return rows.mapInArrow(run, kind)


def scored(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """docs(text, ...) with score: the chance, 0 to 1, that a document beats one at the cut. Null and empty texts have the
    features of an empty text. Without a ranking every score is one half. Columns of any name are kept, but a column score
    is replaced."""
    docs = docs.drop("score")
    others = [c for c in docs.columns if c != "text"]
    whole = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    out = _scores(docs.select(whole.alias("whole"), "text"), ranking)
    return out.select(*[F.col("text") if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns], "score")


def _scores_of_table(table: DataFrame, ranking: Ranking | None) -> DataFrame:
    """whole and score from whole and x."""
    model = table.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(_chances(x, model.value if batch.num_rows else None))], ["whole", "score"])

    return table.mapInArrow(run, f"whole {table.schema['whole'].dataType.simpleString()}, score double")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = labels.where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))
    whole = F.struct("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    table = measured(docs.select(whole.alias("whole"), "text"))  # the texts are read once
    out = _scores_of_table(table, _fit(table, rows)).select("whole.*", "score")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
