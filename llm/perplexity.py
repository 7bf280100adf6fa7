"""Quality rules by n-gram perplexity under a modified Kneser-Ney model.

Spark counts the words, then the pairs of adjacent words, of all documents and each language apart; every word and every
pair that occurs is in the model, whatever the size of the corpus. A word is a code: its place among the words with at
least a 2^-RARE share of all words, or else its hash. The counts give three discounts from the counts of counts,
continuation counts for the lower order, and the weight that the discounts leave to it. The first word of a text is the
pair (START, word), which has the lower order alone.

The pairs stay in Spark. Frequent ones (both words have a place, and a 2^-PAIR share of all words: at most 2^PAIR) are also
sent to the tasks, so that they need no shuffle and make no hot key; all other pairs of a document find theirs by a join.

A document is rejected if its perplexity lies outside the band of its language: so many deviations around the median of
its documents' logarithms, measured by the quartiles on either side. So it is if the perplexity without the evidence of
pairs that it alone has lies outside of its band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from llm import signals as S
from llm import words as W
from llm.store import written

RARE, PAIR = 19, 22
LOW, HIGH = 12.0, 6.0  # quartile distances below and above the median that are still kept
MIN_WORDS, MAX_REPEATED = 50, 50  # base rules: words at least, per cent of words in repeated windows at most
BIN = 100  # classes of log perplexity for each unit
FLUSH = 1 << 22  # words that are pre-counted together
START = 0  # the context of a text's first word
_HASHED = np.uint64(1 << 63)  # marks codes that are hashes: as signed numbers they are below 0


def _languages(column: pa.Array) -> np.ndarray:
    """A 64-bit salt for each row's language; null is a language of its own."""
    salts: dict = {}
    out = np.empty(len(column), np.uint64)
    for i, x in enumerate(column.to_pylist()):
        if x not in salts:
            raw = b"\0" if x is None else x.encode()
            salts[x] = W.mix(np.array([int.from_bytes(raw[:7], "little") * 2 + (x is None) + 1], np.uint64))[0]
            for k in range(7, len(raw), 7):
                salts[x] = W.mix(np.array([salts[x] ^ np.uint64(int.from_bytes(raw[k : k + 7], "little"))]))[0]
        out[i] = salts[x]
    return out


def _word_keys(batch: pa.RecordBatch):
    """Slices of a batch with the key of each word: language and bytes."""
    salt = _languages(batch.column("lang"))
    for part in W.slices(batch.column("text")):
        with np.errstate(over="ignore"):
            yield part, W.mix(part.hashes() + salt[part.first + part.row])


def _pre_counted(batches, keys, names):
    """Distinct keys of a task with their counts, some millions of them at a time."""
    held, n = [], 0

    def flush():
        u, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names)

    for batch in batches:
        for x in keys(batch):
            held.append(x)
            n += len(x)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of all words of docs(text, lang) by hash of language and word."""
    run = lambda batches: _pre_counted(batches, lambda b: (k for _, k in _word_keys(b)), ["word", "n"])
    return docs.select("text", "lang").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(vocabulary: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted vocabulary plus 1; a key that is not there is its own code, below 0."""
    hashed = (keys | _HASHED).view(np.int64)
    if not len(vocabulary):
        return hashed
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return np.where(vocabulary[at] == keys, at + 1, hashed)


def _pairs(part: W.Slice, codes: np.ndarray) -> np.ndarray:
    """The code before each word, START for a row's first; so a text has as many pairs as words."""
    before = np.concatenate((np.full(min(1, len(codes)), START), codes[:-1]))
    before[1:][part.row[1:] != part.row[:-1]] = START
    return before


def pair_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(v, w, n): counts of all pairs of adjacent words by their codes; the rows of one v are in one partition."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def flush(held):
        v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        with np.errstate(over="ignore"):
            key = W.mix(W.mix(v.view(np.uint64)) + w.view(np.uint64))
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(w[at]), pa.array(n.astype(np.int64))], ["v", "w", "n"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part, keys in _word_keys(batch):
                w = _codes(words.value, keys)
                held.append((_pairs(part, w), w))
                n += len(w)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    pairs = docs.select("text", "lang").mapInArrow(run, "v long, w long, n long")
    return pairs.repartition("v").groupBy("v", "w").agg(F.sum("n").alias("n"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more; 1/2, 1 and 3/2 where counts are too few."""
    if min(n1, n2, n3) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [max(0.0, 1 - 2 * y * n2 / n1), max(0.0, 2 - 3 * y * n3 / n2), max(0.0, 3 - 4 * y * n4 / n3)]


def _less(n: Column, d: list[float]) -> Column:
    """What is taken off a count, never more than the count."""
    return F.least(n.cast("double"), F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]))


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes of the words that have a place
    pairs: DataFrame  # (v, w, n) and of v: total, types, n1, n2
    words: DataFrame  # (w, into): the contexts of each word that has some
    high: list[float]  # discounts of pairs
    low: list[float]  # and of contexts
    contexts: int  # different pairs
    floor: float  # probability of a word without context
    keys: np.ndarray  # sorted keys v << 32 | w of the frequent pairs
    log_p: np.ndarray

    def weight(self) -> Column:
        """Weight of the lower order after v; 1 if v never had a successor."""
        d, total = self.high, F.col("total")
        left = d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * (F.col("types") - F.col("n1") - F.col("n2"))
        return F.when(F.col("v") == START, 1.0).otherwise(F.coalesce(F.greatest(left / total, F.lit(1e-9)), F.lit(1.0)))

    def scored(self, pairs: DataFrame) -> DataFrame:
        """pairs(v, w, rest, weight, once, alone) with log_p, and log_left: that without the pair's own evidence if it occurs
        once. Words with a place are at most 2^RARE, so theirs are broadcast; the others are joined, which have few pairs."""
        words, into, floor = self.words, F.coalesce("into", F.lit(0)), F.lit(self.floor)
        one = lambda n: (n - _less(n, self.low)) / max(1, self.contexts) + floor
        log_p = F.log(F.col("rest") + F.col("weight") * one(into))
        left = F.when(F.col("once"), F.log(F.when(F.col("alone"), 1.0).otherwise(F.col("weight")) * one(into - 1))).otherwise(log_p)
        placed = pairs.where("w > 0").join(F.broadcast(words.where("w > 0")), "w", "left")
        rows = placed.unionByName(pairs.where("w < 0").join(words.where("w < 0"), "w", "left"))
        return rows.select("v", "w", log_p.alias("log_p"), left.alias("log_left"))

    def known(self, least: int = 1) -> DataFrame:
        """(v, w, log_p, log_left) of the pairs that occur at least so often."""
        pairs = self.pairs if least <= 1 else self.pairs.where((F.col("n") >= least) & (F.col("v") >= 0) & (F.col("w") > 0))
        rest = F.when(F.col("v") == START, 0.0).otherwise((F.col("n") - _less(F.col("n"), self.high)) / F.col("total"))
        once = (F.col("n") == 1) & (F.col("v") != START)
        return self.scored(pairs.select("v", "w", rest.alias("rest"), self.weight().alias("weight"), once.alias("once"), (F.col("total") == 1).alias("alone")))

    def unseen(self, pairs: DataFrame) -> DataFrame:
        """(v, w, log_p, log_left) of those of pairs(v, w) that never occur in the corpus."""
        new = pairs.distinct().join(self.pairs.select("v", "w"), ["v", "w"], "left_anti")
        of = self.pairs.select("v", "total", "types", "n1", "n2").distinct()
        never = F.lit(False)
        return self.scored(new.join(of, "v", "left").select("v", "w", F.lit(0.0).alias("rest"), self.weight().alias("weight"), never.alias("once"), never.alias("alone")))


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(p.words[-1]) for p in W.slices(batch.column("text")))], pa.int64())], ["n"])


def train(docs: DataFrame, rare: int = RARE, pair: int = PAIR) -> Model:
    """The model of docs(text, lang). rare and pair say what is sent to the tasks, and change no probability."""
    total = docs.select("text").mapInArrow(_sizes, "n long").agg(F.sum("n")).first()[0] or 0
    seen = Observation()
    frequent = word_counts(docs).observe(seen, F.count("*").alias("n")).where(F.col("n") >= max(1, -(-total >> rare))).select("word")  # at most 2^rare rows
    vocabulary = np.sort(frequent.toArrow().column("word").to_numpy().view(np.uint64)) if total else np.zeros(0, np.uint64)
    size = (seen.get["n"] if total else 0) + 1  # with the unknown word
    of_v = Window.partitionBy("v")
    some = lambda k: F.count(F.when(F.col("n") == k, 1)).over(of_v)
    pairs = written(pair_counts(docs, vocabulary).select("v", "w", "n", F.sum("n").over(of_v).alias("total"), F.count("*").over(of_v).alias("types"), some(1).alias("n1"), some(2).alias("n2")))
    real = pairs.where(F.col("v") != START)
    words = written(real.groupBy("w").agg(F.count("*").alias("into")))
    of = lambda df, c: df.agg(F.count("*"), F.sum(c), *[F.count(F.when(F.col(c) == k, 1)) for k in (1, 2, 3, 4)]).first()
    high = _discounts(*of(real, "n")[2:])
    types, contexts, *low_counts = of(words, "into")
    low, (n1, n2) = _discounts(*low_counts), low_counts[:2]
    left = min(1, low[0]) * n1 + min(2, low[1]) * n2 + low[2] * (types - n1 - n2)
    m = Model(vocabulary, pairs, words, high, low, contexts or 0, (left or 1.0) / (contexts or 1) / size, np.zeros(0, np.int64), np.zeros(0))
    top = m.known(max(2, -(-total >> pair))).select((F.shiftleft("v", 32).bitwiseOR(F.col("w"))).alias("key"), "log_p").toArrow()  # at most 2^pair rows
    key, log_p = (top.column(x).to_numpy() for x in ("key", "log_p"))
    order = np.argsort(key)
    m.keys, m.log_p = key[order], log_p[order].astype(np.float32)
    return m


def _here(part: W.Slice, keys: np.ndarray, vocabulary: np.ndarray, held: np.ndarray, log_p: np.ndarray):
    """Codes v and w of a slice's pairs, the sum of the log probabilities held here by row, and which pairs are not held."""
    w = _codes(vocabulary, keys)
    v = _pairs(part, w)
    if not len(held):
        return v, w, np.zeros(part.rows), np.ones(len(w), bool)
    key = np.where((v >= 0) & (w > 0), v << 32 | w, -1)
    at = np.minimum(np.searchsorted(held, key), len(held) - 1)
    hit = held[at] == key
    return v, w, np.bincount(part.row[hit], log_p[at[hit]], part.rows), ~hit


def signals(docs: DataFrame, model: Model, of_corpus: bool = False) -> DataFrame:
    """docs(doc_id, text, lang): the base counts of each row, log_ppl, the mean negative log probability of its words, and
    log_left, the same with pairs that occur once in the corpus scored as if they never did: a text of words that no other
    has is likely under a model that has learned it. 0 without words. With of_corpus, docs are those of the model, so no
    pair is unseen.

    Pairs that are not held by the tasks are looked up by a join and added up by text and language: equal rows add up to a
    multiple, of their sums as of their numbers of pairs."""
    held = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.keys, model.log_p))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in [*names, "asked"]]
            here = [np.zeros(0)]
            for part, keys in _word_keys(batch):
                base = S.base(part)
                _, _, s, asked = _here(part, keys, *held.value)
                base["asked"] = np.bincount(part.row[asked], minlength=part.rows)
                for c, name in zip(out, [*names, "asked"], strict=True):
                    c.append(base[name].astype(np.int64))
                here.append(s)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "lang", "key")), *(pa.array(np.concatenate(c)) for c in out), pa.array(np.concatenate(here))], ["doc_id", "lang", "key", *names, "asked", "here"])

    def rest(batches):
        for batch in batches:
            own = batch.column("key").to_numpy(zero_copy_only=False)
            for part, keys in _word_keys(batch):
                v, w, _, asked = _here(part, keys, *held.value)
                yield pa.RecordBatch.from_arrays([pa.array(own[part.first + part.row[asked]]), pa.array(v[asked]), pa.array(w[asked])], ["key", "v", "w"])

    keyed = docs.select("doc_id", "lang", "text", F.xxhash64(F.col("lang").isNull(), "lang", "text").alias("key"))
    rows = keyed.mapInArrow(run, "doc_id long, lang string, key long, " + ", ".join(f"{x} long" for x in [*names, "asked"]) + ", here double")
    asked = keyed.select("key", "lang", "text").mapInArrow(rest, "key long, v long, w long")
    known = model.known() if of_corpus else model.known().unionByName(model.unseen(asked.select("v", "w")))
    pair = F.xxhash64("v", "w").alias("pair")
    logs = ["log_p", "log_left"]
    sums = asked.select("key", pair).join(known.select(pair, *[F.col(x).cast("float").alias(x) for x in logs]), "pair").groupBy("key").agg(*[F.sum(x).alias(x) for x in logs], F.count("*").alias("n"))
    mean = lambda x: -(F.col("here") + F.coalesce(F.col(x) * F.col("asked") / F.col("n"), F.lit(0.0))) / F.greatest("n_words", F.lit(1))
    return rows.join(sums, "key", "left").select("doc_id", "lang", *names, mean("log_p").alias("log_ppl"), mean("log_left").alias("log_left"))


def bands(rows: DataFrame, low: float = LOW, high: float = HIGH, of: str = "log_ppl") -> DataFrame:
    """(language, low, high): bounds of one of the scores from exact quartiles of its BIN classes, over the rows that pass the base
    rules; a few thousand classes for each language are all that is ranked."""
    binned = rows.where("NOT base_failed").groupBy("language", F.round(F.col(of) * BIN).alias("bin")).agg(F.count("*").alias("n"))
    q = binned.groupBy("language").agg(*[F.percentile("bin", F.lit(p), F.col("n")).alias(f"q{k}") for k, p in enumerate((0.25, 0.5, 0.75))])
    below, above = F.greatest(F.col("q1") - F.col("q0"), F.lit(5.0)), F.greatest(F.col("q2") - F.col("q1"), F.lit(5.0))
    return q.select("language", ((F.col("q1") - low * below) / BIN).alias("low"), ((F.col("q1") + high * above) / BIN).alias("high"))


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl) of docs(doc_id,
    text, lang). Null or empty text: no words, base_failed. Null lang: a language of its own; a language without a
    document that passes the base rules has no band. Other columns are not read, repeated rows are rows like any other."""
    rows = written(signals(docs, train(docs), of_corpus=True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("language", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")))
    out = rows.withColumn("kept", ~F.col("base_failed"))
    for score in ("log_ppl", "log_left"):
        inside = F.coalesce(F.col(score).between(F.col("low"), F.col("high")), F.lit(True))
        out = out.join(bands(rows, of=score), "language", "left").withColumn("kept", F.col("kept") & inside).drop("low", "high")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")
