"""Removal of repeated passages by content-defined chunks of lines.

A chunk is two lines that follow each other (blank ones between them do not count), from every line on, or one line of LONG
words or more. A passage that is shifted or set into another document has the same chunks there, whatever is around it, so
all of its lines go: a match grows line by line as far as the texts agree. Of each chunk that occurs more than once in the
corpus, the first occurrence by (doc_id, place) stays and the lines of all others go, after their bytes are compared by a
cryptographic digest (the bytes themselves would travel twice for every line); a chunk that shares a line with its first
occurrence stays too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words as W
from llm.store import small_batches

LONG = 50  # words
CLASSES = 1 << 22  # of chunk hashes whose repeats are looked for: fixed, so that the broadcast is 512 KB


@dataclass
class Lines:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray  # with the line end
    words: np.ndarray
    hash: np.ndarray
    worded: np.ndarray  # places of the lines with words, which chunks are made of


@dataclass
class Chunks:
    row: np.ndarray
    nth: np.ndarray  # twice the number of the first line among the row's lines with words, and 1 for a long line
    first: np.ndarray  # places of the first and last line
    last: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def _folded(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of x[first:last] in order, for many ranges."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * W.powers(W._BASE, len(x)), out=total[1:])
        return W.mix((total[last] - total[first]) * W.powers(W._INVERSE, len(x) + 1)[first])


def lines(part: W.Slice) -> Lines:
    data, n = part.data, len(part.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Lines(none, none, none, none, none.astype(np.uint64), none)
    newline = data == 10
    ends = np.unique(np.concatenate((np.flatnonzero(newline), part.offsets[1:][part.offsets[1:] > 0] - 1))) + 1
    start = np.concatenate(([0], ends[:-1]))
    row = np.searchsorted(part.offsets, start, side="right") - 1
    words = np.searchsorted(part.start, ends) - np.searchsorted(part.start, start)
    with np.errstate(over="ignore"):
        line = _folded(W._LETTER[data], start, ends - newline[ends - 1])
    return Lines(row, start, ends, words, line, np.flatnonzero(words > 0))


def chunks(x: Lines) -> Chunks:
    w = x.worded
    row = x.row[w]
    number = np.arange(len(w)) - np.searchsorted(row, row)
    pair, long = np.flatnonzero(row[1:] == row[:-1]), np.flatnonzero(x.words[w] >= LONG)
    first, last = np.concatenate((w[pair], w[long])), np.concatenate((w[pair + 1], w[long]))
    nth = np.concatenate((2 * number[pair], 2 * number[long] + 1))
    with np.errstate(over="ignore"):
        h1 = W.mix(x.hash[first] * np.uint64(0xC2B2AE3D27D4EB4F) + x.hash[last])
        h2 = W.mix(W.mix(x.hash[first] ^ np.uint64(0x2545F4914F6CDD1D)) + x.hash[last])
        one = first == last
        h1[one], h2[one] = W.mix(h1[one]), W.mix(h2[one])  # a long line is no pair of equal lines
    return Chunks(x.row[first], nth, first, last, h1, h2)


def _count(batches):
    total = np.zeros(CLASSES, np.uint8)
    for batch in batches:
        for part in W.slices(batch.column("text")):
            at, n = np.unique((chunks(lines(part)).h1 >> np.uint64(42)).astype(np.int64), return_counts=True)
            total[at] = np.minimum(total[at] + np.minimum(n, 2), 2)
    for i, x in enumerate(np.split(total, 64)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([np.packbits(x >= 1).tobytes()], pa.binary()), pa.array([np.packbits(x >= 2).tobytes()], pa.binary())], ["i", "once", "twice"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    once = twice = np.zeros(CLASSES // 64 // 8, np.uint8)
    for a, b in zip(pdf.once, pdf.twice, strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        once, twice = once | a, twice | b | (once & a)
    return pd.DataFrame({"i": [pdf.i.iloc[0]], "twice": [twice.tobytes()]})


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _candidates(classes):
    def run(batches):
        twice = np.unpackbits(np.frombuffer(classes.value, np.uint8)).astype(bool)
        for batch in batches:
            for part in W.slices(batch.column("text")):
                x = lines(part)
                c = chunks(x)
                ks = np.flatnonzero(twice[(c.h1 >> np.uint64(42)).astype(np.int64)])
                text = lambda i: part.data[x.start[i] : x.end[i]].tobytes().rstrip(b"\n")  # noqa: B023, E731
                body = [_digest(text(a) + b"\n" + text(b) if a < b else text(a)) for a, b in zip(c.first[ks].tolist(), c.last[ks].tolist(), strict=True)]
                taken = batch.select(["doc_id", "key"]).take(pa.array(part.first + c.row[ks]))
                kinds = [pa.array(c.nth[ks]), pa.array(c.h1[ks].view(np.int64)), pa.array(c.h2[ks].view(np.int64)), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays([*taken.columns, *kinds], ["doc_id", "key", "nth", "h1", "h2", "digest"])

    return run


def _rebuilt(batches):
    """Texts without the lines of the chunks whose numbers are in ``gone``, a slice of rows at a time."""
    for batch in batches:
        for part in W.slices(batch.column("text")):
            rows = batch.slice(part.first, part.rows)
            gone, out = rows.column("gone").to_pylist(), rows.column("text").to_pylist()
            newline = np.concatenate(([0], np.cumsum(part.data == 10)))
            a, b = part.offsets[:-1], part.offsets[1:]
            open_end = np.array([y > x and part.data[y - 1] != 10 for x, y in zip(a, b, strict=True)], np.int64)
            n_lines, cut = newline[b] - newline[a] + open_end, np.zeros(part.rows, np.int64)
            some = [i for i in range(part.rows) if gone[i]]
            if some:
                x = lines(part)
                begin, end = np.searchsorted(x.row, np.arange(part.rows)), np.searchsorted(x.row, np.arange(part.rows), side="right")
                worded = np.searchsorted(x.worded, begin)
            for i in some:
                drop = np.zeros(end[i] - begin[i], bool)
                for g in gone[i]:
                    k = worded[i] + g // 2
                    drop[x.worded[k] - begin[i] : x.worded[k + 1 - g % 2] - begin[i] + 1] = True
                kept = b"".join(part.data[x.start[k] : x.end[k]].tobytes() for k in range(begin[i], end[i]) if not drop[k - begin[i]])
                cut[i] = drop.sum()
                if drop[-1] and kept.endswith(b"\n"):
                    kept = kept[:-1]
                out[i] = kept.decode()
            yield pa.RecordBatch.from_arrays([rows.column("whole"), pa.array(out, pa.string()), pa.array(n_lines.astype(np.int64)), pa.array(cut)], ["whole", "new_text", "n_lines", "n_removed"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with the new text, and n_lines and n_removed (lines before, lines removed).

    All rows stay; a document whose every line occurs before, in chunks, has an empty text. Null or empty text: stays as it is, no
    lines. Null doc_id: after all others in the order of occurrences. Rows equal in doc_id and text are one document and
    keep the same lines. Own columns may have any names but n_lines and n_removed, which are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("whole"))
    parts = keyed.select("text").mapInArrow(_count, "i long, once binary, twice binary").groupBy("i").applyInPandas(_add, "i long, twice binary").collect()
    twice = b"".join(r.twice for r in sorted(parts, key=lambda r: r.i)) or bytes(CLASSES // 8)
    classes = docs.sparkSession.sparkContext.broadcast(twice)
    found = keyed.select("doc_id", "key", "text").mapInArrow(_candidates(classes), "doc_id long, key long, nth long, h1 long, h2 long, digest binary")
    place = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "key", "nth")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    # all bytes are equal if the least and the greatest digest are
    first = first.where("least = most AND first != last").select("h1", "h2", "first")
    again = found.select("doc_id", "key", "nth", "h1", "h2").join(first, ["h1", "h2"]).where(place != F.col("first"))
    # pairs of equal lines in a row share one
    shared = (F.col("nth") - F.col("first.nth") == 2) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    again = again.where(~shared)
    gone = again.groupBy("doc_id", "key").agg(F.collect_set("nth").alias("gone"))
    same = keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["key"] == gone["key"])
    joined = keyed.join(gone, same, "left").select("whole", keyed["text"].alias("text"), "gone")
    kind = f"whole {keyed.schema['whole'].dataType.simpleString()}, new_text string, n_lines long, n_removed long"
    out = joined.mapInArrow(_rebuilt, kind)
    columns = [F.col("new_text").alias("text") if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns]
    return out.select(*columns, "n_lines", "n_removed")
