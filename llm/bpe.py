"""BPE encoding and decoding of a word tokenizer, by contiguous rank arrays.

A word starts as one part per byte. Its part boundaries and the ranks of adjacent parts lie in two contiguous arrays; the
least rank is found by a scan, its boundary is deleted and the two neighbouring ranks are looked up again, until no rank
is left. New words of one length are rows of one matrix, so a scan step works on all of them; each step takes one boundary
from every row that is still open. Words met before are kept, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

NONE = np.int32(1 << 30)
KEPT = 200_000  # words whose parts a task remembers
RARE = re.compile("[\u0530-\U0010ffff]")  # what may hold a code point that some Unicode tables lack
ROUND = 1 << 20  # characters of text that are split into words at once


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself where printable, else the next free code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    spare = iter(range(256, 512))
    return [letters.get(b) or chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder of a tokenizer file with NFC, lower case, a split pattern, byte letters and word ends."""

    def __init__(self, spec: dict):
        self.spec = spec
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t
        self.end = spec["model"]["end_of_word_suffix"]
        first = np.array([vocab[c] for c in byte_letters()], np.int32)
        last = np.array([vocab[c + self.end] for c in byte_letters()], np.int32)
        self.first, self.last = first, last
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        late = "[" + spec["late"] + "]"
        self.new = regex.compile("[" + spec["new"] + "]")
        for old, new in ((r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{late})"), (r"[\p{L}]", rf"(?:(?!{late})\p{{L}})"), (r"[\p{N}]", rf"(?:(?!{late})\p{{N}})")):
            split = split.replace(old, new)
        self.with_late = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, tuple[int, str, str]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, parts: np.ndarray) -> list[np.ndarray]:
        """parts: a row of equally many parts for each word."""
        out: list[np.ndarray] = [None] * len(parts)
        row = np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(row):
            if ranks.shape[1] == 0:
                best, at = np.full(len(row), NONE), np.zeros(len(row), int)
            else:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for r, x in zip(row[done].tolist(), parts[done], strict=True):
                    out[r] = x
                row, parts, ranks, at, best = row[~done], parts[~done], ranks[~done], at[~done], best[~done]
                if not len(row):
                    break
            n = np.arange(len(row))
            column = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)
            parts[n, at] = self.merged[best]
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            left, right = at > 0, at < ranks.shape[1]
            ranks[n[left], at[left] - 1] = self.rank(parts[n[left], at[left] - 1], parts[n[left], at[left]])
            ranks[n[right], at[right]] = self.rank(parts[n[right], at[right]], parts[n[right], at[right] + 1])
        return out

    def parts(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        raw = [w.encode() for w in words]
        length = np.array([len(w) for w in raw])
        out: list[np.ndarray] = [None] * len(words)
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            step = max(1, (1 << 22) // n)
            for i in range(0, len(rows), step):
                some = rows[i : i + step].tolist()
                data = np.frombuffer(b"".join([raw[r] for r in some]), np.uint8).reshape(len(some), n)
                start = self.first[data]
                start[:, -1] = self.last[data[:, -1]]
                for r, x in zip(some, self.merge(start), strict=True):
                    out[r] = x
        return out

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(words)
        for w, ids in zip(new, self.parts(new), strict=True):
            ids = ids.tolist()
            self.known[w] = (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))

    def words(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        out: list[str] = []
        for piece in self.cut.split(text) if "<|" in text else (text,):
            if piece in self.special:
                out.append(piece)
            elif piece.isascii():
                out += self.pattern.findall(piece.lower())
            else:  # capital sigma: letters are lower-cased one by one, whatever follows
                if RARE.search(piece) and self.new.search(piece):
                    from tokenizers import normalizers

                    piece = normalizers.Lowercase().normalize_str(normalizers.NFC().normalize_str(piece))
                    out += self.with_late.findall(piece)
                else:
                    out += self.pattern.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text (ids, their decimal text, their decoded text) of each word."""
        split = [self.words(t) for t in texts]
        every = set().union(*split)
        for t, i in self.special.items():
            self.known[t] = (1, str(i), t)
        self.learn(every)
        for t, i in self.special.items():
            self.known[t] = (1, str(i), t)
        get = self.known.__getitem__
        return [list(map(get, w)) for w in split]


def load(path: str) -> dict:
    """The tokenizer file, with two sets of code points in which the Unicode tables of the libraries differ.

    new: letters and digits that Python's own tables do not have yet; texts with one of them are normalized by the
    tokenizers library. late: those of them that only the pattern library knows; they are no letters or digits here."""
    from tokenizers import Regex, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    found = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(" ".join(map(chr, new)))
    late = sorted(set(new) - {ord(c) for c, _ in found})
    return spec | {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(x)) or r"\U0010ffff" for k, x in (("new", new), ("late", late))}


def _ranges(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def _rounds(texts: list[str]):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= ROUND):
            n += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs(doc_id, text): the whole text is encoded and its
    ids decoded again. Decoding joins the tokens by one space, as a tokenizer without a decoder does; special tokens
    written in a text are those tokens. Null text: empty; repeated rows and null ids are rows like any other; other
    columns are not read. The tokenizer file, of fixed size, is read once on the driver and broadcast."""
    spec = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        bpe = Bpe(spec.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, ids, decoded = [], [], []
            for texts in _rounds(_texts(batch)):
                for words in bpe.encode(texts):
                    n.append(sum([w[0] for w in words]))
                    ids.append(sha(" ".join([w[1] for w in words])))
                    decoded.append(sha(" ".join([w[2] for w in words])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row of docs(doc_id, text)."""
    spec = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        bpe = Bpe(spec.value)
        for batch in batches:
            ids = [[int(i) for w in words for i in w[1].split(" ")] for texts in _rounds(_texts(batch)) for words in bpe.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of rows(doc_id, ids); null ids are empty, an id outside the vocabulary is skipped."""
    spec = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        tokens = Bpe(spec.value).tokens
        for batch in batches:
            text = [" ".join([tokens[i] for i in ids or [] if i is not None and 0 <= i < len(tokens)]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def tokenizer_path(spark: SparkSession) -> str:
    """The tokenizer file: the session's ``llm.tokenizer.path``, or the installed public one."""
    own = spark.conf.get("llm.tokenizer.path", None)
    if own is None:
        import public_tokenizers

        own = public_tokenizers.path("word_bpe_49k.json")
    return own
