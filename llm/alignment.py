"""Alignment of two tokenizers by coalescing byte intervals.

Every token of a text is an interval of its bytes. All intervals of a slice of texts, of both tokenizers, lie on one axis
(one text behind the other) and are sorted by start. The running maximum of their ends (``maximum.accumulate``) tells where
a group breaks: where a start reaches it. Within a group, each distinct start opens one overlap, of the last A and the last
B interval that began: two tilings overlap exactly there.

Where both tokenizers allow it, a text is cut before a space that follows a visible character: no token of either crosses that
place, so each segment has the tokens, groups and links that it has in the whole text. A task aligns a segment once and keeps
the result for the next time it meets it, up to KNOWN segments; a text is put together from its segments.

The counts of id pairs cover all documents. They are not looked up one by one: texts are taken in blocks of bounded size, a
block asks once for each of its distinct pairs, and the answers come back as an array in the order of the block's own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import byte_letters
from llm.store import written

BLOCK = 8 << 20  # bytes of text of a block; a longer text is a block of its own
SLICE = 1 << 20  # bytes of text that are aligned at once
JOINED = 1 << 16  # letters of segments that are encoded as one text
KNOWN, KNOWN_LETTERS = 1 << 18, 1 << 22  # segments that a task keeps, and their letters; then it starts anew
# what a split of A may take for white space, and some more: such a character has no cut behind it
WHITE = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff"
_WHITE_SPACE, _ENDS_WHITE = re.compile(f"[{WHITE}] "), re.compile(f"[{WHITE}]\\Z")
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, links array<binary>, pairs array<long>, docs array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def tokenizer_paths(spark: SparkSession) -> tuple[str, str]:
    """Files of A and B: the session's ``llm.alignment.a`` and ``llm.alignment.b``, else the public ones."""
    import public_tokenizers

    return spark.conf.get("llm.alignment.a", public_tokenizers.path(A_FILE)), spark.conf.get("llm.alignment.b", public_tokenizers.path(B_FILE))


class Tokens:
    """Ids of both tokenizers and the bytes that each id stands for."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_letter = {ch: i for i, ch in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of_letter[c] for c in token) if all(c in of_letter for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        # the spelling of each id before ',', '|' and ';', B behind A
        ids = [*map(str, range(len(self.a_bytes))), *map(str, range(len(self.b_bytes)))]
        self.spelt = np.array([[i + end for end in ",|;"] for i in ids], object)
        self.cuts = self._separable(a_path, pieces)

    def _separable(self, a_path: str, pieces: list[str]) -> bool:
        """Whether no token of A or B reaches over a visible character and the space behind it, nor depends on what is there."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(a_path, encoding="utf-8") as f:
            a = json.load(f)
        split = a.get("pre_tokenizer") or {}
        of_a = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and a.get("normalizer") is None
        of_a = of_a and a["model"].get("type", "BPE") == "BPE" and not a["model"].get("dropout") and all(x["special"] for x in a.get("added_tokens") or [])
        b = pb.ModelProto()
        b.ParseFromString(self.b.serialized_model_proto())
        norm, spec = b.normalizer_spec, b.trainer_spec
        of_b = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        of_b = of_b and spec.model_type == spec.BPE and not spec.treat_whitespace_as_suffix and all(x.type in (x.NORMAL, x.UNKNOWN, x.CONTROL, x.BYTE) for x in b.pieces)
        return bool(of_a and of_b and not any(re.search("[^▁]▁", p) for p in pieces))

    def joined(self, segments: list[str]) -> tuple | None:
        """(ids, how many of each segment) of A and of B, encoded as one text; None unless both spell all of it back."""
        text = " ".join(segments)
        want = f" {text}".encode()
        end = np.cumsum([len(s.encode()) + 1 for s in segments])
        out = []
        for ids, spelling, length in (
            (self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.a_bytes, self.a_length),
            (self.b.encode(text), self.b_bytes, self.b_length),
        ):
            ends = np.cumsum(length[ids])
            last = np.searchsorted(ends, end)
            if b"".join([spelling[k] for k in ids]) != want or not np.array_equal(ends[last], end):
                return None
            out.append((np.array(ids, np.int64), np.diff(last + 1, prepend=0)))
        return tuple(out)

    def segments(self, text: str) -> list[str]:
        """Parts of a text that are encoded each for itself; joined by a space they are the text."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if not _WHITE_SPACE.search(f" {text}") and parts[-1]:
            return parts
        out: list[str] = []
        held: list[str] = []
        for p in parts:
            held.append(p)
            if p and not _ENDS_WHITE.search(p):
                out.append(" ".join(held))
                held = []
        if held:  # the text ends in white space, which needs a character before it
            out.append(" ".join([*out[-1:], *held]))
            del out[-2:-1]
        return out

    def encoded(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each text; both empty unless both spell a space and the text."""
        some = [i for i, t in enumerate(texts) if t]
        a: list[list[int]] = [[] for _ in texts]
        b: list[list[int]] = [[] for _ in texts]
        ones = self.a.encode_batch_fast([" " + texts[i] for i in some], add_special_tokens=False)
        twos = self.b.encode([texts[i] for i in some], num_threads=1)
        for i, x, y in zip(some, ones, twos, strict=True):
            want = (" " + texts[i]).encode()
            x = x.ids
            if b"".join([self.a_bytes[k] for k in x]) == want and b"".join([self.b_bytes[k] for k in y]) == want:
                a[i], b[i] = x, y
        return a, b


_loaded: dict[tuple[str, str], Tokens] = {}


def tokens(paths: tuple[str, str]) -> Tokens:
    if paths not in _loaded:
        _loaded[paths] = Tokens(*paths)
    return _loaded[paths]


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in one array, and how many of each."""
    n = np.array([len(x) for x in ids], np.int64)
    return np.fromiter((i for x in ids for i in x), np.int64, n.sum()), n


def aligned(t: Tokens, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray | list]:
    """For some segments, ids and how many of each: counts and groups of each, its links as (row, A id << 32 | B id), in text order."""
    n_a, n_b = a[1], b[1]
    rows = len(n_a)
    ids = np.concatenate([a[0], b[0]])
    of_b = np.arange(len(ids)) >= n_a.sum()
    row = np.concatenate([np.repeat(np.arange(rows), n_a), np.repeat(np.arange(rows), n_b)])
    length = np.where(of_b, t.b_length[np.where(of_b, ids, 0)], t.a_length[np.where(of_b, 0, ids)])
    # both tokenizers tile the same bytes, so the running sums of both start every text at the same place
    end = np.concatenate([np.cumsum(length[~of_b]), np.cumsum(length[of_b])])
    start = end - length
    order = np.lexsort((of_b, start))
    ids, of_b, row, start, end = ids[order], of_b[order], row[order], start[order], end[order]
    reach = np.maximum.accumulate(end)
    breaks = np.ones(len(ids), bool)
    breaks[1:] = start[1:] >= reach[:-1]
    # a group's first A and first B begin at one place: the second of them breaks nothing, its start is below the reach
    group = np.cumsum(breaks) - 1
    opens = np.ones(len(ids), bool)
    opens[:-1] = start[1:] != start[:-1]  # the last token that begins at a place
    place = np.arange(len(ids))
    last_a = np.maximum.accumulate(np.where(of_b, 0, place))
    last_b = np.maximum.accumulate(np.where(of_b, place, 0))
    at = np.flatnonzero(opens)
    pair = ids[last_a[at]] << 32 | ids[last_b[at]]
    # spelling: tokens by group, A before B
    spell = np.lexsort((of_b, group))
    s_group, s_b, s_row = group[spell], of_b[spell], row[spell]
    sep = np.full(len(spell), 2)
    sep[:-1] = np.where(s_group[1:] != s_group[:-1], 2, np.where(s_b[1:] != s_b[:-1], 1, 0))
    text = t.spelt[ids[spell] + s_b * len(t.a_bytes), sep].tolist()
    cut = np.searchsorted(s_row, np.arange(rows + 1)).tolist()
    groups = ["".join(text[i:j])[:-1] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(row[breaks], minlength=rows), "n_links": np.bincount(row[at], minlength=rows),
        "groups": groups, "link_row": row[at], "pair": pair,
    }


class Known:
    """Segments that are aligned already: their counts, groups and links by place."""

    def __init__(self, t: Tokens) -> None:
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.letters = 0
        self.counts = {c: np.zeros(0, np.int64) for c in COUNTS}
        self.first, self.pair = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _add(self, new: list[str]) -> None:
        # a segment that ends in white space has no cut behind it
        alone = [s for s in new if not self.t.cuts or _ENDS_WHITE.search(s)]
        chunks, letters = [alone] if alone else [], JOINED
        known = set(alone)
        for s in new:
            if s in known:
                continue
            if letters >= JOINED:
                chunks.append([])
                letters = 0
            chunks[-1].append(s)
            letters += len(s)
        for k, chunk in enumerate(chunks):
            self._keep(chunk, None if alone and k == 0 else self.t.joined(chunk))

    def _keep(self, new: list[str], ids) -> None:
        some = aligned(self.t, *(ids or map(flat, self.t.encoded(new))))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.groups += some["groups"]
        self.letters += sum(map(len, new))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(some["n_links"])))
        self.pair = np.concatenate((self.pair, some["pair"]))
        self.counts = {c: np.concatenate((x, some[c])) for c, x in self.counts.items()}

    def places(self, segments: list[str]) -> np.ndarray:
        if len(self.at) > KNOWN or self.letters > KNOWN_LETTERS:
            self.clear()
        found = list(map(self.at.get, segments))
        if None in found:
            self._add(list(dict.fromkeys(s for s, i in zip(segments, found, strict=True) if i is None)))
            found = list(map(self.at.__getitem__, segments))
        return np.array(found, np.int64)

    def texts(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """For a slice of texts: counts and digests of each, and its distinct links (row, pair, times), ascending."""
        rows = len(texts)
        parts = [self.t.segments(x) if x else [] for x in texts]
        at = self.places([s for p in parts for s in p])
        row = np.repeat(np.arange(rows), [len(p) for p in parts])
        # a text has no tokens if one of its segments is not spelled back
        spelt = (np.bincount(row, self.counts["n_a"][at] == 0, rows) == 0)[row]
        at, row = at[spelt], row[spelt]
        out: dict = {c: np.bincount(row, x[at], rows).astype(np.int64) for c, x in self.counts.items()}
        groups = [self.groups[i] for i in at.tolist()]
        cut = np.searchsorted(row, np.arange(rows + 1)).tolist()
        out["groups_sha256"] = [hashlib.sha256(";".join(groups[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(cut[:-1], cut[1:], strict=True)]
        each, times = np.unique(row << 32 | at, return_counts=True)
        row, at = each >> 32, each & 0xFFFFFFFF
        many = self.first[at + 1] - self.first[at]
        of = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out["row"], out["pair"], out["times"] = distinct(np.repeat(row, many), self.pair[of], np.repeat(times, many))
        return out


def distinct(link_row: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times), ascending, of links of some rows, each so many times."""
    order = np.lexsort((pair, link_row))
    r, p = link_row[order], pair[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (p[1:] != p[:-1]))))
    return r[first], p[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each, as bytes: steps first, then counts."""
    import zstandard

    step = np.diff(at, prepend=0).astype(np.uint32)
    planes = np.concatenate([step, times.astype(np.uint32)]).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    n = len(both) // 2
    return np.cumsum(both[:n].astype(np.int64)), both[n:].astype(np.int64)


_TYPES = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32())]
_NAMES = ["block", "doc_id", *COUNTS, "groups_sha256", "links", "pairs", "docs"]


def _blocks(paths: tuple[str, str], block_bytes: int):
    """One row for each block of consecutive texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(tokens(paths))
        block = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}

        def fresh() -> None:
            held.update({c: [] for c in ("doc_id", *COUNTS, "groups_sha256")}, row=[], pair=[], times=[], bytes=[0], rows=[0])

        def block_row() -> pa.RecordBatch:
            nonlocal block
            row, pair, times = (np.concatenate([*held[c], np.zeros(0, np.int64)]) for c in ("row", "pair", "times"))
            pairs, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
            cut = np.searchsorted(row, np.arange(held["rows"][0] + 1))
            links = [packed(at[i:j], times[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            values = [block, held["doc_id"], *(np.concatenate([*held[c], np.zeros(0, np.int64)]) for c in COUNTS), held["groups_sha256"], links, pairs, docs]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _TYPES, strict=True)], _NAMES)
            block += 1
            fresh()
            return out

        fresh()
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE):
                    size += len(texts[j] or "")
                    j += 1
                if held["rows"][0] and held["bytes"][0] + size > block_bytes:
                    yield block_row()
                some = known.texts(texts[i:j])
                held["row"].append(some["row"] + held["rows"][0])
                held["pair"].append(some["pair"])
                held["times"].append(some["times"])
                held["doc_id"] += doc_ids[i:j]
                held["groups_sha256"] += some["groups_sha256"]
                for c in COUNTS:
                    held[c].append(some[c])
                held["bytes"][0] += size
                held["rows"][0] += j - i
                i = j
        if held["rows"][0]:
            yield block_row()

    return run


def _scored(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one block with the counts of their links."""
    many = answers.sort_by("place")
    n, top = many.column("n").to_numpy(), many.column("best").to_numpy()
    out = {"doc_id": [], "best": [], "sum": []}
    rest: dict[str, list] = {c: [] for c in (*COUNTS, "groups_sha256")}
    for k in range(block.num_rows):
        for data in block.column("links")[k].as_py():
            at, times = unpacked(data)
            out["best"].append(int((times * top[at]).sum()))
            out["sum"].append(int((times * n[at]).sum()))
        out["doc_id"] += block.column("doc_id")[k].as_py()
        for c in rest:
            rest[c] += block.column(c)[k].as_py()
    arrays = [out["doc_id"], *(rest[c] for c in COUNTS), out["best"], out["sum"]]
    return pa.table([*(pa.array(x, pa.int64()) for x in arrays), pa.array(rest["groups_sha256"], pa.string())], ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each id pair, and whether no pair of its A id has more."""
    each = blocks.select(F.arrays_zip("pairs", "docs").alias("z")).select(F.explode("z").alias("z"))
    counts = written(each.groupBy(F.col("z.pairs").alias("pair")).agg(F.sum("z.docs").cast("long").alias("n")))
    # one row for each A id, so no more than A has ids
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def alignments(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row for each row of docs(doc_id, text): tokens, groups and links of A and B, and the corpus counts of its links.

    * null or empty text, or one that either tokenizer does not spell back as a space and the text: no tokens, zeros and ''
    * a null or repeated doc_id: each row is a document of its own
    * texts of any length; a text above BLOCK bytes is a block of its own. Other columns are not read
    """
    blocks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(paths, BLOCK), BLOCKS))
    asked = blocks.select(F.col("block").alias("asking"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(blocks), "pair").select("asking", "place", "n", "best")
    held = blocks.drop("pairs", "docs")
    return held.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(_scored, RESULT)


def align_query(docs: DataFrame, spark: SparkSession) -> DataFrame:
    return alignments(docs, tokenizer_paths(spark))
