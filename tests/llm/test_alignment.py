"""Token alignment against a walk over bytes, pair by pair."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm import alignment as L


@pytest.fixture(scope="module")
def two():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelt(two, text):
    """[(id, bytes)] of A and B."""
    a, b = two
    letters = dict(zip(L.byte_letters(), range(256), strict=True))
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two_ = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return one, two_


def brute(two, rows):
    docs = []
    for i, text in rows:
        one, other = spelt(two, text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(x for _, x in one) != want or b"".join(x for _, x in other) != want:
            one = other = []
        of_a = [k for k, (_, x) in enumerate(one) for _ in x]
        of_b = [k for k, (_, x) in enumerate(other) for _ in x]
        links = sorted(set(zip(of_a, of_b, strict=True)))
        links = [(one[x][0], other[y][0]) for x, y in links]
        groups, p, q, at, bt = [], 0, 0, 0, 0
        left, right = [], []
        while p < len(one) or q < len(other):
            if at <= bt:
                left.append(one[p][0])
                at += len(one[p][1])
                p += 1
            else:
                right.append(other[q][0])
                bt += len(other[q][1])
                q += 1
            if at == bt:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        docs.append((i, len(one), len(other), groups, links))
    count = Counter(p for d in docs for p in set(d[4]))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return sorted(
        (
            (i, n, m, len(g), len(k), sum(count[p] == top[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, n, m, g, k in docs
        ),
        key=str,
    )


def found(spark, df):
    return sorted((tuple(r) for r in L.align_query(df, spark).collect()), key=str)


@pytest.mark.parametrize("block", [L.BLOCK, 3000])
def test_given_documents(spark, docs, two, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(spark, docs) == brute(two, rows)


def test_odd_texts(spark, odd, empty, two):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(spark, odd) == brute(two, rows)
    assert L.align_query(empty, spark).count() == 0


def test_special_and_strange_texts(spark, two):
    texts = ["<|endoftext|> a", "  two  spaces ", "a▁b", "▁", "ééﬁÅ", "\x00nul\x00", "\r\n\t", "​　", "👩‍👩‍👧‍👦 日本", "x" * 3000, "<0x41>", "<s> </s> <unk>", " ", None, ""]
    rows = list(enumerate(texts)) + [(3, "same"), (3, "same"), (None, "same")]
    assert found(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(two, rows)


def test_packed_places():
    import numpy as np

    at, times = np.array([0, 5, 70_000, 3_000_000]), np.array([1, 300, 2, 70_000])
    assert [x.tolist() for x in L.unpacked(L.packed(at, times))] == [at.tolist(), times.tolist()]
    assert [x.tolist() for x in L.unpacked(L.packed(at[:0], times[:0]))] == [[], []]


def test_segments_are_aligned_once(two, monkeypatch):
    """Texts put together from segments equal whole texts, and a segment that comes again is not encoded again."""
    import random

    t = L.Tokens(public_tokenizers.path(L.A_FILE), public_tokenizers.path(L.B_FILE))
    assert t.cuts
    r = random.Random(3)
    some = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "é", "日", "1", "'s", ".", "▁", "<s>", "x y", "\r\n", "​", "\x1c", "\x85"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(1, 20))) for _ in range(1500)]
    known = L.Known(t)
    got = known.texts(texts)
    want = brute(two, list(enumerate(texts)))
    assert sorted(zip(range(len(texts)), *(got[c].tolist() for c in L.COUNTS), got["groups_sha256"], strict=True)) == sorted((i, n, m, g, k, h) for i, n, m, g, k, _, _, h in want)
    asked = []
    monkeypatch.setattr(L.Known, "_add", lambda self, new: asked.append(new))
    again = known.texts(texts[::-1])
    assert not asked and again["groups_sha256"] == got["groups_sha256"][::-1]
