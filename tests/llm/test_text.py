"""BPE, winnowing, words and signals against plain Python."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from llm import bpe, perplexity, signals, winnow
from llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    r = random.Random(5)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    out = ["", " ", "I'll we'RE don't 'S 123 a.b", "x<|endoftext|>y <|startoftext|>", "ΟΔΟΣ İstanbul Ǆ ﬁ é", "\x85\xa0​　", "ab" * 2000]
    return out + ["".join(chr(r.choice(points) if r.random() < 0.4 else r.randrange(32, 400)) for _ in range(50)) for _ in range(400)]


def test_bpe_is_the_library(spark, docs):
    rows = list(enumerate(texts())) + [(10_000 + r.doc_id, r.text) for r in docs.collect()] + [(None, None)]
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    t = library()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), repr(x)[:80]


def test_bpe_parts(spark, odd, empty):
    ids = bpe.encoded(odd, PATH)
    t = library()
    want = sorted(str(t.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    assert sorted(str(r.ids) for r in ids.collect()) == want
    back = bpe.decoded(ids, PATH).collect()
    assert sorted(r.text for r in back) == sorted(t.decode(r.ids, skip_special_tokens=False) for r in ids.collect())
    assert bpe.round_trip(empty, PATH).count() == 0 and bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_marks_are_windows():
    r = random.Random(3)
    for n in [0, 1, 5, 23, 24, 25, 47, 48, 200]:
        text = "".join(r.choice("ab") for _ in range(n))
        h, at = winnow.marks(text, 8, 6)
        every = winnow.gram_hashes(text, 8)
        w, want = min(6, len(every)), []
        for a in range(len(every) - w + 1 if len(every) else 0):
            p = a + max(j for j in range(w) if every[a + j] == every[a : a + w].min())
            want += [p] if not want or want[-1] != p else []
        assert at.tolist() == want and (h == every[at]).all()


def test_winnow_guarantee():
    common = "a passage that both texts hold for sure."
    a, b = winnow.marks("xyz" * 9 + common + "1234567", 8, 6)[0], winnow.marks("other " + common + "!", 8, 6)[0]
    assert set(a.tolist()) & set(b.tolist())


def test_edited(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()][:150] + [(None, "null id"), (-5, None), (10**9, "")]
    got = {r.doc_id: r for r in winnow.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_part=20).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, x), (_, y) in zip(order, order[1:] + order[:1], strict=True):
        x, y = x or "", y or ""
        e = x[: len(x) - len(x) // 4] + y[: len(x) // 4]
        a, b, c = (np.unique(winnow.marks(t, 24, 24)[0]) for t in (x, e, y))
        assert got[i].n_chars == len(x) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (got[i].near_edited, got[i].near_next) == (winnow.likeness(a, b), winnow.likeness(a, c))


def test_winnow_odd(odd, empty):
    got = winnow.edited(odd, per_part=3).collect()
    assert len(got) == 12 and len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert winnow.edited(empty).count() == 0
    assert winnow.fingerprints(odd).columns == [*odd.columns, "marks"]


def test_words_and_signals():
    r = random.Random(9)
    some = ["", None, "\n\n", "a\n a\na\n", "x y z x y z", "é# $%|<>& é#", "a  b\t\x0bc\x85d"] + ["".join(r.choice("ab# \n\té") for _ in range(r.randrange(80))) for _ in range(300)]
    for limit in (7, 1 << 20):
        at = 0
        for part in W.slices(pa.array(some), limit):
            base = signals.base(part)
            for i in range(part.rows):
                x = some[at] or ""
                at += 1
                w = WORD.findall(x)
                seen, dup, cover = set(), 0, set()
                for line in x.split("\n"):
                    if WORD.search(line):
                        dup += line in seen
                        seen.add(line)
                windows = list(zip(w, w[1:], w[2:]))
                for k, g in enumerate(windows):
                    cover |= {k, k + 1, k + 2} if windows.count(g) > 1 else set()
                assert [base[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover)], repr(x)
        assert at == len(some)


def test_kneser_ney(spark):
    """The model against its formulas on a small corpus; every context's probabilities add up to 1."""
    from collections import Counter, defaultdict

    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefg") for _ in range(30)), "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = perplexity.train(df)
    pairs = Counter(p for _, t, _ in rows for p in zip(t.split(), t.split()[1:]))
    words = sorted({w for _, t, _ in rows for w in t.split()})
    of = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    into = Counter(w for _, w in pairs)
    d2, d1 = perplexity._discounts(*of(pairs)), perplexity._discounts(*of(into))
    less = lambda n, d: d[min(n, 3) - 1]
    types, size = sum(into.values()), len(words) + 1
    left = sum(min(n, less(n, d1)) for n in into.values())
    uni = {w: max(0, into[w] - less(into[w], d1)) / types + left / types / size for w in words}
    total = defaultdict(int)
    for (v, _), n in pairs.items():
        total[v] += n
    text = rows[0][1].split()
    backoff = {v: 1 - sum(max(0, n - less(n, d2)) for (a, _), n in pairs.items() if a == v) / total[v] for v in words}
    log = np.log(uni[text[0]])
    for v, w in zip(text, text[1:]):
        n = pairs[v, w]
        log += np.log(max(0, n - less(n, d2)) / total[v] + backoff[v] * uni[w] if n else backoff[v] * uni[w])
    got = perplexity.signals(df.where("doc_id = 0"), m).first().log_ppl
    assert abs(got + log / 30) < 1e-4
    for v in words:
        p = sum(max(0, pairs[v, w] - less(pairs[v, w], d2)) / total[v] + backoff[v] * uni[w] if pairs[v, w] else backoff[v] * uni[w] for w in words)
        assert abs(p + backoff[v] * left / types / size - 1) < 1e-9


def test_rules(odd, empty, docs):
    got = perplexity.rules(odd).collect()
    assert len(got) == 12 and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert perplexity.rules(empty).count() == 0
    rows = perplexity.rules(docs).collect()
    assert sum(r.kept for r in rows) > 0.9 * sum(not r.base_failed for r in rows)


def test_every_word_and_pair_counts(spark):
    """What is sent to the tasks changes no probability, and texts of rare words are improbable."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    plain = [word() for _ in range(300)]
    # a real corpus has a tail of rare words, so each text has some of its own
    texts = [" ".join(word() if r.random() < 0.05 else r.choice(plain[: r.choice((20, 300))]) for _ in range(120)) for _ in range(300)]
    junk = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [(i, t, "en") for i, t in enumerate(texts + junk)]
    df = spark.createDataFrame([*rows, rows[0], rows[1]], "doc_id long, text string, lang string").repartition(5)
    got = [{(x.doc_id, x.log_left) for x in perplexity.signals(df, perplexity.train(df, *size), True).collect()} for size in ((19, 22), (8, 6), (0, 0))]
    for other in got[1:]:
        assert len(got[0]) == len(other) == 306 and all(abs(a[1] - b[1]) < 1e-4 for a, b in zip(sorted(got[0]), sorted(other)))
    m = perplexity.train(df, 8, 6)
    assert m.pairs.where("v != 0").count() == len({p for t in texts + junk for p in zip(t.split(), t.split()[1:])})
    assert m.words.count() <= len({w for t in texts + junk for w in t.split()})
    log = dict(got[1])
    assert min(log[i] for i in range(300, 306)) > max(log[i] for i in range(300))
    kept = {x.doc_id: x.kept for x in perplexity.rules(df).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 306))


def test_model_grows_with_the_corpus(spark):
    """Pairs and words in Spark grow in proportion; only what is sent to the tasks has a bound."""
    rows = [(i, " ".join(f"a{i * 50 + k} b" for k in range(50)), "en") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small, large = (perplexity.train(x, 4, 4) for x in (df.where("doc_id < 40"), df))
    assert [m.pairs.where("v != 0").count() for m in (small, large)] == [40 * 99, 80 * 99]
    assert [m.words.count() for m in (small, large)] == [40 * 49 + 1, 80 * 49 + 1]
    assert all(len(m.vocabulary) <= 16 and len(m.keys) <= 16 for m in (small, large))
