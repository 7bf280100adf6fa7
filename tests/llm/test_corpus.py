"""Line dedup, mixing, sharding, classifiers, licenses and the pipeline on small tables."""

import collections
import importlib
import random
import sys
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from llm import licenses, linededup, mixing, quality, sharding, toxicity
from llm.queries import QUERIES, SQL


def lines_of(text):
    return text.split("\n") if text else []


def test_repeated_passages_go(spark):
    r = random.Random(4)
    line = lambda n: " ".join(f"v{r.randrange(10**7)}" for _ in range(n))
    block, long = [line(12) for _ in range(12)], line(60)
    rows = []
    for i in range(30):
        own = [line(9) for _ in range(6)]
        at = r.randrange(7)
        rows.append((i, "\n".join(own[:at] + (block if i % 3 == 0 else [long] if i % 3 == 1 else []) + own[at:])))
    got = {x.doc_id: x for x in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert sum(long in x.text for x in got.values()) == 1 and long in got[1].text
    count = collections.Counter(ln for x in got.values() for ln in lines_of(x.text) if ln in block)
    assert sum(v == 1 for v in count.values()) >= 6  # all but the chunks at the passage's ends
    for i, t in rows:
        kept = lines_of(got[i].text)
        assert [ln for ln in lines_of(t) if ln not in block and ln != long] == [ln for ln in kept if ln not in block and ln != long] or got[i].n_removed
        assert len(lines_of(t)) - len(kept) == got[i].n_removed
        if i % 3 == 2:
            assert got[i].text == t


def test_short_passages_go_whole(spark):
    """Passages of 2 to 8 lines between other lines: every line of the second copy goes, single lines and equal lines stay."""
    r = random.Random(5)
    line = lambda n: " ".join(f"u{r.randrange(10**7)}" for _ in range(n))
    rows, want, some = [], {}, line(8)
    for k in range(2, 9):
        for j in range(6):
            passage = [line(9) for _ in range(k)]
            if j == 0:
                passage.insert(1, "")
            for copy in (0, 1):
                before, after = [line(7) for _ in range(r.randrange(3, 13))], [line(7), some, *(line(7) for _ in range(r.randrange(3, 13)))]
                i = len(rows)
                rows.append((i, "\n".join(before + passage + after)))
                want[i] = "\n".join(before + after) if copy else rows[-1][1]
    rows += [(1000, "x y\n" * 5 + "end"), (1001, "only\n\nx y\nz\nx y")]
    want |= {1000: "x y\nx y\nend", 1001: rows[-1][1]}
    got = {x.doc_id: x.text for x in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_line_dedup_odd(odd, empty):
    got = linededup.without_repeats(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == 12
    assert all(r.text is not None and r.text.startswith("word0") for r in rows if r.doc_id in (5, 7)) and all(r.text == "" for r in rows if r.doc_id == 6)
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert linededup.without_repeats(empty).count() == 0


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Excess reshared by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: cap * sizes[s] if s in full else w[s] * left / sum(w[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and share[s] > cap * sizes[s]}
        if not over:
            return share
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 7}, {"x": 5}, {"a": 1, "b": 1, "c": 1, "d": 100000}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    for s, t in targets(sizes).items():
        assert abs(got[s] - t) <= 1e-9 * max(1, t)


def test_mix(spark, docs, odd, empty):
    rows = mixing.mix_query(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
        assert r.taken <= 3 * r.size
    for (target, _), some in by.items():
        assert abs(sum(r.taken for r in some) - target) <= 2 * max(r.size for r in some)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_query(docs.repartition(5)).collect()))
    assert len(mixing.mix_query(odd).collect()) == 12 and mixing.mix_query(empty).count() == 0
    mixed = mixing.mixed(docs)
    taken = {r.doc_id: r.taken // r.size for r in rows if r.size}
    got = collections.Counter(r.doc_id for r in mixed.select("doc_id", "n_chars").where("n_chars > 0").collect())
    assert mixed.columns == docs.columns and all(got[i] == n for i, n in taken.items())
    again = mixing.mixed(odd)
    assert again.columns == odd.columns and again.where("doc_id = 8").count() <= 3 and mixing.mixed(empty).count() == 0


def test_shards(spark, docs, odd, empty):
    rows = sharding.shard_query(docs.repartition(6)).collect()
    size = collections.Counter(r.shard for r in rows)
    assert max(size.values()) - min(size.values()) <= 1 and set(size) == set(range(8))
    for s, n in size.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)
    got = sharding.sharded(odd, 5)
    assert got.columns == [*odd.columns, "shard", "slot"] and got.count() == 12 and got.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert sharding.sharded(empty).count() == 0


def test_matrix_is_hypergeometric():
    counts = [100, 0, 37, 5]
    cells = collections.Counter()
    for seed in range(400):
        m = sharding.matrix(counts, 3, seed)
        assert [sum(r) for r in m] == counts and sorted(map(sum, zip(*m))) == [47, 47, 48]
        cells[m[0][0]] += 1
    mean = sum(k * v for k, v in cells.items()) / 400
    var = sum((k - mean) ** 2 * v for k, v in cells.items()) / 400
    n, good = 142, 48
    assert abs(mean - 100 * good / n) < 0.6 and 0.6 < var / (100 * good / n * (1 - good / n) * 42 / 141) < 1.5


def test_shuffle_is_uniform(spark):
    """Rows of one partition spread over the shards and slots without a trend."""
    rows = spark.range(4000).repartition(4).selectExpr("id AS doc_id")
    got = sharding.sharded(rows, 4).collect()
    first = sum(r.slot for r in got if r.doc_id < 1000) / 1000
    assert abs(first - 499.5) < 40


@pytest.mark.parametrize("name,label,floor", [("op3_bradley_terry_quality", "quality", 0.97), ("op5_ftrl_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, floor):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", label, "score").collect()
    assert len(got) > 500 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r[label] for r in got) / len(got) >= floor
    clean = [r for r in got if r[label] == (0 if label == "toxic" else 1)]
    assert sum(r.predicted == r[label] for r in clean) / len(clean) >= 0.98


@pytest.mark.parametrize("module,keep", [(toxicity, 0), (quality, 1)])
def test_classifiers_odd(spark, odd, empty, module, keep):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (8, 0), (None, 1), (9, None), (5, 1)], "doc_id long, label int")
    model = module.fit(odd, labels)
    got = module.scored(odd, model)
    assert got.columns == [*odd.columns, "score"] and all(0 <= r.score <= 1 for r in got.collect()) and got.count() == 12
    none = module.fit(odd, labels.where("false"))
    assert all((r.score >= 0.5) == bool(keep) for r in module.scored(odd, none).collect())
    assert module.scored(empty, model).count() == 0


def test_held_out_labels_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.toxic_query(docs, x).collect())) for x in (labels, flipped))
    assert one == two
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h, _, _ in one)


def test_licenses(spark, odd, empty):
    rows = [
        ("p/LICENSE", "Licensed under the Apache License, Version 2.0."), ("p/a/x.py", "code here\nand there"), ("p/a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("p/a/b/y.py", "text\nReleased under the MIT License.\nmore text and more text"), ("p/a/b/c/z.py", None), ("q/w.py", "nothing said"), ("top.py", ""), (None, "All rights reserved."), ("p/v.py", "a license is a thing of the past"),
    ]
    got = {r.path: r for r in licenses.inherited(licenses.scanned(spark.createDataFrame(rows, "path string, text string"))).collect()}
    assert got["p/LICENSE"].own_license == "Apache-2.0" and got["p/a/b/y.py"].own_license == "MIT" and got[None].license == "All-Rights-Reserved"
    assert (got["p/a/x.py"].license, got["p/a/x.py"].inherited_from) == ("GPL-3.0", "p/a") and got["p/a/b/c/z.py"].license in ("GPL-3.0", "MIT")
    assert got["p/v.py"].own_license is None and got["p/v.py"].license == "Apache-2.0" and got["q/w.py"].license is None and got["top.py"].license is None
    assert len(licenses.license_query(odd).collect()) == 12 and licenses.license_query(empty).count() == 0


def test_frequent_license_is_found(spark):
    """A statement that a third of the documents carry, so that all of its words are frequent, beside a rare one."""
    said = "Licensed under the Apache License, Version 2.0."
    rows = [(f"d{i}/a.py", f"some code {i}\n{said if i % 3 == 0 else 'Released under the MIT License.' if i == 1 else 'x'}\nmore of it") for i in range(600)]
    rows += [("d0/sub/b.py", "nothing")]
    got = {r.path: r for r in licenses.inherited(licenses.scanned(spark.createDataFrame(rows, "path string, text string")), share=0.2).collect()}
    assert [got[f"d{i}/a.py"].own_license for i in range(600)] == ["Apache-2.0" if i % 3 == 0 else "MIT" if i == 1 else None for i in range(600)]
    assert got["d0/sub/b.py"].license == "Apache-2.0"


def test_license_texts_and_headers(spark):
    """Headers with copyright notices, wrapped lines, whole license files with a few changes; prose names no license."""
    texts = dict(licenses.TEXTS)
    comment = lambda t, n, mark: "\n".join(f"{mark} {' '.join(t.split()[i : i + n])}" for i in range(0, len(t.split()), n))
    header = dict(reversed(licenses.HEADERS))
    want = {
        "one": ("Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), "two": ("Copyright (c) 2021 Jane Doe. All rights reserved.", "All-Rights-Reserved"),
        "three": ("x = 1\n# Copyright (c) 2021 Jane Doe\n# Licensed under the MIT License\ny = 2", "MIT"), "four": ("/*\n" + comment(header["Apache-2.0"], 7, " *") + "\n */\ncode " * 30, "Apache-2.0"),
        "five": (comment("Copyright 2001 A. All rights reserved. " + header["GPL-3.0"], 9, "--") + "\nselect 1" * 30, "GPL-3.0"), "six": (comment(header["LGPL-2.1"], 8, "//"), "LGPL-2.1"),
        "prose": ("the license to print was under all that a version of the rights of man reserved for the public " * 9, None),
    } | {n: (f"Copyright (c) 1999 Some Body and others\nAll rights reserved.\n\n{t}\n\nOur own remark ends it.", n) for n, t in texts.items()}
    rows = [(k, t) for k, (t, _) in want.items()] + [(f"f{i}", f"plain words {i} of some text about the weather") for i in range(50)]
    got = {r.path: r for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: got[k].own_license for k in want} == {k: n for k, (_, n) in want.items()}
    assert all(got[n].share > 0.8 for n in texts) and all(got[f"f{i}"].own_license is None for i in range(50))


def test_sql_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    for name, sql in SQL.items():
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(cur.fetchall()) == sorted(tuple(r[c] for c in names) for r in QUERIES[name](spark, sf).collect())


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as C

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    now, seen = docs, []
    for name, stage in C.STAGES:
        now = stage(spark, now, sf)
        now = now.cache()
        seen.append((name, now.count()))
        if name != C.STAGES[-1][0]:
            assert now.dtypes == docs.dtypes
        if name == "toxicity":
            left = {r.doc_id for r in now.collect()}
            assert all(i in left for i, y in labels.items() if y == 0)
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    counts = dict(seen)
    assert counts["line_dedup"] == counts["toxicity"] > counts["jaccard_join"] > 0
    assert sorted(map(tuple, C.run(spark, sf).collect())) == sorted(map(tuple, now.collect()))


def test_registry_without_the_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m.split(".")[0] in ("llm", "corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "op1_jaccard_components" not in entry.queries() and len(entry.queries()) > 100
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_stages_keep_clashing_columns(spark, sf, odd, empty):
    import corpus_pipeline as C

    more = odd.selectExpr("*", "'mine' AS score", "7 AS n_lines", "'k' AS key", "'b' AS body", "'g' AS gone")
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, more, sf)
        assert got.columns == more.columns, name
        assert {(r.score, r.n_lines, r.key, r.body, r.gone) for r in got.collect()} == {("mine", 7, "k", "b", "g")}, name
        assert stage(spark, empty, sf).count() == 0, name
    assert C.STAGES[-1][1](spark, more, sf).count() == 12


def test_quality_counts_every_labelled_row(spark):
    """More labelled rows than were once sampled: means, ranks and quantile are those of all of them."""
    n = 20_600
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word, "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("label"))
    whole = quality.measured(docs.select(F.struct("doc_id").alias("whole"), "text"))
    mean = whole.agg(*[F.avg(F.col("x")[i]) for i in range(len(whole.first().x))]).first()
    got = quality.fit(docs, labels)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got.mean, mean))
    rows = labels.select("label", F.xxhash64("doc_id").alias("place"))
    nth = {}
    for r in quality.numbered(rows, 100_000 * n).orderBy("place").collect():
        assert r.nth == nth.get(r.label, 0)
        nth[r.label] = r.nth + 1
    scores = spark.range(n).select(F.when(F.col("id") == 5, 1e9).otherwise(F.col("id") * F.col("id") % 9973 / 7.0).alias("s"))
    for share in (0.0, 0.14, 0.5, 1.0):
        assert quality.quantile(scores, share) == pytest.approx(scores.agg(F.percentile("s", F.lit(share))).first()[0], rel=1e-12)
