"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance along directories.

Templates are statements, standard headers and whole license texts. Every line of a file, and every run of as many words as
a template has, whatever its lines, is compared with the templates; the one most like a template names the file's own
license. A whole license text goes before the statements in it, and any license before "All rights reserved". A license file,
by its name or because the statement makes up a good part of it, covers its directory. A file without a license of its own
inherits the nearest ancestor directory's: the distinct directories are joined with their ancestors by path.

Weights: ``log(1 + documents / documents with the word)``, counted over all documents for the words of the templates. A
word of no template weighs as much as a word of one document alone, so added text lowers the likeness.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import words as W
from llm.license_texts import HEADERS, TEXTS

# Statements by which files name their license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("All-Rights-Reserved", "All rights reserved."),
]
TEMPLATES += HEADERS + TEXTS
NOTICE = "All-Rights-Reserved"  # says nothing where a license is named
ALIKE, SHARE = 0.75, 0.25
WHOLE = 100  # words of a license text; its runs begin at every hundredth of its length, which changes no cosine by more than some hundredths
TOKEN = re.compile(rb"[0-9a-z]+(?:[.-][0-9a-z]+)*|[^\x00-\x7f]+")
FILE_NAME = r"(?i)(^|/)(licen[sc]es?|copying|notice)([.-][^/]*)?$"


def tokens(text: bytes) -> list[bytes]:
    return TOKEN.findall(text.lower())


def _vocabulary(templates) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(sorted({t for _, x in templates for t in tokens(x.encode())}))}


def _has_license_word(part: W.Slice, asked: np.ndarray) -> np.ndarray:
    h = part.hashes(lower=True)
    at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
    return np.flatnonzero(asked[at] == h)


def _hashes(words: list[bytes]) -> np.ndarray:
    parts = list(W.slices(pa.array([b" ".join(words).decode()]), between=_BETWEEN))
    return np.unique(np.concatenate([p.hashes(lower=True) for p in parts])) if parts else np.zeros(1, np.uint64)


_BETWEEN = np.array([b < 128 and not (chr(b).isalnum() or chr(b) in ".-") for b in range(256)])


def _trimmed(part: W.Slice) -> W.Slice:
    """The slice's words without stops and dashes at their ends; words of these alone are none."""
    start, end, row = part.start, part.end, part.row
    edge = np.isin(part.data, (45, 46))
    while len(start):
        first = edge[start]
        start = start + first
        keep = start < end
        start, end, row = start[keep], end[keep], row[keep]
        last = edge[end - 1]
        end = end - last
        if not first.any() and not last.any():
            break
    return W.Slice(part.first, part.rows, part.data, part.offsets, start, end, row, np.searchsorted(row, np.arange(part.rows + 1)))


def _places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among sorted ones, -1 for none."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def document_counts(files: DataFrame, templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that have each word of the templates."""
    vocabulary = _vocabulary(templates)

    def run(batches):
        names = list(vocabulary)
        asked = np.array([_hashes([t])[0] for t in names], np.uint64)
        order = np.argsort(asked)
        total, n = np.zeros(len(names), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in W.slices(batch.column("text"), between=_BETWEEN):
                words = _trimmed(part)
                place = _places(asked[order], words.hashes(lower=True))
                hit = place >= 0
                seen = np.unique(words.row[hit] * len(names) + order[place[hit]])
                total += np.bincount(seen % len(names), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *names]), pa.array([n, *total.tolist()], pa.int64())], ["word", "n"])

    rows = files.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts.pop(b"", 0), counts


def _has_license_word_loose(part: W.Slice, asked: np.ndarray) -> np.ndarray:
    """Words of the slice that are a template's word but for a stop at their end; one row counts a word once."""
    stripped = part.end - (part.data[part.end - 1] == 46) if len(part.end) else part.end
    keep = stripped > part.start
    trimmed = W.Slice(part.first, part.rows, part.data, part.offsets, part.start[keep], stripped[keep], part.row[keep], part.words)
    at = np.flatnonzero(keep)[_has_license_word(trimmed, asked)]
    if not len(at):
        return at
    h = trimmed.hashes(lower=True)[np.searchsorted(np.flatnonzero(keep), at)]
    order = np.lexsort((h, part.row[at]))
    r, h = part.row[at][order], h[order]
    first = np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))
    return at[order][first]


def _anchors(templates, idf: dict[bytes, float], alike: float) -> list[bytes]:
    """Words of which any line has one that is like a template: of each template the rarest, until what is left of its
    vector is too short for the likeness, since a line without them has at most that cosine."""
    anchors = set()
    for _, x in templates:
        weight = {t: (c * idf[t]) ** 2 for t, c in Counter(tokens(x.encode())).items()}
        left = total = sum(weight.values())
        for t in sorted(weight, key=lambda t: (-idf[t], t)):
            if left < alike * alike * total * (1 - 1e-9):
                break
            anchors.add(t)
            left -= weight[t]
    return sorted(anchors)


def scanned(files: DataFrame, templates=TEMPLATES, alike: float = ALIKE) -> DataFrame:
    """files(path, text, ...) with own_license, likeness and share (of the file's words that the statement has).

    Null or empty text: no license, likeness 0. Ties go to the
    first line, then the first template's run. Columns of any name
    are kept, but the three are replaced."""
    files = files.drop("own_license", "likeness", "share")
    n, counts = document_counts(files, templates)
    idf = {t: math.log(1 + n / max(1, counts.get(t, 0))) for t in _vocabulary(templates)}
    other = math.log(1 + n)
    short = [x for x in templates if len(tokens(x[1].encode())) < WHOLE]
    anchors = _anchors(short, idf, alike)

    def vector(words):
        v = {t: c * idf.get(t, other) for t, c in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    known = [(name, *vector(tokens(x.encode()))) for name, x in short]

    def best(line: bytes):
        v, size = vector(tokens(line))
        scores = [sum(x * u.get(t, 0.0) for t, x in v.items()) / (size * length) for _, u, length in known] if size else [0.0]
        k = max(range(len(scores)), key=lambda i: (round(scores[i], 9), -i))
        return scores[k], known[k][0]

    names = list(idf)

    def prepared():
        """Sorted hashes of the vocabulary, squares of its weights, and for each template: its name, what a word adds to the
        product, its length, its words and its anchors; the last weight is for other words."""
        hashes = np.array([_hashes([t])[0] for t in names], np.uint64)
        order = np.argsort(hashes)
        at = {names[k]: i for i, k in enumerate(order)}
        square = np.array([*(idf[names[k]] ** 2 for k in order), other**2])
        out = []
        for name, x in templates:
            words = tokens(x.encode())
            gain, some = np.zeros(len(square)), np.zeros(len(square), bool)
            for t, c in Counter(words).items():
                gain[at[t]] = c * square[at[t]]
            some[[at[t] for t in _anchors([(name, x)], idf, alike)]] = True
            out.append((name, gain, math.sqrt(vector(words)[1] ** 2), len(words), some))
        return hashes[order], square, out

    def runs(hashes, place, square, template):
        """The likeness of the run of words most like a template and its number of words; (0, 0) if none is alike."""
        name, gain, length, n, some = template
        n = min(n, len(place))
        step = max(1, n // 100) if n >= WHOLE else 1
        sums = lambda x: (lambda c: c[n:] - c[:-n])(np.concatenate(([0.0], np.cumsum(x))))[::step]
        product = sums(gain[place])
        # a word's repeats only lengthen a run's vector
        most = product / (np.sqrt(sums(square[place])) * length)
        top = 0.0
        for k in np.argsort(-most, kind="stable").tolist():
            if most[k] < alike - 1e-9 or most[k] <= top:
                break
            _, first, c = np.unique(hashes[k * step : k * step + n], return_index=True, return_counts=True)
            size = math.sqrt(float((square[place[k * step : k * step + n][first]] * c * c).sum()))
            top = max(top, product[k] / (size * length))
        return (top, n) if top >= alike else (0.0, 0)

    def run(batches):
        asked = _hashes(anchors)
        vocabulary, square, ready = prepared()
        for batch in batches:
            # rank: whole texts, then licenses, then notices
            out = [(0, 0.0, None, 0.0)] * batch.num_rows

            def take(at, score, name, share, text=False):
                rank = 3 if text else 1 if name == NOTICE else 2
                if score >= alike and (rank, score) > (out[at][0], out[at][1] + 1e-9 * (rank == out[at][0])):
                    out[at] = (rank, score, name, share)

            for part in W.slices(batch.column("text"), between=_BETWEEN):
                newline = np.flatnonzero(part.data == 10)
                seen = set()
                for k in sorted(_has_license_word_loose(part, asked).tolist()):
                    row = int(part.row[k])
                    a, b = part.offsets[row], part.offsets[row + 1]
                    i = np.searchsorted(newline, part.start[k])
                    begin = max(a, newline[i - 1] + 1 if i else 0)
                    end = min(b, newline[i] if i < len(newline) else b)
                    if (row, begin) in seen:
                        continue
                    seen.add((row, begin))
                    score, name = best(part.data[begin:end].tobytes())
                    inside = np.searchsorted(part.start, (begin, end))
                    take(part.first + row, score, name, float(inside[1] - inside[0]) / max(1, int(part.words[row + 1] - part.words[row])))
                words = _trimmed(part)
                hashes = words.hashes(lower=True)
                place = _places(vocabulary, hashes)  # -1 is the last weight
                for template in ready:
                    for row in np.unique(words.row[template[4][place]]).tolist():
                        a, b = words.words[row], words.words[row + 1]
                        score, n = runs(hashes[a:b], place[a:b], square, template)
                        take(part.first + row, score, template[0], n / max(1, b - a), template[3] >= WHOLE)
            columns = [[x[2] for x in out], [x[1] for x in out], [x[3] for x in out]]
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], ["whole", "own_license", "likeness", "share"])

    whole = files.select(F.struct("*").alias("whole"), "text")
    kind = f"whole {whole.schema['whole'].dataType.simpleString()}, own_license string, likeness double, share double"
    return whole.mapInArrow(run, kind).select("whole.*", "own_license", "likeness", "share")


def directory(path: Column) -> Column:
    """The part of a path before its last slash; '' for none."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(found: DataFrame, share: float = SHARE) -> DataFrame:
    """found(path, own_license, likeness, share, ...) with license and inherited_from.

    A directory with several license files has the license of the most alike, then of the least path. Null path: no
    directory, own license alone. The root directory is ''."""
    found = found.drop("license", "inherited_from").withColumn("_directory", directory(F.col("path")))
    is_file = F.col("own_license").isNotNull() & ((F.col("share") >= share) | F.col("path").rlike(FILE_NAME))
    rank = F.struct((-F.round("likeness", 9)).alias("l"), "path", F.col("own_license").alias("name"))
    covers = found.where(is_file & F.col("_directory").isNotNull()).groupBy("_directory").agg(F.min(rank).alias("best")).select(F.col("_directory").alias("above"), F.col("best.name").alias("license"))
    parts = F.split("_directory", "/")
    steps = F.when(F.col("_directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    ancestors = found.select("_directory").where("_directory IS NOT NULL").distinct().select("_directory", F.explode(F.array_distinct(steps)).alias("above"))
    nearest = ancestors.join(covers, "above").groupBy("_directory").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "license")).alias("n"))
    out = found.join(nearest, "_directory", "left")
    own = F.col("own_license").isNotNull()
    out = out.withColumn("license", F.coalesce("own_license", "n.license")).withColumn("inherited_from", F.when(~own, F.col("n.above")))
    return out.drop("n", "_directory")


def license_query(docs: DataFrame) -> DataFrame:
    """Documents as files <source>/<lang>/<doc_id>."""
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "/", "_"), F.lit("_"))
    files = docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    out = inherited(scanned(files).drop("text"))
    return out.select("doc_id", "path", "own_license", F.round("likeness", 6).alias("likeness"), "license", "inherited_from")
