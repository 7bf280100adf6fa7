"""Damage and repair of conversations: weighted CYK parsing of role sequences under a repair grammar.

The repaired roles of a conversation must read ``(s?(ua)+)?`` by their initials. The grammar's symbols name what a span of
rows can be repaired to: nothing (``-``), or an alternating run by its first and last role, with or without a leading
system row. They are closed under cutting a word anywhere, so the binary rules of the Chomsky normal form are complete for
every split of a span, and a chart only needs one split per span: spans of 1, 2, 4, ... rows are combined bottom-up. A cell
holds the least ``(cost, audit)`` of its symbol. Row cells are closed under insertion on either side.

Taking the ASCII-least audit of a span is safe: two audits of one span with one cost are never prefixes of one another (the
longer one would have one insertion more, and so cost more), so concatenation keeps their order.

Rows are range-partitioned by (conversation, turn, role, text): a conversation of any length spreads over tasks. A task
parses each stretch that it holds; stretches of one conversation (one per task at most) are combined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.store import written

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: What a span is repaired to: nothing, a system row alone, runs by first and last role, runs behind a system row.
SYMBOLS = ("-", "s", "uu", "ua", "au", "aa", "su", "sa")
ACCEPTED = tuple(SYMBOLS.index(x) for x in ("-", "ua", "sa"))
WHOLE = 8 << 20  # bytes of text up to which a conversation is hashed where it is parsed
CELLS = "array<struct<cost:long,audit:string>>"
PART = f"kind string, conv_id long, part int, place long, role string, text string, copies long, first_turn long, last_turn long, turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, rows long, cells {CELLS}, audit string, digest string"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _rules() -> list[tuple[int, int, int]]:
    """(out, left, right) for every two symbols whose words may stand side by side."""
    out = []
    for i, x in enumerate(SYMBOLS):
        for j, y in enumerate(SYMBOLS):
            if x == "-" or y == "-":
                out.append((j if x == "-" else i, i, j))
            elif y[0] != "s" and (y[0] == "u" if x[-1] in "sa" else y[0] == "a"):
                out.append((SYMBOLS.index(x[0] + y[-1]), i, j))
    return out


RULES = _rules()
Cell = tuple[int, str]
Cells = list[Cell | None]


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans as one."""
    out: Cells = [None] * len(SYMBOLS)
    for o, i, j in RULES:
        x, y = left[i], right[j]
        if x is not None and y is not None:
            cost = x[0] + y[0]
            if out[o] is None or cost < out[o][0] or (cost == out[o][0] and x[1] + y[1] < out[o][1]):
                out[o] = (cost, x[1] + y[1])
    return out


_INSERTED: Cells = [None] * len(SYMBOLS)
_INSERTED[SYMBOLS.index("uu")] = _INSERTED[SYMBOLS.index("aa")] = (INSERT, "I")


def closed(cells: Cells) -> Cells:
    """cells with any number of inserted rows before and after."""
    while True:
        wider = [min((c for c in some if c is not None), default=None) for some in zip(cells, combined(_INSERTED, cells), combined(cells, _INSERTED), strict=True)]
        if wider == cells:
            return cells
        cells = wider


@lru_cache(maxsize=64)
def row_cells(initial: str, cut: bool) -> Cells:
    """One row that may stay: kept as what it is, given a role, or deleted; one that is cut off costs more if it stays."""
    cells: Cells = [None] * len(SYMBOLS)
    cells[0] = (DELETE, "D")
    for name, letter in (("uu", "u"), ("aa", "a")):
        cells[SYMBOLS.index(name)] = (KEEP + CUT * cut, "K") if initial == letter else (REROLE + CUT * cut, "R")
    if initial == "s":
        cells[SYMBOLS.index("s")] = (KEEP + CUT * cut, "K")
    return closed(cells)


@lru_cache(maxsize=64)
def deleted_cells(rows: int) -> Cells:
    """Rows that have to go."""
    cells: Cells = [None] * len(SYMBOLS)
    cells[0] = (DELETE * rows, "D" * rows)
    return closed(cells)


class Chart:
    """Cells of a growing span: neighbouring spans of one length are combined into one of twice the length."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cells]] = []

    def add(self, cells: Cells) -> None:
        size = 1
        while self.spans and self.spans[-1][0] == size:
            cells = combined(self.spans.pop()[1], cells)
            size *= 2
        self.spans.append((size, cells))

    def cells(self) -> Cells:
        out: Cells = [None] * len(SYMBOLS)
        out[0] = (0, "")
        for _, cells in reversed(self.spans):
            out = combined(cells, out)
        return out


def best(cells: Cells) -> Cell:
    return min(cells[k] for k in ACCEPTED if cells[k] is not None)


@lru_cache(maxsize=1 << 16)
def _short(kinds: tuple) -> tuple:
    chart = Chart()
    for forced, initial, cut, rows in kinds:
        _add(chart, forced, initial, cut, rows)
    return tuple(chart.cells())


def _add(chart: Chart, forced: bool, initial: str, cut: bool, rows: int) -> None:
    """rows equal rows: the first may stay unless it is forced out, the others repeat it."""
    if not forced:
        chart.add(row_cells(initial if initial in ("s", "u", "a") else "", cut))
    if rows > (not forced):
        chart.add(deleted_cells(rows - (not forced)))


class Writer:
    """Digest of the repaired ``role:text`` lines, row by row."""

    def __init__(self) -> None:
        self.digest, self.any, self.user_next = hashlib.sha256(), False, True

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def edit(self, letter: str, role: str, text: str) -> None:
        if letter == "D":
            return
        if letter == "K" and role[:1] == "s":
            self.put(role, text)
            return
        own = "user" if self.user_next else "assistant"
        self.put(role if letter == "K" else own, "" if letter == "I" else text)
        self.user_next = not self.user_next

    def row(self, audit: str, at: int, role: str, text: str, copies: int) -> int:
        """The edits of one row and its copies, from place at of the audit; returns the place behind them."""
        for _ in range(copies):
            while audit[at] == "I":
                self.edit("I", "", "")
                at += 1
            self.edit(audit[at], role, text)
            at += 1
        return at

    def rest(self, audit: str, at: int) -> None:
        for letter in audit[at:]:
            self.edit(letter, "", "")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage by the CRC-32 of ``conv_id:turn``; a dropped row has no
    copies, a repeated one two. Nulls are one space; copies of one (conv_id, turn, role, text) are one row."""
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    spelt = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(spelt) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    after = clean.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return after.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of the repair, a mark before each first one of its role and text."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), F.unhex(F.md5("text")).alias("h"), "text", "copies", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    first = rows.where("copies > 0").groupBy("conv_id", "role", "head", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("m"))
    first = first.select("conv_id", F.col("m.turn").alias("turn"), "role", "head", "h", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("cut"))
    order = ["conv_id", "turn", "role", "head", "h"]
    both = rows.union(first).repartitionByRange(*order).sortWithinPartitions(*order, F.col("copies").isNotNull())
    return both.select("conv_id", "turn", "role", "text", "copies", "blank", "cut")


class _Stretch:
    """What a task knows of the rows it holds of one conversation."""

    def __init__(self, conv, part: int, whole: bool) -> None:
        self.conv, self.part, self.whole = conv, part, whole
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.first_role, self.last_role = None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.kinds: list[tuple] = []
        self.chart: Chart | None = None
        self.held: list[tuple[str, str, int]] = []
        self.bytes, self.rows, self.places = 0, 0, 0

    def add(self, turn, role: str, text: str, copies: int, blank: bool, cut: bool, first: bool) -> None:
        if turn is not None:
            self.turns += self.last_turn != turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = role[:1]
        if self.last_role is not None:
            self.counts["illegal"] += self.last_role + initial not in ("su", "ua", "au")
        self.first_role = initial if self.first_role is None else self.first_role
        self.last_role = initial
        self.counts["illegal"] += copies - 1
        forced = blank or not first
        cut = cut and not forced
        self.counts["blank"] += copies if blank else 0
        self.counts["duplicate"] += 0 if blank else copies - first
        self.counts["truncated"] += cut
        self.rows += copies
        kind = (forced, initial, cut, copies)
        if self.chart is None:
            self.kinds.append(kind)
            if len(self.kinds) > 64:
                self.chart = Chart()
                for k in self.kinds:
                    _add(self.chart, *k)
        else:
            _add(self.chart, *kind)
        self.held.append((role, text, copies))
        self.bytes += len(text)

    def cells(self) -> Cells:
        return list(_short(tuple(self.kinds))) if self.chart is None else self.chart.cells()

    def spilled(self) -> Iterator[dict]:
        """The rows held so far, to be hashed when the whole conversation is known."""
        for role, text, copies in self.held:
            yield {"kind": "row", "conv_id": self.conv, "part": self.part, "place": self.places, "role": role, "text": text, "copies": copies}
            self.places += 1
        self.held = []

    def done(self) -> Iterator[dict]:
        base = {"conv_id": self.conv, "part": self.part, "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns, "first_role": self.first_role, "last_role": self.last_role, "rows": self.rows} | self.counts
        if self.whole:
            cost, audit = best(self.cells())
            out, at = Writer(), 0
            for role, text, copies in self.held:
                at = out.row(audit, at, role, text, copies)
            out.rest(audit, at)
            yield {"kind": "whole", "cells": [{"cost": cost, "audit": audit}], "audit": audit, "digest": out.digest.hexdigest()} | base
        else:
            yield from self.spilled()
            yield {"kind": "stretch", "cells": [None if c is None else {"cost": c[0], "audit": c[1]} for c in self.cells()]} | base


def _parser(limit: int):
    """Stretches of sorted rows. A conversation that may go on in the next or began in the last task, or that is long, is
    left open: its rows travel on with its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: _Stretch | None = None
        out: list[dict] = []
        fresh, size, begun = False, 0, False
        for batch in batches:
            for conv, turn, role, text, copies, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.extend(now.done())
                    now, begun = _Stretch(conv, part, whole=begun), True
                if copies is None:
                    fresh = True
                    continue
                if copies:
                    now.add(turn, role, text, copies, blank, cut, fresh)
                    size += len(text)
                fresh = False
                if now.bytes > limit:
                    now.whole = False
                if not now.whole and len(now.held) >= 500:
                    out.extend(now.spilled())
                if len(out) >= 2000 or size > limit:
                    yield _table(out)
                    out, size = [], 0
        if now is not None:
            now.whole = False
            out.extend(now.done())
        if out:
            yield _table(out)

    return run


_ARROW = pa.schema(
    [("kind", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
    + [("turns", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("rows", pa.int64())]
    + [("cells", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))), ("audit", pa.string()), ("digest", pa.string())]
)


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else min(last - first + 1 - turns, (1 << 63) - 1)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The stretches of one conversation, one per task at most, as one; and the audit cut into their pieces."""
    parts = pdf.sort_values("part").to_dict("records")
    cells: Cells = [(0, "")] + [None] * (len(SYMBOLS) - 1)
    first = last = role = None
    turns, sums = 0, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for p in parts:
        cells = combined(cells, [None if c is None else (c["cost"], c["audit"]) for c in p["cells"]])
        if not pd.isna(p["first_turn"]):
            turns += int(p["turns"]) - (last == int(p["first_turn"]))
            first = int(p["first_turn"]) if first is None else first
            last = int(p["last_turn"])
        for k in sums:
            sums[k] += int(p[k])
        if p["first_role"] is not None:
            sums["illegal"] += role is not None and role + p["first_role"] not in ("su", "ua", "au")
            role = p["last_role"]
    cost, audit = best(cells)
    out, at = [], 0
    for p in parts:
        left, start = int(p["rows"]), at
        while left:
            left -= audit[at] != "I"
            at += 1
        if p is parts[-1]:
            at = len(audit)
        out.append({"conv_id": p["conv_id"], "part": p["part"], "audit": audit[start:at], "gaps": _gaps(first, last, turns), "cost": cost, "rows": p["rows"]} | sums)
    return pd.DataFrame(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation from rows sorted by (conv_id, part, place); a piece of the audit leads its part."""
    conv, writer, audit, at, seen = None, None, "", 0, False
    for batch in batches:
        out = []
        for c, place, role, text, copies, piece in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not seen or c != conv:
                if seen:
                    writer.rest(audit, at)
                    out.append((conv, writer.digest.hexdigest()))
                conv, writer, audit, at, seen = c, Writer(), "", 0, True
            if place < 0:
                writer.rest(audit, at)
                audit, at = piece, 0
            else:
                at = writer.row(audit, at, role, text, copies)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["conv_id", "digest"])
    if seen:
        writer.rest(audit, at)
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([writer.digest.hexdigest()])], ["conv_id", "digest"])


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows(conv_id, turn, role, text): faults, cheapest repair and digest of the repaired text.

    * ``rows`` is what is to be repaired, with ``copies`` (see ``damaged``); a conversation whose rows all have no copies
      keeps its conv_id, with zeros, an empty audit and the digest of nothing
    * order: turn with nulls first; ties by role, then by text (its first 64 characters, then its MD5)
    * a null conv_id is a conversation of its own; null role or text is one space, and so blank text or no known role
    * equal rows are one row with many copies until its edits are written, however many there are
    * gaps of turns that leave the range of long are held at its end

    The digest of a text is sequential by nature: a conversation's rows stream through one task at the end, one at a time.
    """
    table = written(_ordered(rows).mapInArrow(_parser(WHOLE), PART))
    whole = table.where("kind = 'whole'")
    counts = [F.col(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    wide = F.col("last_turn").cast("decimal(20,0)") - F.col("first_turn").cast("decimal(20,0)") + 1 - F.col("turns")
    gaps = F.least(F.coalesce(wide, F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    done = whole.select("conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *counts, F.col("cells")[0]["cost"].alias("cost"), "audit", F.col("digest").alias("repaired_sha256"))
    open_ = table.where("kind = 'stretch'").select("conv_id", "part", "first_turn", "last_turn", "turns", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal", "rows", "cells")
    pieces = written(open_.groupBy("conv_id").applyInPandas(_joined, "conv_id long, part int, audit string, gaps long, cost long, rows long, blank long, duplicate long, truncated long, illegal long"))
    lines = table.where("kind = 'row'").select("conv_id", "part", "place", "role", "text", "copies", F.lit(None).cast("string").alias("piece"))
    lead = pieces.select("conv_id", "part", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"), F.col("audit").alias("piece"))
    stream = lines.union(lead).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    digests = stream.select("conv_id", "place", "role", "text", "copies", "piece").mapInArrow(_hashed, "conv_id long, digest string")
    audits = pieces.groupBy("conv_id", "gaps", "cost", "blank", "duplicate", "truncated", "illegal").agg(F.sort_array(F.collect_list(F.struct("part", "audit"))).alias("p"))
    audits = audits.withColumn("audit", F.concat_ws("", F.transform("p", lambda x: x["audit"])))
    same = audits.conv_id.eqNullSafe(digests.conv_id)
    late = audits.join(digests, same).select(audits.conv_id, "gaps", *counts, "cost", "audit", F.col("digest").alias("repaired_sha256"))
    return done.union(late)


def repair_query(rows: DataFrame) -> DataFrame:
    """Every conversation of rows, damaged and repaired."""
    return repaired(damaged(rows))


#: The same for DuckDB: the CRC-32 bit by bit, and a walk over the rows with the four states of the repaired roles.
SQL = r"""
WITH RECURSIVE clean AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spelt
  FROM conversations
), crc AS (
  SELECT spelt, (xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(spelt) + 1), lambda i: CAST(ascii(substr(spelt, i, 1)) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)), CAST(4294967295 AS BIGINT))) % 20 AS kind
  FROM (SELECT DISTINCT spelt FROM clean)
), hit AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END AS copies
  FROM clean JOIN crc USING (spelt)
), each AS (
  SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM hit, range(2) r(i) WHERE i < copies
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM (SELECT *, row_number() OVER w AS i FROM each WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)))
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
), moves AS (
  -- one row kept, given a role, deleted or put in: from a state of the repaired roles to the next, with its letter
  SELECT * FROM (VALUES ('', 's', 'u', 's'), ('', 'u', 'a', 'u'), ('u', 'u', 'a', 'u'), ('a', 'a', 'z', 'a'), ('z', 'u', 'a', 'u')) m(a, letter, b, emitted)
), wider AS (
  SELECT * FROM (VALUES ('', 0, '', ''), ('', 2, 'I', 'a'), ('', 4, 'II', 'z'), ('u', 0, '', 'u'), ('u', 2, 'I', 'a'), ('u', 4, 'II', 'z'), ('a', 0, '', 'a'), ('a', 2, 'I', 'z'), ('a', 4, 'II', 'a'), ('z', 0, '', 'z'), ('z', 2, 'I', 'a'), ('z', 4, 'II', 'z')) w(a, extra, put, b)
), steps AS (
  SELECT conv_id, i, a, b, cost, letter FROM (
    SELECT conv_id, i, a, a AS b, 3 AS cost, 'D' AS letter FROM faulty, (SELECT DISTINCT a FROM moves)
    UNION ALL SELECT conv_id, i, a, b, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'K' FROM faulty, moves WHERE fault NOT IN ('blank', 'duplicate') AND left(role, 1) = moves.letter
    UNION ALL SELECT conv_id, i, a, b, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R' FROM faulty, moves WHERE fault NOT IN ('blank', 'duplicate') AND moves.letter <> 's')
), closed AS (
  SELECT conv_id, i, s.a, w.b, min(struct_pack(cost := cost + extra, audit := s.letter || put)) AS cell
  FROM steps s JOIN wider w ON w.a = s.b GROUP BY conv_id, i, s.a, w.b
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, w.b AS state, CAST(extra AS BIGINT) AS cost, put AS audit FROM (SELECT DISTINCT conv_id FROM faulty), wider w WHERE w.a = ''
  UNION ALL
  SELECT conv_id, i, state, cell.cost, cell.audit FROM (
    SELECT w.conv_id, c.i, c.b AS state, min(struct_pack(cost := w.cost + c.cell.cost, audit := w.audit || c.cell.audit)) AS cell
    FROM walk w JOIN closed c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1 AND c.a = w.state
    GROUP BY w.conv_id, c.i, c.b)
), ends AS (
  SELECT w.conv_id, min(struct_pack(cost := cost, audit := audit)) AS cell
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE state IN ('', 'z') GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, k, substr(cell.audit, k, 1) AS letter, length(replace(left(cell.audit, k), 'I', '')) AS i FROM ends, range(1, length(cell.audit) + 1) r(k)
), kept AS (
  SELECT l.conv_id, l.k, l.letter, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text, f.role, letter = 'K' AND left(f.role, 1) = 's' AS system
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D'
), spoken AS (
  SELECT conv_id, k, CASE WHEN letter = 'K' THEN role WHEN count(*) FILTER (NOT system) OVER (PARTITION BY conv_id ORDER BY k) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line FROM kept
), digests AS (
  SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS digest FROM spoken GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(coalesce(e.cell.cost, 0) AS BIGINT) AS cost, coalesce(e.cell.audit, '') AS audit, coalesce(d.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
