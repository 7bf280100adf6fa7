"""Exchange files, candle arrays and other raw inputs to tidy tables; sinks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import clean

# fixed values: header names of the two daily-file generations, first present wins
ALIASES = {
    "symbol": ["SYMBOL", "TckrSymb"],
    "series": ["SERIES", "SctySrs"],
    "open": ["OPEN_PRICE", "OPEN", "OpnPric"],
    "high": ["HIGH_PRICE", "HIGH", "HghPric"],
    "low": ["LOW_PRICE", "LOW", "LwPric"],
    "close": ["CLOSE_PRICE", "CLOSE", "ClsPric"],
    "volume": ["TTL_TRD_QNTY", "VOLUME", "TtlTradgVol", "TtlTrdQnty"],
    "turnover": ["TURNOVER", "TURNOVER_LACS", "TtlTrfVal"],
    "deliv_qty": ["DELIV_QTY", "DlvrbleQty"],
    "deliv_pct": ["DELIV_PER", "DELIV_PCT", "PctOfDlvrbleQtyTltTrdQty"],
}


def read_symbol_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files, or folders of part files, as one table with the symbol from the first part of the path that ends in .parquet."""
    t = spark.read.parquet(path)
    return t.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/\\]+)\.parquet(?:/|$)", 1).alias("symbol"))


DAILY_FIELDS = ("symbol", "series", "open", "high", "low", "close", "volume", "deliv_qty", "deliv_pct")


_LINE = "day date, file string, line long, ragged boolean, text string, " + ", ".join(f"{ALIASES[f][0]} string" for f in (*DAILY_FIELDS, "turnover"))
_NAMES = [x.strip().split(" ")[0] for x in _LINE.split(",")]
_SYMBOL = frozenset(ALIASES["symbol"])


def _parsed_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole files by each file's own header, a few thousand of them at a time and a column of these at a time."""
    for batch in batches:
        for path, day, content in zip(*(batch.column(x) for x in ("path", "day", "content")), strict=True):
            text = bytes(memoryview(content.as_buffer())).decode("utf-8-sig", errors="replace")
            header: dict[str, int] = {}
            width, n, held = 0, 0, []
            for n, cells in enumerate(csv.reader(io.StringIO(text, newline=""), skipinitialspace=True), 1):
                if not cells or not (first := cells[0].strip()) and not any(x.strip() for x in cells):
                    continue
                if not header or first in _SYMBOL:
                    if held:
                        yield from _columns(path.as_py(), day, held, header, width)
                    cells = [x.strip() for x in cells]
                    header, width, held = {h: k for k, h in reversed(list(enumerate(cells)))}, len(cells), []
                    continue
                held.append((n, cells))
                if len(held) >= 20_000:
                    yield from _columns(path.as_py(), day, held, header, width)
                    held = []
            if held:
                yield from _columns(path.as_py(), day, held, header, width)


def _columns(path: str, day: pa.Scalar, lines: list[tuple[int, list[str]]], header: dict[str, int], width: int) -> Iterator[pa.RecordBatch]:
    """Numbered lines of one header: those that fit it, then those that do not."""
    fits = lambda x: len(x) == width or len(x) > width and not any(y.strip() for y in x[width:])  # noqa: E731 - blank cells behind the last one do no harm
    for ragged in (False, True):
        some = [x for x in lines if fits(x[1]) != ragged]
        if not some:
            continue
        of = lambda k: [x[k].strip() for _, x in some]  # noqa: B023, E731
        none = pa.nulls(len(some), pa.string())
        text = pa.array([",".join(y.strip() for y in x) for _, x in some]) if ragged else none
        at = [None if ragged else next((header[h] for h in ALIASES[f] if h in header), None) for f in DAILY_FIELDS]
        found = [none if k is None else pa.array(of(k), pa.string()) for k in at]
        lacs = next((h for h in ALIASES["turnover"] if h in header), None)
        turnover = none if ragged or lacs is None else pa.array([_turnover(x, lacs) for x in of(header[lacs])], pa.string())
        names = pa.repeat(day, len(some)), pa.repeat(path.rsplit("/", 1)[-1], len(some))
        yield pa.RecordBatch.from_arrays([*names, pa.array([n for n, _ in some], pa.int64()), pa.array([ragged] * len(some)), text, *found, turnover], _NAMES)


def _turnover(cell: str, name: str) -> str | None:
    """Turnover in full units."""
    if name != "TURNOVER_LACS":
        return cell
    try:
        return repr(float(cell) * 100000.0)
    except ValueError:
        return None


def daily_lines(spark: SparkSession, path: str, day_pattern: str = r"(\d{8})", day_in: str = "name") -> DataFrame:
    """Every line below the headers of many daily CSV files: its cells as text by the first alias of each field, or, if
    its cells do not fit its file's header, ``ragged`` and its text.

    Each file is read by its own header, so generations of headers mix; cells may be quoted and hold commas, headers may
    carry blanks, a file may repeat its header. A file is one trading day, found once for all its lines: a task holds one
    file at a time.
    """
    name = F.substring_index("path", "/", -1) if day_in == "name" else F.col("path")
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", date_in_name(name, day_pattern).alias("day"), "content").mapInArrow(_parsed_files, _LINE)


def read_daily_files(spark: SparkSession, path: str, day_pattern: str = r"(\d{8})", day_in: str = "name") -> DataFrame:
    """The lines of many daily CSV files that fit their headers (see :func:`daily_lines`), as text columns.

    The day comes from the file's name, or with ``day_in="path"`` from its whole path (yyyyMMdd folders). TURNOVER is in
    full units, whatever the file's own unit. Lines that do not fit are counted by :func:`ragged_lines`.
    """
    t = daily_lines(spark, path, day_pattern, day_in).filter("NOT ragged")
    return t.select("day", *[ALIASES[f][0] for f in ("turnover", *DAILY_FIELDS)])


def ragged_lines(spark: SparkSession, path: str, day_pattern: str = r"(\d{8})", day_in: str = "name") -> DataFrame:
    """For each daily file its lines, those that do not fit its header, and the first of these."""
    t = daily_lines(spark, path, day_pattern, day_in)
    return t.groupBy("day").agg(F.count(F.lit(1)).alias("lines"), F.count_if("ragged").alias("ragged"), F.min_by("text", F.when(F.col("ragged"), F.col("line"))).alias("first_ragged"))


def resolve(raw: DataFrame, wanted: list[str], required: list[str]) -> dict[str, str]:
    """Wanted field -> header of this file.  Headers may carry blanks."""
    have = {h.strip(): h for h in raw.columns}
    found = {f: next((have[a] for a in ALIASES[f] if a in have), None) for f in wanted}
    missing = [f for f in required if found[f] is None]
    if missing:
        raise ValueError(f"daily file lacks columns for {missing}; it has {sorted(have)}")
    return {f: h for f, h in found.items() if h}


def _text(h: str) -> Column:
    return F.trim(F.col(f"`{h}`").cast("string"))


def _number(h: str) -> Column:
    return clean(_text(h).try_cast("double"))


def normalise_daily(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """symbol, turnover, close, delivery quantity and percent of the EQ rows that have a turnover; ``keep`` rides along."""
    got = resolve(raw, ["symbol", "series", "turnover", "close", "deliv_qty", "deliv_pct"], ["symbol", "series", "turnover", "close"])
    scale = 100000.0 if got["turnover"].strip() == "TURNOVER_LACS" else 1.0
    num = lambda f: _number(got[f]) if f in got else F.lit(None).cast("double")
    return raw.filter(_text(got["series"]) == "EQ").select(
        *(keep or []), _text(got["symbol"]).alias("symbol"), (num("turnover") * scale).alias("turnover"), num("close").alias("close"), num("deliv_qty").alias("deliv_qty"), num("deliv_pct").alias("deliv_pct")
    ).filter("turnover is not null")


def daily_ohlcv(raw: DataFrame, day: Column) -> DataFrame:
    """OHLCV rows of the EQ series stamped with ``day``; rows without a full OHLC are dropped."""
    fields = ["symbol", "series", "open", "high", "low", "close", "volume", "turnover"]
    got = resolve(raw, fields, fields[:6])
    num = lambda f: _number(got[f]) if f in got else F.lit(0.0)
    return raw.filter(_text(got["series"]) == "EQ").select(
        _text(got["symbol"]).alias("symbol"), day.alias("date"), *[num(f).alias(f) for f in ("open", "high", "low", "close")],
        F.coalesce(num("volume"), F.lit(0.0)).alias("volume"), F.coalesce(num("turnover"), F.lit(0.0)).alias("turnover"),
    ).na.drop(subset=["open", "high", "low", "close"])


def date_in_name(name: Column, pattern: str = r"(\d{8})") -> Column:
    """Date (yyyyMMdd) inside a file name."""
    return F.try_to_timestamp(F.regexp_extract(name, pattern, 1), F.lit("yyyyMMdd")).cast("date")


def top_by_turnover(t: DataFrame, n: int = 250) -> DataFrame:
    return t.orderBy(F.desc("turnover"), "symbol").limit(n)


def tradable(day_rows: DataFrame, master: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Distinct upper-case symbols of a day, kept to the master list when given."""
    s = day_rows.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    if master is not None:
        s = s.join(master.select("symbol"), "symbol", "left_semi")
    s = s.orderBy("symbol")
    return s.limit(limit) if limit else s


def candles_to_bars(rows: DataFrame, payload: str = "payload", zone: str = "Asia/Kolkata", daily: bool = True) -> DataFrame:
    """JSON arrays of [epoch, o, h, l, c, v] to bars in exchange-local time (midnight for daily frames)."""
    arr = F.from_json(F.col(payload), "array<array<double>>")
    x = rows.select("symbol", F.explode(arr).alias("x"))
    at = F.from_utc_timestamp(F.timestamp_seconds(F.get("x", F.lit(0)).cast("long")), zone)
    when = F.to_date(at) if daily else at
    return x.select("symbol", when.alias("date"), *[F.get("x", F.lit(i + 1)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))]).filter("close is not null")


def normalise_symbol(s: Column) -> Column:
    """Upper, trimmed, without exchange prefix or listing suffix."""
    u = F.upper(F.trim(s))
    u = F.regexp_replace(u, r"^NSE:", "")
    return F.regexp_replace(F.regexp_replace(u, r"-EQ$", ""), r"\.(NS|BO)$", "")


def exchange_symbol(s: Column, exchange: str = "NSE") -> Column:
    return F.concat(F.lit(f"{exchange}:"), normalise_symbol(s), F.lit("-EQ"))


def suffixed_symbol(s: Column, suffix: str = "NS") -> Column:
    return F.concat(normalise_symbol(s), F.lit(f".{suffix}"))


def nested_rows(rows: DataFrame, payload: str, schema: str, columns: dict[str, str], drop_blank: str) -> DataFrame:
    """JSON {data: [...]} to rows with renamed columns; rows whose key field is blank are dropped."""
    d = rows.select(F.explode(F.from_json(F.col(payload), f"struct<data:array<struct<{schema}>>>")["data"]).alias("d"))
    t = d.select(*[F.col(f"d.{k}").alias(v) for k, v in columns.items()])
    return t.filter(F.col(drop_blank).isNotNull() & ~F.trim(F.col(drop_blank).cast("string")).isin("", "-"))


_SIDE = "struct<openInterest:double,changeinOpenInterest:double,totalTradedVolume:double,impliedVolatility:double,lastPrice:double,change:double,bidQty:double,bidprice:double,askPrice:double,askQty:double>"
_CHAIN = f"struct<records:struct<data:array<struct<expiryDate:string,strikePrice:double,CE:{_SIDE},PE:{_SIDE}>>>>"
_FULL = {
    "oi": "openInterest", "chng_in_oi": "changeinOpenInterest", "volume": "totalTradedVolume", "iv": "impliedVolatility", "ltp": "lastPrice",
    "net_chng": "change", "bid_qty": "bidQty", "bid_price": "bidprice", "ask_price": "askPrice", "ask_qty": "askQty",
}
_COMPACT = ("oi", "chng_in_oi", "volume", "iv", "ltp", "net_chng")


def option_chain(rows: DataFrame, payload: str = "payload", expiry: str | None = None, mode: str = "full", long: bool = False) -> DataFrame:
    """Nested call/put objects to one row per (symbol, expiry, strike); a missing side counts as 0.

    ``mode`` full or compact; ``long`` gives one row per side tagged CE / PE instead.
    """
    r = rows.select("symbol", F.explode(F.from_json(F.col(payload), _CHAIN)["records"]["data"]).alias("r"))
    if expiry:
        r = r.filter(F.col("r.expiryDate") == expiry)
    names = _COMPACT if mode == "compact" else tuple(_FULL)
    base = ["symbol", F.col("r.expiryDate").alias("expiry_date"), F.col("r.strikePrice").alias("strike_price")]
    val = lambda side, n: F.coalesce(F.col(f"r.{side}.{_FULL[n]}"), F.lit(0.0))
    if long:
        sides = F.array(*[F.struct(F.lit(s).alias("side"), *[val(s, n).alias(n) for n in names]) for s in ("CE", "PE")])
        return r.select(*base, F.explode(sides).alias("_s")).select("symbol", "expiry_date", "strike_price", "_s.*")
    return r.select(*base, *[val(s, n).alias(f"{p}_{n}") for s, p in (("CE", "calls"), ("PE", "puts")) for n in names])


def ban_list(lines: DataFrame, col: str = "line") -> DataFrame:
    """First alphanumeric token of each comma-separated row that is not a header word; distinct."""
    tokens = F.transform(F.split(F.col(col), ","), lambda x: F.upper(F.trim(x)))
    ok = F.filter(tokens, lambda x: x.rlike("^[\\p{L}\\p{N}]+$") & ~x.isin("SYMBOL", "SECURITY NAME", "SERIES", "DATE"))
    return lines.select(F.get(ok, F.lit(0)).alias("symbol")).filter("symbol is not null").distinct()


def flag_banned(rows: DataFrame, banned: DataFrame) -> DataFrame:
    key = F.regexp_replace(F.upper(F.trim("symbol")), r"\.NS$", "")
    b = banned.select(F.col("symbol").alias("_key"), F.lit(True).alias("banned"))
    return rows.withColumn("_key", key).join(b, "_key", "left").drop("_key").withColumn("banned", F.coalesce("banned", F.lit(False)))


def high_low_lookup(panel: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """52-week high and low of the latest bar, optionally for a symbol list."""
    t = panel.select("symbol", "date", F.col("high_252").alias("year_high"), F.col("low_252").alias("year_low"))
    return t.join(symbols, "symbol", "left_semi") if symbols is not None else t


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a report list; Parquet by default, CSV with header on request."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
