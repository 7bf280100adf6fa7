"""Broker code tables, symbol mapping and contract masters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import c

# fixed values: broker codes
ORDER_STATUS = {1: "cancelled", 2: "complete", 4: "trigger pending", 5: "rejected", 6: "open"}
ORDER_SIDE = {1: "BUY", -1: "SELL"}
ORDER_TYPE = {1: "LIMIT", 2: "MARKET", 3: "SL-M", 4: "SL"}
PRODUCT = {"CNC": "CNC", "INTRADAY": "MIS", "MARGIN": "NRML", "CO": "CO", "BO": "BO"}
EXCHANGE = {(10, 10): "NSE", (10, 11): "NFO", (10, 12): "CDS", (12, 10): "BSE", (12, 11): "BFO", (11, 20): "MCX"}


def decode(code: Column, table: dict, unknown: str | None = "unknown") -> Column:
    """Code to label through a literal map; anything else becomes ``unknown``."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(unknown))


def decode_orders(o: DataFrame) -> DataFrame:
    return o.withColumns(
        {
            "order_status": decode(c.status, ORDER_STATUS), "action": decode(c.side, ORDER_SIDE),
            "pricetype": decode(c.type, ORDER_TYPE), "product": decode(c.product, PRODUCT),
        }
    )


def encode_orders(o: DataFrame) -> DataFrame:
    """Labels to broker codes; unknown price types become MARKET, unknown products INTRADAY, unknown sides NULL."""
    back = lambda t: {v: k for k, v in t.items()}
    return o.withColumns(
        {
            "side": decode(c.action, back(ORDER_SIDE), None),
            "type": F.coalesce(decode(c.pricetype, back(ORDER_TYPE), None), F.lit(2)),
            "product_code": decode(c.product, back(PRODUCT), "INTRADAY"),
        }
    )


def exchange_of(exchange: Column, segment: Column) -> Column:
    keyed = {f"{a}/{b}": v for (a, b), v in EXCHANGE.items()}
    return decode(F.concat_ws("/", exchange, segment), keyed, "Unknown Exchange")


def map_symbols(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """Broker symbol and exchange codes to the standard symbol; unmapped rows keep the broker symbol."""
    r = rows.withColumn("exchange", exchange_of(c.exchange_code, c.segment_code))
    k = contracts.select("brsymbol", "exchange", F.col("symbol").alias("_std"))
    return r.join(k, ["brsymbol", "exchange"], "left").withColumn("symbol", F.coalesce("_std", "brsymbol")).drop("_std")


CONTRACT_COLUMNS = (
    "token string, details string, instrument int, lotsize int, tick_size double, isin string, session string, "
    "updated string, expiry_epoch string, ticker string, exchange_code int, segment int, scrip int, underlying string, "
    "underlying_scrip long, strike double, option_type string, underlying_token string, reserved1 string, reserved2 string, reserved3 string"
)

# fixed values: file -> (cash instrument codes, exchange)
CASH_FILES = {"NSE_CM": ([0, 9], "NSE"), "BSE_CM": ([0, 4, 50], "BSE")}
DERIVATIVE_FILES = {"NSE_FO": "NFO", "NSE_CD": "CDS", "BSE_FO": "BFO", "MCX_COM": "MCX"}


def _common(raw: DataFrame, symbol: Column, exchange: Column, brexchange: Column, instrument: Column, expiry: Column) -> DataFrame:
    return raw.select(
        symbol.alias("symbol"), F.col("ticker").alias("brsymbol"), F.col("details").alias("name"), exchange.alias("exchange"), brexchange.alias("brexchange"),
        "token", expiry.alias("expiry"), "strike", "lotsize", instrument.alias("instrumenttype"), "tick_size",
    )


def cash_contracts(raw: DataFrame, file: str) -> DataFrame:
    """Equities (by instrument code) and indices (code 10) of a cash market file; other codes are dropped."""
    codes, ex = CASH_FILES[file]
    keep = raw.filter(c.instrument.isin([*codes, 10]))
    idx = c.instrument == 10
    return _common(keep, c.underlying, F.when(idx, f"{ex}_INDEX").otherwise(ex), F.lit(ex), F.when(idx, "INDEX").otherwise("EQ"), c.expiry_epoch)


def derivative_contracts(raw: DataFrame, file: str) -> DataFrame:
    """Futures and options: epoch expiry as dd-MON-yy, type XX means a future.

    The details "NAME dd Mon yy LAST" become NAME + yy + MON + dd + LAST, and options have their type behind it.  A missing
    option type is a future in the BSE file; in the others the contract keeps no type and no symbol.
    """
    ex = DERIVATIVE_FILES[file]
    option = F.coalesce("option_type", F.lit("XX")) if file == "BSE_FO" else c.option_type
    kind = F.when(option == "XX", "FUT").otherwise(option)
    when = F.upper(F.date_format(F.timestamp_seconds(c.expiry_epoch.try_cast("long")), "dd-MMM-yy"))
    t = F.split(c.details, r"\s+")
    tok = lambda i: F.get(t, F.lit(i))
    plain = F.concat(tok(0), tok(3), F.upper(tok(2)), tok(1), tok(4))
    symbol = F.when(option == "XX", plain).when(option.isin("CE", "PE"), F.concat(plain, option))
    return _common(raw, symbol, F.lit(ex), F.lit(ex), kind, when)


def new_contracts(parsed: DataFrame, loaded: DataFrame) -> DataFrame:
    """Contracts whose token is not loaded yet."""
    return parsed.join(loaded.select("token"), "token", "left_anti")


def search(contracts: DataFrame, text: str, exchange: str) -> DataFrame:
    return contracts.filter(F.contains("symbol", F.lit(text)) & (c.exchange == exchange))
