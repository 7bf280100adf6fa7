"""Filtered lists, grouped views and summary tables over a snapshot or panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.num import bands, c, evaluated, flag, money, sdiv, truth
from ..session import written
from .consensus import BUY_LABELS, VOTERS
from .strategies import BAR_WISE

BULL, BULL_SL, CAR_BUY = "In Bull Run", "In Bull Run (SL)", "Buy/Average Out"
GTT = ["Start GTT", "Start GTT (Basic)"]


def in_final() -> Column:
    return (c.trend_status == BULL) & (c.car_rating == CAR_BUY)


def in_swing() -> Column:
    return c.bottom_out_status.isin(GTT)


def in_bull_sl() -> Column:
    return (c.trend_status_sl == BULL_SL) & (c.car_rating == CAR_BUY)


def final_list(t: DataFrame) -> DataFrame:
    """Bull run and CAR buy, largest traded value first."""
    return t.filter(in_final()).orderBy(F.desc("traded_value"))


def swing_list(t: DataFrame) -> DataFrame:
    return t.filter(in_swing()).orderBy(F.desc("traded_value"))


def super_list(t: DataFrame) -> DataFrame:
    return final_list(t.filter(c.bottom_out_status == "Start GTT"))


def bull_sl_list(t: DataFrame) -> DataFrame:
    return t.filter(in_bull_sl()).orderBy("close")


def swing_target(t: DataFrame) -> DataFrame:
    return swing_list(t).withColumn("gtt_target_20pct", c.gtt_trigger * 1.20)


IDLE = {**{v: "Hold" for v in BAR_WISE}, "rsi_ladder": "No Action", "turtle": "No need to fresh start"}


# value columns of the report that the grouped view shows once per symbol
GROUP_VALUES = ("traded_value", "close", "change_pct", "z_score", "vol_spike", "rsi_14", "tech_score", "diff_pct")


def _entries(t: DataFrame) -> Column:
    """The strategies of a row whose action is not idle, in strategy order."""
    cols = set(t.columns)
    pick = lambda v, what: F.col(f"{v}_{what}") if f"{v}_{what}" in cols else F.lit(None).cast("double")
    entry = lambda i, v: F.struct(
        F.lit(i).alias("ord"), F.lit(v).alias("strategy"), F.col(f"{v}_action").alias("action"), pick(v, "target").alias("target"), pick(v, "sl").alias("stop_loss"), pick(v, "diff").alias("diff_pct"), F.lit(IDLE[v]).alias("idle")
    )
    return F.filter(F.array(*[entry(i, v) for i, v in enumerate(BAR_WISE)]), lambda x: x["action"] != x["idle"])


def strategy_rows(t: DataFrame) -> DataFrame:
    """One row per (row, strategy) whose action is not idle, with its target, stop and, where it has one, difference."""
    keep = [x for x in ("symbol", "date", *GROUP_VALUES) if x in t.columns and x != "diff_pct"]
    return t.select(*keep, F.explode(_entries(t)).alias("_s")).select(*keep, "_s.ord", "_s.strategy", "_s.action", "_s.target", "_s.stop_loss", "_s.diff_pct")


def grouped_view(rows: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Strategies of a symbol on one row: joined names, actions, targets and stops in strategy order, and the first known
    value of each value column that the rows have.

    A group has at most one entry per strategy, so its arrays are bounded.
    """
    values = [x for x in GROUP_VALUES if x in rows.columns]
    parts = F.array_sort(F.collect_list(F.struct("ord", "strategy", "action", "target", "stop_loss")))
    return _joined(rows.groupBy(*keys).agg(*[F.min_by(x, F.when(F.col(x).isNotNull(), F.col("ord"))).alias(x) for x in values], parts.alias("_p")), keys, values)


def grouped_bars(t: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """:func:`grouped_view` of :func:`strategy_rows` where each row is a group of its own (``keys`` are unique): nothing to group."""
    values = [x for x in GROUP_VALUES if x in t.columns or x == "diff_pct"]
    g = evaluated(t.select(*keys, *[x for x in values if x != "diff_pct"], _entries(t).alias("_p"))).filter(F.size("_p") > 0)
    known = F.filter(F.transform("_p", lambda x: x["diff_pct"]), lambda x: x.isNotNull())
    return _joined(g.withColumn("diff_pct", F.get(known, F.lit(0))), keys, values)


def _joined(g: DataFrame, keys: tuple[str, ...], values: list[str]) -> DataFrame:
    text = lambda f: F.concat_ws(" | ", F.transform("_p", lambda x: x[f]))
    nums = lambda f: F.concat_ws(" | ", F.transform(F.filter("_p", lambda x: x[f].isNotNull()), lambda x: money(x[f])))
    return g.select(
        *keys, *values, text("strategy").alias("strategies"), text("action").alias("actions"), nums("target").alias("targets"), nums("stop_loss").alias("stop_losses")
    )


def master_filter(m: DataFrame, category: str | None = None, index: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols of a cap category and/or index flag, sorted; ``limit`` is the caller's list length."""
    if category:
        m = m.filter(c.cap_category == category)
    if index:
        m = m.filter(truth(F.col(index)))
    m = m.select(F.upper(F.trim("symbol")).alias("symbol")).orderBy("symbol")
    return m.limit(limit) if limit else m


def signal_filter(t: DataFrame, strategy: str | None = None, min_consensus: int = 0, sector: str | None = None) -> DataFrame:
    if strategy:
        t = t.filter(F.col(f"{strategy}_action").isin(BUY_LABELS))
    if min_consensus:
        t = t.filter(F.coalesce("consensus_score", F.lit(0)) >= min_consensus)
    if sector:
        t = t.filter(c.sector == sector)
    return t


def cap_bucket(large: list[Column], mid: list[Column], small: list[Column]) -> Column:
    """First matching class of index flags; a missing flag is false."""
    any_of = lambda flags: F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))
    return F.when(any_of(large), "Large").when(any_of(mid), "Mid").when(any_of(small), "Small").otherwise("Other")


def mood_band(score: Column) -> Column:
    return bands(score, [(70, "Extreme Greed"), (50, "Greed"), (30, "Fear")], "Extreme Fear")


def buy_counts(snap: DataFrame, voters: list[str] = VOTERS) -> DataFrame:
    """Number of buy labels per strategy: one pass of conditional counts, then one row per strategy."""
    g = snap.agg(*[F.count_if(F.col(f"{v}_action").isin(BUY_LABELS)).alias(v) for v in voters])
    return g.unpivot([], voters, "strategy", "buys")


def kpis(snap: DataFrame) -> DataFrame:
    late = ("vcp", "squeeze", "supertrend", "knn")
    hits = sum((flag(F.col(f"{v}_action").isin(BUY_LABELS), 1) for v in late), F.lit(0))
    return snap.agg(
        F.count_if(c.trend_status == BULL).alias("bull_run"),
        F.count_if(c.consensus_score >= 4).alias("high_conviction"),
        F.count_if(c.bottom_out_status.isin(GTT)).alias("gtt_setups"),
        F.sum(hits).alias("late_strategy_hits"),
    )


def distribution(t: DataFrame, col: str) -> DataFrame:
    return t.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def leaderboard(t: DataFrame, min_score: int, n: int) -> DataFrame:
    """Top ``n`` by consensus score (symbol breaks ties): a bounded top-k."""
    return t.filter(c.consensus_score >= min_score).orderBy(F.desc("consensus_score"), "symbol").limit(n)


def order_statistics(orders: DataFrame) -> DataFrame:
    cond = {
        "total_buy_orders": c.side == 1, "total_sell_orders": c.side == -1, "total_completed_orders": c.status == 2,
        "total_open_orders": c.status == 6, "total_rejected_orders": c.status == 5,
    }
    return orders.agg(*[F.count_if(v).alias(k) for k, v in cond.items()])


def holdings_statistics(h: DataFrame) -> DataFrame:
    g = h.agg(
        F.sum(c.ltp * c.quantity).alias("totalholdingvalue"), F.sum(c.cost_price * c.quantity).alias("totalinvvalue"), F.sum(c.pl).alias("totalprofitandloss")
    )
    return g.withColumn("totalpnlpercentage", F.coalesce(sdiv(c.totalprofitandloss, c.totalinvvalue) * 100, F.lit(0.0)))


def holding_pnl(h: DataFrame) -> DataFrame:
    return h.withColumn("pnlpercent", sdiv(c.ltp - c.cost_price, c.cost_price) * 100)


def top_per_category(funds: DataFrame, keywords: list[tuple[str, str]], banned_words: list[str], banned: list[str], min_volume: float = 10_000.0) -> DataFrame:
    """Most liquid fund of each category (weight = close * volume), with conviction relative to the best."""
    f = funds.withColumn("weight", c.close * c.volume).filter(c.volume >= min_volume)
    for word in banned_words:
        low = F.lit(word.lower())
        f = f.filter(~F.contains(F.lower("underlying"), low) & ~F.contains(F.lower("symbol"), low))
    f = f.filter(~c.symbol.isin(banned)).withColumn("category", keyword_category(c.underlying, keywords)).filter(c.category != "Unknown")
    # one winner per category is a grouped maximum: partial on the map side, hot category or not
    best = f.groupBy("category").agg(F.max_by(F.struct("symbol", "weight", "close", "volume"), F.struct("weight", "symbol")).alias("_b"))
    best = best.select("category", "_b.*")
    top = best.agg(F.max("weight").alias("_top"))
    return best.join(F.broadcast(top), F.lit(True)).withColumn("conviction", F.least(F.lit(1.0), sdiv(c.weight, F.col("_top")))).drop("_top")


def keyword_category(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """Category of the first keyword (in list order) contained in the text, case-insensitive."""
    up = F.upper(F.coalesce(text, F.lit("")))
    expr = None
    for word, cat in keywords:
        cond = F.contains(up, F.lit(word.upper()))
        expr = F.when(cond, cat) if expr is None else expr.when(cond, cat)
    return expr.otherwise("Unknown")


def audit_profile(t: DataFrame, numeric: list[str]) -> DataFrame:
    """Null count, min, max and mean of each numeric column: one pass, one row per column."""
    aggs = []
    for x in numeric:
        aggs += [F.count_if(F.col(x).isNull()).alias(f"{x}|n"), F.min(x).alias(f"{x}|lo"), F.max(x).alias(f"{x}|hi"), F.avg(x).alias(f"{x}|mu")]
    g = t.agg(*aggs)
    rows = [F.struct(F.lit(x).alias("column"), F.col(f"`{x}|n`").alias("nulls"), F.col(f"`{x}|lo`").alias("lowest"), F.col(f"`{x}|hi`").alias("highest"), F.col(f"`{x}|mu`").alias("mean")) for x in numeric]
    return g.select(F.inline(F.array(*rows)))


def top_of_kinds(t: DataFrame, kinds: dict[str, tuple[Column, bool]], n: int, by: list[str], keep: list[str]) -> DataFrame:
    """First ``n`` rows of every kind in every group of ``by``, in one pass.

    ``kinds`` maps a name to (key, descending). Each row is offered once per kind; the rank limit runs before the shuffle
    too, so a task sends at most ``n`` rows of a group and kind, and no group is sorted whole in one task. Rows without a
    key come last. Adds kind, value (the key) and rank.
    """
    offers = F.array(*[F.struct(F.lit(k).alias("kind"), key.cast("double").alias("value"), (-key if down else key).cast("double").alias("_k")) for k, (key, down) in kinds.items()])
    each = t.select(*by, *keep, F.inline(offers))
    w = W.partitionBy(*by, "kind").orderBy(F.asc_nulls_last("_k"), *keep)
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_k")


def movers(latest: DataFrame, n: int = 5, by: str = "index_name") -> DataFrame:
    """Top ``n`` gainers, losers and most active (by value, by volume) per index."""
    kinds = {"gainer": (c.change_pct, True), "loser": (c.change_pct, False), "active_value": (c.turnover, True), "active_volume": (c.volume, True)}
    return top_of_kinds(latest, kinds, n, [by], ["symbol"]).select(by, "kind", "rank", "symbol", "value")


def breadth(latest: DataFrame, by: str = "index_name") -> DataFrame:
    return latest.groupBy(by).agg(
        F.count_if(c.change_pct > 0).alias("advances"), F.count_if(c.change_pct < 0).alias("declines"), F.count_if(c.change_pct == 0).alias("unchanged")
    )


def oi_quadrants(t: DataFrame) -> DataFrame:
    """Label by the signs of the open-interest and price changes, with the group's size."""
    oi = F.when(c.d_oi > 0, "Rise").when(c.d_oi < 0, "Slide")
    px = F.when(c.d_price > 0, "Rise").when(c.d_price < 0, "Slide")
    lab = F.concat(oi, F.lit(" in OI / "), px, F.lit(" in price"))
    return t.withColumn("quadrant", lab).filter("quadrant is not null").groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"), F.avg("d_price").alias("avg_d_price"))


def heatmap(t: DataFrame) -> DataFrame:
    return t.select("symbol", "open", "high", "low", "close", "change_pct", (c.ffmc / 1e7).alias("market_cap_cr")).orderBy(F.desc("market_cap_cr"))


def sections_report(t: DataFrame, sections: dict[str, tuple[Column, Column]], n: int = 5) -> DataFrame:
    """First ``n`` rows (symbol, close) of each list with how many more there are.

    ``sections`` maps a name to (condition, ascending sort key). All lists come from one pass over ``t``: a row is offered
    to each list that it is in; that narrow table is written, ranked and counted.
    """
    offers = F.array(*[F.struct(F.lit(k).alias("section"), key.cast("double").alias("_k"), truth(cond).alias("_in")) for k, (cond, key) in sections.items()])
    each = written(t.select("symbol", "close", F.inline(F.filter(offers, lambda x: x["_in"]))).drop("_in"))
    w = W.partitionBy("section").orderBy(F.asc_nulls_last("_k"), "symbol")
    top = each.withColumn("position", F.row_number().over(w)).filter(c.position <= n)
    total = each.groupBy("section").agg(F.count(F.lit(1)).alias("_n"))  # one row per section
    return top.join(F.broadcast(total), "section").select("section", "position", "symbol", "close", F.greatest(F.col("_n") - n, F.lit(0)).alias("more"))


def membership_flags(members: DataFrame, indexes: list[str]) -> DataFrame:
    """Long (index, symbol) rows to one boolean column per index; the index list is given, so no discovery pass."""
    g = members.groupBy("symbol").pivot("index_name", indexes).agg(F.lit(True))
    return g.na.fill(False, indexes)


def net_position(positions: DataFrame, symbol: str, product: str) -> DataFrame:
    """Quantity of the first row with the symbol and product, "0" without one."""
    hit = positions.filter((c.symbol == symbol) & (F.col("product") == product))
    return hit.agg(F.coalesce(F.min_by(c.net_qty.cast("string"), "row_no"), F.lit("0")).alias("net_qty"))

