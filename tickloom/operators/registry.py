"""Registered scanners, evaluated together.

A scanner declares the columns it adds to the bars of a symbol and, as columns again, which bars give a signal. All of them
share one panel: every window runs on the (symbol, date) order, so any number of scanners costs one shuffle of the bars. A
scanner that compares symbols (a rank, the best of a group, pairs) works on the latest bars, one row per symbol, that the
same pass leaves behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.num import c, clip, rnd, truth
from ..functions.rank import percent_rank_avg
from ..session import written
from . import cointegration, scanners
from .consensus import signal
from .indicators import recursive

SIGNAL = "symbol string, strategy_name string, action int, conviction double, timestamp date, meta map<string,string>"


def _nothing(bars: DataFrame) -> DataFrame:
    return bars


@dataclass(frozen=True)
class Scanner:
    """``columns`` adds to the panel what the scanner reads. Bar by bar: ``when``, ``action``, ``conviction`` and ``meta``
    are columns of the panel; only the last ``recent`` bars of a symbol count. Across symbols: ``across`` turns (latest
    bars with the columns named in ``keep``, bars, symbol master) into signals."""

    columns: Callable[[DataFrame], DataFrame] = _nothing
    when: Callable[[], Column] | None = None
    action: Callable[[], Column] = lambda: F.lit(1)
    conviction: Callable[[], Column] = lambda: F.lit(1.0)
    meta: dict[str, str] = field(default_factory=dict)
    recent: int = 1
    keep: tuple[str, ...] = ()
    across: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame] | None = None


REGISTRY: dict[str, Scanner] = {}


def register(name: str, scanner: Scanner) -> Scanner:
    if name in REGISTRY:
        raise ValueError(f"duplicate scanner {name}")
    REGISTRY[name] = scanner
    return scanner


def oversold(entry: float = 35.0) -> Scanner:
    return Scanner(
        columns=lambda b: b if "rsi_14" in b.columns else recursive(b), when=lambda: c.rsi_14 < entry,
        conviction=lambda: rnd(clip((entry - c.rsi_14) / 25.0, 0.0, 1.0), 2), meta={"rsi": "rsi_14"},
    )


def boxes(recent: int = 1) -> Scanner:
    def columns(b: DataFrame) -> DataFrame:
        return scanners.darvas(b).drop("conviction")

    return Scanner(
        columns=columns, when=lambda: c.darvas_signal.startswith("Break"), action=lambda: F.when(c.darvas_signal.startswith("Breakout"), 1).otherwise(-1),
        conviction=lambda: F.when(c.vol_confirmed, 1.0).otherwise(0.5), meta={"raw_signal": "darvas_signal", "box_days": "box_days"}, recent=recent,
    )


def squeezes(recent: int = 10) -> Scanner:
    return Scanner(
        columns=scanners.squeeze_columns, when=lambda: c.momentum.isNotNull(), action=lambda: F.when(c.hist_color.isin("lime", "green"), 1).otherwise(-1),
        conviction=lambda: F.when(c.hist_color.isin("lime", "red"), 1.0).otherwise(0.5), meta={"color": "hist_color", "squeeze_on": "squeeze_on"}, recent=recent,
    )


def leaders(min_bars: int = 256, **limits) -> Scanner:
    def across(latest: DataFrame, bars: DataFrame, master: DataFrame | None) -> DataFrame:
        t = written(latest.filter(c.n_bars >= min_bars).withColumn("rs", rnd("rs", 8)))  # ranked by a small table, read twice
        t = scanners.leader_candidates(percent_rank_avg(t, "rs", "rs_rating"), **limits)
        return signal(t, "trend_leaders", F.lit(1), c.conviction, c.date, {"rs_rating": rnd("rs_rating", 2), "template_score": c.template_score})

    return Scanner(columns=lambda b: scanners.leader_columns(b), keep=("close", *scanners.LEADER_COLUMNS, "n_bars"), across=across)


def liquid_funds(category: str = "category") -> Scanner:
    """The symbol with the largest turnover of each category of the master; conviction relative to the largest of all."""

    def across(latest: DataFrame, bars: DataFrame, master: DataFrame | None) -> DataFrame:
        j = latest.join(master.select("symbol", F.col(category).alias("_cat")).filter("_cat IS NOT NULL"), "symbol")
        best = j.groupBy("_cat").agg(F.max_by(F.struct("symbol", "date", "turnover"), F.struct("turnover", "symbol")).alias("b")).select("_cat", "b.*")
        most = best.agg(F.max("turnover").alias("_most"))  # one row
        best = best.join(F.broadcast(most), F.lit(True))
        conv = F.when(c._most > 0, rnd(F.least(F.lit(1.0), c.turnover / c._most), 2)).otherwise(1.0)
        return signal(best, "liquid_funds", F.lit(1), conv, c.date, {"category": F.col("_cat")})

    return Scanner(keep=("turnover",), across=across)


def pair_trades(lookback: int = 252, z_entry: float = 2.0, **how) -> Scanner:
    def across(latest: DataFrame, bars: DataFrame, master: DataFrame | None) -> DataFrame:
        pairs = cointegration.cointegrated_pairs(bars, z_entry=z_entry, lookback=lookback, neutral=False, **how)
        return cointegration.pair_signals(pairs, F.lit(None).cast("date"), z_entry)

    return Scanner(across=across)


for _name, _scanner in (("rsi_scanner", oversold()), ("darvas_box", boxes()), ("momentum_squeeze", squeezes()), ("trend_leaders", leaders()), ("liquid_funds", liquid_funds()), ("pair_scanner", pair_trades())):
    register(_name, _scanner)


def panel_hits(bars: DataFrame, chosen: dict[str, Scanner]) -> DataFrame:
    """The bars that give signals (array ``hits``) and the last bar of each symbol with what scanners across symbols need."""
    p = ts.position(bars)
    for s in chosen.values():
        had = set(p.columns)
        p = s.columns(p)
        p = ts.position(p) if "bn" in had and "bn" not in p.columns else p
    recent = ts.age()
    offers = []
    for name, s in chosen.items():
        if s.when is None:
            continue
        kv = [x for k, v in s.meta.items() for x in (F.lit(k), F.col(v).cast("string"))]
        meta = F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")
        on = truth(s.when() & (recent < s.recent))
        offers.append(F.struct(F.lit(name).alias("strategy_name"), s.action().cast("int").alias("action"), s.conviction().cast("double").alias("conviction"), meta.alias("meta"), on.alias("on")))
    hits = F.filter(F.array(*offers), lambda x: x["on"]) if offers else F.array().cast("array<struct<strategy_name:string,action:int,conviction:double,meta:map<string,string>,on:boolean>>")
    keep = list(dict.fromkeys(k for s in chosen.values() for k in s.keep))
    t = p.select("symbol", "date", *keep, (recent == 0).alias("is_last"), hits.alias("hits"))
    return t.filter((F.size("hits") > 0) | F.col("is_last"))


def scan(bars: DataFrame, master: DataFrame | None = None, chosen: dict[str, Scanner] | None = None) -> DataFrame:
    """Signals of the chosen scanners (all registered ones) over bars(symbol, date, open, high, low, close, volume, turnover)."""
    chosen = REGISTRY if chosen is None else chosen
    table = written(panel_hits(bars, chosen))
    out = table.select("symbol", F.col("date").alias("timestamp"), F.inline("hits")).select("symbol", "strategy_name", "action", "conviction", "timestamp", "meta")
    latest = table.filter("is_last").drop("hits", "is_last")
    for s in chosen.values():
        if s.across is not None:
            out = out.unionByName(s.across(latest, bars, master))
    return out
