"""Overlays from corporate texts and filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import c

# fixed values: subject words of corporate actions and of positive catalysts
ACTION_WORDS = {"Div": ["dividend"], "Split": ["split", "sub-division"], "Bonus": ["bonus"]}
CATALYST_WORDS = ["order", "acquisition", "financial results", "fund raising", "upgrade"]


def _has(text: Column, words: list[str]) -> Column:
    cond = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def action_tags(actions: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Per symbol the sorted, comma-joined tags found in any subject, 'None' without one.

    One boolean per tag is combined map-side; texts never travel through the shuffle.
    """
    words = words or ACTION_WORDS
    subj = F.lower(F.coalesce(c.subject, F.lit("")))
    g = actions.groupBy("symbol").agg(*[F.max(_has(subj, ws)).alias(f"_{t}") for t, ws in words.items()])
    tags = F.concat_ws(", ", *[F.when(F.col(f"_{t}"), t) for t in sorted(words)])
    return g.select("symbol", F.when(tags == "", "None").otherwise(tags).alias("corp_action"))


def catalyst(announcements: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Yes when any announcement text of the symbol holds a catalyst word."""
    text = F.lower(F.concat_ws(" ", c.desc, c.subject))
    g = announcements.groupBy("symbol").agg(F.max(_has(text, words or CATALYST_WORDS)).alias("_y"))
    return g.select("symbol", F.when(F.col("_y"), "Yes").otherwise("No").alias("catalyst"))


def days_to_event(events: DataFrame, as_of: Column) -> DataFrame:
    """Days from ``as_of`` to the symbol's next event (text dates dd-MMM-yyyy), -1 without one."""
    d = F.try_to_timestamp(c.event_date, F.lit("dd-MMM-yyyy")).cast("date")
    g = events.withColumn("_d", d).groupBy("symbol").agg(F.min(F.when(F.col("_d") >= as_of, F.col("_d"))).alias("_n"))
    return g.select("symbol", F.coalesce(F.datediff("_n", as_of), F.lit(-1)).alias("event_days"))


def insider_score(filings: DataFrame, large: float = 10_000_000.0) -> DataFrame:
    """Promoter trades: buy +3 (large) or +1, sell -2, pledge -3; summed and clamped to -3..3."""
    person, mode = F.lower(c.person_category), F.lower(c.acq_mode)
    value = F.coalesce(c.sec_val.try_cast("double"), F.lit(0.0))
    pts = (
        F.when(~F.contains(person, F.lit("promoter")), 0)
        .when(_has(mode, ["buy", "market purchase"]), F.when(value > large, 3).otherwise(1))
        .when(_has(mode, ["sell", "market sale"]), -2)
        .when(F.contains(mode, F.lit("pledge")), -3)
        .otherwise(0)
    )
    g = filings.groupBy("symbol").agg(F.sum(pts).alias("_s"))
    return g.select("symbol", F.greatest(F.lit(-3), F.least(F.lit(3), F.col("_s"))).cast("int").alias("insider_score"))
