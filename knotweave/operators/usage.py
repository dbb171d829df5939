"""Session funnels over tool-call events (ts day-comparable, sid, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO = ("consult", "search", "read")


def in_window(ts: Column, since: str | None = None, until: str | None = None) -> Column:
    """Whether a time's day lies in the inclusive range; an unknown time only in an open one."""
    day = F.to_date(ts)
    out = F.lit(True)
    if since:
        out = out & F.coalesce(day >= F.lit(since).cast("date"), F.lit(False))
    if until:
        out = out & F.coalesce(day <= F.lit(until).cast("date"), F.lit(False))
    return out


def regime(ts: Column, available: str | None, rewritten: str) -> Column:
    """pre, early or current by two dates; unknown without a time."""
    day = F.to_date(ts)
    pre = (day < F.lit(available).cast("date")) if available else F.lit(False)
    return F.when(day.isNull(), "unknown").when(pre, "pre").when(day < F.lit(rewritten).cast("date"), "early").otherwise("current")


def first_moves(events: DataFrame, info: tuple[str, ...] = INFO) -> DataFrame:
    """``sid kind ts``: each session's earliest info-seeking event, ties by place."""
    return events.where(F.col("kind").isin(*info)).groupBy("sid").agg(F.min(F.struct("ts", "pos", "kind")).alias("f")).select("sid", "f.kind", "f.ts")


def funnel(events: DataFrame, by: str, consult: str = "consult", save: str = "save") -> DataFrame:
    """For each value of ``by``: events, sessions, consulting and saving sessions, their shares."""
    sessions = F.count_distinct("sid")
    used = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("sid")))
    out = events.groupBy(by).agg(F.count("*").alias("events"), sessions.alias("sessions"), used(consult).alias("consult_sessions"), used(save).alias("save_sessions"))
    return out.withColumns({"consult_rate": F.try_divide("consult_sessions", "sessions"), "save_rate": F.try_divide("save_sessions", "sessions")})


def kind_counts(events: DataFrame, by: str, kinds: tuple[str, ...]) -> DataFrame:
    """Events of each kind as columns."""
    return events.groupBy(by).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
