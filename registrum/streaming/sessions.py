"""Typing sessions: pauses, newest inputs, settled searches and rate limits, over tables of events and as streams."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def _after(session: str, at: str, tie: str) -> Column:
    return F.lead(at).over(Window.partitionBy(session).orderBy(at, tie))


def pauses(events: DataFrame, session: str, at: str, tie: str, gap: str) -> DataFrame:
    """Events that nothing of their session follows within the gap."""
    nxt = _after(session, at, tie)
    return events.withColumn("next_", nxt).where(F.col("next_").isNull() | (F.col("next_") > F.col(at) + F.expr(f"INTERVAL {gap}"))).drop("next_")


def newest(events: DataFrame, session: str, at: str, tie: str, value: str) -> DataFrame:
    return events.groupBy(session).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def settled(events: DataFrame, session: str, at: str, tie: str, key: str, gap: str, acted: Column) -> DataFrame:
    """(session, key): what settled for the gap or was acted on, once a session."""
    nxt = _after(session, at, tie)
    kept = events.withColumn("next_", nxt).where(acted | F.col("next_").isNull() | (F.col("next_") >= F.col(at) + F.expr(f"INTERVAL {gap}")))
    return kept.select(session, key).distinct()


def held(events: DataFrame, session: str, at: str, tie: str, limited: Column, hold: str) -> DataFrame:
    """Events with held: before the end of a hold that an earlier limited event of the session began."""
    w = Window.partitionBy(session).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.when(limited, F.col(at) + F.expr(f"INTERVAL {hold}"))).over(w)
    return events.withColumn("held", F.coalesce(F.col(at) < until, F.lit(False)))


def stream_pauses(events: DataFrame, session: str, at: str, gap: str, late: str) -> DataFrame:
    """A stream's sessions (session, start, end, n): runs of events with no gap longer than `gap`, once the watermark has passed."""
    kept = events.withWatermark(at, late)
    return kept.groupBy(session, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_distinct(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """A stream's first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def pauses_by_kind(events: DataFrame, session: str, at: str, tie: str, kind: str, gaps: dict[str, str], otherwise: str) -> DataFrame:
    """As pauses(), each kind of event waiting its own time: those that no event of the session follows within it."""
    nxt = _after(session, at, tie)
    wait = F.expr(f"INTERVAL {otherwise}")
    for name, gap in gaps.items():
        wait = F.when(F.col(kind) == name, F.expr(f"INTERVAL {gap}")).otherwise(wait)
    return events.withColumn("next_", nxt).where(F.col("next_").isNull() | (F.col("next_") > F.col(at) + wait)).drop("next_")


def stream_newest(events: DataFrame, session: str, at: str, tie: str, value: str) -> DataFrame:
    """A stream's newest value of each session, as newest() tells it: stale ones that come late change nothing. For update or complete
    mode."""
    return events.groupBy(session).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def stream_settled(events: DataFrame, session: str, at: str, tie: str, key: str, gap: str, acted: Column, late: str) -> DataFrame:
    """A stream's (session, key) of settled(), each once: the last event of every run that the gap ends, once the watermark has passed, and
    at once what was acted on. The key is folded by whoever calls, so that one text counts once however it is typed."""
    timed = events.withWatermark(at, late)
    runs = timed.groupBy(session, F.session_window(at, gap).alias("w")).agg(F.max_by(key, F.struct(at, tie)).alias(key))
    done = runs.select(session, key).unionByName(timed.where(acted).select(session, key))
    return done.dropDuplicates([session, key])


def _remembering(events: DataFrame, by: list[str], at: str, tie: str, out: str, state: str, step) -> DataFrame:
    """events with a boolean column that step(state value, time in seconds, row) tells with the next state value; one value a group is
    kept between batches, and the events of a batch are taken by time."""
    schema = StructType([*events.schema.fields, StructField(out, BooleanType())])
    names = events.columns

    def run(_, frames, held):
        value = held.get[0] if held.exists else None
        rows = pd.concat(list(frames)).sort_values([at, tie], kind="stable")
        told = []
        for row in rows.to_dict("records"):
            value, answer = step(value, row[at].timestamp(), row)
            told.append(answer)
        if value is not None:
            held.update((value,))
        yield rows[names].assign(**{out: told})

    return events.groupBy(*by).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def stream_held(events: DataFrame, session: str, at: str, tie: str, limited: str, hold: float) -> DataFrame:
    """A stream's events with held, as held() tells it: before the end of a hold of `hold` seconds that an earlier event with the flag
    `limited` began. A session's state is the end of its hold."""

    def step(until, now, row):
        answer = until is not None and now < until
        end = now + hold if row[limited] else None
        return max((x for x in (until, end) if x is not None), default=None), answer

    return _remembering(events, [session], at, tie, "held", "until double", step)


def stream_unexpired(events: DataFrame, session: str, key: str, at: str, tie: str, ttl: float) -> DataFrame:
    """A stream's events with hit: whether an answer for the key that the session fetched less than ttl seconds before was there; a use
    does not prolong it. The state of a key is when it was last fetched."""

    def step(fetched, now, _):
        hit = fetched is not None and now < fetched + ttl
        return (fetched if hit else now), hit

    return _remembering(events, [session, key], at, tie, "hit", "fetched double", step)
