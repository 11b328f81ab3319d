"""What caches of a session would have answered: least recently used keys, expiring answers, answers kept once given. Each is a fold
over a session's events in order: one pass over sorted partitions, holding one session's state at a time and never its events."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def _fold(events: DataFrame, session: str, order: list[str], out: str, start: Callable[[], dict], step: Callable[[dict, pd.Series], bool], used: list[str]) -> DataFrame:
    schema = StructType([*events.schema.fields, StructField(out, BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            answers = []
            for s, *row in batch[[session, *used]].itertuples(index=False, name=None):
                s = None if pd.isna(s) else s
                if s not in held:
                    held.clear()
                    held[s] = start()
                answers.append(step(held[s], row))
            yield batch.assign(**{out: answers})

    return events.repartition(session).sortWithinPartitions(session, *order).mapInPandas(run, schema)


def recently_used(events: DataFrame, session: str, order: list[str], key: str, capacity: int, out: str = "hit") -> DataFrame:
    """Events with whether a cache of the session's `capacity` last used keys held the key."""

    def step(state: dict, row: list) -> bool:
        hit = row[0] in state
        state.pop(row[0], None)
        state[row[0]] = True
        if len(state) > capacity:
            del state[next(iter(state))]
        return hit

    return _fold(events, session, order, out, dict, step, [key])


def unexpired(events: DataFrame, session: str, order: list[str], key: str, at: str, ttl: float, out: str = "hit") -> DataFrame:
    """Events with whether an answer fetched less than ttl seconds before was there; a use does not prolong it. The session's expired
    answers are dropped when the next one is fetched."""

    def step(state: dict, row: list) -> bool:
        name, moment = row[0], pd.Timestamp(row[1]).timestamp()
        if moment < state.get(name, float("-inf")) + ttl:
            return True
        for old in [k for k, t in state.items() if t + ttl <= moment]:
            del state[old]
        state[name] = moment
        return False

    return _fold(events, session, order, out, dict, step, [key, at])


def answered(events: DataFrame, session: str, order: list[str], key: str, failed: Column, out: str = "hit") -> DataFrame:
    """Events with whether an earlier one of the session got an answer for the key; failures aren't kept."""
    w = Window.partitionBy(session, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(out, F.coalesce(F.max(~failed).over(w), F.lit(False)))


def phase(hits: Column, tokens: Column, short: Column, bad_code: Column) -> Column:
    """What a search shows: idle without words, bad-lei, short, done or no-match."""
    return F.when(hits > 0, "done").when(bad_code, "bad-lei").when(F.size(tokens) == 0, "idle").when(short, "short").otherwise("no-match")
