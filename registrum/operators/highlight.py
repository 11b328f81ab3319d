"""The parts of names that query words matched. Positions go through a fold that may lengthen or drop letters, which needs Python;
it runs on the hits that are shown, in Arrow batches."""

import os.path
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.functions.constants import FUZZY_MIN_LENGTH
from registrum.functions.text import fold_text

RANGES = "array<struct<start:int,end:int>>"
_RUN = re.compile("[a-z0-9]+")


def level(q: str, t: str) -> int:
    """What operators.match.levels gives the pair."""
    if t.startswith(q):
        return 3 if q == t else 2
    if len(q) < FUZZY_MIN_LENGTH:
        return 0
    k = len(os.path.commonprefix((q, t)))
    ends = [(t[k:], q[k + 1 :])]
    if len(t) > k:
        ends += [(t[k + 1 :], q[k + 1 :]), (t[k + 1 :], q[k:])]
    if k + 1 < len(q):
        ends.append((t[k:], q[k + 1] + q[k] + q[k + 2 :]))
    return int(any(rest.startswith(wanted) for rest, wanted in ends))


def _spellings(name: str) -> list[list[tuple[str, int]]]:
    """The words of a name as (letter, code point that it is from): runs of letters and digits, then the runs of a chunk together,
    then neighbouring single letters together."""
    letters, at, gaps = [], [], []
    for i, c in enumerate(name):
        for x in " " if c.isspace() else fold_text(c):
            letters.append(x)
            at.append(i)
            gaps.append(c.isspace())
    folded = "".join(letters)
    runs, places = [], []
    for m in _RUN.finditer(folded):
        runs.append([(folded[k], at[k]) for k in range(*m.span())])
        places.append(sum(gaps[: m.start()]))
    chunks: dict[int, list] = {}
    for run, place in zip(runs, places, strict=True):
        chunks.setdefault(place, []).append(run)
    streaks, streak = [], []
    for run in [*runs, [()] * 2]:
        if len(run) == 1:
            streak.append(run)
        else:
            streaks.append(streak)
            streak = []
    together = [parts for parts in [*chunks.values(), *streaks] if len(parts) >= 2]
    return runs + [[x for run in parts for x in run] for parts in together]


def mark_ranges(query: Iterable[str], name: str) -> list[tuple[int, int]]:
    """Half-open ranges of code points, ascending, neither overlapping nor touching: of each query word's best word in the name (the
    first of equals) the part that was typed."""
    spelled = [("".join(c for c, _ in w), w) for w in _spellings(name)]
    found = []
    for q in query:
        best = max(spelled, key=lambda s: level(q, s[0]), default=None)
        if best and level(q, best[0]):
            found.append((best[1][0][1], best[1][min(len(q), len(best[0])) - 1][1] + 1))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def name_marks(query: Iterable[str], name: str | None, others: Iterable[str] | None) -> tuple:
    """(ranges of the legal name, other name, its ranges): another name is shown if nothing of the legal name is marked, the one with
    most of it marked, the first of equals."""
    query = list(query) if query is not None else []
    legal = mark_ranges(query, name or "")
    if legal:
        return legal, None, []
    marked = [(o, mark_ranges(query, o)) for o in (others if others is not None else ()) if o]
    best = max(marked, key=lambda m: sum(b - a for a, b in m[1]), default=None)
    return (legal, *best) if best and best[1] else (legal, None, [])


def _marks(rows: pd.DataFrame) -> pd.DataFrame:
    out = [name_marks(q, n, o) for q, n, o in zip(rows["tokens"], rows["name"], rows["others"], strict=True)]
    shaped = lambda ranges: [{"start": a, "end": b} for a, b in ranges]
    return pd.DataFrame({"legal": [shaped(x[0]) for x in out], "aka": [x[1] for x in out], "aka_ranges": [shaped(x[2]) for x in out]})


def highlight(hits: DataFrame) -> DataFrame:
    """hits (tokens, name, others, ...) with legal, aka and aka_ranges. Null names and lists have no words."""
    marks = F.pandas_udf(_marks, f"struct<legal:{RANGES},aka:string,aka_ranges:{RANGES}>")
    met = hits.withColumn("marks_", marks(F.struct("tokens", "name", "others")))
    return met.select(*hits.columns, "marks_.legal", "marks_.aka", "marks_.aka_ranges")
