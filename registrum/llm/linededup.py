"""Substring removal by units: paragraphs and lines, each known by the digest of its normal form. Digests are grouped over all
documents; the occurrence that ranks first (least doc_id, then place) stays, every other one is removed and told by its offsets
in the original text.

Passages that begin or end inside a line have no digest of their own. They are found by grams of GRAM words, chosen by winnowing
(Schleimer, Wilkerson and Aiken, 2003): of any WINDOW words in a row the least gram is chosen, so that two texts that share a
passage of that length choose the same gram in it, while only one word in thirteen gives a row. Runs of grams that occurred
before are extended word by word, as far as the words around the first occurrence are the same, and go if they are WINDOW words
or longer.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.llm._shared import bounded, lean, scratch, staged
from registrum.llm.wordhash import mix, word_hashes

#: Words of the shortest line or paragraph that is looked up.
MIN_WORDS = 8
#: Words of a gram, grams of a window, and words of a window: the shortest passage that is found wherever it starts.
GRAM, SPAN = 25, 25
WINDOW = GRAM + SPAN - 1
_UNITS = {"paragraph": re.compile(r"[^\n]+(?:\n(?![ \t]*\n)[^\n]+)*"), "line": re.compile(r"[^\n]+"), "sentence": re.compile(r"[^\n.!?]*[^\n.!?\s][^\n.!?]*[.!?]*")}
_WORD = re.compile(r"[^\t-\r ]+")
KINDS = ("paragraph", "line")


def normal(unit: str) -> str:
    """Lower case, white space runs to one space, and no ends of punctuation or space."""
    return " ".join(unit.lower().split()).strip(".,;:!?\"'()[]- ")


def units(text: str, kinds: tuple[str, ...] = KINDS, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of a text that have `min_words` words or more; what is unit of two kinds comes once."""
    seen = set()
    for kind in kinds:
        for m in _UNITS[kind].finditer(text):
            shape = normal(m[0])
            if shape.count(" ") + 1 >= min_words and m.span() not in seen:
                seen.add(m.span())
                yield m.start(), m.end(), hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def winnowed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of the chosen grams: the least of each WINDOW words within a row, the first of equal ones."""
    count, words = word_hashes(column)
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    n = max(0, len(words) - GRAM + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    grams = mix(grams)
    best, width = np.arange(n), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        a, b = best[: max(0, len(best) - step)], best[step:]
        best, width = np.where(grams[a] <= grams[b], a, b), width + step
    whole = (count[owner] - place)[: len(best)] >= WINDOW
    chosen = np.unique(best[whole])
    return owner[chosen], place[chosen], grams[chosen]


def _slices(batches: Iterator[pa.RecordBatch], letters: int = 2_000_000, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and some `letters` bytes of text; a longer text alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, "right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def _listing(kinds: tuple[str, ...], min_words: int):
    """Units with their places in code points, and chosen grams with their first word, the end -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [(k, *u) for k, text in enumerate(batch.column("text").to_pylist()) for u in units(text or "", kinds, min_words)]
            row, place, gram = winnowed(batch.column("text"))
            packed, m = gram.tobytes(), len(gram)
            at = pa.array(np.concatenate([np.array([f[0] for f in found], np.int64), row]))
            starts = np.concatenate([np.array([f[1] for f in found], np.int64), place])
            ends = np.concatenate([np.array([f[2] for f in found], np.int64), np.full(m, -1)])
            digests = [f[3] for f in found] + [packed[8 * k : 8 * k + 8] for k in range(m)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(at), "text_key": batch.column("text_key").take(at), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32()), "digest": pa.array(digests, pa.binary())})

    return run


def _short(hashes: np.ndarray) -> bytes:
    return hashes.astype(np.uint32).tobytes()


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the grams wanted of each text: the hashes of the words before and after them."""
    for batch in _slices(batches):
        count, words = word_hashes(batch.column("text"))
        ends = np.cumsum(count)
        rows = [(w["digest"], _short(own[max(0, w["start"] - SPAN + 1) : w["start"]]), _short(own[w["start"] + GRAM : w["start"] + WINDOW])) for wanted, own in zip(batch.column("wanted").to_pylist(), np.split(words, ends[:-1]), strict=True) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], names=["digest", "before", "after"])


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def extended(words: np.ndarray, run: dict) -> tuple[int, int]:
    """First word and end of a run of grams, with the words on both sides that are those around the first occurrences."""
    before, after = (np.frombuffer(run[c] or b"", np.uint32) for c in ("before", "after"))
    lo = run["lo"] - _same(words[: run["lo"]][::-1], before[::-1])
    hi = run["hi"] + GRAM
    return max(lo, run["least"]), hi + _same(words[hi:], after)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        kept, spans, sizes = [], [], []
        for text, found, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "found", "runs")), strict=True):
            pieces = [(f["start"], f["end"]) for f in found or []]
            if runs:
                words, places = word_hashes(pa.array([text]))[1].astype(np.uint32), [m.span() for m in _WORD.finditer(text)]
                wide = merge([extended(words, r) for r in runs])
                pieces += [(places[lo][0], places[hi - 1][1]) for lo, hi in wide if hi - lo >= WINDOW]
            merged = merge(pieces)
            kept.append(text if not merged else cut(text, merged))
            spans.append(",".join(f"{a}:{b}" for a, b in merged))
            sizes.append(sum(b - a for a, b in merged))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_removed": pa.array([s.count(":") for s in spans], pa.int64()), "chars_removed": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.string()), "kept_text": pa.array(kept, pa.string())})


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def _of(rows: DataFrame, other: DataFrame) -> Column:
    """The same document: doc_id, null-safe, and hash of the text."""
    return rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["text_key"] == other["text_key"])


def _again(listed: DataFrame, end: Column, name: str) -> DataFrame:
    """What occurred before, with its first occurrence. A digest's minimum is pre-aggregated, and only digests met twice are
    joined; a very common one is split by the planner's skew join."""
    rank = F.struct("doc_id", "text_key", "start", "end")
    firsts = listed.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("final")).where(~F.col("first").eqNullSafe(F.col("final")))
    met = listed.join(staged(firsts.select("digest", "first"), name), "digest")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    # what overlaps its own first occurrence leaves that one whole
    return met.withColumn("own", own).where(~(F.col("own") & (F.col("start") < end)))


def _runs(grams: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, runs): of each document the runs of grams that occurred before (lo, hi: first words of the first and last
    gram), the words around the first occurrence of both, and the least word that a run may reach back to."""
    again = _again(grams, F.col("first.start") + GRAM, "first-grams").select("doc_id", "text_key", "start", "digest", "first", F.when(F.col("own"), F.col("first.start") + GRAM).otherwise(0).alias("least"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("start")
    begun = again.withColumn("new", F.when(F.col("start") - F.lag("start").over(order) <= GRAM, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    ends = F.struct("digest", "first")
    runs = begun.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.min_by("least", "start").alias("least"), F.min_by(ends, "start").alias("one"), F.max_by(ends, "start").alias("two"))
    runs = staged(runs.drop("run"), "runs")
    wanted = runs.select(F.explode(F.array("one", "two")).alias("w")).select("w.*").distinct()
    wanted = wanted.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "digest")).alias("wanted"))
    wanted = staged(wanted, "wanted")
    keys = bounded(wanted.select("doc_id", "text_key"))
    held = rows.join(keys, _of(rows, keys), "left_semi")
    around = held.join(wanted, _of(held, wanted)).select("text", "wanted").mapInArrow(lean(_surroundings), "digest binary, before binary, after binary")
    around = staged(around.dropDuplicates(["digest"]), "around")
    before, after = around.select(F.col("digest").alias("one_"), "before"), around.select(F.col("digest").alias("two_"), "after")
    told = runs.join(before, F.col("one.digest") == F.col("one_")).join(after, F.col("two.digest") == F.col("two_"))
    return told.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi", "least", "before", "after")).alias("runs"))


def dedup_units(docs: DataFrame, *, key: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, n_removed, chars_removed, spans, kept_text) of every row of docs. spans are start:end in code points of the original
    text, adjacent ones joined; kept_text is the text without them.

    The first occurrence of a unit over all documents stays, by doc_id (null first), then hash of the text, then place; a unit
    repeated within a document is removed there too, unless it overlaps its first occurrence. So is every passage of WINDOW words
    or more whose words stand in the same order in an earlier place, wherever it starts. A null text stays null and has no units;
    texts without a unit of `min_words` words and without a passage are left alone; an empty table gives none; of repeated rows
    each gives a row, and as copies of one row they are treated alike. Other columns are ignored. Digests and places are shuffled,
    and the texts once, to meet what is cut from them.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("text_key"), docs[text].alias("text"))
    with scratch(docs.sparkSession) as keep:
        listed = staged(rows.mapInArrow(lean(_listing(kinds, min_words)), "doc_id long, text_key long, start int, end int, digest binary"), "units")
        again = _again(listed.where("end >= 0"), F.col("first.end"), "first-units")
        found = again.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("found"))
        runs = _runs(listed.where("end < 0"), rows)
        both = found.join(runs, _of(found, runs), "full_outer").select(F.coalesce(found["doc_id"], runs["doc_id"]).alias("doc_id"), F.coalesce(found["text_key"], runs["text_key"]).alias("text_key"), "found", "runs")
        both = keep(staged(both, "cuts"))
    out = rows.join(both, _of(rows, both), "left").select(rows["doc_id"], rows["text"], "found", "runs").mapInArrow(lean(_cut), "doc_id long, n_removed long, chars_removed long, spans string, kept_text string")
    return out.withColumnRenamed("doc_id", key)
