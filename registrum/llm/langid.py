"""Language identification: script ranges narrow each word's candidates, n-gram scores rank them, and a Viterbi pass with a
penalty for switching labels the spans of mixed-language text."""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from registrum.llm._shared import lean

#: Bounds of what is learned from: documents of each language, and n-grams kept.
DOCS_PER_LANG, GRAMS = 600, 30_000
SWITCH, BARRED = 9.0, -40.0
_WORD = re.compile(r"[^\W\d_]+")

# First and last code point of ranges, by script (Unicode blocks).
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x3040, 0x30FF, "kana"),
    (0x4E00, 0x9FFF, "han"), (0x3400, 0x4DBF, "han"), (0xAC00, 0xD7AF, "hangul"),
)


def script_of(letter: str) -> str:
    code = ord(letter)
    return next((name for lo, hi, name in SCRIPTS if lo <= code <= hi), "other")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lowered(text: str) -> str:
    """Lower case, letter by letter where the whole would change its length: places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


@dataclass
class Model:
    """langs; number of each n-gram, and by number its log-probability in each language (the last: that of any other n-gram);
    scripts: which languages are written in each."""

    langs: list[str]
    numbers: dict[str, int]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]

    def words(self, listed: list[str]) -> np.ndarray:
        """Scores of each word (not empty) in each language; languages that aren't written in the word's script are barred."""
        other, get = len(self.numbers), self.numbers.get
        found = [[get(g, other) for g in grams(w)] for w in listed]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((k for ks in found for k in ks), np.int64, int(sizes.sum()))
        total = np.add.reduceat(self.scores[flat], np.cumsum(sizes) - sizes, axis=0) * (4.0 / (4 + sizes))[:, None]
        allowed = np.ones(total.shape, bool)
        for k, w in enumerate(listed):
            own = self.scripts.get(script_of(w[0]))
            if own is not None:
                allowed[k] = own
        return np.where(allowed, total, total + BARRED).astype(np.float32)


def fit(samples: list[tuple[str, str]], keep: int = GRAMS) -> Model:
    """The model of (language, text) samples."""
    counts: dict[str, Counter] = defaultdict(Counter)
    letters: dict[str, Counter] = defaultdict(Counter)
    for lang, text in samples:
        for word, n in Counter(_WORD.findall(lowered(text))).items():
            letters[lang][script_of(word[0])] += n * len(word)
            for g in grams(word):
                counts[lang][g] += n
    langs = sorted(counts)
    total = Counter()
    sizes = [sum(counts[x].values()) for x in langs]
    for lang, size in zip(langs, sizes, strict=True):
        total.update({g: n / size for g, n in counts[lang].items()})
    kept = sorted(total, key=lambda g: (-total[g], g))[:keep]
    scores = np.array([[math.log((counts[x][g] + 0.5) / (size + 0.5 * keep)) for x, size in zip(langs, sizes, strict=True)] for g in kept], np.float32).reshape(len(kept), len(langs))
    unseen = float(np.mean([math.log(0.5 / (size + 0.5 * keep)) for size in sizes])) if sizes else 0.0
    scores = np.concatenate([scores, np.full((1, len(langs)), unseen, np.float32)])
    scripts = {s: np.array([letters[x][s] >= 0.02 * sum(letters[x].values()) for x in langs]) for s in {s for c in letters.values() for s in c}}
    return Model(langs, {g: k for k, g in enumerate(kept)}, scores, {s: a for s, a in scripts.items() if a.any()})


def learn(docs: DataFrame, *, per_lang: int = DOCS_PER_LANG, keep: int = GRAMS) -> Model:
    """The model of a sample of whole labelled texts: of each language the `per_lang` documents with the least hash of their
    doc_id, or all if they are fewer. Held-out documents and null languages and texts are not learned from."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("rank"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([])
    # a band of hashes that holds twice as many as are wanted, on average: what comes to the driver is bounded
    reach = lambda n: min(1.0, (2 * per_lang + 50) / n)
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("rank") <= min(2**63 - 1, int(reach(n) * 2**64) - 2**63)))
    rows = defaultdict(list)
    for r in usable.where(wanted).select("lang", "rank", "doc_id").collect():
        rows[r["lang"]].append((r["rank"], r["doc_id"]))
    chosen = {i for found in rows.values() for _, i in sorted(found)[:per_lang]}
    picked = usable.where(wanted).where(F.col("doc_id").isin(list(chosen))).select("lang", "text").collect()
    return fit([(r["lang"], r["text"]) for r in picked], keep)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word. scores: words by languages, texts one after the other; counts: words of each text. All texts
    take each step together, longest first, so the number of steps is that of the longest."""
    n, k = scores.shape
    order = np.argsort(-counts, kind="stable")
    starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    came = np.zeros((n, k), np.int8 if k < 128 else np.int32)
    value = np.zeros((len(counts), k), np.float32)
    live, own = int(np.count_nonzero(lengths)), np.arange(k)
    last = np.zeros(len(counts), np.int64)
    steps = int(lengths[0]) if len(lengths) else 0
    actives = np.searchsorted(-lengths, -np.arange(steps), "left")
    for t in range(steps):
        live = int(actives[t])
        at, now = starts[:live] + t, value[:live]
        if t:
            best = now.argmax(1)
            jump = now[np.arange(live), best] - switch
            stay = now >= jump[:, None]
            came[at] = np.where(stay, own, best[:, None])
            now = np.where(stay, now, jump[:, None])
        value[:live] = now + scores[at]
    labels = np.zeros(n, np.int64)
    last = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        live = int(actives[t])
        at = starts[:live] + t
        labels[at] = last[:live]
        last[:live] = came[at, last[:live]]
    return labels


class Tagger:
    """Labels texts; keeps the scores of at least the last `keep` different words. Row 0 stands for what has no letters."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep = model, keep
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, len(model.langs)), np.float32)

    def _learn(self, listed: list[list[str]]) -> None:
        if len(self.known) > self.keep:
            self.known, self.table = {}, self.table[:1]
        new = list(set().union(*listed).difference(self.known))
        shapes = [w if w[0].isalpha() else "".join(c for c in w if c.isalpha()) for w in new]
        scored = [w for w in dict.fromkeys(shapes) if w]
        rows = {w: k for k, w in enumerate(scored, len(self.table))}
        if scored:
            self.table = np.concatenate([self.table, self.model.words(scored)])
        self.known.update((w, rows.get(shape, 0)) for w, shape in zip(new, shapes, strict=True))

    def tag(self, texts: list[str | None], with_spans: bool) -> list[tuple[str, float, str]]:
        """(language, share of letters in it, spans) of each text."""
        if not self.model.langs:
            return [("und", 0.0, "")] * len(texts)
        listed = [_WORD.findall(lowered(text)) if text else [] for text in texts]
        self._learn(listed)
        known, total = self.known, sum(map(len, listed))
        ids = np.fromiter((k for words in listed for k in map(known.__getitem__, words)), np.int64, total)
        weights = np.fromiter((n for words in listed for n in map(len, words)), np.int64, total)
        counts = np.array([len(words) for words in listed])
        labels, out, at = viterbi(self.table[ids], counts), [], 0
        for text, c in zip(texts, counts, strict=True):
            part, w = labels[at : at + c], np.where(ids[at : at + c] == 0, 0, weights[at : at + c])
            at += c
            total = int(w.sum())
            if not total:
                out.append(("und", 0.0, ""))
                continue
            share = np.bincount(part, weights=w, minlength=len(self.model.langs))
            best = int(share.argmax())
            out.append((self.model.langs[best], float(share[best] / total), self._spans(text, part) if with_spans else ""))
        return out

    def _spans(self, text: str, labels: np.ndarray) -> str:
        """start:end:language in code points of the text, a span for each run of words of one language."""
        places = [(m.start(), m.end()) for m in _WORD.finditer(lowered(text))]
        cut = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1], [True]]))
        return ",".join(f"{places[a][0]}:{places[b - 1][1]}:{self.model.langs[labels[a]]}" for a, b in zip(cut[:-1], cut[1:], strict=True))


def _tagging(shared, with_spans: bool, letters: int = 1_000_000, with_text: bool = False, names: tuple[str, str] = ("lang_pred", "score")):
    """Texts of a batch are taken by length, some `letters` at a time (a longer text alone): what is held follows that, and the
    steps that all take together are few where texts are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), np.int64)
            order = np.argsort(-sizes, kind="stable")
            sums, at = np.cumsum(sizes[order]), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + letters, "right")))
                part = batch.take(pa.array(order[at:to]))
                rows = tagger.tag(part.column("text").to_pylist(), with_spans)
                columns = {n: part.column(n) for n in part.schema.names if with_text or n != "text"}
                columns |= {names[0]: pa.array([r[0] for r in rows], pa.string()), names[1]: pa.array([r[1] for r in rows], pa.float64())}
                yield pa.RecordBatch.from_pydict(columns | ({"spans": pa.array([r[2] for r in rows], pa.string())} if with_spans else {}))
                at = to

    return run


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """(key, held_out, lang_pred, score, spans) of every row: the language of most of the text's letters and their share.

    `und` and 0 where a text is null or has no letters, or nothing was learned. Repeated rows each give a row; a null key stays
    null and is not held out; an empty table gives none; other columns are ignored. No shuffle; the model, whose size `fit`
    bounds, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[key].cast("long").alias("k"), held_out(docs[key]).alias("held_out"), docs[text].alias("text"))
    out = "k long, held_out boolean, lang_pred string, score double" + ", spans string" * with_spans
    return rows.mapInArrow(lean(_tagging(shared, with_spans)), out).withColumnRenamed("k", key)


def labelled(docs: DataFrame, model: Model, *, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of docs (with a column text) and two more columns, the language and its share as identify tells them; their names
    must be none of docs' own. Rows need no key: nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(lean(_tagging(shared, False, with_text=True, names=(lang, score))), schema)
