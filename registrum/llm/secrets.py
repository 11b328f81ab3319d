"""Secret scans: fixed patterns, and values in a credential's place whose guessing cost is high.

The cost is that of the cheapest way to put the value together from known words, dates, repeats, keyboard walks, runs of
the alphabet and brute force, found by dynamic programming over its characters (after Wheeler's zxcvbn, USENIX Security 2016).
Known words are those of common passwords and, ranked behind them, the most frequent words of the documents themselves.
"""

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm._shared import lean, scratch, staged

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 and more: what [0-9a-f]+ finds, less its shorter matches
#: Key names may have a prefix (db_password, dbPassword) and a suffix (secret_key, secretKey); a quoted value ends at its closing
#: quote, another at a space or comma.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z]))|(?=passw|passphrase|passcode|pwd|secret))
    (?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client)[_-]?key|auth|credentials?)
    (?:(?:[_.-]|(?=[0-9])|(?-i:(?<=[a-z])(?=[A-Z])))[A-Za-z0-9_.-]*+)?
    ["']?\x20*(?::=|=>|[:=])\x20*
    (?:"((?:\\.|[^"\\\n]){8,})"|'((?:\\.|[^'\\\n]){8,})'|["']?([^\s"'<>,;]{8,}))""",
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
#: log10 of the guesses from which a value in a credential's place counts as a secret.
THRESHOLD = 10.0

# Common passwords' words by rank, and the keyboard's rows.
COMMON = tuple(
    """password love admin welcome monkey dragon master login princess qwerty sunshine football baseball shadow michael
    superman letmein trustno secret token hello freedom whatever jordan summer winter spring autumn hunter ranger buster
    soccer hockey george charlie andrew michelle jessica pepper daniel access batman test user guest root server example
    change default sample temp demo key api auth pass the and for you""".split()
)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_YEAR, _MONTH, _DAY, _SEP = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._]?"
#: A date or a year from here on: of both the whole date and its year are read.
_DATE = re.compile(rf"(?=({_YEAR}{_SEP}{_MONTH}{_SEP}{_DAY}|{_DAY}{_SEP}{_MONTH}{_SEP}{_YEAR})?({_YEAR})?)", re.ASCII)
#: The longest part of a run or repeat, besides the whole, that is weighed.
PIECE = 32
#: Words that are learned from the documents: what comes to the driver and goes to every task, some 200 kB.
LEARNED = 20_000


def _neighbours() -> dict[str, set[str]]:
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    return {a: {b for b, (q, j) in at.items() if b != a and abs(q - r) <= 1 and abs(j - k) <= 1} for a, (r, k) in at.items()}


_NEAR = _neighbours()


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


class GuessCost:
    """log10 of the guesses that a value takes. words: by rank, most common first."""

    def __init__(self, words: tuple[str, ...] = COMMON):
        self.rank = {w: k + 1 for k, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=0)

    def _words(self, value: str) -> Iterator[tuple[int, int, float]]:
        low = value.lower()
        for variant, extra in ((low, 0.0), (low.translate(_LEET), 0.5)):
            for i in range(len(value)):
                for j in range(i + 3, min(len(value), i + self.longest) + 1):
                    if (rank := self.rank.get(variant[i:j])) is not None:
                        yield i, j, math.log10(rank + 1) + extra + 0.3 * (value[i:j] != low[i:j])

    def _runs(self, value: str) -> Iterator[tuple[int, int, float]]:
        """Keyboard walks and runs of consecutive characters, three and longer, and every part of them of three to PIECE."""
        low = value.lower()
        for joined, start in ((lambda a, b: b in _NEAR.get(a, ()), 1.7), (lambda a, b: abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum(), 1.4)):
            i = 0
            while i < len(low):
                j = i + 1
                while j < len(low) and joined(low[j - 1], low[j]):
                    j += 1
                for a, b in _parts(i, j):
                    yield a, b, start + math.log10(b - a) + 0.2 * (b - a)
                i = j

    def _dates(self, value: str) -> Iterator[tuple[int, int, float]]:
        for m in _DATE.finditer(value):  # looks ahead: dates may overlap
            for a, b in {m.span(1), m.span(2)} - {(-1, -1)}:
                yield a, b, math.log10(365 * 119 if b - a > 4 else 365)

    def _repeats(self, value: str) -> Iterator[tuple[int, int, float]]:
        """Units of up to eight characters said twice and more, three characters at least: every number of times up to PIECE characters,
        and as often as they come."""
        unit_cost: dict[str, float] = {}
        for size in range(1, min(8, len(value) // 2) + 1):
            same = [value[k] == value[k + size] for k in range(len(value) - size)] + [False]
            end = [0] * (len(value) - size + 1)  # how many characters from here are those `size` further on
            for k in range(len(value) - size - 1, -1, -1):
                end[k] = end[k + 1] + 1 if same[k] else 0
            for i in range(len(value) - size):
                times = end[i] // size + 1
                if times < 2:
                    continue
                unit = value[i : i + size]
                if unit not in unit_cost:
                    unit_cost[unit] = self.log10(unit, repeats=False)
                for n in {*range(2, min(times, PIECE // size) + 1), times}:
                    if n * size >= 3:
                        yield i, i + n * size, unit_cost[unit] + math.log10(n)

    def matches(self, value: str, repeats: bool = True) -> Iterator[tuple[int, int, float]]:
        """(start, end, log10 of guesses) of every part of the value that is a word, a run, a date or a repeat."""
        yield from self._words(value)
        yield from self._runs(value)
        if repeats:
            yield from self._dates(value)
            yield from self._repeats(value)

    def log10(self, value: str, repeats: bool = True) -> float:
        """The least sum over all segmentations into matches and spans of brute force; each further segment doubles the guesses."""
        ends: dict[int, list[tuple[int, float]]] = {}
        for i, j, cost in self.matches(value, repeats):
            ends.setdefault(j, []).append((i, cost))
        step = math.log10(2)
        best, brute = [0.0] + [math.inf] * len(value), [math.inf] * (len(value) + 1)
        for j in range(1, len(value) + 1):
            brute[j] = min(brute[j - 1], best[j - 1] + (step if j > 1 else 0)) + _brute(value[j - 1])
            best[j] = min([brute[j], *(best[i] + cost + (step if i else 0) for i, cost in ends.get(j, ()))])
        return best[-1]


def _parts(i: int, j: int) -> Iterator[tuple[int, int]]:
    """Parts of three and more of a run: all up to PIECE long, and the whole."""
    for a in range(i, j - 2):
        for b in range(a + 3, min(j, a + PIECE) + 1):
            yield a, b
    if j - i > PIECE:
        yield i, j


def learn_words(docs: DataFrame, *, text: str = "text", keep: int = LEARNED, least: int = 3) -> tuple[str, ...]:
    """The words of all texts by frequency, most common first (then by the word): those of three to twenty letters that occur `least`
    times or more, at most `keep` of them. Counts are taken over all documents, and then of words by an eighth of an octave of their
    count, so that only whole steps that fit into `keep` are asked for: what comes to the driver is bounded."""
    listed = F.regexp_extract_all(F.lower(docs[text]), F.lit(r"\p{L}{3,20}+(?!\p{L})"), F.lit(0))
    with scratch(docs.sparkSession):
        counts = docs.select(F.explode(listed).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        counts = staged(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "words")
        lowest, total = None, 0
        for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect():
            total += r["n"]
            if total > keep:
                break
            lowest = r["step"]
        rows = [] if lowest is None else counts.where(F.col("step") >= lowest).select("n", "word").collect()
    return tuple(r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"])))


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough, by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def guess_spans(text: str, cost: GuessCost, threshold: float = THRESHOLD) -> list[Span]:
    """Values in a credential's place that take 10**threshold guesses or more."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    return [("guess", *m.span(m.lastindex)) for m in CONTEXT.finditer(text) if cost.log10(m[m.lastindex]) >= threshold]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by a mark with the first one's kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _scan(threshold: float, shared, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(shared.value)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                both = sorted(base + guess_spans(text or "", cost, threshold), key=lambda s: (s[1], KINDS.index(s[0])))
                for kind in KINDS[:3]:
                    rows[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(both))
                rows["redacted"].append(redact(text, both) if both else text)
            types = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64()}
            keep = rows if with_text else [k for k in rows if k != "redacted"]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names if n != "text"} | {k: pa.array(rows[k], types.get(k, pa.string())) for k in keep})

    return run


def _known(docs: DataFrame, words: tuple[str, ...] | None, text: str):
    """The ranked words, broadcast: those given, or the common ones and those learned from the documents."""
    ranked = words if words is not None else tuple(dict.fromkeys((*COMMON, *learn_words(docs, text=text))))
    return docs.sparkSession.sparkContext.broadcast(ranked)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: tuple[str, ...] | None = None, with_text: bool = True) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, redacted) of every row of docs. Spans are kind:start:end in code
    points, end exclusive, joined by commas, by start and then kind; redacted is the text with all spans marked out.

    words: ranked words that guessing begins with; by default common ones and the LEARNED most frequent of all documents. A null text
    has no spans and stays null; so does a null key. Repeated rows each give a row; an empty table gives none. Other columns are
    ignored. Only counts of words are shuffled: every text is scanned whole where it is read.
    """
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("text"))
    out = "k long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * with_text
    return rows.mapInArrow(lean(_scan(threshold, _known(docs, words, text), with_text)), out).withColumnRenamed("k", key)


def _redact_rows(threshold: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(shared.value)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "") + guess_spans(text or "", cost, threshold)
                texts.append(redact(text, spans) if spans else text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return run


def redacted(docs: DataFrame, *, threshold: float = THRESHOLD, words: tuple[str, ...] | None = None) -> DataFrame:
    """The documents with their secrets marked out of the text and n_chars, if there is one, of the new text. All rows and columns
    stay; null texts stay null; words as in scan_secrets."""
    out = docs.mapInArrow(lean(_redact_rows(threshold, _known(docs, words, "text"))), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
