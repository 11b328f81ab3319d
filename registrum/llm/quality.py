"""Quality rules as a ledger of failure bits, in DataFrame operations only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit for each rule that fails. A policy
is a versioned mask over the bits, so policies and ablations are bitwise work on the ledger and never read a text again.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
SPAN = 8


@dataclass(frozen=True)
class Rule:
    """A rule by name and what fails it, over the ledger's measurements."""

    name: str
    fails: str


#: The order gives the bits: only ever append.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_spans", "100 * n_repeat_words > 30 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("no_letters", "100 * n_letter_words < 70 * n_words"),
    Rule("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("upper_case", "2 * n_upper_words > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the named rules."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << k for k, r in enumerate(rules) if r.name in self.rules)


BASE = Policy("base", ("few_words", "repeated_spans"))
POLICIES = (BASE, Policy("v1", tuple(r.name for r in RULES if r.name not in ("upper_case", "bullets"))), Policy("v2", tuple(r.name for r in RULES)))


def bind(value: Column, body) -> Column:
    """body(value) with the value worked out once: lambdas get their argument by reference."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column, span: int = SPAN) -> Column:
    """Words of an array that lie in a window of `span` words found twice or more in it, each counted once."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (span - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(span))))

    def covered(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(
            ranked,
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-span).alias("last"))
        total = F.aggregate(F.sort_array(again), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(span), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), total).otherwise(F.lit(0))

    return F.when(F.size(w) > span, bind(hashes, covered)).otherwise(F.lit(0)).cast("long")


def measurements(text: Column) -> dict[str, Column]:
    """What the rules look at, except for repeats (those need the array of words)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "lines": bind(lines, lambda x: F.array(F.size(x).cast("long"), F.size(F.array_distinct(x)).cast("long"))),
        "n_letter_words": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}")).cast("long"),
        "n_bullet_lines": F.regexp_count(text, F.lit(r"(?m)^[\x20\x09]*[-*•‣▪]")).cast("long"),
        "n_upper_words": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}{2}[^\x20\x09-\x0D\p{Ll}]*+(?![^\x20\x09-\x0D])")).cast("long"),
    }


def ledger(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, the measurements, failed): failed has bit k set if rule k fails.

    A null text has no words, lines or symbols, and fails what an empty one fails. Repeated rows each give a row; a null key
    stays null; an empty table gives none. No shuffle: each document is measured where it is read.
    """
    whole = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    m = measurements(F.col("body"))
    # the words go through a generator, past which the optimizer does not copy their expression into every lambda
    split = whole.select("doc_id", *(c.alias(n) for n, c in m.items()), F.explode(F.array(F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))).alias("w"))
    found = split.withColumn("n_repeat_words", repeat_words(F.col("w")))
    found = found.select("doc_id", *(n for n in m if n != "lines"), "n_repeat_words", F.get("lines", F.lit(0)).alias("n_lines"), (F.get("lines", F.lit(0)) - F.get("lines", F.lit(1))).alias("n_dup_lines"))
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return found.withColumn("failed", failed.cast("long"))


def apply_policy(book: DataFrame, policy: Policy, *, name: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a column that tells whether the policy keeps the document."""
    return book.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, rule, n_failed, n_alone, n_kept, failed_by_any): for each rule of each policy, documents that fail it, those that
    nothing else in the policy would drop, and those that the policy keeps without it. One pass and one partial aggregation."""
    cases = [(p.version, r.name, p.mask(rules), 1 << k) for p in policies for k, r in enumerate(rules) if r.name in p.rules]
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask))
    sums = [
        F.struct(
            F.lit(v).alias("version"),
            F.lit(n).alias("rule"),
            F.count_if(hit(bit) != 0).alias("n_failed"),
            F.count_if(hit(mask) == bit).alias("n_alone"),
            F.count_if(hit(mask & ~bit) == 0).alias("n_kept"),
            F.coalesce(F.bit_or(hit(mask)), F.lit(0)).alias("failed_by_any"),
        )
        for v, n, mask, bit in cases
    ]
    return book.agg(F.array(*sums).alias("all")).select(F.inline("all"))
