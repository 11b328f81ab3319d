"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (document, position, term) for every occurrence of a term that the test items use; it is stored as
it is built, document by document, so that building it needs no shuffle. A phrase is looked up from its rarest term: that
term's postings, less the term's offset in the phrase, are the only places where the phrase can start; these are intersected
with the offset-adjusted lists of the other terms.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.llm._shared import bounded, scratch, staged

#: A word: letters and digits of ASCII and everything beyond it, that is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is folded. Said
#: by what it holds: Java takes ten times as long over the negated ranges.
WORD, WORD_ANY_CASE = r"[0-9a-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; lower() does the same for texts of ASCII alone, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_ANY_CASE)).cast("long")


@dataclass
class PositionalIndex:
    """postings: doc_id, text_key, pos, no. Documents are told apart by doc_id and a hash of the text, so rows that share a doc_id
    keep their own lists. frequency: term, its number (no) and freq, its occurrences in all documents."""

    postings: DataFrame
    frequency: DataFrame


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def build_index(docs: DataFrame, terms: DataFrame, *, key: str = "doc_id", text: str = "text") -> PositionalIndex:
    """The index of whole texts over the terms (column term), which are numbered, and broadcast if they are few enough."""
    known = staged(terms.select("term").distinct().withColumn("no", F.monotonically_increasing_id()), "terms")
    # hashed before the words are dealt out: above the generator the hash would be taken again for every word
    keyed = docs.select(docs[key].alias("doc_id"), F.xxhash64(docs[text]).alias("text_key"), docs[text].alias("body"))
    found = keyed.select("doc_id", "text_key", F.posexplode(words(F.col("body"))).alias("pos", "term"))
    postings = staged(found.join(bounded(known), "term").select("doc_id", "text_key", "pos", "no"), "postings")
    counts = postings.groupBy("no").agg(F.count(F.lit(1)).alias("freq"))
    return PositionalIndex(postings, staged(known.join(counts, "no"), "frequency"))


def item_windows(items: DataFrame, *, key: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, terms): every window of `width` words of each item; an item of fewer words, but not none, is one window."""
    listed = items.select(items[key].alias("item_id"), F.explode(F.array(words(items[text]))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return listed.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("terms")).distinct()


def phrase_matches(index: PositionalIndex, phrases: DataFrame, anchors: int = 2) -> DataFrame:
    """(doc_id, text_key, item_id, start, width): every place where a phrase (item_id, terms) occurs word for word.

    Phrases with a term that no document has cannot occur. The offset-adjusted lists of each phrase's rarest terms (`anchors` of
    them; first offset on ties) are intersected first; what is left is intersected with the lists of its other terms, over the
    documents that still have a candidate.
    """
    numbered = phrases.select("item_id", "terms", F.xxhash64("terms").alias("phrase"))
    placed = numbered.select("phrase", F.size("terms").alias("width"), F.posexplode("terms").alias("off", "term")).distinct().join(index.frequency, "term", "left")
    ranked = placed.groupBy("phrase", "width").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "no"))).alias("found"))
    ranked = ranked.where(F.col("found")[0]["freq"] > 0).select("phrase", "width", F.posexplode("found").alias("rank", "f")).select("phrase", "width", "rank", "f.off", "f.no")
    plan = staged(ranked, "plan")

    first = bounded(staged(plan.where(F.col("rank") < anchors), "anchors"))
    lists = index.postings.join(first, "no").withColumn("start", F.col("pos") - F.col("off")).where(F.col("start") >= 0)
    met = F.bit_or(F.expr("shiftleft(1, rank)")) == F.expr(f"shiftleft(1, least(width, {anchors})) - 1")
    starts = staged(lists.groupBy("doc_id", "text_key", "phrase", "start", "width").agg(met.alias("met")).where("met").drop("met"), "starts")

    holders = bounded(staged(starts.select("doc_id", "text_key").distinct(), "holders"))
    held = index.postings.join(holders, _same_doc(index.postings, holders), "left_semi")
    needed = starts.join(bounded(plan.drop("width")), "phrase").withColumn("pos", F.col("start") + F.col("off"))
    there = needed.join(held, _same_doc(needed, held) & (needed["pos"] == held["pos"]) & (needed["no"] == held["no"]), "left_semi")
    whole = there.groupBy("doc_id", "text_key", "phrase", "start", "width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("width"))
    return whole.join(bounded(staged(numbered.select("phrase", "item_id").distinct(), "phrases")), "phrase").select("doc_id", "text_key", "item_id", "start", "width")


def proximity_matches(index: PositionalIndex, pairs: DataFrame, within: int) -> DataFrame:
    """(doc_id, text_key, first, second, pos, distance): occurrences of `first` with the nearest `second` at most `within`
    words after it. Both lists meet on the document and a bucket of `within` positions, never on the document alone."""
    known = pairs.select("first", "second").distinct()
    met = known.select(F.explode(F.array("first", "second")).alias("term")).distinct().join(index.frequency, "term").select("term", "no")
    postings = index.postings.join(bounded(staged(met, "met")), "no")
    a, b = (postings.select("doc_id", "text_key", F.col("term").alias(t), F.col("pos").alias(p)) for t, p in (("first", "pos"), ("second", "other")))
    a = a.join(known, "first").withColumn("bucket", F.explode(F.array(F.floor(F.col("pos") / within), F.floor(F.col("pos") / within) + 1)))
    b = b.withColumn("bucket", F.floor(F.col("other") / within))
    near = a.join(b, _same_doc(a, b) & (a["second"] == b["second"]) & (a["bucket"] == b["bucket"]) & (b["other"] > a["pos"]) & (b["other"] <= a["pos"] + within))
    return near.groupBy(a["doc_id"], a["text_key"], a["first"], a["second"], a["pos"]).agg(F.min(b["other"] - a["pos"]).alias("distance"))


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key) of every row of docs against the windows of
    every item. n_hit counts the words inside any occurrence of a window, each once.

    A null text has no words and is clean, as is every document if there are no items; items without words are passed over; a
    null item_id is not listed; repeated rows each give a row; a null doc_id stays null. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        windows = staged(item_windows(items, width=width), "windows")
        index = build_index(docs, windows.select(F.explode("terms").alias("term")))
        found = staged(phrase_matches(index, windows), "matches")
        places = found.select("doc_id", "text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("pos")).distinct()
        hits = places.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
        listed = (
            found.select("doc_id", "text_key", F.col("item_id").cast("string").alias("item"))
            .distinct()
            .groupBy("doc_id", "text_key")
            .agg(F.count("item").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
        )
        per_doc = keep(staged(hits.join(listed, _same_doc(hits, listed), "left").select(hits["doc_id"], hits["text_key"], "n_hit", "n_items", "items"), "hits"))
    rows = docs.select(docs["doc_id"], F.xxhash64("text").alias("text_key"), count_words(F.col("text")).alias("n_words"))
    out = rows.join(per_doc, _same_doc(rows, per_doc), "left")
    return out.select(
        rows["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        rows["text_key"],
    )
