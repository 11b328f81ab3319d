"""What the ranking was studied with: signals by entity, extracts, other features of prominence, the baseline score, older routers and
packings, and grids of routing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.constants import MAX_ANCHORS, MAX_SPAN, MIN_CHARS
from registrum.functions.numeric import flag
from registrum.operators import index as X
from registrum.operators.joins import shuffled

# Fixed values of the baseline score.
BASE = {"issued": 15.0, "lapsed": 4.0, "bad": 45.0, "short": 14.0, "letters": 6.0, "child": 1.2}
MOST_CHILDREN = 60
BAD_REGISTRATION = ("RETIRED", "ANNULLED", "DUPLICATE")


def all_relations(relations: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(parent, a count for each kind) of all relations whatever their status; kinds: the counts' names and the relations' types."""
    return relations.groupBy("parent").agg(*(F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()))


def joined_signals(entities: DataFrame, counts: DataFrame, isins: DataFrame, codes: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """Entities (lei) with counts by parent, ISINs, a flag for each list of codes (bic, mic: lei) and the most links (lei, sitelinks) of
    any item that names them; what is missing is 0."""
    out = entities.join(counts.withColumnRenamed("parent", "lei"), "lei", "left")
    out = out.join(isins.groupBy("lei").agg(F.count(F.lit(1)).alias("isin")), "lei", "left")
    for name, listed in codes.items():
        out = out.join(listed.select("lei").distinct().withColumn(name, F.lit(True)), "lei", "left")
    out = out.join(links.groupBy("lei").agg(F.max("sitelinks").alias("sitelinks")), "lei", "left")
    numbers = [c for c in counts.columns if c != "parent"] + ["isin", "sitelinks"]
    return out.na.fill(0, numbers).na.fill(False, list(codes))


def consolidated_pairs(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(child, parent) of direct and ultimate relations whose ends are both entities, each once."""
    kinds = ("IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY")
    pairs = relations.where(F.col("type").isin(*kinds)).select("child", "parent").distinct()
    known = entities.select("lei").distinct()
    return pairs.join(known.withColumnRenamed("lei", "child"), "child", "left_semi").join(known.withColumnRenamed("lei", "parent"), "parent", "left_semi").select("child", "parent")


def extra_prominence(w: dict[str, float]) -> Column:
    """What features beside the shipped ones add: branches and sole proprietors by category, funds managed, links of items."""
    terms = {"branch_cat": flag(F.col("category") == "BRANCH"), "sole": flag(F.col("category") == "SOLE_PROPRIETOR"), "managed": F.log1p("n_managed"), "wikidata": F.log1p("sitelinks")}
    return sum((F.lit(w.get(n, 0.0)) * x for n, x in terms.items()), F.lit(0.0))


def baseline_score() -> Column:
    """The score that the study began with, over entity_status, registration, name_length and n_children: status, short names and all
    relations together."""
    status = F.when(F.col("registration") == "ISSUED", BASE["issued"]).when(F.col("registration") == "LAPSED", BASE["lapsed"]).otherwise(0.0)
    bad = (F.col("entity_status") != "ACTIVE") | F.col("registration").isin(*BAD_REGISTRATION)
    short = F.greatest(F.lit(0.0), F.lit(BASE["short"]) - F.col("name_length") / BASE["letters"])
    return status - F.lit(BASE["bad"]) * flag(bad) + short + F.least(F.col("n_children"), F.lit(MOST_CHILDREN)) * F.lit(BASE["child"])


def item_details(rows: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """One row for each item: its distinct values of every column in order, joined by a bar."""
    return rows.groupBy(item).agg(*(F.array_join(F.sort_array(F.collect_set(c)), "|").alias(c) for c in columns))


def extract(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns under their new names, as lines of a tab-separated file can hold them; nulls are empty."""
    return rows.select(*(F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ").alias(n) for n, c in columns.items()))


def route_words(queries: DataFrame, table: DataFrame, mode: str = "merged", most: int = 2) -> DataFrame:
    """(qid, files) by the older routers: of the first word, of the longest (the first of equal ones), or of all. A word that is still
    typed takes the files of all words that begin with it, `most` at most; another takes its own."""
    words = queries.select("qid", "in_progress", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "word"))
    if mode == "first":
        words = words.where("pos = 0")
    elif mode == "longest":
        best = words.groupBy("qid").agg(F.max_by("pos", F.struct(F.length("word"), -F.col("pos"))).alias("pos"))
        words = shuffled(words).join(best, ["qid", "pos"])
    elif mode != "merged":
        raise ValueError(f"no router {mode}")
    distinct = words.select("word").distinct()
    placed = shuffled(words).join(X.file_of(X.file_of(distinct, table, F.col("word"), "first"), table, F.concat("word", F.lit("\uffff")), "last"), "word")
    last = F.when(F.col("in_progress") & (F.col("pos") == F.col("n") - 1), F.least("last", F.col("first") + most - 1)).otherwise(F.col("first"))
    files = placed.select("qid", "pos", F.sequence("first", last).alias("files")).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "files"))).alias("all"))
    listed = files.select("qid", F.array_distinct(F.flatten(F.transform("all", lambda x: x["files"]))).alias("files"))
    return shuffled(queries.select("qid")).join(listed, "qid", "left").select("qid", F.coalesce("files", F.array().cast("array<int>")).alias("files"))


def route_grid(queries: DataFrame, table: DataFrame, grid: list[tuple[int, int, int]] = ((MIN_CHARS, MAX_SPAN, MAX_ANCHORS),)) -> DataFrame:
    """(min_chars, span, anchors, qid, files) of the router under each triple of its limits."""
    out = None
    for chars, span, anchors in grid:
        one = X.route(queries, table, min_chars=chars, max_span=span, max_anchors=anchors).select(F.lit(chars).alias("min_chars"), F.lit(span).alias("span"), F.lit(anchors).alias("anchors"), "qid", "files")
        out = one if out is None else out.unionByName(one)
    return out


def pack_by_words(shards: DataFrame, words: int) -> DataFrame:
    """(shard, alone, file, lo): shards in order, a file closed after the shard that takes it past `words` words. As pack_files(), one pass
    that keeps a row for each file."""
    sizes = shards.groupBy("shard", "alone").agg(F.min("term").alias("lo"), F.count(F.lit(1)).alias("n"))
    firsts, held, open_ = [], 0, False
    for r in sizes.select("lo", "n").orderBy("lo").toLocalIterator(prefetchPartitions=True):
        if not open_:
            firsts.append((len(firsts), r["lo"]))
            held, open_ = 0, True
        held += r["n"]
        open_ = held <= words
    table = shards.sparkSession.createDataFrame(firsts, "file int, lo string")
    return X.file_of(sizes.select("shard", "alone", "lo"), table, F.col("lo"), "file").select("shard", "alone", "file", "lo")
