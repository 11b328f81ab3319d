"""The inverted index: shards, files, caps, and routing of queries to files."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.functions.constants import CAP, FILE_POSTINGS, MAX_ANCHORS, MAX_DEPTH, MAX_SPAN, MIN_CHARS, SPLIT
from registrum.operators.joins import shuffled


def term_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def plan_shards(counts: DataFrame, split: int = SPLIT, depth: int = MAX_DEPTH) -> DataFrame:
    """(term, cnt, shard, alone): a term's shard is its shortest prefix of two letters and more with no more than `split` postings,
    or at full depth; a term equal to a prefix with more is alone."""
    cut = counts.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.length("term"), F.lit(depth))), lambda i: F.left(F.col("term"), i))))
    sums = cut.groupBy("prefix").agg(F.sum("cnt").alias("total"))
    fits = shuffled(cut).join(sums, "prefix").where((F.col("total") <= split) | (F.length("prefix") == depth))
    least = fits.groupBy("term").agg(F.min_by("prefix", F.length("prefix")).alias("shard"))
    return shuffled(counts).join(least, "term", "left").select("term", "cnt", F.coalesce("shard", "term").alias("shard"), F.col("shard").isNull().alias("alone"))


def pack_files(shards: DataFrame, limit: int = FILE_POSTINGS) -> DataFrame:
    """(shard, alone, file, lo): shards in order of their least term, a file closed before it would pass `limit` postings. What a file holds
    depends on all before it, so this is one pass over the shards in order; they stream to the driver a partition at a time, and only
    the first shard of each file (a row of the index's manifest) is kept there."""
    sizes = shards.groupBy("shard", "alone").agg(F.min("term").alias("lo"), F.sum("cnt").alias("size"))
    firsts, filled = [], 0
    for r in sizes.select("lo", "size").orderBy("lo").toLocalIterator(prefetchPartitions=True):
        if not firsts or filled + r["size"] > limit:
            firsts.append((len(firsts), r["lo"]))
            filled = 0
        filled += r["size"]
    table = shards.sparkSession.createDataFrame(firsts, "file int, lo string")
    return file_of(sizes.select("shard", "alone", "lo"), table, F.col("lo"), "file").select("shard", "alone", "file", "lo")


def files_of(postings: DataFrame, shards: DataFrame, files: DataFrame) -> DataFrame:
    """(file, lei): the entities of each file, once."""
    placed = shards.join(files.select("shard", "alone", "file"), ["shard", "alone"]).select("term", "file")
    return shuffled(postings).join(placed, "term").select("file", "lei").distinct()


def full_files(entries: DataFrame, cap: int = CAP) -> DataFrame:
    """(file, capped): whether a file has more entities than `cap`. All that a routing table needs of them: no prominence, no order."""
    return entries.groupBy("file").agg((F.count("lei") > cap).alias("capped"))


def cap_files(entries: DataFrame, entities: DataFrame, cap: int = CAP) -> DataFrame:
    """(file, lei, rank, capped): each file's `cap` most prominent entities; capped if it had more."""
    order = Window.partitionBy("file").orderBy(F.col("prominence").desc(), "lei")
    ranked = shuffled(entries).join(entities.select("lei", "prominence"), "lei").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
    return ranked.join(full_files(entries, cap), "file").select("file", "lei", "rank", "capped")


def bounds(files: DataFrame, capped: DataFrame) -> DataFrame:
    """(file, lo, hi, capped): the routing table, of cap_files() or full_files(). One row a file."""
    lows = files.groupBy("file").agg(F.min("lo").alias("lo")).join(capped.select("file", "capped").distinct(), "file", "left")
    return lows.select("file", "lo", F.lead("lo").over(Window.orderBy("file")).alias("hi"), F.coalesce("capped", F.lit(False)).alias("capped"))


def file_of(words: DataFrame, table: DataFrame, word: Column, out: str) -> DataFrame:
    """words with the file whose range holds a word: the last one whose first term is not behind it, file 0 below all. The bounds are one
    sorted array, a row of the manifest for each file, that a subquery reads once; each word is found in it by halving."""
    bounds = table.agg(F.sort_array(F.collect_list(F.struct("lo", "file"))).alias("bounds_")).scalar()
    whole = words.withColumn("bounds_", bounds)
    n = F.size("bounds_")

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below, open_ = F.get("bounds_", mid)["lo"] <= word, at["lo"] < at["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(at["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda at: at["lo"])
    return whole.withColumn(out, F.coalesce(F.get("bounds_", found - 1)["file"], F.lit(0))).drop("bounds_")


def route(queries: DataFrame, table: DataFrame, *, paused: bool = True, min_chars: int = MIN_CHARS, max_span: int = MAX_SPAN, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """(qid, files) of queries (qid, tokens, in_progress): the files to read, in order. A word routes by its shortest prefix that lies in
    one file; words whose files hold all their entities go first, then longer ones; two words at most. A lone word too short for that
    routes by itself once typing pauses."""
    words = queries.select("qid", "in_progress", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "word"))
    words = words.withColumn("open", F.col("in_progress") & (F.col("pos") == F.col("n") - 1))
    content = words.where(~T.is_stop(F.col("word")) & (F.length("word") >= min_chars))
    # where a word lies doesn't depend on its query: each distinct word is placed once
    cuts = content.select("word").distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(min_chars), F.length("word")), lambda i: F.left(F.col("word"), i))))
    spans = file_of(file_of(cuts, table, F.col("prefix"), "first"), table, F.concat("prefix", F.lit("\uffff")), "last")
    inside = F.col("last") - F.col("first") + 1 <= max_span
    # the whole word is the last of its prefixes
    placed = spans.groupBy("word").agg(F.min_by(F.sequence("first", "last"), F.when(inside, F.length("prefix"))).alias("narrow"), F.array(F.max_by("first", F.length("prefix"))).alias("own"))
    placed = placed.select("word", F.coalesce("narrow", "own").alias("held"), F.col("narrow").isNotNull().alias("inside"))
    known = placed.withColumn("file", F.explode("held")).join(table.select("file", "capped"), "file", "left")
    known = known.groupBy("word").agg(F.first("held").alias("held"), F.first("inside").alias("inside"), (~F.bool_or(F.coalesce("capped", F.lit(False)))).alias("whole"))
    met = shuffled(content).join(known, "word").where(F.col("inside") | ~F.col("open") | F.lit(paused)).withColumn("full", F.col("whole") & (F.col("inside") | ~F.col("open")))
    order = Window.partitionBy("qid").orderBy(F.col("full").desc(), F.length("word").desc(), "pos")
    anchors = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_anchors)
    listed = anchors.groupBy("qid").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "held"))), lambda x: x["held"]))).alias("files"))
    none = F.array().cast("array<int>")
    out = shuffled(queries).join(listed, "qid", "left")
    if paused:
        single = queries.where((F.size("tokens") == 1) & (F.length(F.get("tokens", F.lit(0))) >= 2)).select("qid", F.get("tokens", F.lit(0)).alias("word"))
        lone = shuffled(single).join(file_of(single.select("word").distinct(), table, F.col("word"), "own"), "word").select("qid", F.array("own").alias("lone"))
        out = shuffled(out).join(lone, "qid", "left").withColumn("files", F.coalesce("files", "lone"))
    return out.select("qid", F.coalesce("files", none).alias("files"))


def candidates(routed: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, lei): what the files that queries (qid, files) route to hold, each once. An index partitioned by file is read only where a
    query routes."""
    return routed.select("qid", F.explode("files").alias("file")).join(index.select("file", "lei"), "file").select("qid", "lei").distinct()


def _gzip_sizes(texts):
    import zlib

    def size(text: str) -> int:
        packer = zlib.compressobj(9, zlib.DEFLATED, 31)
        return len(packer.compress(text.encode())) + len(packer.flush())

    return texts.map(size)


def index_sizes(lines: DataFrame) -> DataFrame:
    """(file, n, bytes, gzip) of lines (file, rank, line): a file's entries, bytes and bytes compressed. A file has at most as many lines
    as the index's cap, so it fits a task."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), text.alias("text"))
    return files.select("file", "n", F.octet_length("text").cast("long").alias("bytes"), F.pandas_udf(_gzip_sizes, "long")("text").alias("gzip"))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """(files, changed, share): how many files of two builds' lines (file, rank, line) differ, by digests of files that don't depend on
    the order of rows."""
    digest = lambda df, n: df.groupBy("file").agg(F.count(F.lit(1)).alias(f"n_{n}"), F.bit_xor(F.xxhash64("rank", "line")).alias(f"x_{n}"), F.sum(F.pmod(F.xxhash64("line", "rank"), F.lit(1_000_000_007))).alias(f"s_{n}"))
    both = digest(before, "a").join(digest(after, "b"), "file", "full_outer")
    same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("x_a").eqNullSafe(F.col("x_b")) & F.col("s_a").eqNullSafe(F.col("s_b"))
    return both.agg(F.count(F.lit(1)).alias("files"), F.count_if(~same).alias("changed"), F.round(F.avg(F.when(same, 0.0).otherwise(1.0)), 9).alias("share"))
