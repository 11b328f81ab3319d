"""Matching of query words with name words, scores, and the best names of each query."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.functions.constants import FUZZY_MIN_LENGTH, INITIALS_MIN_PROMINENCE, MATCH
from registrum.operators.joins import shuffled


def common_prefix(q: Column, t: Column) -> Column:
    both = F.least(F.length(q), F.length(t))
    steps = F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda a, i: F.when((a == i - 1) & (F.substr(q, i, F.lit(1)) == F.substr(t, i, F.lit(1))), i).otherwise(a))


def prefix_edit_le1(q: Column, t: Column, shared: Column) -> Column:
    """Whether some prefix of t is within one insertion, deletion, substitution or swap of q; shared is their common prefix."""
    rest = lambda s, k: F.substr(s, shared + k, F.lit(1_000_000))
    swap = F.concat(F.substr(q, shared + 2, F.lit(1)), F.substr(q, shared + 1, F.lit(1)), rest(q, 3))
    more = F.length(t) >= shared + 1
    return (
        (shared == F.length(q))
        | (more & F.startswith(rest(t, 2), rest(q, 2)))
        | F.startswith(rest(t, 1), rest(q, 2))
        | (more & F.startswith(rest(t, 2), rest(q, 1)))
        | ((shared + 1 < F.length(q)) & F.startswith(rest(t, 1), swap))
    )


def levels(pairs: DataFrame) -> DataFrame:
    """pairs (q, t) with level: 3 equal, 2 prefix, 1 one edit (queries of four characters and more), 0 none."""
    shared = pairs.withColumn("shared", common_prefix(F.col("q"), F.col("t")))
    level = F.when(F.col("q") == F.col("t"), 3).when(F.startswith("t", "q"), 2).when((F.length("q") >= FUZZY_MIN_LENGTH) & prefix_edit_le1(F.col("q"), F.col("t"), F.col("shared")), 1).otherwise(0)
    return shared.withColumn("level", level).drop("shared")


def _one_edit_keys(word: Column, reach: Column) -> Column:
    """The word's first `reach` letters, and those with one left out: what is within one edit shares a key."""
    head = F.left(word, reach)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(head), F.lit(1))), lambda i: F.concat(F.left(head, i - 1), F.substr(head, i + 1, F.lit(1_000_000))))
    return F.array_distinct(F.concat(F.array(head), cuts))


def vocabulary_levels(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(q, t, level) of distinct query words q and terms t with level 1 and more. Each is worked out once, however many names hold
    the term: prefixes meet on their first letters, single edits on keys with a letter left out; the test decides."""
    q, t = queries.select("q").distinct(), vocabulary.select("t").distinct()
    prefix = q.join(t.withColumn("q", F.explode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.left(F.col("t"), i)))), "q").select("q", "t")
    near = q.where(F.length("q") >= FUZZY_MIN_LENGTH)
    sizes = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.length("q") + d))
    left = near.withColumn("reach", F.explode(sizes)).withColumn("key", F.explode(_one_edit_keys(F.col("q"), F.length("q")))).select("q", "reach", "key")
    lengths = left.select("reach").distinct()
    right = t.join(F.broadcast(lengths), F.length("t") >= F.col("reach")).withColumn("key", F.explode(_one_edit_keys(F.col("t"), F.col("reach")))).select("t", "reach", "key")
    fuzzy = left.join(right, ["reach", "key"]).select("q", "t")
    return levels(prefix.unionByName(fuzzy).distinct()).where(F.col("level") > 0)


def _content(tokens: Column, word: Column) -> Column:
    """Whether a word counts: no stop word, or one of a query that has no others."""
    return F.forall(tokens, T.is_stop) | ~T.is_stop(word)


def features(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Match features of every query (qid, tokens) with every name (lei, name_no, seq, extras) that shares a word with it: n, shown,
    n_miss, n_fuzzy, n_exact, exact, prefix, coverage, base_exact. Names that no word leads to aren't listed. Two aggregations, by word
    and by name, and one join each with queries and names after them."""
    words = queries.select("qid", "tokens", F.posexplode("tokens").alias("q_pos", "q")).select("qid", "q_pos", "q", _content(F.col("tokens"), F.col("q")).alias("content"))
    seq = names.select("lei", "name_no", F.posexplode("seq").alias("pos", "t"))
    extra = names.select("lei", "name_no", F.explode("extras").alias("t")).withColumn("pos", F.lit(-1))
    terms = seq.unionByName(extra)
    level = vocabulary_levels(words.select("q"), terms.select("t"))
    # an extra spelling wins only by a higher level; of equal words the first counts
    found = F.max(F.struct("level", (F.col("pos") >= 0).alias("own"), (-F.col("pos")).alias("back"))).alias("b")
    best = words.join(level, "q").join(terms, "t").groupBy("qid", "lei", "name_no", "q_pos").agg(found, F.max("content").alias("content"))
    sums = best.groupBy("qid", "lei", "name_no").agg(
        F.max("content").alias("shown"),
        F.count_if("content").alias("n_content"),
        F.count_if(F.col("b.level") == 1).alias("n_fuzzy"),
        F.count_if(F.col("b.level") == 3).alias("n_exact"),
        F.size(F.collect_set(F.when(F.col("b.own"), F.col("b.back")))).alias("n_pos"),
    )
    needed = F.size(F.filter("tokens", lambda x: _content(F.col("tokens"), x))).alias("n_needed")
    out = sums.join(queries.select("qid", "tokens", needed), "qid").join(names.select("lei", "name_no", "seq"), ["lei", "name_no"])
    n, m = F.size("tokens"), F.size("seq")
    zipped = F.zip_with("tokens", "seq", lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    same = F.aggregate(zipped, F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda a, x: F.struct((a["k"] + F.when(a["on"] & x, 1).otherwise(0)).alias("k"), (a["on"] & x).alias("on")), lambda a: a["k"])
    out = out.withColumn("same", same).withColumn("form", T.form_start(F.col("seq")))
    return out.select(
        "qid", "lei", "name_no", n.alias("n"), "shown", (F.col("n_needed") - F.col("n_content")).alias("n_miss"), "n_fuzzy", "n_exact",
        ((n == m) & (F.col("same") == n)).alias("exact"),
        ((n <= m) & (F.col("same") >= n - 1) & F.coalesce(F.startswith(F.get("seq", n - 1), F.get("tokens", n - 1)), F.lit(False))).alias("prefix"),
        (F.col("n_pos") / F.greatest(F.lit(1), m)).alias("coverage"),
        ((F.col("same") == n) & (n < m) & (F.col("form") == n)).alias("base_exact"),
    )


def match_score(w: dict[str, float] = MATCH) -> Column:
    """The score of one name from its features, in a fixed order of operations; null if it is not shown. Optional weights: order, for
    names whose words stand in the query's order from their first on, and alt, for names that are not the legal one (name_no > 0)."""
    on = lambda c, x: F.when(F.col(c), F.lit(x)).otherwise(F.lit(0.0))
    s = F.when(F.col("n_miss") == 0, F.lit(w["all"])).otherwise(F.lit(0.0)) - F.lit(w["miss"]) * F.col("n_miss") - F.lit(w["fuzzy"]) * F.col("n_fuzzy")
    s = s + (F.lit(w["exact"]) * F.col("n_exact")) / F.col("n") + on("exact", w["core_exact"]) + on("prefix", w["prefix"]) + F.lit(w["coverage"]) * F.col("coverage") + on("base_exact", w["base_exact"])
    if w.get("order"):
        s = s + F.when((F.col("n") > 1) & (F.col("prefix") | F.col("exact")), F.lit(w["order"])).otherwise(F.lit(0.0))
    if w.get("alt"):
        s = s + F.when(F.col("name_no") > 0, F.lit(w["alt"])).otherwise(F.lit(0.0))
    return F.when(F.col("shown"), s)


def initials_hits(queries: DataFrame, names: DataFrame, entities: DataFrame, w: dict[str, float] = MATCH) -> DataFrame:
    """(qid, lei, match) of queries of one word of 3 to 6 characters that are the initials of a name (lei, initials), for entities
    prominent enough. An equi-join on the initials."""
    q = queries.where((F.size("tokens") == 1) & F.length(F.get("tokens", F.lit(0))).between(3, 6)).select("qid", F.get("tokens", F.lit(0)).alias("short"))
    known = names.select("lei", F.explode("initials").alias("short")).distinct()
    known = known.join(entities.where(F.col("prominence") >= INITIALS_MIN_PROMINENCE).select("lei"), "lei", "left_semi")
    return q.join(known, "short").select("qid", "lei", F.lit(w["initials"]).alias("match"))


def _shape() -> Column:
    """What a name's score depends on, as one text: its words and extra spellings."""
    return F.concat_ws("\t", F.array_join("seq", " "), F.array_join("extras", " "))


def query_text() -> Column:
    """What a query's features depend on, as one text: its words."""
    return F.array_join("tokens", " ")


def text_features(queries: DataFrame, names: DataFrame) -> DataFrame:
    """features() of every distinct query text with every distinct name (text, shape, ...), each pair once however many queries and
    entities have it."""
    texts = queries.groupBy(query_text().alias("qid")).agg(F.first("tokens").alias("tokens"))
    shapes = names.groupBy(_shape().alias("lei")).agg(F.first("seq").alias("seq"), F.first("extras").alias("extras")).withColumn("name_no", F.lit(0))
    return features(texts, shapes).drop("name_no").withColumnsRenamed({"qid": "text", "lei": "shape"})


def owners(names: DataFrame) -> DataFrame:
    """(shape, lei, prominence): who has each distinct name."""
    return names.select(_shape().alias("shape"), "lei", "prominence")


#: Some so many ids stand in one array of gathered(): Spark holds what is dealt out of two arrays, the square of it, before any row goes on.
GATHERED = 256
#: Rows that a task of for_everyone() makes.
MADE = 20_000_000


def gathered(rows: DataFrame, key: str, id_: str, size: int = GATHERED) -> DataFrame:
    """(key, ids, n) of rows (key, id): the n ids that a key has as an array, or dealt by their digests to several arrays of some `size` ids.
    An id that is null is in none."""
    counts = rows.groupBy(key).agg(F.count(id_).alias("n"))
    dealt = shuffled(rows.select(key, id_)).join(counts, key).withColumn("nth", F.pmod(F.xxhash64(id_), F.greatest(F.ceil(F.col("n") / size), F.lit(1))))
    # dealt anew, so that a key with very many ids may be split in the join and here
    lists = dealt.repartition(key, "nth").groupBy(key, "nth").agg(F.sort_array(F.collect_list(id_)).alias("ids"))
    return lists.select(key, "ids", F.size("ids").cast("long").alias("n")).where(F.col("n") > 0)


def for_everyone(found: DataFrame, texts: DataFrame, owners: DataFrame, made: int = MADE) -> DataFrame:
    """found (text, shape, ...) for every query and entity: (qid, lei, ...), with texts and owners as gathered() has them by text (qid) and
    shape (lei). Only what is found once for each text and name is joined and shuffled; the rows for each are dealt out of the arrays
    after that, by tasks of some `made` rows however common a text or name is."""
    spark, kept = found.sparkSession, [c for c in found.columns if c not in ("text", "shape")]
    q, e = texts.select("text", F.col("ids").alias("qids"), F.col("n").alias("n_q")), owners.select("shape", F.col("ids").alias("leis"), F.col("n").alias("n_e"))
    met = shuffled(shuffled(found).join(q, "text")).join(e, "shape")
    rows = met.agg(F.sum(F.col("n_q") * F.col("n_e"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // made))
    dealt = met.select("qids", "leis", *kept).repartition(tasks, F.get("qids", F.lit(0)), F.get("leis", F.lit(0)))
    return dealt.select("leis", *kept, F.explode("qids").alias("qid")).select("qid", F.explode("leis").alias("lei"), *kept)


def name_scores(queries: DataFrame, names: DataFrame, w: dict[str, float] = MATCH) -> DataFrame:
    """(qid, shape, match) of all names that are shown, each distinct name once however many entities have it."""
    shapes = names.groupBy(_shape().alias("lei")).agg(F.first("seq").alias("seq"), F.first("extras").alias("extras")).withColumn("name_no", F.lit(0))
    return features(queries, shapes).select("qid", F.col("lei").alias("shape"), match_score(w).alias("match")).where(F.col("match").isNotNull())


def top_k(queries: DataFrame, names: DataFrame, entities: DataFrame, k: int, w: dict[str, float] = MATCH, pool: DataFrame | None = None) -> DataFrame:
    """(qid, lei, score, rank): the k best entities (lei, prominence) of each query, by best name plus prominence, then lei; of those in
    the pool (qid, lei), if one is given. Names with a column initials are found by those too, which count as the better of both matches.

    Distinct names are scored once. Without a pool only the k most prominent entities of each distinct name are looked at: any other
    stands behind k entities with the same name. Ranks go by the unrounded score, which is rounded to be shown.
    """
    owners = shuffled(names.select(_shape().alias("shape"), "lei").distinct()).join(entities.select("lei", "prominence"), "lei")
    scored = name_scores(queries, names, w)
    if pool is None:
        first = Window.partitionBy("shape").orderBy(F.col("prominence").desc(), "lei")
        owners = owners.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).drop("nth")
        found = scored.join(owners, "shape").select("qid", "lei", "match", "prominence")
    else:
        found = shuffled(shuffled(pool.select("qid", "lei").distinct()).join(owners, "lei")).join(scored, ["qid", "shape"]).select("qid", "lei", "match", "prominence")
    if "initials" in names.columns:
        hits = initials_hits(queries, names, entities, w).join(entities.select("lei", "prominence"), "lei")
        hits = hits if pool is None else hits.join(pool.select("qid", "lei"), ["qid", "lei"], "left_semi")
        found = found.unionByName(hits)
    best = found.groupBy("qid", "lei").agg((F.max("match") + F.first("prominence")).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "lei")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "lei", F.round("score", 6).alias("score"), "rank")
