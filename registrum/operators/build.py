"""A build's names and files: variants of names, counters, whether an index is whole, how two builds differ, and a build's id."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.functions.constants import CAP

# How names are typed; previous names (4) are shown but never searched.
NAME_TYPES = {"TRADING_OR_OPERATING_NAME": 1, "ALTERNATIVE_LANGUAGE_LEGAL_NAME": 2, "TRANSLITERATED": 3}
PREVIOUS, JOINT = 4, " | "
#: Prominences that differ by less may swap places: noise of single precision.
TIE = 1e-6


def name_type(kind: Column) -> Column:
    out = F.lit(PREVIOUS)
    for name, n in NAME_TYPES.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def variants(others: Column, transliterated: Column) -> Column:
    """Other names (name, kind) and transliterated ones as (type, place, name), by type and, within one, as they are listed."""
    typed = F.transform(others, lambda o, i: F.struct(name_type(o["kind"]).alias("type"), i.alias("place"), o["name"].alias("name")))
    more = F.transform(transliterated, lambda n, i: F.struct(F.lit(3).alias("type"), (F.size(others) + i).alias("place"), n.alias("name")))
    return F.sort_array(F.concat(typed, more))


def listed_names(found: Column, legal: Column) -> Column:
    """The names that are listed with an entity, in the file's order, each once: those of types 1 to 3 that aren't its legal name."""
    shown = F.filter(found, lambda v: (v["type"] < PREVIOUS) & (v["name"] != ""))
    by_place = F.sort_array(F.transform(shown, lambda v: F.struct(v["place"].alias("place"), v["name"].alias("name"))))
    return F.array_except(F.array_distinct(F.transform(by_place, lambda v: v["name"])), F.array(legal))


def positional_names(names: Column, kinds: Column) -> Column:
    """Names and kinds that were each joined by one mark and are split again, paired by place: names beyond the kinds are lost, and
    a name that holds the mark moves those behind it."""
    split = lambda c: F.split(c, r" \| ", -1)
    pairs = F.arrays_zip(split(names).alias("name"), split(kinds).alias("kind"))
    return F.when(names == "", F.slice(pairs, 1, 0)).otherwise(F.slice(pairs, F.lit(1), F.least(F.size(split(names)), F.size(split(kinds)))))


def indexed_names(entities: DataFrame) -> DataFrame:
    """(lei, name_no, seq, extras): the legal name (0) and the variants of types 1 to 3 of entities (lei, name, variants) whose words no
    earlier name of the entity has. A legal name always stays; a variant without words goes."""
    searched = F.filter("variants", lambda v: v["type"] < PREVIOUS)
    every = F.concat(F.array(F.col("name")), F.transform(searched, lambda v: v["name"]))
    named = entities.select("lei", F.posexplode(every).alias("no", "n"))
    told = named.select("lei", "no", F.explode(F.array(F.struct(T.name_seq(F.col("n")).alias("seq"), T.name_extras(F.col("n")).alias("extras")))).alias("t")).select("lei", "no", "t.*")
    first = Window.partitionBy("lei", "seq").orderBy("no")
    kept = told.withColumn("nth", F.row_number().over(first)).where((F.col("no") == 0) | ((F.col("nth") == 1) & (F.size("seq") > 0)))
    return kept.select("lei", F.col("no").alias("name_no"), "seq", "extras")


def entity_terms(indexed: DataFrame, prominent: DataFrame) -> DataFrame:
    """(lei, terms, initials): the index terms of an entity's names, and how many more terms the initials of its names give it if it is
    one of the prominent (lei)."""
    words = indexed.groupBy("lei").agg(F.array_distinct(F.flatten(F.collect_list(T.index_terms(F.col("seq"), F.col("extras"))))).alias("words"), F.array_distinct(F.flatten(F.collect_list(T.name_initials(F.col("seq"), T.form_start(F.col("seq")))))).alias("short"))
    known = words.join(prominent.select("lei", F.lit(True).alias("known")), "lei", "left")
    more = F.when(F.col("known"), F.array_except("short", "words")).otherwise(F.array().cast("array<string>"))
    return known.select("lei", F.concat("words", more).alias("terms"), F.size(more).alias("initials"))


def build_counters(rows: DataFrame, reason: Column, entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(rows, skipped, joint_names, no_terms, initials) of a build in one row: rows read and skipped, names that hold the mark which
    joins names, entities without a term, entities that initials gave terms."""
    read = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(reason.isNotNull()).alias("skipped"))
    joint = F.size(F.filter("variants", lambda v: F.contains(v["name"], F.lit(JOINT)))) + F.contains("name", F.lit(JOINT)).cast("int")
    names = entities.agg(F.coalesce(F.sum(joint), F.lit(0)).alias("joint_names"))
    found = terms.agg(F.count_if(F.size("terms") == 0).alias("no_terms"), F.count_if(F.col("initials") > 0).alias("initials"))
    return read.crossJoin(names).crossJoin(found)  # a row each


def check_index(entries: DataFrame, manifest: DataFrame, entities: int, cap: int = CAP) -> DataFrame:
    """(file, problem) of index entries (file, rank, lei, tenths) against the manifest's files (file, capped) and count of entities (file
    null): missing and unknown files, too many entries, capped files that aren't full, lines out of order, another count."""
    order = Window.partitionBy("file").orderBy("rank")
    rise = F.coalesce(F.lag("tenths").over(order) < F.col("tenths"), F.lit(False))
    held = entries.withColumn("rise", rise).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("rise").alias("rises"))
    met = manifest.withColumn("told", F.lit(True)).join(held, "file", "full_outer")
    found = F.array(
        F.when(F.col("n").isNull(), F.lit("missing")),
        F.when(F.col("told").isNull(), F.lit("not in the manifest")),
        F.when(F.col("n") > cap, F.lit("over the cap")),
        F.when(F.col("capped") & (F.col("n") != cap), F.lit("capped but not full")),
        F.when(F.col("rises") > 0, F.lit("out of order")),
    )
    files = met.select("file", F.explode(F.array_compact(found)).alias("problem"))
    count = entries.agg(F.count_distinct("lei").alias("n")).where(F.col("n") != entities).select(F.lit(None).cast("int").alias("file"), F.lit("another count of entities").alias("problem"))
    return files.unionByName(count)


def compare_files(got: DataFrame, want: DataFrame) -> DataFrame:
    """(file, moved, ties, other_data, other_tenths) of files that differ between two builds' entries (file, rank, lei, prominence, data):
    how many places hold another entity, whether the file differs only by swaps of entities within TIE of prominence, and how many
    entities have other data or another stored tenth."""
    a, b = (df.select("file", "rank", *(F.col(c).alias(f"{c}_{n}") for c in ("lei", "prominence", "data"))) for df, n in ((got, "a"), (want, "b")))
    places = a.join(b, ["file", "rank"], "full_outer")
    swap = F.col("lei_a").eqNullSafe(F.col("lei_b"))
    near = F.coalesce(F.abs(F.col("prominence_a") - F.col("prominence_b")) <= TIE, F.lit(False))
    moved = places.groupBy("file").agg(F.count_if(~swap).alias("moved"), F.bool_and(swap | near).alias("near"))
    one, two = (df.select("file", "lei", *(F.col(c).alias(f"{c}_{n}") for c in ("prominence", "data"))) for df, n in ((got, "a"), (want, "b")))
    both = one.withColumn("in_a", F.lit(True)).join(two.withColumn("in_b", F.lit(True)), ["file", "lei"], "full_outer")
    here = F.col("in_a") & F.col("in_b")
    tenths = lambda c: F.floor(F.col(c).cast("double") * 10 + 0.5)
    held = both.groupBy("file").agg(F.bool_and(F.coalesce(here, F.lit(False))).alias("same"), F.count_if(here & (F.col("data_a") != F.col("data_b"))).alias("other_data"), F.count_if(here & (tenths("prominence_a") != tenths("prominence_b"))).alias("other_tenths"))
    out = moved.join(held, "file").where((F.col("moved") > 0) | (F.col("other_data") > 0) | (F.col("other_tenths") > 0))
    return out.select("file", "moved", ((F.col("moved") > 0) & F.col("same") & F.col("near")).alias("ties"), "other_data", "other_tenths")


def build_id(hashes: DataFrame, as_of: str) -> DataFrame:
    """(build): the date without dashes and eight digits of a digest of all files' digests (file, sha256) in order: any change of any file
    changes it. A row a file is what a manifest has, too."""
    listed = F.sort_array(F.collect_list(F.struct("file", "sha256")))
    lines = F.array_join(F.transform(listed, lambda x: F.concat(x["file"].cast("string"), F.lit(":"), x["sha256"])), "\n")
    return hashes.agg(F.concat(F.lit(as_of.replace("-", "") + "-"), F.left(F.sha2(lines, 256), F.lit(8))).alias("build"))
