"""Bulk files in and out: quoted CSV by header name, index files, manifests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a quoted UTF-8 CSV with a header, all strings, missing values empty. Fails if a column is absent; only these
    columns are parsed."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="PERMISSIVE", maxCharsPerColumn=1 << 20)
    absent = [c for c in columns if c not in raw.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def index_line() -> Column:
    """An entity as a line: lei, stored tenths, country, status, legal name, other names."""
    clean = lambda c: F.translate(c, "\t\n\r", "   ")
    return F.concat_ws("\t", "lei", F.col("tenths").cast("string"), "country", "status", clean(F.col("name")), F.transform("other_names", clean))


def valid_entries(entries: DataFrame) -> DataFrame:
    """The entries; fails on one with a bad identifier, country or status, an empty name, or a name that is listed twice."""
    names = F.concat(F.array("name"), F.transform("other_names", lambda n: F.translate(n, "\t\n\r", "   ")))
    wrong = (
        F.when(~F.col("lei").rlike("^[0-9A-Z]{1,20}$"), "bad identifier")
        .when(~F.col("country").rlike("^[A-Z]{2}$"), "bad country")
        .when(~F.col("status").rlike("^[A-Za-z]$"), "bad status")
        .when(F.exists(names, lambda n: n == ""), "empty name")
        .when(F.size(F.array_distinct(names)) < F.size(names), "a name twice")
    )
    checked = F.when(wrong.isNull(), F.col("lei")).otherwise(F.raise_error(F.concat_ws(": ", "lei", wrong)))
    return entries.withColumn("lei", checked)


def write_index(entries: DataFrame, path: str) -> None:
    """Lines of each file under file=N, in rank order within a file; fails on an entry that no reader would take."""
    valid_entries(entries).select("file", "rank", index_line().alias("value")).repartition("file").sortWithinPartitions("file", "rank").select("file", "value").write.partitionBy("file").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, lei, prominence, country, status, name, other_names); fails on a line of another shape."""
    parts = spark.read.text(path).withColumn("p", F.split("value", "\t", -1))
    whole = F.when((F.size("p") >= 5) & F.col("p")[1].rlike("^-?[0-9]+$"), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))))
    parts = parts.withColumn("p", whole)
    return parts.select("file", F.col("p")[0].alias("lei"), (F.col("p")[1].cast("int") / 10).alias("prominence"), F.col("p")[2].alias("country"), F.col("p")[3].alias("status"), F.col("p")[4].alias("name"), F.expr("slice(p, 6, size(p))").alias("other_names"))


MANIFEST = "format int, build string, asOf string, entities bigint, bounds array<string>, capped array<int>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's one row; fails unless the format is 1, the build begins with its date, the first bounds ascend, and the capped files
    ascend and are files."""
    row = spark.read.schema(MANIFEST).json(path, multiLine=True)
    rising = lambda c: F.forall(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.coalesce(F.get(c, i - 1) < F.get(c, i), F.lit(True)))
    dated = F.col("build").rlike("^[0-9]{8}-") & F.col("asOf").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.startswith("build", F.replace("asOf", F.lit("-"), F.lit("")))
    inside = F.forall("capped", lambda n: (n >= 0) & (n < F.size("bounds")))
    good = (F.col("format") == 1) & dated & rising("bounds") & rising("capped") & inside
    return row.withColumn("format", F.when(good, F.col("format")).otherwise(F.raise_error(F.lit("bad manifest"))))


def write_prominence(entities: DataFrame, path: str) -> None:
    """Lines of lei, prominence and age in full precision, tab-separated."""
    entities.select("lei", F.col("prominence").cast("string"), F.col("age").cast("string")).write.csv(path, sep="\t", quote="")


def write_report(spark: SparkSession, path: str, build: str, as_of: str, counts: DataFrame, **more: object) -> None:
    """A build's report as one JSON line: its id and date, the one row of counts, and what else is given."""
    told = counts.select(F.lit(build).alias("build"), F.lit(as_of).alias("asOf"), "*", *(F.lit(v).alias(k) for k, v in more.items()))
    told.coalesce(1).write.json(path)


def read_evaluation(spark: SparkSession, sets: dict[str, str]) -> DataFrame:
    """(query, split, stratum, targets) of evaluation sets by name and path: tab-separated with a header, no quotes. The strata of head and
    typo sets are told by their kinds (qtype); a row without a split is for training; targets are the target and its alternatives."""
    out = None
    for name, path in sets.items():
        raw = spark.read.csv(path, sep="\t", header=True, quote="")
        has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")  # noqa: B023, E731
        stratum = {"head": F.concat(F.lit("head_"), has("qtype")), "typo": F.substring_index(has("qtype"), ":", 1), "acronyms": F.lit("acronym")}.get(name, F.lit(name))
        targets = F.array_distinct(F.concat(F.array(has("target_lei")), F.filter(F.split(has("alt_leis"), r"\|"), lambda x: x != "")))
        one = raw.select(has("query").alias("query"), F.when(has("split") == "test", "test").otherwise("train").alias("split"), stratum.alias("stratum"), targets.alias("targets"))
        out = one if out is None else out.unionByName(one)
    return out


def encodings(lines: DataFrame) -> DataFrame:
    """(encoding, files, raw, gzip): bytes of an index's lines (file, rank, line: tab-separated) in other encodings: the lines, JSON rows,
    and columns one after the other."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "line")))
    by_file = lines.groupBy("file").agg(rows.alias("rows"))
    width = F.aggregate("rows", F.lit(0), lambda a, r: F.greatest(a, F.size(F.split(r["line"], "\t", -1))))
    texts = {
        "lines": F.array_join(F.transform("rows", lambda r: r["line"]), "\n"),
        "json": F.to_json(F.transform("rows", lambda r: F.split(r["line"], "\t", -1))),
        "columns": F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.transform("rows", lambda r: F.coalesce(F.get(F.split(r["line"], "\t", -1), i), F.lit(""))), "\t")), "\n"),
    }
    each = by_file.select("file", F.explode(F.array(*(F.struct(F.lit(n).alias("encoding"), t.alias("text")) for n, t in texts.items()))).alias("e")).select("e.*")
    sized = each.select("encoding", F.octet_length("text").cast("long").alias("raw"), F.pandas_udf(_gzip_sizes, "long")("text").alias("gzip"))
    return sized.groupBy("encoding").agg(F.count(F.lit(1)).alias("files"), F.sum("raw").alias("raw"), F.sum("gzip").alias("gzip"))


def _gzip_sizes(texts):
    import gzip

    return texts.map(lambda t: len(gzip.compress(t.encode(), 6)))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(list, code, name) of an index's code lists, a JSON object of objects; blank names go, and a list that is no object has none."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("lists"))
    listed = held.select(F.explode("lists").alias("list", "codes")).select("list", F.explode("codes").alias("code", "name"))
    return listed.where(F.trim(F.coalesce("name", F.lit(""))) != "")


def write_weights(path: str, weights: dict[str, float], known: dict[str, float]) -> dict[str, float]:
    """The known weights with those fitted in their places, written as one JSON object in order of their names; fails on a weight that is
    unknown or no number. What a scorer reads at its start."""
    import json
    import math
    from pathlib import Path

    wrong = [n for n, x in weights.items() if n not in known or not math.isfinite(x)]
    if wrong:
        raise ValueError(f"no such weights: {', '.join(sorted(wrong))}")
    out = known | weights
    part = Path(path).with_suffix(".part")
    part.write_text(json.dumps(out, sort_keys=True) + "\n")
    part.replace(path)
    return out


def read_build(spark: SparkSession, root: str, attempts: int = 3) -> tuple[str, DataFrame]:
    """The build that a folder's manifest names, and its lines (file, value): of one build only. If its files are gone, since another was
    published, the manifest is read again."""
    from pyspark.errors import AnalysisException

    build = None
    for _ in range(attempts):
        build = spark.read.schema(MANIFEST).json(f"{root}/index.json", multiLine=True).first()["build"]
        try:
            return build, spark.read.text(f"{root}/{build}")
        except AnalysisException:
            continue
    raise FileNotFoundError(f"{root} names build {build}, which isn't there")
