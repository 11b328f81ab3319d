import json

import pytest
from pyspark.sql import functions as F

from registrum.sources import files
from registrum.streaming import caches, sessions


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('LEI,Name,Other\n1,"two\nlines, ""quoted""",x\n2,,y\n')
    assert [tuple(r) for r in files.read_csv(spark, str(path), ["LEI", "Name"]).collect()] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    with pytest.raises(ValueError, match="missing columns: City"):
        files.read_csv(spark, str(path), ["City"])


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "L1", 12, "SE", "I", "Acme\tAB", ["A"]), (1, 1, "L2", -3, "DE", "l", "Beta", [])], "file int, rank int, lei string, tenths int, country string, status string, name string, other_names array<string>")
    files.write_index(rows, str(tmp_path / "i"))
    got = {r.lei: (r.file, r.prominence, r.name, r.other_names) for r in files.read_index(spark, str(tmp_path / "i")).collect()}
    assert got == {"L1": (0, 1.2, "Acme AB", ["A"]), "L2": (1, -0.3, "Beta", [])}


def test_manifest(spark, tmp_path):
    good = {"format": 1, "build": "20260916-a", "asOf": "2026-09-16", "entities": 3, "bounds": ["a", "b"], "capped": [1]}
    (tmp_path / "m.json").write_text(json.dumps(good))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().bounds == ["a", "b"]
    (tmp_path / "n.json").write_text(json.dumps(good | {"bounds": ["b", "a"]}))
    with pytest.raises(Exception, match="bad manifest"):
        files.read_manifest(spark, str(tmp_path / "n.json")).collect()


def test_stream_sessions(spark, tmp_path):
    events = spark.createDataFrame([("u", "2026-01-01 00:00:00"), ("u", "2026-01-01 00:00:05"), ("u", "2026-01-01 01:00:00"), ("v", "2026-01-01 05:00:00")], "user string, at string").withColumn("at", F.to_timestamp("at"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = sessions.stream_pauses(stream, "user", "at", "10 minutes", "1 minute").writeStream.format("memory").queryName("paused").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user, r.n) for r in spark.table("paused").collect()} >= {("u", 2), ("u", 1)}


def _played(spark, tmp_path, name, rows, make, mode="append"):
    """What a stream of the rows, a file each, comes to."""
    ddl = "user string, at timestamp, no int, key string, flag boolean"
    for k, row in enumerate(rows):
        at = F.timestamp_seconds(F.lit(row[1]))
        spark.createDataFrame([(row[0], row[2], row[3], row[4])], "user string, no int, key string, flag boolean").withColumn("at", at).select("user", "at", "no", "key", "flag").coalesce(1).write.parquet(str(tmp_path / name / f"{k:03}"))
    stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).option("latestFirst", "false").parquet(str(tmp_path / name))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return [tuple(r) for r in spark.table(name).collect()]


def test_streams_equal_their_tables(spark, tmp_path):
    """The streaming forms tell what the batch forms tell of the same events, given in order over several batches."""
    times = [0, 3, 4, 20, 21, 60, 61, 100, 4000]
    rows = [("u", 1_700_000_000 + t, k, "abca"[k % 4], k % 4 == 1) for k, t in enumerate(times)]
    events = spark.createDataFrame([(u, n, k, f, t) for u, t, n, k, f in rows], "user string, no int, key string, flag boolean, t long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    got = _played(spark, tmp_path, "newest", rows, lambda s: sessions.stream_newest(s, "user", "at", "no", "key"), "complete")
    assert got == [tuple(r) for r in sessions.newest(events, "user", "at", "no", "key").collect()]
    got = _played(spark, tmp_path, "heldback", rows, lambda s: sessions.stream_held(s, "user", "at", "no", "flag", 20.0).select("no", "held"))
    assert sorted(got) == sorted(tuple(r) for r in sessions.held(events, "user", "at", "no", F.col("flag"), "20 seconds").select("no", "held").collect())
    got = _played(spark, tmp_path, "unexpired", rows, lambda s: sessions.stream_unexpired(s, "user", "key", "at", "no", 30.0).select("no", "hit"))
    assert sorted(got) == sorted(tuple(r) for r in caches.unexpired(events, "user", ["at", "no"], "key", "at", 30.0).select("no", "hit").collect())
    got = _played(spark, tmp_path, "settled", rows, lambda s: sessions.stream_settled(s, "user", "at", "no", "key", "10 seconds", F.col("flag"), "1 second"))
    # the last run is open until a later event moves the watermark
    want = sessions.settled(events.where("no < 8"), "user", "at", "no", "key", "10 seconds", F.col("flag")).collect()
    assert sorted(got) == sorted(tuple(r) for r in want)
