"""What a session's keystrokes fetch, summed up over the sessions of every part."""

import duckdb
from compare import canonical, oracle

from registrum.operators import evaluate as V
from registrum.plans import builds, catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_summary_is_of_every_part(spark, tmp_path):
    """No key is a fiftieth one; names occur often, once, and empty, a row twice, and keys are missing."""
    rows = f"SELECT * FROM '{SF}/part.parquet' WHERE p_partkey % 50 <> 0"
    odd = f"""SELECT * REPLACE (1001 AS p_partkey, 'x' AS p_name) FROM ({rows} LIMIT 1) UNION ALL SELECT * REPLACE (1002 AS p_partkey, '' AS p_name) FROM ({rows} LIMIT 1)
UNION ALL SELECT * FROM '{SF}/part.parquet' WHERE p_partkey = 7 UNION ALL SELECT * REPLACE (1003 AS p_partkey, 'quick silver ring' AS p_name) FROM ({rows} LIMIT 1)
UNION ALL SELECT * REPLACE (NULL AS p_partkey) FROM '{SF}/part.parquet' WHERE p_partkey < 9"""
    duckdb.execute(f"COPY ({rows} UNION ALL {odd}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    df = catalogue.QUERIES["session_cost_summary"](spark, str(tmp_path))
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert len(got[0]) == 4
    assert got == oracle(str(tmp_path), catalogue.ORACLES["session_cost_summary"])


def test_rows_that_stand_for_many(spark):
    rows = [("a", 1.0, 3), ("a", 4.0, 1), ("a", 9.0, 7), ("b", 2.0, 1)]
    every = [(m, v) for m, v, n in rows for _ in range(n)]
    short = V.summary(spark.createDataFrame(rows, "m string, v double, n long"), "v", "m", "n")
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, V.summary(spark.createDataFrame(every, "m string, v double"), "v", "m").collect()))
