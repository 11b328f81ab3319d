"""Rows of a Spark query and of its SQL, in a form that can be compared."""

import glob

import duckdb


def shape(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shape, value)) + "]"
    return str(value)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shape(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {file.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{file}'")
    found = con.execute(sql)
    return canonical(found.fetchall(), [d[0] for d in found.description])
