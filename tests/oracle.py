"""Compare a Spark result with DuckDB's, without regard to the order of rows or columns."""

import math

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "None"
    if isinstance(value, float):
        return repr(int(value)) if value == int(value) else repr(round(value, 6))
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(norm, value)) + "]"
    return str(value)


def duck_rows(folder, sql, **tables):
    con = duckdb.connect()
    for name in TABLES:
        if name in tables:
            con.register("_" + name, tables[name])
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
        elif folder:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return sorted(names), sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
