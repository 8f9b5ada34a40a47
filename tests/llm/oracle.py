"""Compare a query with its SQL on one set of tables."""

import datetime
import glob
import os

import duckdb


def rows_of(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)

    def plain(v):
        if isinstance(v, float):
            return round(v, 9)
        return v.isoformat() if isinstance(v, datetime.date) else v

    order = sorted(names)
    left = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    right = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in order]) for r in want.fetchall())
    return left, right
