import os

import duckdb


def same(got, want, places=9):
    def row(r, names):
        return tuple(round(r[n], places) if isinstance(r[n], float) else r[n] for n in names)

    names = sorted(got.columns)
    key = lambda t: [(x is None, str(x)) for x in t]
    left = sorted((row(r, names) for r in got.collect()), key=key)
    cols = want.columns
    assert sorted(cols) == names
    right = sorted((tuple(round(v, places) if isinstance(v, float) else v for v in (r[cols.index(n)] for n in names)) for r in want.fetchall()), key=key)
    assert left == right
    return len(left)


def duck(sf):
    c = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
        p = f"{sf}/{name}.parquet"
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return c


def over(c, spark, df, name="documents"):
    """df as a view of DuckDB."""
    rows = df.toPandas()
    c.register(f"{name}_rows", rows)
    c.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_rows")
    return c
