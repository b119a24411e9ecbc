"""Compare a frame with a DuckDB result, whatever the order of rows and columns."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x if isinstance(x, str | bytes | bool | int) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(([plain(v) for v in r] for r in frame.astype(object).itertuples(index=False)), key=repr)
