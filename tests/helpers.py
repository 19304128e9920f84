"""Rows of a Spark result and of its SQL in one form, for comparison."""

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ in ("NaTType", "NAType"):
        return None
    if type(v).__name__ == "ndarray" or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10] if not isinstance(v, datetime.datetime) or (v.hour, v.minute, v.second) == (0, 0, 0) else str(v)
    if isinstance(v, (bool, str, bytes)):
        return v
    if type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, (int, float, decimal.Decimal)) or hasattr(v, "dtype"):
        return v.item() if type(v).__name__ in ("bool_",) else float(v)
    return v


def rows(frame):
    """Sorted rows of a pandas frame, columns by name."""
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def by_sql(sql, folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c.sql(sql).df()
