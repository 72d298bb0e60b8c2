"""Runs a query and its SQL twin on the same tables and compares the rows."""

from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(normal, v))
    return v


def plain(v):
    return float(v) if isinstance(v, int | float | Decimal) and not isinstance(v, bool) else v


def key(row):
    return tuple((v is not None, isinstance(v, bool), str(plain(v))) for v in row)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=key)


def twin(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = c.execute(sql)
    cols = [d[0] for d in rel.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return [cols[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rel.fetchall()), key=key)


def same(df, sql, sf):
    names, got = rows(df)
    wanted_names, wanted = twin(sql, sf)
    assert names == wanted_names
    assert len(got) == len(wanted), (len(got), len(wanted))
    for a, b in zip(got, wanted, strict=True):
        assert [plain(x) for x in a] == [plain(x) for x in b], (names, a, b)
