"""Compare a registered query with its SQL twin on one data folder."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _kind(value):
    return "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else type(value).__name__


def compare(spark, con, function, sql: str, sf_dir: str) -> list[str]:
    """Problems found, empty if rows, names and kinds of values agree."""
    rows = function(spark, sf_dir)
    names = sorted(rows.columns)
    mine = [tuple(_plain(r[n]) for n in names) for r in rows.collect()]
    relation = con.sql(sql)
    theirs_names = relation.columns
    if sorted(theirs_names) != names:
        return [f"columns {names} != {sorted(theirs_names)}"]
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(_plain(r[i]) for i in order) for r in relation.fetchall()]
    problems = []
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    extra, missing = Counter(mine) - Counter(theirs), Counter(theirs) - Counter(mine)
    if extra or missing:
        problems.append(f"{names}: only here {list(extra)[:2]}, only there {list(missing)[:2]} ({len(extra)}/{len(missing)})")
    for i, name in enumerate(names):
        kinds = {_kind(r[i]) for r in mine if r[i] is not None} | {_kind(r[i]) for r in theirs if r[i] is not None}
        if len(kinds) > 1:
            problems.append(f"{name}: kinds {kinds}")
    return problems
