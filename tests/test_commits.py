"""Monthly tables: a commit is visible as a whole or not at all, and no writer's rows are lost."""

import threading
from pathlib import Path

import pytest

from citescope.sources import commits, sinks

SCHEMA = "domain string, period string, n int, saved_at timestamp"


def month(spark, rows):
    data = ", ".join(f"('{d}', '{p}', {n}, timestamp'2026-05-{s:02}')" for d, p, n, s in rows)
    return spark.sql(f"select * from values {data} as t(domain, period, n, saved_at)")


def held(spark, path, version=None):
    return {(r["domain"], r["period"]): r["n"] for r in sinks.read_monthly(spark, path, version).collect()}


def test_a_crash_before_the_commit_changes_nothing(spark, folder):
    sinks.upsert_monthly(month(spark, [("a", "2026-01", 1, 1), ("b", "2026-02", 2, 1)]), folder)
    before = held(spark, folder)

    def crash():
        raise RuntimeError("lost driver")

    with pytest.raises(RuntimeError, match="lost driver"):
        sinks.upsert_monthly(month(spark, [("a", "2026-01", 9, 2)]), folder, before_commit=crash)
    assert held(spark, folder) == before and commits.versions(spark, folder) == [1]
    assert sinks.upsert_monthly(month(spark, [("a", "2026-01", 9, 2)]), folder) == 2
    assert held(spark, folder) == {**before, ("a", "2026-01"): 9} and held(spark, folder, 1) == before
    # The crash's version and the replaced one go, the months in use stay.
    assert len(commits.forget(spark, folder, keep=1)) == 1 and held(spark, folder)[("b", "2026-02")] == 2


def test_a_writer_in_between(spark, folder):
    """The other one commits after our write: its months are kept, and a month of both is merged again."""
    sinks.upsert_monthly(month(spark, [("a", "2026-01", 1, 1)]), folder)
    other = [[("c", "2026-03", 3, 1)], [("b", "2026-01", 5, 1), ("a", "2026-01", 7, 9)]]

    def meanwhile():
        if other:
            sinks.upsert_monthly(month(spark, other.pop(0)), folder)

    assert sinks.upsert_monthly(month(spark, [("a", "2026-02", 2, 1)]), folder, before_commit=meanwhile) == 3
    assert sinks.upsert_monthly(month(spark, [("a", "2026-01", 8, 3), ("d", "2026-01", 4, 1)]), folder, before_commit=meanwhile) == 5
    assert held(spark, folder) == {
        ("a", "2026-01"): 7, ("b", "2026-01"): 5, ("d", "2026-01"): 4, ("a", "2026-02"): 2, ("c", "2026-03"): 3,
    }


def test_writers_at_once(spark, folder):
    problems = []

    def write(n):
        try:
            sinks.upsert_monthly(month(spark, [(f"w{n}", "2026-01", n, 1), ("all", "2026-01", n, n + 1)]), folder, attempts=20)
        except Exception as error:  # noqa: BLE001
            problems.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems and commits.versions(spark, folder) == [1, 2, 3, 4]
    assert held(spark, folder) == {**{(f"w{n}", "2026-01"): n for n in range(4)}, ("all", "2026-01"): 3}


def test_a_taken_number_is_a_conflict(spark, folder):
    commits._commit(spark, folder, 1, {"2026-01": "x"})
    with pytest.raises(commits.Conflict):
        commits._commit(spark, folder, 1, {"2026-01": "y"})
    assert commits.newest(spark, folder) == (1, {"2026-01": "x"})
    assert [p.name for p in Path(folder, "commits").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_odd_rows(spark, folder):
    with pytest.raises(ValueError, match="no commit"):
        sinks.read_monthly(spark, folder)
    assert sinks.upsert_monthly(spark.createDataFrame([], SCHEMA), folder) == 0
    with pytest.raises(ValueError, match="period"):
        sinks.upsert_monthly(spark.createDataFrame([("a", None, 1, None)], SCHEMA), folder)
    # A new column appears beside the old ones.
    sinks.upsert_monthly(month(spark, [("a", "2026-01", 1, 1), ("b", "2026-02", 1, 1)]), folder)
    sinks.upsert_monthly(month(spark, [("c", "2026-01", 2, 1)]).selectExpr("*", "'x' note"), folder)
    assert {(r["domain"], r["note"]) for r in sinks.read_monthly(spark, folder).collect()} == {("a", None), ("b", None), ("c", "x")}
