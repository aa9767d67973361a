"""Reuse of stored tables, and keyed upserts, with crashes in between."""

from __future__ import annotations

import os

import pytest

from lodestone.sources.store import Folder, KeyedTable, forget, reused


def test_reuse(spark, tmp_path):
    source, root, built = str(tmp_path / "in"), str(tmp_path / "kept"), []
    spark.range(10).write.parquet(source)

    def get(**parameters):
        def build():
            built.append(parameters)
            return spark.read.parquet(source).selectExpr("id * 2 AS x")

        return sorted(r[0] for r in reused(spark, root, "twice", build, [source], **parameters).collect())

    assert get(a=1) == get(a=1) == list(range(0, 20, 2)) and len(built) == 1
    get(a=2)
    assert len(built) == 2
    spark.range(10, 12).write.mode("append").parquet(source)  # a changed input
    assert get(a=1) == list(range(0, 24, 2)) and len(built) == 3
    table = [n for n in os.listdir(root) if not n.startswith(".")][0]
    for n in os.listdir(root):
        if os.path.exists(f"{root}/{n}/_SUCCESS"):
            os.remove(f"{root}/{n}/_SUCCESS")  # all as if left half-written
    assert get(a=1) == list(range(0, 24, 2)) and len(built) == 4 and table
    forget(spark, root, "twice", [source], a=1)
    assert len([n for n in os.listdir(root) if not n.startswith(".")]) == 1 and get(a=1) and len(built) == 4


def test_the_second_call_scans_no_input(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(5).write.parquet(source)
    build = lambda: spark.read.parquet(source)
    reused(spark, root, "t", build, [source])
    again = reused(spark, root, "t", lambda: pytest.fail("built again"), [source])
    assert all("/kept/t-" in f for f in again.inputFiles())


def rows(table):
    return sorted((r["k"] if r["k"] is not None else -1, r["v"]) for r in table.read().collect())


def test_upserts(spark, tmp_path):
    make = lambda pairs: spark.createDataFrame(pairs, "k long, v string, t int")
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    assert table.read() is None
    table.upsert(make([(k, "a", 0) for k in range(20)] + [(3, "later", 1), (None, "null", 0)]), "t")
    assert rows(table) == sorted([(k, "later" if k == 3 else "a") for k in range(20)] + [(-1, "null")])
    before = {p: os.stat(p).st_mtime_ns for p in (str(x) for x in tmp_path.rglob("*.parquet"))}
    table.upsert(make([(5, "b", 0), (None, "again", 0)]), "t")
    assert rows(table) == sorted([(k, {3: "later", 5: "b"}.get(k, "a")) for k in range(20)] + [(-1, "again")])
    assert all(os.stat(p).st_mtime_ns == t for p, t in before.items())  # nothing is written over
    _, state = table._state()
    assert len({p.split("/")[1] for p in state["parts"].values()}) == 2  # other buckets are where they were
    table.upsert(make([]), "t")
    assert KeyedTable(spark, str(tmp_path / "t"), ["k"], 99).buckets == 4 and rows(table)
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, "x")], "k long, w string"))


def test_a_crash_leaves_the_table(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    first, second = (spark.range(8).selectExpr("id AS k", f"'{x}' AS v") for x in "ab")
    table.upsert(first)
    monkeypatch.setattr(Folder, "put", lambda *a: (_ for _ in ()).throw(OSError("gone")))  # before the list is written
    with pytest.raises(OSError):
        table.upsert(second)
    monkeypatch.undo()
    assert rows(table) == [(k, "a") for k in range(8)]
    monkeypatch.setattr(Folder, "rename", lambda *a: False)  # another upsert took the number
    with pytest.raises(RuntimeError):
        table.upsert(second)
    monkeypatch.undo()
    assert rows(table) == [(k, "a") for k in range(8)]
    table.upsert(second)
    assert rows(table) == [(k, "b") for k in range(8)]
    table.vacuum()
    assert rows(table) == [(k, "b") for k in range(8)] and len(os.listdir(tmp_path / "t" / "data")) == 1 and len([v for v in os.listdir(tmp_path / "t" / "versions") if v.endswith("json")]) == 1
