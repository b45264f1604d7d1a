"""Stored tables: replacing, deleting, two writers, changes of several tables, growth, clean-up."""

import pytest
from pyspark.sql import functions as F

from parley.sources import tables


def rows(spark, table):
    return sorted(tuple(r) for r in tables.snapshot(spark, table).collect())


def numbered(spark, low, high, text="x"):
    return spark.range(low, high).select("id", F.lit(text).alias("text"))


def test_a_keyed_table_is_replaced_whole(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.upsert_by_key(numbered(spark, 0, 300), at, ["id"])
    tables.replace_table(tables.snapshot(spark, at).where("id > 100"), at, ["id"])
    assert [r[0] for r in rows(spark, at)] == list(range(101, 300))
    tables.upsert_by_key(numbered(spark, 0, 102, "y"), at, ["id"])
    assert rows(spark, at) == [(k, "y") for k in range(102)] + [(k, "x") for k in range(102, 300)]


def test_delete_read_and_store_again(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.save_records(numbered(spark, 0, 50), at)
    tables.delete_records(spark.range(0, 49), at)
    assert rows(spark, at) == [(49, "x")]
    with pytest.raises(KeyError):
        tables.delete_records(spark.range(49, 51), at)
    tables.delete_records(spark.range(49, 50), at)
    assert rows(spark, at) == []
    with pytest.raises(KeyError):
        tables.load_record(spark, at, 49)
    tables.save_records(numbered(spark, 7, 8, "new"), at)
    assert rows(spark, at) == [(7, "new")] and tables.load_record(spark, at, 7).count() == 1


def test_two_writers_of_one_part_and_of_two(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.upsert_by_key(numbered(spark, 0, 10), at, ["id"], parts=1)
    with pytest.raises(tables.Conflict):
        with tables.Change(spark, at) as slow:
            slow.upsert("data", numbered(spark, 3, 4, "slow"), ["id"])
            tables.upsert_by_key(numbered(spark, 4, 5, "quick"), at, ["id"])
    assert dict(rows(spark, at)) == {k: "quick" if k == 4 else "x" for k in range(10)}
    assert tables.clean_up(spark, at) == 1  # only the version that quick replaced: slow left no trace
    other = str(tmp_path / "u")
    tables.upsert_by_key(numbered(spark, 0, 200), other, ["id"])
    with tables.Change(spark, other) as slow:
        slow.upsert("data", numbered(spark, 3, 4, "slow"), ["id"])
        tables.upsert_by_key(numbered(spark, 5, 6, "quick"), other, ["id"])
    assert {k: t for k, t in rows(spark, other) if t != "x"} == {3: "slow", 5: "quick"}


def test_a_writer_that_lost_tries_again(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    tables.upsert_by_key(numbered(spark, 0, 3), at, ["id"], parts=1)
    create, calls = tables._create, []

    def late(session, root, number, entry):
        calls.append(number)
        if len(calls) == 1:  # another writer takes this number first
            monkeypatch.setattr(tables, "_create", create)
            tables.upsert_by_key(numbered(spark, 1, 2, "other"), at, ["id"])
            monkeypatch.setattr(tables, "_create", late)
        return create(session, root, number, entry)

    monkeypatch.setattr(tables, "_create", late)
    tables.upsert_by_key(numbered(spark, 2, 3, "own"), at, ["id"])
    assert rows(spark, at) == [(0, "x"), (1, "other"), (2, "own")] and calls == [2, 3]


def store(spark, at):
    with tables.Change(spark, at) as change:
        change.replace("projects", spark.createDataFrame([("Old", 1), ("Other", 2)], "name string, rank int"), ["name"])
        change.replace("members", spark.createDataFrame([("Old", "Ann"), ("Old", "Bob"), ("Other", "Ann")], "project string, person string"), ["project"])
        change.upsert("records", spark.createDataFrame([(1, "Old"), (2, "Other"), (3, None)], "id long, project string"), ["id"])
        change.upsert("notes", spark.createDataFrame([(1, "see [[Old]] and [[Old|it]] not [[Older]]"), (2, "[[Other]]")], "id long, text string"), ["id"])


def contents(spark, at):
    return {n: sorted(map(repr, tables.snapshot(spark, f"{at}#{n}").collect())) for n in ("projects", "members", "records", "notes")}


def test_a_failure_at_any_step_leaves_nothing(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    store(spark, at)
    before, folders = contents(spark, at), sorted(p.name for p in (tmp_path / "s").iterdir())
    write = tables.Change._write
    for step in range(5):
        calls = []

        def failing(self, df, part):
            calls.append(1)
            out = write(self, df, part)
            if len(calls) == step + 1:
                raise OSError("no space left")
            return out

        monkeypatch.setattr(tables.Change, "_write", failing)
        if step == 4:  # all versions are written, and then the log can't be
            monkeypatch.setattr(tables, "_create", lambda *a: (_ for _ in ()).throw(OSError("no log")))
        with pytest.raises(OSError):
            tables.rename_project(spark, at, "Old", "New")
        assert contents(spark, at) == before and sorted(p.name for p in (tmp_path / "s").iterdir()) == folders
    monkeypatch.undo()
    tables.rename_project(spark, at, "Old", "N$1 \\")
    after = contents(spark, at)
    assert sum("N$1" in x for n in ("projects", "members", "records") for x in after[n]) == 4
    assert tables.snapshot(spark, f"{at}#notes").where("id = 1").first()["text"] == "see [[N$1 \\]] and [[N$1 \\|it]] not [[Older]]"
    with pytest.raises(ValueError):
        tables.rename_project(spark, at, "Other", "N$1 \\")
    with pytest.raises(KeyError):
        tables.delete_project(spark, at, "Old")
    tables.delete_project(spark, at, "Other")
    assert rows(spark, f"{at}#projects") == [("N$1 \\", 1)] and tables.snapshot(spark, f"{at}#records").where("project is null").count() == 2


def test_growth_summaries_and_clean_up(spark, tmp_path):
    at = str(tmp_path / "t")
    for k in range(23):
        tables.upsert_by_key(numbered(spark, 10 * k, 10 * k + 11, f"{k}"), at, ["id"], parts=1, rows_per_part=100)
    state = tables.read_state(spark, at).tables["data"]
    assert state.count == 4 and len(state.parts) == 4 and sum(n for _, n in state.parts.values()) == 231
    want = {i: f"{k}" for k in range(23) for i in range(10 * k, 10 * k + 11)}
    assert dict(rows(spark, at)) == want
    assert tables.clean_up(spark, at) > 0 and min(tables._numbers(spark, at)) == 20
    assert dict(rows(spark, at)) == want
    tables.upsert_by_key(spark.createDataFrame([(5, "wide", 1.5)], "id long, text string, more double"), at, ["id"])  # a new column
    assert tables.load_record(spark, at, 5).first()["more"] == 1.5 and tables.load_record(spark, at, 6).first()["more"] is None
