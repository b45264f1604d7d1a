"""Stored tables: durable intermediate results, and tables of parts whose present versions a log of changes names.

A store is a folder with a log; its tables are ``folder#name``, and a path without ``#`` is a store of one table. A change writes new
versions beside the old ones and then one file to the log, under the next number, created only if nobody else has. So a reader sees a
change of however many tables whole or not at all, a job that fails halfway has changed nothing, and of two writers one notices.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a new table that is kept by key, and rows of a part beyond which a table gets twice as many parts.
PARTS, ROWS_PER_PART = 64, 1_000_000

#: After how many changes one tells everything, so that a reader needs nothing before it.
SUMMARY = 20

#: How often a change is tried anew that another writer got ahead of.
TRIES = 10


class Conflict(RuntimeError):
    """Another writer has changed the same parts meanwhile."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where none is set a local master gets a
    temporary one; on a cluster that is an error, as executors could not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="parley-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- the log


@dataclass
class Table:
    """Present state of a table: its schema, by part the folder and its number of rows, and how many parts keys are dealt into."""

    schema: str | None = None
    count: int = PARTS
    parts: dict[int, tuple[str, int]] = field(default_factory=dict)


@dataclass
class State:
    """What the log says up to a change's number."""

    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)


def _split(table: str) -> tuple[str, str]:
    root, _, name = table.partition("#")
    return root, name or "data"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, root: str) -> list[int]:
    files, at = _fs(spark, f"{root}/log")
    if not files.exists(at):
        return []
    return sorted(int(m[1]) for s in files.listStatus(at) if (m := re.fullmatch(r"(\d{12})\.json", s.getPath().getName())))


def _entry(spark: SparkSession, root: str, number: int) -> dict:
    files, at = _fs(spark, f"{root}/log/{number:012d}.json")
    stream = files.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _apply(state: State, entry: dict) -> None:
    if entry["whole"]:
        state.tables = {}
    for name, change in entry["tables"].items():
        table = state.tables.setdefault(name, Table())
        if change["schema"] is not None:
            table.schema, table.count = change["schema"], change["count"]
        if change["all"]:
            table.parts = {}
        for part, folder, rows in change["parts"]:
            if folder is None:
                table.parts.pop(part, None)
            else:
                table.parts[part] = (folder, rows)


def read_state(spark: SparkSession, root: str) -> State:
    """From the last summary on; at most SUMMARY small files and as many lines as tables have parts."""
    numbers, state = _numbers(spark, root), State()
    if numbers:
        first = max(n for n in numbers if n % SUMMARY == 0 or n == numbers[0])
        for n in (n for n in numbers if n >= first):
            _apply(state, _entry(spark, root, n))
            state.number = n
    return state


def _create(spark: SparkSession, root: str, number: int, entry: dict) -> bool:
    """Whether the change could be written under this number; a file appears with all that is in it, and none is replaced."""
    files, at = _fs(spark, f"{root}/log/{number:012d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log/.{uuid.uuid4().hex}")
    files.mkdirs(at.getParent())
    stream = files.create(draft, False)
    stream.write(json.dumps(entry).encode())
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(draft, at, options)
        return True
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise


# ---------------------------------------------------------------- changes


class Change:
    """Changes of one or several tables of a store that become visible together, when the block ends without an error.

        with Change(spark, folder) as change:
            change.upsert("people", rows, ["id"])
            change.delete("notes", gone, ["id"])

    If anything fails, what was written is removed and the log is untouched. If another writer changed one of the same parts after
    this change began, it ends with ``Conflict``, likewise without a trace; changes of other parts don't matter.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.written, self.told = spark, root, [], {}

    def __enter__(self) -> Change:
        self.state = read_state(self.spark, self.root)
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            try:
                self._commit()
                return
            except BaseException:
                self._undo()
                raise
        self._undo()

    def _undo(self) -> None:
        for folder in self.written:
            files, at = _fs(self.spark, f"{self.root}/{folder}")
            files.delete(at, True)

    def _commit(self) -> None:
        if not self.told:
            return
        while True:
            now = read_state(self.spark, self.root)
            for n in range(self.state.number + 1, now.number + 1):
                self._disjoint(_entry(self.spark, self.root, n))
            entry = {"whole": False, "tables": self.told}
            _apply(now, entry)
            if (now.number + 1) % SUMMARY == 0:
                tables = {name: {"schema": t.schema, "count": t.count, "all": True, "parts": [[p, *x] for p, x in t.parts.items()]} for name, t in now.tables.items()}
                entry = {"whole": True, "tables": tables, "touched": self.told}
            if _create(self.spark, self.root, now.number + 1, entry):
                return

    def _disjoint(self, other: dict) -> None:
        for name, change in other.get("touched", other["tables"]).items():
            own = self.told.get(name)
            if own and (own["all"] or change["all"] or {p for p, *_ in own["parts"]} & {p for p, *_ in change["parts"]} or None not in (own["schema"], change["schema"]) and (own["schema"], own["count"]) != (change["schema"], change["count"])):
                raise Conflict(f"table {name} of {self.root} has been changed meanwhile")

    def _tell(self, name: str, schema: T.StructType | None, count: int, everything: bool, parts: list[list]) -> None:
        if name in self.told:
            raise ValueError(f"table {name} is changed twice at once")
        self.told[name] = {"schema": None if schema is None else schema.json(), "count": count, "all": everything, "parts": parts}

    def _write(self, df: DataFrame, part: str) -> dict[int, tuple[str, int]]:
        folder = f"v-{uuid.uuid4().hex}"
        self.written.append(folder)
        df.write.partitionBy(part).parquet(f"{self.root}/{folder}")
        files, at = _fs(self.spark, f"{self.root}/{folder}")
        if not any(x.getPath().getName().startswith(f"{part}=") for x in files.listStatus(at)):
            return {}
        rows = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(part).count().collect()  # a number a part
        return {r[0]: (f"{folder}/{part}={r[0]}", r["count"]) for r in rows}

    def _read(self, name: str, parts: list[int] | None = None) -> DataFrame | None:
        return _present(self.spark, self.root, self.state.tables.get(name), parts)

    def replace(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """The table has the rows of ``df`` and no others; with ``keys`` it is kept by key, else as one part."""
        count = self.state.tables.get(name, Table()).count
        part = F.lit(0) if keys is None else dealt(keys, count)
        fresh = self._write(df.withColumn("part", part.cast("int")), "part")
        self._tell(name, df.schema, count, True, [[p, *x] for p, x in fresh.items()])

    def upsert(self, name: str, changes: DataFrame, keys: list[str], newest: str | None = None, parts: int = PARTS, kept: tuple[str, ...] = (), rows_per_part: int = ROWS_PER_PART) -> None:
        """Rows with the keys of ``changes`` are replaced by those, other rows stay; of several with equal keys, stored ones included,
        the one of largest ``newest`` stays, if that is given. Columns of ``kept`` that the last row leaves null keep what was there.
        Only parts that a change falls into are read and written, but for the time when a table has outgrown its parts."""
        table = self.state.tables.get(name) or Table(count=parts)
        stored = sum(rows for _, rows in table.parts.values())
        count, grown = table.count, stored > table.count * rows_per_part
        while stored > count * rows_per_part:
            count *= 2
        marked = changes.withColumn("part", dealt(keys, count))
        touched = None if grown else [r["part"] for r in marked.select("part").distinct().collect()]
        known = self._read(name, touched)
        both = marked.withColumn("__age", F.lit(1))
        if known is not None:
            both = both.unionByName(known.withColumns({"part": dealt(keys, count), "__age": F.lit(0)}), allowMissingColumns=True)
        rest = [c for c in both.columns if c not in (*keys, "part", "__age")]
        order = F.struct(*([newest] if newest else []), "__age", F.xxhash64(*(F.col(c).cast("string") for c in rest)))
        held = [c for c in kept if c in rest]
        latest = both.groupBy(*keys, "part").agg(F.max_by(F.struct(*rest), order).alias("row"), *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"__{c}") for c in held))
        latest = latest.select(*keys, *(F.coalesce(f"row.{c}", f"__{c}").alias(c) if c in held else F.col(f"row.{c}").alias(c) for c in rest), "part")
        fresh = self._write(latest, "part")
        schema = T.StructType([f for f in latest.schema if f.name != "part"])
        self._tell(name, schema, count, grown, [[p, *x] for p, x in fresh.items()])

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows are added as a part of their own; nothing that is there is read. For logs, which are not kept by key."""
        table = self.state.tables.get(name, Table())
        fresh = self._write(rows.withColumn("part", F.lit(max(table.parts, default=-1) + 1)), "part")
        self._tell(name, rows.schema, table.count, False, [[p, *x] for p, x in fresh.items()])

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        """Rows whose keys ``gone`` has are removed; a part without rows left is marked as removed."""
        table = self.state.tables.get(name)
        if table is None:
            return
        named = gone.select(*keys).distinct().withColumn("part", dealt(keys, table.count))
        touched = [r["part"] for r in named.select("part").distinct().collect() if r["part"] in table.parts]
        if not touched:
            return
        known = self._read(name, touched).withColumn("part", dealt(keys, table.count))
        match = [known[k].eqNullSafe(named[k]) for k in keys]
        condition = known["part"] == named["part"]
        for m in match:
            condition = condition & m
        fresh = self._write(known.join(named, condition, "left_anti"), "part")
        self._tell(name, None, table.count, False, [[p, *fresh.get(p, (None, 0))] for p in touched])


def dealt(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _present(spark: SparkSession, root: str, table: Table | None, parts: list[int] | None = None) -> DataFrame | None:
    if table is None or table.schema is None:
        return None
    schema = T.StructType.fromJson(json.loads(table.schema))
    folders = [f"{root}/{folder}" for part, (folder, _) in sorted(table.parts.items()) if parts is None or part in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, table: str, parts: list[int] | None = None) -> DataFrame | None:
    """The present contents of a table, or of some of its parts; None if nothing was ever written there."""
    root, name = _split(table)
    return _present(spark, root, read_state(spark, root).tables.get(name), parts)


def _tried(spark: SparkSession, root: str, run) -> None:
    for k in range(TRIES):
        try:
            with Change(spark, root) as change:
                run(change)
            return
        except Conflict:
            if k == TRIES - 1:
                raise


def replace_table(df: DataFrame, table: str, keys: list[str] | None = None) -> None:
    """Replace a table as a whole, whatever parts it had; a reader of the old version is not disturbed."""
    root, name = _split(table)
    _tried(df.sparkSession, root, lambda c: c.replace(name, df, keys))


def upsert_by_key(changes: DataFrame, table: str, keys: list[str], newest: str | None = None, parts: int = PARTS, kept: tuple[str, ...] = (), rows_per_part: int = ROWS_PER_PART) -> None:
    """``Change.upsert`` of one table; tried again on what another writer has left."""
    root, name = _split(table)
    _tried(changes.sparkSession, root, lambda c: c.upsert(name, changes, keys, newest, parts, kept, rows_per_part))


def delete_by_key(gone: DataFrame, table: str, keys: list[str]) -> None:
    """``Change.delete`` of one table; tried again on what another writer has left."""
    root, name = _split(table)
    _tried(gone.sparkSession, root, lambda c: c.delete(name, gone, keys))


def append(rows: DataFrame, table: str) -> None:
    """``Change.append`` of one table, such as what people said of guesses; tried again if another writer added at the same time."""
    root, name = _split(table)
    _tried(rows.sparkSession, root, lambda c: c.append(name, rows))


def cached(spark: SparkSession, root: str, stage: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's result, made once for each set of parameters and stored under a hash of them; what fails halfway is not stored."""
    key = hashlib.sha1(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:10]
    table = f"{root}#{stage}-{key}"
    if (known := snapshot(spark, table)) is None:
        replace_table(make(), table)
        known = snapshot(spark, table)
    return known


def clean_up(spark: SparkSession, root: str) -> int:
    """Remove versions that the present state does not name and log files before the last summary; how many folders went.

    Only when no older reader and no writer is at work: they may still need what goes.
    """
    root, _ = _split(root)
    numbers, state = _numbers(spark, root), read_state(spark, root)
    named = {folder.split("/")[0] for t in state.tables.values() for folder, _ in t.parts.values()}
    files, at = _fs(spark, root)
    gone = 0
    for s in files.listStatus(at) if files.exists(at) else []:
        folder = s.getPath().getName()
        if folder.startswith("v-") and folder not in named:
            files.delete(s.getPath(), True)
            gone += 1
    for n in numbers:
        if n < max((x for x in numbers if x % SUMMARY == 0), default=0):
            files.delete(_fs(spark, f"{root}/log/{n:012d}.json")[1], False)
    return gone


# ---------------------------------------------------------------- records


def save_records(records: DataFrame, table: str, kept: tuple[str, ...] = ("_tasks",)) -> None:
    """Store records by id. Columns of ``kept`` that the new record leaves null keep what is stored."""
    upsert_by_key(records, table, ["id"], kept=kept)


def delete_records(ids: DataFrame, table: str) -> None:
    """Remove the records with these ids; an id that is not there is an error, and then none is removed."""
    known = snapshot(ids.sparkSession, table)
    missing = ids.select("id") if known is None else ids.select("id").join(known.select("id"), "id", "left_anti")
    if first := missing.first():
        raise KeyError(f"no record {first['id']}")
    delete_by_key(ids, table, ["id"])


def load_record(spark: SparkSession, table: str, record: str | int) -> DataFrame:
    """The record of one id, from the part that it is in; a missing one is an error."""
    root, name = _split(table)
    state = read_state(spark, root).tables.get(name)
    wanted = F.lit(record) if isinstance(record, str) else F.lit(record).cast("long")
    part = spark.range(1).select(F.pmod(F.xxhash64(wanted), F.lit(state.count if state else PARTS))).first()[0]
    known = _present(spark, root, state, [part])
    found = known.where(F.col("id") == wanted) if known is not None else None
    if found is None or found.isEmpty():
        raise KeyError(f"no record {record}")
    return found


def rename_project(spark: SparkSession, store: str, old: str, new: str) -> None:
    """Give a project another name in all tables of a store: projects and members by name, records by their project, links in notes.

    All four change together or none does. A missing project, a blank or long name, or one that is taken, is an error.
    """
    new = new.strip()
    if not new or len(new) > 100:
        raise ValueError("a project's name has 1 to 100 characters")
    with Change(spark, store) as change:
        projects, members, records, notes = (change._read(n) for n in ("projects", "members", "records", "notes"))
        if projects is None or projects.where(F.col("name") == old).isEmpty():
            raise KeyError(f"no project {old}")
        if new != old and not projects.where(F.col("name") == new).isEmpty():
            raise ValueError(f"there is a project {new}")
        named = F.when(F.col("name") == old, new).otherwise(F.col("name")).alias("name")
        change.replace("projects", projects.select(named, *(c for c in projects.columns if c != "name")), ["name"])
        if members is not None:
            change.replace("members", members.withColumn("project", F.when(F.col("project") == old, new).otherwise(F.col("project"))), ["project"])
        if records is not None:
            own = records.where(F.col("project") == old)
            change.upsert("records", own.withColumn("project", F.lit(new)), ["id"])
            if notes is not None:
                link = rf"\[\[{re.escape(old)}(?=[\]|#])"
                linked = notes.where(F.col("text").rlike(link))
                change.upsert("notes", linked.withColumn("text", F.regexp_replace("text", link, ("[[" + new).replace("\\", r"\\").replace("$", r"\$"))), ["id"])


def delete_project(spark: SparkSession, store: str, name: str) -> None:
    """Remove a project and its members, and unlink its records, together or not at all; a missing project is an error."""
    with Change(spark, store) as change:
        projects, members, records = (change._read(n) for n in ("projects", "members", "records"))
        if projects is None or projects.where(F.col("name") == name).isEmpty():
            raise KeyError(f"no project {name}")
        change.delete("projects", spark.createDataFrame([(name,)], "name string"), ["name"])
        if members is not None:
            change.replace("members", members.where(~F.col("project").eqNullSafe(name)), ["project"])
        if records is not None:
            change.upsert("records", records.where(F.col("project") == name).withColumn("project", F.lit(None).cast("string")), ["id"])
