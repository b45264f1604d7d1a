"""Action items in Markdown notes, their keys, states and dates.

notes: id and body, a Markdown text. Tasks: id, line (from 0), done, text, owner, due, turn, editable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions.text import blank_to_null, due_mark, json_text
from parley.sources.tables import durable

#: The patterns of a task's line and its parts.
TASK = r"^(\s*)- \[( |x|X)\] (.+)$"
OWNER = r"^\[\[([^\]|]+)(?:\|[^\]]*)?\]\]\s*"
DUE = r"\s*(?:📅\s*(\d{4}-\d{2}-\d{2})|\(due: ([^)]+)\))"
CITE = r"\s*\((?:\[\[#\^t\d+(?:\\?\|[^\]]*)?\]\](?:,\s*)?)+\)"
TURN = r"\[\[#\^(t\d+)"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BOX = r"- \[( |x|X)\]"

#: Fixed value: days until a new task's reminder.
REMINDER_DAYS = 7


def note_lines(body: str = "body") -> Column:
    """The lines above the transcript's heading."""
    lines = F.split(body, LINE_END)
    stop = F.array_position(F.transform(lines, lambda x: x.startswith("## Transcript")), True)
    return F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)


def parse_tasks(notes: DataFrame) -> DataFrame:
    """One row for each task line above the transcript whose text is not blank."""
    lines = notes.select("id", F.posexplode(note_lines()).alias("line", "__line")).where(F.col("__line").rlike(TASK))
    found = lines.select("id", "line", (F.lower(F.regexp_extract("__line", TASK, 2)) == "x").alias("done"), F.regexp_extract("__line", TASK, 3).alias("__raw"))
    body = found.withColumns({"turn": blank_to_null(F.regexp_extract("__raw", TURN, 1)), "__body": F.regexp_replace("__raw", CITE, "")})
    owned = body.withColumns({"owner": blank_to_null(F.regexp_extract("__body", OWNER, 1)), "__rest": F.regexp_replace("__body", OWNER, "")})
    # Only the first due mark counts: what stands before it and behind it is kept.
    parts = [F.regexp_extract("__rest", rf"(?s)^(.*?){DUE}(.*)$", k) for k in (1, 2, 3, 4)]
    dated = F.col("__rest").rlike(DUE)
    split = owned.withColumns({"due": F.when(dated, F.coalesce(blank_to_null(parts[1]), blank_to_null(parts[2]))), "text": F.when(dated, F.concat(parts[0], parts[3])).otherwise(F.col("__rest"))})
    task = F.struct("line", "done", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"), "owner", "due", "turn", F.lit(True).alias("editable"))
    # Blank texts are left out within the row, so that the patterns are not matched again for a filter.
    return split.select("id", F.inline(F.filter(F.array(task), lambda t: t["text"] != "")))


def item_tasks(items: DataFrame) -> DataFrame:
    """Extracted action items (id, seq, task, owner, due, source_turns) as tasks that only the store can tick."""
    return items.select(
        "id", (F.col("seq") - F.lit(1 << 30)).alias("line"), F.lit(False).alias("done"), F.col("task").alias("text"), "owner", "due", F.get("source_turns", F.lit(0)).alias("turn"), F.lit(False).alias("editable")
    )


def recover_owners(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Where a task without owner reads 'owner task' of one of its note's items, both are told apart; the first item wins."""
    known = items.where(blank_to_null("owner").isNotNull()).select("id", F.concat("owner", F.lit(" "), "task").alias("text"), F.struct("seq", "owner", "task").alias("item"))
    first = known.groupBy("id", "text").agg(F.min("item").alias("item"))
    joined = tasks.join(first, ["id", "text"], "left")
    hit = F.col("owner").isNull() & F.col("item").isNotNull()
    return joined.withColumns({"text": F.when(hit, F.col("item.task")).otherwise(F.col("text")), "owner": F.when(hit, F.col("item.owner")).otherwise(F.col("owner"))}).select(tasks.columns)


def source_tasks(notes: DataFrame, items: DataFrame) -> DataFrame:
    """The tasks of each note; a note without any takes its extracted items. Notes are parsed once, though tasks are read twice."""
    read = durable(recover_owners(parse_tasks(notes), items))
    return read.unionByName(item_tasks(items).join(read.select("id").distinct(), "id", "left_anti"))


def with_keys(tasks: DataFrame) -> DataFrame:
    """Tasks with ``key``: a hash of text, owner and how many equal ones stand before it in the note."""
    words = F.trim(F.regexp_replace("text", r"\s+", " "))
    signature = F.concat(F.lit("["), json_text(words), F.lit(", "), json_text("owner"), F.lit("]"))
    nth = F.row_number().over(W.partitionBy("id", "__signature").orderBy("line"))
    signed = tasks.withColumn("__signature", signature)
    return signed.withColumn("key", F.sha2(F.concat("__signature", F.lit(":"), nth), 256)).drop("__signature")


def sync_states(tasks: DataFrame, states: DataFrame, today: str) -> DataFrame:
    """States (id, key, task_id, reminder_date, created_date, done) of the tasks there are now.

    Known keys keep theirs, with ``done`` from the note where the note can be edited; new ones get an id and a reminder;
    states whose task is gone are dropped. tasks: with keys.
    """
    joined = tasks.select("id", "key", F.col("done").alias("__now"), "editable").join(states, ["id", "key"], "left")
    fresh = F.col("task_id").isNull()
    return joined.select(
        "id",
        "key",
        F.coalesce("task_id", F.left(F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), "key"), 256), F.lit(32))).alias("task_id"),
        F.coalesce("reminder_date", F.lit(today).cast("date") + REMINDER_DAYS).alias("reminder_date"),
        F.coalesce("created_date", F.lit(today).cast("date")).alias("created_date"),
        F.when(fresh | F.col("editable"), F.col("__now")).otherwise(F.col("done")).alias("done"),
    )


def with_states(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Tasks with task_id and reminder_date of their states; read-only ones also take ``done``."""
    joined = tasks.withColumnRenamed("done", "__done").join(states.select("id", "key", "task_id", "reminder_date", "done"), ["id", "key"], "left")
    done = F.when(F.col("editable"), F.col("__done")).otherwise(F.coalesce("done", "__done"))
    return joined.withColumn("done", done).drop("__done")


def tick_lines(notes: DataFrame, ticks: DataFrame) -> DataFrame:
    """Notes with the boxes of some lines set: ticks has id, line, done; lines that are no tasks stay as they are."""
    packed = ticks.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("line", "done"))).alias("__ticks"))
    lines = F.transform(
        F.split("body", "\n"),
        lambda x, k: F.when(F.map_contains_key("__ticks", k) & x.rlike(TASK), F.regexp_replace(x, r"^(\s*)- \[[ xX]\]", F.when(F.element_at("__ticks", k), F.lit("$1- [x]")).otherwise(F.lit("$1- [ ]")))).otherwise(x),
    )
    return notes.join(packed, "id", "left").withColumn("body", F.when(F.col("__ticks").isNull(), F.col("body")).otherwise(F.array_join(lines, "\n"))).drop("__ticks")


def carry_completion(rendered: DataFrame, previous: DataFrame, items: DataFrame) -> DataFrame:
    """New notes in which tasks that were done before are ticked. previous: tasks with keys and ``done``."""
    tasks = with_keys(recover_owners(parse_tasks(rendered), items))
    done = previous.where("done").select("id", "key").distinct()
    return tick_lines(rendered, tasks.join(done, ["id", "key"], "left_semi").select("id", "line", F.lit(True).alias("done")))


def set_done(states: DataFrame, changes: DataFrame) -> DataFrame:
    """States with changed ``done`` and ``reminder_date`` (changes: task_id, done, reminder_date; null leaves a value)."""
    new = changes.select("task_id", F.col("done").alias("__done"), F.col("reminder_date").alias("__date"))
    joined = states.join(new, "task_id", "left")
    return joined.withColumns({"done": F.coalesce("__done", "done"), "reminder_date": F.coalesce("__date", "reminder_date")}).select(states.columns)


def task_rows(tasks: DataFrame, meetings: DataFrame) -> DataFrame:
    """Tasks with their meeting's title, date and project (meetings: id, title, date, project)."""
    return tasks.join(meetings.select("id", F.col("title").alias("meeting"), "date", "project"), "id")


def open_tasks(tasks: DataFrame, most: int = 50) -> DataFrame:
    """The first open tasks by due date, missing ones last, then by the meeting's date and place."""
    return tasks.where(~F.col("done")).orderBy(F.asc_nulls_last("due"), "date", "id", "line").limit(most)


def task_list(tasks: DataFrame) -> DataFrame:
    """All tasks, open ones first, by reminder."""
    return tasks.orderBy("done", F.coalesce(F.col("reminder_date").cast("string"), F.lit("")), "task_id")


def find_tasks(tasks: DataFrame, status: str = "all", project: str | None = None, owner: str | None = None, needle: str = "", today: str = "") -> DataFrame:
    """Tasks by status (all, open, done, due), project and owner ('' for none, None for any) and a text in any column."""
    from parley.operators.dashboard import search

    for name, wanted in (("project", project), ("owner", owner)):
        if wanted is not None:
            tasks = tasks.where(blank_to_null(name).isNull() if wanted == "" else F.col(name) == wanted)
    if status == "due":
        tasks = tasks.where(reminder_is_due(today))
    elif status != "all":
        tasks = tasks.where("done" if status == "done" else "not done")
    return search(tasks, needle, tuple(c for c in ("text", "owner", "meeting", "project") if c in tasks.columns))


def reminder_is_due(today: str) -> Column:
    """Whether an open task's reminder has come; ISO dates compare as texts."""
    return ~F.col("done") & (F.col("reminder_date").cast("string") <= today)


def status_counts(tasks: DataFrame, today: str) -> DataFrame:
    return tasks.agg(F.count("*").alias("all"), F.count_if(~F.col("done")).alias("open"), F.count_if("done").alias("done"), F.count_if(reminder_is_due(today)).alias("due"))


def task_line(task: Column, owner: Column, due: Column, done: Column) -> Column:
    """A task as a note shows it."""
    link = F.when(blank_to_null(owner).isNotNull(), F.concat(F.lit("[["), owner, F.lit("]] "))).otherwise(F.lit(""))
    return F.concat(F.when(done, F.lit("- [x] ")).otherwise(F.lit("- [ ] ")), link, task, due_mark(due))
