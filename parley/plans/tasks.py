"""Task queries. Each customer's orders make up a note, written alike in both engines, and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import tasks as k
from parley.plans import query, table
from parley.sources.tables import durable

TODAY = "1998-06-30"

#: A note for each customer: one task line an order, then a transcript with a decoy.
NOTES_SQL = """SELECT o_custkey AS id, '# Notes' || chr(10) || string_agg(line, chr(10) ORDER BY o_orderkey) || chr(10) || '## Transcript' || chr(10) || '- [ ] no task' AS body FROM
  (SELECT o_custkey, o_orderkey, '- [' || CASE o_orderstatus WHEN 'F' THEN 'x' WHEN 'O' THEN ' ' ELSE 'X' END || '] '
    || CASE WHEN o_orderkey % 3 = 0 THEN '[[Clerk ' || (o_orderkey % 5) || '|C]] ' WHEN o_orderkey % 3 = 1 THEN 'Clerk ' || (o_orderkey % 5) || ' ' ELSE '' END
    || 'Ship  part ' || (o_orderkey % 4) || CASE WHEN o_orderkey % 4 = 1 THEN '' WHEN o_orderkey % 4 = 2 THEN ' (due: next week)' ELSE ' 📅 ' || strftime(o_orderdate, '%Y-%m-%d') END
    || CASE WHEN o_orderkey % 2 = 0 THEN ' ([[#^t' || (o_orderkey % 9) || '|00:00:05]])' ELSE '' END AS line FROM orders) GROUP BY o_custkey"""

_LINES = f"""SELECT id, line - 1 AS line, x FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS line FROM
  (SELECT id, string_split(body, chr(10)) AS full_l, list_slice(full_l, 1, list_position(full_l, '## Transcript') - 1) AS l FROM ({NOTES_SQL}))) WHERE regexp_matches(x, '^(\\s*)- \\[( |x|X)\\] (.+)$')"""

_DUE = r"\s*(?:📅\s*(\d{4}-\d{2}-\d{2})|\(due: ([^)]+)\))"

TASKS_SQL = f"""SELECT id, line, done, trim(regexp_replace(rest, '{_DUE}', '')) AS text, owner, coalesce(nullif(regexp_extract(rest, '{_DUE}', 1), ''), nullif(regexp_extract(rest, '{_DUE}', 2), '')) AS due, turn FROM
  (SELECT *, nullif(regexp_extract(b, '^\\[\\[([^\\]|]+)', 1), '') AS owner, regexp_replace(b, '^\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]\\s*', '') AS rest FROM
    (SELECT id, line, lower(regexp_extract(x, '^(\\s*)- \\[( |x|X)\\] (.+)$', 2)) = 'x' AS done, nullif(regexp_extract(x, '\\[\\[#\\^(t\\d+)', 1), '') AS turn,
      regexp_replace(regexp_extract(x, '^(\\s*)- \\[( |x|X)\\] (.+)$', 3), '\\s*\\((?:\\[\\[#\\^t\\d+(?:\\|[^\\]]*)?\\]\\](?:,\\s*)?)+\\)', '', 'g') AS b FROM ({_LINES})))"""

OWNED_SQL = f"""SELECT id, line, done, CASE WHEN owner IS NULL AND regexp_matches(text, '^Clerk \\d Ship') THEN text[9:] ELSE text END AS text,
  CASE WHEN owner IS NULL AND regexp_matches(text, '^Clerk \\d Ship') THEN text[:7] ELSE owner END AS owner, due, turn FROM ({TASKS_SQL})"""

KEYED_SQL = f"""SELECT *, sha256(sig || ':' || row_number() OVER (PARTITION BY id, sig ORDER BY line)) AS key FROM
  (SELECT *, '["' || regexp_replace(text, '\\s+', ' ', 'g') || '", ' || coalesce('"' || owner || '"', 'null') || ']' AS sig FROM ({OWNED_SQL}))"""

#: States as they were when only two thirds of the tasks were known.
STATES_SQL = f"""SELECT id, key, 'task-' || left(key, 8) AS task_id, DATE '1998-01-01' + CAST(line AS INTEGER) AS reminder_date, DATE '1997-12-25' AS created_date, line % 2 = 0 AS done FROM ({KEYED_SQL}) WHERE line % 3 <> 1"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    clerk = F.concat(F.lit("Clerk "), (key % 5).cast("string"))
    owner = F.when(key % 3 == 0, F.concat(F.lit("[["), clerk, F.lit("|C]] "))).when(key % 3 == 1, F.concat(clerk, F.lit(" "))).otherwise(F.lit(""))
    due = F.when(key % 4 == 1, F.lit("")).when(key % 4 == 2, F.lit(" (due: next week)")).otherwise(F.concat(F.lit(" 📅 "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    cite = F.when(key % 2 == 0, F.concat(F.lit(" ([[#^t"), (key % 9).cast("string"), F.lit("|00:00:05]])"))).otherwise(F.lit(""))
    box = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "O", " ").otherwise("X")
    line = F.concat(F.lit("- ["), box, F.lit("] "), owner, F.lit("Ship  part "), (key % 4).cast("string"), due, cite)
    told = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    body = F.concat_ws("\n", F.lit("# Notes"), F.array_join(told, "\n"), F.lit("## Transcript"), F.lit("- [ ] no task"))
    return o.groupBy(F.col("o_custkey").alias("id")).agg(body.alias("body"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted items behind the notes: every combination of clerk and part, by note."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.struct((c * 4 + p).alias("seq"), F.concat(F.lit("Ship  part "), p.cast("string")).alias("task"), F.concat(F.lit("Clerk "), c.cast("string")).alias("owner")))))
    return ids.select("id", F.inline(pairs)).withColumns({"due": F.lit(None).cast("string"), "source_turns": F.array(F.lit("t1"))})


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.with_keys(k.source_tasks(notes(spark, sf_dir), items(spark, sf_dir)))


def states(tasks: DataFrame) -> DataFrame:
    known = tasks.where("line % 3 <> 1")
    return known.select(
        "id", "key", F.concat(F.lit("task-"), F.left("key", F.lit(8))).alias("task_id"), (F.lit("1998-01-01").cast("date") + F.col("line").cast("int")).alias("reminder_date"), F.lit("1997-12-25").cast("date").alias("created_date"), (F.col("line") % 2 == 0).alias("done")
    )


@query(f"SELECT id, CAST(line AS INTEGER) AS line, done, text, owner, due, turn FROM ({TASKS_SQL})")
def parse_task_lines(spark, sf_dir):
    return k.parse_tasks(notes(spark, sf_dir)).drop("editable")


@query(f"SELECT id, CAST(line AS INTEGER) AS line, text, owner FROM ({OWNED_SQL})")
def task_owner_recovery(spark, sf_dir):
    return k.recover_owners(k.parse_tasks(notes(spark, sf_dir)), items(spark, sf_dir)).select("id", "line", "text", "owner")


@query(f"SELECT id, CAST(line AS INTEGER) AS line, key FROM ({KEYED_SQL})")
def task_keys_occurrence(spark, sf_dir):
    return keyed(spark, sf_dir).select("id", "line", "key")


@query(f"""
SELECT t.id, t.key, coalesce(s.task_id, left(sha256(t.id || ':' || t.key), 32)) AS task_id, coalesce(s.reminder_date, DATE '{TODAY}' + 7) AS reminder_date,
  coalesce(s.created_date, DATE '{TODAY}') AS created_date, t.done FROM ({KEYED_SQL}) t LEFT JOIN ({STATES_SQL}) s USING (id, key)""")
def task_state_upsert(spark, sf_dir):
    tasks = keyed(spark, sf_dir)
    return k.sync_states(tasks, states(tasks), TODAY)


@query(f"""
SELECT t.id, CAST(t.line AS INTEGER) AS line, t.text, t.done, s.task_id, s.reminder_date FROM ({KEYED_SQL}) t LEFT JOIN ({STATES_SQL}) s USING (id, key)""")
def tasks_with_states(spark, sf_dir):
    tasks = keyed(spark, sf_dir)
    return k.with_states(tasks, states(tasks)).select("id", "line", "text", "done", "task_id", "reminder_date")


@query(f"""
WITH l AS (SELECT id, x, line FROM (SELECT id, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line FROM ({NOTES_SQL})))
SELECT l.id, string_agg(CASE WHEN k.key IS NOT NULL THEN regexp_replace(x, '- \\[( |x|X)\\]', '- [x]') ELSE x END, chr(10) ORDER BY l.line) AS body
FROM l LEFT JOIN (SELECT id, line, key FROM ({KEYED_SQL}) WHERE line % 2 = 0) k ON k.id = l.id AND k.line = l.line GROUP BY l.id""")
def carry_completion(spark, sf_dir):
    made = durable(notes(spark, sf_dir))
    before = k.with_keys(k.source_tasks(made, items(spark, sf_dir))).withColumn("done", F.col("line") % 2 == 0)
    return k.carry_completion(made, before, items(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.plans.dashboard import meetings

    people = meetings(spark, sf_dir).groupBy(F.regexp_extract(F.element_at("people", 1), r"(\d+)$", 1).cast("long").alias("id")).agg(F.max("date").alias("date"), F.min("project").alias("project"))
    return k.task_rows(keyed(spark, sf_dir), people.where("id is not null").withColumn("title", F.concat(F.lit("Account "), F.col("id").cast("string"))))


_ROWS_SQL = f"""SELECT t.id, t.line, t.done, t.text, t.owner, t.due, 'Account ' || t.id AS meeting, m.date, m.project FROM ({OWNED_SQL}) t JOIN
  (SELECT o_custkey AS id, max(strftime(o_orderdate, '%Y-%m-%d')) AS date, min(o_orderpriority || ':' || o_orderstatus) AS project FROM orders WHERE o_custkey % 10 <> 0 GROUP BY 1) m USING (id)"""


@query(f"SELECT id, CAST(line AS INTEGER) AS line, text, owner, due, date FROM ({_ROWS_SQL}) WHERE NOT done ORDER BY due NULLS LAST, date, id, line LIMIT 50")
def open_tasks_sorted_top50(spark, sf_dir):
    return k.open_tasks(_rows(spark, sf_dir)).select("id", "line", "text", "owner", "due", "date")


@query(f"""
SELECT id, CAST(line AS INTEGER) AS line, text, owner, project FROM ({_ROWS_SQL})
WHERE NOT done AND owner = 'Clerk 3' AND (contains(lower(text), 't 7') OR contains(lower(meeting), 't 7') OR contains(lower(project), 't 7'))""")
def task_filter_search(spark, sf_dir):
    return k.find_tasks(_rows(spark, sf_dir), "open", owner="Clerk 3", needle="T 7").select("id", "line", "text", "owner", "project")


@query(f"""
SELECT count(*) AS "all", count(*) FILTER (NOT t.done) AS open, count(*) FILTER (t.done) AS done, count(*) FILTER (NOT t.done AND CAST(s.reminder_date AS VARCHAR) <= '1998-01-08') AS due
FROM ({KEYED_SQL}) t LEFT JOIN ({STATES_SQL}) s USING (id, key)""")
def task_status_counts(spark, sf_dir):
    tasks = keyed(spark, sf_dir)
    return k.status_counts(k.with_states(tasks, states(tasks)), "1998-01-08")


@query(f"""
SELECT id, key, task_id, CASE WHEN left(key, 1) = '7' THEN DATE '1999-01-01' ELSE reminder_date END AS reminder_date, created_date, CASE WHEN left(key, 1) = '7' THEN true ELSE done END AS done FROM ({STATES_SQL})""")
def task_updates(spark, sf_dir):
    known = states(keyed(spark, sf_dir))
    # Equal notes of two customers give equal keys, hence equal task ids; one change is enough for both.
    changes = known.where("left(key, 1) = '7'").select("task_id").distinct().select("task_id", F.lit(True).alias("done"), F.lit("1999-01-01").cast("date").alias("reminder_date"))
    return k.set_done(known, changes).select("id", "key", "task_id", "reminder_date", "created_date", "done")


@query(f"""
SELECT id, CAST(line AS INTEGER) AS line, CASE WHEN done THEN '- [x] ' ELSE '- [ ] ' END || coalesce('[[' || owner || ']] ', '') || text
  || CASE WHEN due IS NULL THEN '' WHEN regexp_matches(due, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN ' 📅 ' || due ELSE ' (due: ' || due || ')' END AS shown FROM ({OWNED_SQL})""")
def task_lines_rendered(spark, sf_dir):
    return keyed(spark, sf_dir).select("id", "line", k.task_line(F.col("text"), F.col("owner"), F.col("due"), F.col("done")).alias("shown"))
