"""Dashboard queries. Orders stand for meetings, conversations for turns, events for recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import dashboard as d
from parley.plans import query, table

#: Meetings as DuckDB builds them.
MEETINGS_SQL = """
SELECT o_orderkey AS id, 'Meeting ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CAST(o_orderdate AS DATE) AS day, o_orderpriority || ':' || o_orderstatus AS project,
  CAST(floor(o_totalprice) AS BIGINT) % 7200 AS duration, [CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE c_name END] AS people,
  ['Guest ' || (o_orderkey % 7), 'Guest ' || (o_orderkey % 3)] AS attendees, c_mktsegment AS segment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    guest = [F.concat(F.lit("Guest "), (F.col("o_orderkey") % n).cast("string")) for n in (7, 3)]
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Meeting "), F.col("o_orderkey").cast("string")).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.to_date("o_orderdate").alias("day"),
        F.concat("o_orderpriority", F.lit(":"), "o_orderstatus").alias("project"),
        (F.floor("o_totalprice").cast("long") % 7200).alias("duration"),
        F.array(F.when(F.col("o_custkey") % 10 != 0, F.col("c_name"))).alias("people"),
        F.array(*guest).alias("attendees"),
        F.col("c_mktsegment").alias("segment"),
    )


def spoken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a turn as long as its text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("id"), F.col("role").alias("speaker"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.floor("value").cast("long").alias("duration"))


@query("""
SELECT role AS name, CAST(sum(s) AS BIGINT) AS seconds, count(*) AS meetings FROM
  (SELECT conv_id, role, sum(length(text)) AS s FROM conversations GROUP BY ALL) GROUP BY role ORDER BY seconds DESC, name LIMIT 8""")
def speaking_time_leaderboard(spark, sf_dir):
    return d.speaker_board(spoken_turns(spark, sf_dir))


@query("""
SELECT CAST(d AS DATE) AS day, count(e.ts) AS meetings, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS seconds
FROM range(TIMESTAMP '2024-01-12', TIMESTAMP '2024-02-11', INTERVAL 1 DAY) r(d) LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d AS DATE) GROUP BY d""")
def activity_spine_30d(spark, sf_dir):
    return d.activity(recordings(spark, sf_dir), "2024-02-10", 30)


@query("""
WITH s AS (SELECT count(*) FILTER (day BETWEEN DATE '2024-01-16' AND DATE '2024-01-25') AS meetings,
  CAST(coalesce(sum(v) FILTER (day BETWEEN DATE '2024-01-16' AND DATE '2024-01-25'), 0) AS BIGINT) AS seconds,
  count(*) FILTER (day >= DATE '2024-01-06' AND day < DATE '2024-01-16') AS previous_meetings,
  CAST(coalesce(sum(v) FILTER (day >= DATE '2024-01-06' AND day < DATE '2024-01-16'), 0) AS BIGINT) AS previous_seconds
  FROM (SELECT CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS v FROM events))
SELECT *, round((meetings - previous_meetings) / nullif(previous_meetings, 0) * 100, 1) AS meetings_delta,
  round((seconds - previous_seconds) / nullif(previous_seconds, 0) * 100, 1) AS seconds_delta FROM s""")
def period_vs_previous(spark, sf_dir):
    return d.period_totals(recordings(spark, sf_dir), "2024-01-25", 10)


@query(f"""
SELECT count(*) AS meetings, round(sum(duration) / 3600, 1) AS hours, count(*) FILTER (people[1] IS NULL) AS unnamed FROM ({MEETINGS_SQL})""")
def kpi_totals(spark, sf_dir):
    return d.totals(meetings(spark, sf_dir))


@query(f"""
SELECT replace(project, ':', '-') AS name, count(*) AS meetings, CAST(sum(duration) AS BIGINT) AS seconds, max(date) AS last
FROM ({MEETINGS_SQL}) GROUP BY 1""")
def project_rollup(spark, sf_dir):
    return d.project_rollup(meetings(spark, sf_dir))


@query("""
SELECT conv_id AS id, role AS speaker, CAST(sum(length(text)) AS BIGINT) AS seconds, count(*) AS turns,
  round(sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY conv_id), 4) AS share
FROM conversations GROUP BY conv_id, role HAVING sum(length(text)) > 0""")
def conversation_speaker_stats(spark, sf_dir):
    return d.speaker_share(spoken_turns(spark, sf_dir))


@query(f"""
SELECT name, count(*) AS meetings FROM (SELECT DISTINCT id, unnest(list_concat(people, attendees)) AS name FROM ({MEETINGS_SQL}))
WHERE name IS NOT NULL GROUP BY name""")
def attendance_per_person(spark, sf_dir):
    return d.attendance(meetings(spark, sf_dir))


_ROWS_SQL = f"""
SELECT id, title, date, replace(project, ':', '-') AS project, duration, array_to_string(list_sort(list_distinct(list_concat(people, attendees))), '|') AS people,
  CAST(CASE WHEN people[1] IS NULL THEN 1 ELSE 0 END AS INTEGER) AS unidentified FROM ({MEETINGS_SQL})"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("people", F.array_join("people", "|"))


@query(_ROWS_SQL + " ORDER BY date DESC, id LIMIT 6")
def recent_meetings(spark, sf_dir):
    return _shown(d.recent(d.meeting_rows(meetings(spark, sf_dir))))


@query(_ROWS_SQL)
def meeting_rows(spark, sf_dir):
    return _shown(d.meeting_rows(meetings(spark, sf_dir)))


@query(f"SELECT * FROM ({_ROWS_SQL}) WHERE contains(lower(title), '77') OR contains(lower(people), 'customer#000000012')")
def meeting_search(spark, sf_dir):
    rows = d.meeting_rows(meetings(spark, sf_dir))
    found = d.search(rows, "77", ("title",)).union(d.search(rows, "Customer#000000012", (), ("people",)))
    return _shown(found).dropDuplicates(["id"])


@query(f"SELECT id, title, duration FROM ({MEETINGS_SQL}) WHERE replace(project, ':', '-') = '1-URGENT-O'")
def project_records(spark, sf_dir):
    rows = d.meeting_rows(meetings(spark, sf_dir))
    return rows.where(F.col("project") == "1-URGENT-O").select("id", "title", "duration")


@query("""
WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS meetings FROM events GROUP BY 1)
SELECT day, meetings, round(meetings / (SELECT sum(meetings) FROM a), 4) AS share FROM a ORDER BY meetings DESC, day LIMIT 1""")
def busiest_day(spark, sf_dir):
    return d.busiest_day(recordings(spark, sf_dir).groupBy("day").agg(F.count("*").alias("meetings")))


@query("""
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role FROM customer WHERE contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')""")
def people_search(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    return d.search(people, "Auto", ("name", "role"))
