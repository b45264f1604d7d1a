"""Queries about people and projects. Customers stand for people, nations for projects, suppliers for speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import people as p
from parley.plans import query, table

#: Who belongs to which project, whom its meetings saw and whose tasks it has; spellings differ in case.
_TEAM_SQL = """
WITH members AS (SELECT n_name AS project, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0),
met AS (SELECT n_name AS project, o_orderkey AS id, upper(c_name) AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 4 = 0),
owed AS (SELECT n_name AS project, lower(c_name) AS owner, o_orderstatus = 'F' AS done FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 4 = 1),
k AS (SELECT project, lower(name) AS f, min(name) AS name, 0 AS r FROM members GROUP BY ALL UNION ALL SELECT project, lower(name), min(name), 1 FROM met GROUP BY ALL UNION ALL SELECT project, owner, min(owner), 2 FROM owed GROUP BY ALL),
n AS (SELECT project, f, arg_min(name, r) AS name, min(r) = 0 AS assigned FROM k GROUP BY ALL),
a AS (SELECT project, lower(name) AS f, count(DISTINCT id) AS meetings FROM met GROUP BY ALL),
o AS (SELECT project, owner AS f, count(*) FILTER (NOT done) AS open_tasks FROM owed GROUP BY ALL)
SELECT project, n.name, coalesce(c_mktsegment, '') AS role, CASE WHEN c_name IS NULL THEN '' ELSE 'Org ' || c_nationkey END AS organisation, assigned, coalesce(meetings, 0) AS meetings, coalesce(open_tasks, 0) AS open_tasks
FROM n LEFT JOIN a USING (project, f) LEFT JOIN o USING (project, f) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON lower(c_name) = f"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")


@query(_TEAM_SQL)
def team_overview_full_outer(spark, sf_dir):
    located = _located(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(located, F.col("o_custkey") == F.col("c_custkey"))
    members = located.where("c_custkey % 3 = 0").select("project", F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    met = orders.where("o_orderkey % 4 = 0").select("project", F.col("o_orderkey").alias("id"), F.upper("c_name").alias("name"))
    owed = orders.where("o_orderkey % 4 = 1").select("project", F.lower("c_name").alias("owner"), (F.col("o_orderstatus") == "F").alias("done"))
    profiles = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.concat(F.lit("Org "), F.col("c_nationkey").cast("string")).alias("organisation"))
    return p.in_team_order(p.team(members, met, owed, profiles))


@query("""
SELECT o_orderpriority AS project, count(*) FILTER (o_orderstatus <> 'F') AS open_tasks, count(*) FILTER (o_orderstatus = 'F') AS completed_tasks,
  count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 3 = 0) AS unassigned_tasks FROM orders GROUP BY 1""")
def project_task_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return p.project_task_counts(o.select(F.col("o_orderpriority").alias("project"), (F.col("o_orderstatus") == "F").alias("done"), F.when(F.col("o_orderkey") % 3 != 0, F.lit("Ann")).otherwise(F.lit("")).alias("owner")))


@query("""
SELECT coalesce(s.name, f.name) AS name, coalesce(meetings, 0) AS meetings, coalesce(seconds, 0) AS seconds, last, modified, greatest(last, modified) AS latest FROM
  (SELECT n_name AS name, count(*) AS meetings, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS seconds, max(strftime(o_orderdate, '%Y-%m-%d')) AS last
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1) s
  FULL JOIN (SELECT n_name AS name, '1998-' || lpad(CAST(n_nationkey % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS modified FROM nation WHERE n_nationkey % 3 = 0) f ON s.name = f.name""")
def projects_full_outer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.floor("o_totalprice").cast("long").alias("seconds"))
    located = orders.join(_located(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 2 = 0")
    stats = located.groupBy(F.col("project").alias("name")).agg(F.count("*").alias("meetings"), F.sum("seconds").alias("seconds"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last"))
    folders = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.format_string("1998-%02d-01", F.col("n_nationkey") % 12 + 1).alias("modified"))
    return p.projects(stats, folders)


@query("""
SELECT s_suppkey AS speaker_id, s_name AS name, count(v.vec_id) AS samples FROM supplier LEFT JOIN embeddings v ON s_suppkey = v.label AND v.vec_id % 2 = 1 GROUP BY ALL""")
def voice_people_left_join(spark, sf_dir):
    speakers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("speaker_id"), F.col("s_name").alias("name"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("speaker_id"), F.when(F.col("vec_id") % 2 == 1, F.lit("m1")).otherwise(F.lit("m2")).alias("model"))
    return p.speakers_with_samples(speakers, vectors, "m1")


@query("""
SELECT s_suppkey AS speaker_id, s_name AS name, coalesce(q.seconds, 0) AS seconds, coalesce(q.meetings, 0) AS meetings, CASE WHEN n_name IS NULL THEN '' ELSE 'role ' || s_nationkey END AS role,
  coalesce(n_name, '') AS organisation, CASE WHEN n_name IS NULL THEN '' ELSE 'bio' END AS bio FROM supplier
  LEFT JOIN (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS seconds, count(DISTINCT l_orderkey) AS meetings FROM lineitem GROUP BY 1) q ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey AND s_suppkey % 3 = 0""")
def voice_profiles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    speakers = s.select(F.col("s_suppkey").alias("speaker_id"), F.col("s_name").alias("name"))
    each = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("seconds"))
    talk = each.groupBy("l_suppkey").agg(F.sum("seconds").cast("long").alias("seconds"), F.count("*").alias("meetings")).join(speakers, F.col("l_suppkey") == F.col("speaker_id")).select("name", "seconds", "meetings")
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    people = s.where("s_suppkey % 3 = 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return p.voice_profiles(speakers, talk, people.select(F.upper("s_name").alias("name"), F.concat(F.lit("role "), F.col("s_nationkey").cast("string")).alias("role"), F.col("n_name").alias("organisation"), F.lit("bio").alias("bio")))


@query("SELECT c_custkey AS speaker_id, c_name AS name FROM customer WHERE c_custkey % 11 = 3")
def attendee_semi_join(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("speaker_id"), F.col("c_name").alias("name"))
    return p.expected_speakers(people, people.where("speaker_id % 11 = 3").select(F.concat(F.lit("  "), F.upper("name")).alias("name")))


@query("""
SELECT 'rec-' || o_orderkey AS file, CAST(o_totalprice AS DOUBLE) AS seconds FROM orders WHERE o_totalprice >= 50000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def unprocessed_anti_join(spark, sf_dir):
    recordings = table(spark, sf_dir, "orders").select(F.concat(F.lit("rec-"), F.col("o_orderkey").cast("string")).alias("file"), F.col("o_totalprice").alias("seconds"))
    in_use = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("rec-"), F.col("l_orderkey").cast("string")).alias("file"))
    return p.unprocessed(recordings, in_use, 50000)


@query("""
SELECT conv_id AS id, turn, role AS speaker, CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN 'Ann ' || conv_id WHEN role = 'assistant' THEN 'Unknown speaker 1' ELSE role END AS label FROM conversations""")
def labelled_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("id"), "turn", F.col("role").alias("speaker"))
    voices = c.where("role <> 'system'").select(F.col("conv_id").alias("id"), F.col("role").alias("cluster")).distinct()
    named = F.when((F.col("cluster") == "user") & (F.col("id") % 3 == 0), F.concat(F.lit("Ann "), F.col("id").cast("string"))).when(F.col("cluster") == "assistant", F.lit(""))
    return p.label_turns(turns, voices.select("id", "cluster", named.alias("name"), F.when(F.col("cluster") == "assistant", F.lit("Unknown speaker 1")).alias("unknown_label")))


@query("""
SELECT id, speaker, start, text FROM (SELECT conv_id AS id, role AS speaker, turn AS start, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS n FROM conversations) WHERE n <= 2""")
def longest_quotes(spark, sf_dir):
    return p.longest_quotes(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("speaker"), F.col("turn").alias("start"), "text"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def people_sorted(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    return p.sort_people(people, "c_mktsegment", True).withColumnRenamed("name", "c_name")


@query("SELECT CAST(sum(c_nationkey) AS BIGINT) AS samples, CAST(sum(c_custkey) AS BIGINT) AS minutes, count(*) FILTER (c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING') AS complete, max(c_custkey) AS most FROM customer")
def people_totals(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    role = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")
    return p.people_totals(c.select(F.col("c_nationkey").alias("samples"), F.col("c_custkey").alias("minutes"), role.alias("role"), F.when(F.col("c_custkey") % 2 == 0, F.lit("Org")).otherwise(F.lit("")).alias("organisation")))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS id, 100 + n_regionkey AS needs FROM nation UNION SELECT n_nationkey, n_nationkey - 5 FROM nation WHERE n_nationkey >= 5),
c AS (SELECT n_nationkey AS root, n_nationkey AS id FROM nation UNION SELECT c.root, e.needs FROM c JOIN e ON c.id = e.id)
SELECT root, id FROM c""")
def dependency_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").alias("id"), (100 + F.col("n_regionkey")).alias("needs")).union(n.where("n_nationkey >= 5").select("n_nationkey", F.col("n_nationkey") - 5))
    return p.closure(edges, n.select(F.col("n_nationkey").alias("id")))


@query("""
SELECT o_orderkey AS id, stem, CASE WHEN n = 1 THEN stem ELSE stem || ' (' || n || ')' END AS path FROM
  (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS stem, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS n FROM orders)""")
def unique_note_paths(spark, sf_dir):
    return p.unique_paths(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("stem")))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'built-in' END AS text FROM nation")
def template_override(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), "n_nationkey")
    return p.overridden(n.select("key", F.lit("built-in").alias("text")), n.where("n_nationkey % 2 = 0").select("key", F.lit("own").alias("text")))


@query("""
SELECT w AS name FROM (SELECT DISTINCT c_mktsegment AS w FROM customer WHERE c_custkey % 2 = 0 UNION SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT '1-URGENT'""")
def union_intersect_except_terms(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("name"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"))
    return a.union(b).distinct().exceptAll(spark.createDataFrame([("1-URGENT",)], "name string"))
