"""Queries of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as x
from parley.functions.vectors import dot, norm
from parley.plans import query, table
from parley.sources.files import index_lines, resolve_links, transcripts


@query("""
SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' ELSE s // 3600 || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS length
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 60 ELSE event_id % 300 * 60 END AS s FROM events)""")
def format_timestamps(spark, sf_dir):
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 60).otherwise(F.col("event_id") % 300 * 60)
    return table(spark, sf_dir, "events").select("event_id", x.format_timestamp(s).alias("clock"), x.format_duration(s).alias("length"))


@query("""
SELECT conv_id, regexp_replace(regexp_replace(string_agg(trim(w), ' ' ORDER BY turn, k), '\\s+([,.;:!?%)\\]}])', '\\1', 'g'), '([(\\[{])\\s+', '\\1', 'g') AS text
FROM (SELECT conv_id, turn, unnest(string_split(replace(text, '.', ' . '), ' ')) AS w, generate_subscripts(string_split(replace(text, '.', ' . '), ' '), 1) AS k FROM conversations)
WHERE trim(w) <> '' GROUP BY conv_id""")
def join_words_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", F.posexplode(F.split(F.replace("text", F.lit("."), F.lit(" . ")), " ")).alias("k", "w"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("turn", "k", "w"))), lambda v: v["w"])
    return words.groupBy("conv_id").agg(x.join_words(told).alias("text"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_replace(p_type || ': #' || p_name || '?..', '[\\\\/:*?\"<>|#^\\[\\]]', '-', 'g')), '^\\.+|\\.+$', '', 'g'), '\\s+', ' ', 'g') AS name FROM part")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.safe_filename(F.concat("p_type", F.lit(": #"), "p_name", F.lit("?.."))).alias("name"))


@query("""
SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 20) AS slug, lower(regexp_replace(trim(p_name || ' & ' || p_brand), '[^\\p{L}\\p{N}_-]+', '-', 'g')) AS tag FROM part""")
def slugs_and_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.slug(F.concat("p_name", F.lit(" "), "p_type"), "-", 20).alias("slug"), x.tag(F.concat("p_name", F.lit(" & "), "p_brand")).alias("tag"))


@query("SELECT conv_id, turn, length(text) // 4 + 1 AS tokens, '[t' || turn || ' 00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || '] ' || role || ': ' || text AS line FROM conversations")
def transcript_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", x.estimate_tokens("text").alias("tokens"), x.transcript_line(F.concat(F.lit("t"), F.col("turn").cast("string")), F.col("turn"), F.col("role"), F.col("text")).alias("line"))


@query("SELECT c_custkey, upper(left(c_mktsegment, 1)) || 'C' AS initials, '[\"' || c_name || '\"]' AS label FROM customer")
def initials_and_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", x.initials(F.concat(F.lower("c_mktsegment"), F.lit(" van "), "c_name")).alias("initials"), F.concat(F.lit("["), x.json_text("c_name"), F.lit("]")).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 7 END AS reminder FROM orders")
def days_of_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 4 == 0, F.lit("not a date")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:59:00+06:00")))
    return o.select("o_orderkey", x.day_of(date).alias("day"), F.date_add(x.day_of(date), 7).alias("reminder"))


@query("SELECT conv_id, turn, 'title: ' || role AS header, 'Line ' || turn AS body, 'kept ' || turn AS section FROM conversations")
def note_parts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    note = F.concat(F.lit("---\ntitle: "), "role", F.lit("\n---\n\nLine "), F.col("turn").cast("string"))
    body = F.concat(F.lit("# Top\n## Summary\n_nothing yet_\nkept "), F.col("turn").cast("string"), F.lit("\n\n## Next\nother"))
    parts = c.select("conv_id", "turn", x.front_matter(note).alias("n"), x.section(body, "Summary").alias("section"))
    return parts.select("conv_id", "turn", F.trim("n.header").alias("header"), "n.body", "section")


@query("SELECT conv_id AS id, string_agg('**' || role || '** 00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || chr(10) || text || ' ^t' || turn, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def transcripts_rendered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return transcripts(c.select(F.col("conv_id").alias("id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("turn"), F.col("role").alias("label"), F.col("turn").alias("start"), "text"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'See [' || n_name || '](people/' || replace(n_name, ' ', '%20') || '.md) now' ELSE 'See the state now' END AS body FROM nation")
def wikilinks_resolved(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    bodies = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("See [["), "n_name", F.lit("]] now"))).otherwise(F.concat(F.lit("See [["), "n_name", F.lit("|the state]] now"))).alias("body"))
    return resolve_links(bodies, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("target"), F.concat(F.lit("people/"), "n_name", F.lit(".md")).alias("path")))


@query("SELECT r_name AS folder, string_agg('- [' || n_name || '](' || replace(r_name || '/' || n_name, ' ', '%20') || ')', chr(10) ORDER BY n_name) AS lines FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def bundle_index(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pages = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name").alias("path"), F.col("n_name").alias("title"))
    return index_lines(pages)


@query("SELECT vec_id, round(list_inner_product(e, e), 4) AS square, round(sqrt(list_inner_product(e, e)), 4) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vector_norms(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(dot("embedding", "embedding"), 4).alias("square"), F.round(norm("embedding"), 4).alias("norm"))
