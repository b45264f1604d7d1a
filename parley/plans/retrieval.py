"""Queries over note text. Documents are the passages, their sources the meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import STOP_WORDS, cite_number_cleanup, cited_numbers, estimate_tokens, terms
from parley.operators import retrieval as r
from parley.plans import query, table

#: Invented words, as the passages have them.
QUESTION = "What of the orantions and hehely, or rewh for thatin inoran?"

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms_sql(text: str) -> str:
    return f"""list_transform(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({_STOP}) AND length(w) > 1),
      lambda w: CASE WHEN suffix(w, 's') AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END)"""


_CHUNKS_SQL = f"SELECT doc_id AS chunk, source AS meeting, source || ' ' || coalesce(lang, '') AS title, {_terms_sql('text')} AS t, length(text) + 80 AS cost FROM documents"

_SCORED_SQL = f"""
SELECT chunk, meeting, cost, coalesce(s, 0) + 2 * len(list_intersect(list_distinct({_terms_sql("title")}), {_terms_sql(f"'{QUESTION}'")})) AS score FROM c LEFT JOIN
  (SELECT chunk, sum(CASE WHEN n > 0 THEN ln(1 + (total - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / average)) ELSE 0 END ORDER BY w) AS s FROM
    (SELECT c.chunk, q.w, len(c.t) AS len, len(list_filter(c.t, lambda x: x = q.w)) AS n, count(*) FILTER (list_contains(c.t, q.w)) OVER (PARTITION BY q.w) AS df,
      count(*) OVER (PARTITION BY q.w) AS total, avg(len(c.t)) OVER (PARTITION BY q.w) AS average FROM c CROSS JOIN q) GROUP BY chunk) USING (chunk)"""

_WITH = f"WITH RECURSIVE c AS ({_CHUNKS_SQL}), q AS (SELECT DISTINCT unnest({_terms_sql(f'''{QUESTION!r}''')}) AS w), s AS ({_SCORED_SQL})"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk"), F.col("source").alias("meeting"), F.concat("source", F.lit(" "), F.coalesce("lang", F.lit(""))).alias("title"), "text")


@query(f"SELECT doc_id, array_to_string({_terms_sql('text')}, ' ') AS terms FROM documents")
def tokenize_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(terms("text"), " ").alias("terms"))


@query(f"SELECT w AS term, count(*) AS chunks FROM (SELECT DISTINCT doc_id, unnest({_terms_sql('text')}) AS w FROM documents) GROUP BY 1")
def term_document_frequency(spark, sf_dir):
    return r.document_frequencies(chunks(spark, sf_dir))


@query(f"SELECT doc_id AS chunk, w AS term, count(*) AS n FROM (SELECT doc_id, unnest({_terms_sql('text')}) AS w FROM documents) GROUP BY 1, 2")
def term_counts(spark, sf_dir):
    return r.term_counts(chunks(spark, sf_dir))


@query(f"SELECT count(*) AS chunks, round(avg(len({_terms_sql('text')})), 6) AS average FROM documents")
def corpus_figures(spark, sf_dir):
    return r.corpus_size(chunks(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query(_WITH + " SELECT chunk, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, chunk LIMIT 12")
def bm25_top_k(spark, sf_dir):
    return r.ranked(r.bm25(chunks(spark, sf_dir), QUESTION), 12).select("chunk", F.round("score", 4).alias("score"))


_TIERS = """, f AS (SELECT chunk FROM (SELECT meeting, list(chunk ORDER BY score DESC, chunk)[1] AS chunk, max(score) AS best FROM s WHERE score > 0 GROUP BY 1) ORDER BY best DESC, chunk LIMIT 6),
d AS (SELECT chunk, meeting, cost, score, CASE WHEN chunk IN (SELECT chunk FROM f) THEN 0 ELSE 1 END AS tier FROM s WHERE score > 0)"""


@query(_WITH + _TIERS + " SELECT chunk, meeting, CAST(tier AS INTEGER) AS tier, round(score, 4) AS score FROM d")
def bm25_diversified(spark, sf_dir):
    return r.diversified(r.bm25(chunks(spark, sf_dir), QUESTION)).select("chunk", "meeting", "tier", F.round("score", 4).alias("score"))


@query(
    _WITH
    + _TIERS
    + """, o AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, chunk) AS n FROM d),
p AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, 0 AS k, CAST(NULL AS BIGINT) AS chunk UNION ALL
  SELECT o.n, CASE WHEN p.used + o.cost <= 9000 AND p.k < 12 THEN p.used + o.cost ELSE p.used END, CASE WHEN p.used + o.cost <= 9000 AND p.k < 12 THEN p.k + 1 ELSE p.k END,
    CASE WHEN p.used + o.cost <= 9000 AND p.k < 12 THEN o.chunk END FROM p JOIN o ON o.n = p.n + 1)
SELECT chunk, k AS number FROM p WHERE chunk IS NOT NULL"""
)
def bm25_budgeted_selection(spark, sf_dir):
    found = r.diversified(r.bm25(chunks(spark, sf_dir), QUESTION)).withColumn("cost", F.col("characters") + r.OVERHEAD)
    return r.select_within(found, 9000).select("chunk", "number")


@query()
def note_passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return r.passages(d.select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


@query("""
WITH RECURSIVE l AS (SELECT conv_id, turn, length(text) // 4 + 1 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
b AS (SELECT conv_id, turn, n, size AS used, 0 AS bin FROM l WHERE n = 1 UNION ALL
  SELECT l.conv_id, l.turn, l.n, CASE WHEN b.used + l.size > 60 THEN l.size ELSE b.used + l.size END, b.bin + CASE WHEN b.used + l.size > 60 THEN 1 ELSE 0 END FROM b JOIN l ON l.conv_id = b.conv_id AND l.n = b.n + 1)
SELECT conv_id AS id, turn AS seq, bin FROM b""")
def pack_lines_into_bins(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), estimate_tokens("text").alias("size"))
    return r.pack_lines(c, ["id"], 60)


@query("""
SELECT conv_id AS id, turn AS seq FROM (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE n <= 4 AND used <= 400""")
def recent_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "text")
    return r.recent_messages(c, ["id"], 400, 4).select("id", "seq")


@query("""
SELECT conv_id AS id, turn, 'See [2] and' || CASE WHEN turn % 5 BETWEEN 1 AND 3 THEN ' [' || (turn % 5) || ']' ELSE ' ' END || '.' AS answer,
  CASE WHEN turn % 5 = 1 THEN '1|2' WHEN turn % 5 = 3 THEN '2|3' ELSE '2' END AS numbers FROM conversations""")
def citation_cleanup(spark, sf_dir):
    answer = F.concat(F.lit("See [2] and ["), (F.col("turn") % 5).cast("string"), F.lit("]."))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", answer.alias("raw"))
    clean = c.withColumn("answer", cite_number_cleanup("raw", F.array(*(F.lit(k) for k in (1, 2, 3)))))
    return clean.select("id", "turn", "answer", F.array_join(F.transform(cited_numbers("answer"), lambda n: n.cast("string")), "|").alias("numbers"))


@query("SELECT conv_id AS id, turn AS number, text FROM conversations WHERE turn IN (1, 3)")
def cited_sources(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sources = c.select(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("number"), "text")
    return r.cited(c.select(F.col("conv_id").alias("id")).distinct().withColumn("answer", F.lit("Yes [3], no [1], again [3].")), sources).withColumn("number", F.col("number").cast("long"))


@query(_WITH + _TIERS + " SELECT (SELECT count(DISTINCT meeting) FROM c) AS searched_meetings, count(DISTINCT meeting) AS included_meetings, count(*) < (SELECT count(*) FROM c) AS partial FROM d WHERE tier = 0")
def retrieval_coverage(spark, sf_dir):
    all_of = chunks(spark, sf_dir)
    return r.coverage(r.diversified(r.bm25(all_of, QUESTION)).where("tier = 0"), all_of)
