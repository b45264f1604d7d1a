"""Queries over voice vectors. Labels stand for people; every fifth vector is of one meeting, and runs of vectors are one recording's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.vectors import rounded
from parley.operators import voices as v
from parley.plans import query, table

VECTORS_SQL = "SELECT vec_id, CAST(vec_id % 5 AS BIGINT) AS meeting, vec_id // 50 AS recording, label AS person, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"

_MEANS_SQL = f"""SELECT meeting, person, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS e FROM
  (SELECT meeting, person, list(x ORDER BY k) AS m FROM (SELECT meeting, person, k, avg(x) AS x FROM
    (SELECT meeting, person, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM ({VECTORS_SQL})) GROUP BY ALL) GROUP BY ALL)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 5).alias("meeting"), F.floor(F.col("vec_id") / 50).alias("recording"), F.col("label").alias("person"), "embedding")


def asked(rows: DataFrame) -> DataFrame:
    """The stated queries: vectors whose number can be divided by 100."""
    return rows.where("vec_id % 100 = 0")


_PAIR_SCORES = f"""SELECT vec_id AS query, person, list_sum(s[1:3]) / len(s[1:3]) AS score FROM (SELECT q.vec_id, l.person, list(list_inner_product(q.e, l.e) ORDER BY list_inner_product(q.e, l.e) DESC) AS s
  FROM ({VECTORS_SQL}) q JOIN ({VECTORS_SQL}) l ON q.vec_id % 100 = 0 AND l.vec_id <> q.vec_id GROUP BY ALL)"""


@query(f"SELECT query, person, round(score, 4) AS score FROM ({_PAIR_SCORES})")
def pairwise_similarity_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = v.similarities(asked(rows).withColumn("query", F.col("vec_id")), rows, apart="vec_id")
    return found.select("query", "person", F.round("score", 4).alias("score"))


_GENUINE = f"""SELECT a.vec_id AS query, b.vec_id AS other, a.person = b.person AS genuine, list_inner_product(a.e, b.e) AS score FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b
  ON a.vec_id % 100 = 0 AND a.meeting <> b.meeting AND NOT (b.vec_id % 100 = 0 AND a.vec_id > b.vec_id)"""


@query(f"SELECT query, other, genuine, round(score, 4) AS score FROM ({_GENUINE})")
def genuine_impostor_pairs(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return v.verification_scores(asked(rows), rows).select("query", "other", "genuine", F.round("score", 4).alias("score"))


@query(f"SELECT meeting, person, list_transform(e, lambda x: round(x, 4)) AS mean FROM ({_MEANS_SQL})")
def centroids(spark, sf_dir):
    return v.mean_vectors(vectors(spark, sf_dir), ["meeting", "person"]).select("meeting", "person", F.transform("mean", lambda x: rounded(x, 4)).alias("mean"))


@query(f"""
SELECT person, list(round(m / n, 4) ORDER BY k) AS mean FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY person)) AS n FROM
  (SELECT person, k, sum(x * w) / sum(w) AS m FROM (SELECT person, 1 + vec_id % 4 AS w, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM ({VECTORS_SQL})) GROUP BY ALL)) GROUP BY person""")
def centroids_weighted(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("seconds", 1 + F.col("vec_id") % 4)
    return v.mean_vectors(rows, ["person"], weight="seconds").select("person", F.transform("mean", lambda x: rounded(x, 4)).alias("mean"))


@query(f"""
WITH m AS ({_MEANS_SQL}), s AS (SELECT a.meeting, a.person AS truth, b.person, list(list_inner_product(a.e, b.e) ORDER BY list_inner_product(a.e, b.e) DESC)[1:3] AS l FROM m a JOIN m b ON a.meeting <> b.meeting GROUP BY ALL),
w AS (SELECT meeting, truth, list(person ORDER BY list_sum(l) / len(l) DESC, person)[1] AS best FROM s GROUP BY ALL)
SELECT truth, count(*) FILTER (best = truth) AS correct, count(*) AS total FROM w GROUP BY truth""")
def leave_one_out_identify(spark, sf_dir):
    return v.left_out_accuracy(vectors(spark, sf_dir))


@query(f"""
WITH p AS (SELECT round(score, 6) AS score, genuine FROM ({_GENUINE})), n AS (SELECT count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS i, avg(score) FILTER (genuine) AS gm, avg(score) FILTER (NOT genuine) AS im FROM p),
t AS (SELECT DISTINCT score FROM p), r AS (SELECT t.score, 1 - (SELECT count(*) FROM p WHERE NOT genuine AND p.score < t.score) / greatest(i, 1) AS far, (SELECT count(*) FROM p WHERE genuine AND p.score < t.score) / greatest(g, 1) AS frr FROM t, n),
e AS (SELECT * FROM r ORDER BY abs(far - frr), score LIMIT 1), f AS (SELECT * FROM r WHERE far <= 0.01 ORDER BY score LIMIT 1)
SELECT round((e.far + e.frr) / 2, 6) AS eer, e.score AS eer_threshold, f.score AS threshold_far, round(f.frr, 6) AS frr_at_far, round(gm, 6) AS genuine_mean, round(im, 6) AS impostor_mean, g AS n_genuine, i AS n_impostor FROM e, f, n""")
def verification_eer(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return v.verification_figures(v.verification_counts(asked(rows), rows, 6)).withColumns({c: F.round(c, 6) for c in ("eer", "frr_at_far", "genuine_mean", "impostor_mean")})


def _voices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries as voices, four to a meeting, and what they score against every person's other vectors."""
    rows = vectors(spark, sf_dir)
    number = F.floor(F.col("vec_id") / 100)
    voices = asked(rows).select(F.floor(number / 4).alias("meeting"), (number % 4).alias("cluster"), (number % 4).alias("seq"), "vec_id", "embedding")
    found = v.similarities(voices.select(F.col("vec_id").alias("query"), "vec_id", "embedding"), rows, apart="vec_id")
    scores = found.join(voices.select(F.col("vec_id").alias("query"), "meeting", "cluster"), "query").select("meeting", "cluster", "person", "score")
    return voices.select("meeting", "cluster", "seq"), scores


@query(f"""
WITH RECURSIVE s AS (SELECT vec_id // 400 AS meeting, vec_id // 100 % 4 AS cluster, person, list_sum(l[1:3]) / len(l[1:3]) AS score FROM (SELECT q.vec_id, p.person, list(list_inner_product(q.e, p.e) ORDER BY list_inner_product(q.e, p.e) DESC) AS l
  FROM ({VECTORS_SQL}) q JOIN ({VECTORS_SQL}) p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id GROUP BY ALL)),
o AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY score DESC, cluster, person) AS n FROM s WHERE score >= 0.15),
w AS (SELECT m.meeting, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS cs, CAST([] AS BIGINT[]) AS ps, CAST(NULL AS BIGINT) AS cluster, CAST(NULL AS BIGINT) AS person, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT meeting FROM s) m UNION ALL
  SELECT o.meeting, o.n, CASE WHEN ok THEN list_append(w.cs, o.cluster) ELSE w.cs END, CASE WHEN ok THEN list_append(w.ps, CAST(o.person AS BIGINT)) ELSE w.ps END, CASE WHEN ok THEN o.cluster END, CASE WHEN ok THEN o.person END, CASE WHEN ok THEN o.score END
  FROM w JOIN (SELECT * FROM o) o ON o.meeting = w.meeting AND o.n = w.n + 1, LATERAL (SELECT NOT list_contains(w.cs, o.cluster) AND NOT list_contains(w.ps, CAST(o.person AS BIGINT)) AS ok)),
a AS (SELECT b.meeting, b.cluster, w.person, round(coalesce(w.score, b.best), 4) AS score, CASE WHEN w.score >= 0.2 THEN 'auto' WHEN w.score IS NOT NULL THEN 'suggested' ELSE 'unknown' END AS status
  FROM (SELECT meeting, cluster, max(score) AS best FROM s GROUP BY ALL) b LEFT JOIN w ON w.meeting = b.meeting AND w.cluster = b.cluster)
SELECT meeting, cluster, CAST(person AS INTEGER) AS person, score, status, CASE WHEN status <> 'auto' THEN 'Unknown speaker ' || CAST(sum(CASE WHEN status <> 'auto' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY cluster) AS BIGINT) END AS unknown_label FROM a""")
def greedy_assignment(spark, sf_dir):
    voices, scores = _voices(spark, sf_dir)
    return v.match_voices(voices, scores, 0.2, 0.15).select("meeting", "cluster", "person", "score", "status", "unknown_label")


@query(f"""
SELECT person, vec_id, round(list_sum(list_transform(list(r), lambda x: x)) / count(*), 4) AS redundancy FROM (SELECT a.person, a.vec_id, list_inner_product(a.e, b.e) AS r FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b ON a.person = b.person AND a.vec_id <> b.vec_id) GROUP BY ALL""")
def redundancy(spark, sf_dir):
    return v.redundancy(vectors(spark, sf_dir), ["person"]).select("person", "vec_id", F.round("redundancy", 4).alias("redundancy"))


@query(f"""
WITH RECURSIVE p AS (SELECT recording, list(vec_id ORDER BY vec_id) AS ids, list(e ORDER BY vec_id) AS es FROM ({VECTORS_SQL}) GROUP BY recording),
m AS (SELECT recording, ids, list_transform(es, lambda a: list_transform(es, lambda b: list_inner_product(a, b))) AS s FROM p),
w AS (SELECT recording, ids, s, range(1, len(ids) + 1) AS alive FROM m
  UNION ALL SELECT recording, ids, s, list_filter(alive, lambda i: i <> worst) FROM (SELECT *, list_min(list_transform(alive[1:len(alive) - 1], lambda i: {{'x': -list_sum(list_transform(alive, lambda j: CASE WHEN i = j THEN 0 ELSE s[i][j] END)), 'i': i}})).i AS worst
    FROM w WHERE len(alive) > {v.KEEP})),
f AS (SELECT * FROM w WHERE len(alive) <= {v.KEEP})
SELECT recording, unnest(ids) AS vec_id, unnest(list_transform(range(1, len(ids) + 1), lambda k: list_contains(alive, k))) AS kept FROM f""")
def prune_most_redundant(spark, sf_dir):
    return v.prune(vectors(spark, sf_dir), ["recording"])


@query()
def average_linkage_labels(spark, sf_dir):
    return v.average_linkage(vectors(spark, sf_dir), ["recording"], 0.1)


@query()
def online_leader_clustering(spark, sf_dir):
    return v.online_speakers(vectors(spark, sf_dir), ["recording"], 0.25)


@query()
def split_voices(spark, sf_dir):
    """Windows that are asked for are named by the person they are nearest to, if near enough."""
    rows = vectors(spark, sf_dir)
    near = v.best_person(v.similarities(asked(rows).withColumn("query", F.col("vec_id")), rows, apart="vec_id")).where("score >= 0.2").select(F.col("query").alias("vec_id"), F.col("person").alias("known"))
    named = rows.join(near, "vec_id", "left")
    windows = named.select("recording", F.col("vec_id").alias("seq"), F.floor(F.col("vec_id") / 10).alias("segment"), F.lit(1.5).alias("seconds"), "embedding", "known")
    return v.split_voices(windows, ["recording"], 0.2, 3.0)


@query("""
WITH s AS (SELECT conv_id AS meeting, role AS speaker, turn AS start, turn + length(text) AS "end" FROM conversations),
k AS (SELECT *, count(*) FILTER ("end" - start >= 150) OVER (PARTITION BY meeting, speaker) > 0 AS enough FROM s)
SELECT meeting, speaker, start, least("end", start + 200) AS "end", CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY meeting, speaker ORDER BY "end" - start DESC, start) AS rank FROM k WHERE NOT enough OR "end" - start >= 150) WHERE rank <= 2""")
def chosen_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    spans = c.select(F.col("conv_id").alias("meeting"), F.col("role").alias("speaker"), F.col("turn").alias("start"), (F.col("turn") + F.length("text")).alias("end"))
    return v.chosen_segments(spans, ["meeting", "speaker"], 2, 150, 200)


@query("""
SELECT o_orderkey AS id, piece, piece * 8 AS start, least(s, (piece + 1) * 8) AS "end" FROM (SELECT o_orderkey, s, unnest(range(0, greatest(1, (s + 7) // 8))) AS piece FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 50 AS s FROM orders))
WHERE least(s, (piece + 1) * 8) - piece * 8 >= 2""")
def enrolment_pieces(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice").cast("long") % 50).alias("seconds"))
    found = v.enrolment_pieces(o)
    return found.select("id", *(F.col(c).cast("long").alias(c) for c in ("piece", "start", "end")))


@query("SELECT user_id, event_type, count(value) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS deviation FROM events GROUP BY ALL")
def window_moments_pooling(spark, sf_dir):
    return v.moments(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value").withColumns({c: F.round(c, 8) for c in ("mean", "deviation")})


@query("""
WITH t AS (SELECT conv_id AS meeting, role AS label, sum(length(text)) AS seconds FROM conversations GROUP BY ALL)
SELECT meeting, label, CAST(seconds AS BIGINT) AS seconds, share FROM (SELECT *, round(seconds / sum(seconds) OVER (PARTITION BY meeting), 4) AS share, row_number() OVER (PARTITION BY meeting ORDER BY seconds DESC, label) AS n FROM t) WHERE n <= 2""")
def solo_share(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting"), F.col("role").alias("label"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))
    return v.solo_share(c, ["meeting"], 2)


@query("""
WITH t AS (SELECT user_id AS meeting, event_type AS slot, sum(CASE WHEN event_id % 16 >= 8 THEN (event_id % 16) / 16.0 ELSE 0 END) AS activity FROM events GROUP BY ALL)
SELECT meeting, slot, CAST(activity AS DOUBLE) AS activity FROM (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY activity DESC, slot) AS n FROM t) WHERE n <= 3 AND activity > 0""")
def active_slots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting"), F.col("event_type").alias("slot"), (F.col("event_id") % 16 / 16).alias("activity"))
    return v.active_slots(e, ["meeting"], 3)


@query(f"""
WITH s AS (SELECT q.vec_id, q.person AS truth, l.person, list(list_inner_product(q.e, l.e) ORDER BY list_inner_product(q.e, l.e) DESC)[1:3] AS l FROM ({VECTORS_SQL}) q JOIN ({VECTORS_SQL}) l ON q.vec_id % 100 = 0 AND q.meeting <> l.meeting GROUP BY ALL),
b AS (SELECT vec_id, truth, list(person ORDER BY list_sum(l) / len(l) DESC, person)[1] AS best, bool_or(person = truth) AS judged FROM s GROUP BY ALL)
SELECT truth, count(*) FILTER (best = truth) AS correct, count(*) AS total FROM b WHERE judged GROUP BY truth""")
def leave_one_out_segments(spark, sf_dir):
    """The stated queries as segments, named by what other meetings hold."""
    rows = vectors(spark, sf_dir)
    return v.left_out_segments(asked(rows), rows)


@query("""
WITH f AS (SELECT user_id % 7 AS recording, 'S' || user_id % 3 AS cluster, event_type AS voice, min(event_id) AS s FROM events GROUP BY ALL UNION ALL SELECT r, 'S1_2', 'own', -1 FROM range(7) t(r)),
r AS (SELECT *, row_number() OVER (PARTITION BY recording, cluster ORDER BY s) AS k FROM f)
SELECT recording, cluster, voice, CASE WHEN k = 1 THEN cluster WHEN cluster = 'S1' THEN 'S1_' || (k + 1) ELSE cluster || '_' || k END AS id FROM r""")
def split_voice_ids(spark, sf_dir):
    """Names of the voices that clusters were split into, past a cluster that has one of these names already."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("recording"), F.concat(F.lit("S"), F.col("user_id") % 3).alias("cluster"), F.col("event_type").alias("voice"), F.col("event_id").alias("start"))
    taken = e.select("recording").distinct().select("recording", F.lit("S1_2").alias("cluster"), F.lit("own").alias("voice"), F.lit(-1).cast("long").alias("start"))
    return v.split_ids(e.unionByName(taken), ["recording"])
