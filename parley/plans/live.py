"""Live queries: the batch twins of the streams. Events are revisions of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import early
from parley.operators import live as n
from parley.plans import query, table

_SEGMENTS = """SELECT user_id AS session, event_id % 7 AS id, event_id AS rev, event_type AS speaker_key, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || event_id END AS text, event_id % 4 = 0 AS partial FROM events"""

_LATEST = f"SELECT * FROM (SELECT * FROM ({_SEGMENTS}) QUALIFY row_number() OVER (PARTITION BY session, id ORDER BY rev DESC) = 1) WHERE text <> ''"


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").alias("session"), (F.col("event_id") % 7).alias("id"), F.col("event_id").alias("rev"), F.col("event_type").alias("speaker_key"), text.alias("text"), (F.col("event_id") % 4 == 0).alias("partial"))


@query(_LATEST)
def live_upsert_latest_rev(spark, sf_dir):
    return n.latest(revisions(spark, sf_dir), ["session", "id"])


@query(f"SELECT * FROM ({_LATEST}) WHERE rev > 5000")
def live_since_revision(spark, sf_dir):
    return n.since(n.latest(revisions(spark, sf_dir), ["session", "id"]), 5000)


@query(f"SELECT * FROM ({_LATEST}) WHERE id > 3 AND NOT partial")
def live_since_id(spark, sf_dir):
    return n.since_id(n.latest(revisions(spark, sf_dir), ["session", "id"]), 3)


@query(f"""
SELECT session, id, rev, CASE WHEN id = 2 THEN 'Ann' WHEN speaker_key = 'click' AND session % 2 = 0 THEN 'Bob' ELSE speaker_key END AS speaker, id = 2 OR (speaker_key = 'click' AND session % 2 = 0) AS corrected FROM ({_LATEST})""")
def live_overrides(spark, sf_dir):
    now = n.latest(revisions(spark, sf_dir), ["session", "id"])
    own = now.where("id = 2").select("session", "id", F.lit("Ann").alias("name"))
    names = now.where("session % 2 = 0").select("session").distinct().select("session", F.lit("click").alias("speaker_key"), F.lit("Bob").alias("name"))
    return n.apply_overrides(now, own, names).select("session", "id", "rev", "speaker", "corrected")


@query(f"""
SELECT o_orderkey AS edit, o_orderkey % 200 AS session, o_orderkey % 9 AS id, CASE WHEN l.rev IS NULL THEN 'missing' WHEN l.partial THEN 'unfinished' WHEN o_orderkey % 2 = 0 THEN 'changed' ELSE 'ok' END AS verdict
FROM orders LEFT JOIN ({_LATEST}) l ON l.session = o_orderkey % 200 AND l.id = o_orderkey % 9""")
def live_edit_checks(spark, sf_dir):
    edits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit"), (F.col("o_orderkey") % 200).alias("session"), (F.col("o_orderkey") % 9).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(-1)).cast("long").alias("rev"), F.lit("Ann").alias("name"))
    return n.check_edits(edits, n.latest(revisions(spark, sf_dir), ["session", "id"])).select("edit", "session", "id", "verdict")


@query("""
WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM
  (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = n.sessions(e, ["user_id"], "30 minutes")
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@query()
def speech_utterances(spark, sf_dir):
    """Each document's bytes as a recording's samples: a deterministic stand-in for sound."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording"), F.lit(0).alias("seq"), F.col("text").cast("binary").alias("pcm"))
    return n.utterances(d)


@query()
def known_or_new_speakers(spark, sf_dir):
    """The stated queries as voices, four to a recording, held against all other vectors."""
    from parley.operators.voices import similarities
    from parley.plans.voices import asked, vectors

    rows = vectors(spark, sf_dir)
    voices = asked(rows).withColumn("meeting", F.floor(F.col("vec_id") / 400))
    # People as text, as they stand beside 'Speaker n'.
    scores = similarities(voices.withColumn("query", F.col("vec_id")), rows.withColumn("person", F.col("person").cast("string")), apart="vec_id").withColumnRenamed("query", "vec_id")
    return n.known_or_new(voices, scores.join(voices.select("vec_id", "meeting"), "vec_id"), ["meeting"], 0.2, 0.25)


# ---------------------------------------------------------------- early rows, letting out less

_IN_ORDER = "SELECT user_id, event_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events"

_TOLD = f"""
WITH RECURSIVE e AS ({_IN_ORDER}),
w AS (SELECT user_id, k, moment, moment AS start, moment AS told, 1 AS n, false AS partial FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, moment, CASE WHEN fresh THEN moment ELSE start END, CASE WHEN fresh OR moment - told >= 10800000000 THEN moment ELSE told END, CASE WHEN fresh THEN 1 ELSE n + 1 END, NOT fresh AND moment - told >= 10800000000
  FROM (SELECT e.user_id, e.k, e.moment, w.start, w.told, w.n, e.moment - w.moment >= 43200000000 AS fresh FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)),
f AS (SELECT user_id, start, max(moment) AS "end", max(n) AS n, row_number() OVER (PARTITION BY user_id ORDER BY start) AS id FROM w GROUP BY user_id, start HAVING max(n) > 1),
r AS (SELECT user_id, id, start, "end", CAST(n AS BIGINT) AS n, false AS partial FROM f
  UNION ALL SELECT w.user_id, f.id, w.start, w.moment, CAST(w.n AS BIGINT), true FROM w JOIN f ON w.user_id = f.user_id AND w.start = f.start WHERE w.partial)"""


@query(f"{_TOLD} SELECT * FROM r")
def early_and_final_rows(spark, sf_dir):
    """Sessions of users with pauses under half a day: told each three hours of growth under an id, which the final row keeps."""
    return early.early_sessions(table(spark, sf_dir, "events"), ["user_id"], "12 hours", "3 hours")


@query(f"""{_TOLD} SELECT user_id, id, start, "end", n, partial FROM r WHERE NOT partial""")
def early_rows_replaced(spark, sf_dir):
    """What a reader who replaces rows by id has in the end."""
    return early.newest(early.early_sessions(table(spark, sf_dir, "events"), ["user_id"], "12 hours", "3 hours"), ["user_id"])


@query(f"""
WITH RECURSIVE e AS ({_IN_ORDER}),
w AS (SELECT user_id, k, moment AS last, NULL::BIGINT AS pending, 0 AS skipped, NULL::BIGINT AS flush_at, NULL::BIGINT AS flush_item, 0 AS flush_skipped, moment AS own_at, event_id AS own_item FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, CASE WHEN own THEN moment ELSE last1 END, CASE WHEN own THEN NULL ELSE event_id END, CASE WHEN own OR flush OR pending IS NULL THEN 0 ELSE skipped + 1 END,
    CASE WHEN flush THEN last1 END, CASE WHEN flush THEN pending END, CASE WHEN flush THEN skipped ELSE 0 END, CASE WHEN own THEN moment END, CASE WHEN own THEN event_id END
  FROM (SELECT *, moment >= last1 + 43200000000 AS own FROM (SELECT *, CASE WHEN flush THEN last + 43200000000 ELSE last END AS last1 FROM
    (SELECT e.user_id, e.k, e.moment, e.event_id, w.last, w.pending, w.skipped, w.pending IS NOT NULL AND e.moment >= w.last + 43200000000 AS flush FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)))),
z AS (SELECT user_id, last + 43200000000 AS moment, pending AS item, skipped FROM w WHERE pending IS NOT NULL QUALIFY k = (SELECT max(k) FROM e WHERE e.user_id = w.user_id))
SELECT user_id, flush_at AS "at", flush_item AS item, CAST(flush_skipped AS BIGINT) AS skipped FROM w WHERE flush_at IS NOT NULL
UNION ALL SELECT user_id, own_at, own_item, 0 FROM w WHERE own_at IS NOT NULL UNION ALL SELECT * FROM z""".replace("QUALIFY k =", "AND k ="))
def newest_once_an_interval(spark, sf_dir):
    """Of a user's events at most one each half a day, the newest that waits."""
    return early.conflated(table(spark, sf_dir, "events"), ["user_id"], "12 hours")


@query(f"""
WITH RECURSIVE e AS ({_IN_ORDER}),
w AS (SELECT user_id, k, moment, event_id, moment + 72000000000 AS free, true AS passed, 0 AS told, 0 AS skipped FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, moment, event_id, CASE WHEN pass THEN greatest(moment, free) + 72000000000 ELSE free END, pass, CASE WHEN pass THEN skipped ELSE 0 END, CASE WHEN pass THEN 0 ELSE skipped + 1 END
  FROM (SELECT e.user_id, e.k, e.moment, e.event_id, w.free, w.skipped, e.event_id % 5 = 0 OR e.moment >= w.free AS pass FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
SELECT user_id, moment AS "at", event_id AS item, CAST(told AS BIGINT) AS skipped FROM w WHERE passed""")
def early_rows_shed(spark, sf_dir):
    """Of a user's events those that find a worker free which takes twenty hours for each, and every fifth."""
    e = table(spark, sf_dir, "events").withColumn("final", F.col("event_id") % 5 == 0)
    return early.shed(e, ["user_id"], "20 hours", "final")


@query("""
SELECT doc_id AS recording, CASE WHEN doc_id % 3 = 0 THEN 'cancel' ELSE 'finish' END AS ended, coalesce(octet_length(encode(text)), 0) // 2 AS samples FROM documents""")
def recordings_ended(spark, sf_dir):
    """Each document's bytes as sound in two pieces and a control row that finishes or cancels it, through the detector of early rows:
    cancelled recordings have no final row after the control row, and whatever it tells lies within the samples."""
    d = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    length = F.octet_length(raw)
    half = F.floor(length / 4).cast("int") * 2
    pieces = d.select(F.col("doc_id").alias("recording"), length.alias("bytes"), F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.substring(raw, F.lit(1), half).alias("pcm"), F.lit(None).cast("string").alias("control")),
        F.struct(F.lit(1).alias("seq"), F.substring(raw, half + 1, length).alias("pcm"), F.when(F.col("doc_id") % 3 == 0, early.CANCEL).otherwise(early.FINISH).alias("control")),
    )).alias("p")).select("recording", "bytes", "p.*")
    told = early.early_utterances(pieces)
    wrong = told.join(pieces.where("seq = 1").select("recording", "bytes"), "recording").where(F.col("end") * 32000 > F.col("bytes") + 960).select("recording").distinct()
    return pieces.where("seq = 1").join(wrong, "recording", "left_anti").select("recording", F.when(F.col("control") == early.CANCEL, "cancel").otherwise("finish").alias("ended"), F.floor(F.col("bytes") / 2).alias("samples"))
