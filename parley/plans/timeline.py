"""Queries over timed rows. Events stand for words, users for recordings; times are whole minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import timeline as t
from parley.plans import query, table

KEYS = ["meeting"]

#: Events as words, segments and marks in DuckDB.
WORDS_SQL = """SELECT user_id AS meeting, event_id AS seq, epoch_us(ts) // 60000000 AS start, epoch_us(ts) // 60000000 + 1 + event_id % 240 AS "end",
  event_type AS text, CASE WHEN event_id % 7 <> 0 THEN event_type END AS label FROM events"""
SEGMENTS_SQL = """SELECT user_id AS meeting, event_id AS seq, epoch_us(ts) // 60000000 AS start, epoch_us(ts) // 60000000 + 60 + event_id % 600 AS "end",
  event_type AS speaker FROM events"""


def minutes(column: str = "ts") -> Column:
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 60)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("meeting"), F.col("event_id").alias("seq"), minutes().alias("start"), (minutes() + 1 + F.col("event_id") % 240).alias("end"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("label")
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("meeting"), F.col("event_id").alias("seq"), minutes().alias("start"), (minutes() + 60 + F.col("event_id") % 600).alias("end"), F.col("event_type").alias("speaker"))


@query(f"""
WITH w AS ({WORDS_SQL}), s AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY start, seq) AS rn FROM ({SEGMENTS_SQL})),
i AS (SELECT w.meeting, w.seq, any_value(w.start) AS start, any_value(w."end") AS "end", count(s.seq) AS idx
  FROM w LEFT JOIN s ON s.meeting = w.meeting AND s.start <= w."end" GROUP BY w.meeting, w.seq),
c AS (SELECT i.meeting, i.seq, s.speaker, s.rn, least(s."end", i."end") - greatest(s.start, i.start) AS shared,
  greatest(0, i.start - s."end", s.start - i."end") AS gap FROM i JOIN s ON s.meeting = i.meeting AND s.rn <= i.idx),
b AS (SELECT meeting, seq, list(speaker ORDER BY shared DESC, rn DESC) FILTER (shared > 0) AS best,
  list(speaker ORDER BY gap, rn DESC) FILTER (gap < 120) AS near, coalesce(min(gap) FILTER (gap < 120), 120) AS least FROM c GROUP BY ALL)
SELECT i.meeting, i.seq, CASE WHEN len(b.best) > 0 THEN b.best[1] WHEN n.start - i."end" < coalesce(b.least, 120) THEN n.speaker ELSE b.near[1] END AS label
FROM i LEFT JOIN b USING (meeting, seq) LEFT JOIN s n ON n.meeting = i.meeting AND n.rn = i.idx + 1""")
def assign_by_overlap(spark, sf_dir):
    return t.assign_speakers(words(spark, sf_dir).drop("label"), segments(spark, sf_dir), KEYS, 120).select("meeting", "seq", "label")


@query(f"""
WITH w AS ({WORDS_SQL}), s AS ({SEGMENTS_SQL}), p AS (SELECT w.meeting, w.seq, w.label, s.speaker, s.seq AS c,
  least(s."end", w."end") - greatest(s.start, w.start) AS shared FROM w JOIN s ON w.meeting = s.meeting AND w.start < s."end" AND s.start < w."end")
SELECT w.meeting, w.seq, coalesce(any_value(b.speaker), any_value(w.label)) AS label FROM w LEFT JOIN
  (SELECT meeting, seq, list(speaker ORDER BY shared DESC, c)[1] AS speaker FROM p GROUP BY ALL) b USING (meeting, seq) GROUP BY ALL""")
def corrections_by_overlap(spark, sf_dir):
    return t.relabel(words(spark, sf_dir), segments(spark, sf_dir), KEYS, 720).select("meeting", "seq", "label")


@query(f"""
WITH p AS (SELECT meeting, seq, start + 7 AS at FROM ({WORDS_SQL})), m AS (SELECT meeting, seq, start AS at, speaker AS label FROM ({SEGMENTS_SQL})),
r AS (SELECT p.meeting, p.seq, m.label, row_number() OVER (PARTITION BY p.meeting, p.seq
  ORDER BY abs(m.at - p.at), m.at, CASE WHEN m.at <= p.at THEN -m.seq ELSE m.seq END) AS rn FROM p JOIN m ON p.meeting = m.meeting)
SELECT p.meeting, p.seq, p.at, r.label AS near FROM p LEFT JOIN r ON r.meeting = p.meeting AND r.seq = p.seq AND rn = 1""")
def nearest_interval_asof(spark, sf_dir):
    points = words(spark, sf_dir).select("meeting", "seq", (F.col("start") + 7).alias("at"))
    marks = segments(spark, sf_dir).select("meeting", "seq", F.col("start").alias("at"), F.col("speaker").alias("label"))
    return t.nearest_mark(points, marks, KEYS)


_FILLED = f"""SELECT meeting, seq, start, "end", text, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY meeting ORDER BY seq),
  first_value(label IGNORE NULLS) OVER (PARTITION BY meeting ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS label FROM ({WORDS_SQL})"""


@query(f"SELECT meeting, seq, label FROM ({_FILLED})")
def forward_fill_labels(spark, sf_dir):
    return t.fill_labels(words(spark, sf_dir), KEYS).select("meeting", "seq", "label")


_RUNS = f"""SELECT *, sum(CASE WHEN label IS DISTINCT FROM prev OR first THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY seq) AS run FROM
  (SELECT *, lag(label) OVER (PARTITION BY meeting ORDER BY seq) AS prev, lag(seq) OVER (PARTITION BY meeting ORDER BY seq) IS NULL AS first FROM ({_FILLED}))"""


@query(f"""
WITH r AS ({_RUNS}), g AS (SELECT meeting, run, any_value(label) AS label, arg_max("end", seq) - arg_min(start, seq) AS length FROM r GROUP BY ALL),
n AS (SELECT *, lag(label) OVER o AS b, lead(label) OVER o AS a FROM g WINDOW o AS (PARTITION BY meeting ORDER BY run))
SELECT r.meeting, r.seq, CASE WHEN n.a = n.b AND n.length <= 600 THEN n.b ELSE n.label END AS label FROM r JOIN n USING (meeting, run)""")
def smooth_islands_one_pass(spark, sf_dir):
    return t.smooth_once(t.fill_labels(words(spark, sf_dir), KEYS), KEYS, 600).select("meeting", "seq", "label")


@query(f"""
WITH RECURSIVE r AS ({_RUNS}), g AS (SELECT meeting, run, any_value(label) AS label, arg_min(start, seq) AS s, arg_max("end", seq) AS e FROM r GROUP BY ALL),
q AS (SELECT meeting, list({{'label': label, 's': s, 'e': e, 'c': 1}} ORDER BY run) AS runs FROM g GROUP BY meeting),
w AS (SELECT meeting, runs, runs[1:0] AS done, runs[1] AS head, 2 AS pos FROM q
  UNION ALL SELECT meeting, runs, CASE WHEN hit THEN done[1:len(done) - 1] ELSE list_append(done, head) END,
    CASE WHEN hit THEN {{'label': done[-1].label, 's': done[-1].s, 'e': runs[pos].e, 'c': done[-1].c + head.c + runs[pos].c}} ELSE runs[pos] END, pos + 1
  FROM (SELECT *, len(done) > 0 AND pos <= len(runs) AND done[-1].label = runs[pos].label AND runs[pos].label <> head.label AND head.e - head.s <= 600 AS hit FROM w WHERE head IS NOT NULL)),
x AS (SELECT meeting, unnest(done) AS d, generate_subscripts(done, 1) AS k FROM w WHERE head IS NULL),
y AS (SELECT meeting, d.label AS label, d.c AS c, sum(d.c) OVER (PARTITION BY meeting ORDER BY k) AS high FROM x)
SELECT r.meeting, r.seq, y.label FROM r JOIN y ON r.meeting = y.meeting AND r.run > y.high - y.c AND r.run <= y.high""")
def smooth_islands(spark, sf_dir):
    return t.smooth(t.fill_labels(words(spark, sf_dir), KEYS), KEYS, 600).select("meeting", "seq", "label")


@query(f"""
WITH f AS (SELECT *, label IS DISTINCT FROM lag(label) OVER o OR start - lag("end") OVER o > 600 OR lag(seq) OVER o IS NULL AS new FROM ({_FILLED}) WINDOW o AS (PARTITION BY meeting ORDER BY seq)),
g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY seq) AS stretch FROM f)
SELECT meeting, CAST(stretch AS BIGINT) AS stretch, any_value(label) AS speaker, arg_min(start, seq) AS start, arg_max("end", seq) AS "end", count(*) AS words FROM g GROUP BY meeting, stretch""")
def turns_gaps_islands(spark, sf_dir):
    return t.turn_spans(t.fill_labels(words(spark, sf_dir), KEYS), KEYS, 600)


@query()
def aligned_turns(spark, sf_dir):
    return t.align(words(spark, sf_dir).drop("label"), segments(spark, sf_dir), KEYS)


def _merged(spans: str, keys: str, gap: float) -> str:
    return f"""SELECT {keys}, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > {gap} THEN 1 ELSE 0 END)
      OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end"
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({spans}))) GROUP BY {keys}, island"""


@query(_merged(SEGMENTS_SQL, "meeting", 30))
def merge_spans(spark, sf_dir):
    return t.merge_spans(segments(spark, sf_dir), KEYS, 30)


@query(_merged(SEGMENTS_SQL, "meeting, speaker", 0))
def join_touching_spans(spark, sf_dir):
    return t.merge_spans(segments(spark, sf_dir), ["meeting", "speaker"], 0)


_GAPS = f"""
WITH r AS ({_merged(SEGMENTS_SQL, "meeting", 30)}), w AS ({WORDS_SQL}),
p AS (SELECT r.meeting, r.start, r."end", w.start AS ws, w."end" AS we FROM r JOIN w ON r.meeting = w.meeting AND w.start < r."end" AND r.start < w."end"),
g AS (SELECT meeting, greatest(start, coalesce(max(we) OVER (PARTITION BY meeting, start, "end" ORDER BY ws, we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)) AS a, ws AS b FROM p
  UNION ALL SELECT r.meeting, greatest(r.start, coalesce(max(we), r.start)), r."end" FROM r LEFT JOIN p USING (meeting, start, "end") GROUP BY r.meeting, r.start, r."end")"""


@query(_GAPS + _merged('SELECT meeting, a AS start, b AS "end" FROM g WHERE b - a >= 60', "meeting", 0))
def missing_spans(spark, sf_dir):
    regions = t.merge_spans(segments(spark, sf_dir), KEYS, 30)
    return t.missing_spans(words(spark, sf_dir), regions, KEYS, 720, 60)


@query(f"""
SELECT meeting, seq, start, "end" FROM ({WORDS_SQL}) w WHERE NOT EXISTS (SELECT 1 FROM ({SEGMENTS_SQL}) s
  WHERE s.meeting = w.meeting AND least(s."end", w."end") - greatest(s.start, w.start) > 5)""")
def range_anti_overlap(spark, sf_dir):
    found = words(spark, sf_dir).select("meeting", "seq", "start", "end")
    return t.without_overlap(found, segments(spark, sf_dir), KEYS, "seq", 720, 5)


@query(f"""
WITH j AS ({_merged(SEGMENTS_SQL, "meeting, speaker", 0)}), e AS (SELECT DISTINCT meeting, unnest([start, "end"]) AS a FROM j),
x AS (SELECT meeting, a, lead(a) OVER (PARTITION BY meeting ORDER BY a) AS b FROM e),
o AS (SELECT x.meeting, a, b, list(speaker ORDER BY start, speaker)[1] AS label FROM x JOIN j ON x.meeting = j.meeting AND start <= a AND "end" >= b WHERE b IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN label = pl AND pb >= a THEN 0 ELSE 1 END) OVER (PARTITION BY meeting ORDER BY a) AS run FROM
  (SELECT *, lag(label) OVER w AS pl, lag(b) OVER w AS pb FROM o WINDOW w AS (PARTITION BY meeting ORDER BY a)))
SELECT meeting, any_value(label) AS label, min(a) AS start, max(b) AS "end" FROM r GROUP BY meeting, run""")
def exclusive_spans(spark, sf_dir):
    return t.exclusive(segments(spark, sf_dir).withColumnRenamed("speaker", "label"), KEYS, 720, 0)


@query(f"""
SELECT meeting, any_value(label) AS label, arg_min(start, seq) AS start, arg_max("end", seq) AS "end", count(*) AS words FROM ({_RUNS}) GROUP BY meeting, run""")
def run_length_labels(spark, sf_dir):
    return t.run_spans(t.fill_labels(words(spark, sf_dir), KEYS), KEYS).drop("run")


@query("""
WITH f AS (SELECT DISTINCT user_id AS meeting, epoch_us(ts) // 3600000000 AS seq, FIRST_VALUE(event_type) OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY event_id) AS label FROM events),
r AS (SELECT *, sum(CASE WHEN label = lag_l AND seq = lag_s + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting ORDER BY seq) AS run FROM
  (SELECT *, lag(label) OVER w AS lag_l, lag(seq) OVER w AS lag_s FROM f WINDOW w AS (PARTITION BY meeting ORDER BY seq)))
SELECT meeting, any_value(label) AS label, min(seq) AS first, max(seq) + 1 AS "end" FROM r GROUP BY meeting, run""")
def run_length_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting"), F.floor(minutes() / 60).alias("seq"), "event_id", "event_type")
    frames = e.groupBy("meeting", "seq").agg(F.min_by("event_type", "event_id").alias("label"))
    return t.encode_frames(frames, KEYS)


@query(f"""
SELECT meeting, speaker AS label, row_number() OVER (PARTITION BY meeting ORDER BY min(start), speaker) - 1 AS number FROM ({SEGMENTS_SQL}) GROUP BY meeting, speaker""")
def first_appearance_numbering(spark, sf_dir):
    return t.first_appearance(segments(spark, sf_dir).withColumnRenamed("speaker", "label"), KEYS).withColumn("number", F.col("number").cast("long"))


@query("""
WITH k AS (SELECT user_id AS meeting, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN ' ' || event_type ELSE event_type END AS text, CAST(event_id % 10 AS DOUBLE) / 16 AS confidence FROM events),
g AS (SELECT *, sum(CASE WHEN starts_with(text, ' ') OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY seq) AS word FROM (SELECT *, lag(seq) OVER (PARTITION BY meeting ORDER BY seq) AS p FROM k))
SELECT meeting, CAST(word AS BIGINT) AS word, trim(string_agg(text, '' ORDER BY seq)) AS text, min(seq) AS start, max(seq) AS "end", min(confidence) AS confidence FROM g GROUP BY meeting, word""")
def tokens_to_words(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tokens = e.select(F.col("user_id").alias("meeting"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type")).alias("text"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), (F.col("event_id") % 10 / 16).alias("confidence"))
    return t.words_of_tokens(tokens, KEYS)


@query("""
WITH s AS (SELECT conv_id AS meeting, turn AS seq, CASE WHEN turn % 3 <> 2 THEN role END AS speaker, turn % 3 = 2 AS partial, text FROM conversations),
j AS (SELECT *, partial AND speaker IS NULL AS joins FROM s),
l AS (SELECT *, last_value(CASE WHEN NOT joins THEN {'s': speaker} END IGNORE NULLS) OVER (PARTITION BY meeting ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)['s'] AS lead,
  lag(seq) OVER (PARTITION BY meeting ORDER BY seq) AS p FROM j),
g AS (SELECT *, sum(CASE WHEN (joins AND p IS NOT NULL) OR coalesce(speaker = lead, false) THEN 0 ELSE 1 END) OVER (PARTITION BY meeting ORDER BY seq) AS paragraph FROM l)
SELECT meeting, CAST(paragraph AS BIGINT) AS paragraph, first(speaker ORDER BY seq) AS speaker, string_agg(text, ' ' ORDER BY seq) AS text FROM g GROUP BY meeting, paragraph""")
def speaker_paragraphs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    live = c.select(F.col("conv_id").alias("meeting"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("speaker"), (F.col("turn") % 3 == 2).alias("partial"), "text")
    return t.paragraphs(live, KEYS)


@query(f"""
WITH s AS (SELECT meeting, seq, start, "end", greatest(1, ("end" - start) // 90) AS n FROM ({SEGMENTS_SQL}))
SELECT meeting, seq, w AS "window", start + w * (("end" - start) / n) AS w_start, start + (w + 1) * (("end" - start) / n) AS w_end FROM (SELECT *, unnest(range(0, n)) AS w FROM s)""")
def segment_windows(spark, sf_dir):
    return t.sub_windows(segments(spark, sf_dir), 90).select("meeting", "seq", F.col("window").cast("long").alias("window"), "w_start", "w_end")


@query(f"""
SELECT meeting, seq, start // 1440 AS chunk, start - start // 1440 * 1440 AS in_start, "end" - start // 1440 * 1440 AS in_end FROM ({WORDS_SQL})""")
def fixed_chunks(spark, sf_dir):
    return t.fixed_chunks(words(spark, sf_dir), 1440).select("meeting", "seq", "chunk", "in_start", "in_end")


@query("""
WITH f AS (SELECT user_id AS meeting, epoch_us(ts) // 7200000000 AS frame, bool_or(event_type = 'click') AS solo FROM events GROUP BY ALL)
SELECT meeting, frame // 2 AS "column" FROM f GROUP BY meeting, frame // 2 HAVING 2 * count(*) FILTER (solo) >= 2""")
def column_majority(spark, sf_dir):
    frames = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("meeting"), F.floor(minutes() / 120).alias("frame")).agg(F.bool_or(F.col("event_type") == "click").alias("solo"))
    return t.column_majority(frames, KEYS, 2)


@query(f"""
WITH w AS (SELECT *, start // 720 * 720 AS a, start // 720 * 720 + 660 AS b FROM ({WORDS_SQL}))
SELECT meeting, seq, greatest(start, a) AS start, least("end", b) AS "end" FROM w WHERE (start + "end") / 2 BETWEEN a AND b""")
def words_inside_spans(spark, sf_dir):
    low = F.floor(F.col("start") / 720) * 720
    return t.inside(words(spark, sf_dir).withColumns({"span_start": low, "span_end": low + 660})).select("meeting", "seq", "start", "end")


@query(f"""
WITH l AS ({SEGMENTS_SQL}), p AS (SELECT x.meeting, x.speaker AS turn_label, l.seq % 3 AS lane, least(x."end", l."end") - greatest(x.start, l.start) AS s
  FROM l JOIN (SELECT meeting, speaker, min(start) AS start, min("end") AS "end" FROM l GROUP BY ALL) x ON x.meeting = l.meeting),
g AS (SELECT meeting, turn_label, lane, min(greatest(0, -s)) AS gap, sum(greatest(0, s)) AS shared FROM p GROUP BY ALL)
SELECT meeting, turn_label, list(lane ORDER BY gap, shared DESC, lane)[1] AS lane FROM g GROUP BY ALL""")
def nearest_lane(spark, sf_dir):
    s = segments(spark, sf_dir)
    turns = s.groupBy("meeting", F.col("speaker").alias("turn_label")).agg(F.min("start").alias("start"), F.min("end").alias("end"))
    return t.nearest_lane(s.select("meeting", (F.col("seq") % 3).alias("lane"), "start", "end"), turns, KEYS)
