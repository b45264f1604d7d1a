"""Quality queries. Neighbouring messages are compared as texts; segments with shifted borders as speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.operators import quality as q
from parley.plans import query, table
from parley.plans.timeline import SEGMENTS_SQL, segments

_PAIRS_SQL = """SELECT conv_id, turn, role, text AS reference,
  coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS hypothesis FROM conversations"""


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(replace(lower({text}), '’', ''''), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\s+'), lambda w: w <> '')"


_ERRORS_SQL = f"""WITH RECURSIVE p AS (SELECT conv_id, turn, role, {_words("reference")} AS r, {_words("hypothesis")} AS h FROM ({_PAIRS_SQL})),
d AS (SELECT conv_id, turn, 0 AS i, range(0, len(h) + 1) AS l FROM p UNION ALL
  SELECT d.conv_id, d.turn, i + 1, list_reduce(list_transform(range(0, len(h) + 1), lambda j: [CASE WHEN j = 0 THEN i + 1 ELSE least(l[j] + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1 END, l[j + 1] + 1) END]),
    lambda a, x: list_append(a, least(a[-1] + 1, x[1]))) FROM d JOIN p USING (conv_id, turn) WHERE i < len(r)),
e AS (SELECT p.conv_id, p.turn, p.role, CAST(l[len(h) + 1] AS BIGINT) AS errors, len(r) AS words FROM d JOIN p USING (conv_id, turn) WHERE i = len(r))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    after = F.coalesce(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return c.select("conv_id", "turn", "role", F.col("text").alias("reference"), after.alias("hypothesis"))


@query(_ERRORS_SQL + " SELECT conv_id, turn, errors, words, round(CASE WHEN words > 0 THEN errors / words WHEN errors > 0 THEN 1 ELSE 0 END, 4) AS wer FROM e")
def wer_pairs(spark, sf_dir):
    return q.word_errors(pairs(spark, sf_dir)).select("conv_id", "turn", "errors", "words", F.round("wer", 4).alias("wer"))


@query(_ERRORS_SQL + " SELECT role, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(words) AS BIGINT) AS words, CAST(count(*) * 60 AS DOUBLE) AS audio_s, CAST(count(*) * 2 AS DOUBLE) AS processing_s, round(sum(errors) / sum(words), 4) AS wer, CAST(30 AS DOUBLE) AS speed FROM e GROUP BY role")
def wer_corpus(spark, sf_dir):
    return q.error_totals(q.word_errors(pairs(spark, sf_dir)).withColumns({"audio_s": F.lit(60.0), "processing_s": F.lit(2.0)}), ["role"])


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference segments, in ten-minute frames, and hypotheses that begin later or carry another label."""
    s = segments(spark, sf_dir)
    reference = s.select("meeting", "speaker", F.floor(F.col("start") / 10).alias("start"), F.floor(F.col("end") / 10).alias("end"))
    label = F.when(F.col("seq") % 5 == 0, F.lit("other")).otherwise(F.col("speaker"))
    return reference, s.select("meeting", F.concat(F.lit("h-"), label).alias("speaker"), F.floor((F.col("start") + 30) / 10).alias("start"), F.floor((F.col("end") + 50) / 10).alias("end"))


_FRAMES_SQL = f"""WITH s AS ({SEGMENTS_SQL}), r AS (SELECT DISTINCT meeting, speaker, unnest(range(start // 10, "end" // 10)) AS f FROM s),
h AS (SELECT DISTINCT meeting, 'h-' || CASE WHEN seq % 5 = 0 THEN 'other' ELSE speaker END AS speaker, unnest(range((start + 30) // 10, ("end" + 50) // 10)) AS f FROM s),
m AS (SELECT DISTINCT meeting, unnest(range(greatest(0, x - 2), x + 2)) AS f FROM (SELECT meeting, unnest([start // 10, "end" // 10]) AS x FROM s)),
rs AS (SELECT * FROM r ANTI JOIN m USING (meeting, f)), hs AS (SELECT * FROM h ANTI JOIN m USING (meeting, f))"""


@query(_FRAMES_SQL + " SELECT meeting, rs.speaker AS reference, hs.speaker AS hypothesis, count(*) AS frames FROM rs JOIN hs USING (meeting, f) GROUP BY ALL")
def der_overlap_matrix(spark, sf_dir):
    from parley.operators.timeline import merge_spans

    reference, hypothesis = sides(spark, sf_dir)
    merged = [merge_spans(x, ["meeting", "speaker"], 0) for x in (reference, hypothesis)]
    return q.speaker_overlap(*merged, ["meeting"], q.collars(reference, ["meeting"], 2), 144)


_COUNTS_SQL = (
    _FRAMES_SQL
    + """, a AS (SELECT meeting, f, count(*) AS n FROM rs GROUP BY ALL), b AS (SELECT meeting, f, count(*) AS n FROM hs GROUP BY ALL),
x AS (SELECT coalesce(a.meeting, b.meeting) AS meeting, coalesce(a.n, 0) AS r, coalesce(b.n, 0) AS h FROM a FULL JOIN b ON a.meeting = b.meeting AND a.f = b.f)
SELECT meeting, CAST(sum(r) AS BIGINT) AS total, CAST(sum(greatest(0, r - h)) AS BIGINT) AS missed, CAST(sum(greatest(0, h - r)) AS BIGINT) AS false_alarm FROM x GROUP BY meeting"""
)


@query(_COUNTS_SQL)
def der_components(spark, sf_dir):
    reference, hypothesis = sides(spark, sf_dir)
    return q.speaker_errors(reference, hypothesis, ["meeting"], 2, 1, 144).select("meeting", "total", "missed", "false_alarm")


#: The best one-to-one mapping is found among all: each reference label in turn takes any free hypothesis label, or none.
_MAPPED_SQL = (
    _FRAMES_SQL.replace("WITH s", "WITH RECURSIVE s", 1)
    + """, a AS (SELECT meeting, f, count(*) AS n FROM rs GROUP BY ALL), b AS (SELECT meeting, f, count(*) AS n FROM hs GROUP BY ALL),
x AS (SELECT coalesce(a.meeting, b.meeting) AS meeting, coalesce(a.n, 0) AS r, coalesce(b.n, 0) AS h FROM a FULL JOIN b ON a.meeting = b.meeting AND a.f = b.f),
c AS (SELECT meeting, CAST(sum(r) AS BIGINT) AS total, CAST(sum(greatest(0, r - h)) AS BIGINT) AS missed, CAST(sum(greatest(0, h - r)) AS BIGINT) AS false_alarm, CAST(sum(least(r, h)) AS BIGINT) AS shared FROM x GROUP BY meeting),
o AS (SELECT meeting, rs.speaker AS reference, hs.speaker AS hypothesis, count(*) AS frames FROM rs JOIN hs USING (meeting, f) GROUP BY ALL),
n AS (SELECT meeting, reference, row_number() OVER (PARTITION BY meeting ORDER BY reference) AS i FROM (SELECT DISTINCT meeting, reference FROM o)),
g AS (SELECT n.meeting, n.i, o.hypothesis, o.frames FROM n JOIN o ON o.meeting = n.meeting AND o.reference = n.reference UNION ALL SELECT meeting, i, NULL, 0 FROM n),
w AS (SELECT meeting, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(0 AS BIGINT) AS got FROM c UNION ALL
  SELECT w.meeting, w.i + 1, CASE WHEN g.hypothesis IS NULL THEN used ELSE list_append(used, g.hypothesis) END, got + g.frames FROM w JOIN g ON g.meeting = w.meeting AND g.i = w.i + 1 WHERE g.hypothesis IS NULL OR NOT list_contains(used, g.hypothesis)),
mapped AS (SELECT meeting, max(got) AS correct FROM w GROUP BY meeting)
SELECT meeting, total, missed, false_alarm, shared - correct AS confusion, CASE WHEN total > 0 THEN (missed + false_alarm + shared - correct) / total ELSE 0.0 END AS der FROM c JOIN mapped USING (meeting)"""
)


@query(_MAPPED_SQL)
def der_frames(spark, sf_dir):
    reference, hypothesis = sides(spark, sf_dir)
    return q.speaker_errors(reference, hypothesis, ["meeting"], 2, 1, 144)


@query(f"SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(false_alarm) AS BIGINT) AS false_alarm FROM ({_COUNTS_SQL})")
def der_total(spark, sf_dir):
    reference, hypothesis = sides(spark, sf_dir)
    return q.speaker_error_total(q.speaker_errors(reference, hypothesis, ["meeting"], 2, 1, 144)).select("total", "missed", "false_alarm")
