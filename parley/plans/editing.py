"""Queries that change tables. Conversations are transcripts and chats, suppliers speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import editing as e
from parley.plans import query, table


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("id"), "turn", F.col("role").alias("speaker"), "text")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of each odd turn: the first of both values, the second of the speaker only."""
    t = turns(spark, sf_dir).where("turn % 2 = 1")
    both = F.array(F.struct(F.lit(1).alias("seq"), F.lit("first").alias("speaker"), F.concat(F.lit(" new "), F.col("turn").cast("string")).alias("text")), F.struct(F.lit(2).alias("seq"), F.lit("second").alias("speaker"), F.lit(" ").alias("text")))
    return t.select("id", "turn", F.inline(both))


@query("SELECT conv_id AS id, turn, CASE WHEN turn % 2 = 1 THEN 'second' ELSE role END AS speaker, CASE WHEN turn % 2 = 1 THEN 'new ' || turn ELSE text END AS text FROM conversations")
def edit_batch_last_wins(spark, sf_dir):
    return e.edit_turns(turns(spark, sf_dir), edits(spark, sf_dir))


@query("""
SELECT id, revision, reason FROM (SELECT k AS id, 1 AS revision, CASE WHEN c.conv_id IS NULL THEN 'missing' WHEN k % 3 = 0 THEN 'conflict' WHEN k % 5 = 0 THEN 'turn' END AS reason
  FROM range(0, 200) t(k) LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON k = c.conv_id) WHERE reason IS NOT NULL""")
def edit_batches_refused(spark, sf_dir):
    t = turns(spark, sf_dir)
    records = t.select("id").distinct().withColumn("revision", F.when(F.col("id") % 3 == 0, 2).otherwise(1))
    batches = spark.range(200).select("id", F.lit(1).alias("revision"))
    wrong = records.where("id % 5 = 0").select("id", F.lit(99).cast("long").alias("turn"), F.lit(1).alias("seq"), F.lit("x").alias("speaker"), F.lit(None).cast("string").alias("text"))
    return e.refused_batches(batches, records, wrong, t)


@query("SELECT DISTINCT conv_id AS id, role AS cluster, CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN 'Ann B' WHEN role = 'user' THEN NULL ELSE 'old' END AS name, CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN 'confirmed' WHEN role = 'user' THEN 'unknown' ELSE 'auto' END AS status FROM conversations")
def voices_renamed(spark, sf_dir):
    known = turns(spark, sf_dir).select("id", F.col("speaker").alias("cluster")).distinct().withColumns({"name": F.lit("old"), "status": F.lit("auto")})
    name = F.when(F.col("id") % 2 == 0, F.lit(" Ann   B ")).otherwise(F.lit(" "))
    asked = known.where("cluster = 'user'").select("id", "cluster", F.inline(F.array(F.struct(F.lit(1).alias("seq"), F.lit("Zoe").alias("name")), F.struct(F.lit(2).alias("seq"), name.alias("name")))))
    return e.rename_voices(known, asked)


@query("SELECT DISTINCT conv_id AS id, role AS cluster, 'n' AS name FROM conversations")
def unused_assignments_dropped(spark, sf_dir):
    """Names of clusters that speak in no turn go."""
    all_turns = turns(spark, sf_dir)
    known = all_turns.select("id", F.col("speaker").alias("cluster")).distinct().withColumn("name", F.lit("n"))
    silent = known.select("id", F.concat("cluster", F.lit(" who left")).alias("cluster"), "name")
    return e.used_assignments(known.unionByName(silent), all_turns)


@query("""
SELECT s_suppkey AS speaker_id, s_name AS name, s_suppkey % 2 = 0 AS consent FROM supplier UNION ALL SELECT 100000 + n_nationkey + 1, n_name, true FROM nation""")
def speakers_added(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("speaker_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("consent"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("consent"), F.col("n_nationkey").alias("seq"))
    twice = nation.unionByName(nation.select(F.lower("name").alias("name"), "consent", (F.col("seq") + 100).alias("seq")))
    fresh = e.add_speakers(s, twice).join(s.select("speaker_id"), "speaker_id", "left_anti")
    last = s.agg(F.max("speaker_id").alias("m")).first()["m"]
    return s.unionByName(fresh.withColumn("speaker_id", F.col("speaker_id") - last + 100000))


@query("SELECT s_suppkey AS speaker_id, upper(n.s2) AS name FROM supplier JOIN (SELECT s_suppkey AS k2, s_name AS s2 FROM supplier) n ON n.k2 = s_suppkey + 1 WHERE s_suppkey % 10 = 0")
def speaker_rename_conflicts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("speaker_id"), F.col("s_name").alias("name"))
    wanted = s.where("speaker_id % 10 = 1").select((F.col("speaker_id") - 1).alias("speaker_id"), F.upper("name").alias("name"))
    return e.rename_conflicts(s, wanted.unionByName(s.where("speaker_id % 10 = 5").select("speaker_id", F.lit("Free name").alias("name"))))


@query("SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN user_id END AS speaker_id FROM events")
def speakers_forgotten(spark, sf_dir):
    v = table(spark, sf_dir, "events")
    feedback = v.select("event_id", F.col("user_id").alias("speaker_id"))
    people = feedback.select("speaker_id").distinct()
    return e.forget({"speakers": people, "embeddings": feedback, "feedback": feedback}, people.where("speaker_id % 4 = 0"))["feedback"]


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 100 OR vec_id % 2 = 0")
def vectors_added(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    broken = F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x: x * float("nan")).cast("array<float>"))
    return e.add_vectors(v.where("vec_id < 100"), v.where("vec_id >= 100").withColumn("embedding", broken)).select("vec_id", "label")


@query("""
SELECT conv_id AS id, count(*) + CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS messages, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'Why?' WHEN conv_id % 2 = 0 THEN NULL ELSE 'chat' END AS title FROM conversations GROUP BY conv_id""")
def chat_pairs_appended(spark, sf_dir):
    said = turns(spark, sf_dir).select("id", F.col("turn").cast("long").alias("seq"), F.col("speaker").alias("role"), "text")
    counts = said.groupBy("id").agg(F.count("*").alias("n"))
    chats = counts.select("id", F.when(F.col("id") % 2 == 1, F.lit("chat")).alias("title"), F.lit("2024-01-01").alias("updated"))
    pairs = counts.select("id", F.when(F.col("id") % 3 == 0, F.col("n")).otherwise(F.col("n") - 1).alias("expected"), F.lit("Why?").alias("question"), F.lit("So.").alias("answer"), F.lit("2024-01-02").alias("at"))
    new_chats, new_messages, _ = e.append_messages(chats, said, pairs)
    return new_messages.groupBy("id").agg(F.count("*").alias("messages")).join(new_chats.select("id", "title"), "id")


@query("SELECT conv_id AS id, conv_id % 4 = 0 AS pinned, max(turn) AS updated FROM conversations GROUP BY conv_id ORDER BY pinned DESC, updated DESC, id LIMIT 20")
def chats_order(spark, sf_dir):
    chats = turns(spark, sf_dir).groupBy("id").agg(F.max("turn").alias("updated")).withColumn("pinned", F.col("id") % 4 == 0)
    return e.chat_list(chats).limit(20).select("id", "pinned", "updated")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Rush' ELSE o_orderpriority END AS project FROM orders")
def project_relinked(spark, sf_dir):
    return e.relink(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project")), "1-URGENT", "Rush")


@query("SELECT o_orderkey AS id, nullif(o_orderpriority, '1-URGENT') AS project FROM orders")
def project_unlinked(spark, sf_dir):
    return e.unlink(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project")), "1-URGENT")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'role' ELSE 'old' END AS role, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 9 END AS org FROM nation UNION ALL SELECT r_name, 'role', NULL FROM region")
def people_upserted(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    current = n.select(F.col("n_name").alias("name"), F.lit("old").alias("role"), F.lit(9).alias("org"))
    changes = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit("role").alias("role"), F.col("n_regionkey").alias("org"))
    fresh = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("role").alias("role"), F.lit(None).cast("int").alias("org"))
    return e.merge_rows(current, changes.unionByName(fresh), ["name"])


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey % 2 = 1")
def inserted_if_absent(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return e.insert_absent(n.where("id % 2 = 0"), n.withColumn("name", F.lit("new")), ["id"])


@query("SELECT n_name AS project, CAST(n_nationkey AS VARCHAR) AS name, 1 AS seq FROM nation WHERE n_name <> 'FRANCE' UNION ALL SELECT 'FRANCE', r_name, r_regionkey FROM region")
def project_members_set(spark, sf_dir):
    members = table(spark, sf_dir, "nation").select(F.col("n_name").alias("project"), F.col("n_nationkey").cast("string").alias("name"), F.lit(1).alias("seq"))
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("seq"))
    return e.set_members(members, "FRANCE", region.unionByName(region.select(F.lower("name").alias("name"), (F.col("seq") + 10).alias("seq"))))


@query("""
SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'Head' || chr(10) || '## Transcript' || chr(10) || chr(10) || 'new' || chr(10) || chr(10) || '# End' || chr(10) ELSE 'Head' || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || 'new' || chr(10) END AS body FROM conversations GROUP BY conv_id""")
def transcripts_replaced(spark, sf_dir):
    ids = turns(spark, sf_dir).select("id").distinct()
    notes = ids.withColumn("body", F.when(F.col("id") % 2 == 0, F.lit("Head\n## Transcript\nold\n# End\n")).otherwise(F.lit("Head\n")))
    return e.replace_transcript(notes, ids.withColumn("transcript", F.lit("new")))


@query("SELECT conv_id AS id, turn AS body FROM (SELECT conv_id, CAST(max(turn) AS VARCHAR) AS turn FROM conversations GROUP BY 1) WHERE conv_id % 2 = 0")
def untouched_notes(spark, sf_dir):
    notes = turns(spark, sf_dir).groupBy("id").agg(F.max("turn").cast("string").alias("body"))
    hashes = notes.select("id", F.sha2(F.when(F.col("id") % 2 == 0, F.col("body")).otherwise(F.lit("edited")), 256).alias("sha"))
    return e.untouched_notes(notes, hashes)


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey >= 20")
def unknown_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return e.unknown(n, n.where("id < 20"), ["id"])


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'left' ELSE 'right' END AS side FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20")
def differing_sets(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return e.differing(n.where("id < 20"), n.where("id >= 5"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 1 AND n_nationkey < 10 THEN 'done' WHEN n_nationkey % 3 = 0 THEN 'new' WHEN n_nationkey % 3 = 1 THEN 'review' ELSE 'done' END AS state FROM nation")
def session_transitions(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    state = F.when(F.col("id") % 3 == 0, "new").when(F.col("id") % 3 == 1, "review").otherwise("done")
    return e.move("done", {"new": ("recording",), "review": ("done",)}, n.withColumn("state", state), n.where("id < 10"))


@query("SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS revision, conv_id % 2 = 0 AS notes_stale FROM conversations GROUP BY conv_id")
def revisions_bumped(spark, sf_dir):
    ids = turns(spark, sf_dir).select("id").distinct()
    return e.bump_revisions(ids.select("id", F.lit(1).alias("revision"), F.lit(False).alias("notes_stale")), ids.where("id % 2 = 0"))


@query("""
SELECT meeting, person AS name, n FROM (SELECT vec_id % 5 AS meeting, label AS person, count(*) AS n FROM embeddings WHERE label % 2 = 0 GROUP BY ALL)""")
def confirmed_voices_learned(spark, sf_dir):
    from parley.plans.voices import vectors

    rows = vectors(spark, sf_dir).select("meeting", F.col("vec_id").alias("cluster"), "embedding", F.lit(0.5).alias("seconds"), "person")
    review = rows.select("meeting", "cluster", F.when(F.col("person") % 2 == 0, F.col("person").cast("string")).alias("name"))
    return e.confirmed_voices(rows.drop("person"), review).select("meeting", F.col("name").cast("int").alias("name"), "n")
