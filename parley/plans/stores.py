"""Queries that write tables or files to the shared folder and read them again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import headers
from parley.operators.common import SHARE, spread
from parley.plans import query, table
from parley.sources import files, tables


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'renamed ' || o_orderpriority ELSE 'Order ' || o_orderkey END AS title, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS duration,
  'tasks of ' || o_orderkey AS _tasks FROM orders
UNION ALL SELECT -1 - c_custkey, c_name, c_acctbal, NULL FROM customer""")
def records_saved(spark, sf_dir):
    """Records stored, then some of them changed and others added; what a change leaves out stays."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    at = tables.fresh_folder(spark)
    key = F.col("o_orderkey").alias("id")
    tables.save_records(o.select(key, F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_totalprice").alias("duration"), F.concat(F.lit("tasks of "), "o_orderkey").alias("_tasks")), at)
    changed = o.where("o_orderstatus = 'F'").select(key, F.concat(F.lit("renamed "), "o_orderpriority").alias("title"), (F.col("o_totalprice") + 1).alias("duration"), F.lit(None).cast("string").alias("_tasks"))
    added = c.select((-1 - F.col("c_custkey")).alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("duration"), F.lit(None).cast("string").alias("_tasks"))
    tables.save_records(changed.unionByName(added), at)
    return tables.snapshot(spark, at)


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey = 7")
def record_by_id(spark, sf_dir):
    """One record, read from the part that holds it."""
    at = tables.fresh_folder(spark)
    tables.save_records(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), at)
    return tables.load_record(spark, at, 7)


@query("""
SELECT 'rec' || user_id AS file, round((epoch_us(ts) // 60000000) % 10000 + 0.125, 3) AS start, round((epoch_us(ts) // 60000000) % 10000 + 0.125 + event_id % 60 + 0.5, 3) AS "end", event_type AS speaker FROM events""")
def rttm_round_trip(spark, sf_dir):
    """Speaker spans written as RTTM lines and read again."""
    e = table(spark, sf_dir, "events")
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) % 10000 + 0.125
    spans = e.select(F.concat(F.lit("rec"), "user_id").alias("file"), start.alias("start"), (start + F.col("event_id") % 60 + 0.5).alias("end"), F.col("event_type").alias("speaker"))
    files.rttm_lines(spans).write.text(at := tables.fresh_folder(spark))
    return files.read_rttm(spark, at).select("file", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker")


@query("""
SELECT CAST(event_id % 50 AS DOUBLE) AS start, event_id % 50 + 0.5 + event_id % 3 AS "end", event_type AS speaker FROM events""")
def audacity_round_trip(spark, sf_dir):
    """Label lines, with lines of other kinds between them, written as text and read again."""
    e = table(spark, sf_dir, "events")
    start = F.col("event_id") % 50
    line = F.concat_ws("\t", start.cast("double").cast("string"), (start + 0.5 + F.col("event_id") % 3).cast("string"), "event_type")
    lines = e.select(F.explode(F.array(line, F.lit("\\\t100\t200"), F.lit("5.0\t4.0\tback"), F.lit("no label"))).alias("value"))
    lines.write.text(at := tables.fresh_folder(spark))
    return files.read_audacity(spark, at)


@query("""
SELECT c_custkey AS id, c_name AS title, o_orderkey AS turn, o_orderpriority AS text FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT -1, 'by hand', -1, 'one'""")
def records_as_json(spark, sf_dir):
    """Meeting records written as JSON, beside a file of one record and one that is none, and read again, one row for each turn."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    turn = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("S0").alias("speaker"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.col("o_orderpriority").alias("text"))
    turns = o.groupBy("o_custkey").agg(F.collect_list(turn).alias("turns"))
    records = c.join(turns, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), "turns")
    files.write_records(records, at := tables.fresh_folder(spark))
    for name, text in (("broken.json", '{"id": "1", '), ("note.json", '{\n "id": "-1",\n "title": "by hand",\n "turns": [{"id": "-1", "text": "one"}]\n}')):
        folder, path = tables._fs(spark, f"{at}/{name}")
        stream = folder.create(path, False)
        stream.write(text.encode())
        stream.close()
    read = files.read_records(spark, at)
    told = files.turns_of(read).join(read.select("id", "title"), "id")
    return told.select(F.col("id").cast("long").alias("id"), "title", F.col("turn").cast("long").alias("turn"), "text")


@query("SELECT o_custkey AS id FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def ids_repeated(spark, sf_dir):
    return files.repeated_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


def _tones(spark, sf_dir, wave):
    """event_id and content: a WAV file of a made tone for each event, of one of three lengths. A batch makes the longest once, others are its beginning."""
    files.short_batches(spark)
    e = table(spark, sf_dir, "events").select("event_id")
    count = e.count()  # a small file of short rows, from which much sound is made; parts of a large one are longer, as each costs its start
    e = spread(e, ["event_id"], count, min(SHARE, max(10_000, count // 96)))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def tone(length: pd.Series) -> pd.Series:
        longest = wave(np.arange(1, 2401)).astype(np.float32)
        return pd.Series([longest[: int(n)] if n == n else None for n in length], dtype=object)

    length = (800 * (1 + F.col("event_id") % 3)).cast("int")
    return e.select("event_id", files.encode_wav_at(8000)(tone(F.when(length < 0, 0).otherwise(length))).alias("content"))


@query("""
SELECT event_id AS id, 800 * (1 + event_id % 3) AS n, CAST(8000 AS INTEGER) AS rate FROM events""")
def sound_written_and_read(spark, sf_dir):
    """Tones written as WAV files and decoded again."""
    back = _tones(spark, sf_dir, lambda k: np.sin(k / 9.0)).withColumn("a", files.decode_wav("content"))
    return back.select(F.col("event_id").alias("id"), (F.octet_length("a.pcm") / 2).cast("long").alias("n"), "a.rate")


@query("""
SELECT event_id AS id, (800 * least(1 + event_id % 3, 2) - 400 * (event_id % 2)) AS n FROM events""")
def sound_sliced(spark, sf_dir):
    """The samples between two times of written tones, cut to what there is."""
    wav = _tones(spark, sf_dir, lambda k: np.cos(k / 7.0)).withColumn("a", files.decode_wav("content")).select("event_id", "a.*")
    part = files.slice_pcm((F.col("event_id") % 2) * 0.05, F.lit(0.2), "pcm", "rate")
    return wav.select(F.col("event_id").alias("id"), (F.octet_length(part) / 2).cast("long").alias("n"))


@query("""
SELECT n_nationkey AS id, 'title: ' || n_name AS header, '# ' || n_name || chr(10) || 'about [[' || r_name || ']]' AS body FROM nation JOIN region ON r_regionkey = n_regionkey""")
def notes_read(spark, sf_dir):
    """Notes with a header, each one file, read whole."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    at = tables.fresh_folder(spark)
    note = F.concat(F.lit("---\ntitle: "), "n_name", F.lit("\n---\n# "), "n_name", F.lit("\nabout [["), "r_name", F.lit("]]"))
    n.select("n_nationkey", note.alias("value")).write.partitionBy("n_nationkey").text(at)
    notes = files.read_notes(spark, at, suffix=".txt")
    return notes.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("id"), "header", F.regexp_replace("body", r"\s+$", "").alias("body"))


@query("""
SELECT n_nationkey + 1 AS line, '| ' || n_nationkey || ' | ' || n_name || ' |' AS value FROM nation UNION ALL SELECT -1, '| n_nationkey | n_name |' UNION ALL SELECT 0, '|---|---|'""")
def markdown_report(spark, sf_dir):
    """A report's rows as lines of a Markdown table."""
    lines = files.markdown_table(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], "n_nationkey")
    number = F.regexp_extract("value", r"^\| (\d+) ", 1)
    line = F.when(number != "", number.cast("int") + 1).when(F.col("value").startswith("|-"), 0).otherwise(-1)
    return lines.select(line.alias("line"), "value")


@query("""
SELECT o_orderkey AS id, o_orderstatus AS title FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'again' FROM orders WHERE o_orderkey % 9 = 0""")
def records_deleted(spark, sf_dir):
    """Records stored, a third of them deleted, and some of these stored again."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"))
    at = tables.fresh_folder(spark)
    tables.save_records(o, at)
    tables.delete_records(o.where("id % 3 = 0").select("id"), at)
    tables.save_records(o.where("id % 9 = 0").withColumn("title", F.lit("again")), at)
    return tables.snapshot(spark, at)


@query("""
SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT -c_custkey, c_acctbal FROM customer""")
def keyed_table_replaced(spark, sf_dir):
    """A table kept by key, replaced by some of its rows, then changed by key."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    at = tables.fresh_folder(spark)
    tables.upsert_by_key(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), at, ["id"])
    tables.replace_table(tables.snapshot(spark, at).where("id % 2 = 1"), at, ["id"])
    tables.upsert_by_key(c.select((-F.col("c_custkey")).alias("id"), F.col("c_acctbal").alias("price")), at, ["id"])
    return tables.snapshot(spark, at)


@query("""
WITH n AS (SELECT CASE WHEN n_name = 'NATION_3' THEN 'North' ELSE n_name END AS project, n_nationkey FROM nation WHERE n_name <> 'NATION_5'), o AS (SELECT c_custkey AS id, CASE WHEN n_name = 'NATION_3' THEN 'North' WHEN n_name <> 'NATION_5' THEN n_name END AS project,
  'about [[' || CASE WHEN n_name = 'NATION_3' THEN 'North' ELSE n_name END || '|it]] and [[' || n_name || 'x]]' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'project' AS kind, project, CAST(n_nationkey AS BIGINT) AS id, NULL AS text FROM n UNION ALL SELECT 'record', project, id, NULL FROM o UNION ALL SELECT 'note', NULL, id, text FROM o""")
def project_in_all_tables(spark, sf_dir):
    """A project renamed in four tables as one change, another one deleted from them."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    at = tables.fresh_folder(spark)
    with tables.Change(spark, at) as change:
        change.replace("projects", n.select(F.col("n_name").alias("name"), "n_nationkey"), ["name"])
        change.replace("members", n.select(F.col("n_name").alias("project"), "n_regionkey"), ["project"])
        change.upsert("records", c.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("project")), ["id"])
        change.upsert("notes", c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("about [["), "n_name", F.lit("|it]] and [["), "n_name", F.lit("x]]")).alias("text")), ["id"])
    tables.rename_project(spark, at, "NATION_3", "North")
    tables.delete_project(spark, at, "NATION_5")
    none = F.lit(None).cast("string")
    projects, records, notes = (tables.snapshot(spark, f"{at}#{x}") for x in ("projects", "records", "notes"))
    return (
        projects.select(F.lit("project").alias("kind"), F.col("name").alias("project"), F.col("n_nationkey").cast("long").alias("id"), none.alias("text"))
        .unionByName(records.select(F.lit("record").alias("kind"), "project", "id", none.alias("text")))
        .unionByName(notes.select(F.lit("note").alias("kind"), none.alias("project"), "id", "text"))
    )


@query("""
SELECT CAST(event_id % 50 AS DOUBLE) AS start, event_id % 50 + 1.5 AS "end", event_type AS speaker FROM events UNION ALL SELECT CAST(event_id % 50 AS DOUBLE), event_id % 50 + 0.5, 'user' || user_id FROM events""")
def labels_read(spark, sf_dir):
    """Speaker spans of label files of two kinds, told apart by their suffix."""
    e = table(spark, sf_dir, "events")
    start, at = (F.col("event_id") % 50).cast("double"), tables.fresh_folder(spark)
    files.rttm_lines(e.select(F.lit("r").alias("file"), start.alias("start"), (start + 1.5).alias("end"), F.col("event_type").alias("speaker"))).write.text(f"{at}.rttm")
    e.select(F.concat_ws("\t", start.cast("string"), (start + 0.5).cast("string"), F.concat(F.lit("user"), "user_id")).alias("value")).write.text(f"{at}.txt")
    return files.read_labels(spark, f"{at}.rttm").unionByName(files.read_labels(spark, f"{at}.txt"))


@query("""
SELECT event_id, user_id AS cluster, value AS score FROM events UNION ALL SELECT -event_id, user_id, NULL FROM events WHERE event_id % 3 = 0""")
def feedback_logged(spark, sf_dir):
    """What people said of guesses, added to a log in two turns."""
    e, at = table(spark, sf_dir, "events"), tables.fresh_folder(spark)
    tables.append(e.select("event_id", F.col("user_id").alias("cluster"), F.col("value").alias("score")), at)
    tables.append(e.where("event_id % 3 = 0").select((-F.col("event_id")).alias("event_id"), F.col("user_id").alias("cluster"), F.lit(None).cast("double").alias("score")), at)
    return tables.snapshot(spark, at)


@query("""
SELECT c_custkey AS id, c_name AS title, 'City ' || n_name AS city, n_nationkey AS rank, 'b: ' || r_name AS second, 3 AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey""")
def headers_nested(spark, sf_dir):
    """Headers with maps, lists and quotes, read to a VARIANT."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    text = F.concat(F.lit("title: "), "c_name", F.lit(" # the customer\nplace:\n  city: 'City "), "n_name", F.lit("'\n  rank: "), F.col("n_nationkey").cast("string"), F.lit('\nlist:\n- {a: 1}\n- "b: '), "r_name", F.lit('"\ntags: [x, "y, z", 3]'))
    v = rows.select(F.col("c_custkey").alias("id"), headers.header_map(text).alias("v"))
    return v.select("id", *(F.try_variant_get("v", path, kind).alias(name) for path, kind, name in (("$.title", "string", "title"), ("$.place.city", "string", "city"), ("$.place.rank", "int", "rank"), ("$.list[1]", "string", "second"), ("$.tags[2]", "int", "tags"))))


@query("""
SELECT o_orderkey AS id, concat_ws(chr(10), '---', 'title: Order ' || o_orderkey, 'note: ' || chr(39) || 'a: ' || o_orderpriority || chr(39), 'who:', '- c' || o_custkey, '- ' || chr(39) || o_custkey || chr(39), 'price:', '  status: ' || o_orderstatus, '  none: null', '---', '') AS header FROM orders""")
def headers_written(spark, sf_dir):
    """Headers written in the order of their keys, with quotes where a text would read as something else."""
    o = table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("title: Order "), key, F.lit('\nnote: "a: '), "o_orderpriority", F.lit('"\nwho: [c'), customer, F.lit(", '"), customer, F.lit("']\nprice: {status: "), "o_orderstatus", F.lit(", none: ~}\n"))
    return o.select(F.col("o_orderkey").alias("id"), headers.written_header(headers.header_json(text)).alias("header"))


@query("""
SELECT 'a' AS model, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'b', event_type, count(*) FROM events WHERE user_id % 2 = 0 GROUP BY ALL""")
def stages_cached(spark, sf_dir):
    """A stage's results under two sets of parameters, each made once and read twice."""
    e, at = table(spark, sf_dir, "events"), tables.fresh_folder(spark)
    made = []

    def stage(model):
        def make():
            made.append(model)
            return (e if model == "a" else e.where("user_id % 2 = 0")).groupBy("event_type").agg(F.count("*").alias("n"))

        return tables.cached(spark, at, "counts", {"model": model, "version": 1}, make).select(F.lit(model).alias("model"), "event_type", "n")

    found = [stage(m) for m in ("a", "b", "a", "b")]
    if made != ["a", "b"]:
        raise ValueError("a stage was made again")
    return found[2].unionByName(found[3])
