"""Queries over notes' context, links and titles. Orders stand for meetings, their lines for voices, messages for words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import documents as d
from parley.plans import query, table
from parley.plans.timeline import SEGMENTS_SQL, segments


@query("""
WITH v AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 3 <> 0 THEN 'Voice ' || l_suppkey END AS name, 'Unknown speaker ' || l_linenumber AS label FROM lineitem),
p AS (SELECT id, list_sort(list(DISTINCT name)) AS people FROM (SELECT id, name FROM v WHERE name IS NOT NULL UNION ALL SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY id),
u AS (SELECT id, list_sort(list(DISTINCT label)) AS unknown FROM v WHERE name IS NULL GROUP BY id),
m AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%B %-d, %Y') AS date_long, CAST(floor(o_totalprice) AS BIGINT) % 20000 AS s FROM orders)
SELECT m.id, date_long, CASE WHEN s < 60 THEN s || 's' WHEN round_even(s / 60, 0) < 60 THEN CAST(round_even(s / 60, 0) AS BIGINT) || 'm'
  ELSE CAST(round_even(s / 60, 0) AS BIGINT) // 60 || 'h' || lpad(CAST(CAST(round_even(s / 60, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 'm' END AS length,
  greatest(1, CAST(round_even(s / 60, 0) AS BIGINT)) AS minutes, array_to_string(coalesce(people, []), ', ') AS people, array_to_string(coalesce(unknown, []), ', ') AS unknown
FROM m LEFT JOIN p USING (id) LEFT JOIN u USING (id)""")
def meeting_contexts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    meetings = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_orderdate").alias("date"), (F.floor("o_totalprice") % 20000).alias("duration"), F.lit(None).cast("string").alias("project"))
    voices = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("Voice "), "l_suppkey")).alias("name"), F.concat(F.lit("Unknown speaker "), "l_linenumber").alias("display_name")
    )
    attendees = o.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"))
    found = d.meeting_context(meetings, voices, attendees)
    return found.select("id", "date_long", "length", "minutes", *(F.array_join(c, ", ").alias(c) for c in ("people", "unknown")))


@query("""
WITH w AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN '  ' || lower(c_name) || ' ' WHEN 2 THEN 'Nobody ' || l_linenumber END AS owner
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey)
SELECT w.id, line, owner, CASE WHEN owner IS NULL THEN '' WHEN a.c_name IS NOT NULL THEN '[[' || a.c_name || ']]' WHEN k.s_name IS NOT NULL THEN '[[' || k.s_name || ']]' ELSE owner END AS link
FROM w LEFT JOIN (SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey) a ON a.o_orderkey = w.id AND lower(a.c_name) = lower(trim(w.owner))
LEFT JOIN supplier k ON lower(k.s_name) = lower(trim(w.owner))""")
def owners_linked(spark, sf_dir):
    l, o, s, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier", "customer"))
    held = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")
    line = F.col("l_linenumber") % 4
    owner = F.when(line == 0, F.upper("s_name")).when(line == 1, F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))).when(line == 2, F.concat(F.lit("Nobody "), "l_linenumber"))
    owners = l.join(held, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), owner.alias("owner"))
    attendees = held.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("seq"))
    known = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return d.owner_links(owners, known, attendees, attendees)


@query("""
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'Speaker-attributed meeting transcript.' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS description,
  CASE WHEN turn % 2 = 0 THEN 'file:///audio/' || conv_id || '%20a.wav' ELSE 'Recorded audio for meeting ' || conv_id END AS resource, 'draft' AS status, sha256(text) AS audio_sha256 FROM conversations""")
def provenance(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.lit("2026-10-09").alias("date"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("summary"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/audio/"), "conv_id", F.lit(" a.wav"))).alias("audio"), F.sha2("text", 256).alias("sha"))
    found = rows.withColumn("k", d.knowledge("conv_id", "date", "summary", "audio", "sha"))
    return found.select("conv_id", "turn", "k.description", F.col("k.sources")[0]["resource"].alias("resource"), "k.status", "k.audio_sha256")


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M') || '-' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS id FROM events")
def meeting_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", d.meeting_id("ts", F.sha2(F.col("event_id").cast("string"), 256)).alias("id"))


@query("""
SELECT conv_id, turn, array_to_string(CASE WHEN turn % 3 = 2 THEN list_append(b, 'more') WHEN turn % 3 = 1 AND conv_id % 5 = 0 THEN list_prepend('other', b[2:]) ELSE a END, ' ') AS words
FROM (SELECT conv_id, turn, string_split(text, ' ') AS a, list_transform(string_split(text, ' '), lambda w: lower(regexp_replace(w, '[^\\p{L}\\p{N}_'']', '', 'g'))) AS b FROM conversations)""")
def punctuation_restored(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("a", F.split("text", " "))
    bare = F.transform("a", lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_']", "")))
    other = F.concat(F.array(F.lit("other")), F.slice(bare, 2, 1_000_000))
    aligned = F.when(F.col("turn") % 3 == 2, F.concat(bare, F.array(F.lit("more")))).when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 5 == 0), other).otherwise(bare)
    return c.select("conv_id", "turn", F.array_join(d.restored_words("a", aligned), " ").alias("words"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with and without header, title and heading."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    head = F.when(kind == 0, F.concat(F.lit('---\ntitle: "old"\nproject: "[[Alpha]]"\n---\n'))).when(kind == 1, F.lit("---\nproject: x\n---\n")).otherwise(F.lit(""))
    first = F.when(kind == 2, F.lit("# Old heading\n")).when(kind == 0, F.lit("\n# Old heading\n\n")).otherwise(F.lit("Begins at once\n# Not the first\n"))
    note = F.concat(head, first, F.lit("See [[Alpha]], [[Alpha|it]], [[Alphabet]] and [[Projects/Alpha/Alpha.md|page]] of "), "p_name", F.lit("\n"))
    return p.select("p_partkey", note.alias("note"), F.concat("p_brand", F.lit(' $1 "x"')).alias("title"))


_NOTES_SQL = """SELECT p_partkey, p_partkey % 4 AS k, p_brand || ' $1 "x"' AS title, p_brand || ' $1 \\"x\\"' AS quoted,
  'See [[Alpha]], [[Alpha|it]], [[Alphabet]] and [[Projects/Alpha/Alpha.md|page]] of ' || p_name || chr(10) AS rest, chr(10) AS n FROM part"""


@query(f"""
SELECT p_partkey, CASE k WHEN 0 THEN '---' || n || 'title: "' || quoted || '"' || n || 'project: "[[Alpha]]"' || n || '---' || n || n || '# ' || title || n || n
  WHEN 1 THEN '---' || n || 'title: "' || quoted || '"' || n || 'project: x' || n || '---' || n || 'Begins at once' || n || '# Not the first' || n
  WHEN 2 THEN '---' || n || 'title: "' || quoted || '"' || n || '---' || n || '# ' || title || n
  ELSE '---' || n || 'title: "' || quoted || '"' || n || '---' || n || 'Begins at once' || n || '# Not the first' || n END || rest AS note FROM ({_NOTES_SQL})""")
def notes_retitled(spark, sf_dir):
    return _notes(spark, sf_dir).select("p_partkey", d.retitled("note", "title").alias("note"))


@query(f"""
SELECT p_partkey, CASE k WHEN 0 THEN '---' || n || 'title: "old"' || n || 'project: "[[B+ (1)]]"' || n || '---' || n || n || '# Old heading' || n || n
  WHEN 1 THEN '---' || n || 'project: "[[B+ (1)]]"' || n || '---' || n || 'Begins at once' || n || '# Not the first' || n
  WHEN 2 THEN '# Old heading' || n ELSE 'Begins at once' || n || '# Not the first' || n END
  || 'See [[B+ (1)]], [[B+ (1)|it]], [[Alphabet]] and [[Projects/B+ (1)/B+ (1).md|page]] of ' || substr(rest, length('See [[Alpha]], [[Alpha|it]], [[Alphabet]] and [[Projects/Alpha/Alpha.md|page]] of ') + 1) AS note FROM ({_NOTES_SQL})""")
def notes_project_renamed(spark, sf_dir):
    return _notes(spark, sf_dir).select("p_partkey", d.project_renamed("note", F.lit("Alpha"), F.lit("B+ (1)")).alias("note"))


@query("""
WITH s AS (SELECT conv_id AS id, role, turn, trim(text) AS value FROM conversations WHERE trim(text) <> ''),
a AS (SELECT id, CASE role WHEN 'user' THEN 1 ELSE 2 END AS place, CASE role WHEN 'user' THEN '## Questions' ELSE '## Answers' END || chr(10) || chr(10) ||
  CASE role WHEN 'user' THEN string_agg('- ' || value, chr(10) ORDER BY turn) ELSE string_agg(value, chr(10) || chr(10) ORDER BY turn) END AS part FROM s WHERE role IN ('user', 'assistant') GROUP BY id, role)
SELECT c.id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY place), '') AS body FROM (SELECT DISTINCT conv_id AS id FROM conversations) c LEFT JOIN a USING (id) GROUP BY c.id""")
def notes_by_template(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("key"), F.col("turn").alias("seq"), F.trim("text").alias("value"))
    template = spark.sql("SELECT * FROM VALUES (1, 'user', 'Questions', 'list'), (2, 'assistant', 'Answers', 'text'), (3, 'decisions', 'Decisions', 'table') AS t(place, key, heading, kind)")
    return d.rendered_sections(c, template)


@query("""
WITH pages AS (SELECT 'people/person-' || lower(regexp_replace(s_name, '[^\\p{L}\\p{N}]+', '-', 'g')) || '.md' AS path, '---' || chr(10) || 'title: "' || replace(s_name, '#', ' ') || '"' || chr(10) || 'type: person' || chr(10) || '---' || chr(10) || chr(10) || 'Works in ' || n_name || chr(10) AS text
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'projects/project-' || lower(regexp_replace(n_name, '[^\\p{L}\\p{N}]+', '-', 'g')) || '.md', '---' || chr(10) || 'title: "' || n_name || '"' || chr(10) || 'type: project' || chr(10) || coalesce('team: [' || team || ']' || chr(10), '') || '---' || chr(10) || chr(10) || 'A project' || chr(10)
  FROM nation LEFT JOIN (SELECT s_nationkey, string_agg('"' || replace(s_name, '#', ' ') || '"', ', ' ORDER BY s_name) AS team FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
UNION ALL SELECT 'meetings/' || id || '.md', '---' || chr(10) || 'title: "Untitled meeting"' || chr(10) || 'type: meeting' || chr(10) || '---' || chr(10) || chr(10) || 'With [' || replace(s_name, '#', ' ') || '](people/person-' || lower(regexp_replace(s_name, '[^\\p{L}\\p{N}]+', '-', 'g')) || '.md) and nobody' || chr(10) || chr(10) || '[Transcript](transcripts/' || id || '.md)' || chr(10)
  FROM (SELECT DISTINCT conv_id AS id FROM conversations) JOIN supplier ON s_suppkey = id % 10
UNION ALL SELECT 'transcripts/' || conv_id || '.md', '---' || chr(10) || 'title: "Untitled meeting"' || chr(10) || 'type: Meeting Transcript' || chr(10) || '---' || chr(10) || chr(10) ||
  trim(string_agg('<a id="turn-' || turn || '"></a>**' || role || '** `' || lpad(CAST(turn // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '` ' || text, chr(10) || chr(10) ORDER BY turn)) || chr(10) FROM conversations GROUP BY conv_id)
SELECT split_part(path, '/', 1) AS folder, path, text FROM pages""")
def bundle_pages(spark, sf_dir):
    s, n, c = (table(spark, sf_dir, x) for x in ("supplier", "nation", "conversations"))
    s = s.withColumn("s_name", F.replace("s_name", F.lit("#"), F.lit(" ")))  # a wiki link's target has no such sign
    people = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("name"), F.concat(F.lit("Works in "), "n_name").alias("body"))
    teams = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("team"))
    projects = n.join(teams, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("name"), "team", F.lit("A project").alias("body"))
    led = c.select(F.col("conv_id").alias("id")).distinct().join(s, F.col("s_suppkey") == F.col("id") % 10)
    none = F.lit(None).cast("string")
    meetings = led.select("id", none.alias("title"), none.alias("description"), none.alias("project"), F.array().cast("array<string>").alias("people"), F.concat(F.lit("With [["), "s_name", F.lit("]] and [[nobody]]")).alias("body"))
    turns = c.select(F.col("conv_id").alias("id"), "turn", F.col("role").alias("label"), F.col("turn").alias("start"), "text")
    return d.bundle_pages(people, projects, meetings, turns).select("folder", "path", "text")


@query("SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderstatus IN ('O', 'P')")
def active_sessions(spark, sf_dir):
    return d.in_states(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")), ("O", "P"))


@query("SELECT o_orderkey AS id, o_totalprice AS seconds FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def top_six(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("seconds"))
    return d.first_rows(rows, 6, F.desc("seconds"), "id")


@query(f"SELECT meeting, seq, start, \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY start, \"end\", seq) AS n FROM ({SEGMENTS_SQL})) WHERE n <= 60")
def spans_capped(spark, sf_dir):
    return d.first_of_each(segments(spark, sf_dir), ["meeting"], 60, "start", "end", "seq").select("meeting", "seq", "start", "end")


@query(f"SELECT meeting, start, \"end\", speaker, row_number() OVER (PARTITION BY meeting ORDER BY start, \"end\", speaker) - 1 AS place FROM ({SEGMENTS_SQL})")
def segments_in_order(spark, sf_dir):
    return d.canonical_order(segments(spark, sf_dir), ["meeting"]).select("meeting", "start", "end", "speaker", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')")
def selected_meetings(spark, sf_dir):
    """Messages of the meetings that are asked for."""
    from parley.operators.people import selected

    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'system'").select(F.col("conv_id").alias("id")).distinct()
    return selected(c.select(F.col("conv_id").alias("id"), "turn", "text"), asked).withColumnRenamed("id", "conv_id")


@query("""
SELECT l_orderkey AS task_id, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_linenumber) AS place FROM lineitem""")
def tasks_in_list_order(spark, sf_dir):
    """Lines as tasks, in the order of the task list: the place of each among its order's."""
    from pyspark.sql import Window as W

    from parley.operators.tasks import task_list

    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("done"))
    l = l.withColumn("reminder_date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("line").cast("int")))
    listed = task_list(l).withColumn("at", F.monotonically_increasing_id())  # ascends through the sorted ranges
    return listed.select("task_id", "line", F.row_number().over(W.partitionBy("task_id").orderBy("at")).cast("long").alias("place"))


@query("""
SELECT event_id, event_type AS text FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 3""")
def words_valid(spark, sf_dir):
    """Words without those of no text and those that end before they begin."""
    from parley.operators.timeline import valid_words

    e = table(spark, sf_dir, "events")
    end = F.when(F.col("event_id") % 7 == 3, -1.0).otherwise(F.col("event_id") % 2)
    words = e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("text"), F.lit(0.0).alias("start"), end.alias("end"))
    return valid_words(words).select("event_id", "text")


@query("""
WITH r AS (SELECT event_id AS id, 60 + event_id % 900 AS frames FROM events),
w AS (SELECT id, frames, unnest(range(0, 1 + greatest(0, CAST(ceil((frames - 200) / 160) AS BIGINT)))) AS k, greatest(0, CAST(ceil((frames - 200) / 160) AS BIGINT)) AS last FROM r),
p AS (SELECT id, frames, CASE WHEN k = last THEN greatest(0, frames - 200) ELSE k * 160 END AS first, CASE WHEN k = 0 THEN 0 ELSE ((k - 1) * 160 + 180) // 10 END AS kept,
  CASE WHEN k = last THEN frames // 10 ELSE (k * 160 + 180) // 10 END AS stop FROM w)
SELECT id, first, kept - first // 10 AS keep_low, stop - first // 10 AS keep_high, kept AS place_low FROM p WHERE kept < frames // 10 OR frames <= 200""")
def windows_planned(spark, sf_dir):
    """Overlapping windows over recordings of many lengths, of which every column is kept once."""
    from parley.operators.timeline import plan_windows

    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (60 + F.col("event_id") % 900).alias("frames"))
    return plan_windows(r, 200, 20, 10).select("id", *(F.col(c).cast("long").alias(c) for c in ("first", "keep_low", "keep_high", "place_low")))


@query("""
SELECT n_name, left(string_agg(s_name, ', ' ORDER BY s_name), 60) AS line FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def project_people_lines(spark, sf_dir):
    """The people of a project in a line for a prompt, cut to its length."""
    from parley.functions.text import people_line

    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    named = s.join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.array_sort(F.collect_list("s_name")).alias("names"))
    return named.select("n_name", people_line("names", 60).alias("line"))


@query("""
SELECT user_id AS meeting, event_id AS seq, greatest(0, CAST(round_even((event_id % 977) * CAST(0.0125 AS DOUBLE) / CAST(0.01 AS DOUBLE), 0) AS BIGINT)) AS start FROM events""")
def spans_in_frames(spark, sf_dir):
    """Times as numbers of frames, to the nearest, half to even."""
    from parley.operators.quality import in_frames

    e = table(spark, sf_dir, "events")
    at = F.col("event_id") % 977 * 0.0125
    return in_frames(e.select(F.col("user_id").alias("meeting"), F.col("event_id").alias("seq"), at.alias("start"), (at + 1).alias("end"))).select("meeting", "seq", "start")


@query("""
SELECT conv_id, turn, length(CAST(to_json({'role': role, 'text': left(text, 500)}) AS VARCHAR)) AS cost, left(text, 500) AS excerpt FROM conversations""")
def passage_excerpts(spark, sf_dir):
    """Passages as a prompt shows them: cut to 500 characters, which the feature is, and what they take up there."""
    from parley.operators.retrieval import OVERHEAD, passage_cost

    c = table(spark, sf_dir, "conversations").withColumn("excerpt", F.left("text", F.lit(500)))
    return c.withColumn("text", F.col("excerpt")).select("conv_id", "turn", (passage_cost("role", "text") - OVERHEAD).cast("long").alias("cost"), "excerpt")


@query("""
SELECT o_orderstatus AS project, EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = s.o_orderstatus) OR EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = s.o_orderstatus) AS used FROM (SELECT DISTINCT o_orderstatus FROM orders UNION SELECT 'none') s""")
def projects_in_use(spark, sf_dir):
    """Whether any table still names a project; the projects of a report are few."""
    from parley.operators.editing import project_in_use

    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    held = [o.select(F.col("o_orderstatus").alias("project")), l.select(F.col("l_linestatus").alias("project"))]
    names = [r[0] for r in held[0].distinct().collect()] + ["none"]
    return spark.createDataFrame([(n, project_in_use(held, n)) for n in names], "project string, used boolean")
