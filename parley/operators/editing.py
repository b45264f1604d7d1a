"""Changes of stored tables, each from DataFrames to the new DataFrame; ``parley.sources.tables`` writes it as a snapshot.

What a caller may not do comes back as rows of a check, so that it can be refused before anything is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions.text import blank_to_null, clean_name
from parley.functions.vectors import finite, unit
from parley.operators.people import distinct_names, folded


def merge_rows(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the changed values; null leaves a value as it is, a new key is a new row."""
    rest = [c for c in current.columns if c not in keys]
    given = changes.select(*keys, *(F.col(c).alias(f"__{c}") if c in changes.columns else F.lit(None).cast(dict(current.dtypes)[c]).alias(f"__{c}") for c in rest))
    joined = current.join(given, keys, "full")
    return joined.select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in rest)).select(current.columns)


def insert_absent(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with those of ``fresh`` whose keys are not there yet."""
    return current.unionByName(fresh.join(current.select(*keys), keys, "left_anti"))


def unknown(wanted: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """What is asked for but isn't there."""
    return wanted.select(*keys).distinct().join(current, keys, "left_anti")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two sets has; none if they are equal as sets."""
    a, b = left.distinct(), right.select(left.columns).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# ---------------------------------------------------------------- speakers


def add_speakers(speakers: DataFrame, wanted: DataFrame) -> DataFrame:
    """speakers (speaker_id, name, consent) with the wanted names (name, consent, seq) added if there are none yet, whatever
    the case; consent once given stays."""
    names = distinct_names(wanted, [], "name", "seq").join(wanted.groupBy(folded("name").alias("folded")).agg(F.max("consent").alias("consent")), "folded")
    known = speakers.withColumn("folded", folded("name")).join(names.select("folded", F.col("consent").alias("__consent")), "folded", "left")
    kept = known.select("speaker_id", "name", (F.col("consent") | F.coalesce("__consent", F.lit(False))).alias("consent"))
    last = speakers.agg(F.coalesce(F.max("speaker_id"), F.lit(0))).first()[0]
    fresh = names.join(speakers.select(folded("name").alias("folded")), "folded", "left_anti")
    # New names of one call are few; they are numbered in their own order.
    nth = F.row_number().over(W.orderBy("seq", "folded"))
    return kept.unionByName(fresh.select((nth + last).cast(dict(speakers.dtypes)["speaker_id"]).alias("speaker_id"), "name", "consent"))


def rename_conflicts(speakers: DataFrame, renames: DataFrame) -> DataFrame:
    """Renames (speaker_id, name) to a name that another speaker has or that is no proper name."""
    asked = renames.select("speaker_id", "name", folded("name").alias("folded"), clean_name("name").isNull().alias("__bad"))
    held = speakers.select(F.col("speaker_id").alias("__other"), folded("name").alias("folded"))
    joined = asked.join(held, "folded", "left").where(F.col("__bad") | (F.col("__other") != F.col("speaker_id")))
    return joined.select("speaker_id", "name").distinct()


def forget(tables: dict[str, DataFrame], speaker_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables speakers, embeddings and feedback without some speakers: rows and vectors go, feedback loses the name."""
    gone = speaker_ids.select("speaker_id").distinct()
    flagged = tables["feedback"].join(gone.withColumn("__gone", F.lit(True)), "speaker_id", "left")
    feedback = flagged.withColumn("speaker_id", F.when(F.col("__gone").isNull(), F.col("speaker_id"))).select(tables["feedback"].columns)
    return {k: tables[k].join(gone, "speaker_id", "left_anti") for k in ("speakers", "embeddings")} | {"feedback": feedback}


def add_vectors(embeddings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Embeddings with the fresh ones that are finite, at length one."""
    good = fresh.where(finite("embedding")).withColumn("embedding", unit("embedding").cast(embeddings.schema["embedding"].dataType)).where("embedding is not null")
    return embeddings.unionByName(good.select(embeddings.columns))


def used_assignments(assignments: DataFrame, turns: DataFrame) -> DataFrame:
    """Assignments whose voice still speaks."""
    return assignments.join(turns.select("id", F.col("speaker").alias("cluster")).distinct(), ["id", "cluster"], "left_semi")


def confirmed_voices(voices: DataFrame, review: DataFrame) -> DataFrame:
    """Voices (meeting, cluster, embedding, seconds) of reviewed clusters (meeting, cluster, name) as one vector for each meeting
    and person, weighted by speech; unconfirmed ones teach nothing."""
    from parley.operators.voices import mean_vectors

    named = voices.join(review.where(blank_to_null("name").isNotNull()), ["meeting", "cluster"]).withColumn("seconds", F.greatest("seconds", F.lit(1.0)))
    return mean_vectors(named, ["meeting", "name"], weight="seconds")


# ---------------------------------------------------------------- chats


def chat_list(chats: DataFrame) -> DataFrame:
    """Pinned ones first, then by last change."""
    return chats.orderBy(F.desc("pinned"), F.desc("updated"), "id")


def append_messages(chats: DataFrame, messages: DataFrame, pairs: DataFrame, title_length: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New chats and messages with question and answer appended, and the pairs refused.

    pairs: id, expected, question, answer, at. A pair is refused if the chat is not there or has another number of messages than
    ``expected``. An untitled chat takes the question as its title.
    """
    counts = messages.groupBy("id").agg(F.count("*").alias("__n"))
    joined = pairs.join(chats.select("id", F.lit(True).alias("__there")), "id", "left").join(counts, "id", "left").na.fill(0, ["__n"])
    fits = F.col("__there").isNotNull() & (F.col("expected") == F.col("__n"))
    good = joined.where(fits)
    said = F.array(F.struct(F.col("__n").alias("seq"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((F.col("__n") + 1).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    added = messages.unionByName(good.select("id", F.inline(said)).select("id", F.col("seq").cast(dict(messages.dtypes)["seq"]).alias("seq"), "role", "text"))
    touched = chats.join(good.select("id", "question", "at"), "id", "left")
    title = F.when(F.col("question").isNotNull() & blank_to_null("title").isNull(), F.left("question", F.lit(title_length))).otherwise(F.col("title"))
    changed = touched.withColumns({"title": title, "updated": F.coalesce("at", "updated")}).select(chats.columns)
    return changed, added, joined.where(~fits).select(pairs.columns)


def relink(rows: DataFrame, old: str, new: str, column: str = "project") -> DataFrame:
    """Rows of one project moved to another name."""
    return rows.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def unlink(rows: DataFrame, old: str, column: str = "project") -> DataFrame:
    return rows.withColumn(column, F.nullif(column, F.lit(old)))


# ---------------------------------------------------------------- transcripts and notes


def refused_batches(batches: DataFrame, records: DataFrame, edits: DataFrame, turns: DataFrame) -> DataFrame:
    """Batches (id, revision) that may not be applied, with ``reason``: missing, conflict (the revision has moved on) or turn (an
    edit names a turn that isn't there). A batch is applied whole or not at all."""
    now = records.select("id", F.col("revision").alias("__now"))
    lost = edits.join(turns.select("id", "turn"), ["id", "turn"], "left_anti").select("id", F.lit(True).alias("__lost")).distinct()
    joined = batches.join(now, "id", "left").join(lost, "id", "left")
    reason = F.when(F.col("__now").isNull(), "missing").when(F.col("__now") != F.col("revision"), "conflict").when(F.col("__lost"), "turn")
    return joined.withColumn("reason", reason).where("reason is not null").select("id", "revision", "reason")


def edit_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns (id, turn, speaker, text) after edits (id, seq, turn, speaker, text; null changes nothing): of each value the last
    edit's counts. Blank texts change nothing."""
    text = F.trim("text")
    last = edits.groupBy("id", "turn").agg(
        F.max_by("speaker", F.when(F.col("speaker").isNotNull(), F.col("seq"))).alias("__speaker"), F.max_by(text, F.when(text != "", F.col("seq"))).alias("__text")
    )
    joined = turns.join(last, ["id", "turn"], "left")
    return joined.withColumns({"speaker": F.coalesce("__speaker", "speaker"), "text": F.coalesce("__text", "text")}).select(turns.columns)


def rename_voices(assignments: DataFrame, renames: DataFrame) -> DataFrame:
    """Assignments (id, cluster, name, status) after renames (id, seq, cluster, name): the last counts; a blank one takes the name away."""
    last = renames.groupBy("id", "cluster").agg(F.max_by(F.struct(F.coalesce(clean_name("name"), F.lit("")).alias("name")), "seq").alias("__new"))
    joined = assignments.join(last, ["id", "cluster"], "left")
    name = F.when(F.col("__new").isNotNull(), blank_to_null("__new.name")).otherwise(F.col("name"))
    status = F.when(F.col("__new").isNull(), F.col("status")).when(F.col("__new.name") != "", "confirmed").otherwise("unknown")
    return joined.withColumns({"status": status, "name": name}).select(assignments.columns)


def bump_revisions(records: DataFrame, changed: DataFrame) -> DataFrame:
    """Records whose turns or names changed have the next revision, and notes that are out of date."""
    ids = changed.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = records.join(ids, "id", "left")
    hit = F.col("__hit").isNotNull()
    return joined.withColumns({"revision": F.col("revision") + hit.cast("int"), "notes_stale": F.col("notes_stale") | hit}).drop("__hit").select(records.columns)


def replace_transcript(notes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Notes (id, body) with the section under the transcript's heading replaced, or added at the end (transcripts: id, transcript)."""
    joined = notes.join(transcripts, "id", "left")
    pattern = r"(?ms)^(## Transcript)[ \t]*\r?$.*?(?=^#{1,2} |\z)"
    body, told = F.col("body"), F.col("transcript")
    has = body.rlike(r"(?m)^## Transcript[ \t]*\r?$")
    head = F.regexp_extract(body, r"(?ms)\A(.*?^## Transcript)[ \t]*\r?$", 1)
    tail = F.regexp_extract(body, pattern + r"(.*)\z", 2)
    new = F.when(has, F.concat(head, F.lit("\n\n"), told, F.lit("\n\n"), tail)).otherwise(F.concat(F.rtrim(F.regexp_replace(body, r"\s+\z", "")), F.lit("\n\n## Transcript\n\n"), told, F.lit("\n")))
    return joined.withColumn("body", F.when(told.isNull(), body).otherwise(new)).select(notes.columns)


def untouched_notes(notes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Notes that still are as they were written (hashes: id, sha); others have been edited by hand and must be kept."""
    return notes.withColumn("sha", F.sha2("body", 256)).join(hashes, ["id", "sha"], "left_semi").drop("sha")


def set_members(members: DataFrame, project: str, names: DataFrame) -> DataFrame:
    """Members (project, name, seq) with one project's list replaced; names that differ in case only are one."""
    own = distinct_names(names, [], "name", "seq").select(F.lit(project).alias("project"), "name", "seq")
    return members.where(F.col("project") != project).unionByName(own.select(members.columns))


def project_in_use(tables: list[DataFrame], project: str) -> bool:
    """Whether any table still names the project."""
    return not reduce(DataFrame.unionAll, [t.where(F.col("project") == project).select("project").limit(1) for t in tables]).isEmpty()


def move(state: str, allowed: dict[str, tuple[str, ...]], sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sessions (id, state) of ``wanted`` (id) moved to ``state`` where their present state allows it; others stay."""
    may = F.col("state").isin(*[s for s, goals in allowed.items() if state in goals])
    joined = sessions.join(wanted.select("id").distinct().withColumn("__ask", F.lit(True)), "id", "left")
    return joined.withColumn("state", F.when(F.col("__ask").isNotNull() & may, F.lit(state)).otherwise(F.col("state"))).select(sessions.columns)
