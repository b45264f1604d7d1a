"""People, projects and who belongs to what. Names compare without regard to case; the first spelling is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions.text import blank_to_null, safe_filename


def folded(name: str | Column) -> Column:
    """A name's form for comparing: single spaces, lower case."""
    column = F.col(name) if isinstance(name, str) else name
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def distinct_names(rows: DataFrame, keys: list[str], name: str = "name", seq: str = "seq") -> DataFrame:
    """One row for each name without regard to case: the spelling of least ``seq``. Blank names are left out."""
    real = rows.where(folded(name) != "")
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    return real.groupBy(*keys, folded(name).alias("folded")).agg(F.min_by(clean, F.struct(seq, name)).alias("name"), F.min(seq).alias("seq"))


def speakers_with_samples(speakers: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """Every speaker (speaker_id, name) with how many samples there are in a model's space, none included."""
    wanted = embeddings if model is None else embeddings.where(F.col("model") == model)
    counts = wanted.groupBy("speaker_id").agg(F.count("*").alias("samples"))
    return speakers.join(counts, "speaker_id", "left").na.fill(0, ["samples"])


def voice_profiles(speakers: DataFrame, talk: DataFrame, people: DataFrame) -> DataFrame:
    """Speakers with samples, seconds and meetings (talk: name, seconds, meetings) and profile (people: name, role,
    organisation, bio); what is missing is 0 or ''."""
    profile = people.select(folded("name").alias("__key"), "role", "organisation", "bio")
    joined = speakers.join(talk, "name", "left").withColumn("__key", folded("name")).join(profile, "__key", "left").drop("__key")
    return joined.na.fill(0, ["seconds", "meetings"]).na.fill("", ["role", "organisation", "bio"])


def projects(stats: DataFrame, folders: DataFrame) -> DataFrame:
    """Projects that meetings name (name, meetings, seconds, last) or that have a folder (name, modified), latest first."""
    both = stats.join(folders, "name", "full").na.fill(0, ["meetings", "seconds"])
    return both.withColumn("latest", F.greatest("modified", "last")).orderBy(F.desc_nulls_last("latest"), F.desc("name"))


def expected_speakers(speakers: DataFrame, attendees: DataFrame) -> DataFrame:
    """Speakers among the attendees (name), whatever the case; without attendees all."""
    if attendees.isEmpty():
        return speakers
    wanted = attendees.select(folded("name").alias("__key")).distinct()
    return speakers.withColumn("__key", folded("name")).join(wanted, "__key", "left_semi").drop("__key")


def unprocessed(recordings: DataFrame, in_use: DataFrame, least_seconds: float = 2.0) -> DataFrame:
    """Recordings (file, seconds) of some length whose file no meeting uses."""
    return recordings.where(F.col("seconds") >= least_seconds).join(in_use.select("file").distinct(), "file", "left_anti")


def selected(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the selected ids (id); an empty selection means all."""
    return records if ids.isEmpty() else records.join(ids.select("id").distinct(), "id", "left_semi")


def team(members: DataFrame, attendance: DataFrame, tasks: DataFrame, people: DataFrame) -> DataFrame:
    """The team of each project: project, name, role, organisation, assigned, meetings, open_tasks.

    members: project, name, seq; attendance: project, id, name; tasks: project, owner, done. Whoever occurs in one of them is
    in the team, under the members' spelling, else the least of the spellings. A person counts once a meeting.
    """
    spelled = members.select("project", "name", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("__rank"))
    spelled = spelled.unionByName(attendance.select("project", "name", F.lit(0).cast("long").alias("seq"), F.lit(1).alias("__rank")).distinct())
    spelled = spelled.unionByName(tasks.where("owner is not null").select("project", F.col("owner").alias("name"), F.lit(0).cast("long").alias("seq"), F.lit(2).alias("__rank")).distinct())
    names = distinct_names(spelled.withColumn("seq", F.struct("__rank", "seq")), ["project"])
    names = names.select("project", "folded", "name", (F.col("seq.__rank") == 0).alias("assigned"))
    met = attendance.select("project", "id", folded("name").alias("folded")).distinct().groupBy("project", "folded").agg(F.count("*").alias("meetings"))
    owed = tasks.groupBy("project", folded("owner").alias("folded")).agg(F.count_if(~F.col("done")).alias("open_tasks"))
    profile = people.select(folded("name").alias("folded"), "role", "organisation")
    joined = names.join(met, ["project", "folded"], "left").join(owed, ["project", "folded"], "left").join(profile, "folded", "left")
    return joined.na.fill(0, ["meetings", "open_tasks"]).na.fill("", ["role", "organisation"]).select("project", "name", "role", "organisation", "assigned", "meetings", "open_tasks")


def in_team_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("project", F.desc("assigned"), folded("name"))


def project_task_counts(tasks: DataFrame) -> DataFrame:
    """Open, completed and unassigned open tasks of each project."""
    return tasks.groupBy("project").agg(
        F.count_if(~F.col("done")).alias("open_tasks"), F.count_if("done").alias("completed_tasks"), F.count_if(~F.col("done") & blank_to_null("owner").isNull()).alias("unassigned_tasks")
    )


def records_of(records: DataFrame, project: str) -> DataFrame:
    """Records whose project, as a file's name, is ``project``."""
    return records.where(safe_filename("project") == F.lit(project))


def label_turns(turns: DataFrame, assignments: DataFrame) -> DataFrame:
    """Turns (id, speaker) with ``label``: the name given to the voice, else the suggestion's stand-in, else the voice itself.

    assignments: id, cluster, name, unknown_label.
    """
    named = assignments.select("id", F.col("cluster").alias("speaker"), "name", "unknown_label")
    return turns.join(named, ["id", "speaker"], "left").withColumn("label", F.coalesce(blank_to_null("name"), blank_to_null("unknown_label"), "speaker")).drop("name", "unknown_label")


def longest_quotes(turns: DataFrame, most: int = 2) -> DataFrame:
    """The ``most`` longest texts of each voice of each meeting, in order of time."""
    rank = F.row_number().over(W.partitionBy("id", "speaker").orderBy(F.desc(F.length("text")), "start"))
    return turns.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank").orderBy("id", "speaker", "start")


def sort_people(people: DataFrame, key: str, descending: bool = False) -> DataFrame:
    column = F.lower(key) if dict(people.dtypes)[key] == "string" else F.col(key)
    return people.orderBy(column.desc() if descending else column.asc(), "name")


def people_totals(people: DataFrame) -> DataFrame:
    """Samples, minutes and complete profiles over all people, and the most minutes of one."""
    complete = (F.col("role") != "") & (F.col("organisation") != "")
    return people.agg(F.sum("samples").alias("samples"), F.sum("minutes").alias("minutes"), F.count_if(complete).alias("complete"), F.max("minutes").alias("most"))


def closure(edges: DataFrame, start: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(root, id): all that each start (id) depends on, itself included. edges: id, needs; cycles end.

    Each round joins what the round before has found; the rows found are checkpointed, so plans stay short.
    """
    from parley.sources.tables import durable

    front = start.select(F.col("id").alias("root"), "id").distinct()
    found = front
    for _ in range(most_rounds):
        step = front.join(edges, "id").select("root", F.col("needs").alias("id")).distinct()
        front = durable(step.join(found, ["root", "id"], "left_anti"))
        if front.isEmpty():
            return found
        found = durable(found.union(front))
    raise RuntimeError("dependencies are too deep")


def unique_paths(notes: DataFrame) -> DataFrame:
    """Notes (id, stem) with a path: the stem, or 'stem (n)' from 2 on for those with a stem taken before."""
    nth = F.row_number().over(W.partitionBy("stem").orderBy("id"))
    return notes.withColumn("path", F.when(nth == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" ("), nth, F.lit(")"))))


def overridden(built_in: DataFrame, own: DataFrame, key: str = "key") -> DataFrame:
    """Rows of both; where a key is in both, the own row wins."""
    return own.unionByName(built_in.join(own.select(key).distinct(), key, "left_anti"))
