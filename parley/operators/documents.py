"""What notes and lists say of meetings: context, links of people, provenance, titles and project links, identifiers, short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions.text import blank_to_null, format_duration, json_text, percent_path, text

#: States of a session that goes on, and what a note says where there is no summary.
ACTIVE_STATES = ("recording", "paused", "processing", "review")
NO_SUMMARY = "Speaker-attributed meeting transcript."


def folded(name: str | Column) -> Column:
    return F.lower(F.trim(text(name)))


# ---------------------------------------------------------------- context and links


def meeting_context(meetings: DataFrame, assignments: DataFrame, attendees: DataFrame) -> DataFrame:
    """meetings (id, title, date, duration, project) with date_long, length, minutes, people and unknown.

    assignments: id, name, display_name; attendees: id, name. ``people`` are the names given to voices and the attendees, ``unknown`` the
    voices without a name; both sorted, without repeats, empty where there are none. At least one minute; halves go to even.
    """
    named = assignments.where("name is not null").select("id", "name").union(attendees.select("id", "name"))
    known = named.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("people"))
    open_ = assignments.where("name is null").groupBy("id").agg(F.array_sort(F.collect_set("display_name")).alias("unknown"))
    none = F.array().cast("array<string>")
    rows = meetings.join(known, "id", "left").join(open_, "id", "left")
    return rows.withColumns(
        {
            "date_long": F.date_format("date", "MMMM d, yyyy"),
            "length": format_duration("duration"),
            "minutes": F.greatest(F.lit(1), F.bround(F.col("duration") / 60, 0).cast("long")),
            "people": F.coalesce("people", none),
            "unknown": F.coalesce("unknown", none),
        }
    )


def owner_links(owners: DataFrame, known: DataFrame, assigned: DataFrame, attendees: DataFrame) -> DataFrame:
    """owners (id, owner) with ``link``: the wiki link of the person whom the owner's name means in that meeting, whatever its case, or the
    name as it is; empty without an owner.

    A name is spelled as the meeting's attendees (id, name, seq) have it, else as its assigned voices (id, name, seq) do, else as the known
    people (name, seq); of several spellings in one source the last. The lists are reduced by name before they are joined.
    """

    def spelled(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.where(blank_to_null("name").isNotNull()).groupBy(*keys, folded("name").alias("__name")).agg(F.max_by("name", "seq").alias(name))

    asked = owners.withColumn("__name", folded("owner"))
    for rows, keys, name in ((attendees, ["id"], "__a"), (assigned, ["id"], "__b"), (known, [], "__c")):
        asked = asked.join(spelled(rows, keys, name), [*keys, "__name"], "left")
    found = F.coalesce("__a", "__b", "__c")
    link = F.when(blank_to_null("owner").isNull(), "").when(found.isNull(), F.col("owner")).otherwise(F.concat(F.lit("[["), found, F.lit("]]")))
    return asked.withColumn("link", link).select(*owners.columns, "link")


def knowledge(meeting_id: str, date: str, summary: str, audio: str, sha: str) -> Column:
    """Where a document comes from: description, date, status, sources and the audio's hash. Nothing claims that a person has checked it."""
    plain = F.trim(F.regexp_replace(text(summary), r"\s+", " "))
    source = F.when(blank_to_null(audio).isNotNull(), F.concat(F.lit("file://"), percent_path(audio))).otherwise(F.concat(F.lit("Recorded audio for meeting "), text(meeting_id).cast("string")))
    return F.struct(
        F.coalesce(F.when(blank_to_null(summary).isNotNull(), plain), F.lit(NO_SUMMARY)).alias("description"),
        text(date).alias("date"),
        F.lit("draft").alias("status"),
        F.array(F.struct(F.lit("audio").alias("id"), source.alias("resource"), F.lit("Original meeting recording").alias("title"))).alias("sources"),
        text(sha).alias("audio_sha256"),
    )


def meeting_id(date: str | Column, sha: str | Column) -> Column:
    """Day, time to the minute and the first six digits of the audio's hash."""
    return F.concat(F.date_format(text(date), "yyyyMMdd-HHmm"), F.lit("-"), F.left(text(sha), F.lit(6)))


# ---------------------------------------------------------------- texts


def restored_words(original: str | Column, aligned: str | Column) -> Column:
    """The original words, with their punctuation, if they are as many as the aligned ones and each pair is equal but for case and
    punctuation; else the aligned ones."""

    def plain(w: Column) -> Column:
        return F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_']", ""))

    a, b = text(original), text(aligned)
    agree = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(plain(x) == plain(y), F.lit(False))), lambda same: same)
    return F.when(agree, a).otherwise(b)


def _literal(x: Column) -> Column:
    """Text that stands for itself in a pattern's replacement."""
    return F.regexp_replace(x, r"([\\$])", r"\\$1")


def retitled(note: str | Column, title: str | Column) -> Column:
    """A note with another title in its header, and in the first heading if the note begins with one; all else stays.

    A header without title gets one, a note without header gets a header.
    """
    t, name = text(note), text(title)
    line = F.when(t.contains("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n"))
    entry = F.concat(F.lit("title: "), json_text(name))
    fence = r"(?sm)\A(---\r?\n)(.*?)(^---[ \t]*(?:\r?\n|\z))"
    has = t.rlike(fence)
    header = F.regexp_extract(t, fence, 2)
    titled = F.when(header.rlike(r"(?m)^title:"), F.regexp_replace(header, F.lit(r"(?m)^title:[^\r\n]*"), _literal(entry))).otherwise(F.concat(entry, line, header))
    body = F.when(has, F.regexp_replace(t, fence, "")).otherwise(t)
    headed = F.regexp_replace(body, F.lit(r"\A((?:[ \t]*\r?\n)*)# [^\r\n]*"), F.concat(F.lit("$1# "), _literal(name)))
    head = F.when(has, F.concat(F.regexp_extract(t, fence, 1), titled, F.regexp_extract(t, fence, 3))).otherwise(F.concat(F.lit("---"), line, entry, line, F.lit("---"), line))
    return F.concat(head, headed)


def _quoted(x: Column) -> Column:
    """Text as a pattern that matches only itself."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}\s])", r"\\$1")


def project_renamed(note: str | Column, old: str | Column, new: str | Column) -> Column:
    """A note whose wiki links to a project, plain or by its path, and whose project line name the project's new name."""
    t, a, b = text(note), text(old), text(new)
    plain = F.regexp_replace(t, F.concat(F.lit(r"\[\["), _quoted(a), F.lit(r"(?=[\]|#])")), F.concat(F.lit("[["), _literal(b)))
    path = F.concat(F.lit(r"\[\[Projects/"), _quoted(a), F.lit("/"), _quoted(a), F.lit(r"(?=(?:\.md)?(?:[|#]|\]\]))"))
    linked = F.regexp_replace(plain, path, F.concat(F.lit("[[Projects/"), _literal(b), F.lit("/"), _literal(b)))
    moved = F.replace(linked, F.concat(F.lit("Projects/"), a, F.lit("/")), F.concat(F.lit("Projects/"), b, F.lit("/")))
    fence = r"(?sm)\A(---\r?\n.*?)(^---\r?$.*)\z"
    header = F.regexp_replace(F.regexp_extract(moved, fence, 1), F.lit(r"(?m)^project:[^\r\n]*"), F.concat(F.lit("project: "), _literal(json_text(F.concat(F.lit("[["), b, F.lit("]]"))))))
    return F.when(moved.rlike(fence), F.concat(header, F.regexp_extract(moved, fence, 2))).otherwise(moved)


def own_notes(notes: str | Column) -> Column:
    """What a person wrote, word for word, with heading marks escaped so that they do not cut the note's sections."""
    return F.regexp_replace(F.trim(text(notes)), r"(?m)^(\s*)#", r"$1\\\\#")


# ---------------------------------------------------------------- notes by template


def rendered_sections(notes: DataFrame, template: DataFrame) -> DataFrame:
    """id and body of notes by a template.

    template: place, key, heading, kind ('text', 'list' or 'table'); notes: id, key, seq, value. A section stands in the template's order with its
    heading; a text's values are paragraphs, a list's are items, a table's are rows whose cells ``value`` parts by '|'. Sections
    without values are left out, and a meeting without any has an empty body. The template, a person's file, is small and broadcast.
    """
    line = F.when(F.col("kind") == "list", F.concat(F.lit("- "), F.col("value"))).when(F.col("kind") == "table", F.concat(F.lit("| "), F.array_join(F.transform(F.split("value", r"\|"), lambda c: F.trim(c)), " | "), F.lit(" |"))).otherwise(F.trim("value"))
    rows = notes.join(F.broadcast(template), "key").where(blank_to_null(F.trim("value")).isNotNull())
    told = rows.groupBy("id", "place", "heading", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    section = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.when(F.col("kind") == "text", F.array_join("lines", "\n\n")).otherwise(F.array_join("lines", "\n")))
    body = told.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", section.alias("part")))), lambda x: x["part"]), "\n\n").alias("body"))
    return notes.select("id").distinct().join(body, "id", "left").select("id", F.coalesce("body", F.lit("")).alias("body"))


# ---------------------------------------------------------------- bundles


def bundle_pages(people: DataFrame, projects: DataFrame, meetings: DataFrame, turns: DataFrame) -> DataFrame:
    """folder, path, title, description and text of the Markdown pages of a bundle: people, projects, meetings and their transcripts.

    people: name, body; projects: name, team (names), body; meetings: id, title, description, project, people (names), body; turns: id, turn,
    label, start (seconds), text. Wiki links to people, projects and meetings become relative links, others plain labels. Meetings link to their
    transcript, whose turns have anchors.
    """
    from parley.functions.text import format_timestamp
    from parley.sources.files import resolve_links

    def page(rows: DataFrame, folder: str, stem: Column, title: Column, description: Column, meta: list[tuple[str, Column]], body: Column) -> DataFrame:
        header = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), v) for k, v in [("title", json_text(title)), *meta]), F.lit("---"))
        return rows.select(F.lit(folder).alias("folder"), F.concat(F.lit(f"{folder}/"), stem, F.lit(".md")).alias("path"), title.alias("title"), description.alias("description"), header.alias("header"), body.alias("body"))

    def names(x: str) -> Column:
        return F.when(F.size(x) > 0, F.concat(F.lit("["), F.array_join(F.transform(x, json_text), ", "), F.lit("]")))

    def stem(x: str) -> Column:
        return F.regexp_replace(F.lower(F.col(x).cast("string")), r"[^\p{L}\p{N}]+", "-")

    lines = F.concat(F.lit('<a id="turn-'), F.col("turn"), F.lit('"></a>**'), F.col("label"), F.lit("** `"), format_timestamp("start"), F.lit("` "), F.col("text"))
    told = turns.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "turn", lines.alias("line")))), lambda x: x["line"]), "\n\n").alias("told"))
    titled = F.coalesce(blank_to_null("title"), F.lit("Untitled meeting"))
    link = F.concat(F.lit("\n\n[Transcript](transcripts/"), stem("id"), F.lit(".md)"))
    held = meetings.join(told.withColumn("__told", F.lit(True)).select("id", "__told"), "id", "left")
    pages = page(people, "people", F.concat(F.lit("person-"), stem("name")), F.col("name"), F.lit(None).cast("string"), [("type", F.lit("person"))], F.col("body"))
    pages = pages.unionByName(page(projects, "projects", F.concat(F.lit("project-"), stem("name")), F.col("name"), F.lit(None).cast("string"), [("type", F.lit("project")), ("team", names("team"))], F.col("body")))
    pages = pages.unionByName(page(held, "meetings", stem("id"), titled, F.col("description"), [("type", F.lit("meeting")), ("project", F.when(F.col("project").isNotNull(), json_text("project"))), ("attendees", names("people"))], F.concat(F.coalesce("body", F.lit("")), F.when(F.col("__told"), link).otherwise(F.lit("")))))
    pages = pages.unionByName(page(meetings.join(told, "id"), "transcripts", stem("id"), titled, F.lit(NO_SUMMARY), [("type", F.lit("Meeting Transcript"))], F.col("told")))
    targets = pages.where("folder in ('people', 'projects')").select(F.col("title").alias("target"), "path")
    targets = targets.union(meetings.select(F.col("id").cast("string"), F.concat(F.lit("meetings/"), stem("id"), F.lit(".md")))).groupBy("target").agg(F.min("path").alias("path"))
    linked = resolve_links(pages.select(F.col("path").alias("id"), "folder", "title", "description", "header", F.coalesce("body", F.lit("")).alias("body")), targets)
    return linked.select("folder", F.col("id").alias("path"), "title", "description", F.concat("header", F.lit("\n\n"), F.trim("body"), F.lit("\n")).alias("text"))


# ---------------------------------------------------------------- lists


def in_states(sessions: DataFrame, states: tuple[str, ...] = ACTIVE_STATES) -> DataFrame:
    """Sessions whose state is one of a set."""
    return sessions.where(F.col("state").isin(*states))


def first_rows(rows: DataFrame, most: int, *order: str | Column) -> DataFrame:
    """The first ``most`` rows of a report, such as the three tasks or six speakers of a side list; each task finds its own first rows, and only those
    meet."""
    return rows.orderBy(*order).limit(most)


def first_of_each(rows: DataFrame, keys: list[str], most: int, *order: str | Column) -> DataFrame:
    """The first ``most`` rows of each recording, such as the spans that are looked at again."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def canonical_order(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with ``place`` in their recording's order of start and end, from 0; of equals by label."""
    return segments.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("start", "end", "speaker")) - 1)
