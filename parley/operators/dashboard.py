"""Dashboard metrics over meetings and turns.

meetings: id, date (text or date), duration (seconds), project, title, people (array of names, null for unnamed voices),
attendees (array). turns: id, speaker, start, end. Missing durations count as 0 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions.text import safe_filename


def speaking_time(turns: DataFrame, *keys: str) -> DataFrame:
    """Seconds spoken by each combination of keys."""
    return turns.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count("*").alias("turns"))


def speaker_board(turns: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` people who spoke longest: name, seconds, meetings. Ties go by name.

    Sums per meeting come first, so a person's meetings are counted without a distinct.
    """
    each = speaking_time(turns.where("speaker is not null"), "id", "speaker")
    total = each.groupBy(F.col("speaker").alias("name")).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("meetings"))
    return total.orderBy(F.desc("seconds"), "name").limit(most)


def activity(meetings: DataFrame, today: str, days: int = 30) -> DataFrame:
    """One row for each of the last ``days`` days: day, meetings, seconds; days without meetings have zeros."""
    end = F.to_date(F.lit(today))
    spine = meetings.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    per_day = meetings.where((F.col("day") >= F.date_sub(end, days - 1)) & (F.col("day") <= end)).groupBy("day").agg(F.count("*").alias("meetings"), F.sum("duration").alias("seconds"))
    return spine.join(per_day, "day", "left").na.fill(0, ["meetings", "seconds"])


def delta(current: Column, previous: Column) -> Column:
    """Change in per cent with one decimal; null if there was nothing before."""
    return F.when(previous != 0, F.round((current - previous) / previous * 100, 1))


def period_totals(meetings: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Meetings and seconds of the last ``days`` days, of as many before, and the changes between them."""
    end = F.to_date(F.lit(today))
    start = F.date_sub(end, days - 1)
    now = (F.col("day") >= start) & (F.col("day") <= end)
    before = (F.col("day") >= F.date_sub(start, days)) & (F.col("day") < start)
    seconds = F.coalesce("duration", F.lit(0))
    sums = meetings.agg(
        F.count_if(now).alias("meetings"),
        F.coalesce(F.sum(F.when(now, seconds)), F.lit(0)).alias("seconds"),
        F.count_if(before).alias("previous_meetings"),
        F.coalesce(F.sum(F.when(before, seconds)), F.lit(0)).alias("previous_seconds"),
    )
    return sums.withColumn("meetings_delta", delta(F.col("meetings"), F.col("previous_meetings"))).withColumn("seconds_delta", delta(F.col("seconds"), F.col("previous_seconds")))


def totals(meetings: DataFrame) -> DataFrame:
    """Count of meetings, hours with one decimal, and unnamed voices over all of them."""
    unnamed = F.size(F.filter("people", lambda p: p.isNull() | (p == "")))
    return meetings.agg(F.count("*").alias("meetings"), F.round(F.sum(F.coalesce("duration", F.lit(0))) / 3600, 1).alias("hours"), F.sum(unnamed).alias("unnamed"))


def project_rollup(meetings: DataFrame) -> DataFrame:
    """Meetings, seconds and last date of each project, by its name as a file's. Meetings without project are left out."""
    named = meetings.where(F.nullif("project", F.lit("")).isNotNull()).withColumn("name", safe_filename("project"))
    return named.groupBy("name").agg(F.count("*").alias("meetings"), F.sum(F.coalesce("duration", F.lit(0))).alias("seconds"), F.max(F.coalesce(F.col("date"), F.lit(""))).alias("last"))


def everyone() -> Column:
    """Distinct names among people and attendees, sorted; missing and empty ones are left out."""
    both = F.concat(F.coalesce("people", F.array().cast("array<string>")), F.coalesce("attendees", F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(both, lambda p: p.isNotNull() & (p != ""))))


def meeting_rows(meetings: DataFrame) -> DataFrame:
    """A row for each meeting as lists show it."""
    return meetings.select(
        "id",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"),
        "date",
        F.when(F.nullif("project", F.lit("")).isNotNull(), safe_filename("project")).alias("project"),
        F.coalesce("duration", F.lit(0)).alias("duration"),
        everyone().alias("people"),
        F.size(F.filter("people", lambda p: p.isNull() | (p == ""))).alias("unidentified"),
    )


def recent(rows: DataFrame, most: int = 6) -> DataFrame:
    """The latest meetings; those without date come last, ties go by id."""
    return rows.orderBy(F.coalesce("date", F.lit("")).desc(), "id").limit(most)


def attendance(meetings: DataFrame) -> DataFrame:
    """In how many meetings each person was, by name; a person counts once a meeting."""
    return meetings.select("id", F.explode(everyone()).alias("name")).groupBy("name").agg(F.count("*").alias("meetings"))


def speaker_share(turns: DataFrame) -> DataFrame:
    """Each meeting's speakers with seconds, turns and share of its talk; speakers without talk are left out."""
    each = speaking_time(turns, "id", "speaker").where("seconds > 0")
    return each.withColumn("share", F.round(F.col("seconds") / F.sum("seconds").over(W.partitionBy("id")), 4))


def busiest_day(days: DataFrame) -> DataFrame:
    """The day with most meetings, the earliest of equals, and its share of all."""
    best = days.agg(F.max_by("day", F.struct("meetings", -F.unix_date("day"))).alias("day"), F.max("meetings").alias("meetings"), F.sum("meetings").alias("total"))
    return best.select("day", "meetings", F.round(F.col("meetings") / F.col("total"), 4).alias("share"))


def search(rows: DataFrame, needle: str, text_columns: tuple[str, ...], list_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows in which a column's text, or a member of a list, has the needle, whatever the case. An empty needle finds all."""
    wanted = needle.lower().strip()
    hit = F.lit(wanted == "")
    for c in text_columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
    for c in list_columns:
        hit = hit | F.coalesce(F.exists(c, lambda p: F.contains(F.lower(p), F.lit(wanted))), F.lit(False))
    return rows.where(hit)
