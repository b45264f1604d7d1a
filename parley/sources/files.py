"""Readers and writers of records, notes, speaker labels and audio."""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from parley.functions.text import blank_to_null, escape_label, format_duration, format_timestamp, front_matter, percent_path, safe_filename

#: A meeting's record.
RECORD = (
    "id string, title string, date string, duration double, language string, project string, attendees array<string>, "
    "assignments map<string, struct<name: string, status: string, score: double, suggestion: string, unknown_label: string>>, "
    "turns array<struct<id: string, speaker: string, start: double, end: double, text: string>>, note_path string, "
    "transcript_revision int, notes_stale boolean, "
    "_notes struct<summary: string, action_items: array<struct<task: string, owner: string, due: string, source_turns: array<string>>>>"
)


def read_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Meeting records of a folder of JSON files: one record a file, or, in files that begin with 'part-' as ``write_records`` leaves them, one
    a line. What is no JSON is passed over, or ends the job if ``strict``."""
    reader = spark.read.schema(RECORD + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    lines = reader.option("multiLine", False).option("pathGlobFilter", "part-*.json").json(path)
    rows = lines.unionByName(reader.option("multiLine", True).option("pathGlobFilter", "{[!p]*,p[!a]*,pa[!r]*,par[!t]*,part[!-]*}.json").json(path))
    return rows.where(F.col("_corrupt").isNull() & F.col("id").isNotNull()).drop("_corrupt")


def repeated_ids(records: DataFrame) -> DataFrame:
    """Ids that more than one record has."""
    return records.groupBy("id").count().where("count > 1").select("id")


def write_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines, in as many files as there are tasks."""
    records.write.mode("overwrite").json(path)


def turns_of(records: DataFrame) -> DataFrame:
    """One row for each turn: id, turn, speaker, start, end, text."""
    return records.select("id", F.explode("turns").alias("t")).select("id", F.col("t.id").alias("turn"), "t.speaker", "t.start", "t.end", "t.text")


def assignments_of(records: DataFrame) -> DataFrame:
    """One row for each assignment: id, cluster, name, status, score, suggestion, unknown_label."""
    return records.select("id", F.explode("assignments").alias("cluster", "a")).select("id", "cluster", "a.*")


def read_notes(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """path, stem, header and body of Markdown notes; folders that begin with a dot are left out."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).text(path, wholetext=True)
    named = rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("_metadata.file_name", re.escape(suffix) + "$", "").alias("stem"), front_matter("value").alias("note"))
    return named.where(~F.col("path").rlike(r"/\.[^/]+/")).select("path", "stem", "note.header", "note.body")


def header_value(header: str | Column, key: str) -> Column:
    """A plain value of a note's header, without quotes; null if there is none."""
    return blank_to_null(F.regexp_extract(header, rf"(?m)^{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1))


# ---------------------------------------------------------------- speaker labels


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """file, start, end, speaker of an RTTM file's SPEAKER lines of eight fields or more."""
    fields = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    start, length = (F.get("f", F.lit(k)).cast("double") for k in (3, 4))
    return fields.select(F.get("f", F.lit(1)).alias("file"), start.alias("start"), (start + length).alias("end"), F.get("f", F.lit(7)).alias("speaker"))


def read_audacity(spark: SparkSession, path: str) -> DataFrame:
    """start, end, speaker of an Audacity label file; lines of other kinds, without name or length are passed over."""
    fields = spark.read.text(path).where(~F.col("value").startswith("\\")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    rows = fields.select(F.get("f", F.lit(0)).try_cast("double").alias("start"), F.get("f", F.lit(1)).try_cast("double").alias("end"), F.trim(F.get("f", F.lit(2))).alias("speaker"))
    return rows.where("end > start and speaker <> ''")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Speaker spans of a label file, by its suffix."""
    return read_rttm(spark, path).select("start", "end", "speaker") if path.endswith(".rttm") else read_audacity(spark, path)


def rttm_lines(spans: DataFrame) -> DataFrame:
    """RTTM lines of (file, start, end, speaker), in order of start."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.replace("file", F.lit(" "), F.lit("_")), "start", F.col("end") - F.col("start"), F.replace("speaker", F.lit(" "), F.lit("_")))
    return spans.orderBy("file", "start").select(line.alias("value"))


# ---------------------------------------------------------------- audio

#: Rows of an Arrow batch of sound.
BATCH_ROWS = 1000

#: Samples of short sounds that are made into 16 bits together.
CHUNK = 1 << 16

#: What begins a WAV file that has nothing but its samples.
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def short_batches(spark: SparkSession) -> None:
    """Rows hold sound, so where the session has Spark's default of 10,000 rows to an Arrow batch, it gets BATCH_ROWS: what a worker holds at a
    time depends on neither the table nor the part of it that a task has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def _plain(raw: bytes) -> tuple[int, bytes] | None:
    """Rate and samples of a file that has 16-bit mono samples already; null for others."""
    if len(raw) >= _HEADER.size:
        riff, rest, kind, name, length, tag, channels, rate, _, _, bits, data, size = _HEADER.unpack_from(raw)
        if (riff, kind, name, length, tag, channels, bits, data) == (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 16, b"data") and size % 2 == 0 and rest == 36 + size and len(raw) == 44 + size:
            return rate, raw[44:]  # the usual file, whole: there is nothing to look for in it
    with wave.open(io.BytesIO(raw)) as file:
        if (file.getsampwidth(), file.getnchannels()) != (2, 1):
            return None
        data = file.readframes(file.getnframes())
    return file.getframerate(), data[: len(data) // 2 * 2]


def _samples(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples from -1 to 1 of a WAV file of 8, 16, 24 or 32 bits; channels are averaged."""
    with wave.open(io.BytesIO(raw)) as file:
        width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
        data = np.frombuffer(file.readframes(file.getnframes()), np.uint8)
    data = data[: len(data) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        values = data[:, 0].astype(np.float64) - 128
    else:
        padded = np.zeros((len(data), 4), np.uint8)
        padded[:, 4 - width :] = data  # the sample's bytes are the highest ones
        values = (padded.view("<i4")[:, 0] >> (8 * (4 - width))).astype(np.float64)
    return rate, values.reshape(-1, channels).mean(axis=1) / (1 << (8 * width - 1))


def _resampled(samples: np.ndarray, rate: int, wanted: int, reach: int = 16) -> np.ndarray:
    """Samples at another rate: each is a windowed sinc's sum over its neighbours, which passes what both rates can hold."""
    if rate == wanted or not len(samples):
        return samples
    share = min(1.0, wanted / rate)
    half = int(np.ceil(reach / share))
    out = np.empty(int(len(samples) * wanted / rate))
    for first in range(0, len(out), 1 << 14):
        places = np.arange(first, min(len(out), first + (1 << 14))) * (rate / wanted)
        near = np.floor(places).astype(np.int64)[:, None] + np.arange(1 - half, half + 1)[None, :]
        apart = places[:, None] - near
        weight = np.sinc(share * apart) * (0.5 + 0.5 * np.cos(np.pi * np.clip(apart / half, -1, 1))) * ((near >= 0) & (near < len(samples)))
        out[first : first + len(places)] = (samples[np.clip(near, 0, len(samples) - 1)] * weight).sum(axis=1) / weight.sum(axis=1)
    return out


def _decoded(content: pd.Series, wanted: int | None) -> pd.DataFrame:
    out = []
    for raw in content:
        try:
            plain = _plain(raw)
            if plain is not None and wanted in (None, plain[0]):
                out.append(plain)
                continue
            rate, samples = _samples(raw)
            samples = _resampled(samples, rate, wanted or rate)
            out.append((wanted or rate, np.clip(np.rint(samples * 32768), -32768, 32767).astype("<i2").tobytes()))
        except (wave.Error, EOFError, ValueError, TypeError, ZeroDivisionError):
            out.append((None, None))
    return pd.DataFrame({"rate": pd.Series([rate for rate, _ in out], dtype="Int32"), "pcm": pd.Series([pcm for _, pcm in out], dtype=object)})


_SOUND = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])


@F.pandas_udf(_SOUND)
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """Rate and 16-bit mono samples of WAV files; channels are averaged. What is no such file, or null, has null for both."""
    return _decoded(content, None)


@F.pandas_udf(_SOUND)
def decode_wav_16k(content: pd.Series) -> pd.DataFrame:
    """The same at 16,000 samples a second."""
    return _decoded(content, 16_000)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """recording, rate, pcm and seconds of a folder of WAV files."""
    short_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("recording"), decode_wav("content").alias("a")).select("recording", "a.*")
    return rows.withColumn("seconds", F.octet_length("pcm") / (2 * F.col("rate")))


def _pcm(sounds: list[np.ndarray]) -> Iterator[bytes]:
    """16-bit samples of each sound; short ones are made together."""
    first = 0
    while first < len(sounds):
        end, size = first + 1, len(sounds[first])
        while end < len(sounds) and size + len(sounds[end]) <= CHUNK:
            size += len(sounds[end])
            end += 1
        whole = np.concatenate(sounds[first:end])
        np.clip(whole, -1, 1, out=whole)
        whole *= 32767
        raw, at = whole.astype("<i2").tobytes(), 0
        for x in sounds[first:end]:
            yield raw[at : at + 2 * len(x)]
            at += 2 * len(x)
        first = end


def _encoded(samples: pd.Series, rates: Iterable[int]) -> pd.Series:
    sounds = [None if x is None else np.asarray(x, np.float32) for x in samples]
    made = _pcm([x for x in sounds if x is not None])

    def one(pcm: bytes, r: int) -> bytes:
        return _HEADER.pack(b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, r, 2 * r, 2, 16, b"data", len(pcm)) + pcm

    return pd.Series([None if x is None else one(next(made), r) for x, r in zip(sounds, rates)], dtype=object)


@F.pandas_udf(T.BinaryType())
def encode_wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """16-bit mono WAV files of samples from -1 to 1; louder ones are cut off, null has none."""
    return _encoded(samples, rate)


def encode_wav_at(rate: int) -> Callable[[str | Column], Column]:
    """The same at one rate. As its only argument is the samples, a pandas function may make them: both run in one pass, and samples go
    neither to Spark's rows nor back from there, which costs more than making them."""

    @F.pandas_udf(T.BinaryType())
    def encode(samples: pd.Series) -> pd.Series:
        return _encoded(samples, repeat(rate))

    return encode


def slice_pcm(start: str | Column, end: str | Column, pcm: str = "pcm", rate: str = "rate") -> Column:
    """The samples between two times, cut to what there is; times go down to whole samples."""
    first, last = (F.greatest(F.floor(F.col(c) * F.col(rate) if isinstance(c, str) else c * F.col(rate)), F.lit(0)) for c in (start, end))
    return F.substring(pcm, (2 * first + 1).cast("int"), F.greatest(F.lit(0), 2 * (last - first)).cast("int"))


# ---------------------------------------------------------------- notes


def transcripts(turns: DataFrame) -> DataFrame:
    """id and transcript: each turn's line with its label, time and text, in order, with blank lines between."""
    line = F.concat(F.lit("**"), F.col("label"), F.lit("** "), format_timestamp("start"), F.lit("\n"), F.col("text"), F.lit(" ^"), F.col("turn"))
    return turns.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "turn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("transcript"))


def render_notes(meetings: DataFrame, tasks: DataFrame, told: DataFrame) -> DataFrame:
    """id, stem and body of Markdown notes of meetings (id, title, date, project, duration, people, summary), their tasks (id, line, text,
    owner, due, done) and transcripts (id, transcript)."""
    from parley.operators.tasks import task_line

    items = tasks.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", task_line(F.col("text"), F.col("owner"), F.col("due"), F.col("done")).alias("t")))), lambda x: x["t"]), "\n").alias("items"))
    rows = meetings.join(items, "id", "left").join(told, "id", "left")

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))

    linked = F.transform("people", lambda p: F.concat(F.lit("[["), p, F.lit("]]")))
    header = F.concat_ws("\n", F.lit("---"), field("title", F.col("title")), field("date", F.col("date")), field("project", F.col("project")), field("duration", format_duration("duration")), F.lit("---"))
    body = F.concat_ws(
        "\n\n",
        header,
        F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled"))),
        F.when(F.size("people") > 0, F.concat(F.lit("People: "), F.array_join(linked, ", "))),
        F.when(blank_to_null("summary").isNotNull(), F.concat(F.lit("## Summary\n\n"), F.col("summary"))),
        F.when(F.col("items").isNotNull(), F.concat(F.lit("## Action items\n\n"), F.col("items"))),
        F.when(F.col("transcript").isNotNull(), F.concat(F.lit("## Transcript\n\n"), F.col("transcript"))),
    )
    return rows.select("id", safe_filename(F.concat_ws(" ", F.left("date", F.lit(10)), "title")).alias("stem"), F.concat(body, F.lit("\n")).alias("body"))


def link_targets(bodies: DataFrame) -> DataFrame:
    """id and target of each wiki link of a text."""
    found = F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)"), 1)
    return bodies.select("id", F.explode(F.array_distinct(F.transform(found, lambda x: F.trim(x)))).alias("target"))


def resolve_links(bodies: DataFrame, targets: DataFrame) -> DataFrame:
    """Texts (id, body) whose wiki links are Markdown links to their target's path (targets: target, path), or plain labels if
    there is none. Only the links that a text has are joined to it."""
    links = link_targets(bodies).join(targets, "target", "left").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", F.coalesce("path", F.lit(""))))).alias("__paths"))
    pattern = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|([^\]]*))?\]\]"
    marks = F.regexp_extract_all("body", F.lit(pattern), 0)

    def shown(mark: Column) -> Column:
        target = F.trim(F.regexp_extract(mark, pattern, 1))
        label = F.coalesce(blank_to_null(F.regexp_extract(mark, pattern, 2)), target)
        path = F.element_at("__paths", target)
        return F.when(path != "", F.concat(F.lit("["), escape_label(label), F.lit("]("), percent_path(path), F.lit(")"))).otherwise(label)

    joined = bodies.join(links, "id", "left")
    body = F.aggregate(F.array_distinct(marks), F.col("body"), lambda text, mark: F.replace(text, mark, shown(mark)))
    return joined.withColumn("body", F.when(F.col("__paths").isNull(), F.col("body")).otherwise(body)).select(bodies.columns)


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Write tables, each below its name, and an index of their rows' paths by first folder. A path that exists is refused by the writer."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    counts = [rows.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, rows in tables.items()]
    index = counts[0]
    for c in counts[1:]:
        index = index.union(c)
    index.coalesce(1).write.mode("errorifexists").json(f"{path}/index")


def index_lines(pages: DataFrame) -> DataFrame:
    """folder and lines: the entries (path, title) of each first folder as Markdown links, by path."""
    entry = F.concat(F.lit("- ["), escape_label("title"), F.lit("]("), percent_path("path"), F.lit(")"))
    grouped = pages.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]), "\n").alias("lines"))
    return grouped


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A report's rows as lines of a Markdown table, header first."""
    body = rows.select(F.row_number().over(W.orderBy(order)).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("value"))
    head = rows.sparkSession.createDataFrame([(-1, f"| {' | '.join(columns)} |"), (0, "|" + "---|" * len(columns))], "n int, value string")
    return head.union(body).orderBy("n").select("value")
