"""What models answered: tolerant reading, shapes coerced, verdicts, and rounds of asking and merging. Column expressions and DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.sources.tables import durable

#: Pieces of an answer: a string with its escapes (one that is not closed reaches the end), a brace, or what lies between.
_PIECE = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}]|[^{}"]++'

#: Other names under which a task may be given, headings of a prompt's sections, what a second try is told.
TASK_NAMES = ("action", "action_item", "description", "text")

GUIDANCE = "## Format guidance (controls presentation; it is not meeting evidence)"
OWN_NOTES = "## Note-taker's own notes (what to make sure is covered; not meeting evidence)"
AGAIN = "Your previous reply did not match the required schema: "

#: Shapes of a declared section.
SHAPES = ("text", "list", "items")


def extract_json(text: str | Column) -> Column:
    """The JSON of an answer as a VARIANT: the text without thoughts, else the first fenced block that is JSON, else what reaches from the first
    brace to where it is closed; null if none of these is JSON, or for null.

    Braces within strings don't count. The braces are counted by a fold over the answer's pieces, of which there are as many as it has
    strings and braces.
    """
    column = F.col(text) if isinstance(text, str) else text
    bare = F.trim(F.regexp_replace(column, r"(?s)<think>.*?</think>", ""), F.lit(" \t\n\r\x0b\x0c"))
    fenced = F.regexp_extract_all(bare, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    first = F.array_compact(F.transform(fenced, lambda x: F.try_parse_json(x)))
    return F.coalesce(F.try_parse_json(bare), F.get(first, F.lit(0)), F.try_parse_json(balanced_object(bare)))


def balanced_object(text: Column) -> Column:
    """From the first brace to the one that closes it, or to the end; null without a brace."""
    at = F.instr(text, "{")
    pieces = F.regexp_extract_all(F.substr(text, at), F.lit(_PIECE), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.struct(
            F.when(state["over"], state["depth"]).otherwise(depth).alias("depth"),
            F.when(state["over"], state["length"]).otherwise(state["length"] + F.char_length(piece)).alias("length"),
            (state["over"] | (depth == 0)).alias("over"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("over"))
    length = F.aggregate(pieces, start, step, lambda state: state["length"])
    return F.when(at > 0, F.substr(text, at, length))


# ---------------------------------------------------------------- shapes


def kind(value: Column) -> Column:
    """'OBJECT', 'ARRAY', 'STRING', … of a VARIANT; null for null."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _is(value: Column, name: str) -> Column:
    return F.coalesce(kind(value) == name, F.lit(False))


def _get(value: Column, name: str, type_: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", type_)


def _texts(value: Column) -> Column:
    """The strings of an array of strings, an empty array where nothing is given; null for any other shape."""
    items = F.try_variant_get(value, "$", "array<variant>")
    fine = _is(value, "ARRAY") & F.forall(items, lambda x: _is(x, "STRING"))
    return F.when(value.isNull(), F.array().cast("array<string>")).when(fine, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


def as_text(value: Column) -> Column:
    """A string as it is, other values as JSON; stripped; '' for null."""
    plain = F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return F.trim(F.coalesce(F.when(_is(value, "VOID"), F.lit(None)).otherwise(plain), F.lit("")), F.lit(" \t\n\r\x0b\x0c"))


def topic(value: Column) -> Column:
    """A topic as struct(title, points, source_turns, cited, error). Points that are objects of a text with citations of their own are that text, and
    their citations become the topic's, each once in source_turns and as often as given in cited; error says what else does not fit, null if all does."""
    points, own = _get(value, "points"), _get(value, "source_turns")
    items = F.when(_is(points, "ARRAY"), F.try_variant_get(points, "$", "array<variant>"))
    sources = _texts(own)

    def cited(p: Column) -> Column:
        return _is(p, "OBJECT") & _is(_get(p, "text"), "STRING") & _texts(_get(p, "source_turns")).isNotNull() & sources.isNotNull()

    said = F.transform(items, lambda p: F.when(cited(p), _get(p, "text", "string")).when(_is(p, "STRING"), F.try_variant_get(p, "$", "string")))
    more = F.flatten(F.transform(items, lambda p: F.when(cited(p), _texts(_get(p, "source_turns"))).otherwise(F.array().cast("array<string>"))))
    error = (
        F.when(~_is(value, "OBJECT"), "topic: no object").when(~_is(_get(value, "title"), "STRING"), "title: no text").when(points.isNotNull() & items.isNull(), "points: no list")
        .when(sources.isNull(), "source_turns: no list of texts").when(F.exists(said, lambda x: x.isNull()), "points: no text")
    )
    none = F.array().cast("array<string>")
    cites = F.concat(F.coalesce(sources, none), F.coalesce(more, none))
    return F.struct(_get(value, "title", "string").alias("title"), F.coalesce(said, none).alias("points"), F.array_distinct(cites).alias("source_turns"), cites.alias("cited"), error.alias("error"))


def action(value: Column) -> Column:
    """An action item as struct(task, owner, due, source_turns, error). Where no task is given, but the other names of TASK_NAMES hold one
    text between them, that is the task; none is invented."""
    task = _get(value, "task")
    others = F.array_compact(F.array(*(F.when(_is(_get(value, n), "STRING"), F.nullif(F.trim(_get(value, n, "string")), F.lit(""))) for n in TASK_NAMES)))
    others = F.array_distinct(others)
    said = F.when(_is(task, "STRING"), F.trim(_get(value, "task", "string"))).when(task.isNull() & (F.size(others) == 1), F.get(others, F.lit(0)))
    sources = _texts(_get(value, "source_turns"))

    def optional(name: str) -> Column:
        own = _get(value, name)
        return own.isNull() | _is(own, "VOID") | _is(own, "STRING")

    error = (
        F.when(~_is(value, "OBJECT"), "action: no object").when(F.coalesce(said, F.lit("")) == "", "task: none").when(~optional("owner"), "owner: no text").when(~optional("due"), "due: no text")
        .when(sources.isNull(), "source_turns: no list of texts")
    )
    return F.struct(said.alias("task"), _get(value, "owner", "string").alias("owner"), _get(value, "due", "string").alias("due"), F.coalesce(F.array_distinct(sources), F.array().cast("array<string>")).alias("source_turns"), error.alias("error"))


def section_faults(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Declared sections (keys, key, title, type) that cannot stand, with ``fault``: no title, an unknown type, or a key that another section of
    the same template has."""
    named = F.trim(F.coalesce("title", F.lit("")))
    repeated = sections.groupBy(*keys, "key").agg(F.count("*").alias("__n"))
    joined = sections.join(repeated, [*keys, "key"])
    fault = F.when(named == "", "no title").when(~F.coalesce(F.col("type").isin(*SHAPES), F.lit(False)), "unknown type").when(F.col("__n") > 1, "repeated key")
    return joined.withColumn("fault", fault).where("fault is not null").drop("__n")


def section(value: Column, shape: Column) -> Column:
    """An extra section in its declared shape, as struct(text, list, items): one is filled, the others null. Blank texts and items go; what is
    no list is a list of one; what has neither a title nor a text is no item."""
    empty = value.isNull() | _is(value, "VOID") | (_is(value, "STRING") & (F.try_variant_get(value, "$", "string") == "")) | (_is(value, "BOOLEAN") & ~F.coalesce(F.try_variant_get(value, "$", "boolean"), F.lit(False))) | (
        kind(value).isin("BIGINT", "DECIMAL", "DOUBLE") & (F.try_variant_get(value, "$", "double") == 0))
    empty = empty | (_is(value, "ARRAY") & (F.size(F.try_variant_get(value, "$", "array<variant>")) == 0)) | (F.to_json(value) == "{}")
    items = F.try_variant_get(value, "$", "array<variant>")
    many = F.when(_is(value, "ARRAY"), items).when(~F.coalesce(empty, F.lit(False)), F.array(value)).otherwise(F.array().cast("array<variant>"))
    texts = F.filter(F.transform(many, as_text), lambda x: x != "")
    pairs = F.filter(F.when(_is(value, "ARRAY"), items).otherwise(F.array().cast("array<variant>")), lambda x: _is(x, "OBJECT"))
    pairs = F.transform(pairs, lambda x: F.struct(as_text(_get(x, "title")).alias("title"), as_text(_get(x, "text")).alias("text")))
    pairs = F.filter(pairs, lambda x: (x["title"] != "") | (x["text"] != ""))
    text = F.when(F.coalesce(empty, F.lit(False)), "").otherwise(as_text(value))
    return F.struct(F.when(shape == "text", text).alias("text"), F.when(shape == "list", texts).alias("list"), F.when(shape == "items", pairs).alias("items"))


def notes(value: str | Column) -> Column:
    """An answer's notes as struct(title, summary, topics, action_items, open_questions, error); error is the first thing that does not fit, null
    if the answer can be used. A null answer is no JSON object."""
    v = F.col(value) if isinstance(value, str) else value

    def each(name: str, shape: Callable[[Column], Column]) -> Column:
        own = _get(v, name)
        return F.when(_is(own, "ARRAY"), F.transform(F.try_variant_get(own, "$", "array<variant>"), shape))

    topics, actions = each("topics", topic), each("action_items", action)
    questions = _texts(_get(v, "open_questions"))
    errors = (F.coalesce(F.transform(x, lambda y: y["error"]), F.array().cast("array<string>")) for x in (topics, actions))
    wrong = F.get(F.array_compact(F.concat(*errors)), F.lit(0))
    error = (
        F.when(v.isNull() | ~_is(v, "OBJECT"), "no JSON object").when(~_is(_get(v, "summary"), "STRING"), "summary: no text").when(_get(v, "topics").isNotNull() & topics.isNull(), "topics: no list")
        .when(_get(v, "action_items").isNotNull() & actions.isNull(), "action_items: no list").when(questions.isNull(), "open_questions: no list of texts").otherwise(wrong)
    )
    return F.struct(_get(v, "title", "string").alias("title"), _get(v, "summary", "string").alias("summary"), topics.alias("topics"), actions.alias("action_items"), questions.alias("open_questions"), error.alias("error"))


# ---------------------------------------------------------------- asking


Model = Callable[[list[str]], list[str]]


def user_prompt(instructions: Column, heading: Column, body: Column, own_notes: Column) -> Column:
    """The sections of a prompt, blank ones left out, with the fixed headings that models are given."""
    def part(heading_: str, text: Column) -> Column:
        bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
        return F.when(bare != "", F.concat(F.lit(heading_), bare))

    guidance = part(f"{GUIDANCE}\n", instructions)
    notes_ = part(f"{OWN_NOTES}\n", own_notes)
    return F.concat_ws("\n\n", guidance, notes_, F.concat(F.lit("## "), heading, F.lit("\n"), F.coalesce(body, F.lit(""))))


def asked(prompts: DataFrame, model: Model, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """``prompts`` with the model's answer to each; the model gets a batch's prompts and gives as many answers."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, `{answer}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{answer: model(batch[prompt].tolist())})

    return prompts.mapInPandas(run, schema)


def asked_until_right(prompts: DataFrame, model: Model, retries: int = 1) -> DataFrame:
    """``prompts`` (with a column prompt) with answer, notes and tries. Only rows whose answer does not fit are asked again, once by default,
    with what was wrong; a row that never fits keeps its last answer and its error."""
    rows = durable(asked(prompts, model).withColumn("tries", F.lit(1)).withColumn("notes", notes(extract_json("answer"))))
    for k in range(retries):
        wrong = rows.where("notes.error is not null")
        if wrong.isEmpty():
            break
        told = F.concat("prompt", F.lit(f"\n\n{AGAIN}"), "notes.error", F.lit("\nCorrect this and return the complete JSON object."))
        again = wrong.withColumns({"__first": F.col("prompt"), "prompt": told}).drop("answer", "notes")
        again = asked(again, model).withColumns({"tries": F.lit(k + 2), "prompt": F.col("__first")}).drop("__first").withColumn("notes", notes(extract_json("answer")))
        rows = durable(rows.where("notes.error is null").unionByName(again.select(rows.columns)))
    return rows


def summarised(parts: DataFrame, model: Model, keys: list[str], text: str = "text", order: str = "part", fan_in: int = 8, retries: int = 1) -> DataFrame:
    """keys, answer, notes, merges, failed: one answer for the parts (keys, ``order``, ``text``) of each key.

    Parts are asked for on their own; then answers are merged by the model, ``fan_in`` neighbours at a time, in as many rounds as it takes
    until each key has one, so no prompt holds more than ``fan_in`` answers. Answers that don't fit are asked for once more; what
    still doesn't is not merged, and counted as failed. A key of one part has no merge; one whose parts all failed has null notes.
    """
    first = parts.select(*keys, F.col(order).cast("long").alias("__at"), F.concat(F.lit("Transcript\n"), F.coalesce(text, F.lit(""))).alias("prompt"))
    done = asked_until_right(first, model, retries)
    failed = durable(done.where("notes.error is not null").groupBy(*keys).agg(F.count("*").alias("failed")))
    totals = durable(parts.select(*keys).distinct())
    rows, merges = done.where("notes.error is null").select(*keys, "__at", "answer", "notes"), 0
    rows = durable(rows.withColumn("__at", F.row_number().over(W.partitionBy(*keys).orderBy("__at")) - 1).withColumn("merges", F.lit(0)))
    while not rows.where("`__at` > 0").isEmpty():
        merges += 1
        group = F.floor(F.col("__at") / fan_in).alias("__to")
        met = rows.groupBy(*keys, group).agg(F.array_sort(F.collect_list(F.struct("__at", "answer", "notes", "merges"))).alias("own"))  # at most fan_in
        alone = met.where("size(own) = 1").select(*keys, F.col("__to").alias("__at"), "own.answer", "own.notes", "own.merges")
        alone = alone.select(*keys, "__at", *(F.get(c, F.lit(0)).alias(c) for c in ("answer", "notes", "merges")))
        prompt = F.concat(F.lit("Partial notes\n["), F.array_join(F.transform("own", lambda x: F.to_json(extract_json(x["answer"]))), ", "), F.lit("]"))
        count = F.aggregate("own", F.lit(1), lambda a, x: a + x["merges"])
        merged = asked_until_right(met.where("size(own) > 1").select(*keys, F.col("__to").alias("__at"), count.alias("merges"), prompt.alias("prompt")), model, retries)
        rows = durable(alone.unionByName(merged.select(*keys, "__at", "answer", "notes", "merges")))
    match = totals.join(rows.drop("__at"), keys, "left").join(failed, keys, "left")
    return match.select(*keys, "answer", "notes", F.coalesce("merges", F.lit(0)).alias("merges"), F.coalesce("failed", F.lit(0)).alias("failed"))
