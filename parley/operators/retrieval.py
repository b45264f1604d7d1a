"""Notes cut into passages, ranked by BM25 and selected under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions.text import cited_numbers, terms
from parley.operators.tasks import LINE_END
from parley.sources.tables import durable

#: BM25's constants, the bonus of a term in a title, characters of a part and of a passage, what a
#: passage costs besides its own characters, how many are selected, and from how many meetings the first ones come.
K1, B, TITLE_BONUS = 1.2, 0.75, 2
PART, PASSAGE, OVERHEAD, MOST, FIRST_MEETINGS = 1200, 1600, 80, 12, 6


def _passages(body: str, heading: str) -> Iterator[tuple[str, str]]:
    """(heading, text) of one note's passages."""
    held: list[str] = []
    size = 0
    for line in body.splitlines():
        marks = len(line) - len(line.lstrip("#"))
        title = line[marks:].lstrip() if 1 <= marks <= 3 and line[marks : marks + 1].isspace() else ""
        pieces = [None] if title else [line[k : k + PART] for k in range(0, max(1, len(line)), PART)]
        for piece in pieces:
            if piece is None or size + len(piece) > PASSAGE:
                if text := "\n".join(held).strip():
                    yield heading, text
                held, size = [], 0
            if piece is not None:
                held.append(piece)
                size += len(piece)
        heading = title or heading
    if text := "\n".join(held).strip():
        yield heading, text


def passages(notes: DataFrame, heading: str = "Meeting notes") -> DataFrame:
    """id, seq, heading, text of the passages of notes (id, body): lines under one heading, up to about PASSAGE characters.

    A null or blank body has no passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (number, seq, title, text)
                for number, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist())
                for seq, (title, text) in enumerate(_passages(body or "", heading))
            ]
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("id").type), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(columns[3])], ["id", "seq", "heading", "text"])

    kind = dict(notes.dtypes)["id"]
    return notes.select("id", "body").mapInArrow(run, f"id {kind}, seq int, heading string, text string")


def note_body(records: DataFrame) -> DataFrame:
    """id and body of records (id, body, notes, transcript): the note, or else its data and the transcript."""
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    told = F.when(F.coalesce("transcript", F.lit("")) != "", F.concat(F.lit("\n\n## Transcript\n"), "transcript")).otherwise(F.lit(""))
    return records.select("id", F.when(blank, F.concat(F.coalesce("notes", F.lit("")), told)).otherwise(F.col("body")).alias("body"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """How often each term stands in each chunk (chunk, text)."""
    return chunks.select("chunk", F.explode(terms("text")).alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("n"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """In how many chunks each term stands."""
    return chunks.select(F.explode(F.array_distinct(terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("chunks"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """Chunks and their mean number of terms; 0 counts as 1."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.nullif(F.avg(F.size(terms("text"))), F.lit(0.0)), F.lit(1.0)).alias("average"))


def question_terms(chunks: DataFrame, question: str) -> list[str]:
    """The question's distinct terms in order, cut as those of the texts are."""
    row = chunks.sparkSession.range(1).select(F.array_sort(F.array_distinct(terms(F.lit(question)))).alias("terms")).first()
    return row["terms"]


def bm25(chunks: DataFrame, question: str) -> DataFrame:
    """chunks (chunk, meeting, title, text) with ``score`` for the question and, in place of the text, its ``characters``.

    One pass over the texts counts the question's terms, without a shuffle. The counts are kept, since several steps read them:
    the corpus's figures (one number a term, as a single row), the ranking, the selection.
    """
    wanted = question_terms(chunks, question)
    titled = F.size(F.array_intersect(terms("title"), F.array(*map(F.lit, wanted)).cast("array<string>"))).alias("__titled")
    rest = [c for c in chunks.columns if c != "text"]
    # The terms are counted in a lambda's argument, so that each text is cut once, however many terms there are.
    counts = F.transform(F.array(terms("text")), lambda own: F.struct(F.size(own).alias("length"), F.array(*(F.size(own) - F.size(F.array_remove(own, w)) for w in wanted)).cast("array<int>").alias("n")))[0]
    counted = durable(chunks.select(*rest, F.length("text").alias("characters"), titled, counts.alias("__c")).select(*rest, "characters", "__titled", F.coalesce("__c.length", F.lit(0)).alias("__length"), *(F.coalesce(F.get("__c.n", F.lit(k)), F.lit(0)).alias(f"__n{k}") for k in range(len(wanted)))))
    figures = counted.agg(F.count("*").alias("n"), F.avg("__length").alias("average"), *(F.count_if(F.col(f"__n{k}") > 0).alias(f"d{k}") for k in range(len(wanted)))).first()
    average = figures["average"] or 1.0
    score = F.lit(0.0)
    for k in range(len(wanted)):
        weight = F.log1p(F.lit((figures["n"] - figures[f"d{k}"] + 0.5) / (figures[f"d{k}"] + 0.5)))
        n = F.col(f"__n{k}")
        score = score + F.when(n > 0, weight * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("__length") / average))).otherwise(0.0)
    return counted.select(*rest, "characters", (score + TITLE_BONUS * F.col("__titled")).alias("score"))


def ranked(scored: DataFrame, most: int) -> DataFrame:
    """The best chunks; if none scores above zero, the first ones by their number."""
    hits = scored.where("score > 0").orderBy(F.desc("score"), "chunk").limit(most)
    return scored.orderBy("chunk").limit(most) if hits.isEmpty() else hits


def diversified(scored: DataFrame, meetings: int = FIRST_MEETINGS) -> DataFrame:
    """Candidates with ``tier``: 0 for the best chunk of each of the best ``meetings`` meetings, 1 for the rest.

    Chunks that score nothing are candidates only if all do.
    """
    hits = scored.where("score > 0")
    candidates = scored if hits.isEmpty() else hits
    best = candidates.groupBy("meeting").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk")).alias("best"))
    first = best.orderBy("best").limit(meetings).select(F.col("best.chunk").alias("chunk"), F.lit(0).alias("tier"))
    return candidates.join(F.broadcast(first), "chunk", "left").withColumn("tier", F.coalesce("tier", F.lit(1)))


def select_within(candidates: DataFrame, budget: int, most: int = MOST) -> DataFrame:
    """candidates (chunk, tier, score, cost) chosen in order of tier, score and chunk, with ``number`` from 1.

    What does not fit is passed over and smaller ones may follow. Each round asks for the next candidates that
    still fit; at most ``most`` rows come back in all, so the rounds are few whatever the corpus.
    """
    chosen: list[tuple] = []
    left, behind = budget, None
    order = F.struct("tier", (-F.col("score")).alias("s"), "chunk")
    keyed = candidates.select("chunk", "cost", order.alias("at"))
    while len(chosen) < most:
        fitting = keyed.where(F.col("cost") <= left)
        if behind is not None:
            tier, score, chunk = behind
            fitting = fitting.where((F.col("at.tier") > tier) | ((F.col("at.tier") == tier) & ((F.col("at.s") > score) | ((F.col("at.s") == score) & (F.col("chunk") > chunk)))))
        found = fitting.orderBy("at").limit(most - len(chosen)).collect()
        if not found:
            break
        for row in found:
            if row["cost"] > left:
                break
            left -= row["cost"]
            behind = (row["at"]["tier"], row["at"]["s"], row["chunk"])
            chosen.append((row["chunk"], len(chosen) + 1))
    kind = dict(candidates.dtypes)["chunk"]
    return candidates.join(F.broadcast(candidates.sparkSession.createDataFrame(chosen, f"chunk {kind}, number int")), "chunk")


def passage_cost(*columns: str) -> Column:
    """Characters that a passage takes up in a prompt."""
    return F.length(F.to_json(F.struct(*columns))) + OVERHEAD


def coverage(chosen: DataFrame, searched: DataFrame) -> DataFrame:
    """How many meetings were searched and are included, and whether passages were left out. searched: chunk, meeting."""
    all_of = searched.agg(F.count_distinct("meeting").alias("searched_meetings"), F.count("*").alias("__all"))
    own = chosen.agg(F.count_distinct("meeting").alias("included_meetings"), F.count("*").alias("__own"))
    both = all_of.withColumn("k", F.lit(1)).join(own.withColumn("k", F.lit(1)), "k")
    return both.select("searched_meetings", "included_meetings", (F.col("__own") < F.col("__all")).alias("partial"))


def pack_lines(lines: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Lines (seq, size) with ``bin`` from 0: a bin is closed when the next line would take it beyond ``most``.

    A line larger than that has a bin of its own. The lines of one text are folded in order, inside the JVM.
    """
    sizes = F.array_sort(F.collect_list(F.struct("seq", "size")))
    empty = F.struct(F.array().cast("array<struct<seq:bigint,bin:int>>").alias("placed"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("used"))

    def place(state: Column, line: Column) -> Column:
        closes = (state["used"] > 0) & (state["used"] + line["size"] > most)
        number = state["bin"] + closes.cast("int")
        used = F.when(closes, line["size"]).otherwise(state["used"] + line["size"]).cast("long")
        return F.struct(F.concat(state["placed"], F.array(F.struct(line["seq"].cast("long").alias("seq"), number.alias("bin")))).alias("placed"), number.alias("bin"), used.alias("used"))

    return lines.groupBy(*keys).agg(F.aggregate(sizes, empty, place)["placed"].alias("placed")).select(*keys, F.inline("placed"))


def recent_messages(messages: DataFrame, keys: list[str], budget: int, most: int = 10) -> DataFrame:
    """The last messages (seq, text) of each chat that fit into ``budget`` characters together, up to the first that doesn't."""
    latest = W.partitionBy(*keys).orderBy(F.desc("seq"))
    sized = messages.withColumns({"__back": F.row_number().over(latest), "__used": F.sum(F.length("text")).over(latest.rowsBetween(W.unboundedPreceding, 0))})
    return sized.where((F.col("__back") <= most) & (F.col("__used") <= budget)).drop("__back", "__used")


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources (id, number, …) that an answer (id, answer) cites."""
    numbers = answers.select("id", F.explode(cited_numbers("answer")).alias("number")).distinct()
    return sources.join(numbers, ["id", "number"], "left_semi")


def keep_valid(ids: str, valid: str) -> Column:
    """An array without what is not valid and without repeats, in order."""
    return F.array_distinct(F.filter(ids, lambda x: F.array_contains(valid, x)))


def lines_of(text: str | Column) -> Column:
    return F.split(text, LINE_END)
