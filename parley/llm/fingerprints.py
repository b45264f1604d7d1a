"""Threshold-scaled sketches: all shingle hashes below a fixed fraction of their range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Memo, map_arrow, mixed, raw_texts, shingle_hashes, signed, slices, table, whole_text, word_hashes, word_memo

#: Words of a shingle, and one in how many shingle hashes stays.
WIDTH, SCALE = 5, 8

#: Most ranges of ids into which the table is dealt to find each document's neighbour. A range is read as a stream, so
#: memory does not grow with it; beyond this many ranges only the parallelism is bounded.
MOST_RANGES = 4096


def sketch(raw: bytes, memo: Memo, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, int]:
    """Distinct shingle hashes below 1 / ``scale`` of their range, sorted, and a number that names the whole set of shingles.

    Sketches merge: the union of two is the sketch of both texts' shingles together.
    """
    hashes = np.unique(shingle_hashes(word_hashes(raw, memo), width))
    with np.errstate(over="ignore"):
        name = int(mixed(hashes, 21).sum(dtype=np.uint64)) if len(hashes) else 0
    return hashes[: np.searchsorted(hashes, np.uint64((1 << 64) // scale))], name


def written(own: tuple[np.ndarray, int]) -> str:
    """The set's name and the hashes, as 16 hexadecimal digits each."""
    return f"{own[1]:016x}" + own[0].astype(">u8").tobytes().hex()


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Estimated Jaccard similarity. Where neither has a hash below the fraction, only equal sets are alike."""
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    either = len(a[0]) + len(b[0]) - both
    return both / either if either else float(a[1] == b[1])


def containment(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Estimated share of the first one's shingles that the second has. A first one without a hash is contained in its equal only."""
    return len(np.intersect1d(a[0], b[0], assume_unique=True)) / len(a[0]) if len(a[0]) else float(a[1] == b[1])


def sketch_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id and sketch (array of longs) for each row of ``df``; use with ``contained`` and ``merged``.

    A null or empty text, or one without words, has an empty sketch, and so may a short one; one of fewer words than ``width`` is
    one shingle.
    Repeated rows and null ids are kept; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in slices(batches, "text"):
            yield table(schema, batch.column("doc_id"), [signed(sketch(x, memo, width, scale)[0]) for x in raw_texts(batch.column("text"))])
            memo.trim()

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return map_arrow(rows, run, "doc_id long, sketch array<long>")


def contained(a: str, b: str) -> Column:
    """Estimated share of the first sketch's shingles that the second has; 1 for an empty first one."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str, b: str) -> Column:
    """The sketch of both sketches' shingles together."""
    return F.array_union(a, b)


def neighbours(df: DataFrame, rows_per_range: int) -> DataFrame:
    """The rows, dealt into ranges of ids and sorted by descending id in each, so that a row's successor follows it.

    The first row of the range below comes again at each range's end (the highest range's at the lowest's), marked as a
    copy. Ids and counts alone tell the ranges; at most MOST_RANGES pairs of numbers come to the driver.
    """
    ids = df.select("at")
    count = ids.count()
    ranges = max(1, min(MOST_RANGES, count // rows_per_range))
    cuts = []
    if ranges > 1:
        shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
        cuts = sorted(set(ids.agg(F.percentile_approx("at", shares, F.lit(20 * ranges))).first()[0]))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[k : k + step] for k in range(0, len(cuts), step)]

    def below(values: Column, at: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < at))

    if cuts:  # the number of cuts below the id, found in two steps
        group = below(F.array(*map(F.lit, coarse)), F.col("at"))
        member = F.get(F.array(*(F.array(*map(F.lit, f)) for f in fine)), group - 1)
        place = F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + below(member, F.col("at")))
    else:
        place = F.lit(0)
    df = df.withColumn("range", place)
    heads = sorted((r["range"], r["at"]) for r in df.select("range", "at").groupBy("range").agg(F.max("at").alias("at")).collect())
    # The head of each range goes to the next higher range's end, the highest one's to the lowest range.
    moves = [(at, heads[(k + 1) % len(heads)][0]) for k, (_, at) in enumerate(heads)]
    goals = df.sparkSession.createDataFrame(moves, "at long, goal int")
    copies = F.when(F.col("goal").isNull(), F.array(F.struct("range", F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct("range", F.lit(False).alias("copy")), F.struct(F.col("goal").alias("range"), F.lit(True).alias("copy")))
    )
    dealt = df.join(F.broadcast(goals), "at", "left").select("at", "doc_id", "text", F.explode(copies).alias("to")).select("at", "doc_id", "text", "to.range", "to.copy")
    dealt = dealt.withColumn("tie", F.xxhash64("text"))
    return dealt.repartition("range").sortWithinPartitions("range", "copy", F.desc("at"), "tie").select("range", "copy", "doc_id", "text")


def edited_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, scale: int = SCALE, rows_per_range: int = 512) -> DataFrame:
    """Fingerprints of each row's text and of its edited text: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, in_edited, edited_in, in_next, next_in.

    near_* are estimates of Jaccard similarity, in_* of the share of the document's shingles that the other text has, *_in of the share of
    the other text's shingles that the document has; the latter two hold for texts of very unequal lengths.

    The edited text's last n_chars // 2 code points are the next document's first ones. Documents follow by descending
    id, null ids last and by a hash of the text, equal ids by that hash; the first follows the last. Null texts count as empty. Repeated
    rows are kept; other columns are not read.
    """
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    estimates = ("near_edited", "near_next", "in_edited", "edited_in", "in_next", "next_in")
    schema = pa.schema(fields + [("edited_fingerprint", pa.string()), *((c, pa.float64()) for c in estimates)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last = word_memo(), None
        for batch in slices(batches, "text", 8 << 20):
            rows = []
            for part, copy, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "copy", "doc_id", "text"))):
                own = sketch(text.encode(), memo, width, scale)
                if last is not None and last[0] == part and not last[1]:
                    _, _, before, earlier, theirs = last
                    half = len(earlier) // 2
                    edited = (earlier[: len(earlier) - half] + text[:half]).encode()
                    changed = sketch(edited, memo, width, scale)
                    found = (likeness(theirs, changed), likeness(theirs, own), containment(theirs, changed), containment(changed, theirs), containment(theirs, own), containment(own, theirs))
                    rows.append((before, len(earlier), hashlib.sha256(edited).hexdigest(), written(theirs), written(changed), *found))
                last = (part, copy, doc, text, own)
            if rows:
                yield table(schema, *zip(*rows, strict=True))
            memo.trim()

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    # Rows without id are spread over the lowest 2 ** 40 numbers, so that they needn't share a range.
    spread = F.lit(-(1 << 63)) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rows = rows.withColumn("at", F.coalesce("doc_id", spread)).select("at", "doc_id", "text")
    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, " + ", ".join(f"{c} double" for c in estimates)
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], shape)
    return map_arrow(neighbours(rows, rows_per_range), run, shape)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
