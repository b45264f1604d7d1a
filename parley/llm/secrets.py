"""Secret scans: candidates by pattern, judged by how many distinct owners and repositories hold the same value."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import durable, hot_join, map_arrow, slices, whole_text

#: Kinds in the order in which spans with one start are listed: those of the patterns, then those of the verdicts.
KINDS = ("assign", "access", "hex", "live", "example")

#: The patterns, and how long a match must be.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: From how many characters on a value needs no digits to look like a credential, and how mixed it must be (bits a character).
LONG_VALUE, LEAST_ENTROPY = 12, 2.5

#: What counts as holding a value.
HOLDERS = ("owners", "repositories", "texts")

#: Values that nobody would use in earnest.
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|your|xxxx|test|placeholder|(.)\1{5}")


def find(text: str) -> list[tuple[int, int, int, int, int]]:
    """Kind, start and end of each match, start and end of its value; in order of start, then kind."""
    found = [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def looks_live(value: str) -> bool:
    """Whether a value is mixed enough for a credential, and no placeholder; a short one needs both letters and digits."""
    if PLACEHOLDER.search(value):
        return False
    if len(value) < LONG_VALUE and not (any(map(str.isdigit, value)) and any(map(str.isalpha, value))):
        return False
    counts = Counter(value)
    return -sum(n / len(value) * log2(n / len(value)) for n in counts.values()) >= (LEAST_ENTROPY if len(value) >= LONG_VALUE else LEAST_ENTROPY - 0.5)


def candidates(df: DataFrame, id_column: str, owner_column: str, repository_column: str, text_column: str) -> DataFrame:
    """One row for each row: counts by kind, the matches' spans, and the distinct candidate values with their hashes.

    Values leave the task as hashes only.
    """
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    value = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())])
    kept = ("row_id", "doc_id", "owner", "repository", "text_key")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    schema = pa.schema([*zip(kept, types), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("base", pa.list_(span)), ("found", pa.list_(value))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            counts, shas, base, found = ([], [], []), [], [], []
            for text in batch.column("text").to_pylist():
                spans = find(text)
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in spans))
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans).encode()).hexdigest())
                base.append([{"start": a, "kind": k, "end": b} for k, a, b, *_ in spans])
                values = {(a, b): text[a:b] for *_, a, b in spans}
                found.append([{"start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "live": looks_live(v)} for (a, b), v in values.items()])
            columns = [batch.column(c) for c in kept] + [*counts, shas, base, found]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_column).cast("long").alias("doc_id"), F.col(owner_column).cast("string").alias("owner"), F.col(repository_column).cast("string").alias("repository"), F.xxhash64(whole_text(text_column)).alias("text_key"), whole_text(text_column).alias("text")
    )
    shape = "row_id long, doc_id long, owner string, repository string, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string"
    return map_arrow(rows, run, shape + ", base array<struct<start int, kind int, end int>>, found array<struct<start int, end int, hash string, live boolean>>")


def ownership(values: DataFrame) -> DataFrame:
    """hash, n, owners, repositories, texts: in how many rows a value stands, and how many distinct owners, repositories (of an owner) and
    texts hold it, over all rows.

    Repeats are removed before anything is counted by value, and then by partial counts, so a value that fills a third of the corpus meets
    in one row per task. A row without owner counts as the owner ''.
    """
    named = values.withColumns({c: F.coalesce(c, F.lit("")) for c in ("owner", "repository")})
    pairs = named.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    held = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    texts = named.groupBy("hash", "text_key").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("texts"))
    return held.join(texts, "hash")


def listed(spans: Column) -> Column:
    """'kind:start:end' joined by commas, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(
    df: DataFrame, id_column: str = "doc_id", owner_column: str = "source", repository_column: str = "doc_id", text_column: str = "text", example_owners: int = 3, example_repositories: int = 20
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_live, n_example, most_owners, most_repositories, most_texts, base (spans), judged
    (spans) and spans.

    Matches of the patterns are the base. Every value found is counted over all rows of the corpus: one that at least ``example_owners``
    owners hold, or two at least in ``example_repositories`` repositories, is widely copied, an ``example``; any other one that looks
    like a credential is ``live``, and one owner's value is so in however many of its repositories. Both are added as spans of the value;
    most_owners, most_repositories and most_texts (distinct ones) are the largest counts of the row's values, 0 without values. A null or empty text has no spans, a null owner is an owner of its own, repeated rows are kept, and other
    columns are not read. Offsets are code points.
    """
    rows = durable(candidates(df, id_column, owner_column, repository_column, text_column))
    values = rows.select("row_id", "owner", "repository", "text_key", F.explode("found").alias("v")).select("row_id", "owner", "repository", "text_key", "v.*")
    counts = durable(ownership(values))
    known = hot_join(values.select("row_id", "hash", "start", "end", "live"), counts, "hash", values.count())
    example = (F.col("owners") >= example_owners) | (F.col("owners") >= 2) & (F.col("repositories") >= example_repositories)
    known = known.withColumn("kind", F.when(example, KINDS.index("example")).when(F.col("live"), KINDS.index("live")))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    judged = known.groupBy("row_id").agg(F.collect_list(span).alias("judged"), *(F.max(c).alias(f"most_{c}") for c in HOLDERS))
    none = F.array().cast("array<struct<start int, kind int, end int>>")
    with_values = rows.where(F.size("found") > 0).join(judged, "row_id", "left").withColumn("judged", F.coalesce("judged", none))
    without = rows.where(F.size("found") == 0).withColumn("judged", none).withColumns({c: F.lit(0).cast("long") for c in (f"most_{h}" for h in HOLDERS)})
    all_rows = with_values.drop("found").unionByName(without.drop("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("judged", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return all_rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", count("live"), count("example"), *(f"most_{c}" for c in HOLDERS), "base", "judged", listed(F.concat("base", "judged")).alias("spans"))


def redact_live(df: DataFrame, id_column: str = "doc_id", owner_column: str = "source", text_column: str = "text", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """``df`` with each live credential's value replaced by '[secret]'; all rows and columns stay.

    Values that overlap are replaced together, and nothing beside them. Rows are matched by id and text, so ids may repeat; rows
    without live values, null and empty texts pass through as they are.
    """
    marked = df.withColumn("__row_key", F.xxhash64(F.coalesce(F.col(id_column).cast("long"), F.lit(-1)), whole_text(text_column)))
    spans = scan_secrets(marked, "__row_key", owner_column, id_column, text_column, **options).where("n_live > 0")
    live = F.filter("judged", lambda s: s["kind"] == KINDS.index("live"))
    spans = durable(spans.select(F.col("doc_id").alias("__row_key"), F.array_sort(live).alias("__live")).dropDuplicates(["__row_key"]))
    joined = marked.join(F.broadcast(spans) if spans.count() <= broadcast_rows else spans, "__row_key", "left")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def replace(state: Column, s: Column) -> Column:
        before = F.substr(F.col(text_column), state["at"] + 1, s["start"] - state["at"])
        fresh = F.concat(state["done"], before, F.lit("[secret]"))  # a span that begins within the last one only moves its end
        done = F.when(s["start"] >= state["at"], fresh).otherwise(state["done"])
        return F.struct(done.alias("done"), F.greatest(state["at"], s["end"]).alias("at"))

    redacted = F.aggregate("__live", start, replace, lambda state: F.concat(state["done"], F.substr(F.col(text_column), state["at"] + 1)))
    return joined.withColumn(text_column, F.when(F.col("__live").isNotNull(), redacted).otherwise(F.col(text_column))).select(df.columns)


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("base", "judged")
