"""Totals in a global order, without one task that holds everything; walks through rows in order, in constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a part of ``spread`` has about.
SHARE = 100_000


def running_totals(df: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """``df`` with ``before_<column>``: the column's sum over all rows of lesser ``order``, whose values must be distinct.

    Rows are dealt into ranges of about equal counts; totals within a range are moved up by those of the ranges below, of
    which there are at most ``parts``.
    """
    cuts = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], F.lit(20 * parts))).first()[0]
    cuts = sorted(set(cuts or []))
    ranged = df.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order)))) if cuts else df.withColumn("__range", F.lit(0))
    below = W.partitionBy("__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    lower = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    starts = sums.select("__range", *(F.coalesce(F.sum(f"__{c}").over(lower), F.lit(0)).alias(f"__{c}") for c in columns))
    joined = ranged.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in columns}).join(F.broadcast(starts), "__range")
    return joined.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"__{c}") for c in columns}).drop("__range", *(f"__{c}" for c in columns))


def spread(rows: DataFrame, keys: list[str], count: int, share: int = SHARE) -> DataFrame:
    """Rows dealt by key into as many parts as ``count`` rows need at ``share`` rows a part, so that what a task sorts does not grow with
    the table; the number is not lowered at run time as that of other shuffles is."""
    return rows.repartition(parts_for(count, share), *keys)


def parts_for(count: int, share: int = SHARE) -> int:
    return max(1, -(-count // share))


class Walk:
    """What a walk over one key's rows in order keeps, and what it tells; subclasses are pickled as they are as a stream's state."""

    def row(self, *values) -> list[tuple]:
        """Rows that this one gives rise to."""
        raise NotImplementedError

    def end(self) -> list[tuple]:
        """What is still to be told when no more rows come."""
        return []

    def waiting(self) -> bool:
        """Whether something is held back that time alone lets out."""
        return False


def walked(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Walk], schema: T.StructType) -> DataFrame:
    """``keys`` and the columns of ``schema``: each key's rows go in order of ``order`` through a ``Walk``, which gets their ``columns``.

    Rows are dealt by key and sorted; a task streams through them and holds one walk's state and one batch, however many rows
    a key has. Null keys are a key like others.
    """
    whole = T.StructType([*(rows.schema[k] for k in keys), *schema.fields])
    arrow, width = to_arrow_schema(whole), len(keys)
    names = [f"__k{i}" for i in range(width)] + [f"__c{i}" for i in range(len(columns))]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*(F.col(k).alias(n) for k, n in zip([*keys, *columns], names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, out = None, None, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            for values in zip(*(batch.column(n).to_pylist() for n in names)):
                key = values[:width]
                if own is None or key != now:
                    if own is not None:
                        out += [(*now, *r) for r in own.end()]
                    own, now = start(), key
                out += [(*key, *r) for r in own.row(*values[width:])]
            if out:
                yield told()
                out = []
        if own is not None:
            out += [(*now, *r) for r in own.end()]
        if out:
            yield told()

    return ordered.mapInArrow(run, whole)
