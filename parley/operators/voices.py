"""Voice vectors: means, comparison in blocks, assignment to people, verification figures, grouping.

Vectors are ARRAY<FLOAT> or ARRAY<DOUBLE> of one length. What is walked in order (greedy assignment, grouping) is walked within one
recording or one person, whose vectors are few; those groups go to Arrow grouped maps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from parley.functions.vectors import finite, top_mean, unit
from parley.sources.tables import durable

#: Least similarity to accept and to suggest a person, similarities that count, kept vectors of a person,
#: segments of a voice, their least and greatest length, and least similarities of one voice.
ACCEPT, SUGGEST, TOP, KEEP = 0.60, 0.45, 3, 20
SEGMENTS, SHORTEST, LONGEST, SAME_VOICE, LIVE_VOICE, VOICE_SECONDS = 12, 1.5, 20.0, 0.50, 0.55, 3.0

#: Vectors in a block of a comparison.
BLOCK = 2048


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[c] for c in names]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _length_one(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=-1, keepdims=True)


# ---------------------------------------------------------------- means


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """keys, ``mean`` (of length one; null if it is zero), n: the mean of each group's finite vectors, weighted if asked for.

    Components are summed position by position with partial sums, so a large group is no burden.
    """
    good = rows.where(finite(vector))
    factor = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = good.select(*keys, factor.alias("__w"), F.posexplode(vector).alias("__at", "__x"))
    sums = parts.groupBy(*keys, "__at").agg((F.sum(F.col("__x").cast("double") * F.col("__w")) / F.sum("__w")).alias("__x"), F.count("*").alias("n"))
    whole = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda p: p["__x"]).alias("__mean"), F.max("n").alias("n"))
    return whole.select(*keys, unit("__mean").alias("mean"), "n")


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sample deviation (null below two values) by key, from partial sums."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def chosen_segments(segments: DataFrame, keys: list[str], most: int = SEGMENTS, shortest: float = SHORTEST, longest: float = LONGEST) -> DataFrame:
    """The longest segments of each voice, those of at least ``shortest`` if there are any; cut to ``longest``."""
    length = F.col("end") - F.col("start")
    enough = F.count_if(length >= shortest).over(W.partitionBy(*keys)) > 0
    kept = segments.withColumn("__enough", enough).where(~F.col("__enough") | (length >= shortest))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(length.desc(), "start"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("end", F.least("end", F.col("start") + longest)).drop("__enough")


def enrolment_pieces(recordings: DataFrame, size: float = 8.0, least: float = 2.0) -> DataFrame:
    """Pieces of ``size`` seconds of recordings (id, seconds); a rest shorter than ``least`` is left out."""
    pieces = recordings.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("seconds") / size) - 1).cast("int"))))
    spans = pieces.withColumns({"start": F.col("piece") * size, "end": F.least(F.col("seconds"), (F.col("piece") + 1) * size)})
    return spans.where(F.col("end") - F.col("start") >= least)


# ---------------------------------------------------------------- comparison


def similarities(queries: DataFrame, library: DataFrame, k: int = TOP, least: float | None = None, apart: str | None = None, block: int = BLOCK) -> DataFrame:
    """query, person, score: mean of the ``k`` largest dot products between a query's vector and a person's.

    queries: query, embedding; library: person, embedding. With ``apart``, a column of both, only vectors with another value of it
    count. The library is cut into blocks by hash, so a person of very many vectors is no single task; queries, the stated smaller
    side, are sent to each block, where one matrix product compares them. A block answers with ``k`` numbers for each query and person.
    """
    extra = [apart] if apart else []
    count = library.count()
    blocks = max(1, -(-count // block))
    kind_q, kind_p = queries.schema["query"].dataType, library.schema["person"].dataType
    shape = T.StructType([T.StructField("query", kind_q), T.StructField("person", kind_p), T.StructField("best", T.ArrayType(T.DoubleType()))])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame([], columns=["query", "person", "best"], dtype=object)
        right = right.sort_values("person", kind="stable")
        scores = _matrix(left["q_embedding"]) @ _matrix(right["embedding"]).T
        if apart:
            scores = np.where(left[f"q_{apart}"].to_numpy()[:, None] != right[apart].to_numpy()[None, :], scores, -np.inf)
        people, first = np.unique(right["person"].to_numpy(), return_index=True)
        out = []
        for person, part in zip(people, np.split(scores, first[1:], axis=1)):
            top = -np.sort(-part, axis=1)[:, :k]
            out += [(q, person, row[row > -np.inf].tolist()) for q, row in zip(left["query"], top) if row[0] > -np.inf]
        return pd.DataFrame(out, columns=["query", "person", "best"])

    # By what the rows hold, so that a task that runs again deals them as before; equal rows share a block.
    spread = F.pmod(F.xxhash64(*(c for c in library.columns if c != "embedding")), F.lit(blocks)).cast("int")
    sides = library.withColumn("__block", spread).select("person", "embedding", *extra, "__block")
    # Own names keep the two sides apart where both come from one table.
    asked = queries.select("query", *(F.col(c).alias(f"q_{c}") for c in ("embedding", *extra))).withColumns({"__block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    parts = max(1, -(-queries.count() // block))  # so that a task's share of the queries does not grow with them
    asked = asked.withColumn("__part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
    sides = sides.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = asked.groupBy("__block", "__part").cogroup(sides.groupBy("__block", "__part")).applyInPandas(compare, shape)
    scored = found.groupBy("query", "person").agg(top_mean(F.flatten(F.collect_list("best")), k).alias("score"))
    return scored if least is None else scored.where(F.col("score") >= least)


def best_person(scores: DataFrame) -> DataFrame:
    """Each query's person of highest score; of equals the least."""
    return scores.groupBy("query").agg(F.max("score").alias("score"), F.min_by("person", F.struct((-F.col("score")).alias("s"), "person")).alias("person"))


def left_out_accuracy(voices: DataFrame, k: int = TOP) -> DataFrame:
    """voices (meeting, person, embedding) identified by the voices of other meetings: correct and total, by person.

    Each meeting's voice of a person is first reduced to its mean, so what is compared is one vector a person and meeting.
    """
    means = mean_vectors(voices, ["meeting", "person"]).where("mean is not null").select("meeting", "person", F.col("mean").alias("embedding"))
    queries = means.withColumn("query", F.struct("meeting", "person").cast("string"))
    found = best_person(similarities(queries, means, k, apart="meeting"))
    judged = queries.select("query", F.col("person").alias("truth")).join(found, "query")
    return judged.groupBy("truth").agg(F.count_if(F.col("person") == F.col("truth")).alias("correct"), F.count("*").alias("total"))


def left_out_segments(queries: DataFrame, voices: DataFrame, k: int = TOP) -> DataFrame:
    """The stated queries (vec_id, meeting, person, embedding), each a segment, identified by all voices of other meetings: correct and total,
    by person. A segment whose person no other meeting has is not judged, as none could name it."""
    found = best_person(similarities(queries.withColumn("query", F.col("vec_id")), voices, k, apart="meeting"))
    own = queries.select(F.col("vec_id").alias("query"), F.col("meeting").alias("__meeting"), F.col("person").alias("truth"))
    elsewhere = voices.groupBy("person").agg(F.min("meeting").alias("__low"), F.max("meeting").alias("__high")).withColumnRenamed("person", "__person")
    known = own.join(elsewhere, F.col("truth") == F.col("__person")).where((F.col("__low") != F.col("__meeting")) | (F.col("__high") != F.col("__meeting"))).select("query", "truth")
    return known.join(found, "query").groupBy("truth").agg(F.count_if(F.col("person") == F.col("truth")).alias("correct"), F.count("*").alias("total"))


def split_ids(parts: DataFrame, keys: list[str], cluster: str = "cluster", voice: str = "voice", start: str = "start") -> DataFrame:
    """keys, cluster, voice, id of the voices that clusters were split into (parts, with their starts): the voice heard first keeps its
    cluster's id, the others are <cluster>_2, <cluster>_3 and so on in order of their first part, past ids that other clusters have."""
    first = parts.groupBy(*keys, cluster, voice).agg(F.min(start).alias("__start"))
    names = first.groupBy(*keys).agg(F.collect_set(cluster).alias("__names"))  # a recording's clusters, which are few
    rank = F.row_number().over(W.partitionBy(*keys, cluster).orderBy("__start", voice))
    joined = first.withColumn("__rank", rank).join(names, keys)
    free = F.filter(F.sequence(F.lit(2), F.col("__rank") + F.size("__names") + 1), lambda k: ~F.array_contains("__names", F.concat(cluster, F.lit("_"), k.cast("string"))))
    name = F.when(F.col("__rank") == 1, F.col(cluster)).otherwise(F.concat(cluster, F.lit("_"), F.get(free, F.col("__rank") - 2).cast("string")))
    return joined.select(*keys, cluster, voice, name.alias("id"))


def _compared(queries: DataFrame, voices: DataFrame, shape: str, told: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """What ``told`` makes of the pairs of a block of queries and a block of voices, given as places in both and scores. Pairs of one meeting
    and, of two queries, the one in which the greater id asks, are left out within the block, so no pair is shuffled."""
    columns = ("vec_id", "meeting", "person", "embedding")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({field.split()[0]: [] for field in shape.split(", ")})
        scores = _matrix(left["q_embedding"]) @ _matrix(right["embedding"]).T
        apart = left["q_meeting"].to_numpy()[:, None] != right["meeting"].to_numpy()[None, :]
        twice = right["__known"].to_numpy(bool)[None, :] & (left["q_vec_id"].to_numpy()[:, None] > right["vec_id"].to_numpy()[None, :])
        a, b = np.nonzero(apart & ~twice)
        return told(left, right, a, b, scores[a, b])

    known = queries.select(F.col("vec_id").alias("__id")).distinct().withColumn("__known", F.lit(True))
    library = voices.select(*columns)
    library = library.join(known, library["vec_id"] == known["__id"], "left").drop("__id").withColumn("__known", F.coalesce("__known", F.lit(False)))
    blocks, parts = (max(1, -(-rows.count() // BLOCK)) for rows in (voices, queries))
    sides = library.withColumn("__block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Own names keep the two sides apart where both come from one table.
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in columns)).withColumn("__part", F.pmod(F.xxhash64("q_vec_id"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy("__block", "__part").cogroup(sides.groupBy("__block", "__part")).applyInPandas(compare, shape)


def verification_scores(queries: DataFrame, voices: DataFrame) -> DataFrame:
    """query, other, genuine, score for the stated queries against all voices of other meetings.

    Both have vec_id, meeting, person, embedding. A pair of two queries comes once.
    """

    def pairs(left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        genuine = left["q_person"].to_numpy()[a] == right["person"].to_numpy()[b]
        return pd.DataFrame({"query": left["q_vec_id"].to_numpy()[a], "other": right["vec_id"].to_numpy()[b], "genuine": genuine, "score": scores})

    return _compared(queries, voices, "query long, other long, genuine boolean, score double", pairs)


def verification_counts(queries: DataFrame, voices: DataFrame, digits: int = 6) -> DataFrame:
    """score, g, i: genuine and other pairs of ``verification_scores`` by score, rounded (halves away from zero). Blocks send counts, so what is
    shuffled is bounded by the number of different scores, not of pairs."""
    scale = 10.0**digits

    def counts(left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        genuine = left["q_person"].to_numpy()[a] == right["person"].to_numpy()[b]
        values, at = np.unique(np.sign(scores) * np.floor(np.abs(scores) * scale + 0.5) / scale + 0.0, return_inverse=True)
        g, every = np.bincount(at[genuine], minlength=len(values)), np.bincount(at, minlength=len(values))
        return pd.DataFrame({"score": values, "g": g, "i": every - g})

    return _compared(queries, voices, "score double, g long, i long", counts).groupBy("score").agg(F.sum("g").alias("g"), F.sum("i").alias("i"))


def verification(scores: DataFrame, far_target: float = 0.01, parts: int = 64) -> DataFrame:
    """One row of figures for scores (genuine, score), as ``verification_figures`` gives them."""
    each = scores.groupBy("score").agg(F.count_if("genuine").alias("g"), F.count_if(~F.col("genuine")).alias("i"))
    return verification_figures(each, far_target, parts)


def verification_figures(counts: DataFrame, far_target: float = 0.01, parts: int = 64) -> DataFrame:
    """One row of figures for counts (score, g, i): eer, eer_threshold, threshold_far, frr_at_far, the means and the counts.

    A threshold accepts scores at or above it. Equal error is where false accepts and false rejects differ least, at the
    least such threshold; threshold_far is the least one at which at most ``far_target`` of impostors pass, else the
    largest score. Running counts are made range by range, from counts that are made once.
    """
    from parley.operators.common import running_totals

    each = durable(counts.withColumn("score", F.col("score") + F.lit(0.0)))  # as a value of its own it brings no partitioning with it
    run = running_totals(each, "score", ["g", "i"], parts)
    means = [(F.sum(F.when(F.col(n) > 0, F.col("score") * F.col(n))) / F.nullif(F.sum(n), F.lit(0))).alias(name) for n, name in (("g", "genuine_mean"), ("i", "impostor_mean"))]
    sums = each.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n_genuine"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_impostor"), *means).first()
    one = F.lit(1)
    far = 1 - (F.col("before_i") / F.greatest(F.lit(sums["n_impostor"]), one))
    frr = F.col("before_g") / F.greatest(F.lit(sums["n_genuine"]), one)
    rated = run.select("score", far.alias("far"), frr.alias("frr"))
    passing = F.col("far") <= far_target
    best = rated.agg(
        F.min_by(F.struct("score", "far", "frr"), F.struct(F.abs(F.col("far") - F.col("frr")).alias("d"), "score")).alias("e"),
        F.coalesce(F.min_by(F.struct("score", "frr"), F.when(passing, F.col("score"))), F.max_by(F.struct("score", "frr"), "score")).alias("t"),
    )
    return best.select(
        ((F.col("e.far") + F.col("e.frr")) / 2).alias("eer"), F.col("e.score").alias("eer_threshold"), F.col("t.score").alias("threshold_far"), F.col("t.frr").alias("frr_at_far"),
        *(F.lit(sums[c]).cast("double").alias(c) for c in ("genuine_mean", "impostor_mean")), *(F.lit(sums[c]).cast("long").alias(c) for c in ("n_genuine", "n_impostor")),
    )


# ---------------------------------------------------------------- assignment


def match_voices(voices: DataFrame, scores: DataFrame, accept: float = ACCEPT, suggest: float = SUGGEST) -> DataFrame:
    """Each recording's voices with at most one person each, and each person with at most one voice.

    voices: meeting, cluster, seq (order of first speech); scores: meeting, cluster, person, score. Pairs are taken by
    falling score (then seq, then person) if both are still free and the score is at least ``suggest``. Returns meeting, cluster, person, score,
    status (auto, suggested, unknown) and unknown_label ('Unknown speaker n', in order of speech, if not auto). The
    score of an unknown voice is its best one. Pairs too low to be taken never reach the walk.
    """
    best = scores.groupBy("meeting", "cluster").agg(F.max("score").alias("best"))
    taken_from = scores.where(F.col("score") >= suggest).join(voices.select("meeting", "cluster", "seq"), ["meeting", "cluster"])
    shape = T.StructType(_fields(taken_from, "meeting", "cluster", "person", "score"))

    def walk(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(["score", "seq", "person"], ascending=[False, True, True])
        used: set = set()
        keep = []
        for cluster, person in pairs[["cluster", "person"]].itertuples(index=False):
            free = ("c", cluster) not in used and ("p", person) not in used
            keep.append(free)
            if free:
                used |= {("c", cluster), ("p", person)}
        return pairs[keep][["meeting", "cluster", "person", "score"]]

    matched = taken_from.groupBy("meeting").applyInPandas(walk, shape)
    joined = voices.join(matched, ["meeting", "cluster"], "left").join(best, ["meeting", "cluster"], "left")
    status = F.when(F.col("score") >= accept, "auto").when(F.col("score").isNotNull(), "suggested").otherwise("unknown")
    stated = joined.withColumn("status", status).withColumn("score", F.round(F.coalesce("score", "best"), 4))
    nth = F.sum((F.col("status") != "auto").cast("int")).over(W.partitionBy("meeting").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return stated.withColumn("unknown_label", F.when(F.col("status") != "auto", F.concat(F.lit("Unknown speaker "), nth))).drop("best")


# ---------------------------------------------------------------- walks within one person or recording


def _grouped(rows: DataFrame, keys: list[str], name: str, kind: T.DataType, walk: Callable[[np.ndarray], list], order: str) -> DataFrame:
    """keys, ``order`` column and what ``walk`` says of each of a group's vectors, in their order."""
    shape = T.StructType([*_fields(rows, *keys, order), T.StructField(name, kind)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group[[*keys, order]].assign(**{name: walk(_matrix(group["embedding"]))})

    return rows.where(finite("embedding")).select(*keys, order, "embedding").groupBy(*keys).applyInPandas(run, shape)


def redundancy(rows: DataFrame, keys: list[str], order: str = "vec_id") -> DataFrame:
    """Each vector's mean similarity to the others of its group; null if there are none.

    The others' sum is the sum of all less the vector itself, so no pairs are made.
    """
    parts = rows.select(*keys, order, F.posexplode("embedding").alias("__at", "__x")).withColumn("__x", F.col("__x").cast("double"))
    sums = parts.groupBy(*keys, "__at").agg(F.sum("__x").alias("__sum"), F.count("*").alias("__n"))
    others = parts.join(sums, [*keys, "__at"]).withColumn("__part", F.col("__x") * (F.col("__sum") - F.col("__x")))
    return others.groupBy(*keys, order).agg((F.sum("__part") / F.nullif(F.max("__n") - 1, F.lit(0))).alias("redundancy"))


def _prune(m: np.ndarray, keep: int) -> list[bool]:
    alive = np.ones(len(m), bool)
    rest = m @ m.T
    np.fill_diagonal(rest, 0.0)
    sums = rest.sum(axis=1)
    for _ in range(len(m) - keep):
        mean = np.where(alive, sums, -np.inf)
        mean[-1] = -np.inf  # the newest stays
        worst = int(mean.argmax())
        alive[worst] = False
        sums = sums - rest[worst]
    return alive.tolist()


def prune(rows: DataFrame, keys: list[str], keep: int = KEEP, order: str = "vec_id") -> DataFrame:
    """keys, ``order``, kept: a person's vectors without the most redundant ones, down to ``keep``; the newest always stays.

    Redundancy is judged anew after each removal.
    """
    return _grouped(rows, keys, "kept", T.BooleanType(), lambda m: _prune(m, keep), order)


def _linkage(m: np.ndarray, least: float) -> list[int]:
    sums = m @ m.T
    size = np.ones(len(m))
    label = np.arange(len(m))
    while len(size) > 1:
        mean = sums / np.outer(size, size)
        mean[np.tril_indices(len(size))] = -np.inf
        a, b = np.unravel_index(int(mean.argmax()), mean.shape)
        if not mean[a, b] > least:
            break
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sums, size = np.delete(np.delete(sums, b, 0), b, 1), np.delete(np.where(np.arange(len(size)) == a, size[a] + size[b], size), b)
        label = np.where(label == b, a, label - (label > b))
    seen: dict[int, int] = {}
    return [seen.setdefault(int(x), len(seen)) for x in label]


def average_linkage(rows: DataFrame, keys: list[str], least: float, order: str = "vec_id") -> DataFrame:
    """keys, ``order``, cluster: groups of unit vectors merged while two have a mean similarity above ``least``; numbered by
    first member. Similarities between groups are kept as sums over their members' pairs."""
    return _grouped(rows, keys, "cluster", T.IntegerType(), lambda m: _linkage(m, least), order)


def _leaders(m: np.ndarray, least: float, later: bool = True) -> list[int]:
    """Each vector's group; of groups equally near the ``later`` or the earlier one."""
    sums: list[np.ndarray] = []
    out = []
    for v in m:
        scores = [float(s @ v / (np.linalg.norm(s) or 1.0)) for s in sums]
        best = max(range(len(scores)), key=lambda k: (scores[k], k if later else -k), default=-1)
        if best >= 0 and scores[best] >= least:
            sums[best] = sums[best] + v
        else:
            best = len(sums)
            sums.append(v.copy())
        out.append(best)
    return out


def online_speakers(rows: DataFrame, keys: list[str], least: float = LIVE_VOICE, order: str = "vec_id") -> DataFrame:
    """keys, ``order``, speaker ('Speaker n'): each vector in order joins the group whose sum is nearest, of equals the later,
    if that is at least ``least`` similar; else it begins one."""
    found = _grouped(rows, keys, "number", T.IntegerType(), lambda m: _leaders(m, least), order)
    return found.select(*keys, order, F.concat(F.lit("Speaker "), F.col("number") + 1).alias("speaker"))


def _split(windows: pd.DataFrame, same: float, seconds: float) -> list[int]:
    m, length = _matrix(windows["embedding"]), windows["seconds"].to_numpy(float)
    named = windows["known"].notna().to_numpy()
    # A window that is near a known person is that person's; the others are grouped in order.
    label: list = [("person", x) if k else None for k, x in zip(named, windows["known"])]
    for k, number in zip(np.flatnonzero(~named), _leaders(m[~named], same, later=False)):
        label[k] = ("voice", number)
    major = [x for x in dict.fromkeys(label) if length[[y == x for y in label]].sum() >= seconds]
    groups = [(x[0] == "person", m[[y == x for y in label]]) for x in major]
    while len(groups) > 1:
        centres = _length_one(np.stack([g.mean(axis=0) for _, g in groups]))
        near = centres @ centres.T
        near[np.tril_indices(len(groups))] = -np.inf
        known = np.array([k for k, _ in groups])
        near[np.outer(known, known)] = -np.inf  # two known people are never one
        a, b = np.unravel_index(int(near.argmax()), near.shape)
        if near[a, b] < same:
            break
        person, taken = groups.pop(b)
        groups[a] = (groups[a][0] or person, np.concatenate((groups[a][1], taken)))
    if len(groups) < 2:
        return [0] * len(m)
    found = (m @ _length_one(np.stack([g.mean(axis=0) for _, g in groups])).T).argmax(axis=1)
    segment = windows["segment"].to_numpy()
    for k in range(1, len(found) - 1):
        if segment[k - 1] == segment[k] == segment[k + 1] and found[k - 1] == found[k + 1]:
            found[k] = found[k - 1]
    return found.tolist()


def split_voices(windows: DataFrame, keys: list[str], same: float = SAME_VOICE, seconds: float = VOICE_SECONDS) -> DataFrame:
    """keys, seq, voice: windows (seq, segment, seconds, embedding and, if there is that column, ``known``, the person that the window was
    recognised as) of one supposed voice, told apart where it is several.

    A known person's windows are a group, the others are grouped in order, of groups equally near the first. Groups of at least
    ``seconds`` count as voices; near ones are merged, but never two known people; every window joins the nearest, and a lone one between
    two of another in its segment follows those. With fewer than two voices all are voice 0.
    """
    if "known" not in windows.columns:
        windows = windows.withColumn("known", F.lit(None).cast("string"))
    shape = T.StructType([*_fields(windows, *keys, "seq"), T.StructField("voice", T.IntegerType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        return group[[*keys, "seq"]].assign(voice=_split(group, same, seconds))

    return windows.where(finite("embedding")).select(*keys, "seq", "segment", "seconds", "embedding", "known").groupBy(*keys).applyInPandas(run, shape)


def solo_share(spans: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` labels with most time of each recording, with their share of it."""
    total = spans.groupBy(*keys, "label").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("seconds"), "label"))
    share = F.round(F.col("seconds") / F.sum("seconds").over(W.partitionBy(*keys)), 4)
    return total.withColumns({"rank": rank, "share": share}).where(F.col("rank") <= most).drop("rank")


def active_slots(frames: DataFrame, keys: list[str], most: int, least: float = 0.5) -> DataFrame:
    """The ``most`` speaker slots of each recording with most activity, of frames (slot, activity) at or above ``least``."""
    total = frames.groupBy(*keys, "slot").agg(F.sum(F.when(F.col("activity") >= least, F.col("activity")).otherwise(0.0)).alias("activity"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("activity"), "slot"))
    return total.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("activity") > 0)).drop("rank")


def usable(vector: str | Column) -> Column:
    return finite(vector)
