"""Hard negatives by inner product, from lists that clusters of anchors share.

Anchors are clustered by angle. If an anchor lies within ``spread`` of its cluster's
centre and a candidate at the angle ``a`` of it, their inner product is at most
|anchor| |candidate| cos(max(0, a - spread)): without the anchor's length this angular
upper bound is the same for the whole cluster. So each cluster has one list, its
candidates by falling bound, and every member walks it from the top until its bound
falls below what could still enter the member's answer. From there on nothing can, so
the answer is exact, whatever the clusters look like.

Spark deals the lists out. Bounds are rounded up to 256 steps and stored with each
candidate, one byte per cluster. The heads of all lists (the highest steps, counted
first) go to the members, which then know how far they must read; only what reaches that
bound is sent after, in segments of bounded size that are walked side by side. Clusters
of many members are cut into parts. Vectors without clusters must read on to the end:
then all candidates pass by all anchors in blocks, and no exact method reads less.

Positives are found in the first search (same label), negatives in the second (another
label, scores within a band below each positive).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stored

#: Steps of the stored bounds.
_STEPS = 256
#: Added to each cosine, far above what rounding takes away.
_SLACK = 1e-6
_ROW = "id long, copy int, label long, v binary"


@dataclass(frozen=True)
class Lists:
    """Sizes of the clustered lists; every number is a parameter."""

    members: int = 1024  # anchors per cluster that are aimed at
    clusters: int = 256  # clusters at most
    part: int = 4096  # anchors that walk together
    head: int = 4096  # candidates in the head of a list
    segment: int = 8192  # candidates per task of a walk
    sample: int = 4096  # anchors and candidates that centres and steps are fitted on
    rounds: int = 10
    seed: int = 13


def usable(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, copy, label, v): whole vectors floor(scale * x), stored; rows that take no part are gone.

    ``copy`` numbers the different rows of one id. Kept are rows with an id, a label and
    a finite vector with the most common number of components (of several the smallest)
    whose scaled length is below 2^31, so that inner products are 64-bit numbers.
    """
    x = F.col(vector)
    df = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    df = df.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    df = df.filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))))
    small = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")) * scale * scale < float(1 << 62) * 0.999
    df = df.filter(small)
    width = df.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return df.select("id", F.lit(0).alias("copy"), "label", F.lit(b"").alias("v"))

    @F.pandas_udf("binary")
    def whole(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.floor(np.asarray(v, np.float64) * scale).astype("<i8").tobytes())

    df = df.filter(F.size("x") == width["w"]).select("id", "label", whole("x").alias("v")).distinct()
    copy = F.row_number().over(Window.partitionBy("id").orderBy("label", "v")) - 1
    return stored(df.select("id", copy.alias("copy"), "label", "v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), -1)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = m.astype(np.float64)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None], size


def fit_centres(sample: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres of a bounded sample of vectors, by spherical k-means."""
    unit, size = _unit(sample)
    unit = unit[size > 0]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    draw = np.random.default_rng(seed)
    centres = unit[draw.permutation(len(unit))[: min(k, len(unit))]]
    for _ in range(rounds):
        at = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def _bounds(m: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Upper bounds (rows x clusters) of the inner product with a unit member of the cluster."""
    unit, size = _unit(m)
    angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
    return size[:, None] * np.where(size[:, None] > 0, np.cos(np.maximum(angle - spread, 0)) + _SLACK, 0)


@dataclass(frozen=True)
class Walk:
    """One search: members with slots, and the steps of the bounds."""

    top: int  # answers per slot
    same: bool  # candidates of the member's own label, or of all others
    exact: bool  # whether sums stay below 2^53


def _walk(members: pd.DataFrame, rows: pd.DataFrame, edges: np.ndarray, how: Walk) -> pd.DataFrame:
    """The best ``top`` (score, id) per member and slot among rows that come by falling step.

    ``members`` have arrays ``low`` and ``high``, the band of each slot. A member leaves
    when the next row's bound is below all that its slots still need.
    """
    kind = np.float64 if how.exact else np.int64
    m = _matrix(members["v"])
    _, size = _unit(m)
    m = m.astype(kind)
    low, high = (np.array(members[c].tolist(), np.int64) for c in ("low", "high"))
    slots = low.shape[1]
    own_id, own_label = members["id"].to_numpy(), members["label"].to_numpy()
    need = low.copy()
    held = np.zeros((0, 5), np.int64)  # member, slot, score, id, copy
    active = np.flatnonzero((low <= high).any(1))
    for i in range(0, len(rows), 1024):
        part = rows.iloc[i : i + 1024]
        reach = edges[int(part["step"].iloc[0])] * size[active] * (1 + 1e-9)
        wanted = np.where(low[active] <= high[active], need[active], np.iinfo(np.int64).max).min(1)
        active = active[reach >= wanted]
        if not len(active):
            break
        x = _matrix(part["v"]).astype(kind)
        score = (m[active] @ x.T).astype(np.int64)
        fits = (own_label[active][:, None] == part["label"].to_numpy()) == how.same
        fits &= own_id[active][:, None] != part["id"].to_numpy()
        ids, copies = part["id"].to_numpy(), part["copy"].to_numpy()
        fresh = [held]
        for s in range(slots):
            at, col = np.nonzero(fits & (score >= need[active, s][:, None]) & (score <= high[active, s][:, None]))
            fresh.append(np.column_stack([active[at], np.full(len(at), s), score[at, col], ids[col], copies[col]]))
        held = np.concatenate(fresh)
        held = held[np.lexsort((held[:, 4], held[:, 3], -held[:, 2], held[:, 1], held[:, 0]))]
        group = held[:, 0] * slots + held[:, 1]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group)))) if len(group) else group
        held, rank = held[rank < how.top], rank[rank < how.top]
        full = held[rank == how.top - 1]
        need[full[:, 0], full[:, 1]] = full[:, 2]
    return pd.DataFrame(
        {
            "anchor": own_id[held[:, 0]],
            "anchor_copy": members["copy"].to_numpy()[held[:, 0]],
            "slot": held[:, 1],
            "score": held[:, 2],
            "id": held[:, 3],
            "copy": held[:, 4],
        }
    )


_FOUND = "anchor long, anchor_copy int, slot int, score long, id long, copy int"


@dataclass
class Index:
    """Candidates with one byte per cluster: how high their bound lies in its list."""

    rows: DataFrame  # id, copy, label, v, steps
    counts: np.ndarray  # clusters x steps
    edges: np.ndarray
    centres: np.ndarray
    exact: bool
    sizes: Lists


def build_index(rows: DataFrame, anchors: DataFrame, sizes: Lists) -> tuple[Index, DataFrame]:
    """The index of all rows, and the anchors (id, copy, label, v, cluster, part) that share its lists."""
    draw = F.xxhash64(F.lit(sizes.seed), "id", "copy")
    some = anchors.orderBy(draw, "id", "copy").limit(sizes.sample).toPandas()
    wanted = min(sizes.clusters, -(-anchors.count() // sizes.members))
    centres = fit_centres(_matrix(some["v"]), wanted, sizes.rounds, sizes.seed)

    @F.pandas_udf("cluster int, angle double, size double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        unit, size = _unit(_matrix(vectors))
        cosine = unit @ centres.T
        at = cosine.argmax(1)
        angle = np.where(size > 0, np.arccos(np.clip(cosine[np.arange(len(at)), at], -1, 1)), 0)
        return pd.DataFrame({"cluster": at.astype(np.int32), "angle": angle, "size": size})

    placed = stored(anchors.withColumn("x", nearest("v")).select("id", "copy", "label", "v", "x.cluster", "x.angle"))
    per = placed.groupBy("cluster").agg(F.max("angle").alias("spread"), F.count("*").alias("n")).toPandas()
    spread, parts = np.zeros(len(centres)), np.ones(len(centres), np.int64)
    spread[per["cluster"]] = per["spread"]
    parts[per["cluster"]] = -(-per["n"] // sizes.part)
    part = F.pmod(draw, F.lit(parts.tolist())[F.col("cluster")]).cast("int")
    placed = placed.select("id", "copy", "label", "v", "cluster", part.alias("part"))

    @F.pandas_udf("double")
    def length(vectors: pd.Series) -> pd.Series:
        return pd.Series(_unit(_matrix(vectors))[1])

    longest = rows.agg(F.max(length("v"))).first()[0]
    sample = rows.orderBy(draw, "id", "copy").limit(sizes.sample).toPandas()
    seen = _bounds(_matrix(sample["v"]), centres, spread)
    edges = np.append(np.quantile(seen, np.linspace(0, 1, _STEPS - 1)), longest * (1 + 1e-5) + 1)

    @F.pandas_udf("binary")
    def steps(vectors: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, _bounds(_matrix(vectors), centres, spread)).astype(np.uint8)
        return pd.Series([x.tobytes() for x in at])

    indexed = stored(rows.withColumn("steps", steps("v")))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(centres), _STEPS), np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch["steps"]), np.uint8).reshape(len(batch), -1)
            for c in range(len(centres)):
                sums[c] += np.bincount(at[:, c], minlength=_STEPS)
        c, s = np.nonzero(sums)
        yield pd.DataFrame({"c": c, "s": s, "n": sums[c, s]})

    counted = indexed.select("steps").mapInPandas(tally, "c int, s int, n long").groupBy("c", "s").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(centres), _STEPS), np.int64)
    counts[counted["c"], counted["s"]] = counted["n"]
    return Index(indexed, counts, edges, centres, longest * longest < float(1 << 52), sizes), placed


def _segments(index: Index, low: np.ndarray, high: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(cluster, segment, step, row) of every list from step ``low`` up to below ``high``.

    Rows go to as many segments as keep each near ``sizes.segment`` rows, by a hash; how
    many that are per list is the second result.
    """
    until = np.cumsum(index.counts, 1)
    before = np.concatenate([np.zeros((len(until), 1), np.int64), until], 1)
    at = np.arange(len(until))
    n = before[at, np.maximum(high, low)] - before[at, low]
    pieces = np.maximum(-(-n // index.sizes.segment), 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = np.frombuffer(b"".join(batch["steps"]), np.uint8).reshape(len(batch), -1)
            code = pd.util.hash_array(batch["id"].to_numpy()) ^ pd.util.hash_array(batch["copy"].to_numpy().astype(np.int64))
            for c in range(steps.shape[1]):
                rows = np.flatnonzero((steps[:, c] >= low[c]) & (steps[:, c] < high[c]))
                if len(rows):
                    made = batch.iloc[rows][["id", "copy", "label", "v"]].reset_index(drop=True)
                    made["cluster"], made["step"] = c, steps[rows, c].astype(np.int32)
                    made["segment"] = (code[rows] % np.uint64(pieces[c])).astype(np.int32)
                    yield made

    dealt = index.rows.mapInPandas(deal, f"{_ROW}, cluster int, step int, segment int")
    return dealt, pieces


def _walked(index: Index, asked: DataFrame, low: np.ndarray, high: np.ndarray, how: Walk) -> DataFrame:
    """What the members find in their lists between two steps; each (cluster, part, segment) is a task's group."""
    dealt, pieces = _segments(index, low, high)
    all_of = F.explode(F.sequence(F.lit(0), F.lit(pieces.tolist())[F.col("cluster")].cast("int") - 1))
    members = asked.withColumn("segment", all_of)
    parts = stored(asked.groupBy("cluster").agg(F.collect_set("part").alias("parts")))
    # One row per cluster, at most ``sizes.clusters``.
    dealt = dealt.join(F.broadcast(parts), "cluster").withColumn("part", F.explode("parts")).drop("parts")
    edges = index.edges

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})
        return _walk(left, right.sort_values(["step", "id"], ascending=[False, True], kind="stable"), edges, how)

    keys = ["cluster", "part", "segment"]
    return members.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(near, _FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("anchor", "anchor_copy", "slot").orderBy(F.desc("score"), "id", "copy")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: Index, asked: DataFrame, top: int, same: bool) -> DataFrame:
    """(anchor, anchor_copy, slot, score, id, copy, rank): the first ``top`` of every slot, exactly.

    ``asked`` is (id, copy, label, v, cluster, part, low, high), its arrays ``low`` and
    ``high`` the band of each slot.
    """
    how = Walk(top, same, index.exact)
    asked = stored(asked)
    above = np.cumsum(index.counts[:, ::-1], 1)[:, ::-1]
    # The lowest step above which a head is long enough, else the whole list.
    cut = np.where((above >= index.sizes.head).any(1), _STEPS - 1 - (above[:, ::-1] >= index.sizes.head).argmax(1), 0)
    heads = stored(_best(_walked(index, asked, cut, np.full(len(cut), _STEPS), how), top))
    # What a slot still needs: its last place if all are taken, else the bottom of its band.
    last = heads.filter(F.col("rank") == top).groupBy("anchor", "anchor_copy")
    last = last.agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
    on = [F.col("id") == F.col("anchor"), F.col("copy") == F.col("anchor_copy")]
    rest = asked.join(last, on, "left").drop("anchor", "anchor_copy")
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.get(F.map_values(F.map_filter("last", lambda k, v: k == i)), F.lit(0)), x)))
    rest = rest.withColumn("low", raised).drop("last")
    edges = index.edges

    @F.pandas_udf("int")
    def lowest(vectors: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        """First step that a member must still read; 256 if it needs nothing more."""
        size = _unit(_matrix(vectors))[1]
        low, high = (np.array(x.tolist(), np.int64) for x in (lows, highs))
        wanted = np.where(low <= high, low, np.iinfo(np.int64).max).min(1)
        reach = size[:, None] * edges * (1 + 1e-9) >= wanted[:, None]
        return pd.Series(np.where(reach.any(1), reach.argmax(1), _STEPS).astype(np.int32))

    rest = stored(rest.withColumn("from", lowest("v", "low", "high")))
    need = rest.groupBy("cluster").agg(F.min("from").alias("from")).toPandas()
    start = np.full(len(cut), _STEPS)
    start[need["cluster"]] = need["from"]
    start = np.minimum(start, cut)
    rest = rest.filter(F.col("from") < F.lit(cut.tolist())[F.col("cluster")]).drop("from")
    tails = _walked(index, rest, start, cut, how)
    return stored(_best(heads.drop("rank").unionByName(tails), top))


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    band: tuple[int, int] = (80, 100),
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    scale: int = 256,
    sizes: Lists | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that the condition ``anchors`` on the column ``id`` marks; their
    positives are the first rows of their label, the negatives of a positive the first
    rows of other labels whose score is ``band`` percent of the positive's, both ends
    included. Scores are inner products of the vectors floor(scale * x), higher first,
    ties by smaller id. A negative positive score has an empty band; so has a positive
    without any row in it, and such pairs have no rows. Rows with a null id, label or
    vector, a null or non-finite component, another than the most common length or a
    length beyond 2^31 after scaling take no part. Rows that repeat in full count once;
    different rows under one id are rows of their own, none of them other than the
    anchor of that id. Zero vectors score 0 with all. Other columns are ignored, no rows
    give none.
    """
    sizes = sizes or Lists()
    good = usable(rows, key, vector, F.col("label") if label is None else label, scale)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    marked = stored(good.filter(anchors))
    if marked.isEmpty():
        return rows.sparkSession.createDataFrame([], names)
    index, placed = build_index(good, marked, sizes)
    least, most = F.lit(-(1 << 62)), F.lit(1 << 62)
    first = search(index, placed.withColumns({"low": F.array(least), "high": F.array(most)}), positives, True)
    # A slot per positive: scores from the rounded-up low end of its band to its high end.
    low = F.when(F.col("score") < 0, F.lit(1)).otherwise(F.expr(f"cast((cast(score as decimal(20,0)) * {band[0]} + 99) div 100 as bigint)"))
    high = F.when(F.col("score") < 0, F.lit(0)).otherwise(F.expr(f"cast((cast(score as decimal(20,0)) * {band[1]}) div 100 as bigint)"))
    one = F.struct("rank", low.cast("long").alias("low"), high.cast("long").alias("high"))
    bands = first.groupBy("anchor", "anchor_copy").agg(F.array_sort(F.collect_list(one)).alias("b"))
    # Absent positives are empty bands.
    fill = [F.coalesce(F.get("b", F.lit(i)), F.struct(F.lit(i + 1).alias("rank"), F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))) for i in range(positives)]
    on = [F.col("id") == F.col("anchor"), F.col("copy") == F.col("anchor_copy")]
    asked = placed.join(bands, on).withColumn("b", F.array(*fill))
    asked = asked.select("id", "copy", "label", "v", "cluster", "part", F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    found = search(index, asked, negatives, False)
    found = found.select("anchor", "anchor_copy", F.col("slot") + 1, "rank", "id", "score").toDF("anchor", "anchor_copy", "p", "rank", "negative_id", "negative_score")
    mates = first.select("anchor", "anchor_copy", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = mates.join(found, ["anchor", "anchor_copy", "p"])
    return both.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
