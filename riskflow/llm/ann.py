"""Approximate nearest neighbours on shifted Hilbert curves.

Several orderings: each projects the vectors onto a few random orthogonal directions,
shifts them, and orders them along a Hilbert curve. Spark sorts every ordering by
range partitions, which gives each vector a rank in each. A query looks at its
window, all vectors up to ``reach`` ranks away, in every ordering; windows are cut
into blocks of fixed size, so the work of a task is bounded by the block. Within a
block distances come from 8-bit copies of the vectors. What rounding and clipping took
from a vector is known, so each distance has a lower and an upper bound; every
candidate whose lower bound does not exceed the k-th upper bound stays, however many,
and these are merged and ranked again by exact distances. Every cut counts ids, not
vectors: an id is where the nearest of its vectors is, and takes one place.

``reach`` is measured, not guessed: for a bounded sample of vectors the true
neighbours are found against all rows, and the window is made as wide as it takes
for the wanted share of them to lie within it in some ordering. Clustered vectors
need a narrow one; vectors without structure need a share of all ranks, and no
curve can change that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stored


@dataclass(frozen=True)
class Curves:
    """Orderings and sizes; every number is a parameter of the index."""

    orderings: int = 16
    directions: int = 12
    bits: int = 5
    block: int = 4096
    recall: float = 0.97
    sample: int = 4096
    trials: int = 96
    seed: int = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (n x d, below 2^bits), d * bits <= 63.

    Works on whole columns: the cells are turned into the curve's Gray code from the
    highest bit down, and the bits of all directions are then woven together.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            upper = (x[i] >> b) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for column in x:
            key = (key << 1) | (((column ^ flip) >> b) & 1)
    return key


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (id, v) of vectors that take part: an id, numbers only, not all zero, the most common length."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine & some
    )
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, summed in order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64)


class _Index:
    """Projections, shifts and scales, fitted on a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: Curves) -> None:
        rng = np.random.default_rng(curves.seed)
        wide = max(sample.shape[1], 1)
        d = min(curves.directions, wide)
        self.bits = min(curves.bits + (0 if d == curves.directions else 3), 62 // d)
        self.turn = [np.linalg.qr(rng.standard_normal((wide, d)))[0] for _ in range(curves.orderings)]
        flat = [sample @ t for t in self.turn]
        self.low = [p.mean(0) - 3.5 * p.std(0) for p in flat]
        self.span = [max(float((7 * p.std(0)).max()), 1e-12) for p in flat]
        self.shift = [rng.random(d) for _ in range(curves.orderings)]
        # A few long vectors must not set the scale of all; what they lose is in their error.
        most = float(np.abs(sample).max())
        usual = 1.6 * float(np.quantile(np.abs(sample), 0.99))
        self.scale = max(min(usual or most, most), 1e-12) / 127.0

    def keys(self, vectors: np.ndarray, o: int) -> np.ndarray:
        at = ((vectors @ self.turn[o] - self.low[o]) / self.span[o] + self.shift[o]) / 2
        cells = np.clip(np.floor(at * (1 << self.bits)), 0, (1 << self.bits) - 1).astype(np.int64)
        return hilbert_keys(cells, self.bits)

    def small(self, vectors: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """8-bit copies, large components clipped, and how far each is from its vector, in steps of the scale."""
        scaled = vectors / self.scale
        codes = np.clip(np.rint(scaled), -127, 127)
        away = np.sqrt(((scaled - codes) ** 2).sum(1)) * (1 + 1e-9) + 1e-9
        return [r.tobytes() for r in codes.astype(np.int8)], away


def _ranked(classes: DataFrame, index: _Index, curves: Curves) -> DataFrame:
    """(o, rank, id, q, e, own): every vector in every ordering, with its rank along the curve."""
    state = classes.sparkSession.sparkContext.broadcast(vars(index))
    orderings = curves.orderings

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Index.__new__(_Index)
        own.__dict__.update(state.value)
        for batch in batches:
            # A few thousand at a time: each gives a row per ordering.
            for i in range(0, len(batch), 2048):
                part = batch.iloc[i : i + 2048]
                m = _matrix(part["v"])
                q, e = own.small(m)
                for o in range(orderings):
                    keys = own.keys(m, o)
                    yield pd.DataFrame({"o": o, "key": keys, "id": part["id"].to_numpy(), "q": q, "e": e, "own": part["own"].to_numpy()})

    keys = classes.mapInPandas(keyed, "o int, key long, id long, q binary, e double, own array<long>")
    width = max(orderings, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = keys.repartitionByRange(width, "o", "key", "id").sortWithinPartitions("o", "key", "id")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen, kept = TaskContext.get().partitionId(), 0, ("o", "id", "q", "e", "own")
        for batch in batches:
            n = len(batch)
            yield pd.DataFrame({"part": part, "pos": np.arange(seen, seen + n), **{c: batch[c] for c in kept}})
            seen += n

    # Stored before ranks are derived, so that a lost task cannot renumber its rows.
    rows = stored(sorted_.mapInPandas(numbered, "part int, pos long, o int, id long, q binary, e double, own array<long>"))
    # One row per partition and ordering: how many come before, and where the ordering begins.
    runs = rows.groupBy("part", "o").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    upto = Window.partitionBy("o").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first"))
    starts = stored(runs.select("part", "o", "base"))
    return stored(
        rows.join(F.broadcast(starts), ["part", "o"]).select("o", (F.col("pos") + F.col("base")).alias("rank"), "id", "q", "e", "own")
    )


def exact_neighbours(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, d): the k nearest others of a bounded set of queries, by looking at every row."""
    queries = asked.select("id", "v").toPandas()
    ids, m = queries["id"].to_numpy(), _matrix(queries["v"])
    state = classes.sparkSession.sparkContext.broadcast((ids, m))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = state.value
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.iloc[i : i + 4096]
                own, x = part["id"].to_numpy(), _matrix(part["v"])
                d = (m * m).sum(1)[:, None] + (x * x).sum(1) - 2 * (m @ x.T)
                d[ids[:, None] == own] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(d, best, 1)
                real = np.isfinite(near)
                yield pd.DataFrame({"query_id": np.repeat(ids, best.shape[1])[real.ravel()], "id": own[best][real], "d": near[real]})

    found = classes.select("id", "v").mapInPandas(look, "query_id long, id long, d double")
    order = Window.partitionBy("query_id").orderBy("d", "id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def _reach(ranked: DataFrame, truth: DataFrame, recall: float) -> int:
    """Ranks within which the wanted share of true neighbours lies in some ordering."""
    pairs = F.broadcast(stored(truth.select("query_id", "id")))
    mine = ranked.select("o", "id", "rank")
    a = mine.join(pairs, "id").select("o", "query_id", "id", F.col("rank").alias("there"))
    b = mine.join(F.broadcast(truth.select("query_id").distinct()), mine["id"] == F.col("query_id"))
    both = a.join(b.select("o", "query_id", F.col("rank").alias("here")), ["o", "query_id"])
    gaps = both.groupBy("query_id", "id").agg(F.min(F.abs(F.col("there") - F.col("here"))).alias("gap"))
    found = gaps.agg(F.percentile("gap", F.lit(recall)).alias("p")).first()["p"]
    return int(np.ceil(found or 0)) + 1


def search_classes(classes: DataFrame, asked: DataFrame, k: int, curves: Curves) -> DataFrame:
    """(query_id, member, score): the k nearest ids found of each asked class, those of the class included.

    ``classes`` is stored (id, v, own) with distinct vectors and the ids, at most a fixed
    number, that have this vector; ``asked`` is a subset of it. An id comes once, with its
    nearest vector, ties by smaller id.
    """
    by_draw = classes.orderBy(F.xxhash64(F.lit(curves.seed), "id"), "id").limit(curves.sample)
    sample = stored(by_draw.select("id", "v")).toPandas()
    index = _Index(_matrix(sample["v"]) if len(sample) else np.zeros((1, 1)), curves)
    ranked = _ranked(classes, index, curves)
    tried = sample["id"].head(curves.trials).tolist()
    if not tried:
        return asked.select(F.col("id").alias("query_id"), F.col("id").alias("member"), F.lit(0.0).alias("score")).limit(0)
    truth = stored(exact_neighbours(classes, classes.filter(F.col("id").isin(tried)), k))
    reach = _reach(ranked, truth, curves.recall)
    block = curves.block
    tiles = ranked.withColumn("tile", F.floor(F.col("rank") / block))
    wanted = ranked.drop("own").join(asked.select("id"), "id", "left_semi")
    low, high = F.greatest(F.floor((F.col("rank") - reach) / block), F.lit(0)), F.floor((F.col("rank") + reach) / block)
    wanted = stored(wanted.select("o", "rank", "id", "q", "e", F.explode(F.sequence(low, high)).alias("tile")))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = {"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "member": np.zeros(0, np.int64), "low": np.zeros(0), "high": np.zeros(0)}
        if left.empty or right.empty:
            return pd.DataFrame(none)
        x = np.frombuffer(b"".join(left["q"]), np.int8).reshape(len(left), -1)
        # Sums of products below 2^24 are exact in single precision.
        kind = np.float32 if 4 * 127 * 127 * x.shape[1] < 1 << 24 else np.float64
        x = x.astype(kind)
        xx, ids, ranks, ex = (x * x).sum(1), left["id"].to_numpy(), left["rank"].to_numpy(), left["e"].to_numpy()
        # One column for each (member, class), those of a member side by side.
        members, cls = np.concatenate(left["own"].to_list()), np.repeat(np.arange(len(left)), left["own"].str.len())
        order = np.argsort(members, kind="stable")
        members, cls = members[order], cls[order]
        begin = np.flatnonzero(np.r_[True, members[1:] != members[:-1]])
        who = np.cumsum(np.r_[0, members[1:] != members[:-1]])
        step = max((256 << 12) // len(members), 1)
        made = [pd.DataFrame(none)]
        for i in range(0, len(right), step):
            part = right.iloc[i : i + step]
            m = np.frombuffer(b"".join(part["q"]), np.int8).reshape(len(part), -1).astype(kind)
            d = np.sqrt(((m * m).sum(1)[:, None] + xx - 2 * (m @ x.T)).astype(np.float64))
            slack = part["e"].to_numpy()[:, None] + ex
            low, high = d * (1 - 1e-9) - slack, d * (1 + 1e-9) + slack
            high[np.abs(part["rank"].to_numpy()[:, None] - ranks) > reach] = np.inf
            # What a member can be at most away, and the k-th smallest of these.
            low, high = low[:, cls], high[:, cls]
            most = np.minimum.reduceat(high, begin, axis=1)
            n = min(k, most.shape[1])
            bound = np.partition(most, n - 1, axis=1)[:, n - 1 : n]
            at, found = np.nonzero((low <= bound) & np.isfinite(high))
            best = low[at, found] <= most[at, who[found]]
            at, found = at[best], found[best]
            pairs = {"query_id": part["id"].to_numpy()[at], "id": ids[cls[found]], "member": members[found]}
            made.append(pd.DataFrame(pairs | {"low": low[at, found], "high": high[at, found]}))
        return pd.concat(made)

    found = tiles.groupBy("o", "tile").cogroup(wanted.groupBy("o", "tile"))
    found = found.applyInPandas(near, "query_id long, id long, member long, low double, high double")
    merged = found.groupBy("query_id", "id", "member").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    # The same over all tiles, in one exchange: a member's least upper bound, and the k-th of these.
    merged = merged.repartition("query_id")
    mine = Window.partitionBy("query_id", "member").orderBy("high", "id")
    ranks = merged.withColumn("most", F.min("high").over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranks = ranks.withColumn("first", (F.row_number().over(mine) == 1).cast("int"))
    upto = Window.partitionBy("query_id").orderBy("most", "member", "high", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = ranks.withColumn("n", F.sum("first").over(upto))
    bound = F.max(F.when(F.col("n") <= k, F.col("most"))).over(Window.partitionBy("query_id"))
    short = ranks.withColumn("bound", bound).filter("low <= bound and low <= most")
    short = stored(short.select("query_id", "id", "member"))
    a = asked.select(F.col("id").alias("query_id"), F.col("v").alias("a"))
    pairs = short.select("query_id", "id").distinct().join(classes.select("id", F.col("v").alias("b")), "id").join(a, "query_id")
    scored = pairs.select("query_id", "id", distance(F.col("a"), F.col("b")).alias("score"))
    scored = short.join(scored, ["query_id", "id"]).groupBy("query_id", "member").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "member")
    return scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: Curves | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``queries`` marks.

    ``queries`` is a condition on the column ``id``. Candidates are all rows but those
    with the query's own id; nearest first by Euclidean distance of the original
    vectors, ties to the smaller id. Equal vectors fold into one class with its k + 1
    smallest ids, which is all that any answer can use, so any number of copies
    costs one place on the curves; a smaller id of the same vector is always ahead. Null, zero, non-finite and null-holding vectors,
    rows without an id and vectors of another than the most common length take no
    part. Rows that repeat an id and vector count once; an id with several vectors is
    searched with each and answers with its nearest. No rows give no rows; other
    columns are ignored.
    """
    curves = curves or Curves()
    good = stored(usable(rows, key, vector))
    # The smallest ids of each vector; the limit is applied before the shuffle too.
    first = Window.partitionBy("v").orderBy("id")
    ids = good.withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k + 1)
    ids = ids.select("v", F.col("id").alias("member")).distinct()
    heads = good.groupBy("v").agg(F.min("id").alias("id"))
    # An id with several vectors heads several classes: number them by vector.
    heads = heads.withColumn("twin", F.row_number().over(Window.partitionBy("id").orderBy("v")) - 1)
    classes = stored(heads)
    if classes.filter("twin > 0").limit(1).count():
        code = F.xxhash64(F.col("id"), F.col("twin"))
        classes = stored(classes.withColumn("id", F.when(F.col("twin") > 0, code).otherwise(F.col("id"))))
    asked_rows = stored(good.filter(queries).distinct().join(classes.withColumnRenamed("id", "cls"), "v").select("id", "cls"))
    asked = stored(classes.join(asked_rows.select(F.col("cls").alias("id")).distinct(), "id", "left_semi").select("id", "v"))
    own = ids.groupBy("v").agg(F.sort_array(F.collect_set("member")).alias("own"))
    classes = stored(classes.select("id", "v").join(own, "v"))
    # One more than asked for: the query's own id is among them.
    near = search_classes(classes, asked, k + 1, curves)
    found = asked_rows.select(F.col("id").alias("query_id"), "cls").join(near.withColumnRenamed("query_id", "cls"), "cls")
    found = found.filter("member <> query_id").groupBy("query_id", "member").agg(F.min("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy("score", "member")
    found = found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), "score")
