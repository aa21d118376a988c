"""SimHash fingerprints linked by covering locality-sensitive hashing.

With radius r, each of the 64 bits gets a non-zero vector of r + 1 bits, and each
non-zero vector v of r + 1 bits gives a table whose mask holds the bits whose vector
has an odd inner product with v. The at most r vectors of the bits in which two
fingerprints differ leave some v orthogonal to all of them, so in that table both have
the same masked key: no pair within the radius is missed. For r = 3 that is 15 tables
with about half of the bits each.

Copies fold into one fingerprint first. Tables are dealt by (table, key) and read as a
sorted stream: a bucket of up to ``most`` fingerprints is searched in place and
yields the links of a spanning forest, never all pairs. Fingerprints of larger
buckets pass by and are linked through points at distance 1 of one and 2 of the
other, an exact way whose work is linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stored
from riskflow.llm.connected import components

RADIUS = 3
WORDS = 3
SEED = 42
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 15


def fingerprint_of(text: str, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 without words."""
    # Bytes lower-case A-Z only and split at the six ASCII blanks only.
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        spans = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1]
        spans = [joined[a:b] for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(spans), _CHUNK):
        part = spans[i : i + _CHUNK]
        codes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(spans), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(text: Column | str) -> Column:
    """Fingerprint of each text; null texts have no words."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.fromiter((fingerprint_of(t) for t in batch), np.int64, len(batch)))

    return of(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks of the 2^(radius + 1) - 1 tables, as signed 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(64) if ((i % vectors + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that span the bucket's components; every link is real."""
    rest, links = codes, []
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            at = open_.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                links += [(int(at), int(x)) for x in found]
                open_ += list(found)
                rest = rest[~near]
    return links


def bucket_links(classes: DataFrame, radius: int = RADIUS, most: int = 16_384) -> DataFrame:
    """Real links (a, b) between fingerprints whose components are those of all links within the radius."""
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(masks)]))
    keyed = classes.select("fp", tables.alias("x")).select(
        F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp"
    )
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the bucket that is still open
        where, size, over = None, 0, False

        def close() -> list[tuple[int, int]]:
            if size < 2 or over:
                return []
            return _forest(np.concatenate(held), radius)

        for batch in batches:
            t, key, fp = batch["t"].to_numpy(), batch["key"].to_numpy(), batch["fp"].to_numpy().astype(np.uint64)
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            first, last = np.append(0, cut), np.append(cut, len(fp))
            links, large = [], []
            # Buckets inside the batch with one fingerprint need no look.
            some = (last - first > 1) | (np.arange(len(first)) == 0) | (np.arange(len(first)) == len(first) - 1)
            for i in np.flatnonzero(some):
                a, b = first[i], last[i]
                here = (t[a], key[a])
                if here != where:
                    links += close()
                    held, where, size, over = [], here, 0, False
                size += b - a
                if over:
                    large.append(fp[a:b])
                elif size > most:
                    large += [*held, fp[a:b]]
                    held, over = [], True
                else:
                    held.append(fp[a:b])
            passed = np.concatenate(large) if large else np.zeros(0, np.uint64)
            yield _pairs(links, passed)
        yield _pairs(close(), np.zeros(0, np.uint64))

    found = stored(dealt.mapInPandas(search, "a long, b long"))
    links = found.filter("b is not null")
    large = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if found.filter("b is null").limit(1).count():
        links = links.unionByName(star_links(stored(large), radius))
    return links.distinct()


def _pairs(links: list[tuple[int, int]], passed: np.ndarray) -> pd.DataFrame:
    a = np.array([x for x, _ in links], np.uint64)
    b = np.array([x for _, x in links], np.uint64)
    second = pd.array(b.view(np.int64), dtype="Int64")
    alone = pd.array([pd.NA] * len(passed), dtype="Int64")
    return pd.DataFrame(
        {
            "a": np.concatenate([a, passed]).view(np.int64),
            "b": pd.concat([pd.Series(second), pd.Series(alone)], ignore_index=True).astype("Int64"),
        }
    )


def star_links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links that connect exactly what links within the radius connect, without comparing pairs.

    Two codes are within r + s if some point is within r of one and s of the other. Of
    the codes within s = radius // 2 of a point, the smallest is joined to all within
    radius - s: real links, through which all pairs that meet there are connected.
    """
    near = radius // 2

    def ball(low: int, high: int) -> Column:
        points = [0] if low == 0 else []
        if low <= 1 <= high:
            points += [1 << i for i in range(64)]
        if high >= 2:
            points += [1 << i | 1 << j for i in range(64) for j in range(i)]
        points = [p - (1 << 64) if p >> 63 else p for p in points]
        return F.from_json(F.lit(str(points)), "array<bigint>")

    if radius - near > 2:
        raise ValueError("radius up to 4")
    z = F.transform("_ball", lambda m: F.col("fp").bitwiseXOR(m))
    inner = codes.select("fp", ball(0, near).alias("_ball")).select("fp", F.explode(z).alias("z"))
    outer = codes.select("fp", ball(0, radius - near).alias("_ball")).select("fp", F.explode(z).alias("z"))
    hub = inner.groupBy("z").agg(F.min("fp").alias("hub"))
    return outer.join(hub, "z").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def _components(docs: DataFrame, radius: int, most: int) -> DataFrame:
    """(doc_id, doc_hash, fp, root, component_id) per document row; roots are fingerprints."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", F.xxhash64(text).alias("doc_hash"), fingerprints("text").alias("fp")))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stored(components(bucket_links(classes, radius, most)))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.withColumn("root", F.coalesce("root", "fp"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(linked.join(lowest, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "doc_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = 16_384) -> DataFrame:
    """(doc_id, fp, component_id): one row per document row, none dropped.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` bits reach,
    itself included. Null and empty texts share the fingerprint 0 and so a component.
    A null doc_id is kept and never the smallest; a component of such rows alone has a
    null id. Repeated rows give repeated rows, other columns are ignored, no rows give
    none. Texts are read whole and never shuffled: only ids and fingerprints are.
    """
    return _components(docs, radius, most).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, most: int = 16_384) -> DataFrame:
    """One document row of each near-duplicate component, with all columns.

    It is a row with the component's smallest doc_id, of several texts under that id the
    one with the smallest hash, of repeated rows any one. Components whose rows all lack
    an id keep one row likewise.
    """
    return kept_rows(docs, stored(_components(docs, radius, most)))


def kept_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` per root; ``found`` is stored (doc_id, doc_hash, root, component_id)."""
    lead = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = lead.groupBy("root", F.col("doc_id").alias("_id")).agg(F.min("doc_hash").alias("_hash"))
    first = stored(first.select("_id", "_hash").distinct())
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.withColumn("_own", own).join(
        first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_semi"
    )
    again = found.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_hash") == F.col("_hash")), "left_semi")
    if again.count() > first.count():
        # Rows that repeat in full: one of each, chosen before the shuffle where possible.
        one = Window.partitionBy("doc_id", "_own").orderBy(F.xxhash64(*[c for c in docs.columns]))
        kept = kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    return kept.drop("_own")
