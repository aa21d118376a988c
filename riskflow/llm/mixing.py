"""Mixing sources to target weights by thresholds on a hash.

Every document has a fixed 60-bit hash. A source whose target is ``e`` whole copies
of itself and a rest takes ``e`` copies of every document and one more of those
whose hash is at most the source's threshold. The threshold is found without
sorting: a histogram of words by (source, first hash bits) names the bucket in which
the rest runs out, the next histogram covers that bucket alone, and the last one its
single hashes. A threshold of a smaller budget is never above that of a larger one,
so mixes of growing budgets contain each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column
from riskflow.llm.common import attach, fresh, stored, word_count

#: Bits that each histogram resolves; together the 60 bits of a hash.
LEVELS = (12, 16, 32)


def mix_hash(key: str | Column, seed: int = 0) -> Column:
    """60 bits of md5 over the key, the same in any engine. A null key hashes like ''."""
    text = F.coalesce(as_column(key).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int) -> DataFrame:
    """Words each source should give: (source, source_size, target).

    ``sizes`` has one row per source. Sources in code point order, null last, weigh
    ``weights`` in turn and divide ``share`` (a fraction) of all words. None gets
    more than ``cap`` times its size; what is over goes to the others by weight.
    The fixed point of that sharing is ``min(cap * size, level * weight)`` for one
    water level: the largest of the levels that capping the first k sources implies.
    One row per source passes this ordering, never one per document.
    """
    up, down = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    df = sizes.withColumn("_weight", F.get(table, turn))
    fill = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    df = df.withColumns(
        {
            "_capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap,
            "_open": F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
            "_all": F.sum("source_size").over(everything),
        }
    )
    # Whole numbers up to the one division, so that every engine gets the same double.
    level = (F.col("_all") * up - F.col("_capped") * down) / (F.col("_open") * down)
    df = df.withColumn("_level", F.max(level).over(everything))
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("_level") * F.col("_weight"))
    return df.select("source", "source_size", target.alias("target"))


def _boundary(hist: DataFrame, bucket: str) -> DataFrame:
    """Per source the bucket in which the running words pass the rest, and the words before it."""
    running = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    df = hist.withColumn("_upto", F.col("_before") + F.sum("_words").over(running))
    first = Window.partitionBy("source").orderBy(bucket)
    return (
        df.filter(F.col("_upto") > F.col("_rest"))
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .withColumn("_before", F.col("_upto") - F.col("_words"))
        .drop("_upto", "_n")
    )


def mix_thresholds(sized: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int) -> DataFrame:
    """(source, source_size, target, epochs, threshold) from stored (source, size, hash) rows.

    ``epochs`` copies of every document and one more where hash <= threshold.
    """
    left, state = 60, None
    for bits in LEVELS:
        left -= bits
        bucket = F.shiftright("hash", left)
        if state is None:
            hist = sized.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"))
            hist = stored(hist)
            sizes = hist.groupBy("source").agg(F.sum("_words").alias("source_size"))
            targets = source_targets(sizes, weights, share, cap)
            epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
            targets = stored(targets.withColumn("epochs", epochs))
            rest = F.col("target") - F.col("epochs") * F.col("source_size")
            state = targets.select("source", rest.alias("_rest"), F.lit(0).cast("long").alias("_before"))
            hist = attach(hist, state, "source")
        else:
            # Only documents of the bucket in which the rest runs out.
            rows = attach(sized, state.withColumnRenamed("_bucket", "_prefix"), "source")
            rows = rows.filter(F.shiftright("hash", left + bits) == F.col("_prefix"))
            hist = rows.groupBy("source", "_rest", "_before", bucket.alias("_bucket"))
            hist = hist.agg(F.sum("size").alias("_words"))
        state = stored(_boundary(hist, "_bucket").select("source", "_rest", "_before", "_words", "_bucket"))
    # Equal hashes stand or fall together: whichever end is nearer to the rest.
    nearer = F.col("_before") + F.col("_words") - F.col("_rest") < F.col("_rest") - F.col("_before")
    threshold = F.when(nearer, F.col("_bucket")).otherwise(F.col("_bucket") - 1)
    ends = state.select(F.col("source").alias("_source"), threshold.alias("threshold"))
    on = targets["source"].eqNullSafe(ends["_source"])
    joined = targets.join(ends, on, "left").drop("_source")
    return stored(joined.withColumn("threshold", F.coalesce("threshold", F.lit(-1).cast("long"))))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: int = 0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with how often the mix takes them.

    Adds size, source_size, target, copies and taken (= size * copies) to the columns
    ``keep`` (default: all). Texts are read once to size them; every histogram
    reads stored (source, size, hash) rows.

    A null text has size 0, a null source is a source, a null doc_id hashes like an
    empty one. Rows with the same doc_id are taken or left together, repeated rows
    each count. A source without words takes nothing; a document without words is copied
    like the others of its source, at most ``cap`` times. An empty table gives no rows.
    Columns of the input that are named like added ones are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in added]
    few = docs.select("source", word_count("text").alias("size"), mix_hash("doc_id", seed).alias("hash"))
    sized = stored(few)
    ends = mix_thresholds(sized, weights, share, cap)
    source, code, epochs, threshold = fresh(docs, "_mix_source", "_mix_hash", "epochs", "threshold")
    rows = docs.select(
        *keep,
        F.col("source").alias(source),
        mix_hash("doc_id", seed).alias(code),
        word_count("text").alias("size"),
    )
    ends = ends.withColumnsRenamed({"source": source, "epochs": epochs, "threshold": threshold})
    rows = attach(rows, ends, source)
    # Where whole epochs make the target, a further copy could only be of documents without words.
    rest = F.col("target") > F.col(epochs) * F.col("source_size")
    extra = (rest & (F.col(code) <= F.col(threshold))).cast("long")
    copies = F.when(F.col("source_size") > 0, F.col(epochs) + extra).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*keep, *added)


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """One row per taken copy, numbered from 1 in ``epoch``."""
    taken = mixed.filter("copies > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
