"""URL rules by host and path, looked up in Bloom filter cascades instead of joins.

Every url gives the few keys under which a rule could list it: its last 1 .. D host
labels with the first characters of its path, for the depths and path lengths that
rules have. Those keys of all urls are the universe on which one cascade of blocking
and one of allowing rules are exact, so a key that a cascade contains *is* a rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column
from riskflow.llm.bloom import Cascade, build_cascade

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Everything after the first ``://``: host, then path. ``(?s)`` lets a url hold line ends.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column | str) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(as_column(url), _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    """Text after the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(as_column(url), _PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class UrlRules:
    """A rule is ``host + path``; host and path lengths say which keys a url can have."""

    block: DataFrame
    allow: DataFrame
    depths: tuple[int, ...]
    lengths: tuple[int, ...]

    @staticmethod
    def of(rules: DataFrame) -> UrlRules:
        """From rows (host, path, verdict); a null path is empty, rows without a host are ignored.

        Distinct depths and path lengths, a few numbers, are gathered here. A rule that
        is listed as both blocks.
        """
        rules = rules.filter("host is not null").select(
            F.col("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
        )
        keyed = rules.withColumn("key", F.concat("host", "path"))
        shape = rules.agg(
            F.collect_set(F.size(F.split("host", r"\."))).alias("d"),
            F.collect_set(F.length("path")).alias("n"),
        ).first()
        return UrlRules(
            keyed.filter("verdict = 'block'").select("key"),
            keyed.filter("verdict = 'allow'").select("key"),
            tuple(sorted(shape["d"])),
            tuple(sorted(shape["n"])),
        )

    def keys(self, host: Column, path: Column) -> Column:
        """Structs (length, host length, key) of every key the url can have; the array may be empty."""
        found = []
        for d in self.depths:
            # The last d labels; only where the host has as many.
            tail = F.when(F.size(F.split(host, r"\.")) >= d, F.substring_index(host, ".", -d))
            for n in self.lengths:
                key = F.when((F.length(host) > 0) & (F.length(path) >= n), F.concat(tail, F.substring(path, 1, n)))
                found.append(F.struct(F.length(key).alias("n"), F.length(tail).alias("h"), key.alias("key")))
        if not found:
            return F.array().cast("array<struct<n:int,h:int,key:string>>")
        return F.filter(F.array(*found), lambda k: k["key"].isNotNull())


def judge(pages: DataFrame, rules: UrlRules, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to the pages.

    The longest fitting rule decides (of equal ones the one with the longer host), and
    ``default`` where none fits. Null urls and urls without ``://`` have an empty host
    and path and no rule. Repeated rows are judged alike; no row moves or is dropped.
    Input columns named host, path, rule or verdict are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in added]
    parts = pages.select(*[F.col(c) for c in kept], host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = parts.withColumn("_keys", rules.keys(F.col("host"), F.col("path")))
    universe = keyed.select(F.explode("_keys").alias("k")).select(F.col("k.key").alias("key"))
    block: Cascade = build_cascade(rules.block, universe)
    allow: Cascade = build_cascade(rules.allow, universe)

    def listed(k: Column) -> Column:
        return block.contains(k["key"]) | allow.contains(k["key"])

    best = F.array_max(F.filter("_keys", listed))["key"]
    found = keyed.withColumn("rule", best)
    verdict = (
        F.when(block.contains("rule"), F.lit("block")).when(F.col("rule").isNotNull(), F.lit("allow"))
    ).otherwise(F.lit(default))
    return found.withColumn("verdict", verdict).select(*kept, *added)


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) tuples as a frame of literals."""
    names = ("host", "path", "verdict")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
