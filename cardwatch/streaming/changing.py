"""Rules that change while a stream runs.

Registries are kept as versions of a table. A live stream asks for the newest version at
every batch, so a rule that is switched off, changed or added takes effect with the next
batch and what was judged before stays. The version a batch used is kept, so that a batch
given twice is judged alike. ``judged_by_time`` picks the version by the time of the item
instead, for replays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.operators import enrich, verdicts
from cardwatch.operators.rules import REGISTRY_COLUMNS, Registry
from cardwatch.sources import sinks

_FINAL = ("final_status", "n_applicable", "rejecting_ruleset", "rejecting_reason", "rejecting_rulesets", "n_rejecting")


class RuleTable:
    """Versions of a registry under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, registry: Registry, version: int) -> None:
        """Store a version; one that is stored already stays as it is."""
        if version in sinks.version_numbers(self.spark, self.path):
            raise ValueError(f"version {version} is stored already")
        sinks.write_version(registry.to_df(self.spark).coalesce(1), self.path, version)

    def newest(self) -> int:
        versions = sinks.version_numbers(self.spark, self.path)
        if not versions:
            raise ValueError(f"no registry under {self.path}")
        return versions[-1]

    def load(self, version: int) -> Registry:
        return Registry.from_df(self.spark.read.schema(REGISTRY_COLUMNS).parquet(f"{self.path}/batch_id={version}"))


def judged(items: DataFrame, merchants: DataFrame, registry: Registry, version: int) -> DataFrame:
    """id, the final verdict, and the version of the rules that gave it."""
    rows = enrich.with_merchant(items, merchants)
    final = verdicts.with_final(verdicts.evaluate(rows, registry), registry)
    return final.select("id", *_FINAL, F.lit(version).alias("rules_version"))


def verdict_writer(rules: RuleTable, merchants: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Judge every batch by the newest rules when it begins."""

    def write(items: DataFrame, batch_id: int) -> None:
        used = f"{path}/rules_used"
        if batch_id in sinks.version_numbers(rules.spark, used):
            version = rules.spark.read.parquet(f"{used}/batch_id={batch_id}").first().version
        else:
            version = rules.newest()
            sinks.write_version(rules.spark.createDataFrame([(version,)], "version int").coalesce(1), used, batch_id)
        sinks.write_version(judged(items, merchants, rules.load(version), version), f"{path}/verdicts", batch_id)

    return write


def judged_by_time(items: DataFrame, merchants: DataFrame, versions: Sequence[tuple[str, Registry]]) -> DataFrame:
    """Judge every item by the registry in force at its time. versions: (valid from, registry), in order of time.

    Items before the first version have no rules and stay pending.
    """
    starts = [F.to_timestamp(F.lit(start)) for start, _ in versions]
    parts = [judged(items.where(F.col("ts") < starts[0]), merchants, Registry(), -1)]
    for number, (_, registry) in enumerate(versions):
        inside = F.col("ts") >= starts[number]
        if number + 1 < len(versions):
            inside &= F.col("ts") < starts[number + 1]
        parts.append(judged(items.where(inside), merchants, registry, number))
    return sinks.history(*parts)
