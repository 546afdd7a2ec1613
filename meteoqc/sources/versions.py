"""A table of versions: changes are appended, a compaction merges them, readers see one state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.operators.lookups import latest_per_key
from meteoqc.sources.sinks import read_or_none


@dataclass(frozen=True)
class VersionedTable:
    """Rows by ``key``; the row with the highest version counts.

    ``changes/version=n`` holds what version n wrote, ``base/upto=n`` everything as of version n. A
    base is only seen once it is written whole, and a reader that has chosen one reads the changes
    after it, so a compaction at the same time changes nothing for it.
    """

    path: str
    key: str
    buckets: int = 8

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Writes the new state of ``rows``; writing the same version again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/version={version}")

    def base(self, spark: SparkSession, upto: int | None = None) -> int:
        """The newest compacted version not after ``upto`` (-1 if there is none)."""
        df = read_or_none(spark, f"{self.path}/base")
        known = [] if df is None else [r.upto for r in df.select("upto").distinct().collect()]  # one for each compaction
        return max((v for v in known if upto is None or v <= upto), default=-1)

    def state(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The last row of every key, as of version ``upto`` or now."""
        base = self.base(spark, upto)
        changes = spark.read.parquet(f"{self.path}/changes").filter(F.col("version") > base)
        if upto is not None:
            changes = changes.filter(F.col("version") <= upto)
        if base < 0:
            return latest_per_key(changes, [self.key], "version").drop("version")
        old = spark.read.parquet(f"{self.path}/base/upto={base}")
        both = old.withColumn("version", F.lit(base)).unionByName(changes)
        return latest_per_key(both, [self.key], "version").drop("version")

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Merges all versions up to ``upto`` into a new base, dealt and sorted by key."""
        if self.base(spark, upto) < upto:
            whole = self.state(spark, upto).repartition(self.buckets, self.key).sortWithinPartitions(self.key)
            whole.write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
