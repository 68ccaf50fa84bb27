"""A store of feature tables that are stacked without a shuffle.

Every table of a store is bucketed and sorted by the same keys into the same number of buckets, so Spark
joins any number of them bucket by bucket: no Exchange.  An entry is named by what it was made from: the
feature's name and the identity of its input, so other data is never answered with old features.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identity(df: DataFrame) -> str:
    """A key of the rows of ``df``, in any order: its schema, their number, and two sums of their hashes (one aggregate)."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    hashes = [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)]
    row = df.agg(F.count(F.lit(1)), *[F.sum(h.cast("decimal(20,0)")) for h in hashes]).first()
    return hashlib.sha256(repr((df.schema.simpleString(), *map(str, row))).encode()).hexdigest()[:24]


class FeatureStore:
    """Bucketed tables under one folder; ``keys`` and ``buckets`` are those of all its tables."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int, database: str = "default"):
        self.spark, self.folder, self.keys, self.buckets, self.database = spark, folder.rstrip("/"), list(keys), buckets, database

    def _table(self, name: str, of: str) -> str:
        digest = hashlib.sha256("\n".join([self.folder, name, of, str(self.buckets), *self.keys]).encode()).hexdigest()[:16]
        return f"{self.database}.feature_{''.join(c if c.isalnum() else '_' for c in name).lower()}_{digest}"

    def put(self, name: str, df: DataFrame, of: str = "") -> DataFrame:
        """Write ``df`` (keys and columns) as the entry ``name`` made from ``of``, and return the stored table."""
        table = self._table(name, of)
        (df.repartition(self.buckets, *self.keys).write.mode("overwrite").format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
         .option("path", f"{self.folder}/{table.rpartition('.')[2]}").saveAsTable(table))
        rows = identity(self.spark.table(table).select(*self.keys))  # reads the keys alone
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('feature.keys' = '{rows}')")
        return self.spark.table(table)

    def get(self, name: str, of: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The entry ``name`` made from ``of``; ``build()`` makes it if there is none."""
        table = self._table(name, of)
        if self.spark.catalog.tableExists(table):
            return self.spark.table(table)
        return self.put(name, build(), of)

    def stack(self, names: list[tuple[str, str]]) -> DataFrame:
        """The entries side by side, by key; entries that do not have the same keys raise.  No row is shuffled.

        Whether the keys are the same is known from when the entries were written, so the join itself is
        an inner one, which keeps the buckets (a full outer join would lose them).
        """
        out = first = None
        for name, of in names:
            table = self._table(name, of)
            if not self.spark.catalog.tableExists(table):
                raise FileNotFoundError(f"feature {name!r} is not in the store")
            rows = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}["feature.keys"]
            if first is None:
                first, out = (name, rows), self.spark.table(table)
                continue
            if rows != first[1]:
                raise ValueError(f"features {first[0]!r} and {name!r} have rows without a partner")
            out = out.join(self.spark.table(table).hint("merge"), self.keys)
        return out
