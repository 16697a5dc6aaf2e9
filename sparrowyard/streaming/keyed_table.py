"""A keyed table of Parquet files that takes upserts at the cost of the batch, not of the table.

Every batch becomes a **run**: its newest row per key, in folders by bucket of the key. A run covers a range of batch
numbers, which its name tells, and counts once it is complete (``_SUCCESS``). Runs are **compacted** in tiers:
as soon as ``fan`` runs of one level follow each other, they become one run of the next level, so a row is rewritten
once a level, some log(batches) times in all. The set of complete runs that no other run covers is the table's
manifest: it follows from the names alone, so a writer that dies leaves nothing half done. A reader takes each key's
row with the greatest order over these runs; equal orders keep the row of the earlier batch.

A batch that comes again is known by its number and changes nothing. Covered runs are removed one batch after
their successor is complete, so a reader that has just listed them can finish.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAME = "L{}_{}_{}"


class KeyedTable:
    """The table below ``path``. Keys, order and buckets are stored on the first write; later they may be left out."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, order: str | None = None, buckets: int = 8, fan: int = 8) -> None:
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        stored = self._stored()
        if stored is None and keys is not None:
            stored = {"keys": keys, "order": order, "buckets": buckets}
        elif stored is not None and keys is not None and [keys, order] != [stored["keys"], stored["order"]]:
            raise ValueError(f"{path} has keys {stored['keys']} in order of {stored['order']}")
        self.about = stored

    def _stored(self) -> dict | None:
        file = self._at(f"{self.path}/_table.json")
        if not self._fs.exists(file):
            return None
        stream = self._fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _store(self, schema: StructType) -> None:
        if "schema" in self.about:
            return
        self.about["schema"] = schema.json()
        out = self._fs.create(self._at(f"{self.path}/_table.json"), True)
        out.write(bytearray(json.dumps(self.about).encode()))
        out.close()

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.about["schema"]))

    def _complete(self) -> list[tuple[int, int, int]]:
        """Level, first and last batch of every complete run."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(tuple(map(int, n[1:].split("_"))) for n in names if n[0] == "L" and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def runs(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """The runs that make up the table, by batch: complete ones that no other run covers (``before``: of earlier batches)."""
        found = [r for r in self._complete() if before is None or r[2] < before]
        return sorted((r for r in found if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)), key=lambda r: r[1])

    def _read(self, runs: list[tuple[int, int, int]], buckets: list[int] | None = None) -> DataFrame:
        """Rows of runs with their bucket and the run's first batch."""
        parts = None
        for r in runs:
            rows = self.spark.read.schema(self.schema.add("_bucket", "integer")).parquet(f"{self.path}/{_NAME.format(*r)}").withColumn("_batch", F.lit(r[1]).cast("long"))
            rows = rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))
            parts = rows if parts is None else parts.unionByName(rows)
        return parts

    def _newest(self, rows: DataFrame) -> DataFrame:
        order = F.struct(F.col(self.about["order"]), (-F.col("_batch")).alias("b"))
        newest = rows.groupBy(*self.about["keys"], "_bucket").agg(F.max_by(F.struct(*self.schema.names), order).alias("r"))
        return newest.select("r.*", "_bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.about["keys"]), F.lit(self.about["buckets"])).cast("int")

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        rows.repartition(self.about["buckets"], "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{_NAME.format(*run)}")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Put a batch; for foreachBatch."""
        covered = [r for r in self._complete() if r not in self.runs()]
        if any(a <= number <= b for _, a, b in self.runs()):
            return
        self._store(batch.schema)
        rows = batch.select(*self.schema.names).withColumn("_bucket", self._bucket()).withColumn("_batch", F.lit(number).cast("long"))
        self._write(self._newest(rows), (0, number, number))
        for r in covered:
            self._fs.delete(self._at(f"{self.path}/{_NAME.format(*r)}"), True)
        self.compact()

    def compact(self) -> None:
        """Merge the last ``fan`` runs of a level into one of the next, as long as there are so many."""
        while True:
            runs = self.runs()
            if not runs:
                return
            level = runs[-1][0]
            last = []
            for r in reversed(runs):
                if r[0] != level:
                    break
                last.insert(0, r)
            if len(last) < self.fan:
                return
            last = last[-self.fan :]
            self._write(self._newest(self._read(last)), (level + 1, last[0][1], last[-1][2]))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table (as it was before a batch, as long as later ones are not compacted); none if nothing was written."""
        runs = self.runs(before)
        return self._newest(self._read(runs)).drop("_bucket") if runs else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """Rows of the given keys; only their buckets are read."""
        runs, names = self.runs(), self.about["keys"] if self.about else []
        if not runs:
            return None
        wanted = keys.select(*names).distinct()
        mine = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most one a bucket
        found = self._read(runs, mine).join(wanted, names, "left_semi") if mine else self._read(runs).limit(0)
        return self._newest(found).drop("_bucket")

    def bytes_of(self, run: tuple[int, int, int]) -> int:
        return self._fs.getContentSummary(self._at(f"{self.path}/{_NAME.format(*run)}")).getLength()
