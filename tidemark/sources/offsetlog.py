"""An offset log kept as a versioned table: files of consecutive offsets, which the commit log indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import logs
from tidemark.sources.versioned import Conflict, VersionedTable


class OffsetLog:
    """Messages of partitions with dense offsets, over any number of appends.

    The statistics of each file (its partition, first and last offset) are the log's sparse index. An append begins after the
    last offsets that the index has, and a fetch opens only the files whose offsets it wants.
    """

    def __init__(self, table: VersionedTable):
        self.table = table

    @classmethod
    def create(cls, spark, path: str) -> OffsetLog:
        return cls(VersionedTable.create(spark, path, partition_columns=("partition",)))

    def index(self, version: int | None = None) -> DataFrame:
        """(partition, first, last, path, version) of each file."""
        bound = lambda x: F.col("stats")[f"{x}.offset"].cast("long")
        return self.table.files(version).select(F.col("partitionValues")["partition"].alias("partition"), bound("min").alias("first"), bound("max").alias("last"), "path", "version")

    def ends(self, version: int | None = None) -> DataFrame:
        """(partition, end): the last offset of each partition."""
        return self.index(version).groupBy("partition").agg(F.max("last").alias("end"))

    def append(self, messages: DataFrame, seq: str = "seq", rows_per_file: int = 1 << 20, tries: int = 5) -> int:
        """Numbers messages (partition, seq and others) after those that the log has, in one commit; returns the version.

        If another writer is first, they are numbered anew after its messages. A null partition is an error; a null seq comes first.
        """
        kind = messages.schema["partition"].dataType
        for k in range(tries):
            read = self.table.version()
            ends = self.ends(read).withColumn("partition", F.col("partition").cast(kind))
            numbered = logs.assign_offsets(messages, seq=seq, ends=ends)
            laid = numbered.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset")
            staged = self.table.stage(laid, "partition", rows_per_file=rows_per_file)
            try:
                return self.table.commit(staged, read, "WRITE", {"mode": "append"})
            except Conflict:
                if k == tries - 1:
                    raise
        raise Conflict("no try was made")

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def fetch(self, bounds: DataFrame, start: int = 1, most: int | None = None, version: int | None = None) -> DataFrame:
        """Messages from `start` up to each partition's bound (partition, bound), `most` of each at most."""
        files = self.table.files(version)
        of = F.col("partitionValues")["partition"]
        limits = bounds.select(F.col("partition").cast("string").alias("of_"), F.col("bound").alias("bound_"))
        first, last = (F.col("stats")[f"{x}.offset"].cast("long") for x in ("min", "max"))
        wanted = files.join(limits, of == F.col("of_")).filter((last >= start) & (first <= F.col("bound_")))
        if most is not None:
            wanted = wanted.filter(first < start + most)
        return logs.fetch(self.table._rows(wanted, self.table.schema(files)), bounds, start, most)
