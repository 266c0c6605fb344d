"""Running streams over files to an end, and sinks that commit each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import recon
from tidemark.sources.files import workspace
from tidemark.sources.versioned import VersionedTable, txn_parts


def file_stream(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_files(stream: DataFrame, out: str | None = None, state: str | None = None) -> DataFrame:
    """All that the stream has now, through a file sink that commits each micro-batch once.

    With the folders of an earlier run, for the results and the state, the stream goes on where that one ended.
    """
    spark = stream.sparkSession
    out, state = out or workspace(spark), state or workspace(spark)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """each(rows, batch id) for every micro-batch; transitions of a detector reach their listeners so."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state or workspace(stream.sparkSession)).trigger(availableNow=True).start().awaitTermination()


def run_updates(stream: DataFrame, out: str | None = None, state: str | None = None) -> DataFrame:
    """What each micro-batch changes (output mode update), in a folder of its own, which a repeated batch writes anew."""
    spark = stream.sparkSession
    out, state = out or workspace(spark), state or workspace(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # there may be no batch
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def append_to_table(stream: DataFrame, table: VersionedTable, query: str) -> None:
    """Each micro-batch is one atomic commit, which a restart doesn't repeat."""
    run_batches(stream, lambda rows, batch: table.append(rows, txn=f"{query}:{batch}"))


class Watcher:
    """Follows a feed of changes (revision and others) into a table: first the state as listed, then each change after it, once.

    The commits of a query bear the revision that they reach as their number, so the table's log is the bookmark: a watcher that
    starts anew, with or without its stream's checkpoint, goes on after it. If the feed no longer holds all that came after the
    bookmark, the state is listed anew, which replaces the table's rows in one commit.
    """

    def __init__(self, table: VersionedTable, query: str = "watch"):
        self.table, self.query = table, query

    def bookmark(self) -> int | None:
        """The revision up to which the table has everything."""
        query, number = txn_parts(F.col("action.txn"))
        return self.table.state().filter(query == f"{self.query}:").agg(F.max(number)).first()[0]

    def list(self, feed: DataFrame, revision: int) -> None:
        """The state as of a revision, from a feed (key, revision, op, value) that holds every change up to it; rows are of the kind Added."""
        state = recon.materialize(feed.filter(F.col("revision") <= revision)).select("key", "revision", "value", F.lit("Added").alias("kind"))
        self.table.replace(state, txn=f"{self.query}:{revision}")

    def watch(self, changes: DataFrame, kept_from: int = 0, whole: tuple[DataFrame, int] | None = None, state: str | None = None) -> bool:
        """Takes all that the stream `changes` has now; whether the state had to be listed first.

        `kept_from` is the first revision from which on the feed holds all; `whole` what to list from, and its revision.
        """
        at, listed = self.bookmark(), False
        if at is None or at + 1 < kept_from:
            if whole is None:
                raise ValueError(f"the feed begins at {kept_from}, after the bookmark {at}, and there is nothing to list from")
            self.list(*whole)
            at, listed = self.bookmark(), True

        def take(rows: DataFrame, batch: int) -> None:
            new = rows.filter(F.col("revision") > self.bookmark()).select("key", "revision", "value", F.lit("Changed").alias("kind"))
            last = new.agg(F.max("revision")).first()[0]
            if last is not None:
                self.table.append(new, txn=f"{self.query}:{last}")

        run_batches(changes.filter(F.col("revision") > at), take, state)
        return listed
