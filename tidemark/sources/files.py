"""Columnar and text sources: typed and string-typed tables, row groups, footers, byte ranges, listings."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark) -> str:
    """The session's checkpoint folder, which all executors share. A cluster has to name it in spark.checkpoint.dir; a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def workspace(spark) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def discard(spark, path: str) -> None:
    """Deletes a folder of intermediate results that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def parallelize(spark, rows: list, schema, partitions: int = 2) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(partitions)


def scan_parquet(spark, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A typed scan; Spark splits it by bytes, prunes columns and pushes filters."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def write_parquet(df: DataFrame, path: str, row_group_bytes: int | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", min(row_group_bytes, 1 << 20))
    writer.parquet(path)


def dynamic_columns(maps: DataFrame, column: str = "row") -> list[str]:
    """The union of the maps' keys, sorted."""
    return [r[0] for r in maps.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").collect()]


def from_maps(maps: DataFrame, column: str = "row") -> DataFrame:
    """Rows of string maps as nullable string columns."""
    return maps.select(*(F.col(column)[k].alias(k) for k in dynamic_columns(maps, column)))


def to_maps(df: DataFrame) -> DataFrame:
    """Rows as string maps without the null fields."""
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns)), lambda e: e["value"].isNotNull())
    return df.select(F.map_from_entries(entries).alias("row"))


def read_dynamic(spark, path: str, predicate: Column | None = None) -> DataFrame:
    """A string-typed table of files whose columns may differ; predicates compare as text."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    df = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    return df if predicate is None else df.filter(predicate)


def write_csv(df: DataFrame, path: str) -> None:
    """A header, empty for null, quotes doubled."""
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    text.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark, path: str, schema: str | None = None, multi_line: bool = True, header: bool = True) -> DataFrame:
    """All columns are text; blank lines are skipped, short rows leave the trailing columns null.

    Quoted values may hold line feeds, for which a file is one task; without multi_line files are split.
    """
    reader = spark.read.option("header", header).option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def files_of(spark, path: str, glob: str = "*.parquet") -> DataFrame:
    """(path, size) of the files below a path, as Spark lists them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"))


FOOTER = (
    "path string, row_group int, rows long, column string, type string, repetition string, offset long, bytes long, min string, max string, nulls long, values long"
)


#: Rows of footers that a task hands over at once.
FOOTER_ROWS = 4096

#: Consecutive row groups of a file that are read at one opening.
GROUPS_PER_TASK = 256

#: Stores that pyarrow reads by itself, so that only footers and wanted row groups are fetched.
RANGED = ("file", "s3", "gs", "gcs", "abfs", "abfss")


def _with_files(spark, path: str, files: DataFrame) -> tuple[DataFrame, bool]:
    """files with `content`, null where tasks can open the path themselves; and whether they can."""
    scheme = path.split(":", 1)[0] if "://" in path or path.startswith("file:") else "file"
    if scheme in RANGED and "://" not in path.removeprefix(f"{scheme}://"):
        return files.withColumn("content", F.lit(None).cast("binary")), True
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.join(whole.select("path", "content"), "path"), False


def _open(path: str, content) -> pq.ParquetFile:
    if content is not None:
        return pq.ParquetFile(io.BytesIO(content))
    store, name = fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/"))
    return pq.ParquetFile(store.open_input_file(name))


def footer_metadata(spark, path: str) -> DataFrame:
    """One row for each column of each row group of each file, from the footers.

    Tasks fetch the footers alone where pyarrow knows the store; from others Spark's reader brings the files.
    """
    files, _ = _with_files(spark, path, files_of(spark, path).select("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOOTER.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in FOOTER.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                meta = _open(name, content.as_py()).metadata
                for g in range(meta.num_row_groups):
                    if len(rows) >= FOOTER_ROWS:
                        yield table(rows)
                        rows = []
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk, leaf = group.column(c), meta.schema.column(c)
                        s = chunk.statistics
                        bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                        start = chunk.dictionary_page_offset if chunk.has_dictionary_page else chunk.data_page_offset
                        rows.append((name, g, group.num_rows, leaf.path, chunk.physical_type, "OPTIONAL" if leaf.max_definition_level else "REQUIRED", start, chunk.total_compressed_size, *bounds, s.null_count if s is not None else None, chunk.num_values))
                yield table(rows)

    return files.select("path", "content").mapInArrow(run, FOOTER)


def scan_row_groups(spark, path: str, groups: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the named row groups (path, row_group) only; other row groups aren't fetched where pyarrow knows the store.

    A task has the row groups of one file in runs of consecutive ones, up to GROUPS_PER_TASK, and opens the file and parses its footer once a run.
    """
    names = [f.name for f in schema]
    work = groups.select("path", "row_group").distinct()
    files, _ = _with_files(spark, path, work.groupBy("path", F.floor(F.col("row_group") / GROUPS_PER_TASK).alias("run")).agg(F.sort_array(F.collect_list("row_group")).alias("row_groups")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                file = _open(name, content.as_py())
                for group in own:
                    yield from file.read_row_group(group, columns=names).to_batches()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, in turn: small shuffles by keys are joined to one task
    return files.repartition(tasks).select("path", "content", "row_groups").mapInArrow(run, schema)


def read_range(spark, path: str, offset: int, length: int) -> DataFrame:
    """(path, bytes) of a slice: a negative offset is 0, a length of 0 or less goes to the end, past the end is empty.

    Tasks fetch the slice alone where pyarrow knows the store; from others Spark's reader brings the files.
    """
    start = max(offset, 0)
    scheme = path.split(":", 1)[0] if "://" in path or path.startswith("file:") else "file"
    files = spark.read.format("binaryFile").load(path)
    if scheme not in RANGED:
        end = F.lit(start + length) if length > 0 else F.col("length")
        size = F.greatest(F.least(end, F.col("length")) - start, F.lit(0))
        return files.select("path", F.substring(F.col("content"), F.lit(start + 1), size.cast("int")).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(name.replace("file:///", "/").replace("file:/", "/"))
                with store.open_input_file(inner) as f:
                    size = f.size()
                    f.seek(min(start, size))
                    out.append(f.read(length if length > 0 else None) if start < size else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["path", "bytes"])

    return files.select("path").mapInArrow(run, "path string, bytes binary")


def list_objects(listings: list[DataFrame], prefix: str = "") -> DataFrame:
    """The keys with a prefix that any node lists, once each, in order."""
    keys = listings[0].select("key")
    for more in listings[1:]:
        keys = keys.unionByName(more.select("key"))
    return keys.filter(F.col("key").startswith(prefix)).distinct().orderBy("key")


def latest_versions(versions: DataFrame, with_markers: bool = False) -> DataFrame:
    """Each key's version with the largest mod_time (of equal ones the largest version_id); keys whose latest is a delete marker go."""
    others = [c for c in versions.columns if c != "key"]
    latest = versions.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("mod_time", "version_id")).alias("v")).select("key", *(F.col(f"v.{c}") for c in others))
    return latest if with_markers else latest.filter("not deleted")
