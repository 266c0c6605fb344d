"""Versioned tables: data files named by a commit log of JSON actions, one file a version."""

from __future__ import annotations

import json
import os
import time
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import version_name, version_of
from tidemark.operators.prefix import Ranges, last
from tidemark.sources.files import files_of

ACTION = (
    "type string, path string, size long, modificationTime long, dataChange boolean, partitionValues map<string,string>, stats map<string,string>, "
    "tags map<string,string>, deletionTimestamp long, id string, name string, format string, configuration map<string,string>, partitionColumns array<string>, "
    "createdTime long, minReaderVersion int, minWriterVersion int, operation string, parameters map<string,string>, readVersion long, timestamp long, txn string"
)


def txn_parts(txn: Column) -> tuple[Column, Column]:
    """The query and the number of a txn `query:number`; one of another form is its own query with the number 0."""
    numbered = F.regexp_like(txn, F.lit("^.*:[0-9]{1,18}$"))
    number = F.substring_index(txn, ":", -1)
    query = F.when(numbered, F.substring(txn, F.lit(1), F.length(txn) - F.length(number))).otherwise(txn)
    return query, F.coalesce(F.when(numbered, number).try_cast("long"), F.lit(0))


#: Columns of these types have a least and a greatest value in the statistics.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.DateType)
MOST_BLOOM_BITS = 1 << 26


def plain_path(column: str) -> Column:
    """A path in one form, however Spark writes it; `file:` and its slashes go."""
    return F.regexp_replace(column, "^file:/+", "/")


def bloom_hash(value: Column) -> Column:
    """64 bits of a value; null for null."""
    return F.when(value.isNotNull(), F.xxhash64(value.cast("string")))


def bloom_places(hash_: str, bits: str) -> Column:
    """Six places of a value in a Bloom filter of `bits` bits, from the two halves of its hash."""
    return F.expr(f"transform(sequence(0, 5), i -> pmod(shiftrightunsigned({hash_}, 32) + i * (({hash_} & 4294967295) | 1), {bits}))")


class Conflict(Exception):
    """Another writer published a version after the one that this transaction read."""


def publish(spark, path: str, text: str) -> None:
    """A new file with this text, whole or not at all; FileExistsError if there is one of that name.

    A file beside it is written first and then linked (local folders) or renamed without overwriting (other stores).
    """
    jvm = spark._jvm
    part = f"{path}.{uuid.uuid4()}.part"
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    local = store.getUri().getScheme() == "file"
    if local:
        real = target.toUri().getPath()
        beside = f"{os.path.dirname(real)}/.{os.path.basename(part)}"
        with open(beside, "w") as f:
            f.write(text)
        try:
            os.link(beside, real)
        finally:
            os.unlink(beside)
        return
    out = store.create(jvm.org.apache.hadoop.fs.Path(part), False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(part), target, none)
    except Exception as e:
        store.delete(jvm.org.apache.hadoop.fs.Path(part), False)
        if "AlreadyExists" in str(e):
            raise FileExistsError(path) from e
        raise


class VersionedTable:
    """A table at a path. Reads and replays are DataFrames; only publishing a version is a step of the driver.

    Every `checkpoint_every` versions (0: never) the actions that still count are kept as Parquet in `_checkpoints`, so
    that a read takes the last one before its version and the log's few files after it.
    """

    def __init__(self, spark, path: str, checkpoint_every: int = 10):
        self.spark, self.path, self.checkpoint_every = spark, path, checkpoint_every

    # --- log -------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark, path: str, partition_columns: tuple[str, ...] = (), name: str | None = None, digest: tuple[str, int] | None = None) -> VersionedTable:
        """Version 0 holds the protocol and the metadata; a table that is there is opened.

        `digest` is a column of whole numbers and a width: of each file the digest of its rows in every range of that width is kept, by
        which diff_rows finds the ranges that two versions don't share.
        """
        table = cls(spark, path)
        if table.version() < 0:
            now = int(time.time() * 1000)
            protocol = {"type": "protocol", "minReaderVersion": 1, "minWriterVersion": 1}
            metadata = {"type": "metadata", "id": str(uuid.uuid4()), "name": name, "format": "parquet", "configuration": {"digest.key": digest[0], "digest.width": str(digest[1])} if digest else {}, "partitionColumns": list(partition_columns), "createdTime": now}
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_log")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
            try:
                table._publish(0, [protocol, metadata])
            except FileExistsError:
                pass  # another writer made it
        return table

    def _publish(self, version: int, actions: list[dict]) -> None:
        lines = "\n".join(json.dumps({k: v for k, v in a.items() if v is not None}) for a in actions)
        publish(self.spark, f"{self.path}/_log/{version:020d}.json", lines)

    def version(self) -> int:
        """The latest version, -1 for an empty table."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return -1
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return max((int(n[:20]) for n in names if len(n) == 25 and n[:20].isdigit() and n.endswith(".json")), default=-1)

    def actions(self, upto: int | None = None, after: int = -1) -> DataFrame:
        """(version, line, action) of every action; whole files are read, so that lines keep their order.

        Files up to the version `after` aren't opened: the name is a filter that the listing answers.
        """
        files = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.path}/_log", wholetext=True)
        if after >= 0:
            files = files.filter(F.col("_metadata.file_name") > f"{after:020d}.json")
        if upto is not None:
            files = files.filter(F.col("_metadata.file_name") <= f"{max(upto, 0):020d}.json")
        rows = files.select(version_of(F.col("_metadata.file_name")).alias("version"), F.posexplode(F.split("value", "\n")).alias("line", "json"))
        rows = rows.filter("version is not null and trim(json) <> ''")
        if upto is not None:
            rows = rows.filter(F.col("version") <= upto)
        return rows.select("version", "line", "json", F.from_json("json", ACTION).alias("action"))

    def _checkpoint(self, upto: int | None) -> int:
        """The last version up to this one with a finished checkpoint, else -1."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_checkpoints")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return -1
        names = sorted((s.getPath().getName() for s in store.listStatus(folder)), reverse=True)
        fit = (int(n) for n in names if n.isdigit() and (upto is None or int(n) <= upto))
        return next((v for v in fit if store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_checkpoints/{v:020d}/_SUCCESS"))), -1)

    def state(self, version: int | None = None) -> DataFrame:
        """(version, line, action) of the last checkpoint up to a version, and of all actions between the two."""
        at = self._checkpoint(version)
        later = self.actions(version, after=at).select("version", "line", "action")
        return later if at < 0 else self.spark.read.schema(later.schema).parquet(f"{self.path}/_checkpoints/{at:020d}").unionByName(later)

    def write_checkpoint(self, version: int) -> None:
        """Keeps what still counts at a version: active files, the last metadata and protocol, the last batch of each query that appends."""
        kind = F.when(F.col("action.type").isin("add", "remove"), "file").when(F.col("action.type").isin("metadata", "protocol"), F.col("action.type")).when(F.col("action.txn").isNotNull(), "txn")
        query, batch = txn_parts(F.col("action.txn"))
        name = F.when(F.col("kind") == "file", F.col("action.path")).when(F.col("kind") == "txn", query)
        last = (
            self.state(version)
            .withColumn("kind", kind)
            .filter("kind is not null")
            .groupBy("kind", name.alias("name"))
            .agg(F.max_by(F.struct("version", "line", "action"), F.struct(batch, "version", "line")).alias("last"))
        )
        last.select("last.*").filter("action.type <> 'remove'").write.parquet(f"{self.path}/_checkpoints/{version:020d}")

    def has_txn(self, txn: str) -> bool:
        """Whether a commit bears this txn; of one named `query:number`, whether the query has come to this number."""
        known, wanted = txn_parts(F.col("action.txn")), txn_parts(F.lit(txn))
        return not self.state().filter((known[0] == wanted[0]) & (known[1] >= wanted[1])).isEmpty()

    def files(self, version: int | None = None) -> DataFrame:
        """The active files: of each path the last action, if it is an add. Beyond the last version, that one; below 0, none."""
        named = self.state(version).filter("action.type in ('add', 'remove')")
        last = named.groupBy("action.path").agg(F.max_by("action", F.struct("version", "line")).alias("a"), F.max("version").alias("version"))
        return last.filter("a.type = 'add'").select("path", "a.size", "a.partitionValues", "version", "a.stats", "a.tags")

    def metadata(self, version: int | None = None) -> DataFrame:
        last = self.state(version).filter("action.type in ('metadata', 'protocol')").groupBy("action.type").agg(F.max_by("action", F.struct("version", "line")).alias("a"))
        return last.select("type", "a.partitionColumns", "a.format", "a.minReaderVersion", "a.minWriterVersion")

    def history(self) -> DataFrame:
        a = self.actions()
        per = a.groupBy("version").agg(
            F.max(F.when(F.col("action.type") == "commitInfo", F.col("action.operation"))).alias("operation"),
            F.max(F.when(F.col("action.type") == "commitInfo", F.col("action.readVersion"))).alias("read_version"),
            F.count_if(F.col("action.type") == "add").alias("adds"),
            F.count_if(F.col("action.type") == "remove").alias("removes"),
        )
        return per.orderBy("version")

    def detail(self, version: int | None = None) -> DataFrame:
        return self.files(version).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("version").alias("last_version"))

    def exported_actions(self) -> DataFrame:
        """(actionType, actionJson) of every action, to keep as Parquet; import_actions is the inverse."""
        return self.actions().select("version", "line", F.col("action.type").alias("actionType"), F.to_json("action").alias("actionJson"))

    @staticmethod
    def import_actions(exported: DataFrame) -> DataFrame:
        return exported.select("version", "line", F.from_json("actionJson", ACTION).alias("action"))

    # --- writing ---------------------------------------------------------------------------------

    def stage(self, df: DataFrame, partition_column: str | None = None, blooms: tuple[str, ...] = (), rows_per_file: int = 0) -> list[dict]:
        """Writes data files, as yet invisible; returns their add actions. A null in the partition column is an error.

        Each add bears the file's schema, and its statistics: rows and, of columns that have an order, the least and greatest
        value and the nulls. For the columns named in `blooms` it also has the size of a Bloom filter, whose bits stand in `_blooms`.
        """
        batch = str(uuid.uuid4())
        folder = f"{self.path}/data/{batch}"
        if partition_column:
            guarded = df.withColumn(partition_column, F.when(F.col(partition_column).isNull(), F.raise_error(F.lit(f"null in partition column {partition_column}")).cast(df.schema[partition_column].dataType)).otherwise(F.col(partition_column)))
            guarded.withColumn(f"p_{partition_column}", F.col(partition_column).cast("string")).write.option("maxRecordsPerFile", rows_per_file).partitionBy(f"p_{partition_column}").parquet(folder)
        else:
            df.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
        now = int(time.time() * 1000)
        value = F.regexp_extract("path", rf"/p_{partition_column}=([^/]*)/", 1) if partition_column else F.lit(None)
        found = self._statistics(df.schema, folder, blooms)
        if blooms:
            self._write_blooms(df.schema, folder, found, blooms, batch)
        if self.digest and self.digest[0] in df.columns:
            self._write_digests(df.schema, folder, batch)
        listed = files_of(self.spark, folder).select("path", "size", (F.url_decode(value) if partition_column else value).alias("value"), plain_path("path").alias("plain"))
        stats = {r["plain"]: {k: v for k, v in r["stats"].items() if v is not None} for r in found.collect()}  # one row for each file written
        tags = {"schema": df.schema.json()}
        return [
            {"type": "add", "path": r["path"], "size": r["size"], "modificationTime": now, "dataChange": True, "partitionValues": {partition_column: r["value"]} if partition_column else {}, "stats": stats.get(r["plain"], {}), "tags": tags}
            for r in listed.collect()
        ]

    def _written(self, schema: T.StructType, folder: str) -> DataFrame:
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        return rows.select("*", plain_path("_metadata.file_path").alias("plain_"))

    def _statistics(self, schema: T.StructType, folder: str, blooms: tuple[str, ...]) -> DataFrame:
        """(plain, stats) of the files below a folder."""
        aggregates = [F.count("*").cast("string").alias("rows")]
        for f in schema:
            if isinstance(f.dataType, ORDERED):
                c = F.col(f"`{f.name}`")
                aggregates += [F.min(c).cast("string").alias(f"min.{f.name}"), F.max(c).cast("string").alias(f"max.{f.name}"), F.count_if(c.isNull()).cast("string").alias(f"nulls.{f.name}")]
        each = self._written(schema, folder).groupBy(F.col("plain_").alias("plain")).agg(*aggregates)
        names = each.columns[1:]
        bits = F.least(F.greatest(F.pow(2, F.ceil(F.log2(F.col("rows").cast("long") * 10 + 1))), F.lit(1024)), F.lit(MOST_BLOOM_BITS)).cast("long").cast("string")
        pairs = [(n, F.when(F.length(f"`{n}`") <= 256, F.col(f"`{n}`"))) for n in names] + [(f"bloom.{c}", bits) for c in blooms]
        return each.select("plain", F.create_map(*(x for n, v in pairs for x in (F.lit(n), v))).alias("stats"))

    @property
    def digest(self) -> tuple[str, int] | None:
        if not hasattr(self, "_digest"):
            told = self.state().filter("action.type = 'metadata'").select(F.col("action.configuration").alias("c"), "version").orderBy(F.desc("version")).first()
            known = told["c"] if told and told["c"] else {}
            self._digest = (known["digest.key"], int(known["digest.width"])) if "digest.key" in known else None
        return self._digest

    def _write_digests(self, schema: T.StructType, folder: str, batch: str) -> None:
        """(plain, range, rows, total, mixed) of each file and range of the key: sums of its rows' hashes, which no order or layout changes."""
        key, width = self.digest
        hashed = self._written(schema, folder).select(F.col("plain_").alias("plain"), F.floor(F.col(f"`{key}`") / width).alias("range"), F.xxhash64(*(F.col(f"`{n}`") for n in sorted(schema.names)), F.lit(len(schema.names))).alias("h"))
        each = hashed.groupBy("plain", "range").agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))
        each.write.parquet(f"{self.path}/_digests/{batch}")

    def _ranges_that_differ(self, old: DataFrame, new: DataFrame, most: int = 100) -> list[tuple] | None:
        """Runs of ranges (first, last; None: rows without a key) in which two sets of files hold other rows; None if not all have digests.

        At most `most` runs, the nearest ones joined, come to the driver's plan; the digests are compared in Spark.
        """
        every = old.unionByName(new)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_digests")
        if not self.digest or not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        kept = self.spark.read.parquet(f"{self.path}/_digests/*")
        known = every.select(plain_path("path").alias("plain")).distinct()
        sized = every.select(plain_path("path").alias("plain"), F.col("stats")["rows"].cast("long").alias("n")).distinct()
        counted = kept.join(known, "plain", "left_semi").groupBy("plain").agg(F.sum("rows").alias("m"))
        if not sized.join(counted, "plain", "left").filter("coalesce(n, 0) <> coalesce(m, 0)").isEmpty():
            return None
        of = lambda files: kept.join(files.select(plain_path("path").alias("plain")), "plain", "left_semi").groupBy("range").agg(F.struct(F.sum("rows"), F.sum("total"), F.bit_xor("mixed")).alias("d"))
        a, b = of(old).alias("a"), of(new).alias("b")
        differ = a.join(b, F.col("a.range").eqNullSafe(F.col("b.range")), "full").filter(~F.col("a.d").eqNullSafe(F.col("b.d"))).select(F.coalesce("a.range", "b.range").alias("range"))
        none = not differ.filter("range is null").isEmpty()
        there = differ.filter("range is not null")
        # a run ends at the widest gaps, of which there are most - 1
        gaps = Ranges(there, [], "range").running(there, {"before": last(F.struct("range"))}, before=True).select("range", F.col("before.range").alias("before"))
        ends = there.agg(F.min("range"), F.max("range")).first()
        wide = sorted((r["before"], r["range"]) for r in gaps.filter(F.col("range") - F.col("before") > 1).orderBy(F.desc(F.col("range") - F.col("before")), "range").limit(most - 1).collect())
        runs = list(zip([ends[0], *(r for _, r in wide)], [*(b for b, _ in wide), ends[1]], strict=True)) if ends[0] is not None else []
        return runs + ([(None, None)] if none else [])

    def _write_blooms(self, schema: T.StructType, folder: str, stats: DataFrame, blooms: tuple[str, ...], batch: str) -> None:
        """Bits of each file and column as rows (plain, column, word, mask), in the order of columns and words.

        The tasks that read a file gather its words, so only those are shuffled, never its values; the statistics are one row a file.
        """
        own = [F.struct(F.lit(c).alias("column"), bloom_hash(F.col(f"`{c}`")).alias("hash")) for c in blooms]
        rows = self._written(schema, folder).select(F.col("plain_").alias("plain"), F.explode(F.array(*own)).alias("v")).select("plain", "v.*").filter("hash is not null")
        sized = rows.join(F.broadcast(stats), "plain").withColumn("bits", F.col("stats")[F.concat(F.lit("bloom."), "column")].cast("long"))
        words = sized.select("plain", "column", F.explode(bloom_places("hash", "bits")).alias("at"))
        masks = words.groupBy("plain", "column", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
        masks.sort("column", "word").write.parquet(f"{self.path}/_blooms/{batch}")

    def commit(self, actions: list[dict], read_version: int, operation: str, parameters: dict | None = None, txn: str | None = None) -> int:
        """Publishes read_version + 1; Conflict if there is a newer version than the one read."""
        info = {"type": "commitInfo", "operation": operation, "parameters": parameters or {}, "readVersion": read_version, "timestamp": int(time.time() * 1000), "txn": txn}
        if self.version() > read_version:
            raise Conflict(f"version {self.version()} is newer than {read_version}")
        try:
            self._publish(read_version + 1, [info, *actions])
        except FileExistsError as e:
            raise Conflict(f"version {read_version + 1} was published by another writer") from e
        if self.checkpoint_every and (read_version + 1) % self.checkpoint_every == 0:
            try:
                self.write_checkpoint(read_version + 1)
            except Exception as e:  # the version is published; reads take the checkpoint before
                warnings.warn(f"no checkpoint of version {read_version + 1}: {e}", stacklevel=2)
        return read_version + 1

    def append(self, df: DataFrame, partition_column: str | None = None, txn: str | None = None, blooms: tuple[str, ...] = ()) -> int:
        """One atomic commit; a txn that the log already has (has_txn) is not repeated."""
        read = self.version()
        if txn is not None and self.has_txn(txn):
            return read
        return self.commit(self.stage(df, partition_column, blooms), read, "WRITE", {"mode": "append"}, txn)

    def replace(self, df: DataFrame, txn: str | None = None) -> int:
        """Removes all active files and adds df's, in one commit."""
        read = self.version()
        now = int(time.time() * 1000)
        removed = [{"type": "remove", "path": r["path"], "size": r["size"], "deletionTimestamp": now, "dataChange": True} for r in self.files(read).select("path", "size").collect()]
        return self.commit([*removed, *self.stage(df)], read, "WRITE", {"mode": "replace"}, txn)

    def commit_with_retry(self, attempt: Callable[[VersionedTable, int], list[dict]], tries: int = 5) -> int:
        """attempt(table, read version) gives actions; after a conflict it is asked again over the newer version."""
        for k in range(tries):
            read = self.version()
            try:
                return self.commit(attempt(self, read), read, "WRITE", {"mode": "retry"})
            except Conflict:
                if k == tries - 1:
                    raise
        raise Conflict("no try was made")

    # --- reading ---------------------------------------------------------------------------------

    def schema(self, files: DataFrame) -> T.StructType | None:
        """The columns of all files, as their actions tell; a column that stands in several has the type of the newest."""
        told = files.groupBy(F.col("tags")["schema"].alias("schema")).agg(F.max("version").alias("version")).orderBy("version").collect()  # different schemas only
        if not told or any(r["schema"] is None for r in told):
            return None
        fields: dict[str, T.StructField] = {}
        for r in told:
            for f in T.StructType.fromJson(json.loads(r["schema"])):
                fields[f.name] = T.StructField(f.name, f.dataType, True)
        return T.StructType(list(fields.values()))

    def matching(self, files: DataFrame, schema: T.StructType | None, between: dict[str, tuple] | None = None, at: dict[str, object] | None = None) -> DataFrame:
        """Those of the files which may hold rows with columns between two values (None: open), or of a value, by their statistics alone."""
        for column, (low, high) in [*(between or {}).items(), *((c, (v, v)) for c, v in (at or {}).items())]:
            kind = schema[column].dataType if schema is not None and column in schema.names else None
            if not isinstance(kind, ORDERED):
                continue
            least, greatest = (F.col("stats")[f"{x}.{column}"].cast(kind) for x in ("min", "max"))
            known = F.col("stats")[f"nulls.{column}"]
            some = F.coalesce(known.cast("long") < F.col("stats")["rows"].cast("long"), F.lit(True))
            for bound, fits in ((low, greatest >= F.lit(low).cast(kind)), (high, least <= F.lit(high).cast(kind))):
                if bound is not None:
                    files = files.filter(F.coalesce(fits, F.lit(True)) & some)
        for column, value in (at or {}).items():
            if schema is None or column not in schema.names:
                continue
            kind = schema[column].dataType
            hashed = files.select("*", F.col("stats")[f"bloom.{column}"].cast("long").alias("bits_"), bloom_hash(F.lit(value).cast(kind)).alias("hash_"))
            wanted = hashed.filter("bits_ is not null").select(plain_path("path").alias("plain"), F.explode(F.array_distinct(bloom_places("hash_", "bits_"))).alias("at"))
            if wanted.isEmpty():
                continue
            bits = self.spark.read.parquet(f"{self.path}/_blooms/*").filter(F.col("column") == column)
            found = wanted.withColumn("word", F.shiftright("at", 6)).join(bits, ["plain", "word"], "left")
            hit = found.groupBy("plain").agg(F.bool_and(F.coalesce(F.expr("mask & shiftleft(1L, cast(at & 63 as int))") != 0, F.lit(False))).alias("hit"))
            missed = hit.filter("not hit").select("plain")
            files = files.withColumn("plain", plain_path("path")).join(missed, "plain", "left_anti").drop("plain")
        return files

    def read(self, version: int | None = None, *, between: dict[str, tuple] | None = None, at: dict[str, object] | None = None, **where: str) -> DataFrame:
        """The rows at a version; `where` keeps the files of a partition value, which the log alone decides.

        `between` (a column's least and greatest value, None: open) and `at` (a column's value) keep rows; files whose statistics or
        Bloom filters rule them out aren't opened. The schema comes from the log. The paths of the files to be read come to the
        driver, as in any scan; their rows don't.
        """
        files = self.files(version)
        for column, value in where.items():
            files = files.filter(F.col("partitionValues")[column] == value)
        schema = self.schema(files)
        rows = self._rows(self.matching(files, schema, between, at) if between or at else files, schema)
        for column, (low, high) in (between or {}).items():
            if low is not None:
                rows = rows.filter(F.col(column) >= F.lit(low))
            if high is not None:
                rows = rows.filter(F.col(column) <= F.lit(high))
        for column, value in (at or {}).items():
            rows = rows.filter(F.col(column) == F.lit(value))
        return rows

    def _rows(self, files: DataFrame, schema: T.StructType | None) -> DataFrame:
        """The rows of files; none of them, with the same columns, where there are no files."""
        paths = [r["path"] for r in files.select("path").collect()]
        if paths:
            return self.spark.read.schema(schema).parquet(*paths) if schema is not None else self.spark.read.option("mergeSchema", True).parquet(*paths)
        if schema is None:  # no files at this version: the columns are those of any version
            schema = self.schema(self.actions().filter("action.type = 'add'").select("action.tags", "version"))
        return self.spark.createDataFrame([], schema) if schema is not None else self.spark.createDataFrame([], "_none string").drop("_none")

    def pinned(self) -> Callable[[], DataFrame]:
        """A reader of the version that is the latest now."""
        version = self.version()
        return lambda: self.read(version)

    def diff_files(self, before: int, after: int) -> DataFrame:
        old, new = self.files(before).select("path", "size"), self.files(after).select("path", "size")
        gone = old.join(new, "path", "left_anti").withColumn("change", F.lit("removed"))
        return new.join(old, "path", "left_anti").withColumn("change", F.lit("added")).unionByName(gone)

    def diff_rows(self, before: int, after: int) -> DataFrame:
        """Rows added and removed between two versions; files that both have are not read.

        Of a table with digests only the ranges are read in which the versions' other files differ, and only the files that have them.
        """
        old, new = self.files(before), self.files(after)
        schema = self.schema(old.unionByName(new))
        gone, come = (a.join(b.select("path"), "path", "left_anti") for a, b in ((old, new), (new, old)))
        runs = self._ranges_that_differ(gone, come)
        if runs is None:
            gone, come = self._rows(gone, schema), self._rows(come, schema)
        else:
            gone, come = self._within(gone, schema, runs), self._within(come, schema, runs)
        return come.exceptAll(gone).withColumn("change", F.lit("added")).unionByName(gone.exceptAll(come).withColumn("change", F.lit("removed")))

    def _within(self, files: DataFrame, schema: T.StructType, runs: list[tuple]) -> DataFrame:
        """The rows of files in runs of ranges of the digests' key."""
        key, width = self.digest
        least, greatest, nulls = (F.col("stats")[f"{x}.{key}"].cast("long") for x in ("min", "max", "nulls"))
        some, rows = F.lit(False), F.lit(False)
        for first, final in runs:
            if first is None:
                some, rows = some | (nulls > 0), rows | F.col(f"`{key}`").isNull()
            else:
                low, high = first * width, (final + 1) * width
                some, rows = some | ((greatest >= low) & (least < high)), rows | ((F.col(f"`{key}`") >= low) & (F.col(f"`{key}`") < high))
        return self._rows(files.filter(F.coalesce(some, F.lit(True))), schema).filter(rows)

    def orphans(self, version: int | None = None) -> DataFrame:
        """Data files on disk that no active entry names."""
        return files_of(self.spark, f"{self.path}/data").join(self.files(version), "path", "left_anti").select("path", "size")

    def lost_updates(self) -> DataFrame:
        """(writer, files): written files that no version ever named, by the folder of their write."""
        named = self.actions().filter("action.type = 'add'").select("action.path").distinct()
        lost = files_of(self.spark, f"{self.path}/data").join(named, "path", "left_anti")
        return lost.groupBy(F.regexp_extract("path", r"/data/([^/]+)/", 1).alias("writer")).agg(F.count("*").alias("files"))


def log_names(versions: DataFrame) -> DataFrame:
    return versions.withColumn("name", version_name(F.col("version"))).withColumn("back", version_of(version_name(F.col("version"))))


def balances(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("account").agg(F.sum("delta").alias("balance"))


def running_balances(ledger: DataFrame) -> DataFrame:
    """(account, version, balance) as of each version of an append-only ledger in which the account changes."""
    each = ledger.groupBy("account", "version").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy("account").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("account", "version", F.sum("delta").over(order).alias("balance"))


def conservation(ledger: DataFrame, expected: int) -> DataFrame:
    """(version, total, conserved): the sum over all accounts as of each version against what it must be."""
    each = ledger.groupBy("version").agg(F.sum("delta").alias("delta"))
    order = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # one row a version
    return each.select("version", F.sum("delta").over(order).alias("total")).withColumn("conserved", F.col("total") == expected)
