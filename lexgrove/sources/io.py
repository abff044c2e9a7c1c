"""Sources and sinks: strict delimited scans, typed round trips, ordered Parquet, all-or-nothing publishing, verification."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lexgrove.functions import text as T
from lexgrove.operators.graph import cut, shared_folder

MOST_ROWS = 10_000  # of a result that is shown


class SourceError(ValueError):
    """What a source has isn't what it must have."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session's executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_tsv(spark: SparkSession, path: str, schema: StructType, key: list[str], excluded: tuple[str, ...] = (), counters: dict[str, Column] | None = None) -> tuple[DataFrame, list[str], dict[str, int]]:
    """Rows of a tab-separated file with a header, the columns it has besides the schema's, and counts.

    Quotes are data and empty means null. A required column that is missing, a ragged row and a
    repeated key are errors; excluded columns are neither read nor reported. Besides the header the
    file is read once: ragged rows and whatever `counters` name (conditions on the rows) are
    counted as the rows go by, and repeated keys are looked for in what was read.
    """
    header = spark.read.option("sep", "\t").option("quote", "").option("header", True).option("inferSchema", False).csv(path).columns
    if missing := [f.name for f in schema if f.name not in header]:
        raise SourceError(f"columns missing: {', '.join(missing)}")
    # every column is read as a string with the corrupt-record column, so a ragged row shows itself
    full = ", ".join(f"`{c}` string" for c in header) + ", `_ragged` string"
    raw = spark.read.schema(full).option("sep", "\t").option("quote", "").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_ragged").csv(path)
    clean = raw.select("_ragged", *(F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema))
    seen = Observation()
    counts = [F.count_if(c).alias(name) for name, c in (counters or {}).items()]
    counted = clean.observe(seen, F.count("*").alias("rows"), F.max("_ragged").alias("ragged"), *counts)
    df = cut(counted.drop("_ragged"))
    found = dict(seen.get)
    if ragged := found.pop("ragged"):
        raise SourceError(f"ragged row: {ragged}")
    if (twice := df.groupBy(*key).count().where("count > 1").limit(1).collect()):
        raise SourceError(f"repeated key: {', '.join(str(twice[0][k]) for k in key)}")
    return df, [c for c in header if c not in schema.names and c not in excluded], found


def write_tsv(df: DataFrame, path: str, null: str = "") -> None:
    df.write.option("sep", "\t").option("quote", "").option("header", True).option("nullValue", null).option("emptyValue", "").option("escapeQuotes", False).csv(path)


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Typed staging: written with \\N for null and read back under the same schema, bad rows fatal."""
    df.write.option("sep", "\t").option("nullValue", "\\N").option("emptyValue", '""').option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return df.sparkSession.read.schema(df.schema).option("sep", "\t").option("nullValue", "\\N").option("mode", "FAILFAST").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def write_ordered(df: DataFrame, path: str, key: list[str], attribution: str | None = None) -> None:
    """Parquet in key order across files, so ranges of the key read few row groups; attribution goes to the columns' metadata."""
    if attribution:
        df = df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata | {"attribution": attribution}) for f in df.schema))
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(path)


def publish(df: DataFrame, path: str, own: str = "_lexgrove") -> None:
    """Replaces what an earlier publish left at path, and only as a whole; a folder of other origin is refused.

    The new files are complete beside the old ones before any name changes, and names change by
    the file system's rename, so a failed build leaves the old table.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    mark = jvm.org.apache.hadoop.fs.Path(at, own)
    if fs.exists(at) and not fs.exists(mark):
        raise SourceError(f"{path} holds something else")
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("tmp", "old"))
    try:
        df.write.parquet(new.toString())
        fs.create(jvm.org.apache.hadoop.fs.Path(new, own)).close()
    except Exception:
        fs.delete(new, True)
        raise
    if fs.exists(at) and not fs.rename(at, old):
        fs.delete(new, True)
        raise SourceError(f"could not move the old table away from {path}")
    try:
        moved = fs.rename(new, at)
    except Exception:
        moved = False
    if not moved:
        if fs.exists(old):
            fs.rename(old, at)
        raise SourceError(f"could not move the new table to {path}")
    fs.delete(old, True)


BLOCK = 8 << 20  # bytes of a file that are in memory at once


class _FilesReader(DataSourceReader):
    """A task for each file; relative path, bytes and SHA-256 come back, or why it could not be read."""

    def __init__(self, options: dict) -> None:
        self.root, self.block = options["path"], int(options.get("block", BLOCK))

    def partitions(self) -> list[InputPartition]:
        fs, at = pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        return [InputPartition((f.path, f.path.removeprefix(at.rstrip("/") + "/"))) for f in found if f.is_file]

    def read(self, partition: InputPartition):
        import hashlib

        path, name = partition.value
        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else pafs.LocalFileSystem()
        digest, size = hashlib.sha256(), 0
        with fs.open_input_stream(path) as f:
            while block := f.read(self.block):
                digest.update(block)
                size += len(block)
        yield name, size, digest.hexdigest()


class HashedFiles(DataSource):
    """spark.read.format("hashed_files").load(folder): (file, bytes, sha256) of every file below a folder, each streamed in blocks by one task."""

    @classmethod
    def name(cls) -> str:
        return "hashed_files"

    def schema(self) -> str:
        return "file string, bytes long, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FilesReader(self.options)


def hashed_files(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(file, bytes, sha256): files by their path below the folder. A file of any size takes one task and `block` bytes of memory."""
    spark.dataSource.register(HashedFiles)
    return spark.read.format("hashed_files").option("block", block).load(folder)


def verify_files(spark: SparkSession, folder: str, lock: DataFrame) -> DataFrame:
    """(file, status) for the files, by relative path, that a lock (file, sha256) names: ok, missing or changed."""
    found = hashed_files(spark, folder).select("file", F.col("sha256").alias("have"))
    return lock.join(found, "file", "left").select("file", F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("sha256"), "ok").otherwise("changed").alias("status"))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the declared columns, in their order and types; anything more or less is an error."""
    if set(df.columns) != set(schema.names) or len(df.columns) != len(schema.names):
        raise SourceError(f"columns are {sorted(df.columns)}, declared are {sorted(schema.names)}")
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema))


def json_rows(df: DataFrame, build_id: str | Column) -> DataFrame:
    """(row, build_id): each row as a JSON object, nested values included, with the build it comes from."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("row"), (F.lit(build_id) if isinstance(build_id, str) else build_id).alias("build_id"))


def envelope(df: DataFrame, order: list[str], limit: int, build_id: str | Column) -> DataFrame:
    """One row (build_id, columns, citable, row_count, truncated, rows): the first `limit` rows of a result in order, as JSON, and what is known of it.

    citable names the columns that hold nothing but citable ids; one row more than the limit is taken to see whether there
    were more. The limit bounds what comes together in the row.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise SourceError(f"a result has 1 to {MOST_ROWS} rows")
    some = df.orderBy(*order).limit(limit + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows at most
    shown = F.col("_n") <= limit
    row = F.when(shown, F.struct("_n", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")))
    texts = [c for c, t in df.dtypes if t == "string"]
    known = lambda c: F.coalesce(F.bool_and(F.when(shown & F.col(c).isNotNull(), F.coalesce(T.kind_of(F.col(c)).isin(*T.CITABLE), F.lit(False)))), F.lit(False))
    citable = F.filter(F.array(*(F.when(known(c), F.lit(c)) for c in texts)), lambda c: c.isNotNull()) if texts else F.array().cast("array<string>")
    out = some.agg(F.least(F.count("*"), F.lit(limit)).alias("row_count"), (F.count("*") > limit).alias("truncated"), citable.alias("citable"), F.transform(F.sort_array(F.collect_list(row)), lambda x: x["json"]).alias("rows"))
    build = F.lit(build_id) if isinstance(build_id, str) else build_id
    return out.select(build.alias("build_id"), F.array(*map(F.lit, df.columns)).alias("columns"), "citable", "row_count", "truncated", "rows")


def subset(df: DataFrame, key: str, prefixes: tuple[str, ...], drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key begins with one of the prefixes, without the dropped columns; none of them may be the key."""
    if key in drop:
        raise SourceError(f"{key} is the key")
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(key).startswith(p)
    return df.where(hit).drop(*drop)
