"""What several operators share: checkpoints, joins by keys that may be hot, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 1000  # so many keys at most can each have more than one row in so many
HOT_ROWS = 1000  # keys with fewer rows are never hot
TASK_LINKS = 1 << 17  # links whose ends one task joins


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, kept in the shared checkpoint folder of the session.

    A session on one machine that names no folder (tests) gets a temporary one; on a cluster a
    folder must be named, as executors don't see the driver's own disk.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """The frame cut, in as many partitions as hold so many rows each, so that small frames leave few files behind."""
    own = cut(df)
    return own.coalesce(max(1, -(-own.count() // rows)))


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The frame as a compressed table in the shared folder, where it takes less room than a checkpoint, and what deletes it."""
    path = f"{_shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), lambda: at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def attach(left: DataFrame, by: DataFrame, key: list[str], total: int, count: str = "n_rows", look: bool = False, most: int | None = None, how: str = "inner") -> DataFrame:
    """left joined with `by`, which has a row for each key and in `count` the rows that left has of it, at least.

    total: rows of left, about. A key with more than HOT_ROWS rows and one in HOT_KEYS of all is
    hot; there can't be more than HOT_KEYS of those, so they are broadcast and left's rows of
    them stay where they are. Only rows of other keys are shuffled. look: first see whether
    there are hot keys at all, where `by` is cheap to read, and merge the rest, as each
    broadcast takes driver memory; most, the rows of the most frequent key, tells that without
    a look. how: inner, or left to keep left's rows whose key `by` lacks.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    many = F.col(count) > least
    hot = by.where(many).drop(count)
    rest = by.where(~many).drop(count)
    merge = look or most is not None
    if merge and (hot.isEmpty() if most is None else most <= least):
        return left.join(by.drop(count).hint("merge"), key, how)
    cold = left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest.hint("merge") if merge else rest, key, how)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n_rows"))
    return attach(both.where("b > a"), least, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows"))
    moved = attach(down, least, ["a"], total).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between ids -> (id, root): the smallest id reachable, for each id that has a link.

    Alternates large and small stars until nothing changes. Nothing is collected: the driver
    sees one count and one checksum a round. Vertices with very many links are joined where
    their links are. Links with a null end and of an id to itself are ignored; repeated links
    count once; no links give no rows. Two ids of a link have one type that can be ordered.
    """
    links, drop = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = (links.count(),)
    while True:
        # a table, as its size is read: a checkpoint keeps a guessed one, whose digits each round's joins would multiply
        stars, drop_stars = written(_small_star(cut(_large_star(links, before[0])), before[0]))
        drop()
        links, drop = stars, drop_stars
        now = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())
        if now == before:
            break
        before = now
    links = cut(links)
    drop()
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: each vertex beside the smallest one that the task's links join it to."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for b in batches:
        kind = b.schema
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    if kind is not None:
        rows = [(x, r) for x in list(up) if (r := root(x)) != x]
        for i in range(0, len(rows), TASK_LINKS):
            part = rows[i : i + TASK_LINKS]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], kind.field("a").type), pa.array([r for _, r in part], kind.field("b").type)], names=["a", "b"])


def components_by_parts(links: DataFrame) -> DataFrame:
    """What components gives, after the links were contracted in tasks of TASK_LINKS.

    A task joins the ends of its links and leaves a star for each group, so the rounds that
    follow start from fewer and shorter ways. If all links fit one task, its stars are the answer.
    """
    own = cut(links.where("a <> b").select("a", "b"))
    parts = max(1, -(-own.count() // TASK_LINKS))
    stars = cut(own.repartition(parts).mapInArrow(_contract, own.schema))
    if parts > 1:
        return components(stars)
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b")).distinct())
