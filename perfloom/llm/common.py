"""What the text operators share: word patterns, cut lineage, two-level ranks, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a local session without it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="perfloom-")


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder, written as Parquet and read again; gone at the end. What is returned must not depend on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.parquet(f"{self.folder}/{self.n}")

    def free(self) -> None:
        """Has Spark remove the shuffles behind kept tables: it does once the driver's JVM finds their plans unused, else long after."""
        gc.collect()
        self.spark._jvm.System.gc()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that further columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_hashes(df: DataFrame, seed: int = 42) -> list[Column]:
    """Two 64-bit hashes of all columns, nulls told apart from blanks by their places; maps count by their JSON."""

    def plain(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        return F.to_json(F.struct(F.col(f"`{c}`").alias("m"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`")

    parts = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), plain(c))]
    return [F.xxhash64(F.lit(seed + k), *parts) for k in (0, 104729)]


def same(left: str, right: str, *columns: str) -> Column:
    """A null-safe equi-join condition over columns of two aliased frames."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def match_counted(rows: DataFrame, found: DataFrame, key: str, n: str = "n", least: int = 10_000, share: int = 100_000) -> DataFrame:
    """Left join of rows to a table of one row for each key, whose column `n` (left out) counts the rows with it.

    A key of over `least` rows and over the `share`-th part of all comes by broadcast, so at most `share` keys do;
    the rest is dealt by key, and no key of it fills a task. Both sides are read more than once. Keys are not null.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    bound = max(least, total // share)
    hot, cold = found.filter(F.col(n) > bound).drop(n), found.filter(F.col(n) <= bound).drop(n)
    if hot.isEmpty():
        return rows.join(cold, key, "left")
    by_broadcast = rows.join(F.broadcast(hot), key)
    dealt = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return by_broadcast.unionByName(dealt)


def sum_arrays(df: DataFrame, group: list[str], column: str, fan: int = 64) -> DataFrame:
    """Rows (group, pos, n): the sum by place of a group's arrays, which tasks made. Arrays of `fan` neighbouring tasks are added as wholes first."""

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))

    lots = df.groupBy(*group, F.floor(F.spark_partition_id() / fan).alias("_lot")).agg(F.collect_list(column).alias("_all"))
    added = lots.select(*group, F.posexplode(F.aggregate("_all", F.array().cast("array<bigint>"), add)).alias("pos", "n"))
    return added.filter("n <> 0").groupBy(*group, "pos").agg(F.sum("n").alias("n"))


def with_running(df: DataFrame, group: list[str], bucket: str, order: list[str], add: str | None = None) -> DataFrame:
    """Adds `before`: within a group, the sum of `add` (or the number of rows) ahead of the row.

    Buckets must follow the order. Totals of buckets are summed first, so a task
    sorts one bucket and never a whole group; only the table of bucket totals
    is windowed by group.
    """
    by = [*group, bucket]
    unit = F.col(add) if add else F.lit(1)
    totals = df.groupBy(*by).agg(F.sum(unit).cast("long").alias("_total"))
    ahead = Window.partitionBy(*group or [F.lit(0)]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_inside", F.coalesce(F.sum(unit).over(inside), F.lit(0)))
    joined = local.alias("l").join(offsets.alias("o"), same("l", "o", *by))
    return joined.select("l.*", (F.col("o._offset") + F.col("l._inside")).cast("long").alias("before")).drop("_inside")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, root) with the smallest node of each; only linked nodes.

    Alternating large-star and small-star steps. Every step is a distinct and
    an aggregate over links; lineage is cut each round and only a count and a
    checksum reach the driver.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        both = near.join(low, "u")
        if small:
            out = both.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = settle(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = sign(e)
    while was[0]:
        e = settle(star(star(e, small=False), small=True))
        now = sign(e)
        if now == was:
            break
        was = now
    # at the end every link goes from a node to the smallest of its component
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
