"""What the operators of this subpackage share: written intermediates, ranks that scale, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/granary-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share, and below one of this application.

    Only where the session has no such setting and runs on one machine (tests) a local folder is set; else that is an error."""
    return f"{_scratch.get() or _base(spark)}/{uuid.uuid4().hex}"


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written within, unless it is to be kept, is deleted at the end: results must have been written by then."""
    path = shared_dir(spark)
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        _delete(spark, path)


def forget(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    _delete(df.sparkSession, df.written_to)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written there; results that weren't saved elsewhere can't be read any more."""
    _delete(spark, _base(spark))


#: Settings of Spark by which the shuffle files of a query go when it has ended, under the names of several versions.
CLEANED = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def written(df: DataFrame, name: str = "part", keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors. What was shuffled for it isn't
    needed any more and is deleted. keep: outside of a scratch() that it is written in."""
    spark = df.sparkSession
    path = f"{_base(spark)}/{uuid.uuid4().hex}/{name}" if keep else f"{shared_dir(spark)}/{name}"
    before = {key: spark.conf.get(key, None) for key in CLEANED}
    try:
        for key, value in before.items():
            if value is not None:
                spark.conf.set(key, "true")
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is not None:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text (null: empty) and the columns named, so that no other column can clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def key_of(*columns: str) -> Column:
    """16 bytes of SHA-256 of the columns: an identity for contents."""
    return F.unhex(F.substring(F.sha2(F.concat(*columns), 256), 1, 32))


def ranked(df: DataFrame, by: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """df with a long column: the sum of weight over the rows before, within by, in the order of a salt, then of `order`.

    No group is collected into one task: the salt has about the square root of the number of rows as
    values, sums go over each salt, and a window over the salts' sums gives where each one begins.
    df is read twice, so it should be a table."""
    salts = max(1, int(df.count() ** 0.5))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")).withColumn("_weight", weight)
    sums = salted.groupBy(*by, "_salt").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_salt").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_salt") == F.col("_of"))
    inner = salted.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return inner.join(starts, same).withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_salt", "_of", "_weight", "_start", "_inside", *[f"_{c}" for c in by])


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a long column for each of sums: that expression's sum over the rows before, in an order of the whole table.

    Rows are dealt by ranges of the order, which should have no ties; windows go over one range each, and over the
    ranges' sums, of which there are as many as partitions."""
    values = {f"_{name}": value for name, value in sums.items()}
    dealt = written(df.withColumns(values).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, inside = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("_part"), Window.partitionBy("_part").orderBy(*order)))
    parts = dealt.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    parts = parts.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_start{v}") for v in values])
    out = dealt.withColumns({f"_in{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(F.broadcast(parts), "_part")
    return out.select(*df.columns, *[(F.col(f"_start_{name}") + F.col(f"_in_{name}")).cast("long").alias(name) for name in sums])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has an edge.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and
    beyond"), which needs a logarithmic number of rounds; each round's edges are written. A step keeps
    only a minimum for each node, an aggregate with partial sums, so a hub is no hot key."""

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours, and u itself, point at the smallest of them
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        e = written(step(step(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
