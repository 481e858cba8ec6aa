"""Shared helpers: durable intermediate tables, size-checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import contextlib
import posixpath
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few fixed-width columns, at most 64 bytes a row) may be broadcast.
BROADCAST_ROWS = 200_000
#: Setting by which a query's shuffle files are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    """Best effort: a session that has ended, or a folder that has gone, leaves nothing to do."""
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session in one process (tests, local runs) may do without: it gets a temporary one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def durable(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, its lineage cut.

    A written table is planned by its real size; a checkpoint inherits the size estimated for its plan, a product that
    squares with every round of joins until planning stalls. The write's shuffle files go as soon as it has ended. Tables go
    when they are discarded, or when Python exits.
    """
    spark = df.sparkSession
    path = posixpath.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_delete, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable() wrote and that nothing reads any more."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            _delete(table.sparkSession, path)


#: Rows that a Python worker is sent at a time, at most.
BATCH_ROWS = 256


def in_batches(df: DataFrame) -> DataFrame:
    """df, its session set to send Python workers few rows at a time: texts may be long, and workers keep the memory of their largest batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


#: log2 of the most bits in a map of marks: 16 MB.
MAP_BITS = 27


def maybe_marked(x: DataFrame, column: str, marks: DataFrame, mark: str) -> DataFrame:
    """The rows of x whose hash (a long) is among the marks, and some others: a cheap filter before x is shuffled to be joined.

    The marks' top bits are set in a bit map of 16 bits for each mark, 2 ** MAP_BITS at most. Past that it lets more rows
    through, and the join still decides.
    """
    log = min(MAP_BITS, max(10, (16 * marks.count()).bit_length()))
    word, bit = f"cast(shiftrightunsigned({{}}, {70 - log}) AS int)", f"shiftleft(1L, cast(shiftrightunsigned({{}}, {64 - log}) & 63 AS int))"
    every = x.sparkSession.range(1 << (log - 6)).selectExpr("cast(id AS int) AS word", "0L AS bit")
    table = durable(marks.selectExpr(f"{word.format(mark)} AS word", f"{bit.format(mark)} AS bit").union(every).groupBy("word").agg(F.bit_or("bit").alias("bits")))
    bits = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("map")).scalar()
    return x.where(F.get(bits, F.expr(word.format(column))).bitwiseAND(F.expr(bit.format(column))) != 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df hinted for broadcast if its counted rows stay within the limit; unhinted (a shuffled join) beyond it."""
    return F.broadcast(df) if rows <= limit else df


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    Each round hooks every node to its smallest neighbour and follows that neighbour's own hook (small star plus
    pointer jumping), so paths shorten geometrically. Only minima are aggregated, never neighbour lists, and each
    round's edges are written to the shared checkpoint folder. An empty edge table gives an empty result. Loops and
    null ends are ignored; repeated edges count once.
    """
    e = (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
        if {a, b} != {"hi", "lo"}
        else edges.where("hi != lo").distinct()
    )
    e = durable(e)
    while True:
        parent = durable(e.groupBy("hi").agg(F.min("lo").alias("root")))
        hooked = e.join(parent, "hi").where("lo != root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"), F.lit(1).alias("moved"))
        forest = parent.select("hi", F.col("root").alias("lo"), F.lit(0).alias("moved"))
        up = parent.select(F.col("hi").alias("mid"), F.col("root").alias("top"))
        jumped = forest.union(hooked).join(up, F.col("lo") == F.col("mid"), "left")
        e2 = jumped.select(
            "hi", F.coalesce("top", "lo").alias("lo"), F.when(F.col("top").isNotNull(), 1).otherwise(F.col("moved")).alias("moved")
        ).where("hi != lo")
        e2 = durable(e2.groupBy("hi", "lo").agg(F.max("moved").alias("moved")))
        moved = e2.agg(F.max("moved")).first()[0]
        discard(e, parent)
        e = e2
        if not moved:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
