"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Method. Sources' targets follow from weights and sizes (water filling below 2 times a source's size). Every source's rows
are dealt to blocks by hash; its blocks are put in a random order, repeated for each epoch, and as many as its target
needs are drawn. A binary tree then splits the vector of drawn blocks among output shards: each node gives half of its
blocks to its left child, how many of each source being multivariate hypergeometric, so every shard holds a random
sample of the whole mix with exact totals. Shards take disjoint runs of each source's block order; rows of a shard are
ordered by hash. The block at which a target is reached is taken in part: rows in hash order while they fit. What is left is
filled the same way, `FILLS` times at most, from rows of it and of the next `SPARE` blocks that are no larger, and at last
by the one whose size comes nearest.

Scale. Only DataFrame expressions. Row sizes are counted once into a narrow table; sources and blocks are pre-aggregated,
a source has at most `MAX_BLOCKS` blocks, so windows over a source and over a block stay bounded however hot it is.
The tree works on one number for each source and shard. Rows meet their block's draws by a broadcast while the table of
blocks is small and by a shuffle on (source, block) otherwise. All random choices are hashes: reruns agree.

Edge cases. A null source is a source, last in order; null and empty texts have size 0 and add nothing; a source of size
0 has target 0. Rows equal in id and text are taken alike. Other columns are carried by mix() under their own names, but
for a column already named shard or place, which is replaced. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable, read_table, small_side

#: Weights of sources in code point order, repeating; the mix's size as a share of all sizes; a source's most epochs.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Rows that a block aims at; most blocks of a source; levels of the splitting tree (2 ** LEVELS shards).
BLOCK_ROWS, MAX_BLOCKS, LEVELS = 32, 4096, 3
SPARE, FILLS = 8, 4
SEED = 20


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, n_rows, source_size, nr, target) from (source, size) rows; nr counts sources in order from 0."""
    s = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    s = s.withColumn("nr", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nr") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(EPOCHS)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    w, everything = Window.orderBy("ratio", "nr"), Window.partitionBy()
    total = F.lit(SHARE) * F.sum("source_size").over(everything)
    below = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - below) / F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nr", "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(free * F.col("weight"), F.col("cap")))
    return s.select("source", "n_rows", "source_size", "nr", target.alias("target"))


def _uniform(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *key), 11) / F.lit(float(1 << 53))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _left(node: str, quotas: str) -> Column:
    """Of a node's quotas (array of longs by source), what its left child gets: half of the total, multivariate hypergeometric."""
    total = F.aggregate(quotas, _long(0), lambda a, q: a + q)
    start = F.struct(F.floor(total / 2).cast("long").alias("left"), total.alias("all"), F.array().cast("array<bigint>").alias("out"))

    def source(a: Column, q: Column) -> Column:
        init = F.struct(a["left"].alias("left"), a["all"].alias("all"), F.size(a["out"]).cast("long").alias("nr"))

        def block(b: Column, i: Column) -> Column:
            yes = (_uniform(F.col(node), b["nr"], i) * b["all"] < b["left"]).cast("long")
            return F.struct((b["left"] - yes).alias("left"), (b["all"] - 1).alias("all"), b["nr"].alias("nr"))

        done = F.aggregate(F.filter(F.sequence(_long(0), q), lambda i: i > 0), init, block)
        return F.struct(done["left"].alias("left"), done["all"].alias("all"), F.concat(a["out"], F.array(a["left"] - done["left"])).alias("out"))

    return F.aggregate(quotas, start, source)["out"]


def split(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(nr, shard, quota) from (nr, quota), nr from 0 without gaps: the splitting tree."""
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "quota"))), lambda x: x["quota"]).alias("quotas")).withColumn("node", _long(1))
    for _ in range(levels):
        nodes = nodes.withColumn("left", _left("node", "quotas"))
        right = F.transform("quotas", lambda q, i: q - F.get("left", i))
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        nodes = nodes.select(F.explode(both).alias("x")).select("x.*")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.posexplode("quotas").alias("nr", "quota"))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), id_col, text_col)


def _block(n_rows: Column, key: str) -> Column:
    return F.pmod(F.col(key), F.least(_long(MAX_BLOCKS), F.ceil(n_rows / BLOCK_ROWS).cast("long"))).cast("int")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, draws, part).

    rows: id, key, source, size, source_size, target, nr, block of every row of docs. draws: nr, block and the shards that take
    the whole block. part: nr, block, key and shard of the rows that are taken besides.
    """
    sizes = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), _key(id_col, text_col).alias("key")))
    sources = durable(source_targets(sizes))
    n = sources.count()
    rows = sizes.join(small_side(sources, n), sizes.source.eqNullSafe(sources.source)).select("id", "key", sizes.source, "size", "source_size", "target", "nr", _block(F.col("n_rows"), "key").alias("block"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    blocks = rows.groupBy("nr", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    blocks = blocks.where("words > 0").withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    w = Window.partitionBy("nr").orderBy(F.xxhash64(F.lit(SEED), "nr", "block"), "block")
    blocks = blocks.withColumn("place", F.row_number().over(w) - 1).withColumn("end", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("left", F.col("rest") - (F.col("end") - F.col("words"))).withColumn("n", F.count("*").over(Window.partitionBy("nr")))
    blocks = durable(blocks.select("nr", "block", "place", "n", "epochs", "left", (F.col("end") <= F.col("rest")).alias("whole"), ((F.col("end") > F.col("rest")) & (F.col("left") > 0)).alias("cut")).withColumn("cut_at", F.max(F.when(F.col("cut"), F.col("place"))).over(Window.partitionBy("nr"))))
    draw = F.transform(F.sequence(_long(0), F.col("epochs")), lambda e: F.struct((e * F.col("n") + F.col("place")).alias("rank"), (e == F.col("epochs")).alias("last")))
    drawn = blocks.select("nr", "block", "cut", "whole", F.explode(draw).alias("d")).where("not d.last or whole or cut")
    quotas = sources.select("nr").join(drawn.groupBy("nr").agg(F.count("*").alias("quota")), "nr", "left").select("nr", F.coalesce("quota", _long(0)).alias("quota"))
    shards = split(quotas)
    upto = F.sum("quota").over(Window.partitionBy("nr").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    shards = shards.withColumn("upto", upto).where("quota > 0").select("nr", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("rank"))
    drawn = drawn.select("nr", "block", F.col("d.rank").alias("rank"), (F.col("d.last") & F.col("cut")).alias("in_part")).join(shards, ["nr", "rank"])
    drawn = durable(drawn)
    draws = durable(drawn.where("not in_part").groupBy("nr", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards")))

    near_cut = blocks.where(F.col("place").between(F.col("cut_at"), F.col("cut_at") + SPARE))
    left = F.max(F.when(F.col("cut"), F.col("left"))).over(Window.partitionBy("nr"))
    near_cut = durable(near_cut.select("nr", "block", "cut", left.alias("left")))
    some = rows.join(small_side(near_cut, near_cut.count()), ["nr", "block"]).groupBy("nr", "block", "cut", "left", "key").agg(F.sum("size").alias("size")).where("size > 0")
    w = Window.partitionBy("nr")
    some = some.withColumn("taken", F.lit(False)).withColumn("lack", F.col("left"))
    for fill in range(FILLS):
        fit = ~F.col("taken") & (F.col("size") <= F.col("lack")) & (F.col("cut") | F.lit(fill > 0))
        some = some.withColumn("end", F.sum(F.when(fit, F.col("size"))).over(w.orderBy(F.desc("cut"), "key").rowsBetween(Window.unboundedPreceding, 0)))
        some = some.withColumn("now", fit & (F.col("end") <= F.col("lack")))
        got = F.coalesce(F.max(F.when(F.col("now"), F.col("end"))).over(w), _long(0))
        some = some.withColumn("got", got).withColumn("taken", F.col("taken") | F.col("now")).withColumn("lack", F.col("lack") - F.col("got"))
    near = F.row_number().over(w.orderBy("taken", F.abs(F.col("size") - F.col("lack")), "key"))
    some = some.withColumn("near", near).where("taken or near = 1 and size < 2 * lack")
    taker = drawn.where("in_part").select("nr", F.col("shard").alias("part_shard"))
    return rows, draws, durable(some.join(taker, "nr").select("nr", "block", "key", "part_shard"))


def _with_shards(rows: DataFrame, draws: DataFrame, part: DataFrame) -> DataFrame:
    """rows (with nr, block and key) and the array of shards that take each."""
    drawn = rows.join(small_side(draws, draws.count()), ["nr", "block"], "left")
    drawn = drawn.join(small_side(part, part.count()), ["nr", "block", "key"], "left")
    none = F.array().cast("array<int>")
    extra = F.when(F.col("part_shard").isNotNull(), F.array("part_shard")).otherwise(none)
    return drawn.withColumn("shards", F.concat(F.coalesce("shards", none), extra)).drop("part_shard")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as often as the mix takes them, with shard and place: write it by shard, sorted by place."""
    rows, draws, part = plan(docs, id_col, text_col, source_col)
    names = [c for c in docs.columns if c not in ("shard", "place")]
    packed = docs.select(F.struct(*names).alias("doc"), F.col(source_col).alias("source"), _key(id_col, text_col).alias("key"))
    sources = durable(rows.groupBy("nr").agg(F.first("source").alias("name"), F.count("*").alias("n_rows")))
    packed = packed.join(small_side(sources, sources.count()), F.col("source").eqNullSafe(F.col("name")))
    packed = packed.select("doc", "key", "nr", _block(F.col("n_rows"), "key").alias("block"))
    taken = _with_shards(packed, draws, part).select("doc", "key", F.posexplode("shards").alias("copy", "shard"))
    return taken.select("doc.*", "shard", F.xxhash64(F.lit(SEED), "shard", "copy", "key").alias("place"))


def op5_hypergeometric_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_shards(*plan(read_table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"))
