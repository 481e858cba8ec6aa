"""Operators on literal tables, and every suite query against its oracle."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur import suite
from larkspur.operators import aggregates, dml, joins, recursive, relational, statistics, windows
from larkspur.streaming import windows as stream_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(values):
    return tuple(None if v is None or v != v else round(v, 4) if isinstance(v, float) else v if isinstance(v, (int, str)) else str(v) for v in values)


@pytest.mark.parametrize("key", sorted(suite.QUERIES))
def test_suite(spark, oracle, key):
    df = suite.QUERIES[key](spark, SF)
    names = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    if key in suite.ORACLE:
        found = oracle.execute(suite.ORACLE[key])
        at = [[d[0] for d in found.description].index(c) for c in names]
        assert got == sorted((plain(r[i] for i in at) for r in found.fetchall()), key=repr)
    else:
        assert got


def test_joins_null_keys_and_padding(spark):
    a = spark.createDataFrame([(1, "A"), (2, "B"), (None, "N")], "id int, name string")
    b = spark.createDataFrame([(1, 10), (4, 40), (None, 0)], "uid int, score int")
    on = a.id == b.uid
    count = {how: joins.join(a, b, on, how).count() for how in ("inner", "left", "right", "full", "semi", "anti")}
    assert count == {"inner": 1, "left": 3, "right": 3, "full": 5, "semi": 1, "anti": 2}
    assert joins.natural(a, b).count() == 9
    with pytest.raises(ValueError):
        joins.join(a, b, None, "left")


def test_aggregates(spark):
    df = spark.createDataFrame([("A", 10), ("B", 20), ("A", None)], "k string, v int")
    got = aggregates.aggregate(df, ["k"], n=F.count("*"), m=F.count("v"), c=aggregates.group_concat("v")).collect()
    assert sorted(map(tuple, got)) == [("A", 2, 1, "10"), ("B", 1, 1, "20")]
    assert aggregates.aggregate(df.limit(0), s="sum(v)", n="count(*)").collect() == [(None, 0)]


def test_windows(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(5)], "i int, g int")
    assert [r.t for r in windows.window(df, "ntile", "t", 9, order=["i"]).orderBy("i").collect()] == [1, 2, 3, 4, 5]
    assert [r.r for r in windows.window(df, "rank", "r", order=["g"]).orderBy("i").collect()] == [1, 1, 3, 3, 5]
    with pytest.raises(ValueError):
        windows.window(df, "ntile", "t", 0, order=["i"])


def test_recursion_cycles_and_depth(spark):
    start = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(recursive.CycleError):
        recursive.recursive(start, lambda r: r)
    assert recursive.recursive(start, lambda r: r, distinct=True).count() == 1
    assert recursive.recursive(start, lambda r: r.selectExpr("n + 1 AS n"), depth=3).count() == 4


def test_relational(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "k int, v int")
    assert [r.k for r in relational.sort(df, "v").collect()] == [1, 3, 2] and [r.k for r in relational.sort(df, "v desc").collect()] == [2, 3, 1]
    assert relational.limit(df, 0).count() == 0 and relational.range_scan(df, "v", 4, include_low=False).count() == 1
    scan = relational.range_scan(relational.scan(spark, f"{SF}/orders.parquet", ["o_orderkey"]), "o_orderkey", 1, 5)
    plan = scan._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,1)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_statistics(spark):
    df = spark.createDataFrame([(i, float(i % 10) if i else None) for i in range(100)], "i int, v double")
    e = statistics.ColumnEstimate.of(df, "v")
    assert e.nulls == 1 and abs(e.equal() - 0.1) < 0.02 and abs(e.less(4.5) - 0.5) < 0.05 and e.is_null() == pytest.approx(0.01)
    assert statistics.both(0.5, 0.5) == 0.25 and statistics.either(0.5, 0.5) == 0.75 and statistics.sample_rate(10**9) == 50_000 / 10**9
    assert statistics.equi_width(df.where("v is null"), "v", 4).count() == 0


def test_upsert_twice_in_one_batch(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 3)], "k int, v string, n int")
    assert sorted(map(tuple, dml.upsert(old, new.drop("n"), ["k"], {"v": F.expr("concat(o.v, n.v)")}).collect()))[1] == (2, "z")
    assert sorted(map(tuple, dml.replace(old, new, [["k"]], "n").collect())) == [(1, "y"), (2, "z")]
    assert sorted(map(tuple, dml.insert_ignore(old, new, [["k"]], "n").collect())) == [(1, "a"), (2, "z")]


def test_stream_windows_match_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = stream_windows.windowed(events, "ts", "1 day", ["event_type"], n=F.count("*"))
    stream = stream_windows.windowed(stream_windows.read(spark, str(tmp_path / "in"), events.schema), "ts", "1 day", ["event_type"], n=F.count("*"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("windows_out").collect())) == sorted(map(str, batch.collect()))
    assert stream_windows.sessions(events, "ts", "30 minutes", ["user_id"], n=F.count("*")).count() > 0
