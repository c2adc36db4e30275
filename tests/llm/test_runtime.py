import numpy as np
import pytest
from pyspark.sql import functions as F

from notewell.llm import near_dup, runtime


def test_hot_rows_are_dealt_over_tasks_whatever_their_columns(spark):
    rows = spark.range(20_000).select(F.struct(F.col("id").alias("i"), F.lit(4).alias("h")).alias("key"), F.lit(9).cast("long").alias("n"), F.lit(77).cast("long").alias("node"))
    right = spark.createDataFrame([(77, 5), (78, 6)], "node long, component_id long")
    out = runtime.skew_lookup(rows, right, ["node"], rows.groupBy("node").agg(F.count("*").alias("_n")), spread=1000)
    assert out.count() == 20_000 and {r.component_id for r in out.select("component_id").distinct().collect()} == {5}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:  # without a broadcast of the other side or adaptive changes the rows stay where they were dealt
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = runtime.skew_lookup(rows, right, ["node"], rows.groupBy("node").agg(F.count("*").alias("_n")), spread=1000)
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_no_hot_key_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    right = spark.createDataFrame([(1, 10)], "k long, y long")
    n = rows.groupBy("k").agg(F.count("*").alias("_n"))
    assert [tuple(r) for r in runtime.skew_lookup(rows, right, ["k"], n).collect()] == [(1, "a", 10)]
    assert {tuple(r) for r in runtime.skew_lookup(rows, right, ["k"], n, how="left").collect()} == {(1, "a", 10), (2, "b", None)}
    assert runtime.skew_lookup(rows.limit(0), right, ["k"], n.limit(0)).count() == 0


def test_key_filter_never_loses_a_key(spark):
    df = spark.range(30_000).select(F.xxhash64("id").alias("key"), "id")
    bits = runtime.key_filter(df.where("id % 3 = 0").select("key"))
    got = {r.id for r in runtime.maybe_in(df, "key", bits).collect()}
    assert set(range(0, 30_000, 3)) <= got and len(got) < 10_500
    assert runtime.maybe_in(df, "key", runtime.key_filter(df.limit(0).select("key"))).count() == 0
    assert len(bits) == runtime.FILTER_WORDS and bits.dtype == np.uint64


def test_tables_are_written_read_and_released(spark):
    df = runtime.cut(spark.range(5).withColumn("t", F.array(F.lit("x"))))
    assert df.count() == 5 and df.columns == ["id", "t"]
    runtime.release(df)
    with pytest.raises(Exception):
        df.count()


@pytest.mark.parametrize("members,outsiders", [(40, 1), (40, 7)])
def test_members_of_the_main_component_meet_outsiders_only(spark, monkeypatch, members, outsiders):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    sets = [np.arange(i, i + 50, dtype=np.uint64) for i in range(members + outsiders)]
    rows = [(i, bytearray(r.tobytes()), 50, 1) for i, r in enumerate(near_dup.registers(sets))]
    classes = spark.createDataFrame(rows, "node long, registers binary, n_shingles long, copies long")
    placed = spark.createDataFrame([(0, i, 0 if i < members else i) for i in range(members + outsiders)], "bucket long, node long, comp long")
    sizes = spark.createDataFrame([(0, 0, members + outsiders)], "bucket long, main long, _n long")
    made = []
    monkeypatch.setattr(near_dup, "_suspects", lambda t, threshold: np.ones(t.num_rows, bool))
    made = near_dup._rest(placed, sizes, classes, 0.8).toPandas()
    outer, inner = -(-outsiders // 4), members // 4
    assert len(made) == members * outer + outsiders * (outer + inner)
    meet = {(a, b) for _, g in made.groupby(["bucket", "i", "j"]) for a in g.node for b in g.node if a >= members and b != a}
    assert meet == {(a, b) for a in range(members, members + outsiders) for b in range(members + outsiders) if a != b}
