import random
import zlib

from notewell.llm.sharding import shard_by_bytes

KIND = "doc_id long, text string, shard string"


def test_law_slots_groups(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 400))) for _ in range(1500)]
    texts += ["copy of a hot text " * 9] * 800 + ["small group " * 3] * 6 + [None, "", None]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, KIND).repartition(7)
    out = shard_by_bytes(df).toPandas()
    assert sorted(out.doc_id) == list(range(len(texts))) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    size = {i: len((t or "").encode()) + 1 for i, t, _ in rows}
    assert all(r.size_ == size[r.doc_id] and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out.rename(columns={"size": "size_"}).itertuples())
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() < 1.05 * load.mean() and load.min() > 0.95 * load.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    small = out[out.doc_id.isin([i for i, t, _ in rows if t and t.startswith("small")])]
    assert small.shard.nunique() == 1
    again = shard_by_bytes(df).toPandas()
    assert again.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist() == out.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist()


def test_empty_few_and_repeated(spark):
    assert shard_by_bytes(spark.createDataFrame([], KIND)).count() == 0
    out = shard_by_bytes(spark.createDataFrame([(1, "a", ""), (1, "a", ""), (None, None, None)], KIND)).toPandas()
    assert len(out) == 3 and set(out["size"]) == {2, 1}
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_overfull_ranges_are_numbered_in_parts_and_null_ids_are_dealt(spark):
    texts = ["t%d " % i * 30 for i in range(3000)] + ["middling " * 20] * 12 + ["long " * 4000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "heavy null " * 9, "x")] * 900
    out = shard_by_bytes(spark.createDataFrame(rows, KIND).repartition(5)).toPandas()
    assert len(out) == len(rows) and out[out.doc_id.between(3000, 3011)].shard.nunique() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() < 1.08 * load.mean()
