import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    en, fr = ["the", "of", "thing", "nation", "with", "under", "water"], ["le", "élève", "que", "eaux", "mention", "sur", "dans"]
    say = lambda v, n: " ".join(rng.choice(v) + rng.choice("abcdefgh") for _ in range(n))
    item = say(en, 40)
    rows = [(i, say(en if i % 2 else fr, 80) + "\nAll rights reserved by us", "en" if i % 2 else "fr") for i in range(60)]
    base = say(en, 120)
    rows += [(100 + i, base if i < 3 else base.rsplit(" ", 1)[0] + f" x{i}", "en") for i in range(4)]
    line = say(en, 60)
    rows += [(110 + i, line.rsplit(" ", 1)[0] + f" y{i}", "en") for i in range(4)]
    rows += [(200, say(en, 50) + " " + item + " " + say(en, 30), "en"), (201, None, "en"), (202, "1234 ...", "fr"), (203, "", None), (5, rows[5][1], "en")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns, name
        seen.append({(r.doc_id): r.text for r in now.collect()})
    everything = {i for i, _, _ in rows}
    assert set(seen[0]) == everything - {201, 202, 203} and set(seen[1]) == set(seen[0]) - {111, 112, 113}
    assert sum("All rights" in t for t in seen[1].values()) == 1
    assert set(seen[2]) == set(seen[1]) - {101, 102, 103}
    assert set(seen[3]) == set(seen[2]) - {200} and now.count() == len(seen[3])
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == set(seen[3]) and out.length.sum() == out.groupby("doc_id").doc_tokens.first().sum()
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in out.itertuples())
