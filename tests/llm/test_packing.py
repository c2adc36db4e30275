import numpy as np
import pyarrow as pa

from notewell.llm import packing
from notewell.llm.packing import hilbert_index, pack
from notewell.llm.tokens import default_vocabulary, vocabulary


def test_curve_visits_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    key = hilbert_index(points, 3)
    assert sorted(key) == list(range(512))
    path = points[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pieces_restore_every_document(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 4096)
    texts = [None, "", "one", "word " * 3000, *[f"text {i} " * (i % 40) for i in range(200)], *["copy " * 50] * 60]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    out = pack(df, 64).toPandas()
    v = vocabulary(default_vocabulary())
    want = [ids[p[k] : p[k + 1]].tolist() + [0] for a, b, ids, p in v.encode(pa.array(texts)) for k in range(b - a)]
    for i, g in out.groupby("doc_id"):
        g = g.sort_values("start")
        assert (g.start.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and (g.doc_tokens == len(want[i])).all()
        assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == want[i]
    assert out.doc_id.nunique() == len(texts)
    fill = []
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() <= 64
        fill.append(g.length.sum())
    assert np.mean(fill) > 60


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
