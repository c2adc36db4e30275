import math
import random

import numpy as np
import pytest

from notewell.llm import language_id as L
from notewell.llm.tokens import default_vocabulary


def test_forward_sums_all_segmentations_and_backward_agrees():
    pieces = L.Pieces(default_vocabulary())
    rng = np.random.default_rng(0)
    p = rng.random((pieces.n, 2)) / pieces.n
    lifted = p * pieces.lift[:, None]
    words = [b"the", b"nation", b"xq7", "été".encode(), b"a"]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    import base64

    raw = sorted({base64.b64decode(x.split()[0]).lower() for x in open(default_vocabulary(), "rb")} - {b""})
    number = {w: i for i, w in enumerate(raw)}

    def total(w, k, memo):
        if not w:
            return 1.0
        if w not in memo:
            memo[w] = sum(p[number[w[:n]], k] * total(w[n:], k, memo) for n in range(1, len(w) + 1) if w[:n] in number)
        return memo[w]

    lattice = L.Lattice(pieces, data, starts, lengths)
    got = lattice.scores(lifted)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(math.log(total(b" " + w, k, {})), rel=1e-6)
    uses = lattice.expect(lifted, np.ones((len(words), 2)))
    assert (uses * pieces.lengths[:, None]).sum(0) == pytest.approx(lengths.sum() + len(words))


def _docs(spark, n=120):
    rng = random.Random(3)
    voc = {"en": ["the", "of", "nation", "thing", "with"], "fr": ["le", "élève", "que", "mention", "eaux"], "de": ["der", "über", "schaft", "keit", "und"]}
    rows = [(i, " ".join(rng.choice(voc[k]) for _ in range(rng.randint(1, 30))), k, "x") for i in range(n) for k in [rng.choice(list(voc))]]
    rows += [(n, None, "en", ""), (n + 1, "123 ... 99", "fr", ""), (n + 2, "", None, ""), (n + 3, "der über " + "x" * 500, None, ""), (n + 4, "le " * 20000, "fr", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), n


def test_predictions(spark):
    docs, n = _docs(spark)
    out = {r.doc_id: r for r in L.predict(docs, L.fit(docs.where("doc_id % 2 = 0"))).collect()}
    assert all(out[i].lang_pred == out[i].lang for i in range(n)) and all(0 <= r.score <= 1 for r in out.values())
    assert [out[n + k].lang_pred for k in range(5)] == ["und", "und", "und", "de", "fr"] and out[n].score == 0


def test_no_labels_and_no_rows(spark):
    docs, _ = _docs(spark, 4)
    model = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, model).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0


def test_long_words_agree_with_the_lattice_and_across_blocks(monkeypatch):
    pieces = L.Pieces(default_vocabulary())
    assert pieces.lengths.max() == 128
    rng = np.random.default_rng(1)
    p = rng.random((pieces.n, 2)) / pieces.n
    lattice = lambda w: L.Lattice(pieces, np.frombuffer(w, np.uint8), np.zeros(1, np.int64), np.array([len(w)]))
    spaced = lambda w: L._with_space(np.frombuffer(w, np.uint8), 0, len(w))
    for w in (b"x", b"internationalisation", "b\u00e9b\u00e9".encode() * 9, b"-" * 60):
        assert L.long_score(pieces, spaced(w), np.log(p)) == pytest.approx(lattice(w).scores(p * pieces.lift[:, None])[0], rel=1e-9)
        want = lattice(w).expect(p * pieces.lift[:, None], np.array([[2.0, 3.0]]))
        assert L.long_expect(pieces, spaced(w), np.log(p), np.array([2.0, 3.0])) == pytest.approx(want, abs=1e-9)
    long = b"https://example.org/" + b"path-" * 300 + b"=" * 400
    whole = L.long_score(pieces, spaced(long), np.log(p))
    monkeypatch.setattr(L, "BLOCK", 37)
    assert L.long_score(pieces, spaced(long), np.log(p)) == pytest.approx(whole, rel=1e-12)
    used = L.long_expect(pieces, spaced(long), np.log(p), np.ones(2))
    assert (used * pieces.lengths[:, None]).sum(0) == pytest.approx(len(long) + 1)


def test_clashing_columns_and_repeated_rows(spark):
    docs, _ = _docs(spark, 20)
    wide = docs.withColumn("_letter", docs.lang).withColumn("letter", docs.lang)
    out = L.predict(wide.unionByName(wide), L.fit(wide)).collect()
    once = {r.doc_id: (r.lang_pred, r._letter, r.letter) for r in out}
    assert len(out) == 2 * docs.count() and all((r.lang_pred, r._letter, r.letter) == once[r.doc_id] for r in out)
    assert all(a == b for _, a, b in once.values())
