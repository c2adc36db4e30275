import random

import numpy as np

from notewell.llm import decontaminate as D


def test_common_words_against_the_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert D.common_words(a, b) == t[-1, -1]


def _corpus():
    rng = random.Random(6)
    words = [a + b + c for a in ("th", "en", "qu", "or") for b in ("a", "e", "io") for c in ("n", "st", "r", "ble", "ment")] + ["the", "of", "and"] * 6
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(18, 60)).capitalize() + ". " + say(7) + ".") for i in range(15)]
    docs = [(i, say(rng.randint(5, 400))) for i in range(150)]
    planted = {}
    for k in range(40):
        i, t = items[k % 15]
        w = t.split()
        if k % 4 == 1:
            for _ in range(len(w) // 8):
                w[rng.randrange(len(w))] = "changed"
        if k % 4 == 2:
            w = [x + rng.choice(["***", "%%%", ",", ""]) for x in w]
        docs.append((1000 + k, f"{say(rng.randint(0, 200))} {' '.join(w).upper() if k % 4 == 3 else ' '.join(w)} {say(rng.randint(0, 100))}"))
        planted[1000 + k] = i
    return items, docs, planted


def test_finds_planted_passages_and_leaves_the_rest(spark):
    items, docs, planted = _corpus()
    rows = [*docs, (2000, None), (2001, ""), (2002, "... ***"), (2003, "x")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cosine string").repartition(4)
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    assert found == set(planted.items())
    left = D.decontaminate(df, bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - set(planted) and left.columns == df.columns


def test_empty_sides(spark):
    items, docs, _ = _corpus()
    df, bench = spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0
    assert D.decontaminate(df, bench.limit(0)).count() == 5


def test_finds_an_item_that_a_third_of_the_rows_hold(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, held = say(30) + ". " + say(7) + ".", {}
    for i in range(0, 900, 3):
        w = item.split()
        if i % 4 == 0:
            for j in rng.sample(range(len(w)), len(w) // 4):
                w[j] = rng.choice(words)
        held[i] = f"{say(rng.randint(10, 50))} {' '.join(w)} {say(rng.randint(10, 50))}"
    df = spark.createDataFrame([(i, held.get(i) or say(rng.randint(20, 300))) for i in range(900)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(0, item), (1, say(40)), (2, "unheard words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()} == {(i, 0) for i in held}


def test_short_items_are_found_whole(spark):
    df = spark.createDataFrame([(i, f"some words {'unheard of' if i % 2 else 'of unheard'} among the others {i}") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "Unheard of!")], "item_id long, text string")
    assert {r.doc_id for r in D.leaks(df, bench).collect() if r.common_words == 2} == set(range(1, 20, 2))


def test_clashing_columns_are_kept(spark):
    from notewell.llm.decontaminate import decontaminate

    item = "the small boat crossed the wide river before the storm came and nobody saw it leave the harbour that night"
    df = spark.createDataFrame([(1, item, 5, "x"), (2, "quite another text about bread and butter", 6, "y"), (None, None, 7, "z")], "doc_id long, text string, _hash long, k string")
    out = decontaminate(df, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert sorted((r._hash, r.k) for r in out) == [(6, "y"), (7, "z")]


def test_a_benchmark_in_blocks_finds_the_same(spark, monkeypatch):
    items, docs, planted = _corpus()
    rows = [*docs, *docs[:3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, items[0], items[0]], "item_id long, text string")
    found = lambda: sorted((*r[:5], round(r.cosine, 4), r.answer_found) for r in D.leaks(df, bench).collect())
    at_once = found()
    assert sum(r[1] == 0 for r in at_once) == 3 * sum(i == 0 for d, i in planted.items() if d in dict(rows))
    monkeypatch.setattr(D, "ITEM_BYTES", 400)
    assert found() == at_once


def test_directions_against_an_exact_decomposition(spark):
    """The directions from the added-up Gram matrices are the right singular vectors of all passages' sketches, with singular values of one."""
    _, docs, _ = _corpus()
    idf, space = D.latent_space(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    rows = []
    for _, _, data, offsets in D.blocks(D.pa.array([t for _, t in docs], D.pa.large_string())):
        _, _, hashes, at = D.clean_words(data, offsets)
        first, owner = D.steps_of(at)
        rows.append(D.windows(D.sketches(hashes, first, idf), owner))
    z = np.concatenate(rows).astype(np.float64)
    _, value, right = np.linalg.svd(z, full_matrices=False)
    good = np.flatnonzero(value**2 > value[0] ** 2 * 1e-7)[D.SHARED :]
    assert space.shape[1] == len(good)
    for j, k in list(enumerate(good))[:40]:
        assert abs(abs(space[:, j] @ right[k]) * value[k] - 1) < 1e-2
    assert np.allclose((z @ space).T @ (z @ space), np.eye(len(good)), atol=1e-2)


def test_paraphrases_by_share_of_other_words(spark):
    """Items of which 10, 20, 30 or 35 % of the words are others are all found, and nothing else is."""
    items, docs, planted = _corpus()
    rng, rows, held = random.Random(4), list(docs), dict(planted)
    for k, (i, t) in enumerate(items):
        for m, share in enumerate((0.10, 0.20, 0.30, 0.35)):
            w = t.split()
            for j in rng.sample(range(len(w)), round(share * len(w))):
                w[j] = f"new{rng.randrange(99)}"
            held[5000 + 10 * k + m] = i
            rows.append((5000 + 10 * k + m, f"{docs[k][1]} {' '.join(w)} {docs[k + 20][1]}"))
    found = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == set(held.items())
