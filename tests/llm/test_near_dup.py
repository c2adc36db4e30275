import random
import re

import numpy as np
import pytest

from notewell.llm import near_dup
from notewell.llm.graphs import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain(rows, k, hundredths):
    sets = [shingles(t, k) for _, t in rows]
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= hundredths * (len(sets[i]) + len(sets[j]) - both):
                home[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)}


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(60)]
    rows = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(c) // 14))):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append("\n".join(c).upper() if rng.random() < 0.3 else " ".join(c))
    hot = [rng.choice(words) for _ in range(80)]
    for _ in range(60):
        c = list(hot)
        for _ in range(rng.randint(0, 5)):
            c[rng.randrange(len(c))] = rng.choice(words)
        rows.append(" ".join(c))
    rows += ["same text here now please"] * 9 + ["a", "A", "a b", "", None, " \n", "x y z", "word " * 4000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,blocks", [(4, None), (5, (8, 400))])
def test_equals_all_pairs(spark, monkeypatch, k, blocks):
    if blocks:
        monkeypatch.setattr(near_dup, "BLOCK_ROWS", blocks[0])
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", blocks[1])
    rows = corpus()
    df = spark.createDataFrame([(i, t, "node") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    out = near_dup.link(df, k, 0.8).collect()
    want = plain(rows, k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_null_ids_repeats_and_no_rows(spark):
    kind = "doc_id long, text string"
    rows = [(None, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"), (3, "ONE two three four five six"), (None, "alone " * 9), (7, "something else entirely here")]
    out = sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in near_dup.link(spark.createDataFrame(rows, kind), 4).collect())
    assert out == sorted([("None", "3", 3), ("7", "3", 3), ("7", "3", 3), ("3", "3", 3), ("None", "None", 1), ("7", "7", 1)])
    assert near_dup.link(spark.createDataFrame([], kind)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)) for _ in range(2))
    b[:1500] = a[:1500]
    b = np.unique(b)
    r = near_dup.registers([a, b, np.unique(np.concatenate([a, b]))])
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = near_dup.estimate((r[0] > r[1]).sum()[None], (r[0] < r[1]).sum()[None], np.array([float(len(a))]), np.array([float(len(b))]))
    assert abs(got[0] - true) < 0.17


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(1, 61)} == {1} and {out[i] for i in range(100, 140)} == {100} and len(out) == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_between_rows_far_from_the_centre(spark):
    """Groups of texts that slide along, so that buckets hold rows which no centre links."""
    rng = random.Random(3)
    rows = []
    for g in range(12):
        w = [f"g{g}x{rng.randrange(10**6)}" for _ in range(160)]
        rows += [" ".join(w[i : i + 60]) for i in range(0, 90, rng.choice([2, 3, 4]))]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    out = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 0.8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain(rows, 4, 80)


def test_second_round_of_components(spark, monkeypatch):
    """Links that only the blocks find are put on top of the first components."""
    links = near_dup._confirm
    monkeypatch.setattr(near_dup, "_confirm", lambda pairs, sets, threshold: links(pairs, sets, threshold).where("a % 3 = 0"))
    rows = corpus()
    out = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain(rows, 4, 80)
