import random
from collections import defaultdict

from notewell.llm import line_dedup as D


def templates(line):
    """Plain version: the token tuples that the tree's hashes stand for."""
    words = [w for w in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    words = ["<*>" if any(c.isdigit() and c.isascii() or c == "@" for c in w) else w for w in words]
    n = len(words)
    if n <= D.SHORT_LINE:
        return []
    out = [(n, -1, tuple(words))]
    if n >= D.LONG_LINE:
        part = [-1 if i < D.LEADING else (i - D.LEADING) * D.FIELDS // (n - D.LEADING) for i in range(n)]
        out += [(n, j, tuple("<*>" if p == j else w for w, p in zip(words, part))) for j in range(D.FIELDS)]
    return out


def plain(rows, least):
    texts, first = defaultdict(set), {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            for x in templates(line):
                texts[x].add(t)
                if x not in first or d < first[x][0]:
                    first[x] = (d, t)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        drop = [i for i, line in enumerate(lines) if any(len(texts[x]) >= least and first[x][1] != t for x in templates(line))]
        out[d] = (drop, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in drop))
    return out


def test_equals_plain_version(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta rho sigma tau é".split()) + rng.choice(["", "x", "y", "z"])
    boiler = ["Copyright notice of this site", "User 17 logged in at 10:30 from host a1", "short line", "Please read the long terms of service before you go on to the rest"]
    rows = []
    for i in range(80):
        lines = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), boiler[0])
        if i % 4 == 0:
            lines.append(f"User {i} logged in at {i}:30 from host b{i}")
        if i % 5 == 0:
            lines.insert(0, f"Please read the long terms of service before {word()} {word()} go on to the rest")
        if i % 7 == 0:
            lines.append(boiler[2] + "\t")
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[5][1]) for i in range(6)] + [(300, None), (301, ""), (302, "\n"), (303, boiler[0] + "\n"), (304, "\n" + boiler[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    out = {r.doc_id: (r.dropped, r.text) for r in D.drop_recurring(df, 3).collect()}
    want = plain(rows, 3)
    assert out == want and sum(len(v[0]) for v in want.values()) > 30
    assert out[205] == ([], rows[5][1]) or rows[5][1] in {t for _, t in rows[:80]}


def test_copies_alone_make_nothing_recur(spark):
    df = spark.createDataFrame([(i, "one line of words here\nanother line of words") for i in range(9)], "doc_id long, text string")
    assert all(r.dropped == [] for r in D.drop_recurring(df).collect())
    assert D.drop_recurring(df.limit(0)).count() == 0


def test_equal_lines_recur_from_two_texts_short_ones_too(spark):
    rows = [(1, "three words here\nown first\nYes."), (2, "three\twords here\nown second\nYes.\nNo 1"), (3, "other words here\nNo 2\nown  second"), (4, "three words here\nown first\nYes.")]
    out = {r.doc_id: r.dropped for r in D.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), exact=2).collect()}
    assert out == {1: [], 2: [0, 2], 3: [2], 4: []}


def test_query_drops_lines_that_two_texts_hold(spark, tmp_path):
    from notewell.llm import queries

    spark.createDataFrame([(1, "a line of words\nx"), (2, "y\na line of words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_template_tree(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.dropped_lines for r in out} == {1: [], 2: [1]}


def test_rows_of_numbers_recur_only_if_equal(spark):
    rows = [(i, f"{i} {i * 3}.5 {2000 + i}\n7 8 9\nTotal {i} {i + 1} {i + 2}\nPage {i} of 10") for i in range(1, 9)]
    out = {r.doc_id: r.dropped for r in D.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), exact=2).collect()}
    assert out == {i: [] if i == 1 else [1, 3] for i in range(1, 9)}


def test_clashing_columns_are_kept(spark):
    from notewell.llm.line_dedup import drop_recurring

    df = spark.createDataFrame([(1, "same line here\na b c", 5, "x", "d"), (2, "same line here\nd e f", 6, "y", "k")], "doc_id long, text string, _hash long, _i string, d string")
    out = {r.doc_id: r for r in drop_recurring(df, exact=2).collect()}
    assert (out[2].text, out[2]._hash, out[2]._i, out[2].d) == ("d e f", 6, "y", "k") and out[1].text == "same line here\na b c"
