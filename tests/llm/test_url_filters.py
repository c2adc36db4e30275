import duckdb
import pandas as pd

from notewell.llm import url_filters as U

CASES = {
    "https://A.example.ORG/en/123?x=1": ("a.example.org", "/en/123", "example.org/en/1", "block"),
    "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
    "http://org/": ("org", "/", "org/", "allow"),
    "http://x.com/fr/1#top": ("x.com", "/fr/1", "com/fr/", "allow"),
    "http://xcom/fr/1": ("xcom", "/fr/1", None, None),
    "http://x.org?q=/": ("x.org", "", None, None),
    "no scheme": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    None: ("", "", None, None),
    "": ("", "", None, None),
}


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(CASES)], "page_id long, url string, host string")
    out = {r.page_id: r for r in U.filter_urls(df).collect()}
    assert len(out) == len(CASES)
    for i, (host, path, rule, verdict) in enumerate(CASES.values()):
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (["allow", "block"] if verdict is None else [verdict])
    assert U.filter_urls(df.limit(0)).count() == 0


def test_templates_learn_from_labelled_urls(spark):
    urls = [f"http://h{i % 3}.com/{'de' if i % 2 else 'fr'}/{i}.html" for i in range(120)] + [f"http://other.net/de/{i}.html" for i in range(30)] + [f"http://other.net/fr/{i}.html" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls + urls[:1])), "page_id long, url string")
    out = U.filter_urls(df).collect()
    assert len(out) == len(urls) + 1 and {r.template for r in out} == {"/de/{n}.html", "/fr/{n}.html"}
    assert {r.verdict for r in out if r.host == "other.net" and r.path.startswith("/de")} == {"block"}
    assert {r.verdict for r in out if r.host == "other.net" and r.path.startswith("/fr")} == {"allow"}


def test_segments_without_support_become_wildcards(spark):
    urls = [f"http://a.net/post/{w}" for w in ["title-" + chr(97 + i) + chr(97 + j) for i in range(8) for j in range(8)]] + ["http://a.net/a/b/c/d/e"] * 40
    out = U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.template for r in out} == {"/post/{*}", "/a/b/c/d/e"}


def test_large_sections_and_deep_branches_have_their_own_share(spark):
    """40 sections of 2.5 % each: none is rare by its count; the labels of one differ, and those of one branch five segments deep."""
    rules = [("block", "a.net/s7/"), ("allow", "a.net/s"), ("block", "a.net/x/x/x/x/bad/"), ("allow", "a.net/x/x/x/x/good/")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    sections = ["s" + "".join(letters[int(c)] for c in str(k)) for k in range(40)]
    rules[0] = ("block", f"a.net/{sections[7]}/")
    urls = [f"http://a.net/{s}/{letters[i]}" for s in sections for i in range(25)]
    urls += [f"http://a.net/x/x/x/x/{kind}/{c}" for kind in ("bad", "good") for c in letters]
    urls += [f"http://b.net/{s}/other" for s in sections] + ["http://a.net/x/x/x/x/bad", "http://a.net/x/x/x/x/good"]
    out = {r.path + r.host: r for r in U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    blocked = {s for s in sections if out[f"/{s}/otherb.net"].verdict == "block"}
    assert blocked == {sections[7]}  # the raw first segment carries over to other hosts
    assert out["/x/x/x/x/bada.net"].verdict == "block" and out["/x/x/x/x/gooda.net"].verdict == "allow"
    assert out[f"/{sections[7]}/aa.net"].template == f"/{sections[7]}/{{*}}"
    assert out["/x/x/x/x/good/aa.net"].template == "/x/x/x/x/good/{*}"


def test_equals_sql_on_mixed_urls(spark):
    hosts, words = ["a.com", "b.com", "c.net", "example.org", ""], ["de", "fr", "es", "en", "x", "y"]
    urls = [f"http://{hosts[i * i % 5]}/" + "/".join(words[(i * k + i // 7) % 6] + ("" if (i + k) % 4 else chr(97 + i % 23) + chr(97 + i // 23 % 26)) for k in range(1, 2 + i % 7)) for i in range(900)]
    rows = list(enumerate([*urls, *urls[:50], None, "", "no scheme", "http://a.com", "http://a.com/", "http://a.com//de///1/", "http://z.net/" + "q/" * 300]))
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).drop("share")
    pages = pd.DataFrame(rows, columns=["page_id", "url"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(U.oracle()).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict", "template").collect()))) == sorted(map(repr, want))
