"""URL filtering by a tree of path templates, in DataFrame operations only.

Each url's path is a way down a tree below its host, of any depth. Runs of digits become ``{n}``. At each node the segments with little support
become ``{*}``: fewer than SUPPORT urls, and fewer than one in RARE of the node's. A node is gone down as long as the ways through it differ
further on. Urls that a rule decides are the labelled ones. A url's share of blocks starts as that of all labelled urls and is made finer by its
first segment on any host, by its host, then node by node. Siblings are merged with the node above if their labels can't be told apart from the
node's, and those above it, like those below it, with each other; one that stands apart from those it is merged with has a share of its own.
Shares are smoothed towards the one before. Merging concerns shares; the templates of merged branches stay apart. Urls without a rule are blocked
if their share is at least BLOCK_FROM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, skew_lookup

#: A segment is a branch of its own with so many urls, or with one in so many of its node's.
SUPPORT, RARE = 20, 20
#: Square of the normal deviate at which a branch stands apart (two-sided 5 %), weight of the share above it, share from which to block.
APART, WEIGHT, BLOCK_FROM = 3.84, 4.0, 0.5

#: The rules of the query, as (action, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (the first in text order of equally long ones) and its action; null where none fits."""
    which, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # later ones win
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        which, action = F.when(fits, rule).otherwise(which), F.when(fits, act).otherwise(action)
    return which, action


def _finer(share: Column, n: Column, bad: Column) -> Column:
    """A branch's share: its own, smoothed, if it stands apart from the one above, else that one."""
    apart = (n > 0) & ((bad - n * share) * (bad - n * share) >= F.lit(APART) * n * share * (F.lit(1.0) - share))
    return F.when(apart, (bad + F.lit(WEIGHT) * share) / (n + F.lit(WEIGHT))).otherwise(share)


def _down(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step down the tree: the ways that are done, with way, template and share, and those to go on with.

    ways: way, node, rest (what follows the node), template, share, n, seen, bad. All lookups of hot nodes are dealt by salt.
    """
    seg = F.substring_index("rest", "/", 1)
    ways = ways.withColumn("seg", seg).withColumn("rest", F.expr("substr(rest, length(seg) + 2)"))
    after = F.xxhash64("rest")
    kids = cut(ways.groupBy("node", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "seen", "bad")], F.count("*").alias("_n"), F.min(after).alias("lo"), F.max(after).alias("hi")))
    nodes = kids.groupBy("node").agg(F.sum("n").alias("all"), F.sum("seen").alias("s"), F.sum("bad").alias("b"), F.count("*").alias("_n"))
    branch_of = F.when((F.col("seg") == "") | (F.col("n") >= SUPPORT) | (F.col("n") * RARE >= F.col("all")), F.col("seg")).otherwise("{*}")
    named = cut(skew_lookup(kids.withColumnRenamed("_n", "ways"), nodes.drop("_n"), ["node"], nodes.select("node", "_n")).withColumn("g", branch_of))
    branches = named.groupBy("node", "g").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), F.first("s").alias("s"), F.first("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("_n"))
    rate = F.col("b") / F.greatest("s", F.lit(1)).cast("double")
    off = F.col("bad") - F.col("seen") * rate
    apart = (rate > 0) & (rate < 1) & (off * off >= F.lit(APART) * F.col("seen") * rate * (F.lit(1.0) - rate)) & (F.col("seen") > 0)
    branches = cut(branches.withColumn("side", F.when(apart, F.signum(off).cast("int")).otherwise(0)))
    sums = [F.sum(F.when(F.col("side") == k, F.col(c)).otherwise(0)).alias(f"{c}{name}") for k, name in ((1, "up"), (-1, "down")) for c in ("seen", "bad")]
    pools = branches.groupBy("node").agg(*sums, F.count("*").alias("_n"))
    pooled = skew_lookup(branches.withColumnRenamed("_n", "kids"), pools.drop("_n"), ["node"], pools.select("node", "_n"))
    pick = lambda c: F.when(F.col("side") > 0, F.col(f"{c}up")).otherwise(F.col(f"{c}down")).cast("double")
    pooled = pooled.select("node", "g", "side", F.col("seen").cast("double").alias("own_seen"), F.col("bad").cast("double").alias("own_bad"), pick("seen").alias("pool_seen"), pick("bad").alias("pool_bad"), (F.col("lo") == F.col("hi")).alias("single"))
    known = skew_lookup(named.select("node", "g", "seg"), pooled, ["node", "g"], branches.select("node", "g", "_n"))
    t = skew_lookup(ways, known, ["node", "seg"], kids.select("node", "seg", "_n"))
    finer = _finer(_finer(F.col("share"), F.col("pool_seen"), F.col("pool_bad")), F.col("own_seen"), F.col("own_bad"))
    t = t.withColumn("share", F.when(F.col("side") == 0, F.col("share")).otherwise(finer)).withColumn("node", F.concat_ws("/", "node", "g"))
    t = cut(t.withColumn("template", F.when(F.col("g") == "", F.col("template")).otherwise(F.concat_ws("/", "template", "g"))))
    return _finished(t.where("single")), t.where("not single").select("way", "node", "rest", "template", "share", "n", "seen", "bad")


def _finished(ways: DataFrame) -> DataFrame:
    whole = F.concat("template", F.when(F.col("rest") == "", "").otherwise(F.concat(F.lit("/"), F.col("rest"))))
    return ways.select("way", F.when(whole == "", "/").otherwise(whole).alias("template"), "share")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, ident: str = "page_id", url: str = "url") -> DataFrame:
    """ident, host, path, rule, verdict, template, share (that of blocks in the merged branch) for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and is judged by the branch of the empty host like others; so are urls of no
    path. Very long paths are read whole. Repeated urls count each. Without any labelled url the share is one half of nothing known and everything
    without a rule is blocked only if BLOCK_FROM allows it. Other columns are ignored; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url))
    read = pages.select(F.col(ident), host.alias("host"), path.alias("path"))
    which, action = rule_of(F.col("host"), F.col("path"), rules)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "[0-9]+", "{n}"), "/+", "/"), "^/|/$", "")
    read = read.withColumn("rule", which).withColumn("action", action).withColumn("way", F.concat_ws("/", "host", rest))
    ways = cut(read.groupBy("way", "host", rest.alias("rest")).agg(F.count("*").alias("n"), F.count("action").alias("seen"), F.count_if(F.col("action") == "block").alias("bad")))
    total = ways.agg(F.sum("seen").alias("n"), F.sum("bad").alias("b")).first()
    t = ways.withColumn("share", F.lit(((total["b"] or 0) + 1.0) / ((total["n"] or 0) + 2.0))).withColumn("first", F.substring_index("rest", "/", 1)).withColumn("node", F.col("host"))
    for key in ("first", "node"):
        part = F.xxhash64("rest")
        level = cut(t.groupBy(key).agg(F.sum("seen").cast("double").alias("all_seen"), F.sum("bad").cast("double").alias("all_bad"), F.count("*").alias("_n"), (F.min(part) == F.max(part)).alias("single")))
        t = skew_lookup(t.drop("all_seen", "all_bad", "single"), level.drop("_n"), [key], level.select(key, "_n"))
        t = t.withColumn("share", _finer(F.col("share"), F.col("all_seen"), F.col("all_bad")))
    t = cut(t.withColumn("template", F.lit("")))
    judged, t = _finished(t.where("single")), t.where("not single").select("way", "node", "rest", "template", "share", "n", "seen", "bad")
    while not t.isEmpty():  # as deep as ways differ
        done, t = _down(t)
        judged = judged.unionByName(done)
    out = skew_lookup(read.select(ident, "host", "path", "rule", "action", "way"), judged, ["way"], ways.select("way", F.col("n").alias("_n")))
    verdict = F.coalesce("action", F.when(F.col("share") >= BLOCK_FROM, "block").otherwise("allow"))
    return out.select(ident, "host", "path", "rule", verdict.alias("verdict"), "template", "share")


def oracle(rules: list[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL for the rows of filter_urls over ``pages``, without the share."""

    def fits(rule: str) -> str:
        name, slash, rest = rule.partition("/")
        return f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{rest}')"

    by_length = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1]), r[1]))
    which = "case " + " ".join(f"when {fits(r)} then '{r}'" for _, r in by_length) + " end"
    action = "case " + " ".join(f"when {fits(r)} then '{a}'" for a, r in by_length) + " end"

    def finer(share: str, n: str, bad: str) -> str:
        return f"case when {n} > 0 and ({bad} - {n} * {share}) * ({bad} - {n} * {share}) >= {APART}::double * {n} * {share} * (1.0::double - {share}) then ({bad} + {WEIGHT}::double * {share}) / ({n} + {WEIGHT}::double) else {share} end"

    # one round of the recursion is one step down: segments, branches, sides, pools, shares
    return f"""with recursive r as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
s as (select *, {which} as rule, {action} as act, regexp_replace(regexp_replace(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') as rest from h),
w as (select host, rest, count(*)::double as n, count(act)::double as seen, count(*) filter (where act = 'block')::double as bad from s group by 1, 2),
w1 as (select *, (select (sum(bad) + 1.0::double) / (sum(seen) + 2.0::double) from w) as share, sum(seen) over f as fs, sum(bad) over f as fb, sum(seen) over o as hs, sum(bad) over o as hb, min(rest) over o = max(rest) over o as single
 from w window f as (partition by split_part(rest, '/', 1)), o as (partition by host)),
w2 as (select * replace ({finer("share", "fs", "fb")} as share) from w1), w3 as (select * replace ({finer("share", "hs", "hb")} as share) from w2),
down as (select host, rest as whole, host as node, rest, '' as template, share, n, seen, bad, single from w3 union all
 select host, whole, node || '/' || g, rest, case when g = '' then template else template || '/' || g end, case when side = 0 then share else {finer("mid", "own_seen", "own_bad")} end, n, seen, bad, single from (
 select *, {finer("share", "pool_seen", "pool_bad")} as mid from (
 select *, sum(seen) over (partition by node, side) as pool_seen, sum(bad) over (partition by node, side) as pool_bad from (
 select *, case when node_bad > 0 and node_bad < node_seen and own_seen > 0 and off * off >= {APART}::double * own_seen * (node_bad / node_seen) * (1.0::double - node_bad / node_seen) then sign(off)::int else 0 end as side from (
 select *, own_bad - own_seen * (node_bad / greatest(node_seen, 1)) as off from (
 select *, sum(seen) over b as own_seen, sum(bad) over b as own_bad, sum(seen) over (partition by node) as node_seen, sum(bad) over (partition by node) as node_bad, min(rest) over b = max(rest) over b as single from (
 select * exclude (rest), substr(rest, length(seg) + 2) as rest, case when seg = '' or kid >= {SUPPORT} or kid * {RARE} >= sum(n) over (partition by node) then seg else '{{*}}' end as g from (
 select * exclude (single), split_part(rest, '/', 1) as seg, sum(n) over (partition by node, split_part(rest, '/', 1)) as kid from down where not single))
 window b as (partition by node, g)))))))
select page_id, s.host, path, rule, coalesce(act, case when share >= {BLOCK_FROM}::double then 'block' else 'allow' end) as verdict,
 case when template = '' and d.rest = '' then '/' when d.rest = '' then template else template || '/' || d.rest end as template from s join down d on single and s.host = d.host and s.rest = d.whole"""
