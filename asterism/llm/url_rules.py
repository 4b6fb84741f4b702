"""URL filters: host and path rules, and a path-template tree for what no rule fits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of each rule with its verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A branch stays apart with so many labelled pages and such a squared z against its siblings.
LEAST_LABELS = 5
LEAST_Z2 = 3.84
#: A place in a path is variable if it has so many different segments and fewer pages for each than that.
VARIETY, REPEATS = 8, 4
#: Labels that the purity one step further out counts as.
PRIOR = 4.0
#: Purity where nothing is known.
EVEN = 0.5
WILD = "*"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: tuple[tuple[str, str], ...] = RULES, host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """Rule and verdict of the longest rule whose host is the url's or one above it and whose path begins the url's; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((F.col(host_col) == name) | F.col(host_col).endswith("." + name)) & F.col(path_col).startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def site(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def segments(path: Column) -> Column:
    """The segments of a path; one with a digit is variable and becomes a wildcard, an empty path is one empty segment."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda s: F.when(s.rlike("[0-9]"), WILD).otherwise(s))


@dataclass(frozen=True)
class TemplateTree:
    """``leaves``: host, segments, template and purity of every path seen."""

    leaves: DataFrame


def _apart(b: Column, n: Column, all_b: Column, all_n: Column) -> Column:
    """Whether a branch's share of blocked labels differs from its siblings', by a test of two proportions."""
    rest_b, rest_n = all_b - b, all_n - n
    share = all_b / F.greatest(all_n, F.lit(1))
    gap = b / F.greatest(n, F.lit(1)) - rest_b / F.greatest(rest_n, F.lit(1))
    spread = share * (1 - share) * (n + rest_n) / F.greatest(n * rest_n, F.lit(1))
    return (n >= LEAST_LABELS) & (rest_n > 0) & (gap * gap > LEAST_Z2 * spread) & (spread > 0)


def _level(now: DataFrame, k: int) -> DataFrame:
    """One step down the tree for open rows (h, site, segs, b, n, c, t, pa): their node ``t``, its ``purity``, ``pa`` over all hosts, and whether it may split further."""
    total = lambda c, name: F.sum(c).alias(name)
    now = now.withColumn("g", F.get("segs", F.lit(k)))
    branches = materialise(now.groupBy("h", "site", "t", "g").agg(total("b", "b"), total("n", "n"), total("c", "c")))
    own = branches.groupBy("h", "t").agg(total("b", "pb"), total("n", "pn"), total("c", "pc"), F.count("*").alias("d"))
    over = branches.groupBy("t", "g").agg(total("b", "ab"), total("n", "an"))
    above = branches.groupBy("t").agg(total("b", "qb"), total("n", "qn"))
    seen = branches.join(own, ["h", "t"]).join(over, ["t", "g"]).join(above, "t")
    variable = (F.col("g") == WILD) | ((F.col("d") >= VARIETY) & (F.col("pc") < REPEATS * F.col("d")))
    apart = F.when(F.col("n") >= LEAST_LABELS, _apart(F.col("b"), F.col("n"), F.col("pb"), F.col("pn"))).otherwise(_apart(F.col("ab"), F.col("an"), F.col("qb"), F.col("qn")))
    named = materialise(seen.select("h", "site", "t", "g", F.concat("t", F.lit("/"), F.when(~variable & apart, F.col("g")).otherwise(WILD)).alias("t2"), "b", "n"))
    nodes = named.groupBy("h", "site", "t2").agg(total("b", "hb"), total("n", "hn"))
    by_site = nodes.groupBy("site", "t2").agg(total("hb", "sb"), total("hn", "sn"))
    by_all = nodes.groupBy("t2").agg(total("hb", "ab"), total("hn", "an"))
    found = now.join(named.select("h", "t", "g", "t2"), ["h", "t", "g"]).join(nodes.drop("site"), ["h", "t2"]).join(by_site, ["site", "t2"]).join(by_all, "t2")
    found = found.withColumn("pa", (F.col("ab") + PRIOR * F.col("pa")) / (F.col("an") + PRIOR))
    found = found.withColumn("ps", (F.col("sb") + PRIOR * F.col("pa")) / (F.col("sn") + PRIOR))
    few = F.col("hn") < LEAST_LABELS
    eb, en = F.when(few, F.col("ab")).otherwise(F.col("hb")), F.when(few, F.col("an")).otherwise(F.col("hn"))
    mixed = (en >= 2 * LEAST_LABELS) & (eb > 0) & (eb < en)
    purity = (F.col("hb") + PRIOR * F.col("ps")) / (F.col("hn") + PRIOR)
    done = materialise(found.select("h", "site", "segs", "b", "n", "c", F.col("t2").alias("t"), "pa", purity.alias("purity"), (mixed & (F.size("segs") > k + 1)).alias("open")))
    discard(branches)
    discard(named)
    return done


def grow_tree(pages: DataFrame, blocked: Column, host_col: str = "host", path_col: str = "path") -> TemplateTree:
    """A tree of path templates for each host, from pages and their labels (``blocked``: true, false, or null for none).

    Pages are first counted by host and segments; all else works on these
    counts, level by level for as long as a node's labels are mixed, however
    deep that is. A segment keeps its name if its labels differ from its
    siblings' by the test above: by the host's own labels if it has enough, else
    by those that all hosts have for this segment under the same template.
    All others, and variable segments (with digits, or of a place where they
    hardly ever repeat), merge into one wildcard branch. A node's purity is its
    share of blocked labels, smoothed towards that of the same template on the
    host's site, that towards the same template on all hosts, and that towards
    the template one segment shorter; without any label it is EVEN. So a host
    without labels of its own learns from hosts with the same templates.
    """
    counts = pages.groupBy(F.col(host_col).alias("h"), segments(F.col(path_col)).alias("segs")).agg(F.sum(F.when(blocked, 1).otherwise(0)).alias("b"), F.count(blocked).alias("n"), F.count("*").alias("c"))
    now, parts, k = counts.select("h", site(F.col("h")).alias("site"), "segs", "b", "n", "c", F.lit("").alias("t"), F.lit(EVEN).alias("pa")), [], 0
    now = materialise(now)
    while not now.isEmpty():
        found = _level(now, k)
        k += 1
        template = F.when(F.size("segs") > k, F.concat("t", F.lit("/**"))).otherwise(F.col("t"))
        parts.append(found.filter("not open").select("h", "segs", template.alias("template"), "purity"))
        now = found.filter("open").drop("purity", "open")
    leaves = reduce(DataFrame.union, parts) if parts else now.select("h", "segs", F.lit("").alias("template"), F.lit(EVEN).alias("purity"))
    return TemplateTree(leaves)


def judge_paths(pages: DataFrame, tree: TemplateTree, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``pages`` with ``template`` and ``purity`` of the tree; both null where it has not seen the host and segments. Older columns of these names are replaced."""
    own = [c for c in pages.columns if c not in ("template", "purity")]
    keyed = pages.select(*own, segments(F.col(path_col)).alias("_segs"))
    leaves = tree.leaves.select(F.col("h").alias("_h"), F.col("segs").alias("_s"), "template", "purity")
    return keyed.join(leaves, (F.col(host_col) == F.col("_h")) & (F.col("_segs") == F.col("_s")), "left").select(*own, "template", "purity")


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template``, ``purity`` and ``verdict`` (allow or block).

    The longest rule that fits decides; where none does, the template's purity,
    learnt from the pages that rules decide: over one half blocks, so a page
    that nothing speaks against is allowed. Null urls,
    and those without ``://``, have an empty host and path and are judged like
    any other; repeated rows stay; an empty table stays empty. Older columns of
    these names are replaced.
    """
    new = ("host", "path", "rule", "template", "purity", "verdict", "_says")
    kept = [c for c in pages.columns if c not in new]
    split = pages.select(*kept, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, says = longest_rule(rules)
    ruled = split.select("*", rule.alias("rule"), says.alias("_says"))
    tree = grow_tree(ruled, F.col("_says") == "block")
    judged = judge_paths(ruled, tree)
    verdict = F.coalesce("_says", F.when(F.col("purity") > EVEN, "block").otherwise("allow"))
    return judged.select(*kept, "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def op9_urls(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


#: Levels that the SQL spells out; the tables' paths are no deeper. The query itself has no such limit.
SQL_LEVELS = 6


def _sql_apart(b: str, n: str, all_b: str, all_n: str) -> str:
    gap = f"({b} / greatest({n}, 1) - ({all_b} - {b}) / greatest({all_n} - {n}, 1))"
    spread = f"({all_b} / greatest({all_n}, 1) * (1 - {all_b} / greatest({all_n}, 1)) * ({n} + ({all_n} - {n})) / greatest({n} * ({all_n} - {n}), 1))"
    return f"({n} >= {LEAST_LABELS} AND {all_n} - {n} > 0 AND {gap} * {gap} > {LEAST_Z2} * {spread} AND {spread} > 0)"


def _sql() -> str:
    fits = {text: f"((host = '{text.partition('/')[0]}' OR suffix(host, '.{text.partition('/')[0]}')) AND starts_with(path, '/{text.partition('/')[2]}'))" for text, _ in RULES}
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits[r[0]]} THEN '{r[k]}'" for r in ordered) + " END"
    sql = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {case(0)} AS rule, {case(1)} AS says, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS segs FROM hp),
r0 AS (SELECT host AS h, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS site, segs, CAST(count(*) FILTER (says = 'block') AS DOUBLE) AS b, CAST(count(says) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS c, '' AS t, {EVEN}::DOUBLE AS pa FROM ruled GROUP BY host, segs)"""
    own, over = _sql_apart("b", "n", "pb", "pn"), _sql_apart("ab", "an", "qb", "qn")
    for k in range(1, SQL_LEVELS + 1):
        sql += f""",
b{k} AS (SELECT h, site, t, segs[{k}] AS g, sum(b) AS b, sum(n) AS n, sum(c) AS c FROM r{k - 1} GROUP BY ALL),
s{k} AS (SELECT *, sum(b) OVER own AS pb, sum(n) OVER own AS pn, sum(c) OVER own AS pc, count(*) OVER own AS d, sum(b) OVER (PARTITION BY t, g) AS ab, sum(n) OVER (PARTITION BY t, g) AS an, sum(b) OVER (PARTITION BY t) AS qb, sum(n) OVER (PARTITION BY t) AS qn FROM b{k} WINDOW own AS (PARTITION BY h, t)),
e{k} AS (SELECT h, site, t, g, b, n, t || '/' || CASE WHEN g <> '*' AND NOT (d >= {VARIETY} AND pc < {REPEATS} * d) AND CASE WHEN n >= {LEAST_LABELS} THEN {own} ELSE {over} END THEN g ELSE '*' END AS t2 FROM s{k}),
n{k} AS (SELECT h, site, t2, any_value(t) AS t, sum(b) AS hb, sum(n) AS hn FROM e{k} GROUP BY h, site, t2),
w{k} AS (SELECT *, sum(hb) OVER (PARTITION BY site, t2) AS sb, sum(hn) OVER (PARTITION BY site, t2) AS sn, sum(hb) OVER (PARTITION BY t2) AS ab, sum(hn) OVER (PARTITION BY t2) AS an FROM n{k}),
f{k} AS (SELECT r.h, r.site, r.segs, r.b, r.n, r.c, e.t2 AS t, (ab + {PRIOR} * pa) / (an + {PRIOR}) AS pa, hb, hn, sb, sn, ab, an FROM r{k - 1} r JOIN e{k} e ON r.h = e.h AND r.t = e.t AND r.segs[{k}] = e.g JOIN w{k} w ON w.h = e.h AND w.t2 = e.t2),
l{k} AS (SELECT *, (hb + {PRIOR} * ((sb + {PRIOR} * pa) / (sn + {PRIOR}))) / (hn + {PRIOR}) AS purity, CASE WHEN hn < {LEAST_LABELS} THEN an >= {2 * LEAST_LABELS} AND ab > 0 AND ab < an ELSE hn >= {2 * LEAST_LABELS} AND hb > 0 AND hb < hn END AND len(segs) > {k} AS open FROM f{k}),
r{k} AS (SELECT h, site, segs, b, n, c, t, pa FROM l{k} WHERE open)"""
    leaves = " UNION ALL ".join(f"SELECT h, segs, CASE WHEN len(segs) > {k} THEN t || '/**' ELSE t END AS template, purity FROM l{k} WHERE NOT open" for k in range(1, SQL_LEVELS + 1))
    return sql + f"""
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity > {EVEN} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM ruled JOIN ({leaves}) leaves ON host = h AND ruled.segs = leaves.segs"""


OP9_SQL = _sql()
