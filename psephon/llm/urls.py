"""URL filters: explicit rules, and for the rest a path-template tree judged by smoothed labelled purity.

**Rules** name a host (with all its subdomains) and the begin of a path; the longest that fits decides.

**Template tree.** Pages that a rule decides are the labelled ones. Per host, paths become templates: segments
with a digit become ``*``; then, level by level down to the deepest, the segments below one template prefix become
``*`` if they are many and what follows them is alike: ``varied`` of them at least, over half as many as there are
different rests of paths after them. Rows, repeated urls and other query strings do not count, nor do sub-pages that
segments have in common. (Segments with different rests of their own, like sections with articles, stay.) The
DuckDB counterpart compares with pages and ends at level ``DEPTH``: on tables whose variable segments have digits,
like the given ones, both are the same. Branches are then merged from the deepest level up: of the branches below
one prefix, those whose share of blocked pages is statistically like that of all of them together (too few labels, or
a chi-square below ``chi``) become one branch, the prefix's, which is judged among its own neighbours one level up; the
others stay branches of their own. A branch's purity, the share of blocked pages among its labelled ones, is smoothed
towards the same template's share over all hosts, and that towards the share of all labelled pages. Purity of a half or
more rejects the template.

Everything is an aggregate over (host, template): a host with a third of all pages is counted in parts before
anything is shuffled. Verdicts go back to pages by a join; the paths that hold one in ``HOT`` pages or more, so ``HOT``
paths at most, are dealt by page as well.

Defined results. A null url or one without ``://`` has an empty host and path; no rule fits it, and it is judged as
a host of its own. Null and repeated ids: each row is judged. An empty table gives an empty result; without any
labelled page, every share is a half, and the verdict is block. Other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephon.llm import exchange as x

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a path that the DuckDB counterpart generalises by their variety, and that it merges.
DEPTH, LEVELS = 4, 10
#: Paths that hold one in so many pages are dealt out; into how many parts.
HOT, SALT = 256, 64


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict (null without one)."""
    name = verdict = None
    for judged, of, begin in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(begin)
        name = (F if name is None else name).when(fits, of + begin)
        verdict = (F if verdict is None else verdict).when(fits, judged)
    return (name, verdict) if rules else (F.lit(None).cast("string"),) * 2


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", varied: int = 8, chi: float = 3.84, least: int = 5, weight: float = 2.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every page."""
    host, path = host_path(F.col(url_col))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    raw = F.regexp_replace(F.regexp_replace("path", r"/[^/]*[0-9][^/]*", "/*"), r"/+$", "")
    own = own.withColumn("rule", name).withColumn("ruled", verdict).withColumn("raw", raw)

    # One row for each host and raw template; raw templates then turn into templates level by level.
    counted = own.groupBy("host", "raw").agg(F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a"), F.count("*").alias("n"))
    # (Checkpoints: each of these small tables is used several times, and plans would double at every level.)
    x.shared_dir(pages.sparkSession)
    counted = counted.withColumn("segments", F.split("raw", "/")).withColumn("template", F.lit("")).checkpoint()
    level = 0
    # A level can vary only below a prefix with ``varied`` paths that go on; where none has, nothing deeper can.
    while not counted.filter(F.size("segments") > level + 1).groupBy("host", "template").agg(F.count("*").alias("paths")).filter(F.col("paths") >= varied).isEmpty():
        level += 1
        counted = counted.withColumn("segment", F.try_element_at("segments", F.lit(level + 1)))
        below = counted.filter("segment IS NOT NULL AND segment <> '*'").withColumn("rest", F.slice("segments", level + 2, 1_000_000))
        kinds = below.groupBy("host", "template", "segment").agg(F.lit(1).alias("one")).groupBy("host", "template").agg(F.count("*").alias("kinds"))
        rests = below.groupBy("host", "template", "rest").agg(F.lit(1).alias("one")).groupBy("host", "template").agg(F.count("*").alias("rests"))
        wild = kinds.filter(F.col("kinds") >= varied).join(rests, ["host", "template"]).filter(F.col("kinds") * 2 > F.col("rests")).select("host", "template", F.lit(True).alias("wild"))
        counted = counted.join(wild, ["host", "template"], "left")
        step = F.when(F.col("segment").isNull(), "").when(F.col("wild"), "/*").otherwise(F.concat(F.lit("/"), F.col("segment")))
        counted = counted.withColumn("template", F.concat("template", step)).drop("wild").checkpoint()
    deeper = F.slice("segments", level + 2, 1_000_000)
    counted = counted.withColumn("template", F.when(F.size(deeper) > 0, F.concat_ws("/", F.col("template"), F.array_join(deeper, "/"))).otherwise(F.col("template")))

    leaves = counted.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("a").alias("a")).withColumn("branch", F.col("template")).checkpoint()
    deepest = leaves.agg(F.max(depth_of("branch"))).first()[0] or 0
    for level in range(deepest, 0, -1):
        leaves = merged_level(leaves, level, chi, least).checkpoint()
    branches = leaves.groupBy("host", "branch").agg(F.sum("b").alias("branch_b"), F.sum("a").alias("branch_a"))
    shapes = leaves.groupBy("template").agg(F.sum("b").alias("shape_b"), F.sum("a").alias("shape_a"))
    total = leaves.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("total_b"), F.coalesce(F.sum("a"), F.lit(0)).alias("total_a"))
    leaves = leaves.join(branches, ["host", "branch"]).join(shapes, "template").crossJoin(F.broadcast(total))  # one row of totals
    prior = (F.col("total_b") + 1) / (F.col("total_b") + F.col("total_a") + 2).cast("double")
    shape = (F.col("shape_b") + prior * weight) / (F.col("shape_b") + F.col("shape_a") + F.lit(weight))
    purity = (F.col("branch_b") + shape * weight) / (F.col("branch_b") + F.col("branch_a") + F.lit(weight))
    verdicts = leaves.select("host", "template", F.when(purity >= 0.5, "block").otherwise("allow").alias("judged"))

    verdicts = counted.select("host", "raw", "template").join(verdicts, ["host", "template"])
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.filter(F.col("n") * HOT >= total).select(F.col("host").alias("h"), F.col("raw").alias("r"), F.lit(True).alias("hot"))
    on = (F.col("host") == F.col("h")) & (F.col("raw") == F.col("r"))
    salted = own.join(F.broadcast(hot), on, "left")  # HOT rows at most
    salted = salted.withColumn("s", F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int")).otherwise(0)).drop("h", "r", "hot")
    verdicts = verdicts.join(F.broadcast(hot), on, "left").select(F.col("host").alias("h"), F.col("raw").alias("r"), "template", "judged", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    on = reduce(Column.__and__, [F.col("host") == F.col("h"), F.col("raw") == F.col("r"), F.col("s") == F.col("salt")])
    return salted.join(verdicts, on).select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template")


def depth_of(column: str) -> Column:
    return F.size(F.split(column, "/")) - 1


def merged_level(leaves: DataFrame, level: int, chi: float, least: int) -> DataFrame:
    """Leaves with those branches of one level that are like their neighbours moved to the prefix above."""
    branches = leaves.groupBy("host", "branch").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    here = branches.filter(depth_of("branch") == level).withColumn("parent", F.regexp_replace("branch", "/[^/]*$", ""))
    parents = branches.filter(depth_of("branch") == level - 1).select("host", F.col("branch").alias("parent"), "b", "a")
    pool = here.select("host", "parent", "b", "a").unionByName(parents).groupBy("host", "parent").agg(F.sum("b").alias("all_b"), F.sum("a").alias("all_a"))
    m, labelled = F.col("a") + F.col("b"), (F.col("all_a") + F.col("all_b")).cast("double")
    expected = F.try_divide(m * F.col("all_b"), labelled)
    variance = F.try_divide(expected * F.col("all_a"), labelled)
    differs = (m >= least) & (variance > 0) & ((F.col("b") - expected) * (F.col("b") - expected) >= variance * chi)
    moved = here.join(pool, ["host", "parent"]).filter(~F.coalesce(differs, F.lit(False))).select("host", "branch", "parent")
    return leaves.join(moved, ["host", "branch"], "left").select("host", "template", "b", "a", F.coalesce("parent", "branch").alias("branch"))


#: The production rules (verdict, host, begin of the path): fixed values.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def oracle(varied: int = 8, chi: float = 3.84, least: int = 5, weight: float = 2.0) -> str:
    """The same judgement as DuckDB SQL over ``pages``."""
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in order]
    rule, ruled = ("CASE " + " ".join(f"WHEN {c} THEN '{out[i]}'" for c, *out in cases) + " END" for i in (0, 1))
    parts = [
        "rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"cut AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)",
        f"own AS (SELECT *, {rule} AS rule, {ruled} AS ruled, regexp_replace(regexp_replace(path, '/[^/]*[0-9][^/]*', '/*', 'g'), '/+$', '') AS raw FROM cut)",
        "l0 AS (SELECT host, raw, count(*) AS n, count(*) FILTER (ruled = 'block') AS b, count(*) FILTER (ruled = 'allow') AS a, string_split(raw, '/') AS segments, '' AS template FROM own GROUP BY host, raw)",
    ]
    for k in range(1, DEPTH + 1):
        parts += [
            f"g{k} AS (SELECT *, segments[{k + 1}] AS segment FROM l{k - 1})",
            f"w{k} AS (SELECT host, template FROM (SELECT host, template, segment, sum(n) AS n FROM g{k} WHERE segment IS NOT NULL AND segment <> '*' GROUP BY ALL) GROUP BY host, template HAVING count(*) >= {varied} AND count(*) * 2 > sum(n))",
            f"l{k} AS (SELECT g.host, g.raw, g.n, g.b, g.a, g.segments, g.template || CASE WHEN g.segment IS NULL THEN '' WHEN w.host IS NOT NULL THEN '/*' ELSE '/' || g.segment END AS template FROM g{k} g LEFT JOIN w{k} w ON g.host = w.host AND g.template = w.template)",
        ]
    parts += [
        f"ct AS (SELECT host, raw, b, a, CASE WHEN len(segments) > {DEPTH + 1} THEN template || '/' || array_to_string(segments[{DEPTH + 2}:], '/') ELSE template END AS template FROM l{DEPTH})",
        "lv AS (SELECT host, template, sum(b) AS b, sum(a) AS a FROM ct GROUP BY ALL)",
        f"c{LEVELS} AS (SELECT host, template, b, a, template AS branch FROM lv)",
    ]
    for d in range(LEVELS, 0, -1):
        parts += [
            f"k{d} AS (SELECT host, branch, sum(b) AS b, sum(a) AS a, len(string_split(branch, '/')) - 1 AS depth, regexp_replace(branch, '/[^/]*$', '') AS parent FROM c{d} GROUP BY host, branch)",
            f"p{d} AS (SELECT host, parent, sum(b) AS ab, sum(a) AS aa FROM (SELECT host, parent, b, a FROM k{d} WHERE depth = {d} UNION ALL SELECT host, branch AS parent, b, a FROM k{d} WHERE depth = {d - 1}) GROUP BY host, parent)",
            f"e{d} AS (SELECT k.host, k.branch, k.parent, k.a + k.b AS m, k.b, (k.a + k.b) * ab / nullif((aa + ab)::DOUBLE, 0) AS e, aa / nullif((aa + ab)::DOUBLE, 0) AS q FROM k{d} k JOIN p{d} p ON k.host = p.host AND k.parent = p.parent WHERE k.depth = {d})",
            f"m{d} AS (SELECT host, branch, parent FROM e{d} WHERE NOT coalesce(m >= {least} AND e * q > 0 AND (b - e) * (b - e) >= e * q * {chi}, false))",
            f"c{d - 1} AS (SELECT c.host, c.template, c.b, c.a, coalesce(m.parent, c.branch) AS branch FROM c{d} c LEFT JOIN m{d} m ON c.host = m.host AND c.branch = m.branch)",
        ]
    parts += [
        "sc AS (SELECT host, template, sum(b) OVER (PARTITION BY host, branch) AS bb, sum(a) OVER (PARTITION BY host, branch) AS ba, sum(b) OVER (PARTITION BY template) AS sb, sum(a) OVER (PARTITION BY template) AS sa, sum(b) OVER () AS tb, sum(a) OVER () AS ta FROM c0)",
        f"vd AS (SELECT host, template, CASE WHEN (bb + ((sb + (tb + 1) / (tb + ta + 2)::DOUBLE * {weight}) / (sb + sa + {weight}::DOUBLE)) * {weight}) / (bb + ba + {weight}::DOUBLE) >= 0.5 THEN 'block' ELSE 'allow' END AS judged FROM sc)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT o.page_id, o.host, o.path, o.rule, coalesce(o.ruled, v.judged) AS verdict, c.template FROM own o JOIN ct c ON o.host = c.host AND o.raw = c.raw JOIN vd v ON c.host = v.host AND c.template = v.template"
