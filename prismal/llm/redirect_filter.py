"""URL filtering with redirect equivalence, in DataFrame functions only.

Rules decide urls by host and path.  A url without a rule follows the pages it is
equivalent to: canonical links and redirects are edges between urls, connected
components over them are sets of aliases, and a block decision for one alias
holds for all, unless one of them is explicitly allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import pick, write_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules are part of the plan; so many fit it.
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, rest = text.partition("/")
        return cls(verdict, host, slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A url without scheme and fragment; null where there is no ``://``."""
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as struct(text, verdict), or null; of equal texts allow wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    best = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*\burl\s*=\s*([^"'\s>]+)"""


def _absolute(url: Column, target: Column) -> Column:
    """``target`` as seen from the page at ``url``."""
    base = F.regexp_extract(url, "^([^:]*://[^/?#]*)", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.regexp_extract(F.concat(path_of(url), F.when(path_of(url) == "", "/").otherwise("")), "^(.*/)", 1), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page and what its canonical link or refresh names, as nodes."""
    found = F.explode(F.array(F.regexp_extract("html", _CANONICAL, 1), F.regexp_extract("html", _REFRESH, 1)))
    hinted = F.col("html").rlike("(?i)canonical|http-equiv")
    return (
        pages.where(hinted)
        .select("url", found.alias("target"))
        .where("target != ''")
        .select(node_of(F.col("url")).alias("a"), node_of(_absolute(F.col("url"), F.col("target"))).alias("b"))
        .where("a is not null and b is not null and a != b")
    )


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, html).

    ``redirects`` may add edges as two columns of urls.  The verdict is that of the
    longest rule that fits; without one, ``block`` if the page's component holds a
    blocked url and no explicitly allowed one, else ``allow``.  A null url, or one
    without ``://``, has empty host and path and no aliases; null html adds no edge;
    repeated rows are judged each; an empty table gives no rows; other columns are
    not read.  Only urls that have an edge take part in the components, and the
    join back is on those urls alone.
    """
    pages = pick(pages, ["page_id", "url", "html"])
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rows = rows.withColumn("fits", rule_of(rules, F.col("host"), F.col("path")))
    edges = page_edges(pages)
    if redirects is not None:
        a, b = redirects.columns
        edges = edges.union(redirects.select(node_of(F.col(a)).alias("a"), node_of(F.col(b)).alias("b")).where("a is not null and b is not null and a != b"))
    edges = write_table(spark, edges.distinct(), "alias-edges")
    if edges.isEmpty():
        method = F.lit("allow")
    else:
        nodes = components(spark, edges)
        url = F.concat(F.lit("x://"), F.col("node"))
        said = nodes.withColumn("says", rule_of(rules, host_of(url), path_of(url))["verdict"])
        told = said.groupBy("component").agg(F.max(F.when(F.col("says") == "block", 1)).alias("blocked"), F.max(F.when(F.col("says") == "allow", 1)).alias("allowed"))
        bad = nodes.join(told.where("blocked = 1 and allowed is null").select("component"), "component").select("node", F.lit(True).alias("bad"))
        rows = rows.join(bad, "node", "left")
        method = F.when(F.col("bad"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fits.text").alias("rule"), F.coalesce(F.col("fits.verdict"), method).alias("verdict"))


def rules_sql(rules: list[Rule], host: str, path: str) -> tuple[str, str]:
    """SQL for the text and the verdict of the rule that fits."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow"))
    fits = [f"({host} = {quote(r.host)} OR ends_with({host}, {quote('.' + r.host)})) AND starts_with({path}, {quote(r.path)})" for r in order]
    case = lambda what: reduce(lambda s, x: s + f" WHEN {x[0]} THEN {quote(what(x[1]))}", zip(fits, order, strict=True), "CASE") + " END"
    return case(lambda r: r.text), case(lambda r: r.verdict)


def judge_sql(rules: list[Rule]) -> str:
    """DuckDB SQL for ``judge`` on the table ``pages``."""
    text, verdict = rules_sql(rules, "host", "path")
    _, node_verdict = rules_sql(rules, "nhost", "npath")
    host = lambda u: f"translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    path = lambda u: f"regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
    rest = lambda u: f"regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^#]*)', 1)"
    node = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN {host(u)} || CASE WHEN {rest(u)} = '' THEN '/' ELSE {rest(u)} END END"
    base = "regexp_extract(url, '^([^:]*://[^/?#]*)', 1)"
    return rf"""WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN {host("url")} ELSE '' END AS host,
  CASE WHEN strpos(url, '://') > 0 THEN {path("url")} ELSE '' END AS path, {node("url")} AS node FROM pages),
t AS (SELECT url, path, node, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM u
  UNION ALL SELECT url, path, node, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\bcontent\s*=\s*["''][^"''>]*\burl\s*=\s*([^"''\s>]+)', 1) FROM u),
f AS (SELECT node, CASE WHEN strpos(target, '://') > 0 THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN {base} || target
  ELSE {base} || regexp_extract(path || CASE WHEN path = '' THEN '/' ELSE '' END, '^(.*/)', 1) || target END AS target FROM t WHERE target <> ''),
e AS (SELECT DISTINCT node AS a, {node("target")} AS b FROM f WHERE node IS NOT NULL),
l AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
s AS (SELECT node, reach, regexp_extract(reach, '^([^/?#]*)', 1) AS nhost, regexp_extract(reach, '^[^/?#]*([^?#]*)', 1) AS npath FROM r),
v AS (SELECT node, {node_verdict} AS says FROM s),
c AS (SELECT node, bool_or(coalesce(says = 'block', false)) AND NOT bool_or(coalesce(says = 'allow', false)) AS bad FROM v GROUP BY node)
SELECT page_id, host, path, {text} AS rule, coalesce({verdict}, CASE WHEN coalesce(bad, false) THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN c ON u.node = c.node"""
