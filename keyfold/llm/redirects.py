"""URL verdicts from host and path rules, carried to aliases along redirects and canonical links.

All of it is DataFrame and SQL functions. Pages are judged by the longest rule that fits their own
URL; a page that no rule fits takes the verdict of the component it belongs to, in which pages are
joined by redirects (meta refresh, or a table of them) and canonical links. An explicit allow in a
component takes precedence over its blocks; without either, a page is allowed.

Cases: a null URL or one without ``://`` has empty host and path, fits no rule, has no aliases and
is allowed; null HTML has no links; repeated rows give repeated results; columns other than those
named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.components import connected_components
from keyfold.session import write_stage

# Up to this many rules become one expression each; a longer list would outgrow generated code, and
# becomes a table that is joined.
EXPRESSION_RULES = 8


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits; null if none does."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                   F.lit(i)) for i, r in sorted(enumerate(rules), key=lambda p: (-len(p[1].text), p[1].text))]
    told = F.array(*[F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in rules])
    return F.get(told, F.coalesce(*fits, F.lit(None).cast("int")))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """``(rule_host, rule_path, verdict)``; of rules with one host and path the first counts."""
    first = {(r.host, r.path): r.verdict for r in reversed(rules)}
    return spark.createDataFrame([(*k, v) for k, v in first.items()], "rule_host string, rule_path string, verdict string")


def join_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``_own``, text and verdict of the longest rule that fits ``host`` and ``path``.

    Each distinct host and path meets the rules' path lengths under each of its host's endings, and
    then the rule of that ending and that beginning of the path, so both joins are on equality.
    Rules of one text (``a/`` + ``b`` and ``a`` + ``/b`` cannot differ, as hosts hold no slash) agree.
    """
    urls = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("_lengths"))
    under = urls.select("host", "path", F.explode(names).alias("rule_host")).join(lengths, "rule_host")
    tried = under.select("host", "path", "rule_host", F.explode("_lengths").alias("_length")).filter(
        F.col("_length") <= F.length("path"))
    found = tried.withColumn("rule_path", F.substr("path", F.lit(1), F.col("_length"))).join(rules, ["rule_host", "rule_path"])
    text = F.concat("rule_host", "rule_path")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct(text.alias("rule"), "verdict"), F.length(text)).alias("_best"))
    told = write_stage(best.select("host", "path", "_best.rule", F.col("_best.verdict").alias("_own")), "ruled")
    return df.join(told, ["host", "path"], "left")


def with_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df (host, path, ...)`` with ``rule`` and ``_own``, by whichever way suits the number of rules."""
    if not rules or len(rules) > EXPRESSION_RULES:
        return join_rules(df, rule_table(df.sparkSession, rules))
    told = rule_of(F.col("host"), F.col("path"), rules)
    return df.withColumn("_told", told).withColumns({"rule": F.col("_told.rule"), "_own": F.col("_told.verdict")}).drop("_told")


def _node(url: Column) -> Column:
    """The form under which a URL is compared with link targets: no scheme, no fragment."""
    host, rest = host_of(url), F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.concat(host, F.when(rest == "", "/").otherwise(rest))


def _absolute(href: Column, url: Column) -> Column:
    """A link target as a full URL, seen from the page that holds it; null if it is none."""
    href = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    site = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(.*/)[^/]*$", 1)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(site, href))
            .when((href == "") | href.rlike("^(#|[A-Za-z]+:)"), F.lit(None).cast("string"))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href)))


def _attribute(tag: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")),
                      F.nullif(F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*'([^']*)'", 1), F.lit("")),
                      F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*([^\s\"'>]+)", 1))


def page_links(pages: DataFrame) -> DataFrame:
    """``(a, b)``: nodes joined by a canonical link or a meta refresh in a page's HTML."""
    tags = F.regexp_extract_all("html", F.lit("(?i)<(?:link|meta)\\b[^<>]*+>"), F.lit(0))
    tagged = pages.filter("url LIKE '%://%' AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')").select(
        "url", F.explode(tags).alias("tag"))
    content = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    target = (F.when(F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
              .when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", content))
    return tagged.select("url", target.alias("href")).filter("href IS NOT NULL").select(
        _node(F.col("url")).alias("a"), _node(_absolute(F.col("href"), F.col("url"))).alias("b"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages (page_id, url, html)``.

    ``redirects (source_url, target_url)`` adds redirects seen while crawling.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.filter("source_url LIKE '%://%' AND target_url LIKE '%://%'").select(
            _node(F.col("source_url")).alias("a"), _node(F.col("target_url")).alias("b")))
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                          F.when(F.instr(url, "://") > 0, _node(url)).alias("_url"))
    judged = with_rules(judged, rules)
    members = connected_components(edges)
    # A node is a URL without its scheme, so its own rule is found as for a page.
    named = F.concat(F.lit("http://"), F.col("node"))
    verdicts = with_rules(members.withColumns({"host": host_of(named), "path": path_of(named)}), rules)
    # Allow sorts before block, which is the precedence wanted.
    components = write_stage(verdicts.groupBy("component").agg(F.min("_own").alias("_shared")), "verdicts")
    aliases = write_stage(members.join(components, "component").select(
        F.col("node").alias("_node"), "_shared").filter("_shared IS NOT NULL"), "aliases")
    out = judged.join(aliases, F.col("_url") == F.col("_node"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "_own", "_shared", F.lit("allow")).alias("verdict"))
