"""URL filter with redirect equivalence.

A page's own longest fitting rule decides. A url without a fitting rule takes the decision of its aliases: the
urls connected with it by redirects (``<meta http-equiv=refresh>`` or rows of ``redirects``) and canonical links.
If any alias is explicitly allowed, it is allowed; else if any is blocked, it is blocked; else it is allowed.

Every canonical and refresh tag of a page counts. Targets are resolved against the page's url as in RFC 3986: absolute
only if they start with a scheme, else ``//host``, ``/path``, ``?query``, or relative to the page's directory; dot
segments are removed.

Defined cases: a url that is null or has no ``://`` has an empty host and path, no rule and no aliases; a target that
resolves to none (``mailto:``, ``javascript:``) is no link. Fragments do not tell aliases apart. Repeated rows get equal verdicts. Of rules of equal length, the smaller action wins
(allow before block). Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.components import components
from specimen_spark.operators.keyed import attach

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK_TAG, META_TAG = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL = r"(?is)[\s\"'/]rel\s*=\s*(?:\"(?:[^\"]*\s)?canonical[\s\"]|'(?:[^']*\s)?canonical[\s']|canonical(?:[\s/>]|$))"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)[\s\"'/]href\s*=\s*[\"']?\s*([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) rows as literals, so that Spark knows their size when it picks the join."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "action"), rule)]) for rule in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def url_host(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def without_dots(url: Column) -> Column:
    """The url with the ``.`` and ``..`` segments of its path removed."""
    path, segments = F.regexp_extract(url, URL, 2), F.split(F.regexp_extract(url, URL, 2), "/", -1)
    start = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        return F.when(segment == ".", kept).when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(
            F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), start, step)
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(start)
    clean = F.concat(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0), F.lit("/"), F.array_join(F.concat(kept, end), "/"),
                     F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(path.contains("/."), clean).otherwise(url)


def resolve(base: Column, target: Column) -> Column:
    """The target of a link on the page ``base``."""
    origin, page = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0), F.regexp_extract(base, r"(?s)^[^?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(base, r"(?s)^.*?://[^/?#]*/(?:[^?#]*/)?", 0), F.lit("")), F.concat(origin, F.lit("/")))
    return without_dots(
        F.when(target.rlike(SCHEME), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .when(F.startswith(target, F.lit("?")), F.concat(page, target))
        .when(F.startswith(target, F.lit("#")), F.concat(without_fragment(base), target))
        .otherwise(F.concat(folder, target)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of all canonical links and refreshes of each page; relative targets are resolved."""

    def targets(tag: str, kind: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))

    found = F.concat(targets(LINK_TAG, CANONICAL, HREF), targets(META_TAG, REFRESH, REFRESH_URL))
    raw = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(found).alias("to")).where("to <> ''")
    edges = raw.select(F.col("url").alias("src"), resolve(F.col("url"), F.col("to")).alias("dst"))
    return edges.where(F.col("dst").rlike(SCHEME + "//"))


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each (host, path); ``rules``: host, path, action.

    A host is looked up by its suffixes, so the work is the number of labels of a host, whatever the number of rules.
    """
    places = places.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "action").distinct()
    rule = F.concat("suffix", "rule_path")
    fits = places.select("host", "path", F.explode(suffixes).alias("suffix")).join(rules, "suffix").where(F.startswith("path", F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct(-F.length(rule), "action", rule.alias("rule"))).alias("best"))
    return best.select("host", "path", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = edges.select(without_fragment(F.col("src")).alias("a"), without_fragment(F.col("dst")).alias("b"))
    stars = components(edges)
    aliases = stars.union(stars.select(F.col("component").alias("node"), "component")).distinct()
    placed = pages.select("page_id", without_fragment(F.col("url")).alias("node"), url_host("url").alias("host"), url_path("url").alias("path"))
    alias_places = aliases.select("node", "component", url_host("node").alias("host"), url_path("node").alias("path"))
    best = fitting_rules(placed.select("host", "path").union(alias_places.select("host", "path")), rules)
    decided = (
        attach(alias_places, best, ["host", "path"], "inner").groupBy("component").agg(F.min("action").alias("alias_action"))
    )  # "allow" sorts before "block", so an explicit allow takes precedence
    alias_action = attach(aliases, decided, ["component"], "inner").select("node", "alias_action")
    judged = attach(attach(placed, best, ["host", "path"]), alias_action, ["node"])
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", "alias_action", F.lit("allow")).alias("verdict"))
