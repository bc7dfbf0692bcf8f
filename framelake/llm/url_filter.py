"""URL filters with redirect equivalence.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's; the
longest one decides. Addresses that redirect to each other or name each other as canonical are one: connected
components over those edges carry block decisions to aliases that no rule fits, unless a rule allows an address of the
component explicitly, which takes precedence. Scheme, fragment, trailing slashes and tracking parameters don't tell
addresses apart.

Everything is built-in expressions. A null url, or one without ://, has an empty host and path, which no rule fits, and
is no alias: it is allowed. Repeated rows give repeated results; an empty table gives an empty result; null html has no
links. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, let, stored
from .components import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), A_TO_Z, A_TO_Z.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The address that aliases share; null for no address."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(path(url), r"/+$", ""), F.when(kept == "&", "").otherwise(kept)))


def fitting(host_: Column, path_: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):  # of two as long the allowing one
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def seen_from(base: str, target: str) -> Column:
    """A target (a column, trimmed and without fragment) as an address, seen from a base address; null for none, and for schemes
    without ://.
    """
    b, t = F.col(base), F.col(target)
    before = F.regexp_extract(b, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(b, r"^.*?://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    whole = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when((before == "") | (t == ""), None)
    whole = whole.when(t.startswith("/"), F.concat(before, t)).when(t.startswith("?"), F.concat(F.regexp_replace(b, "[?#].*$", ""), t))
    return whole.otherwise(F.concat(before, F.when(folder == "", "/").otherwise(folder), t))


def straight(url: Column) -> Column:
    """An address without the steps . and .. in its path."""
    steps = F.split(F.regexp_extract(url, r"^.*?://[^/?#]*/?([^?#]*)", 1), "/", -1)
    walked = F.aggregate(steps, F.lit(""), lambda done, step: F.when(step == "..", F.regexp_replace(done, "/[^/]*$", "")).when(step == ".", done).otherwise(F.concat(done, F.lit("/"), step)))
    return F.when(url.rlike(r"/\.{1,2}(/|[?#]|$)"), F.concat(F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1), walked, F.regexp_extract(url, r"([?][^#]*)", 1))).otherwise(url)


#: Comments, and elements whose content is not markup; what isn't closed goes on to the end.
NO_MARKUP = r"(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b.*?(?:</\1\s*>|$)"
#: Whole tags that name addresses; quoted values are taken whole.
TAGS = r"(?is)<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
REFERENCES = [("&", r"(?i)&(?:amp|#38|#x0*26);"), ("/", r"(?i)&(?:sol|#47|#x0*2f);"), (":", r"(?i)&(?:colon|#58|#x0*3a);"), (".", r"(?i)&(?:period|#46|#x0*2e);")]


#: Attributes with their values, read one after another, so that none is found within the value of another.
ATTRIBUTES = r"(?is)[^\s\"'>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, character references that addresses hold decoded; empty without one."""
    one = F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTES), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    value = let(F.coalesce(one, F.lit("")), lambda a: F.concat(*(F.regexp_extract(a, r"(?s)^[^=]*=\s*(?:\"([^\"]*)\"|'([^']*)'|(.*))$", k) for k in (1, 2, 3))))
    for plain, written in REFERENCES:
        value = F.regexp_replace(value, written, plain)
    return value


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The edges (a, b) of canonical links and page redirects, as nodes, with the urls that they come from.

    All of a page's are taken: links whose rel holds the word canonical, and refreshes with an address. Targets may be relative, to the
    page's first base address if it has one. What stands in comments, scripts and the like names nothing.
    """
    named = pages.where(F.col(html_col).rlike("(?i)canonical|refresh")).select(F.col(url_col).alias("url"), F.regexp_extract_all(F.regexp_replace(html_col, NO_MARKUP, " "), F.lit(TAGS), F.lit(0)).alias("tags"))
    of = lambda name: F.filter("tags", lambda t: t.rlike(rf"(?i)^<{name}\b"))
    words = lambda t: F.split(F.lower(attribute(t, "rel")), r"\s+")
    canonical = F.transform(F.filter(of("link"), lambda t: F.array_contains(words(t), "canonical")), lambda t: attribute(t, "href"))
    refresh = F.transform(F.filter(of("meta"), lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh"), lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"']+)", 1))
    based = F.get(F.filter(F.transform(of("base"), lambda t: attribute(t, "href")), lambda v: v != ""), F.lit(0))
    # a step a column, so that no expression is written out over and over
    plain = lambda t: F.regexp_replace(F.trim(t), "#.*$", "")
    found = named.select("url", plain(based).alias("based"), F.concat(canonical, refresh).alias("targets"))
    bases = found.select("url", seen_from("url", "based").alias("base"), "targets").select("url", F.coalesce(straight(F.col("base")), F.col("url")).alias("base"), F.explode("targets").alias("target"))
    ends = bases.where("target <> ''").select("url", "base", plain(F.col("target")).alias("target")).select("url", seen_from("base", "target").alias("far"))
    return usable(ends.select("url", straight(F.col("far"))))


def usable(edges: DataFrame) -> DataFrame:
    """Edges of two urls as nodes, without those that have no address or stay where they are."""
    # made by a generator, so that the filter isn't pushed below, where it would repeat the expressions
    both = F.explode(F.array(F.struct(node(F.col("a_url")).alias("a"), node(F.col("b_url")).alias("b"))))
    ends = edges.toDF("a_url", "b_url").select("a_url", "b_url", both.alias("ends")).select("a_url", "b_url", "ends.a", "ends.b")
    return ends.where("a is not null and b is not null and a <> b").distinct()


def url_filter(pages: DataFrame, rules: list[Rule] | None = None, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Per row: the id, host, path, rule (null: none fits) and verdict. redirects: further edges (src, dst) of urls."""
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), url.alias("url"), F.coalesce(host(url), F.lit("")).alias("host"), F.coalesce(path(url), F.lit("")).alias("path"), node(url).alias("node"))
    name, verdict = fitting(F.col("host"), F.col("path"), rules)
    judged = parts.select(id_col, "host", "path", "node", name.alias("rule"), verdict.alias("own"))

    edges = pages.sparkSession.createDataFrame([], "a_url string, b_url string, a string, b string") if html_col is None else links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(usable(redirects.select("src", "dst")))
    edges = stored(edges)
    decided = judged.where("node is not null").select("node", "own")
    if not edges.isEmpty():
        # ends of edges that are no page are judged too
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_url").alias("url")), F.struct(F.col("b").alias("node"), F.col("b_url").alias("url")))).alias("end")).select("end.*")
        decided = decided.union(ends.select("node", fitting(host(F.col("url")), path(F.col("url")), rules)[1].alias("own")))
    flags = lambda df: df.groupBy("node").agg(F.max((F.col("own") == "block").cast("int")).alias("block"), F.max((F.col("own") == "allow").cast("int")).alias("allow"))
    by_node = flags(decided)
    linked = not edges.isEmpty()
    if linked:
        of = components(edges)
        by_node = by_node.join(of.withColumnRenamed("node", "end"), F.col("node") == F.col("end"), "left").withColumn("component", F.coalesce("component", "node"))
        total = by_node.groupBy("component").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
        by_node = by_node.select("node", "component").join(total, "component")
    blocked = by_node.where("block = 1 and coalesce(allow, 0) = 0").select(F.col("node").alias("alias"))
    # rows without an address, or with a rule of their own, need no look-up
    open_ = judged.where("node is not null and own is null").join(blocked, F.col("node") == F.col("alias"), "left")
    rest = judged.where("node is null or own is not null").withColumn("alias", F.lit(None).cast("string"))
    final = F.coalesce("own", F.when(F.col("alias").isNotNull(), "block").otherwise("allow"))
    out = open_.select(*judged.columns, "alias").union(rest.select(*judged.columns, "alias")).select(id_col, "host", "path", "rule", final.alias("verdict"))
    if linked:
        out = stored(out)
        dropped(of)
        dropped(edges)
    return out
