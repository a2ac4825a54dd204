"""URL filters: rule verdicts, carried over redirect and canonical-link equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest fitting rule decides.  URLs that no rule fits
take the decision of their alias group: the connected component over redirect and canonical-link edges.  In a group an explicit allow
goes before a block, a block before the default (allow).  Built-in functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelquant.llm.common import components, only, written

#: Rules up to this number are tested as one array expression in the scan; more are joined on host suffixes.
INLINE_RULES = 200


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL without its fragment and with a lower-case host, the identity used for links; null without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.lit("://"), host_of(url), rest))


def decoded(text: Column) -> Column:
    """text with its numeric character references and the five named ones of XML replaced."""
    pieces = F.split(text, "&")
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def one(p):
        number = F.regexp_extract(p, r"^#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", 0)
        code = F.coalesce(F.conv(F.regexp_extract(number, r"^#[xX]([0-9A-Fa-f]+)", 1), 16, 10), F.conv(F.regexp_extract(number, r"^#([0-9]+)", 1), 10, 10)).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        out = F.when(valid, F.concat(F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32"), F.substr(p, F.length(number) + 1)))
        for name, char in named.items():
            out = out.when(F.startswith(p, F.lit(f"{name};")), F.concat(F.lit(char), F.substr(p, F.lit(len(name) + 2))))
        return out.otherwise(F.concat(F.lit("&"), p))

    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))


def resolved(base: Column, target: Column) -> Column:
    """The absolute URL of a target on a page (RFC 3986), without the fragment; null for other schemes and for a page without `://`."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    steps = F.split(F.regexp_replace(F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own)), r"/(\.\.?)$", "/$1/"), "/")
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))))
    return (F.when(F.rlike(target, F.lit(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://")), target)
            .when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")) | (root == ""), F.lit(None).cast("string"))
            .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
            .when(own != "", F.concat(root, F.array_join(walk, "/"), query))
            .when(query != "", F.concat(root, path, query)))


def links_from_html(pages: DataFrame, url: str = "url", html: str = "html", resolve: bool = False) -> DataFrame:
    """(src, dst) from all `<link rel="canonical">` and `<meta http-equiv="refresh">` tags of a page, entities decoded.

    With resolve, relative targets are resolved against the page's `<base href>` or URL; without it only absolute targets count.
    """
    tags = lambda name, mark: F.regexp_extract_all(F.col("html"), F.lit(rf"(?is)<{name}\b(?=[^>]*{mark})[^>]*>"), F.lit(0))
    value = lambda tag, key: decoded(F.regexp_extract(tag, rf"""(?is)\b{key}\s*=\s*["']?([^"'\s>]+)""", 1))
    p = only(pages, url=url, html=html).where(F.col("html").isNotNull())
    canonical = F.transform(tags("link", r"""\brel\s*=\s*["']?canonical\b"""), lambda t: value(t, "href"))
    refresh = F.transform(tags("meta", r"""\bhttp-equiv\s*=\s*["']?refresh\b"""), lambda t: value(t, "url"))
    first_base = value(F.regexp_extract(F.col("html"), r"""(?is)<base\b(?=[^>]*\bhref)[^>]*>""", 0), "href")
    to = p.select("url", first_base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("to")).where(F.col("to") != "")
    base = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url")))
    target = resolved(base, F.col("to")) if resolve else F.col("to")
    return to.select(node_of(F.col("url")).alias("src"), node_of(target).alias("dst")).where("src is not null and dst is not null and src <> dst")


def rule_verdicts(urls: DataFrame, rules: list[tuple[str, str, str]], key: list[str]) -> DataFrame:
    """key, host, path -> the same with `rule` and `rule_verdict` (null where none fits).  rules: (verdict, host, path)."""
    fits = lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["p"])
    rank = lambda r: F.struct((F.length(r["h"]) + F.length(r["p"])).alias("n"), F.length(r["h"]).alias("k"), r["h"].alias("h"), r["p"].alias("p"), r["v"].alias("v"))
    if not rules:
        return urls.select(*key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
    if len(rules) <= INLINE_RULES:
        table = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for v, h, p in rules])
        best = urls.select(*key, "host", "path", F.array_max(F.transform(F.filter(table, fits), rank)).alias("best"))
    else:
        table = urls.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "h string, p string, v string")
        one = urls.select("host", "path").distinct()
        dots = F.split("host", r"\.")
        suffix = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.concat_ws(".", F.slice(dots, i, F.size(dots))))
        found = one.select("host", "path", F.explode(suffix).alias("h")).join(table, "h").where(F.startswith("path", F.col("p")))
        found = found.groupBy("host", "path").agg(F.max(rank({c: F.col(c) for c in "hpv"})).alias("best"))
        best = urls.select(*key, "host", "path").join(found, ["host", "path"], "left").select(*key, "host", "path", "best")
    return best.select(*key, "host", "path", F.concat("best.h", "best.p").alias("rule"), F.col("best.v").alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages, repeated rows included.

    links: (src, dst) URLs as `node_of` writes them, seen or unseen as pages.  A null or odd URL has an empty host and path, fits no rule
    and is allowed.  Empty tables give empty results.
    """
    p = only(pages, page_id=page_id, url=url).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = rule_verdicts(p, rules, ["page_id", "url"])
    links = written(links.select("src", "dst"), "links")
    if links.isEmpty():  # no alias anywhere: the rule or the default decides
        return own.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    group = components(links)
    members = rule_verdicts(group.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules, ["node", "component"])
    decided = members.groupBy("component").agg(
        F.min(F.when(F.col("rule_verdict") == "allow", 0).when(F.col("rule_verdict") == "block", 1)).alias("d")).where("d is not null")
    alias = members.where("rule_verdict is null").join(decided, "component").select("node", F.when(F.col("d") == 0, "allow").otherwise("block").alias("alias_verdict"))
    return own.withColumn("node", node_of(F.col("url"))).join(alias, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
