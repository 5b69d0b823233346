"""URL rules with redirect equivalence, with SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witness.llm.common import components, cut

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scheme_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def without_port(host: Column, scheme: Column) -> Column:
    """The host without a port that its scheme has anyway, or an empty one."""
    low = F.lower(scheme)
    return F.when(low == "http", F.regexp_replace(host, ":(?:80)?$", "")).when(low == "https", F.regexp_replace(host, ":(?:443)?$", "")).otherwise(host)


def _walked(path: Column) -> Column:
    steps = F.filter(F.split(path, "/"), lambda x, i: (i > 0) & (x != "."))
    done = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
        lambda done: F.concat(F.lit("/"), F.array_join(done, "/")),
    )
    return F.regexp_replace(F.concat(done, F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")), "^//$", "/")


def without_dots(path: Column) -> Column:
    """An absolute path without its dot segments: each ``..`` takes the step before it along."""
    return _let(path, lambda p: F.when(p.rlike(r"/\.{1,2}(?:/|$)"), _walked(p)).otherwise(p))


def canonical(url: Column) -> Column:
    """A key shared by spellings of one address, null without a host.

    Scheme and its own port, ``www.`` and ``m.``, dot segments, fragment, tracking parameters and a closing slash don't
    count.
    """
    host = F.regexp_replace(without_port(host_of(url), scheme_of(url)), r"^(?:www|m)\.(?=[^.]+\.)", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|ref)="))), "&")
    key = F.concat(host, F.regexp_replace(without_dots(path_of(url)), "/+$", ""), F.lit("?"), query)
    return F.when(host != "", key)


def resolve(value: Column, url: Column) -> Column:
    """The absolute address that a link on page ``url`` means, without dot segments and a port that goes without saying;
    null if it leads nowhere else (fragments, other schemes)."""
    return _let(_absolute(F.regexp_replace(value, "&(?:amp|#38|#[xX]26);", "&"), url), _mended)


def _absolute(value: Column, url: Column) -> Column:
    no, other = F.lit(None).cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*:"
    root = F.regexp_extract(url, r"(?s)^.*?([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.concat(path_of(url), F.when(path_of(url) == "", "/").otherwise("")), "[^/]*$", "")
    return _let(value, lambda v: (
        F.when((v == "") | v.startswith("#"), no).when(v.rlike(f"{other}//"), v).when(v.rlike(other), no)
        .when(v.startswith("//"), F.concat(scheme_of(url), F.lit(":"), v)).when(host_of(url) == "", no)
        .when(v.startswith("/"), F.concat(root, v)).when(v.startswith("?"), F.concat(root, path_of(url), v)).otherwise(F.concat(root, folder, v))
    ))


def _mended(url: Column) -> Column:
    """Without dot segments and the scheme's own port; only what has some is put together anew."""
    head, host = F.regexp_extract(url, r"(?s)^(.*?://)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    anew = F.concat(head, without_port(host, scheme_of(url)), without_dots(path_of(url)), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(host.contains(":") | path_of(url).contains("/."), anew).otherwise(url)


def _value(tag: Column) -> Column:
    """The address in a tag's href or content."""
    return F.trim(F.regexp_extract(tag, r"(?is)\s(?:href|content)\s*=\s*[\"']?(?:\s*\d+\s*;\s*url\s*=\s*[\"']?)?([^\"'>\s]+)", 1))


def targets(html: Column, url: Column) -> Column:
    """Addresses that a page names as its own or redirects to: canonical links, refresh headers and og:url.

    They are resolved against the page's first ``base`` address, if it has one, else against its url; comments don't count.
    """
    shown = F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")).otherwise(html)
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    own = r"(?is)\srel\s*=\s*[\"']?(?:[^\"'>]*\s)?canonical\b|\shttp-equiv\s*=\s*[\"']?refresh\b|\sproperty\s*=\s*[\"']?og:url\b"

    def named(tags: Column) -> Column:
        base = F.try_element_at(F.filter(tags, lambda t: t.rlike(r"(?is)^<base\b[^>]*\shref\s*=")), F.lit(1))
        wanted = F.filter(tags, lambda t: t.rlike(own))
        return _let(F.coalesce(resolve(_value(base), url), url), lambda page: F.filter(F.transform(wanted, lambda t: resolve(_value(t), page)), lambda v: v.isNotNull()))

    return _let(tags, named)


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict: the longest rule that fits each different (host, path); places without one are left out.

    Each host is looked up by its suffixes, so a rule list of any size is one equality join.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_prefix"), "verdict", F.concat("host", "path").alias("rule"))
    known = F.broadcast(known) if rules.count() <= MAX_BROADCAST else known
    return (
        places.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("_suffix"))
        .join(known, "_suffix")
        .where(F.col("path").startswith(F.col("_prefix")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("a"), "rule")).alias("r"))
        .select("host", "path", "r.rule", F.when(F.col("r.a"), "allow").otherwise("block").alias("verdict"))
    )


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_root: a verdict for every row of ``pages``.

    A url's own rule decides (the longest; of equals, allow).  Else its aliases do: pages are aliases if their urls
    are spellings of one address (``canonical``) or one names the other's address, or both name the same, as canonical
    link or redirect, over any number of steps.  Links are resolved against the page's base or url.  If the rules allow an address of such a set outright, its members
    without a rule are allowed; else, if they block one, blocked; else ``default``.  ``alias_root`` is the smallest
    page_id of the set.  Rows that repeat a page_id are aliases of each other; rows with a null page_id have no
    aliases.  A null url, or one without ``://``, has empty host and path and fits no rule.  Null html names nothing.
    """
    spark = pages.sparkSession
    rules = rules if rules is not None else spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    url = F.col("url")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", targets(F.col("html"), url).alias("named"))
    seen = cut(own.select("page_id", "url", "named", host_of(url).alias("host"), path_of(url).alias("path")))
    named = seen.select("page_id", F.explode("named").alias("url"))
    address = (
        seen.select("page_id", "url", "host", "path")
        .unionByName(named.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    )
    ruled = cut(match_rules(address, rules))
    # Pages that share an address meet in its smallest page_id: sums that combine before the shuffle, then a join.
    keys = address.where("page_id is not null").select("page_id", canonical(F.col("url")).alias("key")).where("key is not null")
    shared = keys.groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    # Sides that grow with the pages are joined by shuffle at any size.
    edges = keys.join(shared.hint("merge"), "key").select(F.col("page_id").alias("a"), F.col("first").alias("b"))
    # By rounds at any size, which are SQL functions only.
    root = components(edges, small=0)
    own_verdict = address.where("page_id is not null").join(ruled.hint("merge"), ["host", "path"]).select("page_id", "verdict")
    decided = (
        own_verdict.join(root.hint("merge"), own_verdict.page_id == root.node, "left")
        .groupBy(F.coalesce("root", "page_id").alias("root"))
        .agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"))
    )
    linked = root.join(decided.hint("merge"), "root", "left").select("node", F.col("root").alias("alias_root"), "allowed")
    # A page outside any set may still name an address with a rule.
    alone = decided.join(root.select(F.col("node").alias("root")).hint("merge"), "root", "left_anti").select(F.col("root").alias("node"), F.col("root").alias("alias_root"), "allowed")
    method = F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block").otherwise(default)
    return (
        seen.select("page_id", "host", "path")
        .join(ruled.hint("merge"), ["host", "path"], "left")
        .join(linked.unionByName(alone).hint("merge"), F.col("page_id") == F.col("node"), "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.coalesce("alias_root", "page_id").alias("alias_root"))
    )
