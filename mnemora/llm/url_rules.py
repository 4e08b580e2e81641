"""URL filters: fixed host and path rules, and association rules mined from labelled urls by FP-growth."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import lower_ascii, saved

# (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BLOCK, ALLOW = "block", "allow"
CLASS = "class:block"
# A combination needs this share of the labelled pages behind it; every rule this share of blocked ones among its pages.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
# Blocked pages that a rule needs at least, so that small tables give no rules by chance.
MIN_ROWS = 10
# All ASCII but letters and digits.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*+", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.regexp_extract(after, "^[^?#]*+", 0)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (name, verdict) of a short list that fits; null where none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: all its parts and the words inside them.

    Scheme, host, last one and two labels, every label, every path segment and the first one as such, shape
    of the last segment (digits as 0), every field of the query with and without its value, the names of
    all fields, the fragment and whether there is one; the words of labels, segments, values and fragment.
    """
    segments = F.split(path, "/")
    query = F.regexp_extract(url, r"^[^?#]*+\?([^#]*+)", 1)
    given = F.split(query, "&")
    names = F.transform(given, lambda f: F.substring_index(f, "=", 1))
    anchor = F.regexp_extract(url, "#(.*)$", 1)
    words = lambda parts: F.flatten(F.transform(parts, lambda p: F.split(lower_ascii(p), WORD_BREAK)))
    places = {
        "scheme": F.lower(F.substring_index(url, "://", 1)),
        "host": host,
        "top": F.element_at(F.split(host, r"\."), -1),
        "domain": F.substring_index(host, ".", -2),
        "folder": F.get(segments, 1),
        "leaf": F.regexp_replace(F.element_at(segments, -1), "[0-9]+", "0"),
        "fields": F.array_join(F.array_sort(F.array_distinct(names)), "&"),
        "fragment": F.when(F.instr(url, "#") > 0, F.lit("yes")),
        "anchor": anchor,
    }
    lists = {
        "label": F.split(host, r"\."),
        "name": words(F.split(host, r"\.")),
        "segment": segments,
        "slug": words(segments),
        "field": given,
        "parameter": names,
        "value": words(F.transform(F.filter(given, lambda f: F.instr(f, "=") > 0), lambda f: F.regexp_extract(f, "=(.*)$", 1))),
        "mark": words(F.array(anchor)),
    }
    named = lambda k: lambda v: F.when(v != "", F.concat(F.lit(k + ":"), v))
    each = [F.array(named(k)(v)) for k, v in places.items()] + [F.transform(v, named(k)) for k, v in lists.items()]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(*each))))


def token_groups(urls: DataFrame) -> DataFrame:
    """(name, members, n, bad): tokens with at least MIN_ROWS blocked pages; those of the same urls are one group.

    Sets of urls are compared by their counts and two 64-bit sums of hashes. ``name`` is the least member.
    """
    tokens = (
        urls.select("url", "n", "bad", F.explode("tokens").alias("item"))
        .groupBy("item")
        .agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("urls"),
            F.bit_xor(F.xxhash64("url")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "url")).alias("b"),
        )
        .where(F.col("bad") >= MIN_ROWS)
    )
    groups = tokens.groupBy("n", "bad", "urls", "a", "b").agg(F.min("item").alias("name"), F.collect_list("item").alias("members"))
    return groups.select("name", "members", "n", "bad")


def combinations(labelled: DataFrame, urls: DataFrame, groups: DataFrame, pages: int, least: int) -> DataFrame:
    """(items, support, n) of the token groups that FP-growth finds together on ``least`` blocked pages.

    Left out beforehand are groups that cannot be part of a rule that stays: those on fewer blocked pages,
    those that are always blocked, and those on all pages, whose combinations are no surer than their parts.
    """
    mixed = groups.where((F.col("bad") >= least) & (F.col("bad") < F.col("n")) & (F.col("n") < pages))
    kept = urls.select("url", F.explode("tokens").alias("name")).join(F.broadcast(mixed.select("name")), "name")
    kept = kept.groupBy("url").agg(F.collect_list("name").alias("kept"))
    baskets = saved(
        labelled.select("url", "blocked").join(kept, "url").select(
            F.when(F.col("blocked"), F.array_append("kept", CLASS)).otherwise(F.col("kept")).alias("items")
        ),
        "baskets",
    )
    # Half a page less, so that rounding up gives the same number of pages.
    share = min(1.0, (least - 0.5) / max(baskets.count(), 1))
    model = FPGrowth(itemsCol="items", minSupport=share).fit(baskets)
    sets = saved(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    sure = sets.where(F.array_contains("items", CLASS) & (F.size("items") > 2)).select(
        F.array_remove("items", CLASS).alias("items"), F.col("freq").alias("support")
    )
    return sure.join(sets.withColumnRenamed("freq", "n"), "items")


def mined_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules (items, parts, confidence, support, post) from rows with ``url``, ``tokens`` and ``blocked``.

    Single tokens are counted over all labelled rows and need MIN_ROWS blocked pages however many rows
    there are, so that rare hosts can have rules; combinations come from FP-growth and need ``min_support``
    of the rows too. Tokens that always stand together are mined as one, named in ``items``; any of its
    members in ``parts`` fulfils it. A rule is dropped when a rule on a part of its items is at least as
    sure. The inverted index files a rule under each member ``post`` of its rarest group.
    """
    labelled = labelled.where(F.size("tokens") > 0)
    counted = labelled.groupBy("url").agg(
        F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.count_if("blocked").alias("bad")
    )
    urls = saved(counted, "labelled-urls")
    pages = urls.agg(F.sum("n")).first()[0] or 0
    groups = saved(token_groups(urls), "token-groups")
    least = max(MIN_ROWS, math.ceil(min_support * pages))
    single = groups.select(F.array("name").alias("items"), F.col("bad").alias("support"), "n")
    rules = single.unionByName(combinations(labelled, urls, groups, pages, least))
    rules = rules.withColumn("confidence", F.col("support") / F.col("n")).drop("n").where(F.col("confidence") >= min_confidence)
    named = rules.select("*", F.explode("items").alias("name")).join(groups.select("name", "members", "n"), "name")
    rules = named.groupBy("items", "support", "confidence").agg(
        F.collect_list("members").alias("parts"), F.min_by(F.struct("name", "members"), F.struct("n", "name")).alias("rarest")
    )
    rules = saved(rules, "rules")
    parts = rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure"), F.col("rarest.name").alias("name"))
    worse = (
        rules.select("items", "confidence", F.explode("items").alias("name"))
        .join(parts, "name")
        .where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
        .where(F.col("sure") >= F.col("confidence"))
        .select("items")
        .distinct()
    )
    left = rules.join(worse, "items", "left_anti")
    return left.select("items", "parts", "confidence", "support", F.explode("rarest.members").alias("post"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the surest rule for each distinct url, looked up in the inverted index."""
    found = urls.select("url", "tokens", F.explode("tokens").alias("post")).join(rules, "post")
    fits = F.forall("parts", lambda members: F.arrays_overlap(members, "tokens"))
    return found.where(fits).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every page.

    A page is labelled by the row of ``labels`` with its id: blocked when toxic or of quality 0. Urls are
    matched once each, however many pages have them. Null urls, or those without ://, fit nothing
    and are allowed; repeated pages and labels count each; without labels or pages of both kinds nothing
    is mined. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("blocked"))
    found = matched(rows.select("url", "tokens").distinct(), mined_rules(rows.join(known, "page_id")))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("confidence").isNotNull(), BLOCK).otherwise(ALLOW)
    return (
        rows.drop("tokens")
        .join(found, "url", "left")
        .withColumn("fits", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("fits.name").alias("rule"),
            F.coalesce("fits.verdict", method).alias("verdict"),
            "confidence",
        )
    )
