"""URL filters from association rules.

Curated (host, path) rules judge the urls they fit; those judgements are the
labels from which Spark's FP-growth mines combinations of URL tokens that go
with ``block`` or ``allow``.  Mined rules are pruned by support and confidence
and matched through an inverted index (token -> rules): a rule fits a url if as
many of its tokens hit as it has.  Of the mined rules that fit, the one of the
highest confidence (then support, then length, then smallest id) decides; a url
that none fits gets the default.

Bounds: an itemset needs ``min_support`` of the labelled urls, so the number of
frequent tokens is at most tokens-per-url / min_support, whatever the input.  A url of
more than ``MAX_BASKET`` frequent tokens (a long path that repeats) has 2 ** tokens
combinations for FP-growth, so those within the tokens of such urls are counted level
by level instead, up to a rule's length and over all urls; FP-growth counts the others
in the rest.  Both counts are exact.  Urls are mined and matched once per distinct url.

Edge cases: a null url or one without ``://`` has an empty host and path, no
token but that fact and the default verdict; repeated rows are judged alike; an
empty table gives no rows, and without labelled urls nothing is mined.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import staged, table

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 3
MAX_BASKET = 12
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def curated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest curated rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, each domain suffix, each path word with its
    depth (digits as ``#``), the extension and each query key."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.concat_ws(".", F.slice(labels, k, n))))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    words = F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.element_at(F.split(x, "="), 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1))))
    depth = F.array(F.concat(F.lit("depth:"), F.size(parts).cast("string")))
    none = F.array(F.lit("no url"))
    return F.when(url.isNull() | (host == ""), none).otherwise(F.array_distinct(F.concat(scheme, suffixes, words, keys, depth)))


def _by_level(baskets: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """(tokens sorted, label, times) -> tokens, label, n, total: sets of at most
    ``max_tokens`` tokens that ``least`` baskets of a label hold.

    A set is extended where it is frequent with some label, in the baskets of every
    label, so ``total`` counts them all.  Not extended are sets of one label only and
    sets held by all baskets of a smaller one: the rules of their extensions have the
    confidence of a shorter rule, so they would be redundant (thousands of words of
    one long path always go together).
    """
    rows = staged(baskets.withColumn("id", F.monotonically_increasing_id()), "url-level")
    at = rows.select("id", "label", "times", F.explode("tokens").alias("last")).withColumn("set", F.array("last")).withColumn("under", F.lit(None).cast("bigint"))
    found = []
    for size in range(1, max_tokens + 1):
        at = staged(at, "url-sets")
        each = at.groupBy("set", "label").agg(F.sum("times").alias("n"), F.min("under").alias("under"))
        sets = each.groupBy("set").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("under").alias("under"), F.collect_list(F.struct("label", "n")).alias("by")).filter(F.col("most") >= least)
        sets = staged(sets, "url-frequent")
        found.append(sets.select("set", "total", F.explode("by").alias("b")).filter(F.col("b.n") >= least))
        onward = sets.filter((F.col("most") < F.col("total")) & (F.col("under").isNull() | (F.col("total") < F.col("under")))).select("set", "total")
        if size == max_tokens or onward.isEmpty():
            break
        at = at.drop("under").join(onward, "set").withColumn("head", F.slice("set", 1, size - 1) if size > 1 else F.array().cast("array<string>"))
        a, b = at.alias("a"), at.alias("b")
        both = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.last") < F.col("b.last")))
        at = both.select("a.id", "a.label", "a.times", "b.last", F.array_append("a.set", F.col("b.last")).alias("set"), F.least("a.total", "b.total").alias("under"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("set").alias("tokens"), "b.label", "b.n", "total")


def _subsets(tokens: Column, max_tokens: int) -> Column:
    """The proper subsets, but the empty one, of a sorted array of at most ``max_tokens`` tokens."""
    of = []
    for n in range(1, max_tokens):
        for at in itertools.combinations(range(max_tokens), n):
            of.append(F.when((F.size(tokens) > n) & (F.size(tokens) > at[-1]), F.array(*[F.get(tokens, F.lit(i)) for i in at])))
    return F.filter(F.array(*of), lambda x: x.isNotNull()) if of else F.array().cast("array<array<string>>")


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """(tokens array, label) rows -> rules: rule_id, tokens, verdict, confidence, support.

    A rule that has more tokens than another of the same verdict and at least
    its confidence, all of the other's included, adds nothing and goes.
    """
    spark = labelled.sparkSession
    rows = staged(labelled.select("tokens", F.concat(F.lit("label="), F.col("label")).alias("label")).withColumn("id", F.monotonically_increasing_id()), "url-labelled")
    total = rows.count()
    least = max(1, math.ceil(min_support * total))
    each = rows.select("id", "label", F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").agg(F.count("*").alias("times")).filter(F.col("times") >= least).select("token")
    kept = each.join(frequent, "token").groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("kept"))
    baskets = rows.join(kept, "id", "left").select(F.coalesce("kept", F.array().cast("array<string>")).alias("tokens"), "label")
    baskets = staged(baskets, "url-baskets")
    schema = "rule_id string, tokens array<string>, verdict string, confidence double, support double"
    if baskets.isEmpty():
        return spark.createDataFrame([], schema)
    short, long = (baskets.filter(x) for x in (F.size("tokens") <= MAX_BASKET, F.size("tokens") > MAX_BASKET))
    few = short.count()
    counted = spark.createDataFrame([], "tokens array<string>, label string, n long, total long")
    if few >= least:
        # the count asked for is that of all urls, whatever part of them is looked at
        items = short.select(F.array_append("tokens", F.col("label")).alias("items"))
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / few, minConfidence=min_confidence).fit(items).associationRules
        found = found.filter(F.col("consequent")[0].startswith("label=") & (F.size("antecedent") <= max_tokens))
        found = found.filter(~F.exists("antecedent", lambda x: x.startswith("label=")))
        n = F.round(F.col("support") * few).cast("bigint")
        counted = found.select(F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("label"), n.alias("n"), F.round(n / F.col("confidence")).cast("bigint").alias("total"))
    if few < total:
        # sets of tokens of long urls are counted in all urls; no long url holds any of the others
        words = staged(long.select(F.explode("tokens").alias("token")).distinct(), "url-words")
        numbered = baskets.withColumn("id", F.monotonically_increasing_id()).select("id", "label", F.explode("tokens").alias("token"))
        cut = numbered.join(words, "token").groupBy("id", "label").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        level = _by_level(cut.groupBy("tokens", "label").agg(F.count("*").alias("times")), least, max_tokens)
        counted = counted.withColumn("id", F.monotonically_increasing_id())
        other = counted.select("id", F.explode("tokens").alias("token")).join(words, "token", "left_anti").select("id").distinct()
        counted = counted.join(other, "id", "left_semi").drop("id").unionByName(level)
    confidence = F.col("n") / F.col("total")
    rules = counted.filter(confidence >= min_confidence).select("tokens", F.substring("label", 7, 1 << 20).alias("verdict"), confidence.alias("confidence"), (F.col("n") / F.lit(total)).alias("support"))
    rules = rules.withColumn("rule_id", F.md5(F.concat_ws("\n", F.array_append("tokens", F.col("verdict")))))
    rules = staged(rules.select("rule_id", "tokens", "verdict", "confidence", "support"), "url-rules")
    # a rule is held against those of its subsets only, so the pairs follow the number of rules
    parts = rules.select(F.col("tokens").alias("whole"), "verdict", F.col("confidence").alias("c"), F.explode(_subsets(F.col("tokens"), max_tokens)).alias("tokens"))
    worse = parts.join(rules, ["tokens", "verdict"]).filter(F.col("confidence") >= F.col("c")).select(F.col("whole").alias("tokens"), "verdict").distinct()
    return staged(rules.join(worse, ["tokens", "verdict"], "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support"), "url-rules-kept")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, tokens) with distinct urls -> url, mined (the deciding rule); urls that no rule fits are absent.

    The index names each rule under that of its tokens which the fewest urls have, so
    a url meets few rules that it does not fit, however common their other tokens.
    """
    each = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    listed = rules.withColumn("token", F.explode("tokens"))
    held = each.join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = listed.join(held, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("least"))
    index = rules.join(rarest, "rule_id").select(F.col("least.token").alias("token"), "rule_id", F.col("tokens").alias("wanted"), "verdict", "confidence", "support")
    full = each.join(index, "token").filter(F.size(F.array_except("wanted", "tokens")) == 0)
    best = F.max_by(F.struct("verdict", "rule_id", "confidence", "support"), F.struct("confidence", "support", F.size("wanted").alias("n"), "rule_id"))
    return full.groupBy("url").agg(best.alias("mined"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = DEFAULT,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, mined_rule, confidence."""
    url = F.col("url")
    rule, verdict = curated(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path")).withColumn("rule", rule).withColumn("by_rule", verdict)
    labelled = judged.filter(F.col("by_rule").isNotNull()).select("url", "by_rule").distinct()
    labelled = labelled.select(url_tokens(url).alias("tokens"), F.col("by_rule").alias("label"))
    mined = mine_rules(labelled, min_support, min_confidence)
    open_urls = judged.filter(F.col("by_rule").isNull() & url.isNotNull()).select("url").distinct().select("url", url_tokens(url).alias("tokens"))
    decided = match_rules(open_urls, mined)
    out = judged.join(decided, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.col("mined.verdict"), F.lit(default)).alias("verdict"), F.col("mined.rule_id").alias("mined_rule"), F.col("mined.confidence").alias("confidence"))


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
