"""URL filters: listed rules first, mined association rules for the rest.

FP-growth mines combinations of url tokens (host suffixes, path segments, query keys) together with the label of the page.
Rules ``tokens -> bad`` are pruned by support and confidence. Each rule is indexed under its rarest token; the tokens of a
url meet the index in a join, and a rule holds when all its tokens are among the url's.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import written

BAD = "label:bad"
SUPPORT = 0.002  # least share of the labelled urls that a rule's tokens and the label are on together
LEAST = 5  # and at least so many urls
CONFIDENCE = 0.8

# The listed rules: verdict, host, path.
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: ``h:`` for the host and each of its suffixes, ``p:`` path segments with a letter, ``q:`` keys.

    A number, also with a file ending, names one page and is left out.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, n), "."))
    )
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda s: s.rlike(r"\p{L}") & ~s.rlike(r"^[0-9]+\.[^.]*$")), lambda s: F.concat(F.lit("p:"), s)
    )
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1))
    )
    return F.when(host != "", F.array_distinct(F.concat(suffixes, segments, keys))).otherwise(F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, tokens, confidence, lift) from ``labelled`` (tokens, bad): combinations of tokens that are mostly bad."""
    n = labelled.count()
    empty = labelled.sparkSession.createDataFrame([], "rule long, tokens array<string>, confidence double, lift double")
    if not n:
        return empty
    baskets = labelled.select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=max(support, min(1.0, LEAST / n)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD))
    return rules.select(
        F.xxhash64(F.array_sort("antecedent")).alias("rule"), F.array_sort("antecedent").alias("tokens"), "confidence", "lift"
    )


def matched(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, confidence): the strongest rule whose tokens are all on the url; ``urls`` has the key and ``tokens``."""
    rarity = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    wanted = rules.select("rule", F.explode("tokens").alias("token")).join(rarity, "token", "left")
    rarest = wanted.groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = rules.join(rarest, "rule").select("token", F.col("tokens").alias("needed"), "confidence")
    posted = urls.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    held = posted.where(F.size(F.array_except("needed", "tokens")) == 0)
    return held.groupBy(key).agg(F.max("confidence").alias("confidence"))


def judged_urls(pages: DataFrame, labels: DataFrame, listed=LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page row.

    A listed rule fits its host and all subdomains if the path starts with the rule's; of several the longest text wins. Its
    verdict counts; elsewhere a url is blocked when a mined rule holds (``confidence`` tells how sure) and allowed otherwise.
    Labels belong to the page of the same id; a page is bad when its label's quality is 0 or it is toxic. Null and malformed
    urls have empty host and path and no tokens and are allowed. Equal urls are judged once; repeated rows each give a row. An
    empty table of pages gives no rows, one of labels no mined rules. Other columns play no part, whatever their names.
    """
    read = pages.select(F.col("page_id"), F.col("url"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    read = read.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    read = written(read.drop("url").withColumn("place", F.xxhash64("tokens")))
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad")
    )
    rules = written(mined_rules(read.where(F.size("tokens") > 0).join(bad, "page_id").select("tokens", "bad")))
    kinds = read.where(F.size("tokens") > 0).groupBy("place").agg(F.first("tokens").alias("tokens"))
    found = matched(kinds, rules, "place")

    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(listed, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    out = read.join(found, "place", "left").withColumn("rule", rule).withColumn("listed", verdict)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), "confidence")
