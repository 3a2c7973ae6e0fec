"""URL verdicts: given host and path rules first, then association rules mined from labels.

Labelled pages give baskets of URL tokens. Tokens that occur in just the same URLs are one item, so
that keys which always come together don't multiply. FP-growth finds the frequent combinations
among the bad pages, and an inverted index counts each over all labelled pages. A combination
becomes a rule if so many bad pages are no chance: if labels didn't depend on the URL, the probability
that any combination at all were as surprising is below CHANCE. It is left out where a part of it is
at least as sure. An index entry is a combination's rarest token: URLs
meet it there, and all its tokens are then looked for.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.texts import lower_az
from loomwright.session import Workspace

#: Verdict, host, path; a rule's name is host + path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Support: a share of the bad pages, and a count below which a confidence says nothing.
MIN_SUPPORT = 0.002
MIN_COUNT = 5
#: Probability that labels which don't depend on the URL give a rule, over all combinations together.
CHANCE = 0.05


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one, as for null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_az(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits a host or its parents and the path's start."""
    names, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, top, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(start)
        names = F.when(fits, F.lit(top + start)).otherwise(names)
        verdicts = F.when(fits, F.lit(verdict)).otherwise(verdicts)
    return names, verdicts


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, the host's last two labels, path parts (numbers alike), query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, r"/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    domain = F.array(F.concat(F.lit("d:"), F.substring_index(host, ".", -2)))
    return F.array_distinct(F.filter(F.concat(labels, domain, parts, keys), lambda x: F.length(x) > 2))


def _holding(urls: DataFrame, sets: DataFrame) -> DataFrame:
    """``urls`` (with ``held``, an array) joined to the ``sets`` (``items``, ``rare``) that they hold
    whole: they meet at the set's rarest item, whose URLs are the fewest, and are then compared."""
    met = urls.withColumn("rare", F.explode("held")).join(sets, "rare")
    return met.where(F.size(F.array_except("items", "held")) == 0).drop("rare")


def surprise(bad: Column, n: Column, base: float) -> Column:
    """-ln of Chernoff's bound for ``bad`` or more of ``n`` pages where each is bad with probability ``base``; 0 if
    there are no more than usual."""
    share = bad / n
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when(share > base, n * (share * F.log(share / base) + rest)).otherwise(0.0)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, chance: float = CHANCE) -> DataFrame:
    """(rule_id, tokens, rare, confidence) from ``labelled`` (url, bad boolean), a row per page.

    Rows with a null are not used. Equal URLs are counted together. Without bad pages, with fewer
    than ``min_count``, or where all pages are bad, there is no rule. Of combinations of k tokens out of T there are
    no more than T ** k; each length k gets 1 / (k * (k + 1)) of ``chance``.
    """
    work = Workspace(labelled.sparkSession, "url-rules")
    urls = labelled.where("url is not null and bad is not null").groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("n_bad")
    )
    urls = work.put(urls.withColumn("tokens", tokens_of(F.col("url"))), "urls")
    total, bad = urls.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    need = max(min_count, math.ceil(min_support * bad))
    if bad < need or bad == total:
        return labelled.sparkSession.createDataFrame([], "rule_id bigint, tokens array<string>, rare string, confidence double")
    each = urls.select("url", "n", "n_bad", F.explode("tokens").alias("token"))
    tokens = each.agg(F.count_distinct("token")).first()[0]
    key = [F.bit_xor(F.xxhash64("url", F.lit(i))).alias(f"set_{i}") for i in range(2)]
    single = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), *key).where(F.col("n_bad") >= need)
    # Tokens of equal sets of URLs stand in one URL together, so a group is no longer than a URL.
    groups = single.groupBy("n", "n_bad", "set_0", "set_1").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members"))
    groups = work.put(groups.select("item", "members", F.col("n").alias("item_n")), "groups")
    held = each.join(groups.select("item", F.col("item").alias("token")), "token").groupBy("url", "n", "n_bad").agg(F.collect_list("item").alias("held"))
    held = work.put(held, "held")
    baskets = held.where("n_bad > 0").select(F.explode(F.expr("array_repeat(held, cast(n_bad as int))")).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / bad)).fit(baskets).freqItemsets
    sets = work.put(frequent.select(F.array_sort("items").alias("items")).withColumn("rule_id", F.xxhash64("items")), "sets")
    parts = sets.select("rule_id", "items", F.explode("items").alias("item")).join(groups, "item").groupBy("rule_id").agg(
        F.first("items").alias("items"),
        F.min_by("item", F.struct("item_n", "item")).alias("rare"),
        F.sort_array(F.flatten(F.collect_list("members"))).alias("tokens"),
    )
    index = work.put(parts, "index")
    counted = _holding(held, index.select("rule_id", "items", "rare")).groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    size = F.size("items")
    least = size * math.log(max(2, tokens)) + F.log(size * (size + 1)) - math.log(chance)
    sure = counted.select("rule_id", (F.col("n_bad") / F.col("n")).alias("confidence"), surprise(F.col("n_bad"), F.col("n"), bad / total).alias("surprise"))
    rules = work.put(index.join(sure, "rule_id").where(F.col("surprise") >= least).drop("surprise"), "rules")
    # A rule is superfluous if a part of it is a rule of no less confidence.
    whole = rules.select(F.col("items").alias("held"), F.col("rule_id").alias("whole"), F.col("confidence").alias("own"))
    weak = _holding(whole, rules.select("items", "rare", "rule_id", "confidence")).where("whole <> rule_id and confidence >= own")
    return rules.join(weak.select(F.col("whole").alias("rule_id")).distinct(), "rule_id", "left_anti").select("rule_id", "tokens", "rare", "confidence")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct ``urls`` (url) for which a rule fires, by inverted index."""
    held = urls.select("url").where("url is not null").distinct().withColumn("held", tokens_of(F.col("url")))
    found = _holding(held, rules.select(F.col("tokens").alias("items"), "rare", "confidence"))
    return found.groupBy("url").agg(F.max("confidence").alias("confidence"))


def given(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, given (that rule's verdict, else null) for every row of ``pages``."""
    judged = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select("*", rule.alias("rule"), verdict.alias("given"))


def verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) labels the page of the same number: bad if toxic or of
    quality 0; a label with nulls in both is not used, and of repeated labels the bad one holds.
    A given rule decides; elsewhere a mined rule blocks, with its confidence, and all else is
    allowed. A null url has empty host and path and is allowed. Repeated pages come out again;
    without labels no rule is mined. Empty ``pages`` give no rows; other columns are ignored.
    """
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url")
    marks = labels.where("toxic is not null or quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(F.max(bad).alias("bad"))
    mined = mine_rules(own.join(marks, "page_id").select("url", "bad"), **limits)
    # Written, so that the join has an exchange on both sides and Spark can split a hot URL.
    found = Workspace(pages.sparkSession, "url-matches").put(matches(own, mined), "matches").withColumnRenamed("url", "__url")
    judged = given(own, rules)
    mined_verdict = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(found, F.col("url") == F.col("__url"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", mined_verdict).alias("verdict"), "confidence"
    )
