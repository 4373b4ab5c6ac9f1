"""URL filters: fixed rules first, then association rules mined by FP-growth, in DataFrame operations only.

URL tokens (labels of the host with their places, segments of the path, digits as ``#``) with the label of a rated page form
the baskets. Frequent combinations that imply a label, ``block`` or ``allow``, more often than it is found anyway become
rules: they need support, a lift over the share of their label, and a confidence that chance would not give. A rule is dropped
if a part of it says the same at least as surely. Rules are matched through an inverted index: each rule is posted under
its rarest token only, a URL looks up its tokens, and the few rules found are tested whole.

Of the rules that fit a URL, one that holds all tokens of another and says the opposite sets that other aside: it was counted
on just such URLs. Of those left the surest decides, by its confidence with one page more for either label, which is a
chance of the same kind for both labels. (Lift is not: the more common a label, the less lift a certain rule for it can have.)

Defined cases: a null URL, or one without ``://``, has empty host and path and is allowed unless a rule says
otherwise. Without labels, or with one label only, there are no mined rules and URLs without a fixed rule are
allowed. Of mined rules that are equally sure the one of more tokens decides, then block. Very long URLs are read in full, and an
empty table gives an empty table. Fixed rules win over mined ones; the longest (host and path) of several wins, and block over allow if they
are the same. Distinct URLs are judged once and joined back, so repeated rows keep their rows. Columns other than the
id and the URL play no part.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name (``net/``) and verdict of the longest fixed rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block"))
    for what, h, p in ordered:  # the last that fits stands
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: host labels with their places from the right, path segments, digits as ``#``."""
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    segments = F.transform(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(hosts, segments), lambda t: ~t.rlike(r":$")))


def mine(baskets: DataFrame, min_support: float = 0.005, min_lift: float = 1.2, least_pages: int = 20, sure: float = 5.0) -> DataFrame:
    """Rules ``(rule, says, needs, confidence, support, lift, sure)`` that imply a label, from baskets ``(tokens, blocked)``.

    The label is an item of the basket. A rule needs ``min_support`` of the baskets and ``least_pages`` of them with its
    label, ``min_lift`` times the share that the label has anyway, and a confidence ``sure`` standard deviations above
    that share (thousands of combinations are tried). It is dropped if a rule of part of its tokens is as confident.
    ``sure`` is the confidence with one page added for either label.
    """
    labels = {"block": F.lit("label:block"), "allow": F.lit("label:allow")}
    items = baskets.select(F.array_append("tokens", F.when(F.col("blocked"), labels["block"]).otherwise(labels["allow"])).alias("items"))
    total, blocked = baskets.agg(F.count("*"), F.count_if("blocked")).first()
    base = {"block": blocked / max(1, total), "allow": 1 - blocked / max(1, total)}
    support = min(1.0, max(min_support, least_pages / max(1, total)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min(1.0, min_lift * min(base.values()))).fit(items)
    says = F.substring_index(F.col("consequent")[0], ":", -1)
    rules = model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].isin(*[f"label:{k}" for k in labels]))
    share = F.when(says == "block", base["block"]).otherwise(base["allow"])
    seen = F.col("support") * total / F.col("confidence")
    chance = (F.col("confidence") - share) * F.sqrt(seen) >= F.lit(sure) * F.sqrt(share * (F.lit(1.0) - share))
    rules = rules.where((F.col("confidence") >= share * min_lift) & chance)
    smooth = (F.col("support") * total + 1) / (seen + 2)
    rules = rules.select(F.array_sort("antecedent").alias("needs"), says.alias("says"), "confidence", "support", F.try_divide(F.col("confidence"), share).alias("lift"), smooth.alias("sure")).withColumn("rule", F.array_join("needs", " "))
    weaker = _parts(rules).where((F.col("part_says") == F.col("says")) & (F.col("part_confidence") >= F.col("confidence"))).select("rule", "says").distinct()
    return rules.join(weaker, ["rule", "says"], "left_anti")


def _parts(rules: DataFrame) -> DataFrame:
    """Each rule with every rule of a part of its tokens; a part shares its first token with the whole."""
    posted = rules.select(F.col("needs").alias("small"), F.col("rule").alias("part"), F.col("says").alias("part_says"), F.col("confidence").alias("part_confidence"), F.col("needs")[0].alias("token"))
    met = rules.select("rule", "says", "needs", "confidence", F.explode("needs").alias("token")).join(posted, "token")
    return met.where((F.size("small") < F.size("needs")) & (F.size(F.array_except("small", "needs")) == 0))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url_key, says, confidence)`` of the URLs that some rule fits, by the best one; ``urls`` has ``url_key`` and ``tokens``.

    Each rule stands in the inverted index under its rarest token, so a frequent token leads only to rules that have
    nothing rarer.
    """
    wanted = rules.select(F.explode("needs").alias("token")).distinct()
    tally = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(wanted, "token")
    own = ["rule", "says", "needs", "confidence", "sure"]
    index = (
        rules.select(*own, F.explode("needs").alias("token"))
        .join(tally, "token", "left")
        .groupBy(*own)
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    hits = urls.select("url_key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("needs", "tokens")) == 0).select("url_key", *own)
    # a rule steps back where one that holds it and says the opposite fits as well
    refined = _parts(rules).where(F.col("part_says") != F.col("says")).select("rule", "says", "part", "part_says")
    aside = hits.select("url_key", "rule", "says").join(refined, ["rule", "says"]).select("url_key", F.col("part").alias("rule"), F.col("part_says").alias("says"))
    left = hits.join(aside.distinct(), ["url_key", "rule", "says"], "left_anti")
    best = left.groupBy("url_key").agg(F.max(F.struct("sure", F.size("needs").alias("size"), "says", "confidence")).alias("r"))
    return best.select("url_key", "r.says", "r.confidence")


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, **mining) -> DataFrame:
    """Add host, path, rule, verdict and the confidence of a mined rule; ``labelled`` has ``url`` and ``blocked``."""
    url = F.col("url")
    named = lambda df: df.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    baskets = named(labelled.where("url is not null and blocked is not null")).select(tokens_of(F.col("host"), F.col("path")).alias("tokens"), "blocked")
    mined = mine(baskets, **mining)
    own = named(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", name).withColumn("fixed", verdict).withColumn("url_key", F.xxhash64("host", "path"))
    # only what no fixed rule decides needs the mined ones, and each host and path once
    open_ = own.where("fixed is null").select("url_key", "host", "path").distinct().select("url_key", tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    found = match(open_, mined)
    out = own.join(found, "url_key", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("fixed", "says", F.lit("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"),
    )
