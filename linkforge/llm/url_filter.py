"""URL filtering by explicit host/path rules and mined association rules.

FP-growth finds the token combinations of labelled URLs; rules token set -> block that
pass a support and a confidence threshold, and that no smaller rule makes redundant, are kept. Tokens that
the same labelled URLs have are one item, so a long path that many URLs share doesn't multiply the combinations. An inverted
index from each rule's rarest item finds the rules that a URL might match; a match holds a token of every item.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import staged

ALLOW, BLOCK = "allow", "block"
_BLOCKED = "label=block"
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The inverted index is broadcast up to this many entries, and joined by shuffle beyond.
_BROADCAST_ROWS = 20_000


def url_parts(url) -> tuple[F.Column, F.Column]:
    """(host, path): the host A-Z lower-cased, the path up to ``?`` or ``#``; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, *_AZ), path


def rule_of(host, path, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """(rule text, verdict) of the longest of ``rules`` (verdict, host, path) that fits; both null if none does.

    A rule fits its host and all subdomains where the path starts with its own.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def url_tokens(url) -> F.Column:
    """Distinct tokens: scheme, host suffixes, path segments (numbers as one token), file ending, query keys, whether there is a fragment."""
    host, path = url_parts(url)
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "0")))
    ending = F.transform(F.regexp_extract_all(path, F.lit(r"\.([A-Za-z0-9]+)\z"), F.lit(1)), lambda s: F.concat(F.lit("ending="), s))
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1)))
    scheme = F.transform(F.regexp_extract_all(url, F.lit(r"\A([A-Za-z][A-Za-z0-9+.-]*)://"), F.lit(1)), lambda s: F.concat(F.lit("scheme="), F.lower(s)))
    fragment = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(scheme, suffixes, segments, ending, keys, fragment))


def mine_rules(labelled: DataFrame, url_col: str = "url", block_col: str = "blocked", support: float = 0.01, confidence: float = 0.6, least_rows: int = 20) -> DataFrame:
    """``(items, anchor, confidence, support)`` of the rules that call for blocking.

    An item is an array of tokens that exactly the same labelled URLs have; a rule matches a URL that has a token of
    each of its items. Support is the share of labelled URLs with the items and the label, of which there must be
    ``least_rows`` as well; null labels and URLs without tokens aren't used. A rule is dropped if one with fewer of its items is as
    confident. The anchor is the rule's rarest item. Tokens that pass the support are at most tokens a URL / ``support``: they are broadcast.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(block_col).isNotNull()).groupBy(F.col(url_col).alias("url"), F.col(block_col).cast("boolean").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    rows = staged(rows.withColumn("t", url_tokens(F.col("url"))).where(F.size("t") > 0), "labelled-urls")
    total = rows.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    least = max(least_rows, int(support * total))
    mark = [F.sum(F.xxhash64("url", "b", F.lit(seed)).cast("decimal(38,0)")).alias(f"mark{seed}") for seed in (1, 2)]
    tokens = rows.select("url", "b", "m", F.explode("t").alias("token")).groupBy("token").agg(F.sum("m").alias("freq"), F.sum(F.when(F.col("b"), F.col("m")).otherwise(0)).alias("joint"), *mark)
    # no rule has an item that is rarer with the label than a rule must be
    same = tokens.where(F.col("joint") >= least).groupBy("freq", "mark1", "mark2").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    same = staged(same.select(F.col("tokens")[0].alias("name"), "tokens", "freq"), "url-items")
    empty = spark.createDataFrame([], "items array<array<string>>, anchor array<string>, confidence double, support double")
    if same.isEmpty():
        return empty
    names = F.broadcast(same.select("name", F.explode("tokens").alias("token")))
    baskets = rows.select("url", "b", "m", F.explode("t").alias("token")).join(names, "token").groupBy("url", "b", "m").agg(F.collect_set("name").alias("items"))
    baskets = baskets.select(F.when(F.col("b"), F.concat("items", F.array(F.lit(_BLOCKED)))).otherwise(F.col("items")).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    # URLs that have none of the items count in the total too
    share = least / baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=share * (1 - 1e-9), minConfidence=confidence).fit(baskets.select("items"))
    mined = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BLOCKED))).select(F.array_sort("antecedent").alias("names"), "confidence", (F.col("support") * (least / share / total)).alias("support"))
    rarest = F.min(F.struct("freq", "name")).alias("r")
    ranked = mined.select("*", F.explode("names").alias("name")).join(F.broadcast(same), "name").groupBy("names", "confidence", "support").agg(rarest, F.collect_list("tokens").alias("items"))
    ranked = staged(ranked.select("names", "items", F.col("r.name").alias("anchor"), "confidence", "support"), "url-rules")
    # a smaller rule has its anchor among the larger rule's items
    small = ranked.select(F.col("names").alias("s"), F.col("anchor").alias("a"), F.col("confidence").alias("c"))
    wide = ranked.select("names", "confidence", F.explode("names").alias("a"))
    covers = (F.size("s") < F.size("names")) & (F.size(F.array_except("s", "names")) == 0) & (F.col("c") >= F.col("confidence"))
    redundant = wide.join(small, "a").where(covers).select("names").distinct()
    kept = ranked.join(redundant, "names", "left_anti").join(F.broadcast(same.select(F.col("name").alias("anchor"), "tokens")), "anchor")
    return kept.select("items", F.col("tokens").alias("anchor"), "confidence", "support")


def matched_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``(url, confidence)`` of the distinct URLs that match a rule, with the best rule's confidence."""
    tokens = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumn("t", url_tokens(F.col("url")))
    index = rules.select("items", "confidence", F.explode("anchor").alias("token"))
    found = tokens.select("url", "t", F.explode("t").alias("token")).join(index, "token").where(F.forall("items", lambda x: F.arrays_overlap(x, F.col("t"))))
    return found.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, confidence``: the explicit rule's verdict, else block if a mined rule matches, else allow.

    Null urls, and those without ``://``, have an empty host and path and get the mined verdict. Repeated rows
    are kept; columns named like new ones are replaced; without labels nothing is mined.
    """
    keep = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "confidence"}]
    host, path = url_parts(F.col(url_col))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    mined = staged(mine_rules(labelled, **options), "mined-rules")
    many = mined.select(F.explode("anchor")).count()
    rows = pages.select(F.struct(*keep).alias("row"), F.col(url_col).alias("own"), host.alias("host"), path.alias("path")).select("*", text.alias("rule"), verdict.alias("verdict"))
    if many:
        hit = matched_urls(pages, F.broadcast(mined) if many <= _BROADCAST_ROWS else mined, url_col)
        rows = rows.join(hit, F.col("own") == F.col("url"), "left")
    else:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    by_rules = F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return rows.withColumn("verdict", F.coalesce("verdict", by_rules)).select("row.*", "host", "path", "rule", "verdict", "confidence")
