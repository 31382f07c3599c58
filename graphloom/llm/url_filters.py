"""URL filters: host and path rules, and association rules that FP-growth mines for the rest.

Explicit rules judge the urls they fit; those verdicts are the labels.  FP-growth mines combinations
of url tokens that imply ``block`` over all urls, of which those without a label count against a
combination: its confidence is the share of all urls holding it that are labelled ``block``, so a
combination that only says where the explicit rules look is none.  Tokens that the very same urls
hold are mined as one.  Rules of enough support (rows and
share) and confidence stay unless a shorter one does as well.  A url that no explicit rule fits is
blocked if its tokens hold all those of a mined rule, found through an inverted index on each rule's
rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import scratch, stored, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT = 0.002  # share of urls that hold a rule's tokens and are blocked
LEAST_ROWS = 20  # and their number, at least
MIN_CONFIDENCE = 0.8
HELD = 200_000  # mined rules, or distinct token sets, that a broadcast may hold; beyond, a shuffle join
VERDICT = "verdict="


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    given = F.coalesce(at > 0, F.lit(False))
    return F.when(given, _lower(host)).otherwise(""), F.when(given, path).otherwise("")


def judge(host: Column, path: Column, rules) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, else null; hosts are looked up suffix by suffix."""
    by_host: dict[str, list] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")))
    known = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda r: r.isNotNull())), lambda r: path.startswith(r["path"]))
    return F.array_max(fits)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All tokens of a url, which FP-growth combines: whole labels and segments wherever they stand, and their hyphenated parts."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda k: F.regexp_extract(k, r"^[^=]*", 0)))), "+")
    shape = lambda s: F.regexp_replace(s, "[0-9]+", "#")
    given = lambda tag, c: F.when(F.length(c) > 0, F.concat(F.lit(tag), c))
    each = lambda tag, cs: F.transform(cs, lambda c: given(tag, c))
    names = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    segments = F.transform(parts, shape)
    hyphened = lambda cs: F.flatten(F.transform(F.filter(cs, lambda c: c.contains("-")), lambda c: F.split(c, "-")))
    some = F.array(
        given("scheme:", F.regexp_extract(url, r"^([^:/?#]*)://", 1)),
        given("tld:", F.element_at(labels, -1)),
        given("domain:", F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))),
        given("first:", F.when(F.size(parts) >= 1, F.element_at(segments, 1))),
        given("last:", F.when(F.size(parts) >= 2, F.element_at(segments, -1))),
        given("query:", keys),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    # one tag for a whole name and a hyphenated part, so that equal names are equal items
    every = F.concat(some, each("label:", names), each("label:", hyphened(names)), each("segment:", segments), each("segment:", hyphened(segments)))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def classes(urls: DataFrame, least: float) -> DataFrame:
    """(item, rep, freq): items that at least ``least`` blocked urls hold; those that the very same urls hold are one class.

    Items of a site's template always come together, and n of them make 2 to the n itemsets.  A class
    is mined as its least item.  What urls hold an item is told by two sums of 64-bit hashes of their
    token sets, on which membership depends alone.
    """
    digest = lambda seed: F.xxhash64(F.lit(seed), "tokens").cast("decimal(38,0)")
    held = urls.select(F.explode("tokens").alias("item"), (F.coalesce("verdict", F.lit("")) == "block").cast("int").alias("b"), digest(1).alias("h1"), digest(2).alias("h2"))
    often = held.groupBy("item").agg(F.count(F.lit(1)).alias("freq"), F.sum("b").alias("blocked"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).filter(F.col("blocked") >= least)
    members = often.groupBy("freq", "blocked", "h1", "h2").agg(F.min("item").alias("rep"), F.collect_list("item").alias("items"))
    return stored(members.select(F.explode("items").alias("item"), "rep", "freq"), "url-classes")


def mine(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (items, key, confidence) that imply block, from rows (tokens, verdict or null), and the classes that their items are.

    ``key`` is the rarest item.
    """
    n = urls.count()
    least = max(LEAST_ROWS, -(-MIN_SUPPORT * n // 1))
    # no rule of enough support holds an item that is blocked less often
    alike = classes(urls, least)
    none = urls.sparkSession.createDataFrame([], "items array<string>, confidence double, key string")
    if least > n or alike.isEmpty():
        return none, alike
    often = alike.select(F.col("rep").alias("item"), "freq").distinct()
    known = often.agg(F.collect_set("item").alias("known"))  # at most 1 / MIN_SUPPORT times the items of a url
    marked = F.when(F.col("verdict") == "block", F.array(F.lit(VERDICT + "block"))).otherwise(F.array().cast("array<string>"))
    items = urls.join(F.broadcast(known), F.lit(True)).select(F.concat(F.array_intersect("tokens", "known"), marked).alias("items")).filter(F.size("items") > 0)
    partitions = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.count()
    model = FPGrowth(minSupport=min(1.0, (least - 0.5) / max(rows, 1)), minConfidence=MIN_CONFIDENCE, numPartitions=partitions).fit(items)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.element_at("consequent", 1) == VERDICT + "block") & (F.col("lift") > 1))
    found = stored(found.select(F.array_sort("antecedent").alias("items"), "confidence"), "url-rules")
    # a rule falls if dropping one of its items leaves a rule that is as sure
    shorter = found.select("items", "confidence", F.explode("items").alias("item")).select("items", "confidence", F.array_remove("items", F.col("item")).alias("part"))
    beaten = shorter.join(found.select(F.col("items").alias("part"), F.col("confidence").alias("as_sure")), "part").filter("as_sure >= confidence").select("items").distinct()
    kept = found.join(beaten, "items", "left_anti")
    keyed = kept.select("items", "confidence", F.explode("items").alias("item")).join(often, "item")
    return stored(keyed.groupBy("items", "confidence").agg(F.min(F.struct("freq", "item"))["item"].alias("key")), "url-kept"), alike


def matched(sets: DataFrame, rules: DataFrame, alike: DataFrame) -> DataFrame:
    """The distinct token sets (tokens) that hold an item of each class of a rule."""
    if rules.isEmpty():
        return sets.select("tokens").limit(0)
    held = F.broadcast(rules) if rules.count() <= HELD else rules
    links = alike.select(F.col("item").alias("token"), "rep")
    links = F.broadcast(links) if links.count() <= HELD else links
    reps = sets.select("tokens", F.explode("tokens").alias("token")).join(links, "token").groupBy("tokens").agg(F.collect_set("rep").alias("reps"))
    near = reps.select("tokens", "reps", F.explode("reps").alias("key")).join(held, "key")
    return near.filter(F.forall("items", lambda i: F.array_contains("reps", i))).select("tokens").distinct()


def _judged(pages: DataFrame, rules) -> DataFrame:
    """(page_id, host, path, rule, verdict, tokens), stored; rule and verdict null where no explicit rule fits."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    judged = judged.withColumn("own", judge(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))
    return stored(judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("verdict"), "tokens"), "url-judged")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url, any others): page_id, host, path, rule, verdict; stored.

    Null urls and those without ``://`` have empty host and path, fit no rule and are allowed unless
    mined rules say otherwise.  Urls of any length are read whole.  Of rules of equal length the one
    later by code point counts (one host has no two such rules that fit).  Repeated rows are judged
    each and count each in mining.  If no rule fits any url nothing is mined and the rest is allowed.
    An empty table gives an empty result.
    """
    with scratch() as keep:
        judged = _judged(pages, rules)
        blocked = stored(matched(judged.filter("verdict is null").select("tokens").distinct(), *mine(judged)), "url-blocked").withColumn("mined", F.lit("block"))
        blocked = F.broadcast(blocked) if blocked.count() <= HELD else blocked
        return keep(stored(judged.join(blocked, "tokens", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict")), "urls"))


def precision(pages: DataFrame, rules=RULES) -> tuple[int, int]:
    """(rows, of them blocked by their explicit rule): labelled urls that mined rules match though their labels, a fifth by a hash of the url's tokens, were not mined."""
    with scratch():
        judged = _judged(pages, rules)
        aside = F.pmod(F.xxhash64("tokens"), F.lit(5)) == 0
        hits = matched(judged.filter(aside & F.col("verdict").isNotNull()).select("tokens").distinct(), *mine(judged.filter(~aside)))
        right = judged.filter(aside & F.col("verdict").isNotNull()).join(hits, "tokens", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("verdict") == "block").cast("int")), F.lit(0))).first()
        return int(right[0]), int(right[1])


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
