"""Retrieval metrics, their summaries, comparisons of modes, and precision and recall against gold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.arrays import let

TOLERANCE = 1e-9
KS = (3, 5, 10)
MODES = ("vector", "graph", "hybrid")
# Which metrics are better when lower, which are shown, and which decide on the graph's use.
LOWER_IS_BETTER = ("noise_edge_rate@5", "noise_edge_rate@10", "judge_missing_evidence_rate", "judge_hallucination_rate", "missing_evidence_rate", "hallucination_rate")
DISPLAYED = ("page_recall@5", "citation_accuracy@5", "entity_recall@5", "triple_recall@5", "relation_precision@5", "noise_edge_rate@5", "judge_answer_supported_rate", "judge_citation_accuracy", "judge_missing_evidence_rate", "judge_hallucination_rate")
GAINS = ("judge_answer_supported_rate", "judge_citation_accuracy", "citation_accuracy@5", "triple_recall@5", "relation_precision@5")
RISKS = ("judge_hallucination_rate", "judge_missing_evidence_rate", "noise_edge_rate@5")
VERDICTS = {"better": "提升", "worse": "下降", "same": "持平", "unknown": "无法比较"}


def six(c: Column) -> Column:
    """To six places, a tie to the even neighbour."""
    return F.bround(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places, null where b is 0."""
    return six(F.try_divide(a.cast("double"), b.cast("double")))


def _long(rows: DataFrame, keys: list[str], values: dict[int, dict]) -> DataFrame:
    """(keys, k, metric, value) of columns of values by k and metric: one pass over ``rows``, whatever the number of ks."""
    cells = (F.struct(F.lit(k).cast("int").alias("k"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for k, of in values.items() for m, v in of.items())
    return rows.select(*keys, F.inline(F.array(*cells)))


def even_ideals(counts: DataFrame, ks=KS) -> DataFrame:
    """``counts`` (per, wanted) with the ideals of as many expected items of gain 1: what ``ranked_metrics`` takes as ``own``."""
    ideal = lambda k: reduce(lambda a, i: a + F.when(F.col("wanted") >= i, 1.0 / F.log2(F.lit(i + 1.0))).otherwise(0.0), range(1, k + 1), F.lit(0.0)).alias(f"ideal{k}")
    return counts.filter("wanted > 0").select("*", *(ideal(k) for k in ks))


def ranked_metrics(hits: DataFrame, gains: DataFrame, ks=KS, name: str = "page", per: tuple[str, ...] = ("qid",), own: DataFrame | None = None) -> DataFrame:
    """Long table (per, metric, k, value) of recall, hit, mrr and ndcg.

    ``hits`` (per, rank, item): a rank may have several items, of which the best counts in ndcg, so
    an item met at several ranks scores at each.  ``gains`` (per, item, gain, expected): what is
    relevant, and what is expected of it; metrics are null without anything expected or relevant.
    Only the best ``max(ks)`` gains of a question are kept as its ideal.  Where counts tell ``own`` (per,
    wanted, ideals), ``gains`` need hold no more than those of the hits.
    """
    per, most = list(per), max(ks)
    gains = gains if "expected" in gains.columns else gains.withColumn("expected", F.lit(True))
    if own is None:
        placed = gains.withColumn("__n", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("gain"), "item")))
        ideal = lambda k: F.sum(F.when(F.col("__n") <= k, F.col("gain") / F.log2(F.col("__n") + 1.0))).alias(f"ideal{k}")
        own = placed.groupBy(*per).agg(F.count_distinct(F.when(F.col("expected"), F.col("item"))).alias("wanted"), *(ideal(k) for k in ks))
    found = hits.filter(F.col("rank") <= most).join(gains, [*per, "item"])
    ranks = found.groupBy(*per, "rank").agg(F.max("gain").alias("gain"), F.max(F.col("expected").cast("int")).alias("hit"))
    dcg = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1.0))).alias(f"dcg{k}")
    first = lambda k: F.min(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col("rank"))).alias(f"first{k}")
    met = found.groupBy(*per, "item").agg(F.min(F.when(F.col("expected"), F.col("rank"))).alias("rank"))
    got = lambda k: F.count(F.when(F.col("rank") <= k, 1)).alias(f"got{k}")
    rows = own.join(ranks.groupBy(*per).agg(*(dcg(k) for k in ks), *(first(k) for k in ks)), per, "left").join(met.groupBy(*per).agg(*(got(k) for k in ks)), per, "left")
    values = {}
    for k in ks:
        c = lambda n, k=k: F.coalesce(F.col(f"{n}{k}"), F.lit(0))
        values[k] = ranked_values(name, c("got"), F.col(f"first{k}"), c("dcg"), F.col("wanted"), F.col(f"ideal{k}"))
    return _long(rows, per, values)


def edge_metrics(facts: DataFrame, expected: DataFrame, ks=KS, per: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Long table of triple_recall, relation_precision, noise_edge_rate and relation_evidence_coverage.

    ``facts`` (per, rank, source, type, target, evidence, page), ``expected`` (per, source, type,
    target).  Precision counts each retrieved edge, recall each expected triple once.
    """
    per = list(per)
    want = expected.distinct().withColumn("hit", F.lit(1))
    own = want.groupBy(*per).agg(F.count(F.lit(1)).alias("expected"))
    rows = facts.join(want, [*per, "source", "type", "target"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    covered = ((F.coalesce("evidence", F.lit("")) != "") & (F.coalesce("page", F.lit("")) != "")).cast("int")
    told = F.col("source").isNotNull() & F.col("type").isNotNull() & F.col("target").isNotNull()
    within = lambda k, c, rank="rank": F.when(F.col(rank) <= k, c)
    own_ = {"n": F.lit(1), "told": F.when(told, 1), "hits": F.when(F.col("hit") == 1, 1), "covered": F.when(covered == 1, 1)}
    # by triple first: a triple counts once from its first rank on
    triple = ("source", "type", "target")
    by_triple = rows.groupBy(*per, *triple).agg(*(F.count(within(k, c)).alias(f"{n}{k}") for k in ks for n, c in own_.items()), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    sums = [x for k in ks for x in (*(F.sum(f"{n}{k}").alias(f"{n}{k}") for n in own_), F.count(within(k, 1, "first")).alias(f"triples{k}"))]
    both = own.join(by_triple.groupBy(*per).agg(*sums), per, "full_outer")
    values = {k: edge_values(F.col("expected"), *(F.col(f"{n}{k}") for n in ("n", "told", "hits", "covered", "triples"))) for k in ks}
    return _long(both, per, values)


def firsts(hits: Column, items: str, wanted: Column) -> Column:
    """Of each wanted item that ``hits`` (rank and, as lists, ``items``) have, its first rank."""
    ranks = lambda w: F.transform(F.filter(hits, lambda h: F.array_contains(h[items], w)), lambda h: h["rank"])
    return F.array_compact(F.transform(wanted, lambda w: F.array_min(ranks(w))))


def gained(hits: Column, items: str, gains: Column) -> Column:
    """(rank, gain) of ranks whose ``items`` have a gain in the map ``gains``, the best where there are several."""
    best = F.transform(hits, lambda h: F.struct(h["rank"].alias("rank"), F.array_max(F.transform(h[items], lambda i: F.try_element_at(gains, i))).alias("gain")))
    found = F.sort_array(F.filter(best, lambda g: g["gain"].isNotNull()), asc=False)
    return let(found, lambda gs: F.filter(gs, lambda g, i: (i == 0) | (F.get(gs, i - 1)["rank"] != g["rank"])))


def within(ranks: Column, k: int) -> Column:
    return F.filter(ranks, lambda r: r <= k)


def _total(xs: Column, value) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.coalesce(value(x), F.lit(0.0)))


def discounted(gained_: Column, k: int) -> Column:
    """The gain of (rank, gain) up to ``k``, less by the rank's logarithm."""
    return _total(F.filter(gained_, lambda g: g["rank"] <= k), lambda g: g["gain"] / F.log2(g["rank"] + 1.0))


def ideal(gains: Column, k: int) -> Column:
    """The gain of the map's best ``k``, in their order."""
    best = F.slice(F.sort_array(F.map_values(gains), asc=False), 1, k)
    return _total(F.arrays_zip(best.alias("gain"), F.sequence(F.lit(1), F.lit(k)).alias("n")), lambda g: g["gain"] / F.log2(g["n"] + 1.0))


def ranked_values(name: str, got: Column, first: Column, dcg: Column, wanted: Column, ideal_: Column) -> dict[str, Column]:
    """recall, hit, mrr and ndcg of what was got of ``wanted`` items, the first rank that had one, and gains; null without any."""
    asked = wanted > 0
    return {
        f"{name}_recall": ratio(got, wanted),
        f"{name}_hit": F.when(asked, (ratio(got, wanted) > 0).cast("double")),
        f"mrr_{name}": F.when(asked, six(F.coalesce(1.0 / first, F.lit(0.0)))),
        f"ndcg_{name}": ratio(dcg, ideal_),
    }


def edge_values(expected: Column, n: Column, told: Column, hits: Column, covered: Column, triples: Column) -> dict[str, Column]:
    """triple_recall, relation_precision, noise_edge_rate and relation_evidence_coverage of counts; ``expected`` is null where there is none."""
    exact = F.when(expected.isNotNull(), F.coalesce(F.try_divide(hits.cast("double"), told.cast("double")), F.lit(0.0)))
    return {"triple_recall": ratio(F.when(expected.isNotNull(), F.coalesce(triples, F.lit(0))), expected), "relation_precision": six(exact), "noise_edge_rate": six(1 - exact), "relation_evidence_coverage": ratio(covered, n)}


def citation_values(cited: Column, expected: Column) -> dict[str, Column]:
    """citation_hit and citation_accuracy of the distinct pages cited: 0 where there are none, null where none is expected."""
    hits, asked = F.size(F.array_intersect(cited, expected)), F.size(expected) > 0
    return {"citation_hit": F.when(asked, (hits > 0).cast("double")), "citation_accuracy": F.when(asked, F.coalesce(ratio(hits, F.size(cited)), F.lit(0.0)))}


def keyword_rates(answer: Column, expected: Column, forbidden: Column) -> tuple[Column, Column, Column]:
    """(answer_supported_rate, missing_evidence_rate, hallucination_rate); null without keywords."""
    exact = lambda words: F.try_divide(F.size(F.filter(words, lambda w: (w != "") & answer.contains(w))).cast("double"), F.size(words).cast("double"))
    return six(exact(expected)), six(1 - exact(expected)), six(exact(forbidden))


def judged_rates(verdict: Column) -> dict[str, Column]:
    """The four rates of a judge's JSON verdict; null where there is none, 0 for a field it lacks."""
    v = F.try_parse_json(tx.extract_json(verdict))
    rate = lambda field: F.when(v.isNotNull() & (F.schema_of_variant(v) != "OBJECT<>"), F.coalesce(F.try_variant_get(v, f"$.{field}", "double"), F.lit(0.0)))
    return {"judge_answer_supported_rate": rate("answer_supported"), "judge_citation_accuracy": rate("citation_accurate"), "judge_missing_evidence_rate": rate("missing_evidence"), "judge_hallucination_rate": rate("hallucination")}


def metric_name() -> Column:
    """``name@k``, or the name alone."""
    return F.concat_ws("@", "metric", F.col("k").cast("string"))


def summary(metrics: DataFrame, *per: str) -> DataFrame:
    """(per, metric, k, mean, n) over the values that are not null."""
    return metrics.filter("value is not null").groupBy(*per, "metric", "k").agg(six(F.avg("value")).alias("mean"), F.count("value").alias("n"))


def compare(means: DataFrame) -> DataFrame:
    """Means (mode, metric, value) side by side, with hybrid's delta and verdict against each other mode; metrics as ``name@k``."""
    wide = means.groupBy("metric").pivot("mode", list(MODES)).agg(F.first("value"))
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    wide = wide.withColumn("direction", F.when(lower, "lower").otherwise("higher"))
    for other in ("vector", "graph"):
        delta = six(F.col("hybrid") - F.col(other))
        better = F.when(lower, -delta).otherwise(delta)
        verdict = F.when(delta.isNull(), VERDICTS["unknown"]).when(better > TOLERANCE, VERDICTS["better"]).when(better < -TOLERANCE, VERDICTS["worse"]).otherwise(VERDICTS["same"])
        wide = wide.withColumn(f"delta_{other}", delta).withColumn(f"versus_{other}", verdict)
    return wide


def displayed(compared: DataFrame, requested: str | None = None) -> DataFrame:
    """Rows of the metrics asked for (comma-separated; ``DISPLAYED`` by default), with their place; all of them by name if none of those is there."""
    wanted = [m.strip() for m in requested.split(",") if m.strip()] if requested else list(DISPLAYED)
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("metric"))
    any_ = F.max((place > 0).cast("int")).over(Window.partitionBy())
    rows = compared.withColumn("at", place).withColumn("any", any_).filter("any = 0 or at > 0")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("at", "metric"))).drop("at", "any")


def decide(means: DataFrame) -> DataFrame:
    """One row (positive, negative, risk_worse, decision) on whether hybrid helps against vector, by ``GAINS`` and ``RISKS``; means are (mode, metric, value)."""
    wide = means.groupBy("metric").pivot("mode", list(MODES)).agg(F.first("value"))
    delta = six(F.col("hybrid") - F.col("vector"))
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -delta).otherwise(delta)
    of = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0)).alias(name)
    gain, risk = F.col("metric").isin(*GAINS), F.col("metric").isin(*RISKS)
    sums = wide.agg(of(gain & (better > TOLERANCE), "positive"), of(gain & (better < -TOLERANCE), "negative"), of(risk & (better < -TOLERANCE), "risk_worse"), of(F.col("vector").isNotNull(), "v"), of(F.col("hybrid").isNotNull(), "h"))
    p, n, r = F.col("positive"), F.col("negative"), F.col("risk_worse")
    decision = F.when((F.col("v") == 0) | (F.col("h") == 0), "unknown").when((p > 0) & (r == 0) & (n == 0), "helpful").when((p > 0) & (r == 0), "mixed_helpful").when(r == 0, "neutral").otherwise("risky")
    return sums.withColumn("decision", decision).drop("v", "h")


def gold_scores(predicted: DataFrame, gold: DataFrame, *key: str) -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1 of two sets of keys; null where a denominator is 0."""
    p, g = predicted.select(*key).distinct().withColumn("p", F.lit(1)), gold.select(*key).distinct().withColumn("g", F.lit(1))
    flags = p.join(g, list(key), "full_outer")
    n = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(name)
    sums = flags.agg(n(F.col("p").isNotNull() & F.col("g").isNotNull(), "tp"), n(F.col("g").isNull(), "fp"), n(F.col("p").isNull(), "fn"))
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    precision, recall = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": six(precision), "recall": six(recall), "f1": six(F.try_divide(2 * precision * recall, precision + recall))})


def gold_examples(predicted: DataFrame, gold: DataFrame, key: str, most: int = 20) -> DataFrame:
    """(kind, place, item): the first ``most`` by name of what was predicted wrongly (fp) and of what was missed (fn)."""
    p, g = predicted.select(key).distinct(), gold.select(key).distinct()
    wrong = p.join(g, key, "left_anti").select(F.lit("fp").alias("kind"), F.col(key).cast("string").alias("item"))
    missed = g.join(p, key, "left_anti").select(F.lit("fn").alias("kind"), F.col(key).cast("string").alias("item"))
    return wrong.unionByName(missed).withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("item"))).filter(F.col("place") <= most)


def evidence_rates(edges: DataFrame) -> DataFrame:
    """One row (count, has_evidence_rate, evidence_support_rate) over edges (evidence, located): located is null where the text is not known."""
    has = (F.coalesce("evidence", F.lit("")) != "").cast("int")
    n = F.count(F.lit(1))
    return edges.agg(n.alias("count"), ratio(F.sum(has), n).alias("has_evidence_rate"), ratio(F.sum(F.col("located").cast("int")), F.count("located")).alias("evidence_support_rate"))


def alias_groups(names: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with more than one spelling."""
    return names.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names")).filter(F.size("names") > 1)


def reason_counts(gated: DataFrame) -> DataFrame:
    """(kind, reason, n) over the drops that chunks kept."""
    return gated.select(F.explode("dropped").alias("d")).groupBy("d.kind", "d.reason").agg(F.count(F.lit(1)).alias("n"))


def quality_totals(gated: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_nodes", "accepted_nodes", "input_relationships", "accepted_relationships", "dropped_count")]
    return gated.agg(F.count(F.lit(1)).alias("chunks"), *sums)
