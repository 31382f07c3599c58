"""Mixing sources to target weights: Efraimidis-Spirakis sampling, in DataFrame operations alone.

A source's words are shared out by weight, with a ceiling of ``MOST`` times its own size.  Whole
epochs of the source come first; the fraction that remains takes documents in the order of
exponential keys, -ln(u) / quality, until the word budget is met.  Keys fall into slices, as many as
the square root of the source's documents, so sums over slices find the one in which the budget ends,
and that one alone is sorted and summed row by row: no task reads more than about that square root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import scratch, stored, table

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # epochs of a source at most
SEED = 17


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " +"), lambda w: w != "")).cast("long")


def quality(n_chars: Column, size: Column) -> Column:
    """A document's weight: ordinary mean word lengths count fully, odd ones and tiny texts less."""
    mean = n_chars / F.greatest(size, F.lit(1))
    return F.when((mean >= 3) & (mean <= 12), 1.0).otherwise(0.5) * F.when(size >= 20, 1.0).otherwise(0.5)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source (source, source_size, any others): its target, by water-filling under the ceilings.

    Sources fill up in the order of ceiling over weight; the level at which the rest stay below
    their ceilings comes from running sums.  One row per source is all that this sorts.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn("ceiling", F.col("source_size") * F.lit(float(MOST)))
    level = level.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
    level = level.withColumn("weight_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = level.withColumn("share", F.col("left") / F.col("weight_left")).withColumn("full", F.col("ceiling") / F.col("w") <= F.col("share"))
    # those not full share what the full ones leave: the first of them in filling order has that level
    level = level.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("ceiling") / F.col("w"), F.col("share")))).over(everything)["share"])
    return level.select(*sizes.columns, F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("w") * F.col("level")).alias("target"))


def _uniform(row_id: Column) -> Column:
    """In (0, 1), from the first 52 bits of a digest."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), row_id)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_plan(rows: DataFrame) -> DataFrame:
    """``rows`` (row_id, source, size, q, any others) with source_size, target and copies, a whole number up to ``MOST``.

    Rows of one row_id share a key and their fate.
    """
    same = lambda a, b: a.join(b.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")), "left").drop("its")
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))), "mix-targets")
    epochs = F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.coalesce(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))).withColumn("slices", F.ceil(F.sqrt("n")))
    # the survival of a key at weight 1 is uniform; weights only bend the slices' sizes
    keyed = same(rows, targets).withColumn("key", -F.log(_uniform(F.col("row_id"))) / F.col("q"))
    keyed = keyed.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("slices")), F.col("slices") - 1).cast("long"))
    sliced = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"), F.first("budget").alias("budget"))
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = sliced.withColumn("slice_before", F.coalesce(F.sum("slice_size").over(run), F.lit(0)))
    ends = sliced.filter((F.col("slice_before") < F.col("budget")) & (F.col("slice_before") + F.col("slice_size") >= F.col("budget")))
    ends = stored(ends.select("source", F.col("slice").alias("end"), "slice_before"), "mix-ends")
    # a source without an end takes no fraction
    rest = same(keyed, ends)
    edge = rest.filter(F.col("slice") == F.col("end"))
    own = Window.partitionBy("source", "slice")
    upto = F.sum("size").over(own.orderBy("key", "row_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("before", F.col("slice_before") + upto - F.sum("size").over(Window.partitionBy("source", "slice", "key", "row_id")))
    edge = edge.withColumn("more", (F.col("before") + F.col("size") / 2 <= F.col("budget")).cast("int")).drop("before")
    others = rest.filter(F.col("end").isNull() | (F.col("slice") != F.col("end"))).withColumn("more", F.coalesce(F.col("slice") < F.col("end"), F.lit(False)).cast("int"))
    both = others.unionByName(edge)
    return both.withColumn("copies", F.least(F.col("epochs") + F.col("more"), F.lit(MOST))).drop("key", "slice", "slices", "slice_before", "budget", "epochs", "end", "more", "n")


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells a document's draw from others': its id and a digest of its text."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def measured(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, source, size, q): what the plan needs of each document; no text moves."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), row_id().alias("row_id"))
    return sized.select("row_id", "doc_id", "source", "size", quality(F.col("chars"), F.col("size")).alias("q"))


def mix(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text, any others): doc_id, size, source_size, target, taken; stored.

    Null texts have size 0 and take 0.  Texts of any length count whole and are taken whole.  Rows
    without source are one source, last in order.  Rows alike in doc_id and text share a key and are
    taken equally often.  Sources of size 0 have target 0.  An empty table gives an empty result.
    """
    with scratch() as keep:
        plan = mix_plan(stored(measured(docs), "mix-rows"))
        return keep(stored(plan.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken")), "mixed"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
