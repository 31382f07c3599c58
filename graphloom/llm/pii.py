"""PII: base patterns, and information-theoretic sanitisation of the terms around them; DataFrame operations alone.

Every value that a base pattern finds is a protected entity.  All words of a text outside its base
spans are context terms of the entities that the text holds.  With n(t, e) texts that hold term t
and entity e, n(e) and n(t) texts that hold each and D texts, P(e | t) is taken as the lower
confidence bound (Wilson) of n(t, e) / n(t).  A term discloses an entity if it leaves little to
guess, and if the two do not meet by chance:

    -log2 P(e | t)                         at most LEFT_BITS
    n(t, e) * log2(P(e | t) * D / n(e))    at least CHANCE_BITS

The first does not depend on the size of the corpus; the second is the evidence that all joint texts
give together against independence, which only falls where an entity is everywhere.  A single joint
text is none.  Disclosing terms become spans of kind ``term`` wherever they stand, in any text:
generalised when text is written out.  All counts are of distinct texts, so copied documents make no
evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import scratch, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
TAGS = {k: f"<{k.upper()}>" for k in KINDS}
Z = 1.96  # of the confidence bound
LEFT_BITS = 1.6  # to guess an entity by a term: one of three
CHANCE_BITS = 12  # of evidence that they belong together
LEAST_JOINT = 2  # texts that hold both
HELD_TERMS = 200_000  # terms, or copied texts, that a broadcast may hold; beyond, a shuffle join

# The base patterns.  Possessive quantifiers and the looks behind change no match: they keep long
# runs from being scanned from every position, and loops off the stack.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][ -]?){11}[0-9]"),
    "phone": lambda t: t.contains("+"),
}
_SPAN = "struct<start:int,kind:int,end:int,value:string>"  # in sorting order
RUN = 64  # numbers that are summed one by one; runs are then shifted as wholes
WORDS = 1024  # pieces of a text that are placed one by one


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    return F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))) % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.substring(p, -3, 3), F.lit("999")), F.lit(0)) <= 255)),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def running(sizes: Column) -> Column:
    """Running sums of an array of int.

    An array that grows by one at each step is copied at each step, so only runs of ``RUN`` grow that
    way, and then the runs' totals: the work stays in proportion to the array.
    """
    none = F.array().cast("array<int>")

    def summed(xs):
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))["out"]

    def whole(xs):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: summed(F.slice(xs, i * RUN + 1, F.lit(RUN))))
        totals = summed(F.transform(runs, lambda r: F.element_at(r, -1)))
        return F.flatten(F.zip_with(runs, totals, lambda r, t: F.transform(r, lambda x: x + t - F.element_at(r, -1))))

    return F.when(F.size(sizes) == 0, none).otherwise(F.transform(F.array(sizes), whole)[0])


def _located(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the matches: the pieces between them give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the piece after the last match has no match beside it
    pieces = F.filter(F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())

    def placed(ps):
        ends = running(F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["value"])))
        return F.zip_with(ps, ends, lambda p, e: F.struct((e - F.length(p["value"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), p["value"].alias("value")))

    return F.transform(F.array(pieces), placed)[0]


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    of = lambda i, k: F.when(HINTS[k](text), F.filter(_located(text, PATTERNS[k], i), lambda s: CHECKS[k](s["value"]))).otherwise(none)
    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS[:4]))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])))


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in the place of its spans."""
    return F.when(F.size(spans) == 0, text).otherwise(_replaced(text, spans, lambda s, n: F.repeat(F.lit(" "), n)))


def _terms(text: Column, spans: Column) -> Column:
    """The distinct words of letters outside the spans, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(masked(text, spans), F.lit(r"\p{L}+"), F.lit(0)), F.lower))


def _places(text: Column, spans: Column, terms: Column) -> Column:
    """Spans of all words outside ``spans`` that are among ``terms``; a text's pieces are walked in runs, so that no list grows long."""
    none = F.array().cast(f"array<{_SPAN}>")

    def walked(run, at):
        def step(acc, w):
            e = acc["at"] + F.length(w)
            more = F.array(F.struct(acc["at"].alias("start"), F.lit(4).alias("kind"), e.alias("end"), F.lower(w).alias("value")))
            # a word that is no term leaves the list as it is, uncopied
            return F.struct(e.alias("at"), F.when(F.array_contains(terms, F.lower(w)), F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def placed(parts):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / WORDS).cast("int")), lambda i: F.slice(parts, i * WORDS + 1, F.lit(WORDS)))
        sizes = F.transform(runs, lambda r: F.length(F.array_join(r, "")))
        starts = F.zip_with(running(sizes), sizes, lambda e, n: e - n)
        return F.flatten(F.zip_with(runs, starts, walked))

    pieces = F.regexp_extract_all(masked(text, spans), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(none))[0]


def found_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (text, any others) with row_id, ``h`` of the text and ``spans``, stored; null text is empty."""
    spans = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("spans", base_spans(F.col("text")))
    return stored(spans.withColumn("h", F.xxhash64("text")).withColumn("row_id", F.monotonically_increasing_id()), "pii-found")


def _bounded(df: DataFrame, size: Column | None = None) -> DataFrame:
    n = df.count() if size is None else df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= HELD_TERMS else df


def disclosing_terms(found: DataFrame) -> DataFrame:
    """(term) of the terms to sanitise; counts are over all distinct texts of ``found``."""
    texts = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("copies")), "pii-texts")
    total = float(texts.count())
    held = found.filter(F.size("spans") > 0)
    members = stored(held.select("h", F.explode("spans.value").alias("entity")).distinct(), "pii-members")
    # entities of the same texts have the same counts with every term: one of them stands for all
    alike = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.expr("bit_xor(h)").alias("x"), F.expr("bit_xor(xxhash64(h, 1))").alias("y"))
    alike = stored(members.join(alike.filter(F.col("n_e") >= LEAST_JOINT), "entity").select("n_e", "x", "y", "h").distinct(), "pii-alike")
    largest = alike.agg(F.max("n_e")).first()[0]
    if largest is None:
        return found.sparkSession.createDataFrame([], "term string")
    # P(e | t) is at most n(e) / n(t), so a term in more texts than this discloses nothing
    most = lambda n: n * 2**LEFT_BITS * (1 + 1e-9)
    copied = texts.filter("copies > 1").select("h", F.col("h").alias("copy"))
    words = found.join(_bounded(copied), "h", "left").select("copy", F.explode(_terms(F.col("text"), F.col("spans"))).alias("term"))
    n_t = words.groupBy("term", "copy").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("n_t"))
    near = held.select("h", F.explode(_terms(F.col("text"), F.col("spans"))).alias("term")).distinct()
    near = near.join(n_t.filter(F.col("n_t").between(LEAST_JOINT, most(F.lit(float(largest))))), "term")
    pairs = near.join(alike, "h").filter(F.col("n_t") <= most(F.col("n_e"))).groupBy("n_e", "x", "y", "term", "n_t").agg(F.count(F.lit(1)).alias("n_te"))
    sure = surely("n_te", "n_t")
    chance = F.col("n_te") * F.log2(sure * F.lit(total) / F.col("n_e"))
    return pairs.filter((F.col("n_te") >= LEAST_JOINT) & (-F.log2(sure) <= LEFT_BITS) & (chance >= CHANCE_BITS)).select("term").distinct()


def surely(k: str, n: str) -> Column:
    """Lower confidence bound of the share k of n."""
    k, n, z2 = F.col(k).cast("double"), F.col(n).cast("double"), Z * Z
    return (k + z2 / 2 - Z * F.sqrt(k * (n - k) / n + z2 / 4)) / (n + z2)


def all_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with row_id, the base ``spans`` and ``every``: those and the term spans."""
    found = found_spans(docs)
    chosen = stored(disclosing_terms(found), "pii-chosen")
    words = found.select("row_id", F.explode(_terms(F.col("text"), F.col("spans"))).alias("term"))
    marks = stored(words.join(_bounded(chosen), "term").groupBy("row_id").agg(F.collect_list("term").alias("terms")), "pii-marks")
    every = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", _places(F.col("text"), F.col("spans"), F.col("terms")))))
    return found.join(_bounded(marks, F.size("terms")), "row_id", "left").withColumn("every", every).drop("terms", "h")


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): counts and places of its personal data; stored.

    Null text counts as empty: no spans, the hash of the empty string.  Texts of any length are
    searched whole, in time that grows with their length and matches.  Repeated rows are searched
    each and are one piece of evidence.  Spans that start together are in the order of kinds.  An
    empty table gives an empty result.
    """
    with scratch() as keep:
        rows = all_spans(docs.select("doc_id", "text"))
        count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
        return keep(stored(rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans")), "pii"))


def apart(spans: Column) -> Column:
    """Spans (sorted by start) without those that begin before an earlier one ends."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))
    near = F.exists(F.zip_with(spans, F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False))), lambda x: x)
    return F.when(near, F.aggregate(spans, start, step)["out"]).otherwise(spans)


def _replaced(text: Column, spans: Column, tag) -> Column:
    """The text with ``tag(span, length)`` in the place of each span; of overlapping spans the first stands, and all they cover goes.

    Pieces are cut from UTF-32, where a place is found without reading what is before it.
    """
    none = F.lit(None).cast(_SPAN)

    def written(x):
        kept, wide, all_ = x["kept"], x["wide"], x["all"]
        cut = lambda a, n: F.decode(F.substring(wide, a * 4 + 1, n * 4), "UTF-32")
        size = F.floor(F.octet_length(wide) / 4).cast("int")
        # a span covers what those up to the next kept one cover
        reach = lambda s, after: F.when(F.size(kept) == F.size(all_), s["end"]).otherwise(F.array_max(F.transform(F.filter(all_, lambda o: (o["start"] >= s["start"]) & (after.isNull() | (o["start"] < after))), lambda o: o["end"])))
        ends = F.zip_with(kept, F.concat(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.array(none)), lambda s, t: F.struct(s.alias("s"), reach(s, t["start"]).alias("end"), F.coalesce(t["start"], size).alias("next")))
        pieces = F.transform(ends, lambda e: F.concat(tag(e["s"], e["end"] - e["s"]["start"]), cut(e["end"], e["next"] - e["end"])))
        return F.concat(cut(F.lit(0), kept[0]["start"]), F.array_join(pieces, ""))

    whole = F.struct(apart(spans).alias("kept"), F.encode(text, "UTF-32").alias("wide"), spans.alias("all"))
    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(whole), written)[0])


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind."""
    tag = F.array(*(F.lit(TAGS[k]) for k in KINDS))
    return _replaced(text, spans, lambda s, n: F.element_at(tag, s["kind"] + 1))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` (text, any others) with the personal data in its texts generalised; null texts stay null."""
    keep = docs.columns
    rows = all_spans(docs.withColumn("no_text", F.col("text").isNull()))
    return rows.withColumn("text", F.when(~F.col("no_text"), redacted(F.col("text"), F.col("every")))).select(*keep)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
