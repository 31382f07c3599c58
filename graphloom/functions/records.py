"""Evaluation records whose fields may have several JSON shapes: pages, chunk references, triples, relevance.

A field comes as JSON text; each function says which shapes it takes.  All of it is variant
expressions, so records of any shape pass through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.arrays import let

_TEXTS = "array<string>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, shape: str) -> Column:
    return F.schema_of_variant(v).startswith(shape)


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def elements(json: Column) -> Column:
    """array<variant>: a list's items, or the value alone; empty for null and JSON null."""
    return let(F.try_parse_json(json), lambda v: F.when(v.isNull() | F.is_variant_null(v), _none("array<variant>")).when(_is(v, "ARRAY"), _get(v, "$", "array<variant>")).otherwise(F.array(v)))


def texts(json: Column) -> Column:
    """A list of texts or numbers as texts; empty ones go."""
    return F.filter(F.transform(elements(json), lambda v: _get(v, "$", "string")), lambda t: F.coalesce(t, F.lit("")) != "")


def pages(json: Column) -> Column:
    """Page numbers or lists like ``3-5, 9``, alone or in a list, as distinct page names."""
    return F.array_distinct(F.flatten(F.transform(elements(json), lambda v: tx.expand_pages(_get(v, "$", "string")))))


def chunk_refs(json: Column) -> Column:
    """A reference, or a list of references or of objects with source_ref, id or chunk_id, as distinct texts."""

    def ref(v):
        field = lambda name: _given(_get(v, f"$.{name}", "string"))
        return F.when(_is(v, "OBJECT"), F.coalesce(field("source_ref"), field("id"), field("chunk_id"))).otherwise(_given(_get(v, "$", "string")))

    return F.array_distinct(F.transform(F.filter(F.transform(elements(json), ref), lambda r: r.isNotNull()), lambda r: tx._strip(r, r"\s")))


def _parts(v: Column, text: Column | None) -> Column:
    """(source, type, target) of an object, a list of three or more, or, where ``text`` says how, a text; null if one is missing."""
    struct = lambda s, t, o: F.struct(_given(s).alias("source"), _given(t).alias("type"), _given(o).alias("target"))
    field = lambda name: _get(v, f"$.{name}", "string")
    at = lambda i: _get(v, f"$[{i}]", "string")
    found = F.when(_is(v, "OBJECT"), struct(field("source"), F.coalesce(_given(field("type")), field("relation")), field("target"))).when(_is(v, "ARRAY"), struct(at(0), at(1), at(2)))
    if text is not None:
        part = lambda i: F.regexp_extract(text, tx.TRIPLE, i)
        found = found.when(text.rlike(tx.TRIPLE), struct(part(1), part(2), part(3)))
    return let(found, lambda p: F.when(p["source"].isNotNull() & p["type"].isNotNull() & p["target"].isNotNull(), p))


def triples(json: Column) -> Column:
    """Triples as objects, lists or texts with two arrows, as distinct structs of evaluation keys."""

    def one(v):
        keyed = lambda p: F.when(p.isNotNull(), F.struct(tx.eval_key(p["source"]).alias("source"), F.upper(tx._strip(p["type"], r"\s")).alias("type"), tx.eval_key(p["target"]).alias("target")))
        return let(_parts(v, F.when(_is(v, "STRING"), _get(v, "$", "string"))), keyed)

    return F.array_distinct(F.filter(F.transform(elements(json), one), lambda t: t.isNotNull()))


def gold_parts(json: Column) -> Column:
    """Gold triples as objects or lists, as (source, type, target) texts; ``gold_triple`` makes their keys."""
    return F.filter(F.transform(elements(json), lambda v: _parts(v, None)), lambda t: t.isNotNull())


def gold_triple(source: Column, kind: Column, target: Column) -> Column:
    """A gold triple by canonical keys; the type in capitals with ``_`` for what is no letter or digit."""
    return F.struct(tx.canonical_key(source).alias("source"), tx._type_form(F.coalesce(kind, F.lit(""))).alias("type"), tx.canonical_key(target).alias("target"))


def entity_names(json: Column) -> Column:
    """Entities as texts or objects with a name."""
    return F.filter(F.transform(elements(json), lambda v: F.when(_is(v, "OBJECT"), _get(v, "$.name", "string")).otherwise(_get(v, "$", "string"))), lambda t: F.coalesce(t, F.lit("")) != "")


def relevance(json: Column, expected: Column) -> Column:
    """map<string,double> of relevance: an object of numbers, or a list of texts or of objects (id, page or source_ref; relevance or score, else 1).

    Expected values that it does not name count 1; of repeated names the last counts.
    """

    def entry(v):
        field = lambda name, kind: _get(v, f"$.{name}", kind)
        named = F.coalesce(_given(field("id", "string")), _given(field("page", "string")), field("source_ref", "string"))
        weighed = F.struct(named.alias("key"), F.coalesce(field("relevance", "double"), field("score", "double"), F.lit(1.0)).alias("value"))
        return F.when(_is(v, "OBJECT"), weighed).otherwise(F.struct(_get(v, "$", "string").alias("key"), F.lit(1.0).alias("value")))

    pairs = "array<struct<key:string,value:double>>"
    listed = F.filter(F.transform(elements(json), entry), lambda e: e["key"].isNotNull())
    mapped = let(F.try_parse_json(json), lambda v: F.when(F.coalesce(_is(v, "OBJECT"), F.lit(False)), F.map_entries(_get(v, "$", "map<string,double>")).cast(pairs)))
    given = F.coalesce(mapped, listed.cast(pairs))

    def merged(g):
        names = F.transform(g, lambda e: e["key"])
        last = F.filter(g, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["key"]))
        rest = F.transform(F.filter(expected, lambda x: ~F.array_contains(names, x)), lambda x: F.struct(x.alias("key"), F.lit(1.0).alias("value")))
        return F.map_from_entries(F.concat(last, F.array_distinct(rest)))

    return let(given, merged)


def int_list(value: str) -> list[int]:
    """``3, 5,10`` -> [3, 5, 10]; numbers below 1 go."""
    return [int(p) for p in value.split(",") if p.strip() and int(p) > 0]


# --- what is retrieved


def item_pages(page: Column, start: Column, end: Column) -> Column:
    """Pages of a hit: those its label names, else its range, else none."""
    ranged = F.when(start.isNotNull() & (start <= F.coalesce(end, start)), F.transform(F.sequence(start, F.coalesce(end, start)), lambda p: p.cast("string"))).otherwise(_none(_TEXTS))
    return let(tx.expand_pages(page), lambda named: F.when(F.size(named) > 0, named).otherwise(ranged))


def item_refs(source_ref: Column, id_: Column, source: Column, index: Column) -> Column:
    """What a chunk may be called: its source_ref, its id, and source::index."""
    both = F.when((F.coalesce(source, F.lit("")) != "") & (F.coalesce(index, F.lit(0)) != 0), F.concat_ws("::", source, index.cast("string")))
    return F.array_distinct(F.array_compact(F.array(_given(source_ref), _given(id_), both)))


def edge_triple(source: Column, kind: Column, target: Column) -> Column:
    whole = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "")
    return F.when(whole, F.struct(tx.eval_key(source).alias("source"), F.upper(tx._strip(kind, r"\s")).alias("type"), tx.eval_key(target).alias("target")))


def edge_entities(source: Column, target: Column) -> Column:
    """Both ends by key, without empty ones."""
    return F.array_except(F.array(tx.eval_key(source), tx.eval_key(target)), F.array(F.lit("")))
