"""Text as columns: keys, names, evidence, pages and references.

Python's blanks are Unicode blanks, so the patterns say (?U).  Spark has no NFKC: texts of characters
that it leaves alone, or that it only makes narrow, are done in the JVM, and one Arrow UDF applies it
to the others, to which those go as nulls.  Functions on raw text (``clean_name``, ``match_key``
and so on) normalise first; those with a leading underscore expect text in that form, and are what
lambdas use, where no UDF may stand.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.arrays import Cutter, let, running
from graphloom.functions.vocabulary import GENERIC_NAMES, LABEL_ALIASES, LABELS, TYPE_ALIASES, TYPES, lookup

# What keys drop, what names lose at their edges, sentence ends, page markers, lengths
# and the likeness that count as the same evidence.
BLANK = r"(?U)\s"
NAME_EDGE = r"\s:：,，.;；\-—_()（）\[\]【】\"'“”"
KEY_DROPS = r"[\s\-_./\\:：,，.;；()（）\[\]【】{}<>《》\"'“”‘’]+"
KEY_DROPPED = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000-_./\\:：,，;；()（）[]【】{}<>《》\"'“”‘’"  # the characters of KEY_DROPS
SENTENCE_END = r"[\n。！？!?；;]"
PAGE_MARKER = r"(?m)^\s*(?:===== PAGE|\[Page)\s+(\d+)\s*(?:=====\s*|\]\s*)?$"
MOST_NAME, MOST_EVIDENCE, MOST_DESCRIPTION = 60, 180, 240
ALIKE = 0.84


# Characters that NFKC leaves alone whatever stands beside them, and wide ones that it makes ASCII.
KEPT = r"\x00-\x7F\u2018-\u201D\u3001\u3002\u300A-\u3011\u4E00-\u9FFF"
WIDE, NARROW = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x20, 0x7F)))
PLAIN = rf"^[\x00-\x7F]*+[{KEPT}\u3000\uFF01-\uFF5E]*+\z"
WORD = r"^[A-Za-z0-9]+\z"  # a single word has nothing to clean


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _nfkc_nested(lists: pd.Series) -> pd.Series:
    each = lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts]
    return lists.map(lambda ls: None if ls is None else [each(ts) for ts in ls])


def _ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _is_plain(c: Column) -> Column:
    return _ascii(c) | c.rlike(PLAIN)


def _narrow(c: Column) -> Column:
    """NFKC of a text that is ``PLAIN``."""
    return F.when(~_ascii(c) & c.rlike(r"[\u3000\uFF01-\uFF5E]"), F.translate(c, WIDE, NARROW)).otherwise(c)


def nfkc(c: Column) -> Column:
    """NFKC of a text; null stays null."""
    return F.coalesce(_nfkc(F.when(~_is_plain(c), c)), _narrow(c))


def nfkc_each(c: Column) -> Column:
    """NFKC of each text of an array."""
    return F.coalesce(_nfkc_each(F.when(F.exists(c, lambda t: ~_is_plain(t)), c)), F.transform(c, _narrow))


def nfkc_nested(c: Column) -> Column:
    """NFKC of each text of an array of arrays."""
    return F.coalesce(_nfkc_nested(F.when(F.exists(c, lambda ts: F.exists(ts, lambda t: ~_is_plain(t))), c)), F.transform(c, lambda ts: F.transform(ts, _narrow)))


def is_alike(key: str, segments: list[str]) -> bool:
    """Whether a segment is as good as the evidence (Ratcliff-Obershelp ratio), which levenshtein cannot tell."""
    for s in segments:
        m = SequenceMatcher(None, key, s)
        if m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE:
            return True
    return False


def _pairs(c: Column) -> Column:
    """The places of a text's character pairs, as those pairs; of a text of one character none."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))


def may_be_alike(key: Column, segment: Column) -> Column:
    """What a ratio of ``ALIKE`` implies, in the JVM: false only where it cannot be reached.

    With m matched characters of two texts of lengths a and b the ratio is 2m / (a + b), and m is at
    most the shorter length.  The matches are at most a + b - 2m + 1 blocks, and the pairs inside
    blocks, m less their number, are pairs of both texts: at least 3m - (a + b) - 1 places of the key.
    """
    both = F.length(key) + F.length(segment)
    long_enough = 2 * F.least(F.length(key), F.length(segment)) >= ALIKE * both
    shared = let(F.array_distinct(_pairs(segment)), lambda own: F.size(F.filter(_pairs(key), lambda p: F.array_contains(own, p))))
    return long_enough & (shared >= (1.5 * ALIKE - 1) * both - 1)


def near_segments(key: Column, segments: Column) -> Column:
    """Of ``segments`` those that may be like the evidence, by their keys."""
    return F.filter(segments, lambda s: may_be_alike(key, s))


def segment_keys(text: Column) -> Column:
    """Keys of the sentences of a text in normal form that are long enough to be evidence."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), _key), lambda s: F.length(s) >= 8)


def _strip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{chars}]+|[{chars}]+$", "")


def _spaced(c: Column) -> Column:
    """Whether a text is ASCII with no blanks but single spaces inside: most are, and none of the patterns has to look at them."""
    ends = c.startswith(" ") | c.endswith(" ")
    return _ascii(c) & ~ends & ~reduce(lambda a, b: a | c.contains(b), ("\t", "\n", "\x0b", "\x0c", "\r"), c.contains("  "))


def _space(c: Column) -> Column:
    return F.when(_spaced(c), c).otherwise(_strip(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK + "+", " "), r"\s"))


def _name(c: Column) -> Column:
    bare = F.regexp_replace(_strip(_space(c), NAME_EDGE), r"(?iU)^(?:the|a|an)\s+", "")
    bare = F.regexp_replace(bare, "(?:的)?(?:主要|最重要的|重要的)?(?:组分|成分|质量|控制|工艺|操作)$", "")
    return F.when(c.rlike(WORD), c).otherwise(bare)


def _key(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), KEY_DROPPED, "")


def _canonical(c: Column) -> Column:
    return _key(_name(c))


def _bad(name: Column) -> Column:
    def judged(v):
        name, key = v["name"], v["key"]
        general = name.isin(*GENERIC_NAMES) | key.isin(*GENERIC_NAMES)
        return (key == "") | general | (F.length(name) > MOST_NAME) | (F.length(key) < 2) | key.rlike(r"(?U)^[\d.]+$")

    return let(F.struct(name.alias("name"), _key(name).alias("key")), judged)


def normal_space(c: Column) -> Column:
    return _space(nfkc(c))


def clean_name(c: Column) -> Column:
    """Edges, a leading article and one trailing qualifier go, in this order."""
    return _name(nfkc(c))


def _evidence(c: Column) -> Column:
    bare = F.when(_spaced(c) & ~c.startswith("`") & ~c.endswith("`"), c).otherwise(_strip(_space(c), r"`\s"))
    return let(bare, lambda text: F.when(F.length(text) > MOST_EVIDENCE, F.concat(F.regexp_replace(F.substring(text, 1, MOST_EVIDENCE), BLANK + "+$", ""), F.lit("..."))).otherwise(text))


def clean_evidence(c: Column) -> Column:
    return _evidence(nfkc(c))


def match_key(c: Column) -> Column:
    return _key(nfkc(c))


def canonical_key(c: Column) -> Column:
    return _canonical(nfkc(c))


def bad_name(name: Column) -> Column:
    """Too general, too long, too short or only digits."""
    return _bad(nfkc(name))


def holds_name(text_key: Column, name: Column) -> Column:
    """Whether a text, by its key, holds a name."""
    return let(F.struct(text_key.alias("t"), canonical_key(name).alias("k")), lambda v: (v["k"] != "") & v["t"].contains(v["k"]))


def _aliased(raw: Column, aliases: dict) -> Column:
    table = lookup(aliases)
    return F.coalesce(*(F.try_element_at(table, k) for k in (_key(raw), F.lower(raw), raw)))


def _label(c: Column) -> Column:
    return let(_name(c), lambda raw: F.when(raw.isin(*LABELS), raw).otherwise(_aliased(raw, LABEL_ALIASES)))


def map_label(c: Column) -> Column:
    """The closed label a label stands for, else null."""
    return _label(nfkc(c))


def map_type(c: Column) -> Column:
    """The closed relationship type a type stands for, else null."""
    return _type(nfkc(c))


def _type(c: Column) -> Column:
    def mapped(v):
        return F.when(v["upper"].isin(*TYPES), v["upper"]).otherwise(_aliased(v["raw"], TYPE_ALIASES))

    return let(let(_space(c), lambda raw: F.struct(raw.alias("raw"), _type_form(raw).alias("upper"))), mapped)


def _type_form(c: Column) -> Column:
    return F.upper(F.when(c.rlike(WORD), c).otherwise(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")))


def safe_identifier(c: Column, allowed) -> Column:
    """The identifier if it is one of the allowed ones; anything else fails the query."""
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), F.coalesce(c, F.lit("null")))))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: _strip(s, r"\s")), lambda s: s != "")


# --- documents and pages


def _base(source: Column) -> Column:
    pages = r"(?i)^(.+?)_page_\d{1,6}\.txt$"
    ranged = r"(?i)^(.+?)_pages_\d{1,6}_\d{1,6}\.txt$"
    plain = F.regexp_replace(source, r"(?i)\.(?:txt|md|pdf)$", "")
    return F.when(source.rlike(ranged), F.regexp_extract(source, ranged, 1)).when(source.rlike(pages), F.regexp_extract(source, pages, 1)).otherwise(plain)


def _tidy(name: Column) -> Column:
    cut = F.element_at(F.split(F.regexp_replace(name, "_", " "), r"(?i)\b(?:z-library|1lib|z-lib)\b", 2), 1)
    return _strip(F.regexp_replace(_strip(F.regexp_replace(cut, r"\(\s*\d+\s*\)$", ""), r"\s"), BLANK + "+", " "), r"\s")


def document_name(source: Column) -> Column:
    """A source's display name; the source itself, or "document", where nothing is left."""
    given = F.coalesce(source, F.lit(""))
    return F.coalesce(F.nullif(_tidy(_base(given)), F.lit("")), F.nullif(given, F.lit("")), F.lit("document"))


def document_of(document: Column, source: Column) -> Column:
    """A hit's document for citations: its own, else its source without the page part."""
    pages = r"^(.+)_page_(\d+)\.txt$"
    named = F.when(source.rlike(pages), source_name(F.regexp_extract(source, pages, 1))).otherwise(source_name(source))
    return F.coalesce(F.nullif(_strip(F.coalesce(document, F.lit("")), r"\s"), F.lit("")), named)


def page_of(document: Column, page: Column, source: Column) -> Column:
    """A hit's page for citations: its own where it has a document, else the one in its source's name."""
    own = F.nullif(_strip(F.coalesce(page.cast("string"), F.lit("")), r"\s"), F.lit(""))
    given = F.coalesce(_strip(document, r"\s"), F.lit("")) != ""
    return F.when(given, own).otherwise(F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), r"^.+_page_(\d+)\.txt$", 1), F.lit("")).cast("int").cast("string"))


def source_name(source: Column) -> Column:
    """The citation's form: page parts stay, and so does an empty name."""
    return _tidy(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?i)\.(?:txt|md|pdf)$", ""))


def page_of_source(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, r"(?i)^.+?_page_(\d{1,6})\.txt$", 1), F.lit("")).cast("int")


def page_label(first: Column, last: Column) -> Column:
    one = F.coalesce(first, last).cast("string")
    return F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat_ws("-", first, last)).otherwise(one)


def source_ref(document: Column, first: Column, last: Column, chunk: Column) -> Column:
    unknown = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return F.concat(document, F.lit("#page="), unknown(page_label(first, last)), F.lit("#chunk="), unknown(chunk))


def neighbour_ref(document: Column, page: Column, side: str) -> Column:
    return F.concat(document, F.lit("#page="), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit(f"#boundary={side}"))


def _markers(text: Column) -> Column:
    """array<struct<page,start,body,end>>: where each page marker starts and ends, and the next one starts."""
    none = F.array().cast("array<struct<page:int,start:int,body:int,end:int>>")
    found = F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(0))

    def placed(v):
        gaps, marks = F.transform(v["pieces"], F.length), F.transform(v["found"], F.length)
        # the end of each piece, if every piece is followed by its marker
        after = running(F.zip_with(F.slice(gaps, 1, F.size(marks)), marks, lambda g, m: g + m))
        total = F.aggregate(gaps, F.lit(0), lambda a, x: a + x) + F.aggregate(marks, F.lit(0), lambda a, x: a + x)
        starts = F.zip_with(after, marks, lambda e, m: e - m)
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(total))
        return F.zip_with(F.arrays_zip(v["found"].alias("m"), starts.alias("s"), after.alias("b")), ends, lambda x, e: F.struct(F.regexp_extract(x["m"], PAGE_MARKER, 1).cast("int").alias("page"), x["s"].alias("start"), x["b"].alias("body"), e.alias("end")))

    whole = let(F.struct(F.split(text, PAGE_MARKER).alias("pieces"), found.alias("found")), lambda v: F.when(F.size(v["found"]) == 0, none).otherwise(placed(v)))
    return F.when(text.contains("===== PAGE") | text.contains("[Page"), whole).otherwise(none)


def page_spans(text: Column) -> Column:
    """array<struct<page,start,end>>: from each page marker to the next or the end."""
    return F.transform(_markers(text), lambda m: F.struct(m["page"].alias("page"), m["start"].alias("start"), m["end"].alias("end")))


def page_segments(text: Column) -> Column:
    """array<struct<page,text>>: what stands after each page marker, up to the next."""
    cut = Cutter(Cutter.widened(text))
    return F.transform(_markers(text), lambda m: F.struct(m["page"].alias("page"), cut(m["body"], m["end"] - m["body"]).alias("text")))


def without_markers(text: Column) -> Column:
    return _strip(F.regexp_replace(text, PAGE_MARKER, ""), r"\s")


def safe_stem(name: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\p{Alnum}\-_.]", "_"), "^_+|_+$", ""), F.lit("")), F.lit("document"))


def document_stem(stem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem, r"(?i)_pages_\d{1,6}_\d{1,6}$", ""), r"(?i)_page_\d{1,6}$", "")


def page_section(page: Column, text: Column) -> Column:
    return F.concat(F.lit("===== PAGE "), page.cast("string"), F.lit(" =====\n"), _strip(text, r"\s"))


def window_filename(stem: Column, first: Column, last: Column) -> Column:
    return F.when(first.isNull(), F.concat(stem, F.lit(".txt"))).when(first == last, F.format_string("%s_page_%04d.txt", stem, first)).otherwise(F.format_string("%s_pages_%04d_%04d.txt", stem, first, last))


def select_pages(spec: Column, pages: Column) -> Column:
    """Pages of a list like ``1,5,20-30`` (blank, ``all`` or ``*``: all), sorted, distinct, within 1..pages."""
    every = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    bare = F.lower(_strip(F.coalesce(spec, F.lit("")), r"\s"))
    return F.when(bare.isin("", "all", "*"), every).otherwise(F.array_sort(F.array_intersect(F.flatten(F.transform(F.split(bare, ","), _page_part)), every)))


def _page_part(part: Column) -> Column:
    a = F.regexp_extract(part, r"^\s*(\d+)", 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(part, r"-\s*(\d+)\s*$", 1).try_cast("int"), a)
    return F.when(a.isNotNull() & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def page_number(page: Column) -> Column:
    """``0041`` is ``41``; what is no number stays."""
    bare = _strip(page, r"\s")
    return F.coalesce(bare.try_cast("int").cast("string"), bare)


def expand_pages(pages: Column) -> Column:
    """``3-5, 9`` -> 3, 4, 5, 9 as strings; a reversed range is empty, other ranges stay as they are."""

    def part(p):
        p = _strip(p, r"\s")
        a, b = (F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", i).try_cast("int") for i in (1, 2))
        ranged = F.when(a <= b, F.transform(F.sequence(a, b), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
        return F.when(p == "", F.array().cast("array<string>")).when(a.isNotNull() & b.isNotNull(), ranged).otherwise(F.array(page_number(p)))

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(pages, F.lit("")), "[,，]"), part)))


# --- evaluation keys and questions


def eval_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), BLANK + "+", "")


TRIPLE = r"(?sU)^\s*(.*?)\s*[-=]+>\s*(.*?)\s*[-=]+>\s*(.*?)\s*$"


def triple_of(text: Column) -> Column:
    """``a -> REL -> b`` (arrows of ``-`` or ``=``) as a struct (source, type, target) of keys, else null."""
    part = lambda i: F.regexp_extract(text, TRIPLE, i)
    whole = text.rlike(TRIPLE) & (part(1) != "") & (part(2) != "") & (part(3) != "")
    return F.when(whole, F.struct(eval_key(part(1)).alias("source"), F.upper(_strip(part(2), r"\s")).alias("type"), eval_key(part(3)).alias("target")))


def question_tokens(text: Column) -> Column:
    """ASCII words of the lowered text and runs of two or more CJK characters, each once.

    Names of the graph's nodes that the text holds are tokens too: ``facts.with_tokens`` adds them.
    """
    lowered = F.lower(text)
    return F.array_union(F.regexp_extract_all(lowered, F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(lowered, F.lit("[一-鿿]{2,}"), F.lit(0)))


def compact(text: Column) -> Column:
    return F.regexp_replace(without_markers(text), BLANK + "+", "")


def extract_json(content: Column) -> Column:
    """The JSON object in an answer: fences go, and what stands around the outermost braces; null if what is left is no JSON."""
    bare = _strip(F.regexp_replace(F.regexp_replace(_strip(content, r"\s"), r"^```(?:json)?", ""), "```$", ""), r"\s")
    return let(bare, lambda b: F.when(F.try_parse_json(b).isNotNull(), b).otherwise(let(F.regexp_extract(b, r"(?s)\{.*\}", 0), lambda o: F.when(F.try_parse_json(o).isNotNull(), o))))
