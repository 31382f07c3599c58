"""The quality gate: candidate nodes and relationships of a chunk are cleaned, checked, scored and merged.

A chunk stays one row.  Text work is expressions over its arrays of candidates; two steps are Python
in Arrow batches: normal forms of texts that are not plain, and a fold over the chunk's candidates,
whose accepted relationships label ends for those after them, with the likeness of the evidence that
is not literally in the chunk and within the bounds of it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.arrays import let
from graphloom.functions.vocabulary import LABELS, TYPE_ENDS

LEAST_CONFIDENCE = 0.70
MOST_DROPS = 30
RULE_CONFIDENCE = 0.92
FOLDED = 64  # chunks that a Python worker turns to objects and back at a time
LEAST_ALIKE = 12  # characters of a key from which evidence may be alike
NODE = "struct<name:string,label:string,canonical_key:string,description:string,aliases:array<string>,support_count:int>"
EDGE = "struct<source:string,source_key:string,source_label:string,type:string,target:string,target_key:string,target_label:string,evidence:string,confidence:double,quality_flags:array<string>,support_count:int>"
DROP = "struct<kind:string,name:string,reason:string>"


def _alike_part(batches):
    """The columns before the last three (key, there, near) go through, with whether the evidence is located."""
    import pyarrow as pa

    for batch in batches:
        n = batch.num_columns - 3
        key, there, near = (batch.column(n + i) for i in range(3))
        found = [t.as_py() or tx.is_alike(k.as_py(), s.as_py()) for k, t, s in zip(key, there, near, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.bool_())], names=[*batch.schema.names[:n], "located"])


def with_located(rows: DataFrame, evidence: Column, text: Column, *kept: str) -> DataFrame:
    """Columns ``kept`` and ``located``, whether evidence stands in the text: its key does, or a sentence is alike.

    Sentences are held against bounds in the JVM first; only those within reach Python.  That is a step
    of its own: as a UDF Spark leaves it in place where its arguments nest lambdas, and cannot run it there.
    """
    key, normal = tx._key(tx.nfkc(evidence)), tx.nfkc(text)
    there = (key != "") & tx._key(normal).contains(key)
    within = let(F.struct(key.alias("key"), tx.segment_keys(normal).alias("segments")), lambda v: tx.near_segments(v["key"], v["segments"]))
    near = F.coalesce(F.when((F.length(key) >= LEAST_ALIKE) & ~there, within), F.array().cast("array<string>"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, key.alias("key"), there.alias("there"), near.alias("near")).mapInArrow(_alike_part, f"{schema}, located boolean")


def evidence_score(is_located: Column, evidence: Column, evidence_key: Column, text_key: Column, source_key: Column, target_key: Column) -> tuple[Column, Column]:
    """(score, flags) of a relationship of known type before its ends' labels are looked at."""
    total, flags = F.lit(0.20) + F.when(is_located, 0.35).otherwise(0.0), [F.when(~is_located, F.lit("evidence_not_found"))]
    for side, key in (("source", source_key), ("target", target_key)):
        near, far = (key != "") & evidence_key.contains(key), (key != "") & text_key.contains(key)
        total = total + F.when(near, 0.15).when(far, 0.05).otherwise(0.0)
        flags.append(F.when(~near & ~far, F.lit(f"{side}_not_found")))
    total = total + 0.10 + F.when(F.length(evidence).between(8, tx.MOST_EVIDENCE), 0.05).otherwise(0.0)
    return total, F.array_compact(F.array(*flags))


def _merge_marked(edges: DataFrame, *by: str) -> DataFrame:
    """``edges`` with ``kept``, whether a row stands for its (source_key, type, target_key), the key's support and its first place."""
    own = Window.partitionBy(*by, "source_key", "type", "target_key")
    rows = edges.withColumns({"best": F.min_by("pos", F.struct(-F.col("confidence"), "pos")).over(own), "first": F.min("pos").over(own)})
    support = F.sum((F.col("pos") >= F.col("best")).cast("int")).over(own).cast("int")
    return rows.withColumns({"support_count": support, "kept": F.col("pos") == F.col("best")}).drop("best")


def merged_edges(edges: DataFrame, *by: str) -> DataFrame:
    """One row per chunk (``by``) and (source_key, type, target_key): the first by ``pos`` of the highest confidence.

    ``support_count`` counts that row and each of the key that comes after it.  One window over rows
    dealt by key, whatever a key's number of rows.
    """
    return _merge_marked(edges, *by).filter("kept").drop("kept", "first")


def rule_candidates(text: Column) -> Column:
    """array<struct<source,type,target,evidence,target_label>> that the two sentence rules find."""
    # The wording that the rules look for.
    part = r"([一-鿿A-Za-z0-9（）()]{2,30}?)(?:的)?(?:主要组分|组分|主要成分|成分)是([^。；;\n]{2,120})"
    index = r"([一-鿿A-Za-z0-9（）()]{2,30}?)(?:最重要的)?(?:质量指标|控制指标|指标)是([一-鿿A-Za-z0-9（）()/+]{2,40})"
    row = lambda s, t, o, e, label: F.struct(s.alias("source"), F.lit(t).alias("type"), o.alias("target"), e.alias("evidence"), F.lit(label).alias("target_label"))
    none = F.array().cast("array<struct<source:string,type:string,target:string,evidence:string,target_label:string>>")

    def tidy(t):
        return F.regexp_replace(F.trim(F.regexp_replace(t, "(?:还含有|其中|少量|大量|约占|占).*", "")), "(?:以下组分|以上组分|组分|成分)$", "")

    def of(sentence):
        parts = F.filter(F.transform(F.split(F.regexp_extract(sentence, part, 2), "[、,，和及与]"), tidy), lambda t: t != "")
        first = F.when(sentence.rlike(part), F.transform(parts, lambda t: row(F.regexp_extract(sentence, part, 1), "HAS_COMPONENT", t, sentence, "Material"))).otherwise(none)
        second = F.when(sentence.rlike(index), F.array(row(F.regexp_extract(sentence, index, 1), "HAS_QUALITY_INDEX", F.regexp_extract(sentence, index, 2), sentence, "Parameter"))).otherwise(none)
        return F.concat(first, second)

    # no sentence without this word meets a rule: the rules' patterns look at few
    said = F.transform(F.filter(F.split(text, tx.SENTENCE_END), lambda s: s.contains("是")), lambda s: tx._strip(s, r"\s"))
    return F.flatten(F.transform(F.filter(said, lambda s: F.length(s) <= 220), of))


ID = ("source", "chunk")
_RAW_NODES = "array<struct<name:string,label:string,description:string,aliases:array<string>>>"
_RAW_EDGES = "array<struct<source:string,type:string,target:string,evidence:string>>"


def _holds(text_key: Column, key: Column) -> Column:
    return (key != "") & text_key.contains(key)


def _normal(rows: Column, *fields: str) -> Column:
    """Fields of an array of structs, one after the other in one array of texts in normal form."""
    return tx.nfkc_each(F.concat(*(rows[f] for f in fields)))


def _unpacked(rows: str, texts: str, *fields: str) -> Column:
    """Structs of ``fields`` again, from texts that ``_normal`` gave for ``rows``; places are from 0."""
    n = F.size(rows)
    at = lambda i, k: F.col(texts)[i + n * k]
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("i"), *(at(i, k).alias(f) for k, f in enumerate(fields))))


def _node(n: Column) -> Column:
    """A candidate node, cleaned, and why it is dropped: the first reason counts."""

    def judged(v):
        reason = F.when(v["label"].isNull(), "unknown_label").when(tx._bad(v["name"]), "bad_name").when(~_holds(F.col("text_key"), v["key"]), "name_not_found_in_chunk")
        aliases = F.filter(F.transform(F.coalesce(F.col("node_aliases")[n["i"]], F.array().cast("array<string>")), tx._name), lambda a: a != "")
        told = F.substring(tx._space(n["description"]), 1, tx.MOST_DESCRIPTION)
        return F.struct(v["name"].alias("name"), v["label"].alias("label"), v["key"].alias("canonical_key"), told.alias("description"), aliases.alias("aliases"), reason.alias("reason"))

    return let(let(tx._name(n["name"]), lambda name: F.struct(name.alias("name"), tx._canonical(name).alias("key"), tx._label(n["label"]).alias("label"))), judged)


def _edge(r: Column) -> Column:
    """A candidate relationship, cleaned, with its score but for the labels, and why it is dropped.

    ``near`` is null where the evidence needs no further look; else it holds the sentences that may
    be alike, of which one must be.
    """
    text_key = F.col("text_key")

    def named(v):
        return F.struct(v["from"].alias("from"), v["to"].alias("to"), v["type"].alias("type"), v["evidence"].alias("evidence"), tx._canonical(v["from"]).alias("from_key"), tx._canonical(v["to"]).alias("to_key"), tx._key(v["evidence"]).alias("evidence_key"))

    def judged(v):
        reason = (
            F.when(v["type"].isNull(), "unknown_type")
            .when(tx._bad(v["from"]) | tx._bad(v["to"]), "bad_endpoint")
            .when(~_holds(text_key, v["from_key"]) | ~_holds(text_key, v["to_key"]), "endpoint_not_found_in_chunk")
            .when(v["from_key"] == v["to_key"], "self_loop")
            .when(v["evidence"] == "", "missing_evidence")
        )
        return let(reason, lambda why: placed(v, why))

    def placed(v, why):
        there = _holds(text_key, v["evidence_key"])
        near = F.when(why.isNull() & ~there, F.when(F.length(v["evidence_key"]) >= LEAST_ALIKE, tx.near_segments(v["evidence_key"], F.col("segments"))).otherwise(F.array().cast("array<string>")))
        # evidence that is not found drops the relationship, so a score is of evidence that is
        base, flags = evidence_score(F.lit(True), v["evidence"], v["evidence_key"], text_key, v["from_key"], v["to_key"])
        return F.struct(*(v[c].alias(c) for c in ("from", "to", "type", "evidence", "from_key", "to_key", "evidence_key")), why.alias("reason"), base.alias("base"), flags.alias("flags"), near.alias("near"))

    return let(let(F.struct(tx._name(r["source"]).alias("from"), tx._name(r["target"]).alias("to"), tx._type(r["type"]).alias("type"), tx._evidence(r["evidence"]).alias("evidence")), named), judged)


def _rule(r: Column) -> Column:
    """A relationship that the sentence rules find, cleaned."""
    found = lambda v: F.struct(v["from"].alias("from"), v["to"].alias("to"), v["type"].alias("type"), v["evidence"].alias("evidence"), v["to_label"].alias("to_label"), tx._canonical(v["from"]).alias("from_key"), tx._canonical(v["to"]).alias("to_key"), tx._bad(v["from"]).alias("from_bad"), tx._bad(v["to"]).alias("to_bad"))
    return let(F.struct(tx._name(r["source"]).alias("from"), tx._name(r["target"]).alias("to"), r["type"].alias("type"), tx._evidence(r["evidence"]).alias("evidence"), r["target_label"].alias("to_label")), found)


def candidates(extractions: DataFrame) -> DataFrame:
    """``extractions`` with their cleaned candidates as arrays ``tried_nodes``, ``tried_edges`` and ``tried_rules``.

    A chunk stays a row: normal forms come from one Arrow node, all else is expressions over arrays.
    """
    present = lambda c, kind: F.filter(F.coalesce(F.col(c), F.array().cast(kind)), lambda x: x.isNotNull())
    rows = extractions.withColumns({"raw_nodes": present("nodes", _RAW_NODES), "raw_edges": present("relationships", _RAW_EDGES), "raw_rules": F.coalesce(rule_candidates(F.col("text")), F.array().cast("array<struct<source:string,type:string,target:string,evidence:string,target_label:string>>"))})
    rows = rows.withColumns({
        "normal_text": tx.nfkc(F.col("text")),
        "node_texts": _normal(F.col("raw_nodes"), "name", "label", "description"),
        "node_aliases": tx.nfkc_nested(F.transform("raw_nodes", lambda n: n["aliases"])),
        "edge_texts": _normal(F.col("raw_edges"), "source", "target", "type", "evidence"),
        "rule_texts": _normal(F.col("raw_rules"), "source", "target", "type", "evidence", "target_label"),
    })
    rows = rows.withColumns({"text_key": tx._key(F.col("normal_text")), "segments": tx.segment_keys(F.col("normal_text"))})
    return rows.withColumns({
        "tried_nodes": F.transform(_unpacked("raw_nodes", "node_texts", "name", "label", "description"), _node),
        "tried_edges": F.transform(_unpacked("raw_edges", "edge_texts", "source", "target", "type", "evidence"), _edge),
        "tried_rules": F.transform(_unpacked("raw_rules", "rule_texts", "source", "target", "type", "evidence", "target_label"), _rule),
    })


class ChunkFold:
    """The part of the gate that depends on order: merges by key, and labels that accepted relationships give their ends.

    Names, keys, scores and bounds come ready from the plan; this walks a chunk's candidates once.
    """

    def __init__(self):
        self.nodes: dict[str, dict] = {}
        self.edges: dict[tuple, dict] = {}
        self.drops: list[dict] = []

    def node(self, n) -> None:
        if n["reason"]:
            self.drops.append({"kind": "node", "name": n["name"], "reason": n["reason"]})
            return
        held = self.nodes.get(n["canonical_key"])
        if held is None:
            self._add(n["name"], n["label"], n["canonical_key"], n["description"], n["aliases"])
            return
        # a node that is met again has its aliases sorted, without its own name
        held["aliases"] = sorted({*held["aliases"], *n["aliases"]} - {held["name"]})
        held["description"] = held["description"] or n["description"]
        held["support_count"] += 1

    def _add(self, name: str, label: str, key: str, told: str = "", aliases: list | None = None) -> dict:
        self.nodes[key] = {"name": name, "label": label, "canonical_key": key, "description": told, "aliases": aliases or [], "support_count": 1}
        return self.nodes[key]

    def _label(self, key: str, kind: str, role: int) -> str:
        node = self.nodes.get(key)
        return node["label"] if node else INFERRED[kind][role]

    def candidate(self, c) -> None:
        arrow = f"{c['from']}->{c['to']}"
        if c["reason"]:
            return self._drop(c["from"] if c["reason"] == "self_loop" else arrow, c["reason"])
        if c["near"] is not None and not tx.is_alike(c["evidence_key"], c["near"]):
            return self._drop(arrow, "evidence_not_found")
        labels = [self._label(c["from_key"], c["type"], 0), self._label(c["to_key"], c["type"], 1)]
        odd = [label not in allowed for label, allowed in zip(labels, TYPE_ENDS[c["type"]], strict=True)]
        confidence = max(0.0, min(c["base"] - 0.14 * sum(odd), 1.0))
        named = f"{c['from']}-{c['type']}->{c['to']}"
        if all(odd):
            return self._drop(named, "double_schema_mismatch")
        if confidence < LEAST_CONFIDENCE:
            return self._drop(named, f"low_confidence:{confidence:.2f}")
        flags = [*c["flags"], *(f"{side}_schema_mismatch" for side, x in zip(("source", "target"), odd, strict=True) if x)]
        ends = [self.nodes.get(key) or self._add(name, label, key) for name, label, key in ((c["from"], labels[0], c["from_key"]), (c["to"], labels[1], c["to_key"]))]
        new = self._edge(c, *ends, round(confidence, 3), flags)
        held = self.edges.get(self._key(new))
        if held is None or new["confidence"] > held["confidence"]:
            self.edges[self._key(new)] = new  # support starts anew with a better one
        else:
            held["support_count"] += 1
        return None

    def rule(self, r) -> None:
        """A rule's ends become nodes even where its relationship falls; it adds support to a relationship there is."""
        ends = [None if r[f"{e}_bad"] else self.nodes.get(r[f"{e}_key"]) or self._add(r[e], label, r[f"{e}_key"]) for e, label in (("from", "Product"), ("to", r["to_label"]))]
        if all(ends) and ends[0] is not ends[1]:
            new = self._edge(r, *ends, RULE_CONFIDENCE, ["rule_based"])
            held = self.edges.setdefault(self._key(new), new)
            if held is not new:
                held["support_count"] += 1

    def _drop(self, name: str, reason: str) -> None:
        self.drops.append({"kind": "relationship", "name": name, "reason": reason})

    @staticmethod
    def _key(edge: dict) -> tuple:
        return edge["source_key"], edge["type"], edge["target_key"]

    @staticmethod
    def _edge(c, s, t, confidence, flags) -> dict:
        return {"source": s["name"], "source_key": s["canonical_key"], "source_label": s["label"], "type": c["type"], "target": t["name"], "target_key": t["canonical_key"], "target_label": t["label"], "evidence": c["evidence"], "confidence": confidence, "quality_flags": flags, "support_count": 1}


INFERRED = {kind: tuple(min((x for x in ends if x in LABELS), default="Unit") for ends in both) for kind, both in TYPE_ENDS.items()}
GATED = f"nodes array<{NODE}>, relationships array<{EDGE}>, dropped array<{DROP}>, dropped_count int, input_nodes int, input_relationships int, accepted_nodes int, accepted_relationships int"


def _folded(chunk: str) -> str:
    """A chunk's candidates to what is accepted of them."""
    c, fold = json.loads(chunk), ChunkFold()
    for rows, step in ((c["nodes"], fold.node), (c["edges"], fold.candidate), (c["rules"], fold.rule)):
        for row in rows:
            step(row)
    nodes = sorted(fold.nodes.values(), key=lambda n: (n["label"], n["name"]))
    counts = {"dropped_count": len(fold.drops), "input_nodes": c["n_nodes"], "input_relationships": c["n_edges"], "accepted_nodes": len(nodes), "accepted_relationships": len(fold.edges)}
    return json.dumps({"nodes": nodes, "relationships": list(fold.edges.values()), "dropped": fold.drops[:MOST_DROPS]} | counts, ensure_ascii=False)


def _fold_part(batches):
    """The last column is folded, the others go through; ``FOLDED`` chunks are held as Python objects at a time."""
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, FOLDED):
            batch = whole.slice(at, FOLDED)
            folded = pa.array([_folded(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.string())
            yield batch.set_column(batch.num_columns - 1, "folded", folded)


def gate(extractions: DataFrame, *kept: str) -> DataFrame:
    """Per chunk (source, chunk, text, nodes, relationships): accepted nodes by label and name, relationships, drops and counters.

    Columns ``kept`` go through.  One pass: a chunk is cleaned, judged and folded in its own row, and
    nothing is shuffled.  Candidates cross to Python and back as JSON, which costs it far less than
    Arrow's nested values.
    """
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("int")
    through = [*ID, *(c for c in kept if c not in ID)]
    tried = F.struct(F.col("tried_nodes").alias("nodes"), F.col("tried_edges").alias("edges"), F.col("tried_rules").alias("rules"), size("nodes").alias("n_nodes"), size("relationships").alias("n_edges"))
    rows = candidates(extractions).select(*through, F.to_json(tried, {"ignoreNullFields": "false"}).alias("folded"))
    schema = ", ".join(f"`{c}` {extractions.schema[c].dataType.simpleString()}" for c in through)
    done = rows.mapInArrow(_fold_part, f"{schema}, folded string")
    return done.select(*through, F.from_json("folded", GATED).alias("g")).select(*through, "g.*")
