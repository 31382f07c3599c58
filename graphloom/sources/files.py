"""Readers and writers: text files with a decode ladder, JSON lines, extraction logs, graph snapshots."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as tx

SUFFIXES = ("txt", "md", "pdf")
FIRST_PAGES, LEAST_TEXT = 5, 80  # a PDF has a text layer if its first pages hold so many characters
LOG_SCHEMA = """source string, chunk int, document string, page_start int, page_end int, page string, text string,
 extraction struct<nodes:array<struct<name:string,label:string,canonical_key:string,description:string,aliases:array<string>,support_count:int>>,
 relationships:array<struct<source:string,source_key:string,source_label:string,type:string,target:string,target_key:string,target_label:string,evidence:string,confidence:double,quality_flags:array<string>,support_count:int>>>,
 quality struct<input_nodes:int,input_relationships:int,accepted_nodes:int,accepted_relationships:int,dropped_count:int,dropped:array<struct<kind:string,name:string,reason:string>>>"""


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8, else GBK, else UTF-8 without what it cannot read; a byte order mark stays."""

    def one(raw):
        for encoding in ("utf-8", "gbk"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "ignore")

    return content.map(lambda raw: None if raw is None else one(bytes(raw)))


def list_files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(path, name, suffix, content) of the text, markdown and PDF files under ``path``, or of those that end in ``suffix``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", f"*.{suffix}") if suffix else reader).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.withColumn("suffix", ending).filter(F.col("suffix").isin(*SUFFIXES))
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "suffix", "content")


def source_files(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """``list_files`` of a folder, or of one file of it, by name; an error if there is none that is supported.

    In no order, as contents are not moved to sort them: ``source_names`` is sorted.
    """
    if name and name.rsplit(".", 1)[-1].lower() not in SUFFIXES:
        raise ValueError(f"not supported: {name}")
    try:
        rows = list_files(spark, f"{path.rstrip('/')}/{name}" if name else path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no such file: {name or path}") from e
    if rows.select("path").limit(1).isEmpty():
        raise FileNotFoundError(f"no supported files in {path}")
    return rows


def source_names(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(path, name, suffix) of ``source_files`` in the order of their paths; no contents are read."""
    return source_files(spark, path, name).select("path", "name", "suffix").orderBy("path")


def decoded(files: DataFrame) -> DataFrame:
    """(source, text) of text and markdown files; valid UTF-8 is decoded without Python."""
    rows = files.filter(F.col("suffix") != "pdf")
    return rows.select(F.col("name").alias("source"), F.coalesce(F.when(F.is_valid_utf8(F.col("content")), F.decode("content", "UTF-8")), decode(F.when(~F.is_valid_utf8(F.col("content")), F.col("content")))).alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the text and markdown files under ``path``."""
    return decoded(list_files(spark, path))


class PageProvider(Protocol):
    """What turns a document's bytes into page texts: a PDF library, or rendering and OCR.  They are the caller's."""

    def __call__(self, content: bytes) -> list[str]: ...


def by_ocr(render: Callable[[bytes, float], list], recognise: Callable[[object], str], zoom: float = 2.0) -> PageProvider:
    """A provider that renders pages, ``zoom`` times their size, and reads the images."""
    return lambda content: [recognise(image) for image in render(content, zoom)]


def pdf_pages(files: DataFrame, extract: PageProvider, ocr: PageProvider | None = None, force_ocr: bool = False) -> DataFrame:
    """(source, page, text) of PDF files: their text layer, or OCR where the first pages hold too little text or it is forced."""

    def run(frames):
        for frame in frames:
            rows = []
            for name, raw in zip(frame["name"], frame["content"], strict=True):
                texts = [] if force_ocr and ocr else [t or "" for t in extract(bytes(raw))]
                if ocr and sum(len(t.strip()) for t in texts[:FIRST_PAGES]) < LEAST_TEXT:
                    texts = ocr(bytes(raw))
                rows += [(name, i + 1, t) for i, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return files.filter("suffix = 'pdf'").select("name", "content").mapInPandas(run, "source string, page int, text string")


def read_pdf_pages(spark: SparkSession, path: str, extract: PageProvider) -> DataFrame:
    """(source, page, text) of the PDF files under ``path``, by their text layer."""
    return pdf_pages(list_files(spark, path), extract)


def picked_pages(pages: DataFrame, spec: str | None = None) -> DataFrame:
    """The pages that a list like ``1,5,20-30`` names, of each source; all without one."""
    last = pages.groupBy("source").agg(F.max("page").alias("last"))
    wanted = last.select("source", F.explode(tx.select_pages(F.lit(spec), F.col("last"))).alias("page"))
    return pages.join(wanted, ["source", "page"], "left_semi")


def read_documents(spark: SparkSession, path: str, extract: PageProvider | None = None) -> DataFrame:
    """(source, text) of every supported file: texts as they are, PDF files as their joined pages (by ``extract``)."""
    files = source_files(spark, path)
    texts = decoded(files)
    if extract is None:
        if not files.filter("suffix = 'pdf'").select("path").limit(1).isEmpty():
            raise ValueError("PDF files need a page provider")
        return texts
    return texts.unionByName(joined_pages(pdf_pages(files, extract)).select("source", "text"))


def has_text(pages: DataFrame, key: str = "source", first: int = FIRST_PAGES, least: int = LEAST_TEXT) -> DataFrame:
    """(key, has_text): whether the first pages hold enough text."""
    return pages.groupBy(key).agg((F.coalesce(F.sum(F.when(F.col("page") <= first, F.length(tx._strip(F.col("text"), r"\s")))), F.lit(0)) >= least).alias("has_text"))


def joined_pages(pages: DataFrame, key: str = "source") -> DataFrame:
    """(key, text): the non-blank pages under ``[Page n]`` heads."""
    own = F.array_sort(F.collect_list(F.when(tx._strip(F.col("text"), r"\s") != "", F.struct("page", "text"))))
    parts = F.transform(own, lambda p: F.concat(F.lit("[Page "), p["page"].cast("string"), F.lit("]\n"), p["text"]))
    return pages.groupBy(key).agg(F.array_join(parts, "\n\n").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line): the lines of text files with their numbers in them, as a reader from top to bottom counts.

    Files are read in splits, so a file may be of any size.  A split's lines come in order in one task;
    how many stand before it in its file is a sum over splits, of which there are few.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("spot"))
    sizes = lines.groupBy("file", "block").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a split of a file: a broadcast of a row for each 128 MB that is read
    starts = sizes.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("spot") + F.col("shift")).alias("number"), "line")


def read_json_lines(spark: SparkSession, path: str, schema: str, numbered: str | None = None) -> DataFrame:
    """JSON lines; blank lines and those of ``#`` are skipped; a line that is no JSON is an error that says which.

    ``numbered`` names an id column that defaults to q and the line's number in its file.
    """
    rows = numbered_lines(spark, path).filter((tx._strip(F.col("line"), r"\s") != "") & ~F.col("line").rlike(r"(?U)^\s*#"))
    bad = F.raise_error(F.concat(F.lit("invalid JSON at line "), F.col("number").cast("string")))
    whole = F.when(F.try_parse_json("line").isNotNull(), F.from_json("line", schema)).otherwise(bad.cast(rows.select(F.from_json("line", schema).alias("r")).schema["r"].dataType))
    parsed = rows.select("number", whole.alias("r")).select("number", "r.*")
    if numbered:
        parsed = parsed.withColumn(numbered, F.coalesce(F.col(numbered), F.format_string("q%04d", F.col("number"))))
    return parsed.drop("number")


GOLD = "id string, source string, page string, entities string, expected_entities string, triples string, expected_triples string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold records (id, source, page, entities, triples as JSON texts) from JSON lines, a JSON list, or an object with ``items`` or ``gold``."""
    if path.lower().endswith(".jsonl"):
        rows = read_json_lines(spark, path, GOLD)
    else:
        whole = spark.read.format("text").option("wholetext", "true").load(path).select(F.parse_json("value").alias("v"))
        list_ = lambda at: F.try_variant_get("v", at, "array<variant>")
        item = F.explode(F.coalesce(list_("$"), list_("$.items"), list_("$.gold"), F.array().cast("array<variant>")))
        rows = whole.select(item.alias("r")).select(F.from_json(F.to_json("r"), GOLD).alias("r")).select("r.*")
    filled = lambda c: F.coalesce(F.when(F.col(c) != "[]", F.col(c)), F.col(f"expected_{c}"))
    return rows.select("id", "source", "page", filled("entities").alias("entities"), filled("triples").alias("triples"))


def read_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Extraction-log items that hold an extraction; a missing or broken log is empty, or, if ``strict``, an error."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    try:
        return spark.read.schema(LOG_SCHEMA).option("multiLine", "true").option("mode", mode).json(path).filter("extraction is not null")
    except AnalysisException as e:
        if strict or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def prepared(texts: DataFrame) -> DataFrame:
    """Texts as they are kept: stripped, one line end, under a safe name."""
    return texts.select(F.concat(tx.safe_stem(F.col("source")), F.lit(".txt")).alias("source"), F.concat(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("text"))


def write_table(rows: DataFrame, path: str, *by: str) -> None:
    """Appends rows; a log grows by what is new instead of being written anew."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def snapshot(nodes: DataFrame, edges: DataFrame, path: str, run: str) -> None:
    """Writes a graph as the run's tables, and then makes the run the one that ``load_snapshot`` gives."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{path}/{run}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/{run}/edges")
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{path}/latest")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The latest run's (nodes, edges)."""
    run = spark.read.schema("run string").json(f"{path}/latest").first()["run"]
    return spark.read.parquet(f"{path}/{run}/nodes"), spark.read.parquet(f"{path}/{run}/edges")


def refreshed(spark: SparkSession, path: str, run: str, read: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, str | None]:
    """(nodes, edges, error): the graph that ``read`` gives, kept as a snapshot; where the source is down the latest one, and why."""
    try:
        snapshot(*read(), path, run)
        error = None
    except Exception as e:  # noqa: BLE001 - whatever fails at the source, the snapshot still serves
        error = str(e).splitlines()[0] if str(e) else type(e).__name__
    return *load_snapshot(spark, path), error


def wide_metrics(metrics: DataFrame) -> DataFrame:
    """One row a question, one column a metric, for a CSV file."""
    return metrics.withColumn("name", F.concat_ws("@", "metric", F.col("k").cast("string"))).groupBy("qid").pivot("name").agg(F.first("value"))


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> None:
    """CSV by RFC 4180, null as nothing, line ends inside fields as blanks; ``mark`` puts a byte order mark before the header."""
    flat = rows.select(*(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " ").alias(f"\ufeff{c}" if mark and i == 0 else c) for i, c in enumerate(rows.columns)))
    flat.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def markdown(rows: DataFrame) -> DataFrame:
    """Each row as a line of a markdown table; doubles to four places, null as ``-``."""
    cell = lambda f: F.coalesce(F.format_string("%.4f", f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast("string"), F.lit("-"))
    cells = [F.when(F.col(f.name).isNull(), F.lit("-")).otherwise(cell(f)) for f in rows.schema]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
