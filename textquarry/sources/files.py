"""Readers and writers: file discovery, documents, the registry CSV, questions, the ledger, stored points and reports."""

from __future__ import annotations

import hashlib
import io
import json
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import clean_page_text, stripped
from textquarry.operators.metadata import last_by_key, registry_key
from textquarry.session import checkpointed

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REGISTRY = ("designation", "title", "year", "status", "source_url", "replaced_by")


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, sha256`` of the documents under a root, or of the one file it names; suffixes in any case, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[pP][dD][fF],[dD][oO][cC][xX]}").load(root)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256")).orderBy("path")


def docx_blocks(files: DataFrame) -> DataFrame:
    """``path, block_seq, kind, text, error``: runs of paragraphs and tables in order; a broken file is one row with its error."""

    def cell(node) -> str:
        return "".join(t.text or "" for t in node.iter(_W + "t"))

    def table_text(node) -> str:
        rows = [[cell(c).replace("\n", " ").strip() for c in r.findall(_W + "tc")] for r in node.findall(_W + "tr")]
        rows = [r for r in rows if any(r)]
        wide = max(map(len, rows), default=0)
        lines = ["| " + " | ".join([*r, *[""] * (wide - len(r))]) + " |" for r in rows]
        lines[1:1] = ["| " + " | ".join(["---"] * wide) + " |"] if rows else []
        return "\n".join(lines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(_W + "body")
                    found: list[list] = []
                    for node in body if body is not None else []:
                        if node.tag == _W + "p" and cell(node).strip():
                            if found and found[-1][0] == "text":
                                found[-1][1] += "\n" + cell(node)
                            else:
                                found.append(["text", cell(node)])
                        elif node.tag == _W + "tbl" and table_text(node):
                            found.append(["table", table_text(node)])
                    out += [(path, n, kind, text, None) for n, (kind, text) in enumerate(found)]
                except Exception as e:  # noqa: BLE001 - one bad file must not fail the run
                    out.append((path, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "block_seq", "kind", "text", "error"])

    raw = files.where(F.lower("path").endswith(".docx")).select("path", "content").mapInPandas(run, "path string, block_seq int, kind string, text string, error string")
    return raw.withColumn("text", F.when(F.col("kind") == "text", clean_page_text(F.col("text"))).otherwise(F.col("text")))


#: What a PDF reader gives for a file: (raw text, whether a picture covers the page) for each page.
PdfReader = Callable[[bytes], list[tuple[str, bool]]]


def text_pages(content: bytes) -> list[tuple[str, bool]]:
    """The stand-in for a PDF reader: plain text, pages parted by form feeds."""
    return [(page, False) for page in content.decode("utf-8").split("\f")]


def pdf_pages(files: DataFrame, reader: PdfReader = text_pages) -> DataFrame:
    """``path, page_no, raw, scanned, error``: pages of PDF files; a broken file is one empty page with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(path, n, raw, scanned, None) for n, (raw, scanned) in enumerate(reader(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001
                    out.append((path, 1, "", False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page_no", "raw", "scanned", "error"])

    return files.where(F.lower("path").endswith(".pdf")).select("path", "content").mapInPandas(run, "path string, page_no int, raw string, scanned boolean, error string")


def load_documents(files: DataFrame, reader: PdfReader = text_pages) -> DataFrame:
    """``path, page_no, block_seq, kind, text, error`` of every file by its suffix; other suffixes are a row with an error."""
    docx = docx_blocks(files).select("path", F.lit(1).alias("page_no"), "block_seq", "kind", "text", "error")
    pdf = pdf_pages(files, reader).select("path", "page_no", F.lit(0).alias("block_seq"), F.lit("text").alias("kind"), clean_page_text(F.col("raw")).alias("text"), "error")
    other = files.where(~F.lower("path").rlike(r"\.(pdf|docx)$")).select("path", F.lit(1).alias("page_no"), F.lit(0).alias("block_seq"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("unsupported suffix").alias("error"))
    return docx.unionByName(pdf).unionByName(other)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The status registry, read anew at every call; the last row of a key wins, empty designations are skipped.

    A missing file is an empty registry; a byte order mark is no part of the first name.
    """
    schema = ", ".join(f"{n} string" for n in REGISTRY)
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, key string")
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    names = {c.lstrip("﻿").strip().strip('"'): c for c in rows.columns}
    plain = rows.select(*(stripped(F.col(f"`{names[n]}`")).alias(n) if n in names else F.lit(None).cast("string").alias(n) for n in REGISTRY)).withColumn("_order", F.monotonically_increasing_id())
    keyed = plain.select("_order", *(F.coalesce(n, F.lit("")).alias(n) for n in REGISTRY)).withColumn("key", registry_key(F.col("designation"))).where("key <> ''")
    return last_by_key(keyed, "key", "_order").drop("_order")


QUESTION = "id string, question string, gold_designation string, gold_section string, out_of_corpus boolean, note string, split string, answer_contains array<array<string>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a YAML or JSON file (``questions:`` a list of mappings); a spelling by itself is a group of one."""
    text = spark.sparkContext.wholeTextFiles(path).first()[1]
    try:
        import yaml

        data = yaml.safe_load(text) or {}
    except ImportError:  # JSON is YAML
        data = json.loads(text)
    names = [part.split(" ")[0] for part in QUESTION.split(", ")]
    rows = []
    for item in data.get("questions", []):
        groups = [[str(x) for x in g] if isinstance(g, list) else [str(g)] for g in item.get("answer_contains") or []]
        row = {**item, "answer_contains": groups, "out_of_corpus": bool(item.get("out_of_corpus"))}
        rows.append(tuple(row.get(n) if not isinstance(row.get(n), (int, float)) or isinstance(row.get(n), bool) else str(row.get(n)) for n in names))
    return spark.createDataFrame(rows, QUESTION)


def append_ledger(records: DataFrame, path: str) -> None:
    """One JSON line for each file that was handled; skipped ones write nothing."""
    kept = records.where("not coalesce(skipped, false)") if "skipped" in records.columns else records
    kept.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def settings_fingerprint(settings: dict) -> str:
    """Twelve hex digits of the SHA-1 of the settings as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


#: Folders that stored points are spread over by document, so that neither documents nor folders are too many.
SHARDS = 64


def shard(doc_id: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def ensure_collection(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> None:
    """An empty store where there is none, or where it is to be made anew."""
    if recreate or not exists(spark, path):
        spark.createDataFrame([], f"{schema}, shard int").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, shard int").parquet(path).drop("shard")


def upsert_points(points: DataFrame, path: str, schema: str, key: tuple[str, ...] = ("doc_id", "chunk_index")) -> int:
    """Rows of equal key are replaced, all others stay; returns the number of points given.

    Only the shards of the documents that change are written anew.
    """
    spark = points.sparkSession
    new = checkpointed(points.withColumn("shard", shard(F.col("doc_id"))))
    touched = [r["shard"] for r in new.select("shard").distinct().collect()]  # at most SHARDS
    if not touched:
        return 0
    old = spark.read.schema(f"{schema}, shard int").parquet(path).where(F.col("shard").isin(touched))
    merged = checkpointed(old.join(new.select(*key), list(key), "left_anti").unionByName(new))  # before its own files are overwritten
    merged.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return new.count()


def write_report(report: DataFrame, path: str) -> None:
    """A report, small by nature, as one JSON file of lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def source_status(known: bool, path: str | None, root: str, on_disk: Callable[[str], bool]) -> int:
    """404 for an unknown document or a file that is gone, 403 outside the root, else 200."""
    if not known or not path:
        return 404
    parts = PurePosixPath(path).parts
    if ".." in parts or PurePosixPath(root) not in PurePosixPath(path).parents:
        return 403
    return 200 if on_disk(path) else 404
