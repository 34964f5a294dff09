"""The stored corpus: ids, payloads, upserts, listings, pruning and the ingest ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import approx_tokens, point_id
from textquarry.session import table


def with_ids(chunks: DataFrame) -> DataFrame:
    """Content hash and point id of every chunk; a null text has neither."""
    hashed = chunks.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withColumn("point_id", F.when(F.col("content_hash").isNotNull(), point_id(F.col("doc_id"), F.col("chunk_index"), F.col("content_hash"))))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Last write wins."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of ``new`` replace those stored as wholes."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ledger_last_success(ledger: DataFrame) -> DataFrame:
    """Last successful record of each path; a later failure does not undo an earlier success."""
    return latest(ledger.where("sha256 is not null and error is null"), ["path"], [F.desc("seq")]).withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))


def q_ids(spark, sf):
    return with_ids(table(spark, sf, "chunks")).select("chunk_id", "content_hash", "point_id")


def q_upsert(spark, sf):
    return latest(table(spark, sf, "chunks"), ["doc_id", "chunk_index"], [F.desc("ingested_at"), F.desc("chunk_id")]).select("doc_id", "chunk_index", "chunk_id")


def q_list(spark, sf):
    m = table(spark, sf, "doc_meta").groupBy("doc_id").agg(*(F.min_by(c, "meta_id").alias(c) for c in ("designation", "title", "status")))
    n = table(spark, sf, "chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return n.join(m, "doc_id", "left").select("doc_id", "chunks", "designation", "title", "status")


def q_count(spark, sf):
    return table(spark, sf, "chunks").agg(F.count("*").alias("points"))


def q_known(spark, sf):
    return table(spark, sf, "doc_meta").where("designation is not null").select("designation").distinct()


def q_sources(spark, sf):
    return table(spark, sf, "doc_meta").where("source_path <> ''").select("doc_id", "source_path").distinct()


def q_payload(spark, sf):
    """Chunk with the passport of its document, one row a chunk."""
    m = latest(table(spark, sf, "doc_meta"), ["doc_id"], [F.col("meta_id")]).select("doc_id", "designation", "status", "year")
    return table(spark, sf, "chunks").join(m, "doc_id").select("chunk_id", "doc_id", "designation", "status", "year", "page_start", "page_end")


def q_last(spark, sf):
    return ledger_last_success(table(spark, sf, "ledger")).select("path", "seq", "doc_id", "sha256", "fingerprint")


def q_changed(spark, sf):
    """Registrations whose content the ledger does not hold yet."""
    done = ledger_last_success(table(spark, sf, "ledger")).select(F.col("path").alias("source_path"), "sha256")
    return table(spark, sf, "doc_meta").join(done, ["source_path", "sha256"], "left_anti").select("meta_id", "source_path", "sha256")


def q_prune(spark, sf):
    """Stored sources under the root that no successful ledger record names."""
    files = table(spark, sf, "ledger").where("error is null").select(F.col("path").alias("source_path")).distinct()
    return table(spark, sf, "doc_meta").where(F.col("source_path").startswith("/corpus/")).join(files, "source_path", "left_anti").select("doc_id", "source_path").distinct()


def q_conflicts(spark, sf):
    """Documents registered from more than one path."""
    m = table(spark, sf, "doc_meta").where("source_path is not null").groupBy("doc_id").agg(F.countDistinct("source_path").alias("paths"))
    return m.where("paths > 1").select("doc_id", "paths")


def q_runs(spark, sf):
    kind = F.when(F.col("error").isNotNull(), "failed").when(F.col("skipped"), "skipped").otherwise("ok")
    return table(spark, sf, "ledger").groupBy(kind.alias("result")).agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


def q_rollup(spark, sf):
    """Blocks of a page rolled up: ordered text, first and last block, tokens, tables, ordered distinct sections."""
    b = table(spark, sf, "blocks").where("text is not null")
    rows = b.groupBy("doc_id", "page_no").agg(
        F.min("block_seq").alias("first_seq"), F.max("block_seq").alias("last_seq"), F.sum(approx_tokens(F.col("text")).cast("long")).alias("tokens"),
        F.coalesce(F.max(F.col("kind") == "table"), F.lit(False)).alias("has_table"),
        F.array_sort(F.collect_list(F.struct("block_seq", "text", "section"))).alias("all"),
    )
    return rows.select("doc_id", "page_no", "first_seq", "last_seq", "tokens", "has_table", F.sha2(F.array_join("all.text", "\n\n"), 256).alias("text_hash"), F.array_join(F.array_distinct(F.array_compact("all.section")), ",").alias("sections"))


_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_LAST = "SELECT * FROM ledger WHERE sha256 IS NOT NULL AND error IS NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1"
QUERIES = {
    "chunk_ids": q_ids, "upsert_latest": q_upsert, "list_documents": q_list, "count_points": q_count, "known_designations": q_known, "document_sources": q_sources, "chunk_payload": q_payload,
    "ledger_last_success": q_last, "changed_files": q_changed, "prune_missing": q_prune, "source_conflicts": q_conflicts, "run_summary": q_runs, "page_rollup": q_rollup,
}
ORACLES = {
    "chunk_ids": f"WITH t AS (SELECT chunk_id, sha256(text) AS s, sha1(from_hex('6f0b9d1e3a4c4f8b9c2a1d5e7f0a2b31') || encode(doc_id || ':' || chunk_index || ':' || sha256(text))) AS h FROM chunks) SELECT chunk_id, s AS content_hash, {_UUID} AS point_id FROM t",
    "upsert_latest": "SELECT doc_id, chunk_index, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY ingested_at DESC NULLS LAST, chunk_id DESC) = 1",
    "list_documents": "WITH m AS (SELECT doc_id, arg_min_null(designation, meta_id) AS designation, arg_min_null(title, meta_id) AS title, arg_min_null(status, meta_id) AS status FROM doc_meta GROUP BY 1), n AS (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY 1) SELECT n.doc_id, chunks, designation, title, status FROM n LEFT JOIN m USING (doc_id)",
    "count_points": "SELECT count(*) AS points FROM chunks",
    "known_designations": "SELECT DISTINCT designation FROM doc_meta WHERE designation IS NOT NULL",
    "document_sources": "SELECT DISTINCT doc_id, source_path FROM doc_meta WHERE source_path <> ''",
    "chunk_payload": "WITH m AS (SELECT * FROM doc_meta QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY meta_id) = 1) SELECT chunk_id, c.doc_id, designation, status, year, page_start, page_end FROM chunks c JOIN m USING (doc_id)",
    "ledger_last_success": f"SELECT path, seq, doc_id, sha256, coalesce(fingerprint, '') AS fingerprint FROM ({_LAST})",
    "changed_files": f"SELECT meta_id, source_path, sha256 FROM doc_meta m WHERE NOT EXISTS (SELECT 1 FROM ({_LAST}) l WHERE l.path = m.source_path AND l.sha256 = m.sha256)",
    "prune_missing": "SELECT DISTINCT doc_id, source_path FROM doc_meta m WHERE starts_with(source_path, '/corpus/') AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.error IS NULL AND l.path = m.source_path)",
    "source_conflicts": "SELECT doc_id, count(DISTINCT source_path) AS paths FROM doc_meta GROUP BY 1 HAVING count(DISTINCT source_path) > 1",
    "run_summary": "SELECT CASE WHEN error IS NOT NULL THEN 'failed' WHEN skipped THEN 'skipped' ELSE 'ok' END AS result, count(*) AS files, sum(chunks)::BIGINT AS chunks FROM ledger GROUP BY 1",
    "page_rollup": """WITH b AS (SELECT * FROM blocks WHERE text IS NOT NULL), s AS (SELECT doc_id, page_no, section, min(block_seq) AS q FROM b WHERE section IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT doc_id, page_no, string_agg(section, ',' ORDER BY q) AS sections FROM s GROUP BY 1, 2)
      SELECT b.doc_id, b.page_no, min(block_seq) AS first_seq, max(block_seq) AS last_seq, sum(greatest(1, length(text) // 3))::BIGINT AS tokens, coalesce(max(kind = 'table'), false) AS has_table, sha256(string_agg(text, E'\\n\\n' ORDER BY block_seq)) AS text_hash, coalesce(any_value(t.sections), '') AS sections
      FROM b LEFT JOIN t ON t.doc_id = b.doc_id AND t.page_no IS NOT DISTINCT FROM b.page_no GROUP BY 1, 2""",
}
