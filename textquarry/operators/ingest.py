"""Ingest: states and reading order of pages, recognised words, points, owners, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import clean_page_text, stripped
from textquarry.operators.corpus import with_ids
from textquarry.operators.metadata import first_texts
from textquarry.operators.structure import repeated_lines, strip_repeated
from textquarry.session import table
from textquarry.streaming.ingest import ORDER, ordered_events, parsed_frames

#: Characters that the text layer of a page must have, share of the page that a picture of a scan covers.
LEAST_CHARS, COVER = 100, 0.8


def page_states(pages: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``pages`` (``raw, scanned``) with ``needs_ocr, from_ocr, text``: a page of hardly any text is empty until it is recognised."""
    needs = F.length(stripped(F.coalesce("raw", F.lit("")))) < least
    return pages.select("*", needs.alias("needs_ocr"), (F.col("scanned") & ~needs).alias("from_ocr"), F.when(needs, "").otherwise(clean_page_text(F.col("raw"))).alias("text"))


def is_scan(images: Column, width: Column, height: Column, cover: float = COVER) -> Column:
    """Whether one picture (struct of ``x0, top, x1, bottom``) covers that share of the page."""
    return F.exists(images, lambda i: (i["x1"] - i["x0"]) * (i["bottom"] - i["top"]) >= cover * width * height)


def cropped(words: DataFrame, top: float, bottom: float) -> DataFrame:
    """``id, text``: words (``id, top, x0, text``) of a horizontal band by lines; bands under one point in height are empty."""
    inside = words.where((F.col("top") >= top) & (F.col("top") < bottom) & F.lit(bottom - top >= 1))
    lines = inside.groupBy("id", "top").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("line"))
    return lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "line"))), lambda x: x["line"]), "\n").alias("text"))


def reading_order(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """``id, nth, kind, text``: text above a table, the table, the text below it, and so on.

    ``lines`` has ``id, top, text``, ``boxes`` ``id, top, bottom, text``.  A table that begins above the end of the
    one before is skipped; lines inside a table are no text.
    """
    sorted_ = boxes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("top", "bottom", "text"))).alias("every"))
    empty = F.slice(F.col("every"), 1, 0)
    kept = F.aggregate("every", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x["top"] >= F.try_element_at(acc, F.lit(-1))["bottom"]), F.concat(acc, F.array(x))).otherwise(acc))
    t = sorted_.select("id", kept.alias("tables"))
    j = lines.join(t, "id", "left")
    band = F.coalesce(F.size(F.filter("tables", lambda x: x["bottom"] <= F.col("top"))), F.lit(0))
    outside = ~F.coalesce(F.exists("tables", lambda x: (x["top"] <= F.col("top")) & (F.col("top") < x["bottom"])), F.lit(False))
    texts = j.where(outside).groupBy("id", (band * 2).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]), "\n").alias("text"))
    tables = t.select("id", F.posexplode("tables").alias("k", "x")).select("id", (F.col("k") * 2 + 1).alias("at"), F.col("x.text").alias("text"))
    every = texts.where(F.col("text").rlike(r"\S")).withColumn("kind", F.lit("text")).unionByName(tables.withColumn("kind", F.lit("table")))
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("at"))).select("id", "nth", "kind", "text")


def reflowed(words: DataFrame) -> DataFrame:
    """``id, text, confidence``: recognised words by line, and their mean confidence.

    ``words`` has ``id, block, par, line, word, text, conf``; blank words are left out, and
    those of no positive confidence from the mean, which is null without any.
    """
    full = words.where(F.col("text").rlike(r"(?U)\S"))
    lines = full.groupBy("id", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("t"), F.sum(F.when(F.col("conf") > 0, F.col("conf"))).alias("s"), F.count(F.when(F.col("conf") > 0, 1)).alias("n"))
    return lines.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda x: x["t"]), "\n").alias("text"), F.round(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), 2).alias("confidence")
    )


def recognised(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """``page_id, doc_id, page_no, text``: pages that need recognition with their recognised text, cleaned.

    Running lines are sought among the recognised pages alone.  ``texts`` has ``page_id, text, ocr_confidence``.
    """
    read = pages.where("needs_ocr").select("page_id", "doc_id", "page_no").join(texts.select("page_id", clean_page_text(F.col("text")).alias("text")), "page_id")
    return read.select("page_id", "doc_id", "page_no").join(strip_repeated(read, repeated_lines(read)), "page_id")


def points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``point_id`` and payload of chunks with their vectors, by ``doc_id, chunk_index``; raises where a chunk or a vector has no partner."""
    j = with_ids(chunks).join(vectors, ["doc_id", "chunk_index"], "full")
    lost = j.where("point_id is null or dense is null").limit(1).count()
    if lost:
        raise ValueError("chunks and vectors do not match one to one")
    return j


def missing_languages(wanted: Column, installed: Column) -> Column:
    """Languages asked for (joined by ``+``) that are not installed."""
    return F.array_except(F.filter(F.split(wanted, r"\+"), lambda x: x != ""), installed)


def owner_conflicts(registrations: DataFrame, live: DataFrame) -> DataFrame:
    """``meta_id, doc_id, other``: documents that another live file registered too; ``live`` has ``path``."""
    m = registrations.where("source_path is not null").select("meta_id", "doc_id", "source_path")
    others = registrations.where("source_path is not null").select("doc_id", F.col("source_path").alias("other")).distinct().join(live.select(F.col("path").alias("other")).distinct(), "other", "left_semi")
    return m.join(others, "doc_id").where("source_path <> other").groupBy("meta_id", "doc_id").agg(F.min("other").alias("other"))


def of_document(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.where(F.col("doc_id") == doc_id)


def _words(spark, sf) -> DataFrame:
    pages = table(spark, sf, "page_docs").where("text <> ''")
    lines = pages.select("page_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.select("page_id", "line", F.posexplode(F.split("l", " ")).alias("word", "text"))


def q_states(spark, sf):
    p = table(spark, sf, "page_docs").select("page_id", F.col("text").alias("raw"), F.coalesce("from_ocr", F.lit(False)).alias("scanned"))
    return page_states(p, 600).select("page_id", "needs_ocr", "from_ocr", "text")


def q_scans(spark, sf):
    """Pages under a picture as wide as the page and as high as the confidence says, and a small one."""
    p = table(spark, sf, "page_docs").select("page_id", F.coalesce("ocr_confidence", F.lit(10.0)).alias("c"))
    box = lambda x1, bottom: F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), x1.alias("x1"), bottom.alias("bottom"))
    images = F.array(box(F.lit(600.0), F.col("c") * 8), box(F.lit(60.0), F.lit(80.0)))
    return p.select("page_id", is_scan(images, F.lit(600.0), F.lit(800.0), 0.7).alias("scanned"))


def q_cropped(spark, sf):
    w = _words(spark, sf).select(F.col("page_id").alias("id"), (F.col("line") * 12.0).alias("top"), (F.col("word") * 30.0).alias("x0"), "text")
    return cropped(w, 36.0, 84.0).withColumnRenamed("id", "page_id")


def q_order(spark, sf):
    """Pages with three boxes on them, of which the second overlaps the first."""
    pages = table(spark, sf, "page_docs").where("text <> ''")
    lines = pages.select(F.col("page_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("n", "text")).select("id", (F.col("n") * 12.0).alias("top"), "text")
    box = lambda a, b, t: F.struct(F.lit(a).alias("top"), F.lit(b).alias("bottom"), F.lit(t).alias("text"))
    boxes = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("id"), F.explode(F.array(box(36.0, 72.0, "| 1 |"), box(60.0, 80.0, "| 2 |"), box(120.0, 140.0, "| 3 |"))).alias("b")).select("id", "b.*")
    return reading_order(lines, boxes).withColumnRenamed("id", "page_id")


def q_reflowed(spark, sf):
    w = _words(spark, sf).select(F.col("page_id").alias("id"), F.floor(F.col("line") / 10).cast("int").alias("block"), F.lit(0).alias("par"), "line", "word", "text", ((F.col("page_id") * 7 + F.col("word") * 13) % 100 - 5).cast("double").alias("conf"))
    return reflowed(w).withColumnRenamed("id", "page_id")


def q_points(spark, sf):
    """Points of the latest chunks with the vectors made for them."""
    from textquarry.operators.corpus import latest

    chunks = latest(table(spark, sf, "chunks"), ["doc_id", "chunk_index"], [F.desc("ingested_at"), F.desc("chunk_id")])
    vectors = table(spark, sf, "chunk_vectors").join(chunks.select("chunk_id", "doc_id", "chunk_index"), "chunk_id").select("doc_id", "chunk_index", F.coalesce("dense", F.array().cast("array<float>")).alias("dense"))
    return points(chunks.select("doc_id", "chunk_index", "text"), vectors).select("doc_id", "chunk_index", "point_id", F.size("dense").alias("width"))


def q_languages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(missing_languages(F.concat(F.coalesce("lang", F.lit("")), F.lit("+rus+eng")), F.array(F.lit("eng"), F.lit("ru"))), "+").alias("missing"))


def q_owners(spark, sf):
    return owner_conflicts(table(spark, sf, "doc_meta"), table(spark, sf, "ledger").where("error is null").select("path"))


def q_first(spark, sf):
    return first_texts(table(spark, sf, "page_docs"))


def q_document(spark, sf):
    return of_document(table(spark, sf, "chunks"), "гост-р-69001-2008").select("chunk_id", "chunk_index", "text")


def q_events(spark, sf):
    """Ledger entries as events of their document's thread."""
    kinds = F.array(*(F.lit(e) for e in ORDER[:4]))
    rows = table(spark, sf, "ledger").select(F.col("doc_id").alias("thread"), F.col("seq").alias("nth"), F.get(kinds, (F.col("seq") % 4).cast("int")).alias("event"), F.col("path").alias("data"))
    return ordered_events(rows)


def q_frames(spark, sf):
    """Event text written from the ledger, with mixed line ends and some broken JSON, read again."""
    end = F.when(F.col("seq") % 3 == 0, "\r\n").when(F.col("seq") % 3 == 1, "\n").otherwise("\r")
    event = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("event: token"), end)).otherwise("")
    data = F.when(F.col("seq") % 5 == 0, "data: {broken").otherwise(F.concat(F.lit('data: {"path":"'), "path", F.lit('"}')))
    text = F.concat(event, data, end, end, F.lit(": note"), end, end, F.lit("data: 1"), end)
    return parsed_frames(table(spark, sf, "ledger").select(F.col("seq").alias("id"), text.alias("text")))


def _oracles() -> dict[str, str]:
    from textquarry.operators import metadata, structure
    from textquarry.operators.corpus import _UUID
    from textquarry.operators.structure import _trimmed

    clean = structure.ORACLES["clean_text"].replace("FROM page_docs)", "FROM src)").replace("WITH a AS", ", a AS")
    words = "wd AS (SELECT page_id, line, unnest(string_split(l, ' ')) AS text, generate_subscripts(string_split(l, ' '), 1) - 1 AS word FROM (SELECT page_id, unnest(string_split(text, E'\\n')) AS l, generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS line FROM page_docs WHERE text <> ''))"
    order = "CASE event " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(ORDER)) + " END"
    return {
        "page_states": f"WITH src AS (SELECT page_id, text FROM page_docs) {clean.replace('SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,', ', z AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,', 1)}) SELECT p.page_id, length({_trimmed('coalesce(p.text, chr(32))')}) < 600 AS needs_ocr, coalesce(from_ocr, false) AND length({_trimmed('coalesce(p.text, chr(32))')}) >= 600 AS from_ocr, CASE WHEN length({_trimmed('coalesce(p.text, chr(32))')}) < 600 THEN '' ELSE z.text END AS text FROM page_docs p JOIN z ON z.page_id = p.page_id",
        "scanned_pages": "SELECT page_id, 600.0 * (coalesce(ocr_confidence, 10.0) * 8) >= 0.7::DOUBLE * 600 * 800 AS scanned FROM page_docs",
        "crop_text": f"WITH {words}, l AS (SELECT page_id, line, string_agg(text, ' ' ORDER BY word) AS t FROM wd WHERE line * 12 >= 36 AND line * 12 < 84 GROUP BY 1, 2) SELECT page_id, string_agg(t, E'\\n' ORDER BY line) AS text FROM l GROUP BY 1",
        "reading_order": """WITH l AS (SELECT page_id, unnest(string_split(text, E'\\n')) AS t, (generate_subscripts(string_split(text, E'\\n'), 1) - 1) * 12 AS y FROM page_docs WHERE text <> ''),
          b AS (SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 0 WHEN y >= 140 THEN 4 WHEN y >= 72 THEN 2 ELSE 0 END AS a, t, y FROM l WHERE page_id % 2 = 1 OR NOT (y >= 36 AND y < 72 OR y >= 120 AND y < 140)),
          e AS (SELECT page_id, a, 'text' AS kind, string_agg(t, E'\\n' ORDER BY y) AS text FROM b GROUP BY 1, 2 HAVING regexp_matches(string_agg(t, ''), '\\S') UNION ALL SELECT page_id, 1, 'table', '| 1 |' FROM page_docs WHERE text <> '' AND page_id % 2 = 0 UNION ALL SELECT page_id, 3, 'table', '| 3 |' FROM page_docs WHERE text <> '' AND page_id % 2 = 0)
          SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a)::INT AS nth, kind, text FROM e""",
        "reflow": f"WITH {words}, c AS (SELECT *, ((page_id * 7 + word * 13) % 100 - 5)::DOUBLE AS conf FROM wd WHERE regexp_matches(text, '[^\\s\\x{{a0}}]')), l AS (SELECT page_id, line, string_agg(text, ' ' ORDER BY word) AS t FROM c GROUP BY 1, 2), s AS (SELECT page_id, round(sum(CASE WHEN conf > 0 THEN conf END) / nullif(count(CASE WHEN conf > 0 THEN 1 END), 0), 2) AS confidence FROM c GROUP BY 1) SELECT l.page_id, string_agg(t, E'\\n' ORDER BY line) AS text, any_value(confidence) AS confidence FROM l JOIN s ON s.page_id = l.page_id GROUP BY 1",
        "build_points": f"WITH k AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY ingested_at DESC NULLS LAST, chunk_id DESC) = 1), t AS (SELECT chunk_id, doc_id, chunk_index, sha1(from_hex('6f0b9d1e3a4c4f8b9c2a1d5e7f0a2b31') || encode(doc_id || ':' || chunk_index || ':' || sha256(text))) AS h FROM k) SELECT doc_id, chunk_index, {_UUID} AS point_id, len(coalesce(dense, []))::INT AS width FROM t JOIN chunk_vectors v ON v.chunk_id = t.chunk_id",
        "missing_languages": "SELECT doc_id, array_to_string(list_filter(['' || coalesce(lang, ''), 'rus', 'eng'], lambda x, i: x <> '' AND x <> 'eng' AND x <> 'ru' AND NOT (i > 1 AND x = coalesce(lang, ''))), '+') AS missing FROM documents",
        "owner_conflicts": "SELECT m.meta_id, m.doc_id, min(o.source_path) AS other FROM doc_meta m JOIN doc_meta o ON o.doc_id = m.doc_id AND o.source_path <> m.source_path WHERE o.source_path IN (SELECT path FROM ledger WHERE error IS NULL) GROUP BY 1, 2",
        "first_pages": f"WITH {metadata._FIRST} SELECT doc_id, text FROM first",
        "document_chunks": "SELECT chunk_id, chunk_index, text FROM chunks WHERE doc_id = 'гост-р-69001-2008'",
        "ordered_events": f"WITH e AS (SELECT doc_id AS thread, seq AS nth, CASE seq % 4 WHEN 0 THEN 'sources' WHEN 1 THEN 'token' WHEN 2 THEN 'final' ELSE 'error' END AS event, path AS data FROM ledger UNION ALL SELECT doc_id, max(seq) + 1, 'done', '{{}}' FROM ledger GROUP BY 1) SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY {order}, nth)::INT AS seq, event, data FROM e",
        "sse_frames": "SELECT seq AS id, 0 AS nth, CASE WHEN seq % 2 = 0 THEN 'token' ELSE 'message' END AS event, CASE WHEN seq % 5 = 0 THEN '{}' ELSE '{\"path\":\"' || path || '\"}' END AS data FROM ledger UNION ALL SELECT seq, 2, 'message', '1' FROM ledger",
    }


QUERIES = {
    "page_states": q_states, "scanned_pages": q_scans, "crop_text": q_cropped, "reading_order": q_order, "reflow": q_reflowed, "build_points": q_points, "missing_languages": q_languages, "owner_conflicts": q_owners,
    "first_pages": q_first, "document_chunks": q_document, "ordered_events": q_events, "sse_frames": q_frames,
}
ORACLES = _oracles()
