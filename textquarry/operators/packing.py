"""Chunks packed over whole documents: oversized blocks cut, greedy packing with overlap, short tails merged, roll-up."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import approx_tokens
from textquarry.session import table

#: Tokens of a chunk, of its overlap with the one before, and of the least chunk at the end of a document.
BUDGET, OVERLAP, LEAST = 800, 80, 50
_RULE = re.compile(r"[|\-: ]+")


def _tokens(text: str) -> int:
    return max(1, len(text) // 3)


def split_rows(text: str, most: int = BUDGET) -> list[str]:
    """A table in parts of whole rows, each with everything up to the separator row; a row over ``most`` stays whole."""
    lines = text.split("\n")
    rule = next((i for i, x in enumerate(lines[:6]) if x.strip() and _RULE.fullmatch(x.strip())), 0)
    header = lines[: rule + 1] if rule and len(lines) > rule + 1 else []
    lead = _tokens("\n".join(header)) if header else 0
    parts, current, filled = [], [], lead
    for line in lines[len(header) :]:
        cost = _tokens(line)
        if current and filled + cost > most:
            parts.append("\n".join([*header, *current]))
            current, filled = [], lead
        current.append(line)
        filled += cost
    return [*parts, "\n".join([*header, *current])]


def prepared(blocks: DataFrame, most: int = BUDGET) -> DataFrame:
    """Blocks with ``piece`` and ``cost``: those over ``most`` tokens cut, tables by rows and texts by size; blank ones left out."""
    is_table = F.coalesce(F.lower(F.trim("kind")) == "table", F.lit(False))
    rows = blocks.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "block_seq", F.lit(0).alias("piece"), "page_no", "section", is_table.alias("is_table"), "text")
    size = approx_tokens(F.col("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [split_rows(t, most) if is_t else [t[i : i + 3 * most] for i in range(0, len(t), 3 * most)] for t, is_t in zip(batch["text"], batch["is_table"])]
            batch["piece"] = [list(range(len(x))) for x in batch["text"]]
            yield batch.explode(["piece", "text"])

    large = rows.where(size > most).mapInPandas(cut, rows.schema)
    return rows.where(size <= most).unionByName(large).withColumn("cost", size)


def packs(pieces: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """``doc_id, chunk_index, block_seq, piece, role``: the chunks that each piece of a document lies in.

    ``role`` is ``own``, ``carried`` (overlap from the chunk before) or ``tail`` (of a
    chunk under ``least`` tokens, merged into the one before).  The fold reads keys and
    costs alone, a document in order; its state of at most one chunk passes from one
    Arrow batch to the next, so a document of any size is folded in ordered segments.
    """
    if overlap >= budget:
        raise ValueError(f"overlap {overlap} must be less than the budget {budget}")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, index, current, filled, carried = None, 0, [], 0, 0
        out: list[tuple] = []

        def close(last: bool) -> None:
            tail = last and index > 0 and filled < least
            for n, (seq, piece, _) in enumerate(current):
                if n >= carried:
                    out.append((doc, index - 1, seq, piece, "tail") if tail else (doc, index, seq, piece, "own"))
                elif not tail:
                    out.append((doc, index, seq, piece, "carried"))

        for batch in batches:
            for doc_id, seq, piece, cost in batch.itertuples(index=False):
                if doc_id != doc:
                    close(True)
                    doc, index, current, filled, carried = doc_id, 0, [], 0, 0
                if current and filled + cost > budget:
                    close(False)
                    most, at, total = min(overlap, budget - cost), len(current), 0
                    while at > 1 and total + current[at - 1][2] <= most:
                        at -= 1
                        total += current[at][2]
                    index, current, filled, carried = index + 1, current[at:], total, len(current) - at
                current.append((seq, piece, cost))
                filled += cost
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "block_seq", "piece", "role"])
            out.clear()
        close(True)
        yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "block_seq", "piece", "role"])

    ordered = pieces.select("doc_id", "block_seq", "piece", "cost").repartition("doc_id").sortWithinPartitions("doc_id", "block_seq", "piece")
    return ordered.mapInPandas(fold, "doc_id string, chunk_index int, block_seq int, piece int, role string")


def rollup(pieces: DataFrame, assigned: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a chunk: text, pages, tokens, sections, tables and the mean confidence of the scanned pages of its blocks.

    A tail whose text the chunk holds already adds nothing; the section is that of the chunk's own pieces.
    """
    scanned = pages.where("from_ocr").groupBy("doc_id", "page_no").agg(F.min_by("ocr_confidence", "page_id").alias("conf")).withColumn("ocr", F.lit(True))
    rows = assigned.join(pieces, ["doc_id", "block_seq", "piece"]).join(scanned, ["doc_id", "page_no"], "left")
    # confidences as whole ten-thousandths, so that the mean doesn't depend on the order
    fields = F.struct("block_seq", "piece", "role", "text", F.when(F.col("section") != "", F.col("section")).alias("section"), "page_no", "cost", "is_table", F.coalesce("ocr", F.lit(False)).alias("ocr"), F.round(F.col("conf") * 10000).cast("long").alias("conf"))
    chunks = rows.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(fields)).alias("every"))
    chunks = chunks.withColumn("body", F.filter("every", lambda x: x["role"] != "tail")).withColumn("tail", F.filter("every", lambda x: x["role"] == "tail"))
    chunks = chunks.withColumn("body_text", F.regexp_replace(F.array_join("body.text", "\n\n"), r"(?U)\A\s+|\s+\z", "")).withColumn("tail_text", F.array_join("tail.text", "\n\n"))
    kept = (F.size("tail") > 0) & ~F.expr("contains(body_text, tail_text)")
    chunks = chunks.withColumn("held", F.when(kept, F.concat("body", "tail")).otherwise(F.col("body"))).withColumn("text", F.when(kept, F.concat_ws("\n\n", "body_text", "tail_text")).otherwise(F.col("body_text")))
    sections = F.array_distinct(F.array_compact("held.section"))
    own = F.array_compact(F.transform(F.filter("body", lambda x: x["role"] == "own"), lambda x: x["section"]))
    conf = F.array_compact("body.conf")
    total = F.aggregate(conf, F.lit(0).cast("long"), lambda a, x: a + x)
    return chunks.select(
        "doc_id", "chunk_index", "text", F.array_min("held.page_no").alias("page_start"), F.array_max("held.page_no").alias("page_end"),
        F.aggregate("held.cost", F.lit(0), lambda a, x: a + x).alias("token_count"), F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at(sections, F.lit(1))).alias("section"), sections.alias("sections"),
        F.exists("held", lambda x: x["is_table"]).alias("contains_table"), F.exists("body", lambda x: x["ocr"]).alias("from_ocr"),
        F.when(F.size(conf) > 0, F.floor((2 * total + 100 * F.size(conf)) / (200 * F.size(conf))) / 100).alias("ocr_confidence"),
    )


def q_document_pack(spark, sf):
    return packs(prepared(table(spark, sf, "blocks")))


def q_rollup(spark, sf):
    pieces = prepared(table(spark, sf, "blocks"))
    chunks = rollup(pieces, packs(pieces), table(spark, sf, "page_docs"))
    return chunks.select("doc_id", "chunk_index", "page_start", "page_end", "token_count", "section", F.array_join("sections", ",").alias("sections"), "contains_table", "from_ocr", "ocr_confidence", F.sha2("text", 256).alias("text_hash"))


_PACK = r"""b AS (SELECT doc_id, block_seq, page_no, section, coalesce(lower(trim(kind)) = 'table', false) AS is_table, text, greatest(1, length(text) // 3)::INT AS c FROM blocks WHERE regexp_matches(text, '\S')),
 t AS (SELECT *, string_split(text, E'\n') AS ls FROM b WHERE c > 800 AND is_table),
 r AS (SELECT *, list_position(list_transform(ls[1:6], lambda x: regexp_full_match(trim(x), '[|:\- ]+')), true) AS rule FROM t),
 h AS (SELECT *, CASE WHEN rule >= 2 AND len(ls) > rule THEN rule ELSE 0 END AS head FROM r),
 d AS (SELECT *, ls[head + 1:] AS body, CASE WHEN head > 0 THEN greatest(1, length(array_to_string(ls[1:head], E'\n')) // 3) ELSE 0 END::BIGINT AS lead FROM h),
 g AS (SELECT *, list_reduce(list_transform(body, lambda x: greatest(1, length(x) // 3)::BIGINT), lambda a, x: {'filled': CASE WHEN len(a.out) > 0 AND a.filled + x > 800 THEN lead + x ELSE a.filled + x END, 'p': a.p + CASE WHEN len(a.out) > 0 AND a.filled + x > 800 THEN 1 ELSE 0 END, 'out': list_append(a.out, a.p + CASE WHEN len(a.out) > 0 AND a.filled + x > 800 THEN 1 ELSE 0 END)}, {'filled': lead, 'p': 0::BIGINT, 'out': []::BIGINT[]}).out AS parts FROM d),
 u AS (SELECT doc_id, block_seq, page_no, section, is_table, ls[1:head] AS head, unnest(body) AS line, unnest(parts) AS piece, generate_subscripts(body, 1) AS n FROM g),
 p AS (SELECT doc_id, block_seq, 0 AS piece, page_no, section, is_table, text FROM b WHERE c <= 800
   UNION ALL SELECT doc_id, block_seq, piece, page_no, section, is_table, substr(text, (piece * 2400 + 1)::BIGINT, 2400) FROM (SELECT *, unnest(range((length(text) - 1) // 2400 + 1)) AS piece FROM b WHERE c > 800 AND NOT is_table)
   UNION ALL SELECT doc_id, block_seq, piece, any_value(page_no), any_value(section), any_value(is_table), array_to_string(list_concat(any_value(head), list(line ORDER BY n)), E'\n') FROM u GROUP BY 1, 2, 3),
 i AS (SELECT doc_id, block_seq, piece::INT AS piece, page_no, section, is_table, text, greatest(1, length(text) // 3)::INT AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq, piece) AS i FROM p),
 l AS (SELECT doc_id, count(*) AS n, list(cost ORDER BY i) AS cs, list(e ORDER BY i) AS es FROM (SELECT *, sum(cost) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM i) GROUP BY 1),
 k AS (SELECT doc_id, 0 AS ch, 1::BIGINT AS s, 1::BIGINT AS f, coalesce(list_filter(range(2, n + 1), lambda x: es[x] > 800)[1] - 1, n) AS z FROM l
   UNION ALL SELECT doc_id, ch + 1, s2, z + 1, coalesce(list_filter(range(z + 2, n + 1), lambda x: es[x] - (es[s2] - cs[s2]) > 800)[1] - 1, n)
   FROM (SELECT k.doc_id, ch, z, n, cs, es, coalesce(list_filter(range(s + 1, z + 1), lambda j: es[z] - (es[j] - cs[j]) <= least(80, 800 - cs[z + 1]))[1], z + 1) AS s2 FROM k JOIN l ON k.doc_id = l.doc_id WHERE z < n)),
 w AS (SELECT k.*, z = n AND ch > 0 AND es[z] - (es[s] - cs[s]) < 50 AS tail FROM k JOIN l ON k.doc_id = l.doc_id),
 a AS (SELECT i.*, (CASE WHEN tail THEN ch - 1 ELSE ch END)::INT AS chunk_index, CASE WHEN tail THEN 'tail' WHEN i < f THEN 'carried' ELSE 'own' END AS role FROM w JOIN i ON w.doc_id = i.doc_id AND i BETWEEN s AND z AND (NOT tail OR i >= f))"""
QUERIES = {"chunk_pack": q_document_pack, "document_pack": q_document_pack, "chunk_rollup": q_rollup}
ORACLES = {
    "chunk_pack": f"WITH RECURSIVE {_PACK} SELECT doc_id, chunk_index, block_seq, piece, role FROM a",
    "document_pack": f"WITH RECURSIVE {_PACK} SELECT doc_id, chunk_index, block_seq, piece, role FROM a",
    "chunk_rollup": rf"""WITH RECURSIVE {_PACK},
 o AS (SELECT doc_id, page_no, arg_min_null(ocr_confidence, page_id) AS conf FROM page_docs WHERE from_ocr GROUP BY 1, 2),
 m AS (SELECT a.*, o.doc_id IS NOT NULL AS ocr, round(conf * 10000)::BIGINT AS conf FROM a LEFT JOIN o ON o.doc_id = a.doc_id AND o.page_no = a.page_no),
 x AS (SELECT doc_id, chunk_index, regexp_replace(string_agg(text, E'\n\n' ORDER BY i) FILTER (role <> 'tail'), '^\s+|\s+$', '', 'g') AS body, coalesce(string_agg(text, E'\n\n' ORDER BY i) FILTER (role = 'tail'), '') AS tail FROM m GROUP BY 1, 2),
 y AS (SELECT *, tail <> '' AND NOT contains(body, tail) AS kept FROM x),
 v AS (SELECT m.*, kept, body, tail FROM m JOIN y ON m.doc_id = y.doc_id AND m.chunk_index = y.chunk_index WHERE role <> 'tail' OR kept),
 q AS (SELECT doc_id, chunk_index, section, min(i) AS i FROM v WHERE section <> '' GROUP BY 1, 2, 3),
 z AS (SELECT doc_id, chunk_index, string_agg(section, ',' ORDER BY i) AS sections, arg_min(section, i) AS first_section FROM q GROUP BY 1, 2)
 SELECT v.doc_id, v.chunk_index, min(page_no) AS page_start, max(page_no) AS page_end, sum(cost)::INT AS token_count, coalesce(arg_min(section, i) FILTER (role = 'own' AND section <> ''), any_value(first_section)) AS section, coalesce(any_value(sections), '') AS sections,
 bool_or(is_table) AS contains_table, bool_or(ocr AND role <> 'tail') AS from_ocr, floor((2 * sum(conf) FILTER (role <> 'tail') + 100 * count(conf) FILTER (role <> 'tail')) / (200 * count(conf) FILTER (role <> 'tail'))) / 100 AS ocr_confidence,
 sha256(CASE WHEN any_value(kept) THEN any_value(body) || E'\n\n' || any_value(tail) ELSE any_value(body) END) AS text_hash
 FROM v LEFT JOIN z ON z.doc_id = v.doc_id AND z.chunk_index = v.chunk_index GROUP BY 1, 2""",
}
