from textquarry.operators import packing
from textquarry.registry import queries


def test_packs_span_pages(spark):
    texts = [(500, 1), (60, 1), (400, 2), (330, 3), (30, 4)]  # tokens, page
    blocks = [("a", n, page, "text", f"{n}", chr(97 + n) * 3 * size) for n, (size, page) in enumerate(texts)]
    blocks += [("b", 0, 1, "text", None, "x" * 2400 + "yyy"), ("b", 1, 1, "text", "", "x y"), ("c", 0, 1, "text", None, " \n"), ("c", 1, 1, None, None, None)]
    df = spark.createDataFrame(blocks, "doc_id string, block_seq int, page_no int, kind string, section string, text string")
    pieces = packing.prepared(df)
    got = sorted(tuple(r) for r in packing.packs(pieces).collect())
    assert [x for x in got if x[0] == "a"] == [("a", 0, 0, 0, "own"), ("a", 0, 1, 0, "own"), ("a", 1, 1, 0, "carried"), ("a", 1, 2, 0, "own"), ("a", 1, 3, 0, "own"), ("a", 1, 4, 0, "tail")]
    assert [x for x in got if x[0] == "b"] == [("b", 0, 0, 0, "own"), ("b", 0, 0, 1, "tail"), ("b", 0, 1, 0, "tail")]
    pages = spark.createDataFrame([(1, "a", 1, True, 0.5), (2, "a", 2, True, 0.8), (3, "a", 4, True, 0.1), (4, "b", 1, False, 0.9)], "page_id long, doc_id string, page_no int, from_ocr boolean, ocr_confidence double")
    chunks = {(r["doc_id"], r["chunk_index"]): r for r in packing.rollup(pieces, packing.packs(pieces), pages).collect()}
    a, b = chunks["a", 1], chunks["b", 0]
    assert (a["page_start"], a["page_end"], a["token_count"], a["section"], a["sections"]) == (1, 4, 820, "2", ["1", "2", "3", "4"])
    assert a["text"] == "\n\n".join(chr(97 + n) * 3 * texts[n][0] for n in range(1, 5))
    assert (a["from_ocr"], a["ocr_confidence"], chunks["a", 0]["ocr_confidence"]) == (True, 0.65, 0.5)
    assert (b["from_ocr"], b["ocr_confidence"], b["section"], b["sections"]) == (False, None, None, []) and set(chunks) == {("a", 0), ("a", 1), ("b", 0)}


def test_split_rows():
    row = "| " + "x" * 100 + " |"
    parts = packing.split_rows("\n".join(["Таблица 1", "| a |", "|---|", *[row] * 50]))
    assert len(parts) > 1 and all(p.startswith("Таблица 1\n| a |\n|---|\n") for p in parts) and sum(p.count(row) for p in parts) == 50


def test_fold_passes_from_batch_to_batch(spark):
    df = spark.range(3000).selectExpr("'hot' AS doc_id", "cast(id AS int) AS block_seq", "0 AS piece", "cast(1 + id % 97 AS int) AS cost")
    whole = packing.packs(df).collect()
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(packing.packs(df).collect()) == sorted(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_registered():
    assert {"document_pack", "chunk_rollup"} <= set(queries())
