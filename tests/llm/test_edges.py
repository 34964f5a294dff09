"""Empty tables, null columns, ties and repeats, and extra columns whose names clash with inner ones."""

from pyspark.sql import functions as F

from textquarry.llm import glyphs, leakage, mixing, neardup, neighbours, quality, scans, splitting

CLASH = ("rep", "token", "h", "pos", "w", "n", "cell", "key", "answers", "form", "part", "block", "share")


def clashing(df):
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def test_scans(spark):
    schema = "tab string, row_id long, page boolean, first int, last int, text string, from_ocr boolean, doc_id string"
    assert scans.read_scans(spark.createDataFrame([], schema)).count() == 0
    rows = [("p", 1, True, None, None, None, True, None), ("p", 2, True, None, None, "", None, "a"), ("p", 3, True, 1, None, "\n\n", True, None), ("p", 4, None, None, None, "вал и кольцо", True, "a"), ("p", 4, True, 2, 2, "x" * 20000, True, "a")]
    got = {(r["row_id"], len(r["repaired"])) for r in scans.read_scans(clashing(spark.createDataFrame(rows, schema))).collect()}
    assert (4, 20000) in got and (3, 0) in got and {i for i, _ in got} == {3, 4}


def test_glyphs(spark):
    empty = spark.createDataFrame([], "id long, value string")
    assert glyphs.disguised_rows(empty, ["id"], "value").count() == 0 and glyphs.canonical_values(empty, ["id"], "value").count() == 0
    rows = [(1, None), (2, ""), (3, "х" * 100_000), (4, "дeталь"), (5, "дeталь")]
    df = clashing(spark.createDataFrame(rows, "id long, value string"))
    assert sorted(r["id"] for r in glyphs.disguised_rows(df, ["id"], "value").collect()) == [4, 5]
    assert {r["id"]: r["canonical"] and len(r["canonical"]) for r in glyphs.canonical_values(df, ["id"], "value").collect()} == {1: None, 2: "", 3: 100_000, 4: 6, 5: 6}


def test_neighbours(spark):
    one = [1.0] + [0.0] * 63
    df = clashing(spark.createDataFrame([(i, one) for i in range(30)] + [(99, None), (100, [None] * 64), (101, [float("inf")] * 64)], "id long, v array<float>"))
    got = neighbours.nearest(df, k=3).collect()
    assert len(got) == 90 and {(r["query"], r["neighbour"]) for r in got if r["query"] == 7} == {(7, 0), (7, 1), (7, 2)} and {r["neighbour"] for r in got if r["query"] == 0} == {1, 2, 3}


def test_splitting(spark):
    schema = "tab string, row_id long, text string, table_header string"
    assert splitting.split_oversized(spark.createDataFrame([], schema)).count() == 0
    df = clashing(spark.createDataFrame([("b", 1, None, None), ("b", 2, "", "h"), ("b", 3, "а" * 5000, ""), ("b", 3, "а" * 5000, None)], schema))
    got = splitting.split_oversized(df).collect()
    assert {r["row_id"] for r in got} == {3} and all(r["tokens"] <= 400 for r in got) and sum(r["end"] - r["start"] for r in got) == 10000


def test_near_duplicates(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert neardup.similar_pairs(empty, neardup.classes(empty), "words", 0.6).count() == 0
    short = spark.createDataFrame([(1, "a"), (2, "b c"), (3, None)], "id long, text string")
    assert neardup.similar_pairs(short, neardup.classes(short), "words", 0.6).count() == 0
    a = " ".join(f"с{i}" for i in range(30))
    df = clashing(spark.createDataFrame([(1, a), (2, a), (3, a + " ещё"), (4, None), (5, ""), (6, "с1 с2"), (7, a.upper())], "id long, text string"))
    members = neardup.classes(df)
    assert [(r["a"], r["b"]) for r in neardup.similar_pairs(df, members, "words", 0.6).collect()] == [(1, 3)]
    assert {(r["id"], r["rep"]) for r in members.collect()} == {(1, 1), (2, 1), (7, 1), (3, 3), (5, 5), (6, 6)}


def test_hot_tokens_lose_no_link(spark, monkeypatch):
    """A token of more records than a block is cut into blocks, and every pair of blocks meets."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = [" ".join(["общий"] * 3 + [f"а{i // 3}б{j}" for j in range(12)] + [f"в{i}"]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["a"], r["b"]) for r in neardup.similar_pairs(df, neardup.classes(df), "words", 0.6).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if a // 3 == b // 3}


def test_leaks_and_shapes(spark):
    docs = clashing(spark.createDataFrame([(1, None), (2, ""), (3, "слово " * 3000)], "doc_id long, text string"))
    items = spark.createDataFrame([(1, None, None), (2, "", "")], "item_id long, question string, passage string")
    assert leakage.leaks(docs, items).count() == leakage.near_leaks(docs, items).count() == 0
    assert [r["doc_id"] for r in quality.text_shapes(docs).collect()] == [3]
    assert quality.text_shapes(docs.limit(0)).count() == 0 and quality.text_statistics(docs).count() == 3


def test_mix(spark):
    targets = spark.createDataFrame([(1, "a", 1.0, 2, 1.0), (1, None, 0.5, 1, 1.0)], "mix_id int, source string, target_share double, max_repeats int, corpus_multiple double")
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty, targets).count() == 0
    docs = clashing(spark.createDataFrame([(1, "текст", "a"), (2, "текст", "a"), (3, None, "a"), (4, "иной текст", None)], "doc_id long, text string, source string"))
    selection, total = mixing.mixed(docs, targets)
    row = mixing.shares(selection, targets, total).where("source = 'a'").first()
    assert selection.count() == 1 and row["filled"] <= 1 and row["most_repeats"] <= 2
