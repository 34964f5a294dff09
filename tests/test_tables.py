from pyspark.sql import functions as F

from textquarry.operators import structure, tables


def test_numbers_of_tables_by_segments(spark):
    captions = ["Таблица 3", "Таблица?", "Продолжение табл.", "Таблица?", "Окончание таблицы 5. Размеры", "Таблица?", "Продолжение табл. ?", "Т а б л и и а б", "Таблица 0", "Текст", "Таблица ?"]
    rows = [(n, "d", n, c + "\n| a |", "table") for n, c in enumerate(captions)] + [(50, "e", 0, "Продолжение табл.", "table"), (51, "e", 1, "Таблица", " Table "), (52, "e", 2, "Таблица 9", "text"), (53, "e", 3, None, None)]
    df = spark.createDataFrame(rows, "block_id long, doc_id string, block_seq int, text string, kind string")
    for segment in (1, 2, 3, 100):
        got = {r["block_id"]: (r["number"], r["label"]) for r in tables.numbered_tables(df, segment).collect()}
        assert [got.get(n, (None,))[0] for n in range(len(captions))] == [3, 4, 4, 5, 5, 6, 6, 6, None, None, 7]
        assert got[4][1] == "Окончание табл. 5 Размеры" and got[51] == (1, "Таблица 1") and set(got) & {50, 52, 53} == set()


def test_carry_by_segments(spark):
    rows = [("d", n, "x" if n in (3, 11) else None) for n in range(20)] + [("e", 0, None)]
    df = spark.createDataFrame(rows, "doc_id string, block_seq int, v string").withColumn("w", F.when(F.col("v").isNotNull(), F.concat("v", F.col("block_seq").cast("string"))))
    for segment in (1, 4, 100):
        got = {(r["doc_id"], r["block_seq"]): r["carried"] for r in structure.last_before(df, F.col("w"), segment).collect()}
        assert got["d", 3] is None and got["d", 4] == "x3" and got["d", 11] == "x3" and got["d", 19] == "x11" and got["e", 0] is None
        places = {(r["doc_id"], r["block_seq"]): r["nth"] for r in structure.numbered(df.where("block_seq <> 7"), segment).collect()}
        assert places["d", 6] == 7 and places["d", 8] == 8 and places["e", 0] == 1


def test_notes_are_no_clauses(spark):
    texts = ["1 Общие сведения", "Примечания:", "1. Первое замечание", "2. Второе замечание", "4 Приёмка изделия", "3. Хранение вала", "П р и м с ч а н и я", "1 Третье замечание", "| 2 | 3 |", "2 Испытание вала"]
    df = spark.createDataFrame([("d", 3 * n, t, "table" if t.startswith("|") else None) for n, t in enumerate(texts)], "doc_id string, block_seq int, text string, kind string")
    got = {r["block_seq"] // 3: r["clause"] for r in structure.clause_candidates(df).collect()}
    assert got == {0: "1", 4: "4", 5: "3", 9: "2"}


def test_repeated_lines_stay_inside(spark):
    body = "\n".join(f"строка тела {c}" for c in "абвгдежз")
    page = lambda n: f"ГОСТ 70001-83 С. {n}\n{body}\nГОСТ 70001-83 С. 9\n{body}\nВ миллиметрах"
    pages = spark.createDataFrame([(n, "d", page(n)) for n in range(1, 6)] + [(9, "e", page(1)), (10, "e", None)], "page_id long, doc_id string, text string")
    got = {r["page_id"]: r["text"] for r in structure.strip_repeated(pages, structure.repeated_lines(pages)).collect()}
    assert got[2].count("ГОСТ 70001-83") == 1 and got[2].endswith("В миллиметрах") and got[9].count("ГОСТ") == 2 and 10 not in got


def test_grids(spark):
    grid = [["Обозначение", "Размеры", "Размеры\nмм"], ["Обозначение", "d", "L"], ["А1", "1,5", "20"], ["", "", None], ["А2", "2,5", "−3"]]
    df = spark.createDataFrame([(1, grid), (2, [["а", "б"]]), (3, [["x", ""], ["", ""]]), (4, [])], "id long, grid array<array<string>>")
    r = tables.table_rows(df).collect()
    assert [(x["id"], x["header"], x["body"]) for x in r] == [(1, ["Обозначение", "Размеры / d", "Размеры мм / L"], [["А1", "1,5", "20"], ["А2", "2,5", "−3"]])]
    assert spark.createDataFrame([([["a|b", None], [None, ""], ["c"]],)], "g array<array<string>>").select(tables.markdown(F.col("g"))).first()[0] == "| a|b |  |\n| --- | --- |\n| c |  |"
    assert spark.createDataFrame([([],)], "g array<array<string>>").select(tables.markdown(F.col("g"))).first()[0] == ""


def test_references(spark):
    df = spark.createDataFrame([("По габл. 3, 4 и в таблице 7—9; см. табл. 12-50.",), ("нет",), (None,)], "t string")
    assert [r[0] for r in df.select(tables.references(F.col("t"))).collect()] == [[3, 4, 7, 8, 9, 12], [], None]
