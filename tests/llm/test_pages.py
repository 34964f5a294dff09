from textquarry.llm import scans


def test_words_cut_between_pages(spark):
    def body(n: int) -> list[str]:
        w = "абвгдежзиклмнопрстуфхцчшщэюя"[n % 28] + "ол" + "бвгдж"[n % 5] + "а"
        return [f"Муфта {w} стального вала должна иметь кольцо и опору,", f"если зазор {w} не более 5 мм, а опору проверяет изготовитель.", f"Зазор стального вала {w} проверяет изготовитель {w} муфты."]

    head = lambda n: f"ГОСТ 70001-83 С. {n}"
    rows = [("page_docs", 100 + n, n, "\n".join([head(n), *body(n)]), True, "x") for n in range(1, 40)]
    pages = {1: "Изготовитель проверяет зазор и опо-", 2: "ру. Зазор проверяет изгото-\n2", 3: "вмтель муфты. Зазор проверяет кольцо-", 4: "Муфта стального вала", 6: "Муфта стального ва-"}
    rows += [("page_docs", n, n, f"{head(n)}\n{t}", True, "a") for n, t in pages.items()]
    rows += [("page_docs", 12, 2, f"{head(2)}\n{pages[2]}", True, "a"), ("page_docs", 20, 1, "Зазор муфты и опо-", False, "b"), ("page_docs", 21, 2, f"{head(2)}\nру проверяет изготовитель", True, "b")]
    df = spark.createDataFrame(rows, "tab string, row_id long, first int, text string, from_ocr boolean, doc_id string").selectExpr("*", "true AS page", "first AS last")
    got = {r["row_id"]: r for r in scans.read_scans(df).collect()}
    assert len(got) == 39 + 7
    flaws = {i: {(f["line_no"], f["flaw"]) for f in got[i]["flaws"]} - {(1, "furniture")} for i in (1, 2, 12, 3, 4, 6, 21)}
    assert got[1]["repaired"] == "Изготовитель проверяет зазор и опору."
    assert got[2]["repaired"] == got[12]["repaired"] == "Зазор проверяет изготовитель"
    assert got[3]["repaired"] == "муфты. Зазор проверяет кольцо-" and got[21]["repaired"] == "ру проверяет изготовитель"
    assert flaws[1] == {(2, "break")} and flaws[2] == flaws[12] == {(2, "break"), (3, "furniture")}
    assert flaws[3] == {(2, "misread")} and flaws[4] == flaws[21] == set() and flaws[6] == {(2, "break")}
