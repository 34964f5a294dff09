from textquarry.llm import glyphs


def test_equal_looking_values_come_out_equal(spark):
    rows = [(i, "text", "деталь по СТО 98362-87, твёрдость 173 HB для стали") for i in range(20)]
    rows += [(20, "text", "деталь по CTO 98362-87, твёрдость 173 НВ для стали"), (21, "designation", "CTO 98362−87"), (22, "designation", "СТО 98362‑87"), (23, "designation", "ГОСТ 77920—99"), (24, "text", "сталь — сплав"), (25, "designation", None), (26, "text", ""), (27, "text", "C​TO 98362-87")]
    df = spark.createDataFrame(rows, "id long, field string, value string")
    got = {r["id"]: r["canonical"] for r in glyphs.canonical_values(df, ["id"], "value", "field <> 'text'", "field = 'designation'").collect()}
    assert len(got) == 28 and got[20] == got[0] == rows[0][2]
    assert got[21] == got[22] == "сто 98362-87" and got[23] == "гост 77920-99"
    assert got[24] == "сталь — сплав" and got[25] is None and got[26] == "" and got[27] == "СТО 98362-87"
