from pyspark.sql import functions as F

from textquarry.llm import glyphs


def test_found_is_what_differs_from_its_form(spark):
    """Every value found differs from its canonical form and no other does; variants by dash, script and width come out equal."""
    base = ["ГОСТ 5264-80", "СТО 98362-87"]
    odd = ["ГОСТ 5264–80", "ГОСТ 5264−80", "ГОСТ 5264‑80", "ГOСТ 5264-80", "ГОСТ ５264-80", "ГОСТ 5264-80", "ГОСТ​ 5264-80", "CTO 98362-87", "ГОСТ 5264­-80", "ГОСТ 5264-80\U000e0020"]
    texts = ["На поверхности вала"] * 9 + ["Ha поверхности вала", "Прямой й угол", "Прямой угол", "см² и 5 °C — так", "tab\tи\r\nконец", "", None, "Straße"]
    rows = [("d", i, t) for i, t in enumerate(base * 8 + odd)] + [("t", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "f string, id long, v string").withColumn("extra", F.lit(1))
    found = {tuple(r) for r in glyphs.disguised_rows(df, ["f", "id"], "v", "f = 'd'").collect()}
    forms = {(r["f"], r["id"]): (r["canonical"], r["folded"]) for r in glyphs.canonical_values(df, ["f", "id"], "v", dash="f = 'd'").collect()}
    differ = {(f, i) for f, i, t in rows if t is not None and forms[f, i][0] != glyphs.plain_breaks(t)}
    assert found == differ
    assert {("d", 16 + n) for n in range(len(odd))} <= found and {i for f, i in found if f == "t"} == {9, 11}
    assert {forms["d", i][0] for i in range(16 + len(odd))} == set(base)
    assert forms["t", 16][1] == "strasse" and forms["t", 12][1] == "см2 и 5 °c — так" and forms["t", 15] == (None, None) and forms["t", 14] == ("", "")
