import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import citation_ids, clause_number, clean_page_text, numbers, strip_citations
from textquarry.operators.answers import answer_is_correct, ungrounded
from textquarry.operators.corpus import upsert
from textquarry.operators.metadata import coerce_status, expand_year, overlay, resolve
from textquarry.operators.search import dense_topk, fuse, passes_gate
from textquarry.operators.structure import longest_chain
from textquarry.sources.files import docx_blocks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("подшип-\nник скольжения", "подшипник скольжения"), ("пуско-наладочный", "пуско-наладочный"), ("а    б\n\n\n\nв", "а б\n\nв"), ("\r\nа\xa0б\u202fв\u2007г", "а б в г"), ("", ""), (None, None),
        ("Т И П Ы  И  РАЗМЕРЫ", "ТИПЫ И РАЗМЕРЫ"), ("А Б", "А Б"), ("А Б ВГ", "А Б ВГ"), ("сбор\u00adка ва\u200bла", "сборка вала"),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, text, clean_page_text) == want


@pytest.mark.parametrize("line, want", [("4.7.2 Покрытие вала", "4.7.2"), ("8.3. Хранение", "8.3"), ("4.7.2", None), ("9 12,5 кг", None), (None, None)])
def test_clause(spark, line, want):
    assert one(spark, line, clause_number) == want


def test_citations(spark):
    assert one(spark, "а [S2] б [S1] в [S2]", citation_ids) == [2, 1]
    assert one(spark, "около 6 мм [S1] .", strip_citations) == "около 6 мм."
    assert one(spark, "от -5 до 9,026 и ±0.2", numbers) == ["-5", "9,026", "±0.2"]


def test_ungrounded(spark):
    df = spark.createDataFrame([("0.5 и 9,02", "0,5 мм, 9,026")], "a string, g string")
    assert df.select(ungrounded(F.col("a"), F.col("g"))).first()[0] == ["9,02"]


def test_answers(spark):
    df = spark.createDataFrame([("Не более 74.4 кН", [["74,4", "74.4"]]), ("x", [])], "a string, e array<array<string>>")
    assert [r[0] for r in df.select(answer_is_correct(F.col("a"), F.col("e"))).collect()] == [True, None]


def test_metadata(spark):
    assert one(spark, "93", expand_year) == 1993 and one(spark, "15", expand_year) == 2015
    assert one(spark, " Отменен\t", coerce_status) == "отменён" and one(spark, None, coerce_status) == "неизвестно"
    rows = spark.createDataFrame([("a", "действующий", "x", "t", "u"), ("b", "действующий", None, "t", None)], "key string, status string, replaced_by string, title string, source_url string")
    live = spark.createDataFrame([("a", "заменён", "", "", "v")], "key string, status string, replaced_by string, title string, source_url string")
    assert sorted(map(tuple, overlay(rows, live).collect())) == [("a", "заменён", None, "t", "v"), ("b", "действующий", None, "t", None)]
    m = spark.createDataFrame([("ГОСТ 6124-80",), ("ГОСТ 25816",)], "mention string")
    a = spark.createDataFrame([("ГОСТ 6124-2019",), ("ГОСТ 25816-2004",)], "designation string")
    got = {r["mention"]: (r["matched"], r["alternatives"]) for r in resolve(m, a).collect()}
    assert got == {"ГОСТ 6124-80": ("", "ГОСТ 6124-2019"), "ГОСТ 25816": ("ГОСТ 25816-2004", "")}


def test_search(spark):
    v = [float(i == 0) for i in range(64)], [float(i < 2) for i in range(64)], [float("nan")] * 64, None
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<float>")
    got = [(r["query"], r["item"], r["rank"]) for r in dense_topk(df, df).orderBy("query").collect()]
    assert got == [(0, 1, 1), (1, 0, 1)]
    lists = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query long, item long, rank int")
    assert [r["item"] for r in fuse(lists, lists).orderBy("rank").collect()] == [7, 8]
    gate = spark.createDataFrame([(0.46,), (0.7,), (None,)], "t double")
    assert [r[0] for r in gate.select(passes_gate("t", 0.55)).collect()] == [False, True, False]


def test_chain_and_upsert(spark):
    assert longest_chain(["1", "1.1", "12", "1.2", "2"]) == [0, 1, 3, 4] and longest_chain([]) == []
    old, new = (spark.createDataFrame(x, "doc_id string, v int") for x in ([("a", 1), ("b", 2)], [("a", 3)]))
    assert sorted(map(tuple, upsert(old, new).collect())) == [("a", 3), ("b", 2)]


def test_docx(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Текст</w:t></w:r></w:p></w:body></w:document>')
    files = spark.createDataFrame([("a.docx", bytearray(buffer.getvalue())), ("b.docx", bytearray(b"no zip"))], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"] is None) for r in docx_blocks(files).collect()}
    assert got == {"a.docx": ("Текст", True), "b.docx": (None, False)}
