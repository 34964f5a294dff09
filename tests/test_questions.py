from pyspark.sql import functions as F

from textquarry.operators import answers, evaluation, metadata, questions


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_designations(spark):
    loose = lambda t: one(spark, t, metadata.find_designations)
    assert loose("Что по ГОСТу 6010 и гост р исо 7020-2011, а также ГОСТа 6010?") == ["ГОСТ 6010", "ГОСТ Р ИСО 7020-2011"]
    assert loose("СНиП 2.04-88, ост 5-1; АГОСТ 7") == ["СНИП 2.04-88", "ОСТ 5"] and loose("") == [] and loose(None) is None
    strict = lambda t: one(spark, t, metadata.find_designation)
    assert strict("см. гост  р iso/iec 12.5 — 99 и др.") == "ГОСТ Р ИСО/МЭК 12.5-99" and strict("РД 60-44-92") == "РД 60-44" and strict("ГОСТ 15") is None and strict("МГОСТ 1-90") is None
    assert one(spark, "снип 2-88", metadata.doc_type) == "СНиП" and one(spark, "стп 4", metadata.doc_type) == "СТП"
    assert [one(spark, s, metadata.coerce_status) for s in ("Действующая", "отмененный", "Заменена", "\tЗаменён ", "иное", None)] == ["действующий", "отменён", "заменён", "заменён", "неизвестно", "неизвестно"]


def test_resolution(spark):
    available = spark.createDataFrame([("ГОСТ 8-80", "a"), ("ГОСТ 8-2019", "b"), ("РД 60-44-92", "c"), (None, "d")], "designation string, title string")
    asked = spark.createDataFrame([(1, "по ГОСТ 8"), (2, "ГОСТ 8-90 и РД 60-44"), (3, "ГОСТ 9-77"), (4, "просто вопрос"), (5, None)], "id long, question string")
    got = {r["id"]: (r["matched"], r["missing"], r["alternatives"], r["only_missing"]) for r in questions.resolution(asked, available).collect()}
    assert got[1] == (["ГОСТ 8-2019", "ГОСТ 8-80"], [], [], False)
    assert got[2] == (["РД 60-44-92"], ["ГОСТ 8-90"], [["ГОСТ 8-2019", "ГОСТ 8-80"]], False)
    assert got[3] == ([], ["ГОСТ 9-77"], [[]], True) and got[4] == got[5] == ([], [], [], False)


def test_answer_rules(spark):
    def correct(answer, expected):
        return spark.createDataFrame([(answer, expected)], "a string, e array<array<string>>").select(answers.answer_is_correct(F.col("a"), F.col("e"))).first()[0]

    assert correct("длина 17 мм", [["7мм"]]) is False and correct("длина 7 мм", [["7мм"]]) is True and correct("0,7 мм", [["7мм"]]) is False
    assert correct("резьба М16, −5", [["M16"], ["-5"]]) is True and correct("1.234", [["1,234"]]) is True and correct("x", [[""]]) is True and correct("x", []) is None
    none = lambda t: one(spark, t, answers.says_no_answer)
    assert none("Ответа  нет [S1].\n\nНо есть иное") and none("Данные о массе в разделе отсутствуют") and none("не указан") and not none("Вал.\n\nОтвета нет") and none(None) is None
    df = spark.createDataFrame([("по ГОСТ 7-99 не более -5,5 и 6.0, 6.0 [S1]", "5.5", "размер 6,0")], "a string, g string, h string")
    assert df.select(answers.ungrounded(F.col("a"), F.col("g"))).first()[0] == ["6.0"] and df.select(answers.ungrounded(F.col("a"), F.col("g"), F.col("h"))).first()[0] == []


def test_markers(spark):
    strip = lambda t, n: spark.createDataFrame([(t, n)], "t string, n int").select(questions.strip_invalid(F.col("t"), F.col("n"))).first()[0]
    assert strip("а [S1] б [S7] . в [S07]", 3) == "а [S1] б. в" and strip("[S2] x", 0) == "x"


def test_labels(spark):
    rows = [("Г", "d", "отменён", ["1", "1.2", "3"], None, 1, 4), (None, "d", "неизвестно", [], "7", 2, 2), ("", None, None, None, "", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, e array<string>, f string, g int, h int")
    assert [r[0] for r in df.select(questions.citation_label(*(F.col(c) for c in "abcefgh"))).collect()] == ["Г (отменён), пп. 1–3, стр. 1–4", "d, п. 7, стр. 2", "документ"]


def test_refusal_order(spark):
    df = spark.createDataFrame([(["x"], 0, False), ([], 0, False), ([], 0, True), (["x"], 3, True)], "m array<string>, n int, p boolean")
    assert [r[0] for r in df.select(questions.refusal_reason(F.col("m"), F.col("n"), F.col("p"))).collect()] == ["missing_designation", "weak_dense_match", "no_candidates", "below_rerank_threshold"]


def test_prompts_and_choice(spark):
    rows = [("t", n, "user" if n % 2 else "assistant", f"c{n} [S1] .") for n in range(1, 8)]
    df = spark.createDataFrame(rows, "thread string, nth long, role string, content string")
    assert [(r["nth"], r["content"]) for r in questions.prompts(df, 1).orderBy("nth").collect()] == [(5, "c5 [S1] ."), (6, "c6.")]
    assert questions.prompts(df, 0).count() == 0
    asked = spark.createDataFrame([("t", "c7?", "[S1] фрагмент")], "thread string, question string, context string")
    full = [(r["nth"], r["role"], r["content"]) for r in questions.conversations(asked, df, "правила", 1).orderBy("nth").collect()]
    assert [(n, r) for n, r, _ in full] == [(1, "system"), (2, "user"), (3, "assistant"), (4, "user")] and full[3][2].endswith("[S1] фрагмент\n\nВОПРОС: c7?")
    hits = spark.createDataFrame([(1, 10, 2, 1), (1, 11, 5, 2), (1, 12, 1, 3)], "id long, chunk_id long, score long, rank int")
    sizes = spark.createDataFrame([(1, 10)], "id long, size int")
    assert [(r["chunk_id"], r["place"], r["best_score"]) for r in questions.selected(hits, sizes, threshold=0.2).orderBy("place").collect()] == [(11, 1, 0.5), (10, 2, 0.5)]
    assert [r["chunk_id"] for r in questions.selected(hits, sizes, candidates=0, top=2).orderBy("place").collect()] == [10, 11]


def test_ranks_by_edition_and_clause(spark):
    gold = spark.createDataFrame([(1, "ГОСТ 8", "4.1"), (2, "ГОСТ 8-80", None), (3, None, "1")], "id long, gold_designation string, gold_section string")
    hits = spark.createDataFrame([(1, 1, "ГОСТ 8-80", ["4.12"], None), (1, 2, "ГОСТ 8-80", ["3", "4.1.3"], None), (2, 1, "ГОСТ 8-2019", [], "1"), (3, 1, None, [], "1")], "id long, rank int, designation string, sections array<string>, section string")
    got = {r["id"]: (r["rank"], r["section_rank"]) for r in evaluation.first_ranks(gold, hits).collect()}
    assert got == {1: (1, 2), 2: (None, None), 3: (None, None)}


def test_gates_without_questions_are_null(spark):
    r = spark.createDataFrame([(1, False, "tune", False, 0.4), (2, False, "tune", True, 0.9), (3, False, "tune", False, None)], "id long, out boolean, split string, only_missing boolean, score double")
    t = spark.createDataFrame([(0.4,)], "threshold double")
    x = evaluation.gate_table(r, t).first()
    assert (x["answered_in"], x["total_in"], x["refusal_rate"], x["balanced"]) == (1, 3, None, None) and x["answer_rate"] == 0.333333
