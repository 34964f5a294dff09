from textquarry.llm import leakage


def test_proximity_and_short_questions(spark):
    words = [f"слово{i}" for i in range(60)]
    items = spark.createDataFrame([(1, "Какой вал?", " ".join(words)), (2, None, None), (3, "вал", "короткий текст")], "item_id long, question string, passage string")
    changed = [w if i % 8 else "иначе" for i, w in enumerate(words)]
    inserted = [x for i, w in enumerate(words[:40]) for x in ([w, "лишнее"] if i % 9 == 8 else [w])]
    docs = [(1, "а " + " ".join(changed) + " б"), (2, " ".join(inserted)), (3, " ".join(words[:10])), (4, "Скажите, какой вал подойдёт"), (5, None), (6, ""), (7, " ".join(words[3:30])), (8, " ".join(" ".join(words[i : i + 6]) + " прочее" * 40 for i in range(0, 60, 6)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near = {r["doc_id"]: r for r in leakage.near_leaks(df, items).collect()}
    assert set(near) == {1, 2, 7} and near[7]["words"] == near[7]["span"] == 27 and 40 <= near[1]["words"] < near[1]["span"] <= 60
    exact = {(r["doc_id"], r["item_id"], r["kind"]) for r in leakage.leaks(df, items).collect()}
    assert exact == {(4, 1, "question"), (4, 3, "question"), (7, 1, "passage")}
    assert leakage.near_leaks(df.limit(0), items).count() == leakage.leaks(df, items.limit(0)).count() == 0


def test_stored_index_serves_other_items(spark, tmp_path):
    words = [f"слово{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[5:40])), (2, "прочее " + " ".join(words[30:60])), (3, None)], "doc_id long, text string")
    leakage.full_index(docs).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for lo, hi in ((0, 30), (20, 60)):
        items = spark.createDataFrame([(1, None, " ".join(words[lo:hi]))], "item_id long, question string, passage string")
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(leakage.leaks(docs, items, index=index)) == rows(leakage.leaks(docs, items)) != []
        assert rows(leakage.near_leaks(docs, items, index=index)) == rows(leakage.near_leaks(docs, items)) != []
