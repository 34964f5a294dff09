from textquarry.operators import search


def test_paths_agree(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * j) % 11 - 5 + (i % 3 == j)) for j in range(64)], {j: float(1 + (i + j) % 4) for j in range(i % 5)}, "ab"[i % 7 == 0]) for i in range(120)] + [(500, None, None, "a")]
    df = spark.createDataFrame(rows, "id long, v array<float>, sparse map<int,float>, g string")
    asked = df.where("id % 3 = 0")
    few = sorted(map(tuple, search.dense_topk(asked, df, 7).collect()))
    sparse = sorted(map(tuple, search.sparse_topk(asked, df, 7).collect()))
    for name, value in (("FEW_QUERIES", 0), ("DATA_BLOCK", 30), ("QUERY_BLOCK", 8), ("FEW_TERMS", 0)):
        monkeypatch.setattr(search, name, value)
    assert sorted(map(tuple, search.dense_topk(asked, df, 7).collect())) == few and len(few) == 280
    assert sorted(map(tuple, search.sparse_topk(asked, df, 7).collect())) == sparse
    group = {r["id"]: r["g"] for r in df.collect()}
    inner = search.dense_topk(asked, df, 3, "g").collect()
    assert inner and all(group[r["query"]] == group[r["item"]] for r in inner)
    assert search.dense_topk(df.limit(0), df).count() == 0 and search.dense_topk(asked, df.limit(0)).count() == 0


def test_ties_go_to_the_lower_id(spark):
    same = [1.0] * 64
    df = spark.createDataFrame([(i, same) for i in range(40)], "id long, v array<float>")
    got = sorted((r["rank"], r["item"]) for r in search.dense_topk(df.where("id = 5"), df, 4).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3)]
