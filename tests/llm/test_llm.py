import random

import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import glyphs, leakage, mixing, neardup, neighbours, quality, scans, splitting


def test_canonical():
    assert glyphs.canonical("ГOСT ５​") == "ГОСТ 5"
    assert glyphs.canonical("й IP54 мм²") == "й IP54 мм²"
    assert glyphs.canonical("") == "" and glyphs.folded("Straße") == "strasse"


def test_disguised(spark):
    rows = [(i, "твёрдость 173 HB для стали") for i in range(20)] + [(20, "дeйствует"), (21, "На поверхности"), (22, "Ha поверхности, на"), (23, None), (24, "")] + [(i, "На опоре") for i in range(30, 40)]
    df = spark.createDataFrame(rows, "id long, value string").withColumn("extra", F.lit(1))
    assert sorted(r["id"] for r in glyphs.disguised_rows(df, ["id"], "value").collect()) == [20, 22]
    assert glyphs.disguised_rows(df.limit(0), ["id"], "value").count() == 0


def test_split_round_trip():
    rng = random.Random(1)
    texts = ["x" * 5000, "слово " * 900, "Один. Два. " * 300, "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 400, "а" * 1202, "\n" * 3000]
    texts += ["".join(rng.choice("аб .,\n|") for _ in range(rng.randrange(1100, 4000))) for _ in range(30)]
    for t in texts:
        pieces = splitting.split_text(t)
        assert "".join(t[a:b] for a, b, _ in pieces) == t
        assert all(max(1, len(p) // 3) <= 400 for _, _, p in pieces)
    table = splitting.split_text(texts[3])
    assert all(p.startswith("| a | b |\n| --- | --- |") for _, _, p in table)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(300)}" for _ in range(40)] for _ in range(30)]
    rows = []
    for words in base:
        for _ in range(4):
            w = words[:]
            for _ in range(rng.randrange(4)):
                w[rng.randrange(40)] = f"e{rng.randrange(1000)}"
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), None, "", "one two"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    members = neardup.classes(df)
    got = {(r["a"], r["b"]) for r in neardup.similar_pairs(df, members, "words", 0.6).collect()}
    first = {}
    for i, t in enumerate(rows):
        if t is not None:
            first.setdefault(t.lower(), i)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t, i in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got == want and want
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 9, 11)], "rep long")
    assert {r["rep"]: r["component"] for r in neardup.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7, 11: 11}


def test_leaks(spark):
    passage = " ".join(f"слово{i}" for i in range(40))
    question = "сколько раз проверяют этот новый вал до сборки"
    items = spark.createDataFrame([(1, question, passage), (2, None, None)], "item_id long, question string, passage string")
    words = passage.split()
    docs = [(1, "а " + " ".join(words[3:22]).upper() + " б"), (2, " ".join(words[3:20])), (3, "В: " + question + "?"), (4, None), (5, " ".join(words[:10]) + " сло-\nво10 " + " ".join(words[11:20])), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["kind"]) for r in leakage.leaks(df, items).collect()}
    assert got == {(1, "passage"), (3, "question"), (5, "passage")}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 64))
    v[1], v[2] = v[0] + rng.normal(size=64) * 0.1, v[0]
    rows = [(i, [float(x) for x in u]) for i, u in enumerate(v)] + [(300, None), (301, [0.0] * 64), (302, [1.0] * 32), (303, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {}
    for r in neighbours.nearest(df, cell=64, probes=64).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {i: set(np.argsort(-s[i])[:10].tolist()) for i in range(300)}
    assert sum(len(got[i] & want[i]) for i in range(300)) >= 0.9 * 3000 and set(got) == set(range(300))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_mix(spark):
    flow = mixing.route({("a",): 100, ("a", "b"): 50}, {"a": 120, "b": 40}, {"a": 2, "b": 1})
    assert sum(f.get("a", 0) for f in flow.values()) == 120 and flow[("a", "b")].get("b", 0) == 40
    docs = spark.createDataFrame([(i, f"текст номер {i} " * 5, "a " if i % 3 else "B") for i in range(60)] + [(99, None, "a"), (98, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "a", 0.5, 1, 0.5), (1, "b", 0.5, 2, 0.5), (2, "none", 1.0, 1, 1.0)], "mix_id int, source string, target_share double, max_repeats int, corpus_multiple double")
    got = mixing.mix(docs, targets)
    assert got.agg(F.max("repeats")).first()[0] <= 2
    shares = {(r["mix_id"], r["source"]): r["actual_share"] for r in mixing.shares(got, targets).collect()}
    assert abs(shares[1, "a"] - 0.5) < 0.06 and shares[2, "none"] is None


def test_shapes(spark):
    prose = "Стальной вал хранят отдельно от медного кольца, если при осмотре на нём не найдены трещины и сколы. Замену кольца выполняет изготовитель."
    docs = [(1, prose), (2, "\n".join(f"- предмет {i}" for i in range(12))), (3, "\n".join(f"А{i}\t{i},5\t{i},7\t{i * 3}" for i in range(10, 22))), (4, "\n".join(["одно и то же снова"] * 12)), (5, None), (6, "  ")]
    got = {r["doc_id"]: r["shape"] for r in quality.text_shapes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "prose", 2: "list", 3: "table", 4: "junk"}
    assert {r["doc_id"]: r["word_count"] for r in quality.text_statistics(spark.createDataFrame(docs, "doc_id long, text string")).collect()}[6] == 0


def test_scans(spark):
    def body(n: int) -> list[str]:
        w = "абвгдежзиклмнопрстуфхцчшщэюя"[n % 28] + "ол" + "бвгдж"[n % 5] + "а"
        return [f"Муфта {w} стального вала должна иметь кольцо и опо-", f"ру, если зазор {w} не более 5 мм.", f"Зазор стального вала {w} проверяет изготовитель {w}."]

    rows = [("page_docs", n, True, n, n, "\n".join(["ГОСТ 70001-83 С. " + str(n), *body(n)]), True) for n in range(1, 40)]
    rows += [("page_docs", 40, True, 40, 40, "ГОСТ 70001-83 С. 40\nИуфта ста-\nльного вала и опору", True), ("page_docs", 41, True, 41, 41, "Опору проверяет", False), ("page_docs", 42, True, 42, 42, None, True)]
    rows += [("page_docs", n, True, n, n, "опору муфта", False) for n in range(50, 60)]
    df = spark.createDataFrame(rows, "tab string, row_id long, page boolean, first int, last int, text string, from_ocr boolean")
    got = {r["row_id"]: r for r in scans.read_scans(df).collect()}
    assert 41 not in got and 42 not in got
    assert {(f["line_no"], f["flaw"]) for f in got[1]["flaws"]} == {(1, "furniture"), (2, "break")}
    assert {(f["line_no"], f["flaw"]) for f in got[40]["flaws"]} == {(1, "furniture"), (2, "break"), (2, "misread")}
    assert got[40]["repaired"] == "Муфта стального вала и опору"
