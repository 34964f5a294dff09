import random

from textquarry.operators import structure


def test_longest_chain_matches_all_pairs():
    rng = random.Random(5)

    def slow(clauses):
        parsed = [[int(x) for x in c.split(".")] for c in clauses]
        best, parent = [1] * len(parsed), [-1] * len(parsed)
        for i, q in enumerate(parsed):
            for j in range(i):
                if best[j] + 1 > best[i] and structure.clause_follows(parsed[j], q):
                    best[i], parent[i] = best[j] + 1, j
        at, out = best.index(max(best)), []
        while at >= 0:
            out.append(at)
            at = parent[at]
        return out[::-1]

    for _ in range(400):
        clauses = [".".join(str(rng.randrange(4)) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 40))]
        assert structure.longest_chain(clauses) == slow(clauses)


def test_sections_carry_over_pages(spark):
    lines = [("1 Область применения", 1), ("продолжение", 1), ("продолжение", 2), ("7 мест для хранения", 2), ("1.1 Требования", 3), ("ещё", 4), ("2 Правила приёмки", 5), ("ещё", 6)]
    df = spark.createDataFrame([(n, "a", n, page, text) for n, (text, page) in enumerate(lines)] + [(99, "b", 0, 1, "без пункта"), (98, "b", 1, 1, None)], "block_id long, doc_id string, block_seq int, page_no int, text string")
    for segment in (1, 3, 256):
        got = {r["block_id"]: r["section"] for r in structure.inherited(df, structure.clause_chain(structure.openings(df)), segment).collect()}
        assert got == {0: "1", 1: "1", 2: "1", 3: "1", 4: "1.1", 5: "1.1", 6: "2", 7: "2", 98: None, 99: None}


def test_blocks_carry_over_pages(spark):
    pages = [(1, "a", 1, "начало\n\n3.1 Общие сведения"), (2, "a", 2, "продолжение\n3.2 Размеры деталей"), (3, "a", 2, "продолжение\n3.2 Размеры деталей"), (4, "a", 3, ""), (5, "a", 4, "конец"), (6, "a", 5, None)]
    df = spark.createDataFrame(pages, "page_id long, doc_id string, page_no int, text string")
    got = {(r["page_id"], r["first_line"]): r["section"] for r in structure.blocks_of_documents(df).collect()}
    assert got == {(1, 0): None, (1, 2): "3.1", (2, 0): "3.1", (2, 1): "3.2", (3, 0): "3.1", (3, 1): "3.2", (5, 0): "3.2"}
