import io
import json
import time
import zipfile

import pytest

from textquarry import ports
from textquarry.plans import ask
from textquarry.sources import files
from textquarry.streaming import ingest

CHUNK = "doc_id string, chunk_index int, chunk_id long, text string, ingested_at timestamp"


def docx(*parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" if isinstance(p, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in p) + "</w:tbl>" for p in parts)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return buffer.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.DocX").write_bytes(docx("Вал и", "кольцо", [["а", "б"], ["", ""], ["1"]], "Текст"))
    (tmp_path / "y.PDF").write_bytes("первая\fвторая".encode())
    (tmp_path / "z.docx").write_bytes(b"broken")
    (tmp_path / "n.txt").write_bytes(b"no")
    found = files.discover_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["x.DocX", "y.PDF", "z.docx"]
    assert files.discover_files(spark, str(tmp_path / "y.PDF")).count() == 1
    rows = files.load_documents(found.unionByName(spark.createDataFrame([("q.odt", bytearray(b"x"), "h")], "path string, content binary, sha256 string")))
    got = sorted((r["path"].rsplit("/", 1)[-1], r["page_no"], r["block_seq"], r["kind"], r["text"], r["error"] is None) for r in rows.collect())
    assert got == [
        ("q.odt", 1, 0, None, None, False), ("x.DocX", 1, 0, "text", "Вал и\nкольцо", True), ("x.DocX", 1, 1, "table", "| а | б |\n| --- | --- |\n| 1 |  |", True), ("x.DocX", 1, 2, "text", "Текст", True),
        ("y.PDF", 1, 0, "text", "первая", True), ("y.PDF", 2, 0, "text", "вторая", True), ("z.docx", 1, 0, None, None, False),
    ]


def test_registry_and_questions(spark, tmp_path):
    assert files.read_registry(spark, str(tmp_path / "none.csv")).count() == 0
    path = tmp_path / "r.csv"
    path.write_text("﻿designation,title,status\nГОСТ  1-2000, Вал ,действующий\n,x,y\nгост 1-2000, Ось,отменён\n", encoding="utf-8")
    r = files.read_registry(spark, str(path)).collect()
    assert [(x["key"], x["title"], x["status"], x["replaced_by"]) for x in r] == [("ГОСТ 1-2000", "Ось", "отменён", "")]
    (tmp_path / "q.yaml").write_text(json.dumps({"questions": [{"id": "q1", "question": "Сколько?", "gold_section": 4.1, "answer_contains": ["7 мм", ["8", "9"]]}, {"id": "q2", "out_of_corpus": True}]}))
    q = {x["id"]: x for x in files.read_questions(spark, str(tmp_path / "q.yaml")).collect()}
    assert q["q1"]["answer_contains"] == [["7 мм"], ["8", "9"]] and q["q1"]["gold_section"] == "4.1" and q["q2"]["out_of_corpus"] and q["q2"]["answer_contains"] == []


def test_fingerprint_and_access():
    assert files.settings_fingerprint({"b": 1, "a": "я"}) == files.settings_fingerprint({"a": "я", "b": 1}) != files.settings_fingerprint({"a": "я", "b": 2})
    here = {"/corpus/a.pdf"}.__contains__
    assert [files.source_status(*x, "/corpus", here) for x in ((True, "/corpus/a.pdf"), (True, "/corpus/b.pdf"), (True, "/corpus/../etc/x"), (True, "/corpusx/a.pdf"), (False, None))] == [200, 404, 403, 403, 404]


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, False), ("b", "x", None), ("c", None, True)], "path string, error string, skipped boolean")
    files.append_ledger(rows, str(tmp_path / "l"))
    (tmp_path / "l" / "part-bad.json").write_text("{broken\n")
    assert sorted(r["path"] for r in files.read_ledger(spark, str(tmp_path / "l"), "path string, error string").collect()) == ["a", "b"]


def test_stream_keeps_what_came_before(spark, tmp_path):
    """A document spread over two batches keeps the chunks of both; a later version of a chunk wins; a replay changes nothing."""
    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    batches = [[("d", 0, 1, "a"), ("d", 1, 2, "b"), ("e", 0, 3, "c")], [("d", 2, 4, "x"), ("d", 1, 5, "y")], [("d", 1, 5, "y")]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "doc_id string, chunk_index int, chunk_id long, text string").selectExpr("*", f"timestamp '2024-01-0{n + 1}' AS ingested_at").coalesce(1).write.mode("append").parquet(source)
        ingest.stream_upserts(spark, source, CHUNK, target, str(tmp_path / "cp"), files=1).awaitTermination()
    got = sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in files.read_points(spark, target, CHUNK).collect())
    assert got == [("d", 0, "a"), ("d", 1, "y"), ("d", 2, "x"), ("e", 0, "c")]
    files.ensure_collection(spark, target, CHUNK)
    assert files.read_points(spark, target, CHUNK).count() == 4
    files.ensure_collection(spark, target, CHUNK, recreate=True)
    assert files.read_points(spark, target, CHUNK).count() == 0


def test_dialogue_memory(spark, tmp_path):
    source = str(tmp_path / "m")
    schema = "thread string, nth long, role string, content string"
    out = []
    for n in range(3):
        spark.createDataFrame([("t", 2 * n, "user", f"в{n}"), ("t", 2 * n + 1, "assistant", f"о{n}")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.dialogue_memory(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 1)
    stream.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(out) == 3 and out[-1]["history"] == ["user|в2", "assistant|о2"]


def test_events(spark):
    rows = [("a", 1, "token", "x"), ("a", 2, "sources", "s"), ("a", 3, "token", "y"), ("a", 4, "error", "e"), ("b", 1, "done", "{}")]
    got = [(r["thread"], r["seq"], r["event"], r["data"]) for r in ingest.ordered_events(spark.createDataFrame(rows, "thread string, nth long, event string, data string")).orderBy("thread", "seq").collect()]
    assert got == [("a", 1, "sources", "s"), ("a", 2, "token", "x"), ("a", 3, "token", "y"), ("a", 4, "error", "e"), ("a", 5, "done", "{}"), ("b", 1, "done", "{}")]


def test_ports(spark):
    df = spark.createDataFrame([(1, "вал и вал"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r for r in ports.embed(df, "text").collect()}
    assert len(got[1]["dense"]) == ports.DIM and sorted(got[1]["sparse"].values()) == [1.0, 2.0] and got[2]["dense"] is None and got[3]["sparse"] == {}
    pairs = spark.createDataFrame([("вал ось", "ось и кольцо"), (None, "x")], "question string, text string")
    assert [r["rerank_score"] for r in ports.rerank_scores(pairs).collect()] == [0.5, None]
    assert "".join(ports.ThirdsTokenizer().split("а" * 100, 10)) == "а" * 100 and ports.WordTokenizer().count("") == 1

    def model(question, context):
        if question == "slow":
            time.sleep(3)
        if question == "bad":
            raise RuntimeError("no")
        return "ok"

    asked = spark.createDataFrame([(1, "slow", "c"), (2, "bad", "c"), (3, "good", "c")], "id long, question string, context string").coalesce(1)
    got = {r["id"]: (r["answer"], r["error"]) for r in ports.generate(asked, model, 0.3).collect()}
    assert got[3] == ("ok", None) and got[2][0] is None and "no" in got[2][1] and "0.3" in got[1][1]


def test_ask(spark):
    chunks = spark.createDataFrame(
        [(1, "ГОСТ 5-80", "Зазор стального вала не более 5 мм. Кольцо меняют.", "ГОСТ 5-80, п. 1", False), (2, "ГОСТ 6-80", "Кольцо медное хранят отдельно. Прочее.", "ГОСТ 6-80", True)],
        "chunk_id long, designation string, text string, label string, from_ocr boolean",
    )
    available = spark.createDataFrame([("ГОСТ 5-80", "Вал"), ("ГОСТ 6-80", None), ("ГОСТ 7-2001", "Ось")], "designation string, title string")
    asked = spark.createDataFrame([(1, "какой зазор стального вала по ГОСТу 5"), (2, "что говорит ГОСТ 7-90"), (3, "ъъъ"), (4, None)], "id long, question string")
    got = {r["id"]: (r["shown"], r["insufficient"]) for r in ask(asked, chunks, available).collect()}
    assert got[1] == ("Зазор стального вала не более 5 мм [S1]", False)
    assert got[2][0].startswith("ГОСТ 7-90 нет в базе (есть другая редакция: ГОСТ 7-2001).") and got[2][1]
    assert got[3][1] and got[4][1] and "Сейчас в базе:\n— ГОСТ 5-80 «Вал»" in got[3][0]


def test_points_need_partners(spark):
    from textquarry.operators.ingest import points

    chunks = spark.createDataFrame([("d", 0, "t")], "doc_id string, chunk_index int, text string")
    vectors = spark.createDataFrame([("d", 0, [1.0])], "doc_id string, chunk_index int, dense array<float>")
    assert points(chunks, vectors).count() == 1
    with pytest.raises(ValueError):
        points(chunks, vectors.limit(0))
