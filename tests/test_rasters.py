import numpy as np

from textquarry.operators import ingest, rasters, tables


def picture():
    gray = np.full((240, 300), 230, dtype=np.uint8)
    for y in (40, 80, 160):
        gray[y : y + 2, 30:270] = 20
    for x in (30, 150, 268):
        gray[40:162, x : x + 2] = 20
    gray[190:196, 40:50] = 0  # a blot
    return gray


def test_rules_and_cells(spark):
    rules = rasters.rules_in(picture(), 0.5)
    flat = [r for r in rules if r[2] - r[0] > r[3] - r[1]]
    assert [round(r[1]) for r in flat] == [20, 40, 80] and len(rules) == 6
    assert len(rasters.cells_between(rules)) == 4
    g = picture()
    pages = spark.createDataFrame([(1, bytearray(g.tobytes()), 300, 240, 0.5), (2, None, 1, 1, 1.0)], "id long, pixels binary, width int, height int, scale double")
    found = rasters.page_rules(pages)
    assert found.count() == 6 and tables.enough_rules(found).count() == 1
    boxes = [tuple(r) for r in tables.frames(found).select("x0", "top", "x1", "bottom").collect()]
    assert len(boxes) == 1 and abs(boxes[0][0] - 15) < 1.5 and abs(boxes[0][3] - 81) < 1.5


def test_skew():
    gray = np.full((300, 400), 240, dtype=np.uint8)
    x = np.arange(20, 380)
    for y in range(60, 260, 20):
        at = np.round(y - x * np.tan(np.radians(3.0))).astype(int)
        for d in range(2):
            gray[np.clip(at + d, 0, 299), x] = 10
    assert abs(rasters.skew(gray) - 3.0) <= 0.2 and rasters.skew(picture()) == 0.0 and rasters.skew(np.full((50, 50), 200, dtype=np.uint8)) == 0.0


def test_recognition_port(spark):
    def recogniser(pixels, width, height):
        if width == 1:
            raise RuntimeError("unreadable")
        return [(0, 0, 0, 1, "вал", 90.0), (0, 0, 0, 0, "Стальной", 80.0), (0, 0, 1, 0, " ", 50.0), (1, 0, 0, 0, "кольцо", -1.0)]

    pages = spark.createDataFrame([(1, bytearray(b"x"), 2, 1), (2, bytearray(b"x"), 1, 1)], "id long, pixels binary, width int, height int")
    got = [tuple(r) for r in ingest.reflowed(rasters.recognise(pages, recogniser)).collect()]
    assert got == [(1, "Стальной вал\nкольцо", 85.0)]
    words = spark.createDataFrame([(1, "d", 1, True), (2, "d", 2, True), (3, "d", 3, False)], "page_id long, doc_id string, page_no int, needs_ocr boolean")
    texts = spark.createDataFrame([(1, "Т е\nкст"), (2, None)], "page_id long, text string")
    assert [(r["page_id"], r["text"]) for r in ingest.recognised(words, texts).collect()] == [(1, "Т е\nкст")]
