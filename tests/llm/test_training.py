import random

import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import scans


def test_all_rows_train(spark):
    """A short line at a foot is a header where other pages are topped by one, and text where as many longer pages end in text: these count though a share by hash leaves them out."""
    word = lambda n: "".join("абвгдежзик"[int(c)] for c in f"{n:05d}")
    text = lambda n, k: f"Вал {word(n)} {word(k)} держит кольцо и опору муфты стального вала"
    rows = [("p", n, "\n".join([word(n).title(), text(n, 0)]), "\n".join(text(n, k) for k in range(3))) for n in range(4000)]
    foot = "\n".join([*[text(4000, k) for k in range(3)], "Жжжжж"])
    pages = spark.createDataFrame([*rows, ("p", 4000, foot, foot)], "tab string, row_id long, topped string, longer string")
    pages = pages.withColumn("shared", F.expr("row_id = 4000 or pmod(xxhash64(tab, row_id), 2) = 0"))
    df = pages.select("*", F.when(F.col("shared"), F.col("topped")).otherwise(F.col("longer")).alias("text")).selectExpr("*", "true AS page", "int(null) AS first", "int(null) AS last", "true AS from_ocr")
    header = lambda df: (4, "furniture") in [tuple(f) for f in scans.read_scans(df).where("row_id = 4000").first()["flaws"]]
    assert header(df.where("shared")) and not header(df)


def test_all_paths_at_once_are_the_single_ones(spark):
    """Rows of all lengths, in any partitions: the same paths as one by one, the same model as from one list."""
    rng = random.Random(3)
    layouts = [rng.choice(scans.LAYOUTS) for _ in range(60)]
    sequences = [[rng.choice(layouts) for _ in range(rng.choice((0, 1, 2, 7, 40)))] for _ in range(400)]
    codes, lengths = scans.packed(map(scans.encoded, sequences))
    for model in (scans.LineModel(), scans.LineModel(transitions=False), scans.LineModel().train(sequences)):
        one_by_one = [scans.STATES.index(s) for x in sequences for s in model.best(x)]
        assert np.array_equal(model.paths(codes, lengths), one_by_one)
    df = spark.createDataFrame([(scans.encoded(x),) for x in sequences], "lines binary").repartition(3)
    spread, whole = scans.LineModel().train_on(df), scans.LineModel().train(sequences)
    assert spread.seen == whole.seen and spread.start == whole.start and spread.move == whole.move
