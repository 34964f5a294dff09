import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from textquarry.llm import neardup, quality, scans

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_learnt_shapes_beat_the_start(spark):
    """Labels of people agree more with what expectation-maximisation learnt than with its start."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    found = quality.text_shapes(docs, statistics=False).select("doc_id", "answers").toPandas()
    labels = pd.read_parquet(f"{DATA}/shape_labels.parquet").merge(found, on="doc_id")
    pattern, at, count = np.unique(found["answers"], return_inverse=True, return_counts=True)
    given = quality.answers(pattern.astype(np.int64))
    right = {}
    for rounds in (0, 40):
        shape, _ = quality.shapes_of(given, *quality.fit(given, count.astype(float), rounds))
        of = dict(zip(pattern, shape))
        right[rounds] = (labels["answers"].map(of) == labels["shape"]).mean()
    assert right[40] > 0.96 and right[40] > right[0] + 0.02


def test_path_needs_transitions():
    """A page number after a formula's line, a header in the middle of a chunk: the neighbours decide."""
    line = lambda form, kind, ends="other", after="lower", place="inside": (place, (form, kind, False), ends, after)
    text = ("full", "none", "-")
    doubtful = line("mixed", ("short", "some", "no"), after="digit")
    page = [line("edge", ("short", "some", "yes"), place="top")] + [line("inside", text) for _ in range(12)]
    model = scans.LineModel().train([page] * 50)
    flat = scans.LineModel(transitions=False).train([page] * 50)
    inner = [*page[:6], doubtful, *page[6:]]
    assert model.best(page) == flat.best(page) == ["header"] + ["body"] * 12
    assert model.best(inner)[6] == "body" and flat.best(inner)[6] == "header"


def test_training_learns_a_layout():
    """A short line that tops most pages is known at the foot of another, where the start takes it for text."""
    line = lambda kind, place: (place, ("inside", kind, False), "other", "upper")
    text, short = ("full", "none", "-"), ("short", "none", "-")
    page = [line(short, "top"), *[line(text, "inside")] * 3]
    foot = [line(text, "top"), *[line(text, "inside")] * 2, line(short, "bottom")]
    assert scans.LineModel().best(page)[0] == "header" and scans.LineModel().best(foot)[-1] == "body"
    assert scans.LineModel().train([page] * 300).best(foot)[-1] == "header"


def test_inner_nodes_prune_and_lose_nothing():
    """Trees of several groups find the pairs that a test of all pairs leaves, and inner nodes are left by bitmap."""
    rng = np.random.default_rng(4)
    sets, edges = [], [0]
    for size in (1, 2, 40, 7, 120):
        base = [rng.choice(1 << 40, 90, replace=False) for _ in range(max(1, size // 4))]
        for i in range(size):
            one = base[i % len(base)].copy()
            one[: rng.integers(0, 40)] = rng.choice(1 << 40, 1)
            sets.append(np.unique(one))
        sets[edges[-1] :] = sorted(sets[edges[-1] :], key=lambda s: s[0])
        edges.append(len(sets))
    bits = np.zeros((len(sets), neardup.WORDS), dtype=np.uint64)
    for i, s in enumerate(sets):
        slot = s % (64 * neardup.WORDS)
        np.bitwise_or.at(bits[i], slot // 64, np.uint64(1) << (slot % 64).astype(np.uint64))
    size = np.array([len(s) for s in sets])
    forest, tested = neardup.Forest(bits, size, np.array(edges)), Counter()
    i, j = forest.meet(np.arange(5), np.arange(5), 0.6, tested)
    got = set(zip(i.tolist(), j.tolist()))
    group = np.repeat(np.arange(5), np.diff(edges))
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if group[a] == group[b] and len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))}
    assert similar and similar <= got and len(got) < 3 * len(similar)
    assert all(tested[level, "bitmap"] > 0.2 * tested[level, "pairs"] for level in (0, 1)) and tested[2, "bitmap"] > 0
    # a tree against another finds each pair across once
    x, y = forest.meet(np.array([2]), np.array([4]), 0.1)
    assert len(set(zip(x.tolist(), y.tolist()))) == len(x) and set(group[x]) <= {2} and set(group[y]) <= {4}
