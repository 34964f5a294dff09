"""Problem 5: groups of records that differ by small edits.

Rows of equal text are collapsed first.  Every representative becomes a set of
64-bit token hashes, a size and a signature bitmap.  The tokens of the corpus are
counted in a sketch of fixed width, and every record orders its tokens from the
rarest by it.  Two sets at the threshold share a token among their first
``n - ceil(t n) + 1``; these tokens are the top of a signature tree: a record hangs
under each of its own.  Below, the records of a token are arranged by their least
hash, which similar records tend to share, and in nodes that hold the OR-combined
bitmap, the size range and the greatest excess of a size over the bits it sets.  All trees of a batch are traversed
against themselves at once (hot tokens block against block): a pair of nodes is left
when the largest overlap that bitmaps and sizes allow is under the threshold.
Surviving pairs are verified on the whole sets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import broadcast_if_small, checkpointed, table

#: Bits of a signature; words of 64.
WORDS = 6
BITS = [f"b{i}" for i in range(WORDS)]
#: Children of a tree node, and records of a block of a hot token.
FANOUT, BLOCK = 2, 1024
#: Counters of the sketch that orders the tokens, and its parts: what is broadcast has this size whatever the corpus.
SKETCH, PARTS = 1 << 20, 16
#: Pairs of nodes tested at once.
AT_ONCE = 1 << 16

_WORD = re.compile(r"\w+")


def word_atoms(text: str) -> list[str]:
    return _WORD.findall(text)


def char_atoms(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


#: kind -> (atoms of a text, atoms of a token)
KINDS = {"words": (word_atoms, 3), "chars": (char_atoms, 1)}


def _sets(kind: str):
    """Token sets of the texts, ascending, and at the end of a partition its counts of tokens by slot of the sketch."""
    atoms_of, width = KINDS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        known: dict[str, int] = {}
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            out = []
            for rep, text in zip(batch["rep"], batch["text"]):
                atoms = atoms_of(text)
                if len(atoms) < width:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                for a in atoms:
                    if a not in known:
                        known[a] = xxh64_intdigest(a)
                h = np.array([known[a] for a in atoms], dtype=np.uint64)
                n = len(h) - width + 1
                token = h[:n].copy()
                for k in range(1, width):
                    token = (token * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : n + k] + np.uint64(k))
                token = np.unique(token ^ (token >> np.uint64(29)))
                out.append((rep, token.view(np.int64), len(token)))
            if out:
                counts += np.bincount((np.concatenate([t for _, t, _ in out]) & (SKETCH - 1)), minlength=SKETCH)
            yield pd.DataFrame(out, columns=["rep", "tokens", "size"]).assign(part=None, counts=None)
        parts = counts.reshape(PARTS, -1)
        seen = [i for i in range(PARTS) if parts[i].any()]
        if seen:
            yield pd.DataFrame({"rep": None, "tokens": None, "size": None, "part": seen, "counts": [zlib.compress(parts[i].astype(np.int32), 1) for i in seen]})

    return run


def _sum(batch: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int32).astype(np.int64) for x in batch["counts"])
    return pd.DataFrame({"part": batch["part"].iloc[:1], "counts": [zlib.compress(np.minimum(total, np.iinfo(np.int32).max).astype(np.int32), 1)]})


def sketch_of(sets: DataFrame) -> np.ndarray:
    """The summed sketch: ``PARTS`` rows come to the driver, of ``SKETCH`` numbers in all."""
    summed = sets.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(_sum, "part int, counts binary")
    out = np.zeros((PARTS, SKETCH // PARTS), dtype=np.int32)
    for r in summed.collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int32)
    return out.ravel()


def _keys(threshold: float, sketch):
    """Place (least hash and size), bitmap and routing tokens of every set; ``hot`` has those tokens that may have more than a block of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sketch.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("tokens")
            token = lists.flatten().to_numpy()
            size = batch.column("size").to_numpy()
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            bits = np.zeros((len(size), WORDS), dtype=np.uint64)
            slot = (token.view(np.uint64) >> np.uint64(40)) % np.uint64(64 * WORDS)
            np.bitwise_or.at(bits, (row, (slot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (slot & np.uint64(63)))
            # a total order that all records share: count in the sketch, then the hash
            often = count[token & (SKETCH - 1)]
            order = np.lexsort((token, often, row))
            keep = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            first = (np.arange(len(token)) - start[row]) < keep[row]
            chosen, hot = token[order][first], often[order][first] > BLOCK
            ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
            hots = np.concatenate([[0], np.cumsum(np.bincount(row[first][hot], minlength=len(size)))]).astype(np.int32)
            # sets of a token are arranged by their least hash; the size goes along in the lower half
            place = ((token.view(np.uint64)[start] >> np.uint64(33)) << np.uint64(32)).astype(np.int64) | size
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(place), *(pa.array(bits[:, w].copy().view(np.int64)) for w in range(WORDS)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen)), pa.ListArray.from_arrays(pa.array(hots), pa.array(chosen[hot]))],
                names=["rep", "place", *BITS, "route", "hot"],
            )

    return run


class Forest:
    """Signature trees of many groups of records, level by level.

    A level has, for each node, its bitmap, least and greatest size, excess and the span of
    its children; level 0 holds the records, the last level one root for each group.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray, edges: np.ndarray) -> None:
        excess = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, excess, None, None)]
        while True:
            n = np.diff(edges)
            if (n == 1).all() and len(self.levels) > 1:
                break
            m = -(-n // FANOUT)
            tree = np.repeat(np.arange(len(n)), m)
            at = edges[:-1][tree] + FANOUT * (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
            bits, low, high, excess, _, _ = self.levels[-1]
            end = np.minimum(at + FANOUT, edges[1:][tree])
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), at, end))
            edges = np.concatenate([[0], np.cumsum(m)])

    def meet(self, left: np.ndarray, right: np.ndarray, threshold: float, tested: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of records that may be similar, from pairs of trees; of a tree with itself each pair once.

        ``tested`` counts, for each level, pairs of different nodes and those left by size and by bitmap.
        """
        share = threshold / (1 + threshold)
        out_i, out_j = [], []
        todo = [(len(self.levels) - 1, left, right)]
        while todo:
            level, i, j = todo.pop()
            if len(i) > AT_ONCE:
                todo += [(level, i[a : a + AT_ONCE], j[a : a + AT_ONCE]) for a in range(0, len(i), AT_ONCE)]
                continue
            bits, low, high, excess, first, end = self.levels[level]
            same = i == j
            near = same | ((low[i] * threshold <= high[j] + 1e-9) & (low[j] * threshold <= high[i] + 1e-9))
            if tested is not None:
                tested[level, "pairs"] += int((~same).sum())
                tested[level, "size"] += int((~near).sum())
            i, j, same = i[near], j[near], same[near]
            # a token that both hold sets a common bit or is in excess of the bits of either
            most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1) + np.minimum(excess[i], excess[j])
            near = same | (most >= share * (low[i] + low[j]) - 1e-9)
            if tested is not None:
                tested[level, "bitmap"] += int((~near).sum())
            i, j = i[near], j[near]
            if level == 0:
                out_i.append(i)
                out_j.append(j)
                continue
            n, m = end[i] - first[i], end[j] - first[j]
            times = n * m
            pair = np.repeat(np.arange(len(i)), times)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
            a, b = first[i][pair] + k // m[pair], first[j][pair] + k % m[pair]
            once = (i != j)[pair] | ((a < b) if level == 1 else (a <= b))
            todo.append((level - 1, a[once], b[once]))
        return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _traverse(threshold: float):
    """Within each (token, block, block) of a partition, records that may be similar."""
    names = ["token", "left", "right", "block", "rep", "place", *BITS]

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
        """Columns of whole groups, and where each group begins."""
        rest = None
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in names}
            if rest is not None:
                c = {k: np.concatenate([rest[k], c[k]]) for k in names}
            new = np.zeros(len(c["token"]), dtype=bool)
            for k in names[:3]:
                new[1:] |= c[k][1:] != c[k][:-1]
            at = np.flatnonzero(new)
            cut = int(at[-1]) if len(at) else 0
            if cut:
                yield {k: v[:cut] for k, v in c.items()}, np.concatenate([[0], at])
            rest = {k: v[cut:] for k, v in c.items()}
        if rest is not None and len(rest["token"]):
            yield rest, np.array([0, len(rest["token"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, edges in whole_groups(batches):
            n = np.diff(edges)
            group = np.repeat(np.arange(len(n)), n)
            # trees: the records of a group, or of either block where two blocks meet; single records meet nobody
            cross = c["left"] != c["right"]
            keep = n[group] > 1
            key = (2 * group + (cross & (c["block"] == c["right"])))[keep]
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(keep)[order]
            key = key[order]
            if not len(at):
                continue
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            forest = Forest(np.stack([c[b][at] for b in BITS], axis=1).view(np.uint64), c["place"][at] & 0xFFFFFFFF, edge)
            tree = key[edge[:-1]]
            crossing = cross[at[edge[:-1]]]
            alone = np.flatnonzero(~crossing)
            two = np.flatnonzero(crossing[:-1] & (tree[:-1] % 2 == 0) & (tree[1:] == tree[:-1] + 1)) if len(tree) > 1 else alone[:0]
            i, j = forest.meet(np.concatenate([alone, two]), np.concatenate([alone, two + 1]), threshold)
            rep = c["rep"][at]
            once = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0].copy()), pa.array(once[:, 1].copy())], names=["a", "b"])

    return run


def classes(records: DataFrame) -> DataFrame:
    """``id, rep``: rows of equal lower-cased text share the least id as representative."""
    keyed = records.where("text is not null").select("id", F.unhex(F.sha2(F.lower("text"), 256)).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("id", "rep")


def similar_pairs(records: DataFrame, members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """``a, b, similarity``: pairs of representatives with Jaccard similarity at the threshold or over.

    ``records`` has ``id, text``, ``members`` is their ``classes``; the text is lower-cased and otherwise taken as it
    is.  Null texts and texts too short for one token take no part, equal texts are
    one representative (the least id), ties need no order as all pairs come out.
    """
    spark = records.sparkSession
    # copies leave by their ids, so that texts are not shuffled
    copies = members.where("id <> rep").select("id")
    texts = records.where("text is not null").join(broadcast_if_small(copies, copies.count()), "id", "left_anti")
    reps = texts.select(F.col("id").alias("rep"), F.lower("text").alias("text"))
    counted = checkpointed(reps.mapInPandas(_sets(kind), "rep long, tokens array<long>, size int, part int, counts binary"))
    sketch = spark.sparkContext.broadcast(sketch_of(counted))
    sets = counted.where("part is null").select("rep", "tokens", "size")
    bits = ", ".join(b + " long" for b in BITS)
    keys = sets.mapInArrow(_keys(threshold, sketch), f"rep long, place long, {bits}, route array<long>, hot array<long>")
    # a hot token is cut into blocks, and every pair of blocks is a group of its own; the sketch never counts too few
    hot = checkpointed(keys.select(F.explode("hot").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    n_hot = hot.count()
    routed = keys.select(F.explode("route").alias("token"), "rep", "place", *BITS)
    if n_hot:
        blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
        routed = (
            routed.join(broadcast_if_small(hot, n_hot), "token", "left")
            .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("token", F.least("block", "other").cast("int").alias("left"), F.greatest("block", "other").cast("int").alias("right"), "block", "rep", "place", *BITS)
        )
    groups = ["token", "left", "right"] if n_hot else ["token"]
    placed = routed.repartition(*groups).sortWithinPartitions(*groups, "place")
    if not n_hot:
        placed = placed.select("token", *(F.lit(0).alias(c) for c in ("left", "right", "block")), "rep", "place", *BITS)
    maybe = checkpointed(placed.mapInArrow(_traverse(threshold), "a long, b long").distinct())
    wanted = maybe.select(F.col("a").alias("rep")).unionByName(maybe.select(F.col("b").alias("rep"))).distinct()
    whole = sets.join(broadcast_if_small(wanted, 2 * maybe.count()), "rep", "left_semi")
    side = lambda c: whole.select(F.col("rep").alias(c), F.col("tokens").alias("t" + c), F.col("size").alias("s" + c))
    both = maybe.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return both.select("a", "b", (F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).alias("similarity")).where(
        F.col("similarity") >= threshold - 1e-9
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rep, component``: least id reachable, by star contraction with checkpoints."""
    links = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # every node and its neighbours point at the least of them
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            break
        links = new
    return nodes.join(links.select(F.col("u").alias("rep"), F.col("v").alias("component")), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("component")
    )


def _chunks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), "text")


def _metas(spark, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "doc_meta").where("designation is not null and title is not null")
    return meta.select(F.col("meta_id").alias("id"), F.concat_ws(" ", "designation", "title").alias("text"))


SOURCES = (("chunks", _chunks, "words", 0.6), ("doc_meta", _metas, "chars", 0.7))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of rows with different, similar texts."""
    parts = []
    for tab, source, kind, threshold in SOURCES:
        rows = source(spark, sf_dir)
        members = checkpointed(classes(rows))
        pairs = similar_pairs(rows, members, kind, threshold)
        wide = (
            pairs.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a")
            .join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
        )
        parts.append(wide.select(F.lit(tab).alias("tab"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))
    return parts[0].unionByName(parts[1])


def p5_groups(spark, sf_dir: str) -> DataFrame:
    """One row for each row: its representative, its group, and its links to different texts."""
    parts = []
    for tab, source, kind, threshold in SOURCES:
        rows = source(spark, sf_dir)
        members = checkpointed(classes(rows))
        pairs = checkpointed(similar_pairs(rows, members, kind, threshold))
        reps = members.select("rep").distinct()
        ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
        links = ends.groupBy("rep").agg(F.count("*").alias("links"))
        rows = members.join(components(reps, pairs), "rep").join(links, "rep", "left")
        parts.append(rows.select(F.lit(tab).alias("tab"), "id", "rep", F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")))
    return parts[0].unionByName(parts[1])


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
_PAIRS = r"""RECURSIVE src AS (SELECT 'chunks' AS tab, chunk_id AS id, lower(text) AS t, 0.6 AS least FROM chunks WHERE text IS NOT NULL UNION ALL SELECT 'doc_meta', meta_id, lower(designation || ' ' || title), 0.7 FROM doc_meta WHERE designation IS NOT NULL AND title IS NOT NULL),
 reps AS (SELECT tab, t, min(id) AS rep, any_value(least) AS least FROM src GROUP BY 1, 2), w AS (SELECT *, CASE tab WHEN 'chunks' THEN regexp_extract_all(t, '[\pL\pN_]+') END AS ws FROM reps),
 tok AS (SELECT DISTINCT tab, rep, least, unnest(CASE tab WHEN 'chunks' THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i::BIGINT, 3)) END) AS g FROM w),
 n AS (SELECT tab, rep, count(*) AS n FROM tok GROUP BY 1, 2), c AS (SELECT a.tab, a.rep AS a, b.rep AS b, any_value(a.least) AS least, count(*) AS common FROM tok a JOIN tok b ON a.tab = b.tab AND a.g = b.g AND a.rep < b.rep GROUP BY 1, 2, 3),
 pairs AS (SELECT c.tab, a, b FROM c JOIN n x ON x.tab = c.tab AND x.rep = a JOIN n y ON y.tab = c.tab AND y.rep = b WHERE common >= (least - 1e-9) * (x.n + y.n - common)),
 mem AS (SELECT s.tab, s.id, r.rep FROM src s JOIN reps r ON r.tab = s.tab AND r.t = s.t)"""
ORACLES = {
    "p5_found": f"WITH {_PAIRS} SELECT p.tab, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM pairs p JOIN mem x ON x.tab = p.tab AND x.rep = a JOIN mem y ON y.tab = p.tab AND y.rep = b",
    "p5_groups": f"""WITH {_PAIRS}, e AS (SELECT tab, a, b FROM pairs UNION ALL SELECT tab, b, a FROM pairs), reach AS (SELECT tab, rep, rep AS node FROM reps UNION SELECT reach.tab, reach.rep, e.b FROM reach JOIN e ON e.tab = reach.tab AND e.a = reach.node),
      g AS (SELECT tab, rep, min(node) AS group_id FROM reach GROUP BY 1, 2), l AS (SELECT tab, a AS rep, count(*) AS links FROM e GROUP BY 1, 2)
      SELECT mem.tab, id, mem.rep, group_id, coalesce(links, 0) AS links FROM mem JOIN g ON g.tab = mem.tab AND g.rep = mem.rep LEFT JOIN l ON l.tab = mem.tab AND l.rep = mem.rep""",
}
