"""Problem 3: the most similar vectors of every vector.

Collision-counting hashing.  A coarse quantiser, fitted on a bounded sample, sends
every vector to its nearest cell and every query to the cells nearest to it; a cell
too large for one task is cut into blocks.  Where queries meet a cell, the cell's
vectors are projected on single directions and each projection is a sorted array.
Windows centred on the query are widened round by round (virtual rehashing), the
collisions of every vector are counted over the arrays, and vectors whose count
passes the threshold are verified by their cosine.  A query stops widening once its
k-th verified neighbour lies inside the radius of the round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import checkpointed, table

DIM, K = 64, 10
#: Vectors of the sample that fits cells and directions: a bound on what the driver sees.
SAMPLE = 20_000
#: Vectors a cell should hold, and the most of a block.
CELL, BLOCK = 512, 4096
#: Single projections, and the share of them that must collide.
PROJECTIONS, COLLIDE = 16, 0.8
#: Radii of the rounds, as distances of unit vectors: cosine 0.98, 0.92, 0.78, 0.5, 0.2.
ROUNDS = (0.2, 0.4, 0.66, 1.0, 1.265)


def usable(vector: Column, dim: int = DIM) -> Column:
    """Neither null nor of another length, and with finite elements not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def fit(sample: np.ndarray, cells: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres (spherical k-means) and orthonormal directions of greatest spread."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(8):
        near = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres)
    _, _, directions = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
    return centres.astype(np.float32), directions[:PROJECTIONS].astype(np.float32)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def search_cell(queries: np.ndarray, data: np.ndarray, directions: np.ndarray, k: int, radius: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, data row, cosine) of the best verified candidates, by blocks of queries.

    With ``radius`` only neighbours within that distance are wanted, and no wider round is run.
    """
    m, size = len(directions), len(data)
    projected = data @ directions.T
    order = np.argsort(projected, axis=0)
    arrays = np.take_along_axis(projected, order, axis=0)
    need = max(1, round(COLLIDE * m))
    rounds = [r for r in ROUNDS if radius is None or r < radius] + ([radius] if radius else [2.0])
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        centre = block @ directions.T
        live = np.arange(len(block))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # windows are empty at the query's own place; collisions counted so far
        low = np.stack([np.searchsorted(arrays[:, p], centre[:, p]) for p in range(m)], axis=1)
        high = low.copy()
        count = np.zeros(len(block) * size, dtype=np.uint8)
        for r in rounds:
            if not len(live):
                break
            if r >= 2.0:  # everything collides
                candidates = np.ones((len(live), size), dtype=bool)
            else:
                # half the width holds the projected difference of vectors at distance r, two deviations wide
                half = 2.0 * r / np.sqrt(data.shape[1])
                touched = []
                for p in range(m):
                    lower = np.searchsorted(arrays[:, p], centre[live, p] - half, "left")
                    higher = np.searchsorted(arrays[:, p], centre[live, p] + half, "right")
                    # only what the wider window adds on either side
                    for first, last in ((lower, low[live, p]), (high[live, p], higher)):
                        times = last - first
                        place = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
                        touched.append(np.repeat(live * size, times) + order[place, p])
                    low[live, p], high[live, p] = lower, higher
                count += np.bincount(np.concatenate(touched), minlength=len(count)).astype(np.uint8)
                candidates = count.reshape(len(block), size)[live] >= need
            done = []
            i, j = np.nonzero(candidates)
            cosine = np.einsum("ij,ij->i", block[live[i]], data[j]) if len(i) < 40 * len(live) else (block[live] @ data.T)[i, j]
            cut = np.searchsorted(i, np.arange(len(live) + 1))
            for n, q in enumerate(live):
                js, cs = j[cut[n] : cut[n + 1]], cosine[cut[n] : cut[n + 1]]
                if len(js) > k:
                    top = np.argpartition(-cs, k - 1)[:k]
                    js, cs = js[top], cs[top]
                best[q] = (js, cs)
                if r == rounds[-1] or (len(js) >= k and cs.min() >= 1 - r * r / 2):
                    done.append(n)
            live = np.delete(live, done)
        for q, (js, cs) in best.items():
            yield np.full(len(js), at + q), js, cs


def nearest(vectors: DataFrame, k: int = K, min_cosine: float | None = None, queries: Column | None = None, cell: int = CELL, probes: int = 8) -> DataFrame:
    """``query, neighbour, cosine, rank``: the k most similar other vectors of each query.

    ``vectors`` has ``id, v``.  Vectors that are null, zero, of another length or hold
    NaN take no part.  Equal vectors are collapsed before the search and expanded after
    it, so that a vector repeated many times costs one; ties are ordered by id.  With
    ``min_cosine`` only neighbours at least that similar are wanted.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("v"))).select("id", "v", (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("asks"))
    # members of equal vectors: the k + 1 least ids stand for all in the lists of neighbours
    keyed = good.select("id", "v", F.xxhash64("v").alias("key"))
    firsts = keyed.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = checkpointed(firsts)
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], "query long, neighbour long, cosine double, rank int")
    # a share by hash, so that no partition sends more than its part; about SAMPLE vectors in all
    share = max(1, n // SAMPLE)
    taken = reps.where(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0).select("v").toPandas()
    sample = _unit(taken["v"])
    cells = max(1, n // cell)
    centres, directions = fit(sample, min(cells, max(1, len(sample) // 8)))
    model = spark.sparkContext.broadcast((centres, directions))
    probes = min(probes, len(centres))
    # queries are asked by representative: one that stands for any wanted id
    asked = reps if queries is None else reps.join(good.where("asks").select("v").distinct(), "v", "left_semi")

    def assign(many: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, _ = model.value
            for batch in batches:
                if not len(batch):
                    continue
                u = _unit(batch["v"])
                near = u @ centres.T
                top = np.argpartition(-near, many - 1, axis=1)[:, :many] if many < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(u), 1))
                yield pd.DataFrame({"cell": top.ravel().astype(np.int32), "rep": np.repeat(batch["rep"].to_numpy(), top.shape[1]), "u": [x.tobytes() for x in np.repeat(u, top.shape[1], axis=0)]})

        return run

    schema = "cell int, rep long, u binary"
    home = reps.select("rep", "v").mapInPandas(assign(1), schema)
    visits = asked.select("rep", "v").mapInPandas(assign(probes), schema)
    blocks = home.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    data = home.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "u", F.lit(False).alias("asks"))
    # queries of one visit go to every block of the cell, and many queries are cut into portions
    portions = visits.groupBy("cell").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("portions"))
    asks = (
        visits.join(F.broadcast(blocks), "cell")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(F.broadcast(portions), "cell")
        .select("cell", "block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("portions")).cast("int").alias("portion"), "rep", "u", F.lit(True).alias("asks"))
    )
    data = data.join(F.broadcast(portions), "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), "rep", "u", "asks")
    radius = None if min_cosine is None else float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) + 1e-4

    def search(batch: pd.DataFrame) -> pd.DataFrame:
        _, directions = model.value
        ask = batch["asks"].to_numpy()
        ids = batch["rep"].to_numpy()
        u = np.frombuffer(b"".join(batch["u"]), dtype=np.float32).reshape(len(batch), -1)
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not ask.any() or ask.all():
            return none
        qi, di = ids[ask], ids[~ask]
        found = list(search_cell(u[ask], u[~ask], directions, k + 1, radius))
        if not found:
            return none
        q, d, c = (np.concatenate(x) for x in zip(*found))
        keep = (qi[q] != di[d]) & (c >= (-2 if min_cosine is None else min_cosine - 1e-3))
        return pd.DataFrame({"a": qi[q][keep], "b": di[d][keep]})

    found = asks.unionByName(data).groupBy("cell", "block", "portion").applyInPandas(search, "a long, b long")
    # the exact cosine, in double precision
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("v").alias("v" + c))

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        x, y = np.stack(x.to_numpy()).astype(np.float64), np.stack(y.to_numpy()).astype(np.float64)
        return pd.Series((x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1))

    scored = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", cosine("va", "vb").alias("cosine"))
    own = reps.where("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"))
    near = scored.unionByName(own)
    if min_cosine is not None:
        near = near.where(F.col("cosine") >= min_cosine)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k + 1)
    # members: every id as a query, the k + 1 least ids of a vector as neighbours
    members = good.join(reps.select("v", "rep", "copies"), "v").select("rep", "id", "copies", "asks")
    some = members.where("copies > 1").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    stand = some.select("rep", "id").unionByName(members.where("copies = 1").select("rep", "id"))
    wide = near.join(stand.select(F.col("rep").alias("b"), F.col("id").alias("neighbour")), "b")
    best = wide.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k + 1)
    wanted = members.where("asks")
    mine = best.join(wanted.select(F.col("rep").alias("a"), F.col("id").alias("query")), "a").where("query <> neighbour")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return mine.select("query", "neighbour", "cosine", place.cast("int").alias("rank")).where(F.col("rank") <= k)


def _vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_vectors").select(F.col("vec_id").alias("id"), F.col("dense").alias("v"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.92 and over in which one is among the ten most similar of the other."""
    pairs = nearest(_vectors(spark, sf_dir), min_cosine=0.92)
    return pairs.select(F.least("query", "neighbour").alias("vec_a"), F.greatest("query", "neighbour").alias("vec_b")).distinct()


def p3_nearest(spark, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 20, among all vectors."""
    return nearest(_vectors(spark, sf_dir), queries=F.expr("id % 20 = 0"), probes=24).withColumn("cosine", F.round("cosine", 6))


QUERIES = {"p3_found": p3_found, "p3_nearest": p3_nearest}
# Both look at every vector where the collection has no more cells than are probed, as at the scale of the SQL check.
_NEAR = """ok AS (SELECT vec_id, dense::DOUBLE[] AS v FROM chunk_vectors WHERE dense IS NOT NULL AND len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
 s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS cosine FROM ok a JOIN ok b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour)::INT AS rank FROM s QUALIFY rank <= 10)"""
ORACLES = {
    "p3_found": f"WITH {_NEAR} SELECT DISTINCT least(query, neighbour) AS vec_a, greatest(query, neighbour) AS vec_b FROM r WHERE cosine >= 0.92",
    "p3_nearest": f"WITH {_NEAR} SELECT query, neighbour, round(cosine, 6) AS cosine, rank FROM r WHERE query % 20 = 0",
}
