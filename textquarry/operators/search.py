"""Search over dense and sparse vectors: exact top-k, rank fusion, gates and context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import checkpointed, table

PREFETCH, FUSED, TOP, RRF_K, MIN_DENSE = 50, 30, 6, 60, 0.5
DATA_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Queries that are broadcast (of 64 doubles each: 16 MB), and terms of queries; beyond that both sides are cut into blocks or salted.
FEW_QUERIES, FEW_TERMS, SALT = 32_768, 1_000_000, 16


def usable(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """Vectors that are neither null, of another length, zero nor with NaN."""
    ok = (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return vectors.where(F.col("v").isNotNull()).where(ok)


def ranked(scores: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """The k best of each query, ties by item."""
    w = Window.partitionBy("query").orderBy(F.desc(by), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the lower id; columns of no score are -inf and stay out.

    ``ids`` has the shape of ``scores`` or one row for all.
    """
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        sure, tied = scores > least, scores == least
        free = k - sure.sum(axis=1)
        many = np.flatnonzero(tied.sum(axis=1) > free)
        for r in many:
            at = np.flatnonzero(tied[r])
            own = ids[r if len(ids) > 1 else 0, at]
            tied[r, at[np.argsort(own, kind="stable")[free[r] :]]] = False
        keep = sure | tied
    else:
        keep = np.ones_like(scores, dtype=bool)
    return np.nonzero(keep & np.isfinite(scores))


def _frame(query, item, score) -> pd.DataFrame:
    return pd.DataFrame({"query": query, "item": item, "score": score})


def _few_topk(spark, q: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """Top-k of broadcast queries: the corpus isn't shuffled, each partition sends its best alone."""
    rows = q.select("id", "v").toPandas()  # at most FEW_QUERIES, counted by the caller
    asked = spark.sparkContext.broadcast((rows["id"].to_numpy(), _unit(rows["v"]) if len(rows) else np.zeros((0, 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, qv = asked.value
        score = np.full((len(qid), k), -np.inf)
        item = np.zeros((len(qid), k), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            m, ids = _unit(batch["v"]), batch["id"].to_numpy()
            for at in range(0, len(qid), 512):
                part = slice(at, at + 512)
                s = np.round(qv[part] @ m.T, 6)
                s[qid[part][:, None] == ids[None, :]] = -np.inf
                every, names = np.concatenate([score[part], s], axis=1), np.concatenate([item[part], np.broadcast_to(ids, s.shape)], axis=1)
                r, c = _best(every, names, k)
                place = np.arange(len(r)) - np.searchsorted(r, r)
                new_s, new_i = np.full((len(s), k), -np.inf), np.zeros((len(s), k), dtype=np.int64)
                new_s[r, place], new_i[r, place] = every[r, c], names[r, c]
                score[part], item[part] = new_s, new_i
        r, c = np.nonzero(np.isfinite(score))
        yield _frame(qid[r], item[r, c], score[r, c])

    return d.select("id", "v").mapInPandas(run, "query long, item long, score double")


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = PREFETCH, same: str | None = None) -> DataFrame:
    """Exact cosine top-k of ``queries(id, v)`` in ``corpus(id, v)``; a vector does not find itself.

    Few queries are broadcast to the partitions of the corpus; else blocks of queries meet
    blocks of the corpus, each pair as one matrix product with a local top-k.  ``same``
    names a column whose values must agree: only blocks of one value meet, so it is
    applied before any score.  Unusable vectors take no part; ties go to the lower id.
    """
    spark = queries.sparkSession
    q, d = usable(queries), usable(corpus)
    if not same and q.count() <= FEW_QUERIES:
        return ranked(_few_topk(spark, q, d, k), "score", "item", k)
    group = F.xxhash64(same) if same else F.lit(0).cast("long")
    q, d = (x.select("id", "v", group.alias("g")) for x in (q, d))
    count = lambda x, size, name: x.groupBy("g").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(q, QUERY_BLOCK, "nq").join(count(d, DATA_BLOCK, "nd"), "g")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = q.join(sizes, "g").select("g", "id", "v", mine("nq").alias("qb"), spread("nd").alias("db"), F.lit(True).alias("asks"))
    d = d.join(sizes, "g").select("g", "id", "v", spread("nq").alias("qb"), mine("nd").alias("db"), F.lit(False).alias("asks"))

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        asks, data = batch[batch["asks"]], batch[~batch["asks"]]
        out = [_frame(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asks) and len(data):
            m, ids = _unit(data["v"]), data["id"].to_numpy()
            for at in range(0, len(asks), 256):
                part = asks.iloc[at : at + 256]
                qid = part["id"].to_numpy()
                s = np.round(_unit(part["v"]) @ m.T, 6)
                s[qid[:, None] == ids[None, :]] = -np.inf
                r, c = _best(s, ids[None, :], k)
                out.append(_frame(qid[r], ids[c], s[r, c]))
        return pd.concat(out)

    scores = q.unionByName(d).groupBy("g", "qb", "db").applyInPandas(score, "query long, item long, score double")
    return ranked(scores, "score", "item", k)


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int = PREFETCH) -> DataFrame:
    """Top-k by inner product of ``sparse`` term weights; items without a shared term do not appear.

    The terms of few queries are broadcast, so that all terms of an item meet where it lies and its
    scores are summed before the shuffle; else the join is salted against frequent terms.
    """
    q = queries.select(F.col("id").alias("query"), F.explode("sparse").alias("t", "wq")).where("wq > 0")
    d = corpus.select(F.col("id").alias("item"), F.explode("sparse").alias("t", "wd")).where("wd > 0")
    if q.count() <= FEW_TERMS:
        pairs = d.join(F.broadcast(q), "t")
    else:
        salted = d.withColumn("s", F.pmod(F.xxhash64("item"), F.lit(SALT)).cast("int"))
        pairs = salted.join(q.withColumn("s", F.explode(F.array(*(F.lit(i) for i in range(SALT))))), ["t", "s"])
    dots = pairs.where("query <> item").groupBy("query", "item").agg(F.round(F.sum(F.col("wq").cast("double") * F.col("wd").cast("double")), 6).alias("score"))
    return ranked(dots, "score", "item", k)


def fuse(*lists: DataFrame, k: int = RRF_K, limit: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``query, item, rank``."""
    every = lists[0].select("query", "item", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query", "item", "rank"))
    summed = every.groupBy("query", "item").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("fused"))
    return ranked(summed, "fused", "item", limit)


def passes_gate(top: str, threshold: float) -> F.Column:
    """A threshold of 0 or less lets all pass; else the score must be there and reach it."""
    return F.lit(True) if threshold <= 0 else F.coalesce(F.col(top) >= threshold, F.lit(False))


def _vectors(spark, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_vectors").select(F.col("vec_id").alias("id"), "chunk_id", F.col("dense").alias("v"), "sparse")


def _asked(spark, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("id % 20 = 0")


def q_dense(spark, sf):
    return dense_topk(_asked(spark, sf), _vectors(spark, sf)).select("query", "item", "score", "rank")


def q_filtered(spark, sf):
    docs = table(spark, sf, "chunks").select("chunk_id", "doc_id")
    return dense_topk(_asked(spark, sf).join(docs, "chunk_id"), _vectors(spark, sf).join(docs, "chunk_id"), 10, "doc_id").select("query", "item", "score", "rank")


def q_sparse(spark, sf):
    return sparse_topk(_asked(spark, sf), _vectors(spark, sf)).select("query", "item", "score", "rank")


def lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse ranking, each found once for all that read it."""
    return checkpointed(q_dense(spark, sf)), checkpointed(q_sparse(spark, sf))


def q_hybrid(spark, sf):
    return fuse(q_dense(spark, sf), q_sparse(spark, sf)).select("query", "item", "fused", "rank")


def gated(dense: DataFrame, threshold: float = MIN_DENSE) -> DataFrame:
    """``query, dense_top, passes``: the best dense score of each query, and whether it lets the query through."""
    return dense.groupBy("query").agg(F.max("score").alias("dense_top")).select("query", "dense_top", passes_gate("dense_top", threshold).alias("passes"))


def q_gate(spark, sf):
    return gated(q_dense(spark, sf))


def q_rerank(spark, sf):
    """Threshold then top-n over a score, ties in fusion order; the sparse score stands for the model's."""
    dense, sparse = lists(spark, sf)
    scored = fuse(dense, sparse).join(sparse.select("query", "item", "score"), ["query", "item"], "left").fillna(0.0, ["score"])
    w = Window.partitionBy("query").orderBy(F.desc("score"), "rank")
    kept = scored.where("score >= 0.2").withColumn("place", F.row_number().over(w)).where(f"place <= {TOP}")
    return kept.select("query", "item", "score", "place")


def q_context(spark, sf):
    """The flagship: gate, fusion, first six, labelled with designation, status, clauses and pages."""
    from textquarry.operators.questions import citation_label

    dense, sparse = lists(spark, sf)
    hits = fuse(dense, sparse).where(f"rank <= {TOP}").join(gated(dense).where("passes").select("query"), "query", "left_semi")
    chunks = table(spark, sf, "chunks").select("chunk_id", "doc_id", "section", "sections", "page_start", "page_end")
    first = table(spark, sf, "doc_meta").groupBy("doc_id").agg(F.min_by("designation", "meta_id").alias("designation"), F.min_by("status", "meta_id").alias("status"))
    rows = hits.join(_vectors(spark, sf).select(F.col("id").alias("item"), "chunk_id"), "item").join(chunks, "chunk_id").join(first, "doc_id", "left")
    label = citation_label(F.col("designation"), F.col("doc_id"), F.col("status"), F.col("sections"), F.col("section"), F.col("page_start"), F.col("page_end"))
    return rows.select("query", F.concat(F.lit("[S"), "rank", F.lit("]")).alias("marker"), "item", "doc_id", label.alias("label"))


_OK = "dense IS NOT NULL AND len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0"
_DENSE = f"""ok AS (SELECT vec_id, chunk_id, dense::DOUBLE[] v FROM chunk_vectors WHERE {_OK}),
 ds AS (SELECT q.vec_id AS query, d.vec_id AS item, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM ok q JOIN ok d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
 dense AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INT AS rank FROM ds QUALIFY rank <= 50)"""
_SPARSE = """e AS (SELECT vec_id, unnest(map_keys(sparse)) AS t, unnest(map_values(sparse))::DOUBLE AS w FROM chunk_vectors),
 ss AS (SELECT q.vec_id AS query, d.vec_id AS item, round(sum(q.w * d.w), 6) AS score FROM e q JOIN e d USING (t) WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND q.w > 0 AND d.w > 0 GROUP BY 1, 2),
 sparse AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INT AS rank FROM ss QUALIFY rank <= 50)"""
_FUSED = f"""WITH {_DENSE}, {_SPARSE},
 f AS (SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM (SELECT query, item, rank FROM dense UNION ALL SELECT query, item, rank FROM sparse) GROUP BY 1, 2),
 fused AS (SELECT query, item, fused, row_number() OVER (PARTITION BY query ORDER BY fused DESC, item)::INT AS rank FROM f QUALIFY rank <= 30)"""
QUERIES = {"dense_topk": q_dense, "filtered_dense_topk": q_filtered, "sparse_topk": q_sparse, "hybrid_rrf": q_hybrid, "dense_gate": q_gate, "rerank_threshold": q_rerank, "hybrid_context": q_context}
ORACLES = {
    "dense_topk": f"WITH {_DENSE} SELECT query, item, score, rank FROM dense",
    "filtered_dense_topk": f"""WITH {_DENSE}, s AS (SELECT ds.*, c.doc_id FROM ds JOIN ok a ON a.vec_id = query JOIN chunks c ON c.chunk_id = a.chunk_id JOIN ok b ON b.vec_id = item JOIN chunks k ON k.chunk_id = b.chunk_id WHERE c.doc_id = k.doc_id)
      SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INT AS rank FROM s QUALIFY rank <= 10""",
    "sparse_topk": f"WITH {_SPARSE} SELECT query, item, score, rank FROM sparse",
    "hybrid_rrf": f"{_FUSED} SELECT query, item, fused, rank FROM fused",
    "dense_gate": f"WITH {_DENSE} SELECT query, max(score) AS dense_top, max(score) >= 0.5 AS passes FROM dense GROUP BY 1",
    "rerank_threshold": f"""{_FUSED}, r AS (SELECT f.query, f.item, coalesce(s.score, 0.0) AS score, f.rank FROM fused f LEFT JOIN sparse s USING (query, item))
      SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank)::INT AS place FROM r WHERE score >= 0.2 QUALIFY place <= 6""",
    "hybrid_context": f"""{_FUSED}, good AS (SELECT query FROM dense GROUP BY 1 HAVING max(score) >= 0.5),
      m AS (SELECT doc_id, arg_min_null(designation, meta_id) AS designation, arg_min_null(status, meta_id) AS status FROM doc_meta GROUP BY 1)
      SELECT query, '[S' || rank || ']' AS marker, item, c.doc_id,
        concat_ws(', ', coalesce(nullif(designation, ''), c.doc_id) || CASE WHEN status <> '' AND status <> 'неизвестно' THEN ' (' || status || ')' ELSE '' END,
          CASE WHEN len(sections) > 1 THEN 'пп. ' || sections[1] || '–' || sections[-1] WHEN len(sections) = 1 THEN 'п. ' || sections[1] WHEN section <> '' THEN 'п. ' || section END,
          'стр. ' || page_start || CASE WHEN page_end <> page_start THEN '–' || page_end ELSE '' END) AS label
      FROM fused JOIN good USING (query) JOIN chunk_vectors v ON v.vec_id = item JOIN chunks c ON c.chunk_id = v.chunk_id LEFT JOIN m ON m.doc_id = c.doc_id WHERE rank <= 6""",
}
