"""Problem 7: mixing sources to target weights.

Min-cost flow for overlapping sources.  Texts are aggregated by membership pattern
(the set of sources that hold the text); the driver sees only the patterns.  Tokens
flow from patterns to source quotas, and every further repetition of a pattern costs
more than the one before, so that repeats are used last and spread evenly.  The
flow is then turned into documents: the texts of a pattern lie on a line in seeded
order, and every source takes a stretch of it.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import broadcast_if_small, checkpointed, table

#: A public tokenizer: byte-level BPE for many languages.
TOKENIZER = os.environ.get("TEXTQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published split pattern of this family of tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts in a bucket of the running sums.
BUCKET = 20_000


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, key, tokens``; null texts have no token and keep their row.  The tokenizer's file is sent to the executors."""

    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield batch.assign(tokens=[len(encode(t)) if isinstance(t, str) else 0 for t in batch["text"]])[["doc_id", "source", "key", "tokens"]]

    # the names of sources come padded and in capitals
    source = F.lower(F.regexp_replace("source", r"(?U)\A\s+|\s+\z", ""))
    return documents.select("doc_id", "text", source.alias("source"), F.unhex(F.sha2("text", 256)).alias("key")).mapInPandas(
        run, "doc_id long, source string, key binary, tokens long"
    )


def route(supply: dict[tuple[str, ...], int], quotas: dict[str, int], caps: dict[str, int]) -> dict[tuple[str, ...], dict[str, int]]:
    """Min-cost maximum flow of tokens from patterns to sources.

    Pattern ``p`` offers ``supply[p]`` tokens up to ``min(caps)`` times, the r-th time at
    cost ``(r - 1) ** 2`` a token.  Successive shortest paths with potentials.
    """
    patterns = sorted(p for p in supply if supply[p] > 0 and any(s in quotas for s in p))
    sources = sorted(quotas)
    at_s = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # to, room, cost, index of the reverse

    def edge(u: int, v: int, room: int, cost: int) -> None:
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for i, p in enumerate(patterns, 1):
        own = [s for s in p if s in quotas]
        for r in range(min(caps[s] for s in own)):
            edge(0, i, supply[p], r * r)
        for s in own:
            edge(i, at_s[s], sum(quotas.values()), 0)
    for s in sources:
        edge(at_s[s], sink, quotas[s], 0)

    potential = [0] * (sink + 1)
    while True:
        far = [float("inf")] * (sink + 1)
        via: list = [None] * (sink + 1)
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k, (v, room, cost, _) in enumerate(graph[u]):
                step = d + cost + potential[u] - potential[v]
                if room > 0 and step < far[v]:
                    far[v], via[v] = step, (u, k)
                    heapq.heappush(heap, (step, v))
        if via[sink] is None:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        push, v = float("inf"), sink
        while v:
            u, k = via[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v:
            u, k = via[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    return {
        p: {s: graph[at_s[s]][back][1] for v, _, _, back in graph[i] if v > len(patterns) and v < sink for s in (sources[v - 1 - len(patterns)],)}
        for i, p in enumerate(patterns, 1)
    }


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str = TOKENIZER) -> DataFrame:
    """``mix_id, source, doc_id, repeats, tokens``: the documents of each mix (see ``mixed``)."""
    return mixed(documents, targets, seed, path)[0]


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str = TOKENIZER) -> tuple[DataFrame, int]:
    """``mix_id, source, doc_id, repeats, tokens``: the documents of each mix, and the tokens of all documents.

    A text collected in several sources is one text: its uses over all sources stay
    within the least cap of the targeted sources that hold it.  Texts are never cut,
    so a source may miss its quota by one text a stretch.  Documents without source
    or tokens are never drawn.  A source without enough text falls short, which
    ``shares`` reports; the size of the mix stays as asked.
    """
    spark = documents.sparkSession
    counted = checkpointed(token_counts(documents, path))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    asked = targets.where("source is not null").collect()  # a handful of rows, given by the user
    # only sources that are asked for make patterns, so the user's list bounds their number
    texts = (
        counted.where(F.col("source").isin(sorted({r["source"] for r in asked})) & (F.col("tokens") > 0))
        .groupBy("key", "source")
        .agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
        .groupBy("key")
        .agg(F.first("tokens").alias("tokens"), F.map_from_entries(F.collect_set(F.struct("source", "doc_id"))).alias("held"))
        .withColumn("pattern", F.array_join(F.array_sort(F.map_keys("held")), "\n"))
    )
    placed = checkpointed(texts.withColumn("draw", F.xxhash64(F.lit(seed), "key")))
    # one row for each set of sources that occurs together
    sizes = {tuple(r["pattern"].split("\n")): (r["t"], r["n"]) for r in placed.groupBy("pattern").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    mixes: dict[int, dict] = {}
    for r in asked:
        m = mixes.setdefault(r["mix_id"], {"quota": {}, "cap": {}})
        m["quota"][r["source"]] = int(r["target_share"] * r["corpus_multiple"] * total)
        m["cap"][r["source"]] = r["max_repeats"]
    stretches = []
    for mix_id, m in sorted(mixes.items()):
        for p, shares in route({p: t for p, (t, _) in sizes.items()}, m["quota"], m["cap"]).items():
            at, laps = 0, min(m["cap"][s] for s in p if s in m["cap"])
            for s, amount in sorted(shares.items()):
                if amount:
                    stretches += [("\n".join(p), mix_id, s, lap, at - lap * sizes[p][0], at + amount - lap * sizes[p][0]) for lap in range(laps)]
                    at += amount
    plan = spark.createDataFrame([x for x in stretches if x[5] > 0], "pattern string, mix_id int, source string, lap int, low long, high long")
    # running sums over a pattern of any size: buckets along the seeded order, then within each bucket
    many = placed.groupBy("pattern").agg((1 + F.floor(F.count("*") / BUCKET)).alias("buckets"))
    bucket = F.floor((F.col("draw").cast("double") / F.lit(2.0**64) + 0.5) * F.col("buckets")).cast("int")
    line = placed.join(broadcast_if_small(many, len(sizes)), "pattern").withColumn("bucket", bucket)
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = line.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t")).select("pattern", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("pattern", "bucket").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1)
    laid = line.withColumn("at", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(steps, ["pattern", "bucket"])
    laid = laid.withColumn("start", F.col("from") + F.col("at"))
    drawn = laid.join(broadcast_if_small(plan, len(stretches)), "pattern").where("start >= low and start < high")
    selection = drawn.groupBy("mix_id", "source", F.element_at("held", F.col("source")).alias("doc_id"), "tokens").agg(F.count("*").cast("int").alias("repeats")).select(
        "mix_id", "source", "doc_id", "repeats", "tokens"
    )
    return selection, total


def shares(selection: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Target and actual share of each source of each mix, with its tokens and documents.

    With the ``total`` of all documents' tokens also ``asked_tokens`` and the share of them that
    was filled: a source without enough text raises the actual shares of the others, not what they fill.
    """
    used = selection.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    joined = targets.select("mix_id", "source", "target_share", "corpus_multiple").join(used, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    every = F.sum("tokens").over(Window.partitionBy("mix_id"))
    out = joined.withColumn("actual_share", F.round(F.col("tokens") / F.nullif(every, F.lit(0)), 6))
    if total is not None:
        out = out.withColumn("asked_tokens", (F.col("target_share") * F.col("corpus_multiple") * total).cast("long")).withColumn("filled", F.round(F.col("tokens") / F.nullif("asked_tokens", F.lit(0)), 6))
    return out.drop("corpus_multiple")


def p7_mix(spark, sf_dir: str) -> DataFrame:
    """The documents of every mix with their repeats."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """The shares that every mix actually reaches, and how much of what was asked."""
    targets = table(spark, sf_dir, "mix_targets")
    selection, total = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), targets)
    return shares(selection, targets, total)


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLES: dict[str, str] = {}
