"""Whole pipelines, as compositions of operators and ports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import questions as qa
from textquarry.ports import first_sentence, generate
from textquarry.session import checkpointed


def ask(asked: DataFrame, chunks: DataFrame, available: DataFrame, model: Callable[[str, str], str] = first_sentence, deadline: float = 120.0) -> DataFrame:
    """``id, shown, insufficient``: from question to checked answer, or to a refusal.

    Designations are resolved; questions naming only missing documents and those without
    context are refused, the others answered by the model from the numbered context and checked against it.
    ``asked`` has ``id, question``; ``chunks`` the columns of ``labelled``; ``available`` ``designation, title``.
    """
    resolved = checkpointed(qa.resolution(asked, available))
    hits = qa.lexical_hits(asked, chunks.select("chunk_id", "designation", "text"), resolved)
    sizes = asked.select("id", F.size(F.array_distinct(qa.terms(F.col("question")))).alias("size"))
    chosen = checkpointed(qa.selected(hits, sizes))
    blocks = qa.context(chosen, chunks)
    answers = checkpointed(generate(asked.join(blocks, "id"), model, deadline))
    sources = chosen.join(chunks.select("chunk_id", "label", "text"), "chunk_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "text"))).alias("sources"))
    done = qa.verified(asked.join(resolved, "id").join(answers.where("answer is not null"), "id").join(sources, "id")).select("id", "shown", "insufficient")
    refused = asked.join(resolved, "id").join(done.select("id"), "id", "left_anti")
    text = F.when(F.size("missing") > 0, qa.missing_message(F.col("missing"), F.col("alternatives"))).otherwise(qa.NOT_FOUND)
    note = refused.join(F.broadcast(qa.corpus_summary(available))).select("id", F.concat_ws("\n\n", text, F.nullif("summary", F.lit(""))).alias("shown"), F.lit(True).alias("insufficient"))  # one row
    return done.unionByName(note)
