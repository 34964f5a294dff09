"""Evaluation: ranking metrics, gates by split, generation statistics, rescoring and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import numbers
from textquarry.operators import questions as qa
from textquarry.operators.answers import answer_is_correct, says_no_answer, split_of
from textquarry.operators.metadata import LOOSE, editions
from textquarry.operators.search import q_dense, q_hybrid
from textquarry.session import table

K, MIN_SCORE, STEPS = 10, 0.3, 21


def same_edition(found: Column, gold: Column) -> Column:
    """The gold designation itself, or an edition of it where it has no year."""
    return F.coalesce((F.upper(found) == F.upper(gold)) | F.upper(found).startswith(F.concat(F.upper(gold), F.lit("-"))), F.lit(False))


def section_matches(found: Column, gold: Column) -> Column:
    """The gold clause itself or one below it."""
    return (found == gold) | found.startswith(F.concat(gold, F.lit(".")))


def first_ranks(gold: DataFrame, hits: DataFrame, k: int = K) -> DataFrame:
    """``id, gold_section, rank, section_rank``: where the gold document and the gold clause come first among k hits.

    ``gold`` has ``id, gold_designation, gold_section``; ``hits`` ``id, rank, designation, sections, section``.  Null where they do not come.
    """
    held = F.when(F.size("sections") > 0, F.col("sections")).otherwise(F.array(F.coalesce("section", F.lit(""))))
    doc = same_edition(F.col("designation"), F.col("gold_designation"))
    clause = doc & (F.col("gold_section") != "") & F.exists(held, lambda s: section_matches(s, F.col("gold_section")))
    j = gold.join(hits.where(F.col("rank") <= k), "id", "left")
    return j.groupBy("id", "gold_section").agg(F.min(F.when(doc, F.col("rank"))).alias("rank"), F.min(F.when(clause, F.col("rank"))).alias("section_rank"))


def ranking_metrics(ranks: DataFrame, by: str) -> DataFrame:
    """Recall, MRR and, over questions with a gold clause, recall of the clause and its share of first places."""
    clause = F.col("gold_section") != ""
    return ranks.groupBy(by).agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(clause, F.when(F.col("section_rank").isNotNull(), 1.0).otherwise(0.0))), 6).alias("section_recall"),
        F.round(F.avg(F.when(clause, F.when(F.col("section_rank") == 1, 1.0).otherwise(0.0))), 6).alias("section_at_1"),
    )


def missing_gold(gold: DataFrame, available: DataFrame) -> DataFrame:
    """Gold designations of which the corpus has no edition."""
    wanted = gold.where("gold_designation <> ''").select("gold_designation").distinct()
    return wanted.join(editions(available).select("key").distinct(), F.upper("gold_designation") == F.col("key"), "left_anti")


def refused(only_missing: Column, score: Column, threshold: Column) -> Column:
    """A question that names only missing documents, or whose best score is null or under the threshold."""
    return only_missing | score.isNull() | (score < threshold)


def gate_table(records: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``threshold, split``: answered and refused of how many, their rates and the mean of these.

    Rates without questions are null, and so is their mean.  The thresholds are a short list.
    """
    no = refused(F.col("only_missing"), F.col("score"), F.col("threshold"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = records.join(F.broadcast(thresholds)).groupBy("threshold", "split").agg(
        count(~F.col("out") & ~no).alias("answered_in"), count(~F.col("out")).alias("total_in"), count(F.col("out") & no).alias("refused_out"), count(F.col("out")).alias("total_out")
    )
    rate = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return g.withColumn("answer_rate", rate("answered_in", "total_in")).withColumn("refusal_rate", rate("refused_out", "total_out")).withColumn("balanced", F.round((F.col("answer_rate") + F.col("refusal_rate")) / 2, 6))


def generation_stats(results: DataFrame) -> DataFrame:
    """Rates for each ``mode`` of ``mode, out, insufficient, correct, ungrounded``; correct counts only where the answer is none of refusal."""
    inside = ~F.col("out")
    rate = lambda c, of: F.round(F.avg(F.when(of, c.cast("double"))), 6)
    graded = inside & F.col("correct").isNotNull()
    return results.groupBy("mode").agg(
        rate(~F.col("insufficient"), inside).alias("answer_rate"),
        rate(F.col("correct") & ~F.col("insufficient"), graded).alias("accuracy"),
        F.sum(F.when(graded, 1).otherwise(0)).alias("graded"),
        rate(F.col("ungrounded") > 0, inside).alias("ungrounded_rate"),
        rate(F.col("insufficient"), F.col("out")).alias("refusal_rate"),
    )


def rescored(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Results by the present rules from stored answers: ``id, insufficient, ungrounded, correct``; answers to unknown questions drop out.

    ``stored`` has ``id, answer, insufficient, ungrounded``.  A number counts on only if it also stands outside a designation; an empty answer is wrong.
    """
    outside = F.transform(numbers(F.regexp_replace("answer", LOOSE, " ")), lambda x: F.regexp_replace(x, r"^[-+±]+", ""))
    return stored.join(expected, "id").select(
        "id",
        (F.col("insufficient") | F.coalesce(says_no_answer(F.col("answer")), F.lit(False))).alias("insufficient"),
        F.array_intersect("ungrounded", outside).alias("ungrounded"),
        F.when(F.coalesce(F.col("answer"), F.lit("")) == "", False).otherwise(answer_is_correct(F.col("answer"), F.col("answer_contains"))).alias("correct"),
    )


def shown(value: Column) -> Column:
    """Three decimals; a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.3f", value))


def _gold(spark, sf) -> DataFrame:
    return table(spark, sf, "eval_items").where("not out_of_corpus").select(F.col("item_id").alias("id"), "gold_designation", "gold_section")


def _slices(spark, sf) -> DataFrame:
    chunks = qa.labelled(spark, sf).select("chunk_id", "designation", "sections", "section")
    hits = qa._hits(spark, sf).join(chunks, "chunk_id")
    shuffled = hits.where(F.col("rank") <= qa.RERANKED).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.pmod("chunk_id", F.lit(7)), "rank")))
    gold = _gold(spark, sf)
    return first_ranks(gold, hits).withColumn("slice", F.lit("lexical")).unionByName(first_ranks(gold, shuffled).withColumn("slice", F.lit("rerank")))


def q_ranking(spark, sf):
    """Metrics of the ranking by terms, and of its first candidates in another order."""
    return ranking_metrics(_slices(spark, sf), "slice")


def q_missing_gold(spark, sf):
    gold = table(spark, sf, "eval_items").select("gold_designation")
    return missing_gold(gold.unionByName(gold.select(F.concat("gold_designation", F.lit("1")).alias("gold_designation"))), qa.available(spark, sf))


def _gate_records(spark, sf) -> DataFrame:
    sizes = qa.questions_of(spark, sf).select("id", F.size(F.array_distinct(qa.terms(F.col("question")))).alias("size"))
    top = qa._hits(spark, sf).groupBy("id").agg(F.max("score").alias("best"))
    items = table(spark, sf, "eval_items").select(F.col("item_id").alias("id"), F.col("out_of_corpus").alias("out"), split_of(F.col("id"), F.col("split")).alias("split"))
    j = items.join(qa._resolved(spark, sf).select("id", "only_missing"), "id").join(sizes, "id").join(top, "id", "left")
    return j.select("id", "out", "split", "only_missing", F.round(F.col("best") / F.col("size"), 6).alias("score"))


def _thresholds(spark) -> DataFrame:
    return spark.range(STEPS).select(F.round(F.col("id") / (STEPS - 1), 2).alias("threshold"))


def q_gate_table(spark, sf):
    return gate_table(_gate_records(spark, sf), _thresholds(spark))


def q_tuned(spark, sf):
    """The threshold with the best balance on the tune part, the lowest on ties, and what it does on the other part."""
    g = gate_table(_gate_records(spark, sf), _thresholds(spark))
    best = g.where("split = 'tune' and balanced is not null").agg(F.coalesce(F.max_by("threshold", F.struct("balanced", -F.col("threshold"))), F.lit(0.0)).alias("threshold"))
    return g.where("split = 'test'").join(F.broadcast(best), "threshold").select("threshold", "answered_in", "total_in", "refused_out", "total_out")  # one row


def q_graph_gate(spark, sf):
    """Both signals together: refused where either says so."""
    r = _gate_records(spark, sf)
    no = refused(F.col("only_missing"), F.col("score"), F.lit(MIN_SCORE)) | refused(F.col("only_missing"), F.col("score") * 0.8, F.lit(qa.THRESHOLD))
    return r.select(F.col("id").alias("item_id"), "out", no.alias("refused"))


def _results(spark, sf) -> DataFrame:
    items = table(spark, sf, "eval_items").select(F.col("item_id").alias("id"), F.col("out_of_corpus").alias("out"), "answer_contains", "passage")
    checked = qa.verified(qa.answers_of(spark, sf)).select("id", "kept", "used", "insufficient", "loose").join(items, "id")
    rag = checked.select("id", F.lit("retrieved").alias("mode"), "out", "insufficient", answer_is_correct(F.col("kept"), F.col("answer_contains")).alias("correct"), F.when(F.size("used") > 0, F.size("loose")).otherwise(0).alias("ungrounded"))
    whole = items.select("id", F.lit("passage").alias("mode"), "out", says_no_answer(F.col("passage")).alias("insufficient"), answer_is_correct(F.col("passage"), F.col("answer_contains")).alias("correct"), F.lit(0).alias("ungrounded"))
    return rag.unionByName(whole)


def q_generation(spark, sf):
    return generation_stats(_results(spark, sf))


def q_rescored(spark, sf):
    """Stored answers (passages, with all their numbers as unfounded) by the present rules."""
    written = F.array_distinct(F.transform(numbers(F.col("answer")), lambda x: F.regexp_replace(x, r"^[-+±]+", "")))
    stored = table(spark, sf, "eval_items").select("id", F.when(F.col("item_id") % 11 == 0, "").otherwise(F.concat("passage", F.lit(" по ГОСТ 1.2-93"))).alias("answer"), (F.col("item_id") % 4 == 0).alias("insufficient"))
    stored = stored.withColumn("ungrounded", written)
    expected = table(spark, sf, "eval_items").where("item_id % 2 = 1").select("id", "answer_contains")
    return rescored(stored, expected).select("id", "insufficient", F.array_join("ungrounded", ";").alias("ungrounded"), "correct")


def q_report(spark, sf):
    """Lines of the ranking table."""
    cells = [F.rpad("slice", 10, " "), *(F.lpad(shown(F.col(c)), 10, " ") for c in ("recall", "mrr", "section_recall", "section_at_1"))]
    return q_ranking(spark, sf).select("slice", F.concat_ws(" ", *cells).alias("line"))


def q_moved(spark, sf, top: int = 6):
    """Items that fusion moved into the first six."""
    fused, dense = (q(spark, sf).where(F.col("rank") <= top).select("query", "item") for q in (q_hybrid, q_dense))
    return fused.join(dense, ["query", "item"], "left_anti")


def q_order(spark, sf):
    """Chunks in the order of the whole corpus: by designation, then by place in the document."""
    rows = qa.labelled(spark, sf).select("chunk_id", F.coalesce("designation", F.lit("")).alias("designation"), "chunk_index")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("designation").orderBy("chunk_index", "chunk_id"))).select("designation", "nth", "chunk_id").orderBy("designation", "nth")


def _oracles() -> dict[str, str]:
    from textquarry.operators.answers import _HOLDS, _NO_ANSWER_SQL, _NORM, _NUMS, _with_search
    from textquarry.operators.metadata import _RE2_LOOSE

    same = "(upper(designation) = upper(gold_designation) OR starts_with(upper(designation), upper(gold_designation) || '-'))"
    held = "CASE WHEN len(sections) > 0 THEN sections ELSE [coalesce(section, '')] END"
    clause = f"gold_section <> '' AND len(list_filter({held}, lambda s: s = gold_section OR starts_with(s, gold_section || '.'))) > 0"
    ranking = f"""{qa._HITS}, hh AS (SELECT h.id, h.rank, 'lexical' AS slice, c.* FROM h JOIN c ON c.chunk_id = h.chunk_id UNION ALL SELECT h.id, row_number() OVER (PARTITION BY h.id ORDER BY h.chunk_id % 7, h.rank)::INT, 'rerank', c.* FROM h JOIN c ON c.chunk_id = h.chunk_id WHERE h.rank <= 12),
      g AS (SELECT item_id AS id, gold_designation, gold_section, slice FROM eval_items, (VALUES ('lexical'), ('rerank')) v(slice) WHERE NOT out_of_corpus),
      fr AS (SELECT g.id, g.slice, any_value(g.gold_section) AS gold_section, min(CASE WHEN {same} THEN rank END) AS rank, min(CASE WHEN {same} AND {clause} THEN rank END) AS section_rank FROM g LEFT JOIN hh ON hh.id = g.id AND hh.slice = g.slice AND rank <= 10 GROUP BY 1, 2),
      mt2 AS (SELECT slice, count(*) AS questions, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, round(avg(CASE WHEN gold_section <> '' THEN CASE WHEN section_rank IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS section_recall, round(avg(CASE WHEN gold_section <> '' THEN CASE WHEN section_rank = 1 THEN 1.0 ELSE 0.0 END END), 6) AS section_at_1 FROM fr GROUP BY 1)"""
    records = f"""{qa._HITS}, b AS (SELECT id, max(score) AS best FROM h GROUP BY 1), n AS (SELECT id, count(DISTINCT term) AS size FROM (SELECT id, unnest({qa._TERMS.format(c='question')}) AS term FROM q) GROUP BY 1),
      rec AS (SELECT e.item_id AS id, out_of_corpus AS out, coalesce(split, CASE WHEN ('0x' || substr(sha1(e.id), 1, 2))::INT % 2 = 0 THEN 'tune' ELSE 'test' END) AS split, only_missing, round(best::DOUBLE / size, 6) AS score FROM eval_items e JOIN r ON r.id = e.item_id JOIN n ON n.id = e.item_id LEFT JOIN b ON b.id = e.item_id)"""
    no = "(only_missing OR score IS NULL OR score < {t})"
    gate = f"""{records}, t AS (SELECT round(i / 20.0::DOUBLE, 2) AS threshold FROM range(21) x(i)), gt AS (SELECT threshold, split, sum((NOT out AND NOT {no.format(t='threshold')})::INT)::BIGINT AS answered_in, sum((NOT out)::INT)::BIGINT AS total_in, sum((out AND {no.format(t='threshold')})::INT)::BIGINT AS refused_out, sum(out::INT)::BIGINT AS total_out FROM rec, t GROUP BY 1, 2),
      gr AS (SELECT *, round(answered_in::DOUBLE / nullif(total_in, 0), 6) AS answer_rate, round(refused_out::DOUBLE / nullif(total_out, 0), 6) AS refusal_rate FROM gt), gb AS (SELECT *, round((answer_rate + refusal_rate) / 2, 6) AS balanced FROM gr)"""
    right = lambda text: f"CASE WHEN len(answer_contains) > 0 THEN len(list_filter(answer_contains, lambda g: len(list_filter(g, lambda e: {_HOLDS.format(t=_NORM.format(c=text), n=_NORM.format(c='e'))})) = 0)) = 0 END"
    verified = qa.ORACLES["verify_citations"]
    unsigned = lambda c: f"list_transform({_NUMS.format(c=c)}, lambda x: regexp_replace(x, '^[-+±]+', ''))"
    return {
        "ranking_metrics": f"WITH {ranking} SELECT * FROM mt2",
        "missing_gold": "WITH g AS (SELECT gold_designation FROM eval_items UNION SELECT gold_designation || '1' FROM eval_items) SELECT gold_designation FROM g WHERE gold_designation <> '' AND NOT EXISTS (SELECT 1 FROM doc_meta d WHERE upper(designation) = upper(gold_designation) OR starts_with(upper(designation), upper(gold_designation) || '-'))",
        "gate_table": f"WITH {gate} SELECT * FROM gb",
        "tuned_gate": f"WITH {gate}, best AS (SELECT coalesce((SELECT threshold FROM gb WHERE split = 'tune' AND balanced IS NOT NULL ORDER BY balanced DESC, threshold LIMIT 1), 0.0) AS threshold) SELECT threshold, answered_in, total_in, refused_out, total_out FROM gb JOIN best USING (threshold) WHERE split = 'test'",
        "graph_gate": f"WITH {records} SELECT id AS item_id, out, {no.format(t='0.3')} OR only_missing OR score IS NULL OR score * 0.8 < 0.1 AS refused FROM rec",
        "generation_stats": f"""WITH vf AS ({verified.replace('SELECT id AS item_id, CASE WHEN len(ws)', 'SELECT id, kept, len(used) AS n_used, len(loose) AS n_loose, CASE WHEN len(ws)')}),
          rs AS (SELECT 'retrieved' AS mode, out_of_corpus AS out, insufficient, {right('kept')} AS correct, CASE WHEN n_used > 0 THEN n_loose ELSE 0 END AS ungrounded FROM vf JOIN eval_items e ON e.item_id = vf.id UNION ALL SELECT 'passage', out_of_corpus, {_NO_ANSWER_SQL.format(c='passage')}, {right('passage')}, 0 FROM eval_items)
          SELECT mode, round(avg(CASE WHEN NOT out THEN (NOT insufficient)::INT END), 6) AS answer_rate, round(avg(CASE WHEN NOT out AND correct IS NOT NULL THEN (correct AND NOT insufficient)::INT END), 6) AS accuracy, sum((NOT out AND correct IS NOT NULL)::INT)::BIGINT AS graded, round(avg(CASE WHEN NOT out THEN (ungrounded > 0)::INT END), 6) AS ungrounded_rate, round(avg(CASE WHEN out THEN insufficient::INT END), 6) AS refusal_rate FROM rs GROUP BY 1""",
        "rescored": f"""WITH s AS (SELECT id, CASE WHEN item_id % 11 = 0 THEN '' ELSE passage || ' по ГОСТ 1.2-93' END AS answer, item_id % 4 = 0 AS ins, answer_contains FROM eval_items WHERE item_id % 2 = 1), o AS (SELECT *, {unsigned('answer')} AS ns, {unsigned("regexp_replace(answer, '" + _RE2_LOOSE + "', ' ', 'g')")} AS outside FROM s)
          SELECT id, ins OR {_NO_ANSWER_SQL.format(c='answer')} AS insufficient, array_to_string(list_filter(ns, lambda x, k: list_contains(outside, x) AND list_position(ns, x) = k), ';') AS ungrounded, CASE WHEN answer = '' THEN false ELSE {right('answer')} END AS correct FROM o""",
        "ranking_report": f"WITH {ranking} SELECT slice, concat_ws(' ', rpad(slice, 10, ' '), lpad(printf('%.3f', recall), 10, ' '), lpad(printf('%.3f', mrr), 10, ' '), lpad(coalesce(printf('%.3f', section_recall), '—'), 10, ' '), lpad(coalesce(printf('%.3f', section_at_1), '—'), 10, ' ')) AS line FROM mt2",
        "moved_into_top": _with_search(" SELECT f.query, f.item FROM fused f WHERE rank <= 6 AND NOT EXISTS (SELECT 1 FROM dense d WHERE d.query = f.query AND d.item = f.item AND d.rank <= 6)"),
        "corpus_order": f"WITH {qa._LABELLED} SELECT coalesce(designation, '') AS designation, row_number() OVER (PARTITION BY coalesce(designation, '') ORDER BY chunk_index, chunk_id)::INT AS nth, chunk_id FROM c",
    }


QUERIES = {
    "ranking_metrics": q_ranking, "missing_gold": q_missing_gold, "gate_table": q_gate_table, "tuned_gate": q_tuned, "graph_gate": q_graph_gate, "generation_stats": q_generation, "rescored": q_rescored, "ranking_report": q_report,
    "moved_into_top": q_moved, "corpus_order": q_order,
}
ORACLES = _oracles()
