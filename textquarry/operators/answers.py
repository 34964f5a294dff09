"""Verification of answers and evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import canonical_number, citation_ids, numbers, strip_citations, stripped
from textquarry.operators.metadata import _RE2_LOOSE, LOOSE
from textquarry.operators.search import q_dense, q_hybrid
from textquarry.session import table

# Phrases by which the beginning of an answer says that it has none.
NO_ANSWER = (
    r"(?iU)ответа\s+нет|нет\s+ответа|нет\s+(?:сведений|данных)|(?:сведени|данны)\w*\s[^.]{0,80}?(?:нет|отсутству)"
    r"|не\s+содерж|отсутству|не\s+указан|не\s+привод|невозможно"
)
# Letters that look alike, and dashes, in their order; Cyrillic to Latin.
LOOK_ALIKE = "АВЕКМНОРСТХІУаеорсхуі−–—"
LOOKS_AS = "ABEKMHOPCTXIYaeopcxyi---"


def says_no_answer(answer: Column) -> Column:
    """Whether the first paragraph, without markers, says within 400 characters that there is no answer; null stays null."""
    first = F.substring(F.regexp_replace(F.substring_index(stripped(answer), "\n\n", 1), r"\[S\d+\]", ""), 1, 400)
    return first.rlike(NO_ANSWER)


def ungrounded(answer: Column, *grounds: Column) -> Column:
    """Numbers of the answer, as written but unsigned, that no ground holds in canonical form.

    Markers and names of standards are no numbers of the answer; each is reported once.
    """
    allowed = F.transform(F.flatten(F.array(*[numbers(F.coalesce(g, F.lit(""))) for g in grounds])), canonical_number)
    body = F.regexp_replace(F.regexp_replace(answer, r"\[S\d+\]", " "), LOOSE, " ")
    written = F.transform(numbers(body), lambda x: F.regexp_replace(x, r"^[-+±]+", ""))
    return F.array_distinct(F.filter(written, lambda x: ~F.array_contains(allowed, canonical_number(x))))


def normalize_answer(c: Column) -> Column:
    """One alphabet, one dash, lower case, decimal comma, no white space."""
    low = F.lower(F.translate(F.translate(c, "ёЁ", "еЕ"), LOOK_ALIKE, LOOKS_AS))
    return F.regexp_replace(F.regexp_replace(low, r"(?U)(?<=\d)\.(?=\d)", ","), r"(?U)\s+", "")


def holds(text: Column, needle: Column) -> Column:
    """Whether the text holds the needle; one that begins with a digit must not continue a number.  The empty needle is held."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    guarded = F.exists(
        at, lambda i: (F.substring(text, i, F.length(needle)) == needle) & ~F.when(i > 1, F.substring(text, i - 1, F.lit(1)).rlike(r"[\d,]")).otherwise(F.lit(False))
    )
    return (needle == "") | F.when(needle.rlike(r"^\d"), F.contains(text, needle) & guarded).otherwise(F.contains(text, needle))


def answer_is_correct(answer: Column, expected: Column) -> Column:
    """All groups must hold, each by any of its spellings; nothing expected gives null."""
    text = normalize_answer(answer)
    inside = F.forall(expected, lambda group: F.exists(group, lambda e: holds(text, normalize_answer(e))))
    return F.when(F.size(expected) > 0, inside)


def split_of(key: Column, given: Column) -> Column:
    parity = F.conv(F.substring(F.sha1(key.cast("string")), 1, 2), 16, 10).cast("int") % 2
    return F.coalesce(given, F.when(parity == 0, "tune").otherwise("test"))


def gate_stats(records: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Answer and refusal rates at each threshold; ``records`` has ``out, score``.

    A null score is refused.  Thresholds are a list given by the user, so the join
    repeats the records a fixed number of times and aggregates before any shuffle.
    """
    refused = F.col("score").isNull() | (F.col("score") < F.col("threshold"))
    g = records.join(F.broadcast(thresholds)).groupBy("threshold").agg(
        F.avg(F.when(~F.col("out"), (~refused).cast("int"))).alias("answer_rate"), F.avg(F.when(F.col("out"), refused.cast("int"))).alias("refusal_rate")
    )
    return g.select("threshold", F.round("answer_rate", 6).alias("answer_rate"), F.round("refusal_rate", 6).alias("refusal_rate"), F.round((F.coalesce("answer_rate", F.lit(0.0)) + F.coalesce("refusal_rate", F.lit(0.0))) / 2, 6).alias("balanced"))


def _answers(spark, sf) -> DataFrame:
    """Passages as answers, with citation markers of which some point nowhere."""
    i = table(spark, sf, "eval_items")
    return i.withColumn("answer", F.concat("passage", F.lit(" [S"), (F.col("item_id") % 9).cast("string"), F.lit("] [S2] [S1] .")))


def q_used(spark, sf):
    ids = citation_ids(F.col("answer"))
    return _answers(spark, sf).select("item_id", F.array_join(F.filter(ids, lambda x: x.between(1, 6)), ",").alias("used"), F.array_join(F.filter(ids, lambda x: ~x.between(1, 6)), ",").alias("invalid"))


def q_stripped(spark, sf):
    return _answers(spark, sf).select("item_id", strip_citations(F.col("answer")).alias("answer"))


def q_ungrounded(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", F.array_join(ungrounded(F.col("passage"), F.col("question"), F.col("gold_section")), ";").alias("ungrounded"))


def q_no_answer(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", says_no_answer(F.col("text")).alias("says_no_answer"))


def q_correct(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", answer_is_correct(F.col("passage"), F.col("answer_contains")).alias("correct"))


def q_split(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", split_of(F.col("id"), F.col("split")).alias("split"))


def q_recall(spark, sf):
    """Recall and MRR of the fused ranking, the document of the query chunk being the gold."""
    v = table(spark, sf, "chunk_vectors").join(table(spark, sf, "chunks").select("chunk_id", "doc_id"), "chunk_id").select("vec_id", "doc_id")
    hits = q_hybrid(spark, sf).join(v.select(F.col("vec_id").alias("query"), F.col("doc_id").alias("gold")), "query").join(v.select(F.col("vec_id").alias("item"), "doc_id"), "item")
    first = hits.groupBy("query").agg(F.min(F.when(F.col("gold") == F.col("doc_id"), F.col("rank"))).alias("r"))
    at = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return first.agg(F.count("*").alias("queries"), at(1), at(6), at(30), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def _records(spark, sf) -> DataFrame:
    top = q_dense(spark, sf).groupBy("query").agg(F.max("score").alias("score"))
    return top.select((F.col("query") % 40 == 0).alias("out"), "score")


def _thresholds(spark) -> DataFrame:
    return spark.range(21).select(F.round(F.col("id") / 20, 2).alias("threshold"))


def q_sweep(spark, sf):
    return gate_stats(_records(spark, sf), _thresholds(spark))


def q_choose(spark, sf):
    """Best balanced threshold, the lowest on ties."""
    return gate_stats(_records(spark, sf), _thresholds(spark)).agg(F.max_by("threshold", F.struct("balanced", -F.col("threshold"))).alias("threshold"))


def q_history(spark, sf, turns: int = 4):
    """Last 2 * turns ledger entries of each document, as the messages of a thread."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    return table(spark, sf, "ledger").withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 * turns).select("doc_id", "seq", "n")


_A = "a AS (SELECT item_id, passage || ' [S' || (item_id % 9) || '] [S2] [S1] .' AS answer FROM eval_items)"
_IDS = "i AS (SELECT item_id, unnest(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1))::INT AS s, generate_subscripts(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), 1) AS k FROM a), f AS (SELECT item_id, s, min(k) AS k FROM i GROUP BY 1, 2)"
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({c}, '\[S\d+\]', '', 'g'), ' {{2,}}', ' ', 'g'), ' +([.,;:])', '\1', 'g'))"
_NUMS = r"regexp_extract_all({c}, '(^|[^\pL\pN_,.])([-+±]?\d+([.,]\d+)?)', 2)"
_CANON = r"replace(regexp_replace({x}, '^[-+±]', ''), '.', ',')"
_NORM = r"regexp_replace(list_reduce(range(2), lambda t, i: regexp_replace(t, '(\d)\.(\d)', '\1,\2', 'g'), lower(translate(translate({c}, 'ёЁ', 'еЕ'), '" + LOOK_ALIKE + "', '" + LOOKS_AS + r"'))), '\s+', '', 'g')"
_HOLDS = r"(CASE WHEN regexp_matches({n}, '^\d') THEN regexp_matches({t}, '(^|[^\d,])' || regexp_escape({n})) ELSE contains({t}, {n}) END)"
_NO_ANSWER_SQL = "regexp_matches(substr(regexp_replace(string_split(trim({c}), E'\\n\\n')[1], '\\[S\\d+\\]', '', 'g'), 1, 400), '" + NO_ANSWER.replace("(?iU)", "(?i)").replace("{0,80}", "{{0,80}}").replace("\\w", "[\\pL\\pN_]") + "')"


def _with_search(tail: str) -> str:
    from textquarry.operators.search import _DENSE, _FUSED

    return (_FUSED if "fused" in tail else f"WITH {_DENSE}") + tail


_SWEEP = ", t AS (SELECT round(i / 20.0::DOUBLE, 2) AS threshold FROM range(21) r(i)), x AS (SELECT query % 40 = 0 AS out, max(score) AS score FROM dense GROUP BY query), g AS (SELECT threshold, avg(CASE WHEN NOT out THEN (score >= threshold)::INT END) AS a, avg(CASE WHEN out THEN (score < threshold)::INT END) AS r FROM x, t GROUP BY 1), b AS (SELECT threshold, round(a, 6) AS answer_rate, round(r, 6) AS refusal_rate, round((coalesce(a, 0.0) + coalesce(r, 0.0)) / 2, 6) AS balanced FROM g)"
QUERIES = {
    "used_citations": q_used, "strip_citations": q_stripped, "ungrounded_numbers": q_ungrounded, "no_answer_flag": q_no_answer, "answer_match": q_correct, "split_of": q_split,
    "recall_mrr": q_recall, "gate_sweep": q_sweep, "choose_threshold": q_choose, "history_window": q_history,
}
ORACLES = {
    "used_citations": f"WITH {_A}, {_IDS} SELECT item_id, coalesce(string_agg(s, ',' ORDER BY k) FILTER (s BETWEEN 1 AND 6), '') AS used, coalesce(string_agg(s, ',' ORDER BY k) FILTER (s NOT BETWEEN 1 AND 6), '') AS invalid FROM f GROUP BY 1",
    "strip_citations": f"WITH {_A} SELECT item_id, {_STRIP.format(c='answer')} AS answer FROM a",
    "ungrounded_numbers": f"""WITH n AS (SELECT item_id, list_transform({_NUMS.format(c="regexp_replace(regexp_replace(passage, '\\[S\\d+\\]', ' ', 'g'), '" + _RE2_LOOSE + "', ' ', 'g')")}, lambda x: regexp_replace(x, '^[-+±]+', '')) AS ns, list_transform(list_concat({_NUMS.format(c="coalesce(question, '')")}, {_NUMS.format(c="coalesce(gold_section, '')")}), lambda x: {_CANON.format(x='x')}) AS ok FROM eval_items),
      u AS (SELECT item_id, ok, unnest(ns) AS x, generate_subscripts(ns, 1) AS k FROM n), f AS (SELECT item_id, x, min(k) AS k FROM u WHERE NOT list_contains(ok, {_CANON.format(x='x')}) GROUP BY 1, 2), g AS (SELECT item_id, string_agg(x, ';' ORDER BY k) AS s FROM f GROUP BY 1)
      SELECT e.item_id, coalesce(s, '') AS ungrounded FROM eval_items e LEFT JOIN g USING (item_id)""",
    "no_answer_flag": f"SELECT doc_id, {_NO_ANSWER_SQL.format(c='text')} AS says_no_answer FROM documents WHERE text IS NOT NULL",
    "answer_match": f"SELECT item_id, CASE WHEN len(answer_contains) > 0 THEN len(list_filter(answer_contains, lambda g: len(list_filter(g, lambda e: {_HOLDS.format(t=_NORM.format(c='passage'), n=_NORM.format(c='e'))})) = 0)) = 0 END AS correct FROM eval_items",
    "split_of": "SELECT item_id, coalesce(split, CASE WHEN ('0x' || substr(sha1(id), 1, 2))::INT % 2 = 0 THEN 'tune' ELSE 'test' END) AS split FROM eval_items",
    "recall_mrr": _with_search(""", v AS (SELECT vec_id, doc_id FROM chunk_vectors JOIN chunks USING (chunk_id)), h AS (SELECT f.query, min(CASE WHEN g.doc_id = i.doc_id THEN rank END) AS r FROM fused f JOIN v g ON g.vec_id = f.query JOIN v i ON i.vec_id = f.item GROUP BY 1)
      SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 6 THEN 1.0 ELSE 0.0 END), 6) AS recall_6, round(avg(CASE WHEN r <= 30 THEN 1.0 ELSE 0.0 END), 6) AS recall_30, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM h"""),
    "gate_sweep": _with_search(_SWEEP + " SELECT threshold, answer_rate, refusal_rate, balanced FROM b"),
    "choose_threshold": _with_search(_SWEEP + " SELECT threshold FROM b ORDER BY balanced DESC, threshold LIMIT 1"),
    "history_window": "SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC)::INT AS n FROM ledger QUALIFY n <= 8",
}
