"""From question to checked answer: designations, filtered retrieval, context, refusal, citations and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import citation_ids, strip_citations, stripped
from textquarry.operators import metadata
from textquarry.operators.answers import says_no_answer, ungrounded
from textquarry.operators.metadata import base_number, editions, find_designations
from textquarry.session import broadcast_if_small, table

HITS, RERANKED, TOP, THRESHOLD, LISTED, TURNS = 30, 12, 6, 0.1, 20, 4

# Wording of messages, warnings, labels and prompts, and what stands between the parts.
NOT_FOUND = "В базе не нашлось фрагментов, релевантных вопросу. Возможно, нужный стандарт ещё не загружен в корпус."
LACKING = " нет в базе."
LACKING_BUT = (" нет в базе (есть другая редакция: ", ").")
LISTING = ("Сейчас в базе:\n", "— ", "\n…и ещё ")
ONLY_KNOWN = " Ответ дан только по имеющимся документам."
NO_CITATION = "Ответ не подкреплён ни одной ссылкой на фрагменты документов."
WRONG_MARKERS = ("Модель сослалась на несуществующие фрагменты (", "): относящиеся к ним утверждения источником не подтверждены.")
UNFOUNDED = ("Этих чисел нет в процитированных фрагментах: ", ". Сверьте их с документом.")
WARNING = "⚠ "
CLAUSE, CLAUSES, PAGES, RANGE = "п. ", "пп. ", "стр. ", "–"
BETWEEN = "\n\n---\n\n"
SCANNED = " [распознано OCR, возможны ошибки]"
USER = ("ФРАГМЕНТЫ ДОКУМЕНТОВ:\n\n", "\n\nВОПРОС: ")
#: Instructions for the model; any other may be given.
SYSTEM = "Отвечай только по приведённым фрагментам и после каждого утверждения ставь номер источника в виде [S1]. Числа и единицы переписывай без изменений. Если ответа во фрагментах нет, так и скажи."


def mentions(questions: DataFrame) -> DataFrame:
    """``id, nth, mention``: designations that a question names, in order of first occurrence."""
    return questions.select("id", F.posexplode(find_designations(F.col("question"))).alias("nth", "mention"))


def resolution(questions: DataFrame, available: DataFrame) -> DataFrame:
    """``id, mentioned, matched, missing, alternatives, only_missing`` of each question.

    A mention without a year matches all editions; one that matches none is missing,
    and the other editions of its number are its alternatives.  Questions that name
    nothing have empty arrays; a null question names nothing.
    """
    known, m = editions(available), mentions(questions)
    found = m.join(known.select("designation", "key"), F.upper("mention") == F.col("key"), "left").groupBy("id", "nth", "mention").agg(F.array_sort(F.collect_set("designation")).alias("found"))
    other = known.select("designation", "base").distinct()
    near = found.where("size(found) = 0").withColumn("base", base_number(F.col("mention"))).join(other, "base").groupBy("id", "nth").agg(F.array_sort(F.collect_set("designation")).alias("near"))
    every = found.join(near, ["id", "nth"], "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "mention", "found", "near"))).alias("m"))
    lost = F.filter("m", lambda x: F.size(x["found"]) == 0)
    none = F.array().cast("array<string>")
    out = questions.select("id").join(every, "id", "left").select(
        "id",
        F.coalesce(F.col("m.mention"), none).alias("mentioned"),
        F.coalesce(F.array_distinct(F.flatten("m.found")), none).alias("matched"),
        F.coalesce(F.transform(lost, lambda x: x["mention"]), none).alias("missing"),
        F.coalesce(F.transform(lost, lambda x: F.coalesce(x["near"], none)), F.array().cast("array<array<string>>")).alias("alternatives"),
    )
    return out.withColumn("only_missing", (F.size("missing") > 0) & (F.size("matched") == 0))


def missing_message(missing: Column, alternatives: Column) -> Column:
    """Which documents the corpus lacks, with the editions it has instead; empty where none."""
    one = F.zip_with(
        missing, alternatives,
        lambda m, a: F.concat(m, F.when(F.size(a) > 0, F.concat(F.lit(LACKING_BUT[0]), F.array_join(a, ", "), F.lit(LACKING_BUT[1]))).otherwise(LACKING)),
    )
    return F.array_join(one, " ")


def terms(text: Column) -> Column:
    """Lower-case words of three characters and more: the lexical stand-in for learnt sparse weights."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)), lambda w: F.length(w) >= 3)


def lexical_hits(questions: DataFrame, chunks: DataFrame, resolved: DataFrame, k: int = HITS) -> DataFrame:
    """``id, chunk_id, score, rank``: chunks by the number of a question's distinct terms that they hold.

    Where the question names known documents only their chunks take part, and that
    before ranking; a question that names only missing ones has no hit.  Ties by chunk_id.
    """
    asked = questions.join(resolved.where("not only_missing").select("id", "matched"), "id")
    q = asked.select("id", "matched", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    c = chunks.select("chunk_id", "designation", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    # the terms of few questions are broadcast, so that a chunk's matches meet where it lies
    pairs = c.join(broadcast_if_small(q, q.count()), "term").where((F.size("matched") == 0) | F.array_contains("matched", F.col("designation")))
    scores = pairs.groupBy("id", "chunk_id").agg(F.count("*").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def selected(hits: DataFrame, sizes: DataFrame, candidates: int = RERANKED, top: int = TOP, threshold: float = THRESHOLD) -> DataFrame:
    """The context of each question: ``id, chunk_id, place, rerank_score`` and the best score of all candidates.

    With no candidates asked for, the first by rank; else the first ``candidates`` are scored (share of
    the question's terms, the stand-in for a model), sorted with ties in rank order, and those at the threshold kept.
    """
    if candidates <= 0:
        return hits.where(F.col("rank") <= top).select("id", "chunk_id", F.col("rank").alias("place"), F.lit(None).cast("double").alias("rerank_score"), F.lit(0.0).alias("best_score"))
    scored = hits.where(F.col("rank") <= candidates).join(sizes, "id").withColumn("rerank_score", F.round(F.col("score") / F.col("size"), 6))
    by = Window.partitionBy("id")
    placed = scored.withColumn("place", F.row_number().over(by.orderBy(F.desc("rerank_score"), "rank"))).withColumn("best_score", F.max(F.coalesce("rerank_score", F.lit(0.0))).over(by))
    return placed.where((F.col("rerank_score") >= threshold) & (F.col("place") <= top)).select("id", "chunk_id", "place", "rerank_score", "best_score")


def clause_label(sections: Column, section: Column) -> Column:
    """``п. 3.2``, or ``пп. 3.3–3.7`` for a range; null where there is none."""
    one = F.when(F.size(sections) > 0, F.element_at(sections, 1)).otherwise(section)
    many = F.concat(F.lit(CLAUSES), F.element_at(sections, 1), F.lit(RANGE), F.element_at(sections, -1))
    return F.when(F.size(sections) > 1, many).when(one != "", F.concat(F.lit(CLAUSE), one))


def citation_label(designation: Column, doc_id: Column, status: Column, sections: Column, section: Column, first: Column, last: Column) -> Column:
    """Designation (status), clauses, pages; what is not known is left out."""
    name = F.coalesce(F.nullif(designation, F.lit("")), doc_id, F.lit("документ"))
    named = F.when((status != "") & (status != "неизвестно"), F.concat(name, F.lit(" ("), status, F.lit(")"))).otherwise(name)
    pages = F.when(first.isNotNull(), F.concat(F.lit(PAGES), first.cast("string"), F.when(last != first, F.concat(F.lit(RANGE), last.cast("string"))).otherwise("")))
    return F.concat_ws(", ", named, clause_label(sections, section), pages)


def labelled(spark, sf) -> DataFrame:
    """Chunks with the passport of their document and their label."""
    meta = metadata.last_by_key(table(spark, sf, "doc_meta"), "doc_id", "meta_id").select("doc_id", "designation", "status", "title", "replaced_by", "source_path", "source_url")
    chunks = table(spark, sf, "chunks").join(meta, "doc_id", "left")
    label = citation_label(F.col("designation"), F.col("doc_id"), F.col("status"), F.col("sections"), F.col("section"), F.col("page_start"), F.col("page_end"))
    return chunks.withColumn("label", label)


def context(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, context``: numbered blocks of label and text in order of place."""
    header = F.concat(F.lit("[S"), F.col("place").cast("string"), F.lit("] "), F.col("label"), F.when(F.col("from_ocr"), F.lit(SCANNED)).otherwise(""))
    rows = chosen.join(chunks, "chunk_id").select("id", "place", F.concat(header, F.lit("\n"), "text").alias("block"))
    blocks = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("b"))
    return blocks.select("id", F.array_join("b.block", BETWEEN).alias("context"))


def corpus_summary(available: DataFrame, most: int = LISTED) -> DataFrame:
    """One row ``summary``: the first designations in order with their titles, and how many more there are."""
    known = available.where("designation is not null").groupBy("designation").agg(F.max("title").alias("title"))
    first = known.orderBy("designation").limit(most)
    line = F.concat(F.lit(LISTING[1]), "designation", F.when(F.col("title") != "", F.concat(F.lit(" «"), "title", F.lit("»"))).otherwise(""))
    lines = first.agg(F.array_sort(F.collect_list(F.struct("designation", line.alias("line")))).alias("l"))
    count = known.agg(F.count("*").alias("n"))
    rest = F.when(F.col("n") > most, F.concat(F.lit(LISTING[2]), (F.col("n") - most).cast("string"))).otherwise("")
    text = F.concat(F.lit(LISTING[0]), F.array_join("l.line", "\n"), rest)
    return lines.crossJoin(count).select(F.when(F.col("n") > 0, text).otherwise("").alias("summary"))  # one row by one row


def refusal_reason(missing: Column, candidates: Column, passes: Column) -> Column:
    """Which check stopped a question, the first that applies."""
    return (
        F.when((F.size(missing) > 0) & (candidates == 0), "missing_designation").when(~passes, "weak_dense_match").when(candidates == 0, "no_candidates").otherwise("below_rerank_threshold")
    )


def strip_invalid(answer: Column, available: Column) -> Column:
    """The answer without markers of sources that do not exist, doubled spaces and spaces before punctuation."""
    ids = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[S\d+\]"), F.lit(0)))
    number = lambda m: F.regexp_extract(m, r"\d+", 0).cast("int")
    bad = F.filter(ids, lambda m: ~number(m).between(1, available))
    kept = F.aggregate(bad, answer, lambda text, m: F.replace(text, m, F.lit("")))
    return stripped(F.regexp_replace(F.regexp_replace(kept, " {2,}", " "), r" +([.,;:])", "$1"))


def verified(answers: DataFrame) -> DataFrame:
    """Warnings of each answer, the answer as shown, and whether it is insufficient.

    ``answers`` has ``id, question, answer, sources (in order: struct of label and text), missing, alternatives``.
    Markers of sources that do not exist go; warnings name missing documents,
    those markers, and either the lack of any citation or the numbers that no cited source holds.
    """
    n = F.size("sources")
    ids = citation_ids(F.col("answer"))
    a = answers.withColumn("invalid", F.filter(ids, lambda i: ~i.between(1, n))).withColumn("kept", strip_invalid(F.col("answer"), n))
    a = a.withColumn("used", F.filter(citation_ids(F.col("kept")), lambda i: i.between(1, n)))
    cited = F.transform("used", lambda i: F.element_at("sources", i))
    ground = F.array_join(F.flatten(F.transform(cited, lambda s: F.array(s["label"], s["text"]))), "\n")
    a = a.withColumn("loose", ungrounded(F.col("kept"), F.col("question"), ground))
    note = missing_message(F.col("missing"), F.col("alternatives"))
    warnings = F.array_compact(
        F.array(
            F.when(F.size("missing") > 0, F.concat(note, F.lit(ONLY_KNOWN))),
            F.when(
                F.size("invalid") > 0,
                F.concat(
                    F.lit(WRONG_MARKERS[0]), F.array_join(F.transform("invalid", lambda i: F.concat(F.lit("S"), i.cast("string"))), ", "),
                    F.lit(WRONG_MARKERS[1]),
                ),
            ),
            F.when(F.size("used") == 0, NO_CITATION).when(
                F.size("loose") > 0, F.concat(F.lit(UNFOUNDED[0]), F.array_join("loose", ", "), F.lit(UNFOUNDED[1]))
            ),
        )
    )
    a = a.withColumn("warnings", warnings)
    marks = F.array_join(F.transform("warnings", lambda w: F.concat(F.lit(WARNING), w)), "\n")
    return a.select(
        "id", F.when(F.size("warnings") == 0, F.col("kept")).otherwise(F.concat("kept", F.lit("\n\n"), marks)).alias("shown"), "kept", "used", "invalid", "loose", "warnings",
        ((F.size("used") == 0) | says_no_answer(F.col("kept"))).alias("insufficient"),
    )


def prompts(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """``thread, nth, role, content``: the last ``2 * turns`` messages before the current question, old markers taken out.

    ``messages`` has ``thread, nth, role, content``; the last one of a thread is the question
    and goes into the prompt by itself.  No turns means no history.
    """
    w = Window.partitionBy("thread").orderBy(F.desc("nth"))
    past = messages.withColumn("back", F.row_number().over(w) - 1).where((F.col("back") > 0) & (F.col("back") <= 2 * turns))
    return past.select("thread", "nth", "role", F.when(F.col("role") == "assistant", strip_citations(F.col("content"))).otherwise(F.col("content")).alias("content"))


def conversations(asked: DataFrame, messages: DataFrame, system: str = SYSTEM, turns: int = TURNS) -> DataFrame:
    """``thread, nth, role, content``: what the model gets: instructions, the trimmed history, the context with the question.

    ``asked`` has ``thread, question, context``; ``messages`` as in ``prompts``, the question last.
    """
    history = prompts(messages, turns).select("thread", F.struct(F.lit(1).alias("part"), F.col("nth").cast("long").alias("at")).alias("o"), "role", "content")
    row = lambda part, role, content: asked.select("thread", F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at")).alias("o"), F.lit(role).alias("role"), content.alias("content"))
    every = row(0, "system", F.lit(system)).unionByName(history).unionByName(row(2, "user", F.concat(F.lit(USER[0]), "context", F.lit(USER[1]), "question")))
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("thread").orderBy("o"))).select("thread", "nth", "role", "content")


def questions_of(spark, sf) -> DataFrame:
    """The held-out questions; two thirds name a document, as people write it."""
    i = table(spark, sf, "eval_items")
    named = F.when(F.col("item_id") % 3 == 1, F.concat(F.lit(" (по "), F.regexp_replace("gold_designation", r"^ГОСТ ", "ГОСТу "), F.lit(")"))).when(
        F.col("item_id") % 3 == 2, F.concat(F.lit(" "), F.lower(F.regexp_replace("gold_designation", r"-\d{2,4}$", "")), F.lit(" и СП 99999-2001"))
    )
    return i.select(F.col("item_id").alias("id"), F.concat("question", F.coalesce(named, F.lit(""))).alias("question"), "gold_designation")


def available(spark, sf) -> DataFrame:
    return table(spark, sf, "doc_meta").where("designation is not null").select("designation", "title")


def _resolved(spark, sf) -> DataFrame:
    return resolution(questions_of(spark, sf), available(spark, sf))


def _hits(spark, sf) -> DataFrame:
    return lexical_hits(questions_of(spark, sf), labelled(spark, sf).select("chunk_id", "designation", "text"), _resolved(spark, sf))


def _chosen(spark, sf) -> DataFrame:
    sizes = questions_of(spark, sf).select("id", F.size(F.array_distinct(terms(F.col("question")))).alias("size"))
    return selected(_hits(spark, sf), sizes)


def answers_of(spark, sf) -> DataFrame:
    """Answers of an extractive stand-in for the model: the beginnings of the first two sources, a made-up number and a wrong marker."""
    chunks = labelled(spark, sf).select("chunk_id", "label", "text")
    found = _chosen(spark, sf).join(chunks, "chunk_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "text"))).alias("sources"))
    rows = questions_of(spark, sf).join(_resolved(spark, sf), "id").join(found, "id")
    first, second = F.element_at("sources", 1)["text"], F.try_element_at("sources", F.lit(2))["text"]
    odd = F.when(F.col("id") % 5 == 0, F.lit(" [S9] при 7777,5 мм")).when(F.col("id") % 5 == 1, F.lit(" . по ГОСТ 1.2-93")).otherwise("")
    answer = F.concat(F.substring(first, 1, 160), F.when(F.col("id") % 7 != 0, " [S1]").otherwise(""), odd, F.lit(". "), F.coalesce(F.substring(second, 1, 80), F.lit("")), F.when(F.col("id") % 7 != 0, " [S2] [S1]").otherwise(""))
    return rows.withColumn("answer", answer)


def q_mentions(spark, sf):
    return mentions(questions_of(spark, sf)).select(F.col("id").alias("item_id"), "nth", "mention")


def q_resolution(spark, sf):
    r = _resolved(spark, sf)
    return r.select(F.col("id").alias("item_id"), F.array_join("mentioned", ",").alias("mentioned"), F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), missing_message(F.col("missing"), F.col("alternatives")).alias("message"), "only_missing")


def q_hits(spark, sf):
    return _hits(spark, sf).select(F.col("id").alias("item_id"), "chunk_id", "score", "rank")


def q_chosen(spark, sf):
    return _chosen(spark, sf).select(F.col("id").alias("item_id"), "chunk_id", "place", "rerank_score", "best_score")


def q_labels(spark, sf):
    return labelled(spark, sf).select("chunk_id", "label")


def q_blocks(spark, sf):
    return context(_chosen(spark, sf), labelled(spark, sf).select("chunk_id", "label", "from_ocr", "text")).select(F.col("id").alias("item_id"), "context")


def q_summary(spark, sf):
    return corpus_summary(available(spark, sf))


def q_refusals(spark, sf):
    """Questions without context: the reason, and the message with the corpus summary."""
    hits = _hits(spark, sf).groupBy("id").agg(F.count("*").alias("candidates"), F.max("score").alias("top"))
    kept = _chosen(spark, sf).select("id").distinct().withColumn("kept", F.lit(True))
    rows = _resolved(spark, sf).join(hits, "id", "left").join(kept, "id", "left").where("kept is null or id % 10 = 0")
    n = F.coalesce("candidates", F.lit(0))
    why = refusal_reason(F.col("missing"), n, F.coalesce(F.col("top") >= 3, F.lit(False)))
    text = F.when(F.size("missing") > 0, missing_message(F.col("missing"), F.col("alternatives"))).otherwise(NOT_FOUND)
    return rows.join(F.broadcast(q_summary(spark, sf))).select(F.col("id").alias("item_id"), why.alias("reason"), F.concat_ws("\n\n", text, F.nullif("summary", F.lit(""))).alias("message"))  # the summary is one row


def q_strip_invalid(spark, sf):
    return answers_of(spark, sf).select(F.col("id").alias("item_id"), strip_invalid(F.col("answer"), F.size("sources")).alias("answer"))


def q_citations(spark, sf):
    """One row for each source that an answer cites, in order of first use."""
    a = answers_of(spark, sf)
    used = a.select("id", F.posexplode(F.filter(citation_ids(F.col("answer")), lambda i: i.between(1, F.size("sources")))).alias("nth", "place"))
    chunks = labelled(spark, sf).select("chunk_id", "label", "title", "status", "replaced_by", "doc_id", "source_path", "source_url")
    return used.join(_chosen(spark, sf), ["id", "place"]).join(chunks, "chunk_id").select(
        F.col("id").alias("item_id"), "nth", F.concat(F.lit("S"), F.col("place").cast("string")).alias("marker"), "chunk_id", "label", "title", "status", "replaced_by", "doc_id", "source_path", "source_url", "rerank_score"
    )


def q_verified(spark, sf):
    v = verified(answers_of(spark, sf))
    return v.select(F.col("id").alias("item_id"), "shown", F.array_join(F.transform("used", lambda x: x.cast("string")), ",").alias("used"), F.array_join("loose", ";").alias("loose"), F.size("warnings").alias("warnings"), "insufficient")


def messages_of(spark, sf) -> DataFrame:
    """Ledger entries of a document as the messages of a thread, question and answer by turns."""
    odd = F.col("seq") % 2 == 1
    return table(spark, sf, "ledger").select(F.col("doc_id").alias("thread"), F.col("seq").alias("nth"), F.when(odd, "user").otherwise("assistant").alias("role"), F.concat("path", F.when(odd, "?").otherwise(" [S1] [S3] .")).alias("content"))


def q_prompts(spark, sf):
    return prompts(messages_of(spark, sf))


_LOOSE = metadata._RE2_LOOSE
_QUESTIONS = r"""q AS (SELECT item_id AS id, question || coalesce(CASE item_id % 3 WHEN 1 THEN ' (по ' || regexp_replace(gold_designation, '^ГОСТ ', 'ГОСТу ') || ')' WHEN 2 THEN ' ' || lower(regexp_replace(gold_designation, '-\d{2,4}$', '')) || ' и СП 99999-2001' END, '') AS question FROM eval_items)"""


def _all(c: str, g: int) -> str:
    return f"regexp_extract_all({c}, '{_LOOSE}', {g})"


_MENTIONS = f"""{_QUESTIONS}, x AS (SELECT id, unnest({_all('question', 1)}) AS p, unnest({_all('question', 2)}) AS i, unnest({_all('question', 3)}) AS n, unnest({_all('question', 4)}) AS y, generate_subscripts({_all('question', 1)}, 1) AS k FROM q),
 z AS (SELECT id, {metadata._PLAIN.format(p='p', i='i', n='n', y='y')} AS mention, min(k) AS k FROM x GROUP BY ALL), z2 AS (SELECT id, mention, min(k) AS k FROM z GROUP BY 1, 2),
 m AS (SELECT id, mention, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT AS nth FROM z2)"""
_BASE = metadata._BASE
_RESOLVED = f"""{_MENTIONS}, d AS (SELECT DISTINCT designation FROM doc_meta WHERE designation IS NOT NULL),
 f AS (SELECT id, nth, mention, d.designation FROM m LEFT JOIN d ON upper(d.designation) = upper(mention) OR starts_with(upper(d.designation), upper(mention) || '-')),
 a AS (SELECT f.id, f.nth, string_agg(d.designation, ', ' ORDER BY d.designation) AS near FROM f JOIN d ON {_BASE.format(d='f.mention')} = {_BASE.format(d='d.designation')} WHERE f.designation IS NULL GROUP BY 1, 2),
 mt AS (SELECT id, designation, min(nth) AS nth FROM f WHERE designation IS NOT NULL GROUP BY 1, 2),
 ml AS (SELECT id, list(designation ORDER BY nth, designation) AS matched FROM mt GROUP BY 1),
 ms AS (SELECT f.id, string_agg(mention, ',' ORDER BY f.nth) AS missing, string_agg(CASE WHEN near IS NULL THEN mention || ' нет в базе.' ELSE mention || ' нет в базе (есть другая редакция: ' || near || ').' END, ' ' ORDER BY f.nth) AS message FROM f LEFT JOIN a ON a.id = f.id AND a.nth = f.nth WHERE designation IS NULL GROUP BY 1),
 mm AS (SELECT id, string_agg(mention, ',' ORDER BY nth) AS mentioned FROM m GROUP BY 1),
 r AS (SELECT q.id, question, coalesce(mentioned, '') AS mentioned, coalesce(matched, []) AS matched, coalesce(missing, '') AS missing, coalesce(message, '') AS message, coalesce(missing, '') <> '' AND len(coalesce(matched, [])) = 0 AS only_missing FROM q LEFT JOIN mm ON mm.id = q.id LEFT JOIN ml ON ml.id = q.id LEFT JOIN ms ON ms.id = q.id)"""
_TERMS = "regexp_extract_all(lower({c}), '[\\pL\\pN]{{3,}}')"
_LABELLED = """meta AS (SELECT * FROM doc_meta QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY meta_id DESC) = 1),
 c AS (SELECT k.*, meta.designation, meta.status, meta.title, meta.replaced_by, meta.source_path, meta.source_url, concat_ws(', ', coalesce(nullif(meta.designation, ''), k.doc_id) || CASE WHEN meta.status <> '' AND meta.status <> 'неизвестно' THEN ' (' || meta.status || ')' ELSE '' END,
  CASE WHEN len(sections) > 1 THEN 'пп. ' || sections[1] || '–' || sections[-1] WHEN len(sections) = 1 THEN 'п. ' || sections[1] WHEN section <> '' THEN 'п. ' || section END,
  'стр. ' || page_start || CASE WHEN page_end <> page_start THEN '–' || page_end ELSE '' END) AS label FROM chunks k LEFT JOIN meta ON meta.doc_id = k.doc_id)"""
_HITS = f"""{_RESOLVED}, {_LABELLED}, qt AS (SELECT DISTINCT id, matched, unnest({_TERMS.format(c='question')}) AS term FROM r WHERE NOT only_missing), ct AS (SELECT DISTINCT chunk_id, designation, unnest({_TERMS.format(c='text')}) AS term FROM c),
 s AS (SELECT id, chunk_id, count(*) AS score FROM qt JOIN ct USING (term) WHERE len(matched) = 0 OR list_contains(matched, designation) GROUP BY 1, 2),
 h AS (SELECT id, chunk_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 30)"""
_CHOSEN = f"""{_HITS}, n AS (SELECT id, count(DISTINCT term) AS size FROM (SELECT id, unnest({_TERMS.format(c='question')}) AS term FROM q) GROUP BY 1),
 p AS (SELECT h.id, chunk_id, round(score::DOUBLE / size, 6) AS rerank_score, rank FROM h JOIN n ON n.id = h.id WHERE rank <= 12),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rerank_score DESC, rank)::INT AS place, max(rerank_score) OVER (PARTITION BY id) AS best_score FROM p),
 w AS (SELECT * FROM o WHERE rerank_score >= 0.1 AND place <= 6)"""
_SUMMARY = """k AS (SELECT designation, max(title) AS title FROM doc_meta WHERE designation IS NOT NULL GROUP BY 1), k2 AS (SELECT *, row_number() OVER (ORDER BY designation) AS i, count(*) OVER () AS n FROM k),
 sm AS (SELECT 'Сейчас в базе:' || E'\\n' || string_agg('— ' || designation || CASE WHEN title <> '' THEN ' «' || title || '»' ELSE '' END, E'\\n' ORDER BY designation) || CASE WHEN any_value(n) > 20 THEN E'\\n' || '…и ещё ' || (any_value(n) - 20) ELSE '' END AS summary FROM k2 WHERE i <= 20)"""
_ANSWERS = f"""{_CHOSEN}, u AS (SELECT w.id, list({{'label': label, 'text': text}} ORDER BY place) AS src FROM w JOIN c ON c.chunk_id = w.chunk_id GROUP BY 1),
 an AS (SELECT r.*, src, substr(src[1].text, 1, 160) || CASE WHEN r.id % 7 <> 0 THEN ' [S1]' ELSE '' END || CASE r.id % 5 WHEN 0 THEN ' [S9] при 7777,5 мм' WHEN 1 THEN ' . по ГОСТ 1.2-93' ELSE '' END || '. ' || coalesce(substr(src[2].text, 1, 80), '') || CASE WHEN r.id % 7 <> 0 THEN ' [S2] [S1]' ELSE '' END AS answer FROM r JOIN u ON u.id = r.id)"""
_KEPT = r"""ak AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(list_reduce(list_filter(range(1, 100), lambda i: i > len(src)), lambda t, i: replace(t, '[S' || i || ']', ''), answer), ' {2,}', ' ', 'g'), ' +([.,;:])', '\1', 'g'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS kept FROM (SELECT * FROM an))"""
QUERIES = {
    "question_designations": q_mentions, "question_resolution": q_resolution, "question_hits": q_hits, "select_context": q_chosen, "citation_labels": q_labels, "context_blocks": q_blocks, "corpus_summary": q_summary,
    "refusals": q_refusals, "strip_invalid_citations": q_strip_invalid, "build_citations": q_citations, "verify_citations": q_verified, "prompt_messages": q_prompts,
}
ORACLES = {
    "question_designations": f"WITH {_MENTIONS} SELECT id AS item_id, nth, mention FROM m",
    "question_resolution": f"WITH {_RESOLVED} SELECT id AS item_id, mentioned, array_to_string(matched, ',') AS matched, missing, message, only_missing FROM r",
    "question_hits": f"WITH {_HITS} SELECT id AS item_id, chunk_id, score, rank FROM h",
    "select_context": f"WITH {_CHOSEN} SELECT id AS item_id, chunk_id, place, rerank_score, best_score FROM w",
    "citation_labels": f"WITH {_LABELLED} SELECT chunk_id, label FROM c",
    "context_blocks": f"WITH {_CHOSEN} SELECT id AS item_id, string_agg('[S' || place || '] ' || label || CASE WHEN from_ocr THEN '{SCANNED}' ELSE '' END || E'\\n' || text, E'\\n\\n---\\n\\n' ORDER BY place) AS context FROM w JOIN c ON c.chunk_id = w.chunk_id GROUP BY 1",
    "corpus_summary": f"WITH {_SUMMARY} SELECT summary FROM sm",
    "refusals": f"""WITH {_CHOSEN}, {_SUMMARY}, hc AS (SELECT id, count(*) AS candidates, max(score) AS top FROM h GROUP BY 1)
      SELECT r.id AS item_id, CASE WHEN missing <> '' AND coalesce(candidates, 0) = 0 THEN 'missing_designation' WHEN NOT coalesce(top >= 3, false) THEN 'weak_dense_match' WHEN coalesce(candidates, 0) = 0 THEN 'no_candidates' ELSE 'below_rerank_threshold' END AS reason,
        CASE WHEN missing <> '' THEN message ELSE '{NOT_FOUND}' END || E'\\n\\n' || summary AS message FROM r LEFT JOIN hc ON hc.id = r.id, sm WHERE r.id NOT IN (SELECT id FROM w) OR r.id % 10 = 0""",
}


def _verification() -> dict[str, str]:
    from textquarry.operators.answers import _CANON, _NO_ANSWER_SQL, _NUMS, _STRIP

    ids = "list_transform(regexp_extract_all({c}, '\\[S(\\d+)\\]', 1), lambda x: x::INT)"
    first = lambda c: f"(SELECT coalesce(list(v ORDER BY k), []) FROM (SELECT v, min(k) AS k FROM (SELECT unnest({ids.format(c=c)}) AS v, generate_subscripts({ids.format(c=c)}, 1) AS k) GROUP BY 1))"
    body = f"regexp_replace({_STRIP.format(c='kept')}, '{_LOOSE}', ' ', 'g')"
    return {
        "strip_invalid_citations": f"WITH {_ANSWERS}, {_KEPT} SELECT id AS item_id, kept AS answer FROM ak",
        "build_citations": f"""WITH {_ANSWERS}, e AS (SELECT id, len(src) AS n, unnest({ids.format(c='answer')}) AS place, generate_subscripts({ids.format(c='answer')}, 1) AS k FROM an), g AS (SELECT id, place, min(k) AS k FROM e WHERE place BETWEEN 1 AND n GROUP BY 1, 2)
          SELECT g.id AS item_id, (row_number() OVER (PARTITION BY g.id ORDER BY k) - 1)::INT AS nth, 'S' || g.place AS marker, c.chunk_id, label, title, c.status, replaced_by, doc_id, source_path, source_url, rerank_score FROM g JOIN w ON w.id = g.id AND w.place = g.place JOIN c ON c.chunk_id = w.chunk_id""",
        "verify_citations": f"""WITH {_ANSWERS}, {_KEPT}, i1 AS (SELECT *, list_filter({first('kept')}, lambda v: v BETWEEN 1 AND len(src)) AS used, list_filter({first('answer')}, lambda v: NOT (v BETWEEN 1 AND len(src))) AS invalid FROM ak),
          i2 AS (SELECT *, array_to_string(list_transform(used, lambda v: src[v].label || E'\\n' || src[v].text), E'\\n') AS ground FROM i1),
          i3 AS (SELECT *, list_transform(list_concat({_NUMS.format(c='question')}, {_NUMS.format(c='ground')}), lambda x: {_CANON.format(x='x')}) AS allowed, list_transform({_NUMS.format(c=body)}, lambda x: regexp_replace(x, '^[-+±]', '')) AS ns FROM i2),
          i4 AS (SELECT *, list_filter(ns, lambda x, k: NOT list_contains(allowed, {_CANON.format(x='x')}) AND list_position(ns, x) = k) AS loose FROM i3),
          i5 AS (SELECT *, list_filter([CASE WHEN missing <> '' THEN message || '{ONLY_KNOWN}' END, CASE WHEN len(invalid) > 0 THEN 'Модель сослалась на несуществующие фрагменты (' || array_to_string(list_transform(invalid, lambda v: 'S' || v), ', ') || '): относящиеся к ним утверждения источником не подтверждены.' END,
            CASE WHEN len(used) = 0 THEN '{NO_CITATION}' WHEN len(loose) > 0 THEN 'Этих чисел нет в процитированных фрагментах: ' || array_to_string(loose, ', ') || '. Сверьте их с документом.' END], lambda v: v IS NOT NULL) AS ws FROM i4)
          SELECT id AS item_id, CASE WHEN len(ws) = 0 THEN kept ELSE kept || E'\\n\\n' || array_to_string(list_transform(ws, lambda v: '⚠ ' || v), E'\\n') END AS shown, array_to_string(used, ',') AS used, array_to_string(loose, ';') AS loose, len(ws)::INT AS warnings, len(used) = 0 OR {_NO_ANSWER_SQL.format(c='kept')} AS insufficient FROM i5""",
        "prompt_messages": f"""WITH m AS (SELECT doc_id AS thread, seq AS nth, CASE WHEN seq % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, path || CASE WHEN seq % 2 = 1 THEN '?' ELSE ' [S1] [S3] .' END AS content, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) - 1 AS back FROM ledger)
          SELECT thread, nth, role, CASE WHEN role = 'assistant' THEN {_STRIP.format(c='content')} ELSE content END AS content FROM m WHERE back BETWEEN 1 AND 8""",
    }


ORACLES |= _verification()
