"""Problem 6: evaluation texts leaking into training text.

A distributed positional inverted index.  The terms are runs of five normalised
words; of the corpus, postings are stored for the terms that occur in the test
texts.  In every window of the test text that a match must cover whole, the rarest
term is the anchor; anchor postings give offset-adjusted diagonals (document
position less test offset), and on these diagonals the lists of all terms are
intersected, so that a match is a run of consecutive terms on one diagonal.
Questions of fewer than five words are one term each, of their own length.

Proximity matches take all postings of a document and a test text: terms that follow
one another closely on neighbouring diagonals form a cluster, so that a passage with words
changed, left out or inserted every few words is found by the words that it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.glyphs import skeleton
from textquarry.session import broadcast_if_small, checkpointed, pinned, table

#: Words of an index term.
TERM = 5
#: Consecutive words of a passage that make a leak.
RUN = 18
#: In a proximity match: words between two terms, words by which diagonals may differ from one term to the next, and least share of kept words.
GAP, DRIFT, KEPT = 12, 4, 0.5


#: Marks that may stand where a word is broken at the end of a line, as the inside of a character class.
_BREAK = r"\-\u2010-\u2015\u00ac\u00ad"


def normal_text(column: Column) -> Column:
    """The text in comparison form: breaks inside words joined, compounds closed up, one script, no marks."""
    # the mark comes first in the patterns, so that few places are tried
    joined = F.regexp_replace(column, rf"[{_BREAK}](?<=\p{{L}}[{_BREAK}])[ \t\u00a0]*\r?\n\s*(?=\p{{L}})", "")
    return F.regexp_replace(skeleton(joined), r"[-‐‑](?<=\p{L}[-‐‑])(?=\p{L})", "")


def normal_words(column: Column) -> Column:
    """White-space words in comparison form that hold a letter or digit."""
    return F.filter(F.split(normal_text(column), r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def _tokens(word: Column) -> Column:
    return F.filter(F.split(word, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _terms(hashes: Column, n: int = TERM) -> Column:
    """Hashes of the runs of n tokens, from the hashes of the tokens: no string is built for a run."""
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n)))))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def test_terms(items: DataFrame) -> DataFrame:
    """``item_id, kind, off, h, low, high, n``: terms of questions and passages.

    ``low`` counts the words that begin before the term, ``high`` those that end with
    it, so that ``high - low`` over a run counts the whole words in it; ``n`` is the
    number of terms of the text.  Texts under five words have no term here.
    """
    texts = items.select("item_id", F.explode(F.create_map(F.lit("passage"), "passage", F.lit("question"), "question")).alias("kind", "text"))
    words = pinned(texts.where("text is not null"), "words", normal_words(F.col("text")))
    marked = F.flatten(
        F.transform(
            F.transform("words", _tokens),
            lambda ts, i: F.transform(
                ts, lambda t, k: F.struct(t.alias("t"), (i + F.when(k > 0, 1).otherwise(0)).alias("low"), (i + F.when(k == F.size(ts) - 1, 1).otherwise(0)).alias("high"))
            ),
        )
    )
    rows = pinned(pinned(pinned(words, "m", marked), "th", _hashes(F.col("m.t"))), "terms", _terms(F.col("th"))).where("terms is not null")
    return rows.select("item_id", "kind", F.size("terms").alias("n"), "m", F.posexplode("terms").alias("off", "h")).select(
        "item_id", "kind", "n", "off", "h", F.col("m")[F.col("off")]["low"].alias("low"), F.col("m")[F.col("off") + TERM - 1]["high"].alias("high")
    )


def document_tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, t``: hashes of the tokens of each text in comparison form."""
    return pinned(documents.where("text is not null"), "t", _hashes(_tokens(normal_text(F.col("text"))))).select("doc_id", "t")


def full_index(documents: DataFrame) -> DataFrame:
    """``h, doc_id, pos`` of every term of every document: stored once, it serves any later test texts (``index`` below)."""
    return document_tokens(documents).select(F.posexplode(_terms(F.col("t"))).alias("pos", "h"), "doc_id").select("h", "doc_id", "pos")


def postings(documents: DataFrame, terms: DataFrame, n_terms: int, index: DataFrame | None = None) -> DataFrame:
    """``h, doc_id, pos`` of every occurrence in the corpus, or in its stored index, of a term of the test texts."""
    every = full_index(documents) if index is None else index.select("h", "doc_id", "pos")
    return every.join(broadcast_if_small(terms.select("h").distinct(), n_terms), "h", "left_semi")


def _hashes_of_all(tokens: Column) -> Column:
    """The one term of a text of up to four tokens, as an array."""
    out = F.array().cast("array<bigint>")
    for n in range(1, TERM):
        out = F.when(F.size(tokens) == n, _terms(_hashes(tokens), n)).otherwise(out)
    return out


def short_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, kind, words, whole``: documents that hold a whole question of one to four words."""
    tokens = _tokens(normal_text(F.col("question")))
    short = checkpointed(pinned(items.where("question is not null"), "t", tokens).where(F.size("t").between(1, TERM - 1)).select("item_id", F.size("t").alias("n"), F.explode(_hashes_of_all(F.col("t"))).alias("h")))
    parts = []
    for r in short.select("n").distinct().collect():  # at most four lengths
        n = r["n"]
        held = document_tokens(documents).select("doc_id", F.explode(F.array_distinct(_terms(F.col("t"), n))).alias("h"))
        parts.append(held.join(F.broadcast(short.where(F.col("n") == n)), "h").select("doc_id", "item_id", F.lit("question").alias("kind"), F.col("n").alias("words"), F.lit(True).alias("whole")))  # questions under five words
    if not parts:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, kind string, words int, whole boolean")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, index: DataFrame | None = None) -> DataFrame:
    """``doc_id, item_id, kind, words, span``: proximity matches that keep at least ``run`` words, half of those that they span.

    ``words`` are the words of the document within matched terms.  Exact runs are proximity matches too.
    Null and blank texts take no part; of several clusters the one that keeps most words is reported.
    """
    terms = checkpointed(test_terms(items))
    n_terms = terms.count()
    index = postings(documents, terms, n_terms, index)
    hits = index.join(broadcast_if_small(terms.select("h", "item_id", "kind", "off"), n_terms), "h").select("doc_id", "item_id", "kind", "pos", (F.col("pos") - F.col("off")).alias("diag"))
    order = Window.partitionBy("doc_id", "item_id", "kind").orderBy("pos", "diag")
    step = F.col("pos") - F.lag("pos").over(order)
    apart = F.coalesce((step > GAP + TERM) | (F.abs(F.col("diag") - F.lag("diag").over(order)) > DRIFT), F.lit(True))
    marked = hits.select("*", apart.cast("int").alias("new"), F.when(apart, TERM).otherwise(F.least(F.lit(TERM), step)).alias("kept"))
    found = marked.withColumn("cluster", F.sum("new").over(order)).groupBy("doc_id", "item_id", "kind", "cluster").agg(F.sum("kept").cast("int").alias("words"), (F.max("pos") - F.min("pos") + TERM).cast("int").alias("span"))
    good = found.where((F.col("words") >= run) & (F.col("words") >= KEPT * F.col("span")))
    best = good.groupBy("doc_id", "item_id", "kind").agg(F.max(F.struct("words", (-F.col("span")).alias("least"))).alias("b"))
    return best.select("doc_id", "item_id", "kind", F.col("b.words").alias("words"), (-F.col("b.least")).alias("span"))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, index: DataFrame | None = None) -> DataFrame:
    """``doc_id, item_id, kind, words, whole``: the longest common run of each document and test text.

    Reported are runs of at least ``run`` words of a passage, and whole questions.
    Null and blank texts take no part; repeated documents are each reported.  With a
    stored ``index`` the documents are read for questions under five words alone.
    """
    terms = checkpointed(test_terms(items))
    n_terms = terms.count()
    index = checkpointed(postings(documents, terms, n_terms, index))
    df = index.groupBy("h").agg(F.count("*").alias("df"))
    # the rarest term of every window that a match covers whole: run - 4 terms of a passage, all terms of a question
    span = Window.partitionBy("item_id", "kind").orderBy("off").rowsBetween(0, run - TERM)
    text = Window.partitionBy("item_id", "kind")
    rarest = F.struct("df", "off", "h")
    known = terms.join(broadcast_if_small(df, n_terms), "h")
    anchors = (
        known.select("item_id", "kind", F.when(F.col("kind") == "passage", F.min(rarest).over(span)).otherwise(F.min(rarest).over(text)).alias("a"))
        .select("item_id", "kind", F.col("a.off").alias("off"), F.col("a.h").alias("h"))
        .distinct()
    )
    diagonals = (
        index.join(broadcast_if_small(anchors, n_terms), "h").select("doc_id", "item_id", "kind", (F.col("pos") - F.col("off")).alias("diag")).distinct()
    )
    expected = diagonals.join(broadcast_if_small(terms, n_terms), ["item_id", "kind"]).withColumn("pos", F.col("diag") + F.col("off"))
    matched = expected.join(index, ["doc_id", "pos", "h"], "left_semi")
    order = Window.partitionBy("doc_id", "item_id", "kind", "diag").orderBy("off")
    runs = (
        matched.withColumn("island", F.col("off") - F.row_number().over(order))
        .groupBy("doc_id", "item_id", "kind", "diag", "island")
        .agg((F.max("high") - F.min("low")).alias("words"), (F.count("*") == F.first("n")).alias("whole"))
    )
    long = (
        runs.groupBy("doc_id", "item_id", "kind")
        .agg(F.max("words").cast("int").alias("words"), F.max("whole").alias("whole"))
        .where(((F.col("kind") == "passage") & (F.col("words") >= run)) | ((F.col("kind") == "question") & F.col("whole")))
    )
    return long.unionByName(short_leaks(documents, items))


def p6_leaks(spark, sf_dir: str) -> DataFrame:
    """Leaked texts with the length of the common run."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "question", "passage"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Documents and the test items that each of them gives away."""
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_near(spark, sf_dir: str) -> DataFrame:
    """Proximity matches of passages and questions in documents."""
    return near_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "question", "passage"))


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks, "p6_near": p6_near}
ORACLES: dict[str, str] = {}
