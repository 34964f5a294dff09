"""Structure of pages and blocks: clauses, running lines, paragraphs, tables."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import approx_tokens, clause_number, clean_page_text, stripped
from textquarry.session import table

EDGE_LINES, MIN_PAGES, MIN_RATIO = 3, 4, 0.5
# How a clause line begins, and labels of tables and units, which are never running lines.
CLAUSE = r"(?U)^\s*\d{1,3}(?:\.\d{1,3}){0,4}\.?\s+\S"
TABLE_LABEL = r"(?iU)^\s*(?:Т\s*а\s*б\s*л\s*и\s*ц\s*а|(?:Продолжение|Окончание)\s+табл|(?:Размеры\s*,?\s*)?(?:в\s+)?(?:мм|миллиметрах)\b)"


def lines_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key, line_no, line``: one row a line, from 0."""
    return rows.where("text is not null").select(*key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_form(line: Column) -> Column:
    """Form in which running lines are compared: dashes unified, digits masked, tokens of locators sorted."""
    low = F.regexp_replace(F.lower(stripped(line)), "[‐‑–—]", "-")
    short = F.length(F.regexp_replace(low, r"[^\p{L}]+", "")) <= 15
    return F.when(short, F.array_join(F.array_sort(F.split(F.regexp_replace(low, r"\d+", "#"), r"(?U)\s+")), " ")).otherwise(low)


def repeated_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, form, pages``: edge lines seen on at least half the pages of a document of four or more.

    Each distinct line of a page counts once; lines over 80 characters, clause lines
    and labels of tables and units are never headers.
    """
    lines = lines_of(pages, ["doc_id", "page_id"]).where(stripped(F.col("line")) != "")
    # the place among the lines of the page: pages are small, documents are not
    w = Window.partitionBy("page_id")
    placed = lines.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("line_no")))
    edge = F.greatest(F.lit(1), F.least(F.lit(EDGE_LINES), F.floor(F.col("n") / 3)))
    edges = placed.where((F.col("k") <= edge) | (F.col("k") > F.col("n") - edge)).where((F.length(stripped(F.col("line"))) <= 80) & ~F.col("line").rlike(CLAUSE) & ~F.col("line").rlike(TABLE_LABEL))
    counts = edges.select("doc_id", "page_id", stripped(F.col("line")).alias("raw")).distinct().groupBy("doc_id", line_form(F.col("raw")).alias("form")).agg(F.count("*").alias("pages"))
    sizes = pages.where("text is not null").groupBy("doc_id").agg(F.count("*").alias("all_pages")).where(F.col("all_pages") >= MIN_PAGES)
    return counts.join(sizes, "doc_id").where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES // 2), F.floor(F.col("all_pages") * MIN_RATIO))).select("doc_id", "form", "pages")


def blocks_from_text(pages: DataFrame) -> DataFrame:
    """``page_id, first_line, section, lines, text``: a blank line or a clause line begins a block; sections carry on within the page."""
    rows = lines_of(pages, ["page_id"]).withColumn("blank", F.trim("line") == "").withColumn("clause", clause_number(F.col("line")))
    w = Window.partitionBy("page_id").orderBy("line_no")
    begins = F.when(F.col("clause").isNotNull() | F.coalesce(F.lag("blank").over(w), F.lit(True)), 1).otherwise(0)
    marked = rows.withColumn("b", F.sum(begins).over(w)).withColumn("section", F.last("clause", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    return marked.groupBy("page_id", "b").agg(F.max("section").alias("section"), F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select(
        "page_id", "first_line", "section", "lines", stripped(F.array_join("l.line", "\n")).alias("text")
    )


def clause_follows(p: list[int], q: list[int]) -> bool:
    """Whether clause q may come next after p: its first child, or a step of one or two at a level with only ones below."""
    if q == [*p, 1]:
        return True
    for k in range(min(len(p), len(q))):
        if p[:k] == q[:k] and 1 <= q[k] - p[k] <= 2 and all(x == 1 for x in q[k + 1 :]):
            return True
    return False


class Chain:
    """Longest subsequence of clauses in clause order, found as they come; the earliest end on ties.

    What ``clause_follows`` asks of the clause before is that clause itself or a prefix of it,
    so the best chain by prefix stands for all earlier clauses.  Of a clause that came only two numbers are kept.
    """

    def __init__(self) -> None:
        self.parent, self.place = array("q"), array("q")
        self.exact: dict[tuple, tuple[int, int]] = {}  # clause or prefix -> (length of its best chain, -index)
        self.prefix: dict[tuple, tuple[int, int]] = {}
        self.last, self.most = -1, 0

    def add(self, clause: str, place: int = 0) -> None:
        i = len(self.parent)
        q = tuple(int(x) for x in clause.split("."))
        ways = [self.exact[q[:-1]]] if q[-1] == 1 and q[:-1] in self.exact else []
        for k in range(len(q) - 1, -1, -1):
            ways += [self.prefix[p] for p in ((*q[:k], q[k] - 1), (*q[:k], q[k] - 2)) if p in self.prefix]
            if q[k] != 1:
                break
        length, last = max(ways, default=(0, 1))
        self.parent.append(-last)
        self.place.append(place)
        mine = (length + 1, -i)
        self.exact[q] = max(self.exact.get(q, mine), mine)
        for k in range(1, len(q) + 1):
            self.prefix[q[:k]] = max(self.prefix.get(q[:k], mine), mine)
        if length + 1 > self.most:
            self.most, self.last = length + 1, i

    def path(self) -> list[int]:
        """Indexes of the chain."""
        out, at = [], self.last
        while at >= 0:
            out.append(at)
            at = self.parent[at]
        return out[::-1]


def longest_chain(clauses: list[str]) -> list[int]:
    chain = Chain()
    for clause in clauses:
        chain.add(clause)
    return chain.path()


def openings(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_seq, clause``: the clauses that first lines of blocks open."""
    return blocks.select("doc_id", "block_seq", clause_number(F.split("text", "\n")[0]).alias("clause")).where("clause is not null")


def clause_chain(opening: DataFrame) -> DataFrame:
    """The openings that form the document's chain of clauses."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, chain = None, Chain()

        def members() -> pd.DataFrame:
            return pd.DataFrame([(doc, chain.place[i]) for i in chain.path()], columns=["doc_id", "block_seq"])

        for batch in batches:
            for doc_id, seq, clause in batch.itertuples(index=False):
                if doc_id != doc:
                    yield members()
                    doc, chain = doc_id, Chain()
                chain.add(clause, seq)
        yield members()

    # a document is read in order, batch by batch, and never held as rows
    ordered = opening.select("doc_id", "block_seq", "clause").repartition("doc_id").sortWithinPartitions("doc_id", "block_seq")
    return ordered.mapInPandas(fold, "doc_id string, block_seq int").join(opening, ["doc_id", "block_seq"]).select("doc_id", "block_seq", "clause")


def numbered(rows: DataFrame, segment: int = 256) -> DataFrame:
    """``rows`` (``doc_id, block_seq``) with ``nth``, the place in the document from 1: counted by segments, so that no document is one task."""
    parts = rows.withColumn("part", F.floor(F.col("block_seq") / segment))
    before = parts.groupBy("doc_id", "part").agg(F.count("*").alias("n")).withColumn("past", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("block_seq"))
    return parts.withColumn("inner", inside).join(before.select("doc_id", "part", "past"), ["doc_id", "part"]).withColumn("nth", F.col("past") + F.col("inner")).drop("part", "past", "inner")


def last_before(rows: DataFrame, value: Column, segment: int = 256) -> DataFrame:
    """``rows`` (``doc_id, block_seq``) with ``carried``, the last value that is not null in an earlier row of the document; by segments too."""
    r = rows.withColumn("_v", value).withColumn("part", F.floor(F.col("block_seq") / segment))
    ends = r.groupBy("doc_id", "part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("block_seq"))).alias("end"))
    carry = ends.withColumn("past", F.last("end", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy("doc_id", "part").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("_own", own).join(carry.select("doc_id", "part", "past"), ["doc_id", "part"]).withColumn("carried", F.coalesce("_own", "past")).drop("_v", "_own", "part", "past")


# The heading of a list of notes, as recognition may give it.
NOTES = r"(?imU)^\s*П\s*р\s*и\s*м\s*[ес]\s*ч\s*а\s*н\s*и\s*я\s*:?\s*$"


def is_table(kind: Column) -> Column:
    return F.coalesce(F.lower(stripped(kind)) == "table", F.lit(False))


def clause_candidates(blocks: DataFrame) -> DataFrame:
    """Openings of text blocks, less the numbered notes that follow a heading of notes from 1 without a gap."""
    rows = numbered(blocks.select("doc_id", "block_seq", "text", (~is_table(F.col("kind"))).alias("plain")))
    rows = rows.select("doc_id", "block_seq", "nth", "plain", clause_number(F.split("text", "\n")[0]).alias("clause"), F.coalesce(F.col("plain") & F.col("text").rlike(NOTES), F.lit(False)).alias("heading"))
    # note n of the heading at place h stands at h + n: a run of equal differences that begins with the heading
    n = F.when(F.col("heading") & ~F.coalesce(F.col("clause").rlike(r"^\d+$"), F.lit(False)), 0).when(F.col("plain") & F.col("clause").rlike(r"^\d+$"), F.col("clause").cast("int"))
    run = rows.withColumn("n", n).where("n is not null").withColumn("start", F.col("nth") - F.col("n"))
    w = Window.partitionBy("doc_id", "start").orderBy("n")
    notes = run.withColumn("place", F.row_number().over(w) - 1).withColumn("headed", F.first("heading").over(w) & (F.first("n").over(w) == 0)).where("headed and n > 0 and place = n").select("doc_id", "block_seq")
    return rows.where("plain and clause is not null").select("doc_id", "block_seq", "clause").join(notes, ["doc_id", "block_seq"], "left_anti")


def inherited(blocks: DataFrame, openers: DataFrame, segment: int = 256) -> DataFrame:
    """``block_id, section``: the clause of the last opener at or before the block in its document, over pages.

    The last clause of each segment of blocks is carried over a window on the segments
    alone and then filled inside them, so that no document is one task.
    """
    rows = blocks.select("block_id", "doc_id", "block_seq", F.floor(F.col("block_seq") / segment).alias("part")).join(openers.select("doc_id", "block_seq", "clause"), ["doc_id", "block_seq"], "left")
    ends = rows.groupBy("doc_id", "part").agg(F.max_by("clause", F.when(F.col("clause").isNotNull(), F.col("block_seq"))).alias("last"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("doc_id", "part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("doc_id", "part").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("own", F.last("clause", ignorenulls=True).over(inside))
    return filled.join(carry, ["doc_id", "part"]).select("block_id", F.coalesce("own", "carried").alias("section"))


def blocks_of_documents(pages: DataFrame) -> DataFrame:
    """``blocks_from_text`` with the clause at the end of the pages before carried on; a page that comes twice counts once."""
    clauses = lines_of(pages, ["doc_id", "page_no", "page_id"]).withColumn("clause", clause_number(F.col("line"))).where("clause is not null")
    ends = clauses.groupBy("doc_id", "page_no").agg(F.max_by("clause", F.struct("page_id", "line_no")).alias("last"))
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    every = pages.select("doc_id", "page_no").distinct().join(ends, ["doc_id", "page_no"], "left")
    carry = every.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null")
    carried = pages.select("page_id", "doc_id", "page_no").join(carry, ["doc_id", "page_no"]).select("page_id", "carried")
    return blocks_from_text(pages).join(carried, "page_id", "left").select("page_id", "first_line", F.coalesce("section", "carried").alias("section"), "lines", "text")


def table_cells(blocks: DataFrame) -> DataFrame:
    """``block_id, row_no, col_no, cell`` of pipe tables, separator rows left out."""
    rows = blocks.where("text is not null").select("block_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    inner = rows.where(F.col("line").rlike(r"^\|.*\|$") & ~F.col("line").rlike(r"^\|[ :|-]+\|$"))
    return inner.select("block_id", "row_no", F.posexplode(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|")).alias("col_no", "cell")).select("block_id", "row_no", "col_no", F.trim("cell").alias("cell"))


def data_rows(cells: DataFrame) -> DataFrame:
    """Whether a row is data: numeric cells are at least half of those not empty."""
    numeric = F.length(F.regexp_replace("cell", r"[^0-9.,±—-]+", "")) >= 0.8 * F.length("cell")
    full = cells.where("cell <> ''")
    return full.groupBy("block_id", "row_no").agg((F.sum(numeric.cast("int")) * 2 >= F.count("*")).alias("is_data"))


def q_clean(spark, sf):
    return table(spark, sf, "page_docs").select("page_id", clean_page_text(F.col("text")).alias("text"))


def q_clauses(spark, sf):
    return lines_of(table(spark, sf, "page_docs"), ["page_id"]).select("page_id", "line_no", clause_number(F.col("line")).alias("clause")).where("clause is not null")


def q_document_sections(spark, sf):
    """Section of each block by the chain of clauses of its document."""
    b = table(spark, sf, "blocks")
    return inherited(b, clause_chain(openings(b)))


def q_assigned(spark, sf):
    """The same where only text blocks open clauses and numbered notes do not."""
    b = table(spark, sf, "blocks")
    return inherited(b, clause_chain(clause_candidates(b)))


def q_document_blocks(spark, sf):
    return blocks_of_documents(table(spark, sf, "page_docs"))


def q_repeated(spark, sf):
    return repeated_lines(table(spark, sf, "page_docs"))


def strip_repeated(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """``page_id, text``: pages without the repeated lines at their edges.

    The edge is counted over all lines, blank ones too; lines further inside stay even
    where they look like a header.  Pages of documents without repeated lines stay as they are.
    """
    forms = repeated.groupBy("doc_id").agg(F.collect_set("form").alias("forms"))  # at most six lines on half the pages: a few forms
    n = F.size("lines")
    edge = F.greatest(F.lit(1), F.least(F.lit(EDGE_LINES), F.floor(n / 3).cast("int")))
    rows = pages.where("text is not null").join(forms, "doc_id", "left").withColumn("lines", F.split("text", "\n")).withColumn("edge", edge)
    near = lambda i: (i < F.col("edge")) | (i >= n - F.col("edge"))
    kept = F.filter("lines", lambda x, i: ~(near(i) & (stripped(x) != "") & F.array_contains("forms", line_form(x))))
    text = stripped(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    return rows.select("page_id", F.when(F.col("forms").isNull(), F.col("text")).otherwise(text).alias("text"))


def q_strip(spark, sf):
    """Pages without their running lines."""
    pages = table(spark, sf, "page_docs")
    return strip_repeated(pages, repeated_lines(pages))


def q_tokens(spark, sf):
    return table(spark, sf, "chunks").where("text is not null").select("chunk_id", approx_tokens(F.col("text")).alias("tokens"), F.coalesce(F.col("token_count") != approx_tokens(F.col("text")), F.lit(True)).alias("stale"))


def q_split(spark, sf, most: int = 400):
    """Plain splitting by size: pieces of 3 * most characters."""
    size = 3 * most
    t = table(spark, sf, "blocks").where("text <> ''")
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    return t.select("block_id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("piece"), F.substring(F.col("text"), i * size + 1, F.lit(size)).alias("text")))).alias("p")).select("block_id", "p.piece", "p.text")


def q_cells(spark, sf):
    return table_cells(table(spark, sf, "blocks"))


def q_data_rows(spark, sf):
    return data_rows(table_cells(table(spark, sf, "blocks")))


def q_chain(spark, sf):
    return clause_chain(openings(table(spark, sf, "blocks")))


_L = "l AS (SELECT doc_id, page_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1)::INT - 1 AS line_no FROM page_docs WHERE text IS NOT NULL)"


def _clause(c: str) -> str:
    return rf"CASE WHEN regexp_matches({c}, '^\s*\d{{1,3}}(\.\d{{1,3}}){{0,4}}\.?\s+\S') AND length(regexp_replace(regexp_replace({c}, '^\s*\d{{1,3}}(\.\d{{1,3}}){{0,4}}\.?\s+', ''), '[^\pL]+', '', 'g')) >= 3 THEN regexp_extract({c}, '^\s*(\d{{1,3}}(\.\d{{1,3}}){{0,4}})\.?\s+\S', 1) END"


def _trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def _form(c: str) -> str:
    low = f"regexp_replace(lower({_trimmed(c)}), '[‐‑–—]', '-', 'g')"
    return rf"CASE WHEN length(regexp_replace({low}, '[^\pL]+', '', 'g')) <= 15 THEN array_to_string(list_sort(regexp_split_to_array(regexp_replace({low}, '\d+', '#', 'g'), ' +')), ' ') ELSE {low} END"


_CLAUSE = CLAUSE.replace("(?U)", "")
_LABEL = TABLE_LABEL.replace("(?iU)", "(?i)").replace(r"\b", r"($|[^\pL\pN_])")
_REP = f"""{_L}, nb AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS k FROM l WHERE {_trimmed('line')} <> ''),
 e AS (SELECT DISTINCT doc_id, page_id, {_trimmed('line')} AS raw FROM nb WHERE (k <= greatest(1, least(3, n // 3)) OR k > n - greatest(1, least(3, n // 3))) AND length({_trimmed('line')}) <= 80 AND NOT regexp_matches(line, '{_CLAUSE}') AND NOT regexp_matches(line, '{_LABEL}')),
 c AS (SELECT doc_id, {_form('raw')} AS form, count(*) AS pages FROM e GROUP BY 1, 2), s AS (SELECT doc_id, count(*) AS all_pages FROM page_docs WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
 r AS (SELECT doc_id, form, pages FROM c JOIN s USING (doc_id) WHERE pages >= greatest(2, floor(all_pages * 0.5)))"""
_C = r"""r AS (SELECT block_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1)::INT - 1 AS row_no FROM blocks WHERE text IS NOT NULL),
 k AS (SELECT block_id, row_no, string_split(substr(line, 2, length(line) - 2), '|') AS cs FROM r WHERE regexp_full_match(line, '\|.*\|') AND NOT regexp_full_match(line, '\|[ :|-]+\|')),
 cells AS (SELECT block_id, row_no, generate_subscripts(cs, 1)::INT - 1 AS col_no, trim(unnest(cs)) AS cell FROM k)"""
_BLOCKS = f"""{_L}, m AS (SELECT doc_id, page_id, line_no, line, trim(line) = '' AS blank, {_clause('line')} AS clause FROM l),
 g AS (SELECT *, CASE WHEN clause IS NOT NULL OR coalesce(lag(blank) OVER (PARTITION BY page_id ORDER BY line_no), true) THEN 1 ELSE 0 END AS s FROM m),
 b AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY line_no) AS b, last_value(clause IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM g)"""
_OPENINGS = rf"""(SELECT doc_id, block_seq, {_clause("string_split(text, E'\n')[1]")} AS clause FROM blocks)"""
_CANDIDATES = rf"""(SELECT doc_id, block_seq, clause FROM (SELECT *, first_value(heading) OVER w AND first_value(n) OVER w = 0 AND n > 0 AND row_number() OVER w - 1 = n AS note FROM (SELECT *, nth - n AS start FROM (SELECT *, CASE WHEN heading AND NOT coalesce(regexp_matches(clause, '^[0-9]+$'), false) THEN 0 WHEN plain AND regexp_matches(clause, '^[0-9]+$') THEN clause::INT END AS n FROM (SELECT doc_id, block_seq, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS nth, NOT coalesce(lower({_trimmed("kind")}) = 'table', false) AS plain, {_clause("string_split(text, E'\n')[1]")} AS clause, NOT coalesce(lower({_trimmed("kind")}) = 'table', false) AND coalesce(regexp_matches(text, '{NOTES.replace("(?imU)", "(?im)")}'), false) AS heading FROM blocks))) WINDOW w AS (PARTITION BY doc_id, start, n IS NULL ORDER BY n)) WHERE plain AND NOT coalesce(note, false))"""
_CHAIN = rf"""WITH RECURSIVE o AS (SELECT *, list_transform(string_split(clause, '.'), lambda x: x::INT) AS q FROM @ WHERE clause IS NOT NULL),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS i FROM o),
      e AS (SELECT y.doc_id, y.i, list(x.i ORDER BY x.i) AS js FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.i < y.i AND (y.q = list_append(x.q, 1) OR len(list_filter(range(1, least(len(x.q), len(y.q)) + 1), lambda k: x.q[1:k - 1] = y.q[1:k - 1] AND y.q[k] - x.q[k] BETWEEN 1 AND 2 AND len(list_filter(y.q[k + 1:], lambda v: v <> 1)) = 0)) > 0) GROUP BY 1, 2),
      l AS (SELECT n.doc_id, list(coalesce(js, []::BIGINT[]) ORDER BY n.i) AS js, count(*) AS n FROM n LEFT JOIN e ON e.doc_id = n.doc_id AND e.i = n.i GROUP BY 1),
      f AS (SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS best, []::BIGINT[] AS parent FROM l
        UNION ALL SELECT doc_id, i + 1, list_append(best, coalesce(m, 0) + 1), list_append(parent, coalesce(list_filter(j, lambda x: best[x] = m)[1], 0))
        FROM (SELECT f.doc_id, i, best, parent, js[i + 1] AS j, list_max(list_transform(js[i + 1], lambda x: best[x])) AS m FROM f JOIN l ON f.doc_id = l.doc_id WHERE i < n)),
      d AS (SELECT f.doc_id, best, parent FROM f JOIN l ON f.doc_id = l.doc_id AND f.i = l.n),
      c AS (SELECT doc_id, parent, list_position(best, list_max(best))::BIGINT AS i FROM d UNION ALL SELECT doc_id, parent, parent[i] FROM c WHERE parent[i] > 0),
      k AS (SELECT n.doc_id, block_seq, clause FROM c JOIN n ON c.doc_id = n.doc_id AND c.i = n.i)"""
_INHERIT = """
      SELECT block_id, last_value(clause IGNORE NULLS) OVER (PARTITION BY b.doc_id ORDER BY b.block_seq ROWS UNBOUNDED PRECEDING) AS section FROM blocks b LEFT JOIN k ON k.doc_id = b.doc_id AND k.block_seq = b.block_seq"""
QUERIES = {
    "clean_text": q_clean, "clause_extract": q_clauses, "clause_inherit": q_assigned, "repeated_lines": q_repeated, "strip_repeated": q_strip, "blocks_from_text": q_document_blocks, "approx_tokens": q_tokens,
    "split_text": q_split, "table_cells": q_cells, "data_row_flags": q_data_rows, "clause_chain": q_chain,
    "document_sections": q_document_sections, "assign_sections": q_assigned, "document_blocks": q_document_blocks,
}
ORACLES = {
    "clean_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', E'\n', 'g'), '[\x{ad}\x{200b}]', '', 'g'), '[\x{a0}\x{202f}\x{2007}]', ' ', 'g'), '([\pL\pN_])[-‐‑]\s*\n\s*([\pL\pN_])', '\1\2', 'g') AS t FROM page_docs),
      b AS (SELECT page_id, list_reduce(regexp_extract_all(t, '(?:^|[^\pL\pN_])((?:[А-ЯЁ]\s){2,}[А-ЯЁ])(?:$|[^\pL\pN_])', 1), lambda a, m: replace(a, m, replace(m, ' ', '')), t) AS t FROM a)
      SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]{2,}', ' ', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS text FROM b""",
    "clause_extract": f"WITH {_L} SELECT page_id, line_no, {_clause('line')} AS clause FROM l WHERE ({_clause('line')}) IS NOT NULL",
    "repeated_lines": f"WITH {_REP} SELECT * FROM r",
    "strip_repeated": f"""WITH {_REP}, fs AS (SELECT doc_id, list(form) AS forms FROM r GROUP BY 1), pl AS (SELECT page_id, text, forms, string_split(text, E'\\n') AS ls FROM page_docs p LEFT JOIN fs ON fs.doc_id = p.doc_id WHERE text IS NOT NULL),
      ed AS (SELECT *, greatest(1, least(3, len(ls) // 3)) AS edge FROM pl)
      SELECT page_id, CASE WHEN forms IS NULL THEN text ELSE {_trimmed("regexp_replace(array_to_string(list_filter(ls, lambda x, i: NOT ((i <= edge OR i > len(ls) - edge) AND " + _trimmed('x') + " <> '' AND list_contains(forms, " + _form('x') + "))), E'" + chr(92) + "n'), '" + chr(92) + "n{3,}', E'" + chr(92) + "n" + chr(92) + "n', 'g')")} END AS text FROM ed""",
    "approx_tokens": "SELECT chunk_id, greatest(1, length(text) // 3)::INT AS tokens, coalesce(token_count <> greatest(1, length(text) // 3), true) AS stale FROM chunks WHERE text IS NOT NULL",
    "split_text": "SELECT block_id, piece::INT AS piece, substr(text, (piece * 1200 + 1)::BIGINT, 1200) AS text FROM (SELECT block_id, text, unnest(range((length(text) - 1) // 1200 + 1)) AS piece FROM blocks WHERE text <> '')",
    "table_cells": f"WITH {_C} SELECT * FROM cells",
    "data_row_flags": rf"WITH {_C} SELECT block_id, row_no, sum((length(regexp_replace(cell, '[^0-9.,±—-]+', '', 'g')) >= 0.8 * length(cell))::INT) * 2 >= count(*) AS is_data FROM cells WHERE cell <> '' GROUP BY 1, 2",
    "clause_inherit": _CHAIN.replace("@", _CANDIDATES) + _INHERIT,
    "document_sections": _CHAIN.replace("@", _OPENINGS) + _INHERIT,
    "assign_sections": _CHAIN.replace("@", _CANDIDATES) + _INHERIT,
    "clause_chain": _CHAIN.replace("@", _OPENINGS) + " SELECT doc_id, block_seq, clause FROM k",
    "document_blocks": f"""WITH {_BLOCKS},
      z AS (SELECT doc_id, page_no, max_by(clause, (page_id, line_no)) AS last FROM m JOIN (SELECT page_id, page_no FROM page_docs) USING (page_id) WHERE clause IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT p.doc_id, p.page_no, last_value(last IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM (SELECT DISTINCT doc_id, page_no FROM page_docs) p LEFT JOIN z ON z.doc_id = p.doc_id AND z.page_no = p.page_no),
      x AS (SELECT page_id, min(line_no) AS first_line, max(section) AS section, count(*) AS lines, {_trimmed("string_agg(line, E'" + chr(92) + "n' ORDER BY line_no)")} AS text FROM b WHERE NOT blank GROUP BY page_id, b.b)
      SELECT x.page_id, first_line, coalesce(section, carried) AS section, lines, x.text FROM x JOIN page_docs p ON p.page_id = x.page_id JOIN c ON c.doc_id = p.doc_id AND c.page_no = p.page_no""",
}
ORACLES["blocks_from_text"] = ORACLES["document_blocks"]
