"""Tables: grids from cell boxes, headers, rows, markdown; captions, numbers, references; ruled lines and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import stripped
from textquarry.operators.structure import is_table, last_before, table_cells
from textquarry.session import checkpointed, table

# Characters of numeric cells, rows searched for the end of a header, tolerance of rules and context of a reference.
NUMERIC, HEADER_ROWS, TOLERANCE, CONTEXT, LINE_GAP = "0123456789,.±+-−–—×/%°", 8, 3.0, 400, 3
# A caption (new or continued, and its number as recognition gives it), the digits meant by letters, a reference to tables.
CAPTION = r"(?iU)^\s*(?:(Т\s*а\s*б\s*л\s*и\s*[цил]\s*а)|((?:Продолжение|Окончание)\s+табл\w*\.?))\s*([0-9IlбЗзОO|?]{1,3})?"
MEANT = ("Il|бЗзОO", "11163300")
REFERENCE = r"(?iU)\b[тг]абл(?:\.|\w*)\s*(\d+(?:\s*(?:[,.]|и|[—–-])\s*\d+)*)"


def clean_cell(c: Column) -> Column:
    """A cell without soft hyphens and the line ends after them; null is empty."""
    return stripped(F.regexp_replace(F.coalesce(c, F.lit("")), "­\n?", ""))


def is_numeric(cell: Column) -> Column:
    """At least four fifths of the characters that are not space belong to numbers."""
    chars = F.regexp_replace(cell, r"(?U)\s+", "")
    numeric = F.length(chars) - F.length(F.translate(chars, NUMERIC, ""))
    return (chars != "") & (numeric * 10 >= F.length(chars) * 8)


def is_data_row(row: Column) -> Column:
    """At least half of the cells that are not empty are numeric."""
    full = F.filter(row, lambda c: c != "")
    return (F.size(full) > 0) & (F.size(F.filter(full, is_numeric)) * 2 >= F.size(full))


def header_rows(grid: Column) -> Column:
    """Rows before the first data row among the first eight; 1 where there is none, 0 for the empty grid."""
    first = F.array_position(F.transform(F.slice(grid, 1, HEADER_ROWS), is_data_row), True).cast("int")
    return F.when(F.size(grid) == 0, 0).when(first > 0, first - 1).otherwise(1)


def one_line(cell: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(cell, F.lit("")), "\n", " "))


def flat_header(rows: Column) -> Column:
    """One header row: the levels of each column joined, repeats of a level taken once."""
    width = F.coalesce(F.size(F.try_element_at(rows, F.lit(1))), F.lit(0))

    def column(i: Column) -> Column:
        levels = F.filter(F.transform(rows, lambda r: one_line(F.get(r, i))), lambda x: x != "")
        kept = F.filter(levels, lambda x, k: (k == 0) | (x != F.get(levels, k - 1)))
        return F.array_join(kept, " / ")

    none = F.array().cast("array<string>")
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), column)).otherwise(none)


def is_real_table(grid: Column) -> Column:
    """Two rows and columns at least, four cells with text, and half of all."""
    cells = F.flatten(grid)
    full = F.size(F.filter(cells, lambda c: c != ""))
    return (F.size(grid) >= 2) & (F.size(F.element_at(grid, 1)) >= 2) & (full >= 4) & (full * 2 >= F.size(cells))


def table_rows(grids: DataFrame, require_data: bool = False) -> DataFrame:
    """``header, body, own_header`` beside the columns of ``grids`` (``grid``); grids that are no tables drop out.

    Rows without any text leave the body.  With ``require_data`` a table without a data row is none.
    """
    g = grids.where(F.size("grid") > 0).where(is_real_table(F.col("grid"))).withColumn("_n", header_rows(F.col("grid")))
    rest = F.slice("grid", F.col("_n") + 1, F.greatest(F.size("grid") - F.col("_n"), F.lit(0)))
    g = g.withColumn("_rest", rest)
    if require_data:
        g = g.where(F.exists("_rest", is_data_row))
    plain = F.filter(F.transform("_rest", lambda r: F.transform(r, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))), lambda r: F.exists(r, lambda c: c != ""))
    head = F.when(F.col("_n") > 0, flat_header(F.slice("grid", F.lit(1), F.greatest(F.col("_n"), F.lit(1))))).otherwise(F.array().cast("array<string>"))
    return g.withColumn("header", head).withColumn("body", plain).withColumn("own_header", F.col("_n") > 0).drop("_n", "_rest")


def markdown(rows: Column) -> Column:
    """Rows as a pipe table: empty rows dropped, short ones padded, a rule after the first; empty where nothing is left."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, one_line)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(clean, line)
    return F.when(F.size(clean) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n"))


def inherited_headers(rows: DataFrame) -> DataFrame:
    """``rows`` of tables in document order with ``header`` from the last table with one, where their own is lacking and the width equal."""
    width = F.when(F.size("body") > 0, F.size(F.element_at("body", 1))).otherwise(F.size("header"))
    r = last_before(rows, F.when(F.col("own_header") & (F.size("header") > 0), F.col("header")))
    lends = ~F.col("own_header") & (F.size("carried") == width)
    return r.withColumn("header", F.when(lends, F.col("carried")).otherwise(F.col("header"))).drop("carried")


def caption_of(line: Column) -> Column:
    """``number, continued`` of a caption line: the number is null where it cannot be read; null where the line is no caption."""
    part = lambda g: F.regexp_extract(line, CAPTION, g)
    digits = F.translate(part(3), *MEANT)
    number = F.when(digits.rlike(r"^\d+$"), digits.cast("int"))
    return F.when(line.rlike(CAPTION), F.struct(number.alias("number"), (part(2) != "").alias("continued")))


def numbered_tables(blocks: DataFrame, segment: int = 256) -> DataFrame:
    """``block_id, doc_id, block_seq, number, continued, label``: tables with a caption, in order of the document.

    A new table whose number cannot be read follows the last number, a continuation has it.
    The count runs by segments of the document; tables without a positive number drop out.
    """
    rows = blocks.where(is_table(F.col("kind"))).select("block_id", "doc_id", "block_seq", F.split("text", "\n")[0].alias("line")).withColumn("c", caption_of(F.col("line"))).where("c is not null")
    rows = rows.select("*", F.when(F.col("c.number") > 0, F.col("c.number")).alias("known"), (F.col("c.number").isNull() & ~F.col("c.continued")).cast("int").alias("step"), F.floor(F.col("block_seq") / segment).alias("part"))
    w = Window.partitionBy("doc_id", "part").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.count("known").over(w))
    within = Window.partitionBy("doc_id", "part", "run").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("base", F.first("known").over(within)).withColumn("steps", F.sum("step").over(within))
    # what a segment leaves behind: its last base, and the steps since that or since its beginning
    ends = rows.groupBy("doc_id", "part").agg(F.max_by(F.struct("base", "steps"), "block_seq").alias("end"))
    past = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("last_base", F.last("end.base", ignorenulls=True).over(past)).withColumn("all_steps", F.coalesce(F.sum("end.steps").over(past), F.lit(0)))
    # steps of segments before the last base count for nothing
    ends = ends.withColumn("before", F.last(F.when(F.col("end.base").isNotNull(), F.struct("all_steps")), ignorenulls=True).over(past))
    ends = ends.withColumn("since", F.col("all_steps") - F.coalesce(F.col("before.all_steps"), F.lit(0)))
    j = rows.join(ends.select("doc_id", "part", "last_base", "since"), ["doc_id", "part"])
    place = F.when(F.col("base").isNotNull(), F.col("base") + F.col("steps")).otherwise(F.coalesce("last_base", F.lit(0)) + F.col("since") + F.col("steps"))
    number = F.when(F.col("c.number").isNotNull(), F.col("c.number")).otherwise(place).cast("int")
    tail = stripped(F.regexp_replace(F.col("line"), CAPTION, ""))
    tail = F.regexp_replace(tail, r"^[).:;,\-—– ]+", "")
    word = F.when(F.lower(stripped(F.col("line"))).startswith("окончание"), "Окончание табл. ").when(F.col("c.continued"), "Продолжение табл. ").otherwise("Таблица ")
    label = stripped(F.concat(word, number.cast("string"), F.lit(" "), tail))
    return j.select("block_id", "doc_id", "block_seq", number.alias("number"), F.col("c.continued").alias("continued"), label.alias("label")).where("number > 0")


def reference_numbers(group: Column) -> Column:
    """Numbers named by a reference: ``3, 4`` both, ``3—7`` all five; of a wider or reversed range the first."""
    parts = F.split(group, r"(?U)\s*(?:[,.]|и)\s*")

    def of(part: Column) -> Column:
        bounds = F.transform(F.filter(F.split(part, r"(?U)\s*[—–-]\s*"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))
        a, b = F.try_element_at(bounds, F.lit(1)), F.try_element_at(bounds, F.lit(2))
        return F.when((F.size(bounds) == 2) & (b - a > 0) & (b - a <= 20), F.sequence(a, F.when((b - a > 0) & (b - a <= 20), b).otherwise(a))).otherwise(F.slice(bounds, 1, 1))

    return F.flatten(F.transform(parts, of))


def references(text: Column) -> Column:
    """Numbers of all tables that a text refers to, in order, each once."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), reference_numbers)))


def referring_sentences(text: Column, number: Column) -> Column:
    """The sentences that refer to the table, in one line of at most 400 characters cut at a word; the first where none does."""
    flat = F.regexp_replace(stripped(F.regexp_replace(text, r"(?U)\s+", " ")), r"^\d+(?:\.\d+)*\.?\s+", "")
    sentences = F.split(flat, r"(?<=[.;])\s+(?=[А-ЯЁA-Z])")
    picked = F.filter(sentences, lambda s: F.array_contains(references(s), number))
    context = F.array_join(F.when(F.size(picked) > 0, picked).otherwise(F.slice(sentences, 1, 1)), " ")
    cut = F.regexp_replace(F.substring(context, 1, CONTEXT), r" [^ ]*$", "")
    return F.when(F.length(context) > CONTEXT, F.concat(cut, F.lit("…"))).otherwise(context)


def linked_tables(blocks: DataFrame) -> DataFrame:
    """``block_id, number, section, text``: numbered tables with the section and sentences of the first text that refers to them.

    The first reference must stand before the table, in a block that has a section; else the table keeps its own
    section.  The caption is written anew, and the context put under it.
    """
    texts = blocks.where(~is_table(F.col("kind")) & F.col("section").isNotNull() & F.col("text").isNotNull())
    refs = texts.select("doc_id", "block_seq", "section", "text", F.explode(references(F.col("text"))).alias("number"))
    first = refs.groupBy("doc_id", "number").agg(F.min_by(F.struct("block_seq", "section", "text"), "block_seq").alias("r"))
    first = first.select("doc_id", "number", F.col("r.block_seq").alias("ref_seq"), F.col("r.section").alias("ref_section"), referring_sentences(F.col("r.text"), F.col("number")).alias("context"))
    j = numbered_tables(blocks).join(blocks.select("block_id", "section", "text"), "block_id").join(first, ["doc_id", "number"], "left")
    linked = F.col("ref_seq") < F.col("block_seq")
    lines = F.split("text", "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))
    body = F.when(F.size(lines) > 1, rest).otherwise(F.array().cast("array<string>"))
    note = F.when(linked, F.array(F.concat(F.lit("К п. "), "ref_section", F.lit(": "), "context"))).otherwise(F.array().cast("array<string>"))
    return j.select("block_id", "number", F.when(linked, F.col("ref_section")).otherwise(F.col("section")).alias("section"), F.array_join(F.concat(F.array("label"), note, body), "\n").alias("text"))


def split_caption(band: Column) -> Column:
    """``rest, caption``: the caption in one of the last three lines with what follows it; null caption where there is none."""
    lines = F.split(band, "\n")
    n = F.size(lines)
    at = F.array_max(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(CAPTION).alias("is"))), lambda p: p["is"] & (p["i"] >= n - 3)), lambda p: p["i"]))
    caption = F.array_join(F.filter(F.transform(F.slice(lines, at + 1, F.greatest(n - at, F.lit(1))), stripped), lambda x: x != ""), " ")
    before = stripped(F.array_join(F.slice(lines, 1, at), "\n"))
    return F.struct(F.when(at.isNull(), band).otherwise(before).alias("rest"), F.when(at.isNotNull(), caption).alias("caption"))


def grid_cells(boxes: DataFrame) -> DataFrame:
    """``id, row_no, col_no, text``: cell boxes on the grid of their edges; a merged cell fills every place that it covers.

    ``boxes`` has ``id, x0, top, x1, bottom, text``.
    """
    edges = boxes.groupBy("id").agg(
        F.array_sort(F.array_union(F.collect_set(F.round("x0", 1)), F.array(F.round(F.max("x1"), 1)))).alias("cols"), F.array_sort(F.array_union(F.collect_set(F.round("top", 1)), F.array(F.round(F.max("bottom"), 1)))).alias("rows")
    )
    near = lambda edges, v: F.array_min(F.transform(edges, lambda e, i: F.struct(F.abs(e - v).alias("d"), i.alias("i"))))["i"]
    b = boxes.join(edges, "id").select(
        "id", clean_cell(F.col("text")).alias("text"), "top", "x0", F.size("cols").alias("n_cols"), F.size("rows").alias("n_rows"),
        near(F.col("cols"), F.col("x0")).alias("c0"), near(F.col("cols"), F.col("x1")).alias("c1"), near(F.col("rows"), F.col("top")).alias("r0"), near(F.col("rows"), F.col("bottom")).alias("r1"),
    )
    span = lambda a, b_: F.sequence(F.col(a), F.greatest(F.col(b_), F.col(a) + 1) - 1)
    wide = b.withColumn("row_no", F.explode(span("r0", "r1"))).withColumn("col_no", F.explode(span("c0", "c1"))).where("row_no < n_rows - 1 and col_no < n_cols - 1")
    return wide.groupBy("id", "row_no", "col_no").agg(F.max_by("text", F.struct("top", "x0")).alias("text"))


def exploded_rows(words: DataFrame) -> DataFrame:
    """``id, line, col_no, text``: words of an open row by lines (tops within three points of the first of a line) and columns.

    ``words`` has ``id, x0, x1, top, text, edges`` (left ends of the columns and the right end of the table).
    """
    word = F.struct("top", "x0", "x1", "text")
    rows = words.groupBy("id").agg(F.array_sort(F.collect_list(word)).alias("w"), F.first("edges").alias("edges"))
    zero = F.struct(F.lit(-1).alias("line"), F.lit(float("-inf")).alias("anchor"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        new = x["top"] - acc["anchor"] > LINE_GAP
        line = acc["line"] + F.when(new, 1).otherwise(0)
        return F.struct(line.alias("line"), F.when(new, x["top"]).otherwise(acc["anchor"]).alias("anchor"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    placed = rows.select("id", "edges", F.explode(F.arrays_zip("w", F.aggregate("w", zero, step)["lines"].alias("line"))).alias("z"))
    centre = (F.col("z.w.x0") + F.col("z.w.x1")) / 2
    inner = F.slice("edges", 2, F.size("edges"))
    col = F.least(F.size("edges") - 2, F.size(F.filter(inner, lambda e: e <= centre)))
    return placed.select("id", F.col("z.line").alias("line"), col.alias("col_no"), F.col("z.w").alias("w")).groupBy("id", "line", "col_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w.x0", "w.text"))), lambda x: x["text"]), " ").alias("text")
    )


def touching(rules: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``id, a, b``: rules of one page whose boxes meet within the tolerance; ``rules`` has ``id, rule, x0, top, x1, bottom``."""
    a, b = rules.alias("a"), rules.alias("b")
    t = F.lit(tolerance)
    meet = (F.col("a.x0") - t <= F.col("b.x1")) & (F.col("b.x0") - t <= F.col("a.x1")) & (F.col("a.top") - t <= F.col("b.bottom")) & (F.col("b.top") - t <= F.col("a.bottom"))
    return a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.rule") < F.col("b.rule")) & meet).select("a.id", F.col("a.rule").alias("a"), F.col("b.rule").alias("b"))


def frames(rules: DataFrame) -> DataFrame:
    """``id, x0, top, x1, bottom``: the box of each group of touching rules with lines both ways.

    Groups are connected components by least label, spread until nothing changes; lineage is cut by checkpoints.
    """
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    links = checkpointed(touching(rules).select("id", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("id", "w.a", "w.b"))
    labels = checkpointed(rules.select("id", "rule", F.col("rule").alias("label")))
    while True:
        offered = links.join(labels.withColumnRenamed("rule", "b"), ["id", "b"]).groupBy("id", F.col("a").alias("rule")).agg(F.min("label").alias("offer"))
        new = checkpointed(labels.join(offered, ["id", "rule"], "left").select("id", "rule", "label", F.least("label", F.coalesce("offer", "label")).alias("new")))
        changed = not new.where("new < label").isEmpty()
        labels = new.select("id", "rule", F.col("new").alias("label"))
        if not changed:
            break
    flat = rules.join(labels, ["id", "rule"]).withColumn("flat", F.col("x1") - F.col("x0") >= F.col("bottom") - F.col("top"))
    boxes = flat.groupBy("id", "label").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.max("flat").alias("h"), F.min("flat").alias("all_h"))
    return boxes.where("h and not all_h").select("id", "x0", "top", "x1", "bottom")


def extended_columns(rules: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``id, rule, x0, top, x1, bottom`` of the vertical rules: one that ends on a horizontal goes on to the next below of the same width.

    Of the horizontals where it ends, the first by its number counts.
    """
    flat = F.col("x1") - F.col("x0") >= F.col("bottom") - F.col("top")
    v, h = rules.where(~flat), rules.where(flat).select("id", *(F.col(c).alias("h_" + c) for c in ("rule", "x0", "top", "x1")))
    x = (F.col("x0") + F.col("x1")) / 2
    spans = v.join(h, "id").where((F.col("h_x0") - tolerance <= x) & (x <= F.col("h_x1") + tolerance))
    stop = spans.where(F.abs(F.col("h_top") - F.col("bottom")) <= tolerance).groupBy("id", "rule").agg(F.min_by(F.struct("h_x0", "h_x1", "h_top"), "h_rule").alias("s"))
    j = spans.join(stop, ["id", "rule"]).withColumn("wide", 0.05 * (F.col("s.h_x1") - F.col("s.h_x0")))
    below = j.where((F.col("h_top") > F.col("s.h_top") + tolerance) & (F.abs(F.col("h_x0") - F.col("s.h_x0")) <= F.col("wide")) & (F.abs(F.col("h_x1") - F.col("s.h_x1")) <= F.col("wide")))
    floor = below.groupBy("id", "rule").agg(F.min("h_top").alias("floor"))
    return v.join(floor, ["id", "rule"], "left").select("id", "rule", "x0", "top", "x1", F.coalesce("floor", "bottom").alias("bottom"))


def enough_rules(rules: DataFrame) -> DataFrame:
    """Pages with two horizontal and two vertical rules at least."""
    flat = F.col("x1") - F.col("x0") >= F.col("bottom") - F.col("top")
    return rules.groupBy("id").agg(F.sum(flat.cast("int")).alias("h"), F.sum((~flat).cast("int")).alias("v")).where("h >= 2 and v >= 2")


def grids_of(spark, sf) -> DataFrame:
    """Grids of the pipe tables; those of odd blocks get a level above the header, every fifth loses its header."""
    b = table(spark, sf, "blocks")
    rows = table_cells(b).groupBy("block_id", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"]).alias("r"))
    grid = rows.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "r"))), lambda x: x["r"]).alias("g"))
    first = F.element_at("g", 1)
    level = F.array(F.transform(first, lambda c, i: F.when(i == 0, c).otherwise(F.lit("Размеры\nдетали"))))
    grid = grid.withColumn("grid", F.when(F.col("block_id") % 5 == 0, F.slice("g", 2, F.size("g"))).when(F.col("block_id") % 2 == 1, F.concat(level, "g")).otherwise(F.col("g")))
    return grid.join(b.select("block_id", "doc_id", "block_seq"), "block_id").select("block_id", "doc_id", "block_seq", "grid")


def _text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "¦")), "\n")


def q_rows(spark, sf):
    r = table_rows(grids_of(spark, sf), require_data=True)
    return r.select("block_id", F.array_join("header", "¦").alias("header"), _text(F.col("body")).alias("body"), "own_header")


def q_markdown(spark, sf):
    """Tables written anew, with the header of an earlier table where their own is lacking."""
    r = inherited_headers(table_rows(grids_of(spark, sf)))
    rows = F.when(F.size("header") > 0, F.concat(F.array("header"), "body")).otherwise(F.col("body"))
    return r.select("block_id", markdown(rows).alias("markdown"))


def q_captions(spark, sf):
    b = table(spark, sf, "blocks").where(F.col("text").isNotNull())
    c = caption_of(F.split("text", "\n")[0])
    return b.select("block_id", c["number"].alias("number"), c["continued"].alias("continued")).where("continued is not null")


def q_numbered(spark, sf):
    return numbered_tables(table(spark, sf, "blocks")).select("block_id", "number", "continued", "label")


def q_references(spark, sf):
    return table(spark, sf, "blocks").where(F.col("text").isNotNull()).select("block_id", F.explode(references(F.col("text"))).alias("number"))


def q_linked(spark, sf):
    return linked_tables(table(spark, sf, "blocks"))


def q_split_caption(spark, sf):
    """Text bands above tables: the page's text up to each pipe table's first row."""
    bands = table(spark, sf, "blocks").where("text is not null").select("block_id", F.split("text", r"\n\|")[0].alias("band")).select("block_id", split_caption(F.col("band")).alias("s"))
    return bands.select("block_id", "s.rest", "s.caption")


def boxes_of(spark, sf) -> DataFrame:
    """Cells of pipe tables as boxes; in every third table the first column's cells are merged by twos."""
    cells = table_cells(table(spark, sf, "blocks"))
    nth = F.dense_rank().over(Window.partitionBy("block_id").orderBy("row_no")) - 1
    rows = cells.withColumn("n", nth).withColumn("last", F.max("n").over(Window.partitionBy("block_id")))
    merged = (F.col("block_id") % 3 == 0) & (F.col("col_no") == 0)
    rows = rows.where(~merged | (F.col("n") % 2 == 0))
    high = F.when(merged & (F.col("n") < F.col("last")), 24).otherwise(12)
    return rows.select(F.col("block_id").alias("id"), (F.col("col_no") * 40.0).alias("x0"), (F.col("n") * 12.0).alias("top"), ((F.col("col_no") + 1) * 40.0).alias("x1"), (F.col("n") * 12.0 + high).alias("bottom"), F.col("cell").alias("text"))


def q_grid(spark, sf):
    return grid_cells(boxes_of(spark, sf)).select(F.col("id").alias("block_id"), "row_no", "col_no", "text")


def q_exploded(spark, sf):
    """Header rows as open rows: the words of every cell one below the other, with some unevenness."""
    cells = table_cells(table(spark, sf, "blocks"))
    first = cells.groupBy("block_id").agg(F.min("row_no").alias("row_no"), (F.max("col_no") + 1).alias("n"))
    words = cells.join(first, ["block_id", "row_no"]).select("block_id", "n", "col_no", F.posexplode(F.split("cell", " ")).alias("k", "text")).where("text <> ''")
    edges = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: i * 40.0)
    return exploded_rows(words.select(F.col("block_id").alias("id"), (F.col("col_no") * 40.0 + 3).alias("x0"), (F.col("col_no") * 40.0 + 20).alias("x1"), (F.col("k") * 12.0 + F.col("col_no") % 3).alias("top"), "text", edges.alias("edges"))).withColumnRenamed("id", "block_id")


def rules_of(spark, sf) -> DataFrame:
    """Rules of open tables as print has them: two lines over the header, one under the table, verticals in the header alone; a stray line far below."""
    cells = table_cells(table(spark, sf, "blocks"))
    size = cells.groupBy("block_id").agg(F.countDistinct("row_no").alias("rows"), (F.max("col_no") + 1).alias("cols"))
    wide = F.col("cols") * 40.0
    rule = lambda n, x0, top, x1, bottom: F.struct(F.lit(n).alias("rule") if isinstance(n, int) else n.alias("rule"), x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"))
    zero, low = F.lit(0.0), F.col("rows") * 12.0
    flat = [rule(1, zero, zero, wide, zero), rule(2, zero, F.lit(12.0), wide, F.lit(12.0)), rule(3, zero + F.col("block_id") % 2, low, wide, low), rule(4, zero, low + 50, wide / 2, low + 50)]
    upright = F.transform(F.sequence(F.lit(1), F.greatest(F.col("cols") - 1, F.lit(1))), lambda c: rule((c + 10).cast("int"), c * 40.0, zero + 1, c * 40.0, F.lit(11.0)))
    return size.select(F.col("block_id").alias("id"), F.explode(F.concat(F.array(*flat), upright)).alias("r")).select("id", "r.*")


def q_touching(spark, sf):
    return touching(rules_of(spark, sf)).withColumnRenamed("id", "block_id")


def q_extended(spark, sf):
    return extended_columns(rules_of(spark, sf)).withColumnRenamed("id", "block_id")


def q_frames(spark, sf):
    rules = rules_of(spark, sf)
    enough = enough_rules(rules).select("id")
    return frames(rules.join(enough, "id", "left_semi")).withColumnRenamed("id", "block_id")


def _oracles() -> dict[str, str]:
    from textquarry.operators.structure import _C, _trimmed

    word = r"[\pL\pN_]"
    caption = CAPTION.replace("(?iU)", "(?i)").replace(r"\w", word)
    reference = r"(?:^|[^\pL\pN_])" + REFERENCE.replace(r"(?iU)\b", "").replace(r"\w", word)
    reference = "(?i)" + reference
    line = "regexp_replace(coalesce({c}, ''), '\\n', ' ', 'g')"
    one = _trimmed(line.format(c="{c}")).replace("{c}", "{c}")
    one_line = lambda c: _trimmed(line.format(c=c))
    numeric = lambda c: f"(length(regexp_replace({c}, '\\s+', '', 'g')) > 0 AND (length(regexp_replace({c}, '\\s+', '', 'g')) - length(translate(regexp_replace({c}, '\\s+', '', 'g'), '{NUMERIC}', ''))) * 10 >= length(regexp_replace({c}, '\\s+', '', 'g')) * 8)"
    data = lambda r: f"(len(list_filter({r}, lambda c: c <> '')) > 0 AND len(list_filter({r}, lambda c: c <> '' AND {numeric('c')})) * 2 >= len(list_filter({r}, lambda c: c <> '')))"
    grids = f"""{_C}, gr AS (SELECT block_id, row_no, list(cell ORDER BY col_no) AS r FROM cells GROUP BY 1, 2), gg AS (SELECT block_id, list(r ORDER BY row_no) AS g FROM gr GROUP BY 1),
      grids AS (SELECT g.block_id, doc_id, block_seq, CASE WHEN g.block_id % 5 = 0 THEN g[2:] WHEN g.block_id % 2 = 1 THEN list_concat([list_transform(g[1], lambda c, i: CASE WHEN i = 1 THEN c ELSE E'Размеры\\nдетали' END)], g) ELSE g END AS grid FROM gg g JOIN blocks b ON b.block_id = g.block_id),
      rt AS (SELECT * FROM grids WHERE len(grid) >= 2 AND len(grid[1]) >= 2 AND len(list_filter(flatten(grid), lambda c: c <> '')) >= 4 AND len(list_filter(flatten(grid), lambda c: c <> '')) * 2 >= len(flatten(grid))),
      hn AS (SELECT *, coalesce(list_position(list_transform(grid[1:8], lambda r: {data('r')}), true) - 1, 1) AS n FROM rt),
      hr AS (SELECT *, grid[n + 1:] AS rest, CASE WHEN n > 0 THEN list_transform(range(1, len(grid[1]) + 1), lambda i: list_filter(list_transform(grid[1:n], lambda r: {one_line('r[i]')}), lambda x: x <> '')) ELSE [] END AS levels FROM hn),
      tr AS (SELECT block_id, doc_id, block_seq, rest, n > 0 AS own_header, list_transform(levels, lambda l: array_to_string(list_filter(l, lambda x, k: k = 1 OR x <> l[k - 1]), ' / ')) AS header, list_filter(list_transform(rest, lambda r: list_transform(r, lambda c: {line.format(c='c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS body FROM hr)"""
    cap = lambda c, g: f"regexp_extract({c}, '{caption}', {g})"
    digits = lambda c: f"translate({cap(c, 3)}, '{MEANT[0]}', '{MEANT[1]}')"
    first = "string_split(text, E'\\n')[1]"
    table_kind = f"coalesce(lower({_trimmed('kind')}) = 'table', false)"
    numbered = f"""cp AS (SELECT block_id, doc_id, block_seq, {first} AS line FROM blocks WHERE {table_kind}),
      cq AS (SELECT *, CASE WHEN regexp_matches({digits('line')}, '^[0-9]+$') THEN {digits('line')}::INT END AS num, {cap('line', 2)} <> '' AS continued FROM cp WHERE regexp_matches(line, '{caption}')),
      cr AS (SELECT *, count(CASE WHEN num > 0 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY block_seq) AS run FROM cq),
      cs AS (SELECT *, coalesce(num, coalesce(first_value(CASE WHEN num > 0 THEN num END) OVER w, 0) + sum((num IS NULL AND NOT continued)::INT) OVER w)::INT AS number FROM cr WINDOW w AS (PARTITION BY doc_id, run ORDER BY block_seq)),
      ct AS (SELECT block_id, doc_id, block_seq, number, continued, {_trimmed("CASE WHEN starts_with(lower(trim(line)), 'окончание') THEN 'Окончание табл. ' WHEN continued THEN 'Продолжение табл. ' ELSE 'Таблица ' END || number || ' ' || regexp_replace(" + _trimmed("regexp_replace(line, '" + caption + "', '')") + ", '^[).:;,—– -]+', '')")} AS label FROM cs WHERE number > 0)"""
    parts = lambda g: f"list_transform(regexp_split_to_array({g}, '\\s*(?:[,.]|и)\\s*'), lambda p: list_transform(list_filter(regexp_split_to_array(p, '\\s*[—–-]\\s*'), lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: x::INT))"
    spread = lambda g: f"flatten(list_transform({parts(g)}, lambda b: CASE WHEN len(b) = 2 AND b[2] - b[1] BETWEEN 1 AND 20 THEN range(b[1], b[2] + 1)::INT[] ELSE b[1:1] END))"
    refs = lambda t: f"flatten(list_transform(regexp_extract_all({t}, '{reference}', 1), lambda g: {spread('g')}))"
    flat = "regexp_replace(" + _trimmed("regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')") + ", '^\\d+(?:\\.\\d+)*\\.?\\s+', '')"
    md = f"""ih AS (SELECT *, last_value(CASE WHEN own_header AND len(header) > 0 THEN header END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM tr),
      ii AS (SELECT block_id, CASE WHEN NOT own_header AND len(past) = CASE WHEN len(body) > 0 THEN len(body[1]) ELSE len(header) END THEN past ELSE header END AS header, body FROM ih),
      ij AS (SELECT block_id, list_filter(list_transform(CASE WHEN len(header) > 0 THEN list_concat([header], body) ELSE body END, lambda r: list_transform(r, lambda c: {one_line('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM ii),
      ik AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS w FROM ij),
      il AS (SELECT block_id, w, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(w - len(r)), lambda i: '')), ' | ') || ' |') AS ls FROM ik)"""
    boxes = f"""{_C}, bn AS (SELECT *, dense_rank() OVER (PARTITION BY block_id ORDER BY row_no) - 1 AS n FROM cells), bm AS (SELECT *, max(n) OVER (PARTITION BY block_id) AS last, block_id % 3 = 0 AND col_no = 0 AS merged FROM bn),
      gc AS (SELECT block_id, unnest(CASE WHEN merged AND n < last THEN [n, n + 1] ELSE [n] END) AS row_no, col_no, {_trimmed('cell')} AS text FROM bm WHERE NOT merged OR n % 2 = 0)"""
    rules = f"""{_C}, sz AS (SELECT block_id AS id, count(DISTINCT row_no) AS rows, max(col_no) + 1 AS cols FROM cells GROUP BY 1),
      rl AS (SELECT id, 1 AS rule, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS top, cols * 40.0::DOUBLE AS x1, 0.0::DOUBLE AS bottom FROM sz UNION ALL SELECT id, 2, 0.0, 12.0, cols * 40.0, 12.0 FROM sz UNION ALL SELECT id, 3, id % 2, rows * 12.0, cols * 40.0, rows * 12.0 FROM sz
        UNION ALL SELECT id, 4, 0.0, rows * 12.0 + 50, cols * 20.0, rows * 12.0 + 50 FROM sz UNION ALL SELECT id, (c + 10)::INT, c * 40.0, 1.0, c * 40.0, 11.0 FROM (SELECT id, unnest(range(1, greatest(cols - 1, 1) + 1)) AS c FROM sz)),
      tc AS (SELECT a.id, a.rule AS a, b.rule AS b FROM rl a JOIN rl b ON a.id = b.id AND a.rule < b.rule AND a.x0 - 3 <= b.x1 AND b.x0 - 3 <= a.x1 AND a.top - 3 <= b.bottom AND b.top - 3 <= a.bottom)"""
    del one
    return {
        "table_rows": f"WITH {grids} SELECT block_id, array_to_string(header, '¦') AS header, array_to_string(list_transform(body, lambda r: array_to_string(r, '¦')), E'\\n') AS body, own_header FROM tr WHERE len(list_filter(rest, lambda r: {data('r')})) > 0",
        "table_markdown": f"WITH {grids}, {md} SELECT block_id, coalesce(array_to_string(list_concat(ls[1:1], ['| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'], ls[2:]), E'\\n'), '') AS markdown FROM il",
        "table_captions": f"SELECT block_id, CASE WHEN regexp_matches({digits(first)}, '^[0-9]+$') THEN {digits(first)}::INT END AS number, {cap(first, 2)} <> '' AS continued FROM blocks WHERE regexp_matches({first}, '{caption}')",
        "table_numbers": f"WITH {numbered} SELECT block_id, number, continued, label FROM ct",
        "table_references": f"SELECT DISTINCT block_id, unnest({refs('text')}) AS number FROM blocks WHERE text IS NOT NULL",
        "linked_tables": f"""WITH {numbered}, rf AS (SELECT DISTINCT doc_id, block_seq, section, text, unnest({refs('text')}) AS number FROM blocks WHERE NOT {table_kind} AND section IS NOT NULL AND text IS NOT NULL),
          fr AS (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY block_seq) = 1),
          fs AS (SELECT *, string_split(regexp_replace({flat}, '([.;])\\s+([А-ЯЁA-Z])', E'\\\\1\\x01\\\\2', 'g'), E'\\x01') AS ss FROM fr),
          ft AS (SELECT *, list_filter(ss, lambda s: list_contains({refs('s')}, number)) AS picked FROM fs), fu AS (SELECT *, CASE WHEN len(picked) > 0 THEN array_to_string(picked, ' ') ELSE ss[1] END AS ctx FROM ft),
          fv AS (SELECT doc_id, number, block_seq AS ref_seq, section AS ref_section, CASE WHEN length(ctx) > 400 THEN regexp_replace(substr(ctx, 1, 400), ' [^ ]*$', '') || '…' ELSE ctx END AS context FROM fu)
          SELECT ct.block_id, ct.number, CASE WHEN ref_seq < ct.block_seq THEN ref_section ELSE b.section END AS section, label || CASE WHEN ref_seq < ct.block_seq THEN E'\\nК п. ' || ref_section || ': ' || context ELSE '' END || CASE WHEN contains(text, E'\\n') THEN E'\\n' || substr(text, instr(text, E'\\n') + 1) ELSE '' END AS text
          FROM ct JOIN blocks b ON b.block_id = ct.block_id LEFT JOIN fv ON fv.doc_id = ct.doc_id AND fv.number = ct.number""",
        "split_caption": f"""WITH bd AS (SELECT block_id, string_split(text, E'\\n|')[1] AS band FROM blocks WHERE text IS NOT NULL), be AS (SELECT *, string_split(band, E'\\n') AS ls FROM bd), bf AS (SELECT *, list_max(list_filter(range(1, len(ls) + 1), lambda i: i > len(ls) - 3 AND regexp_matches(ls[i], '{caption}'))) AS i FROM be)
          SELECT block_id, CASE WHEN i IS NULL THEN band ELSE {_trimmed("array_to_string(ls[1:i - 1], E'" + chr(92) + "n')")} END AS rest, CASE WHEN i IS NOT NULL THEN array_to_string(list_filter(list_transform(ls[i:], lambda x: {_trimmed('x')}), lambda x: x <> ''), ' ') END AS caption FROM bf""",
        "grid_cells": f"WITH {boxes} SELECT block_id, row_no::INT AS row_no, col_no::INT AS col_no, text FROM gc",
        "explode_rows": f"""WITH {_C}, fst AS (SELECT block_id, min(row_no) AS row_no, max(col_no) + 1 AS n FROM cells GROUP BY 1), wd AS (SELECT c.block_id, n, col_no, unnest(string_split(cell, ' ')) AS text, generate_subscripts(string_split(cell, ' '), 1) - 1 AS k FROM cells c JOIN fst ON fst.block_id = c.block_id AND fst.row_no = c.row_no),
          wt AS (SELECT *, k * 12 + col_no % 3 AS top FROM wd WHERE text <> '') SELECT block_id, (dense_rank() OVER (PARTITION BY block_id ORDER BY top // 12) - 1)::INT AS line, col_no::INT AS col_no, text FROM wt""",
        "touching_rules": f"WITH {rules} SELECT id AS block_id, a, b FROM tc",
        "extended_columns": f"""WITH {rules}, vs AS (SELECT v.*, h.rule AS hr, h.x0 AS hx0, h.top AS htop, h.x1 AS hx1 FROM rl v JOIN rl h ON h.id = v.id AND h.rule < 10 AND v.rule > 10 AND h.x0 - 3 <= v.x0 AND v.x0 <= h.x1 + 3),
          sp AS (SELECT * FROM vs WHERE abs(htop - bottom) <= 3 QUALIFY row_number() OVER (PARTITION BY id, rule ORDER BY hr) = 1),
          fl AS (SELECT vs.id, vs.rule, min(vs.htop) AS floor FROM vs JOIN sp ON sp.id = vs.id AND sp.rule = vs.rule WHERE vs.htop > sp.htop + 3 AND abs(vs.hx0 - sp.hx0) <= 0.05 * (sp.hx1 - sp.hx0) AND abs(vs.hx1 - sp.hx1) <= 0.05 * (sp.hx1 - sp.hx0) GROUP BY 1, 2)
          SELECT rl.id AS block_id, rl.rule, x0, top, x1, coalesce(floor, bottom) AS bottom FROM rl LEFT JOIN fl ON fl.id = rl.id AND fl.rule = rl.rule WHERE rl.rule > 10""",
        "table_frames": f"""WITH RECURSIVE {rules}, en AS (SELECT id FROM rl GROUP BY 1 HAVING count(*) FILTER (rule < 10) >= 2 AND count(*) FILTER (rule > 10) >= 2), lk AS (SELECT id, a, b FROM tc UNION SELECT id, b, a FROM tc),
          rc AS (SELECT rl.id, rule, rule AS lab FROM rl JOIN en ON en.id = rl.id UNION SELECT lk.id, lk.b, rc.lab FROM rc JOIN lk ON lk.id = rc.id AND lk.a = rc.rule), lb AS (SELECT id, rule, min(lab) AS lab FROM rc GROUP BY 1, 2)
          SELECT lb.id AS block_id, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM lb JOIN rl ON rl.id = lb.id AND rl.rule = lb.rule GROUP BY lb.id, lab HAVING bool_or(lb.rule < 10) AND bool_or(lb.rule > 10)""",
    }


QUERIES = {
    "table_rows": q_rows, "table_markdown": q_markdown, "table_captions": q_captions, "table_numbers": q_numbered, "table_references": q_references, "linked_tables": q_linked, "split_caption": q_split_caption,
    "grid_cells": q_grid, "explode_rows": q_exploded, "touching_rules": q_touching, "extended_columns": q_extended, "table_frames": q_frames,
}
ORACLES = _oracles()
