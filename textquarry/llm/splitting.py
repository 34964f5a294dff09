"""Problem 4: cutting oversized items at natural boundaries, with overlap.

Agglomerative merging: an item starts as atomic segments, adjacent pairs wait in a
heap ordered by the strength of the boundary between them, and the weakest
boundaries are merged first for as long as the combined size, the overlap and the
table header fit the limit.  Only items over the limit leave the JVM.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.session import table

LIMIT, OVERLAP = 400, 40
#: Code points of a token, the measure of the tables: tokens = max(1, length div 3).
CHARS = 3

# Boundary strengths, from the weakest.
HARD, WORD, CLAUSE, LINE, SENTENCE, PARAGRAPH = range(6)
_ATOM = re.compile(r"\S+\s*|\s+")
_SEPARATOR = re.compile(r"\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*")
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:\w|табл|рис|см|стр|разд|прил|черт|руб|тыс|инв|подл|fig|no|eq|cl)\.$", re.I)


def tokens(column: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(column) / CHARS).cast("int"))


def _strength(atom: str, following: str) -> int:
    word, space = atom.rstrip(), atom[len(atom.rstrip()) :]
    if space.count("\n") > 1:
        return PARAGRAPH
    if re.search(r"[.!?…][»\")\]]*$", word) and not following[:1].islower() and not _ABBREVIATION.search(word):
        return SENTENCE
    if "\n" in space:
        return LINE
    if re.search(r"[,;:)—–]$", word):
        return CLAUSE
    return WORD if space else HARD


def table_regions(text: str, header: str | None) -> list[tuple[int, int, str]]:
    """(start, end, header) of each run of table lines; the stored header wins over the one in the text."""
    regions, at, run = [], 0, []
    for line in [*text.splitlines(keepends=True), None]:
        if line is not None and (line.lstrip().startswith("|") or line.count("\t") > 1):
            run.append((at, line))
        elif run:
            first = [x for _, x in run]
            rule = next((i for i, x in enumerate(first[:6]) if _SEPARATOR.fullmatch(x.strip()) and "-" in x), None)
            own = "".join(first[: rule + 1]) if rule else ""
            if not own and len(first) > 1 and not re.search(r"\d{2}", first[0]):
                own = first[0]
            end = run[-1][0] + len(run[-1][1])
            if len(run) > 1:
                regions.append((run[0][0], end, (header.strip() + "\n") if header and header.strip() else own.rstrip("\n") + "\n" if own else ""))
            run = []
        at += len(line or "")
    return regions


def lacks_header(text: str, region: tuple[int, int, str]) -> bool:
    """Whether the table region begins without the row that its header begins with."""
    plain = lambda row: re.sub(r"[\s|]+", " ", row).strip().lower()
    start, end, header = region
    first = plain(header.split("\n", 1)[0])
    # a row with some misread characters is the same row
    return bool(first) and all(SequenceMatcher(None, first, plain(x)).ratio() < 0.8 for x in text[start:end].split("\n", 6)[:6])


def split_text(text: str, header: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, piece): own parts cover the text without gap; a piece is header, overlap and own part.

    The overlap is the last ``overlap`` tokens before the own part, moved left to
    the start of a word (of a row in tables) where the limit allows.  A header that
    would take more than half the limit is not repeated.  Where a table lacks the
    header stored for it, a piece begins with the table and has the header too.
    """
    most, back = limit * CHARS + CHARS - 1, overlap * CHARS
    if max(1, len(text) // CHARS) <= limit:
        return [(0, len(text), text)]
    regions = [(a, b, h if len(h) <= most // 2 else "") for a, b, h in table_regions(text, header)]
    atoms = [m.span() for m in _ATOM.finditer(text)]
    # table rows are atoms as wholes, as far as they fit
    if regions:
        merged: list[tuple[int, int]] = []
        for a, b in atoms:
            r = next((r for r in regions if r[0] <= a < r[1]), None)
            if r and merged and merged[-1][1] == a and r[0] <= merged[-1][0] and "\n" not in text[merged[-1][0] : a] and b - merged[-1][0] <= most - back - len(r[2]) - CHARS:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        atoms = merged
    room = most - back - 24
    cut = []
    for a, b in atoms:
        step = max(1, room - max((len(h) for x, y, h in regions if x <= a < y), default=0))
        cut += [(x, min(x + step, b)) for x in range(a, b, step)]
    start, end = [a for a, _ in cut], [b for _, b in cut]
    n = len(cut)
    strength = [_strength(text[start[i] : end[i]], text[start[i + 1] : start[i + 1] + 1]) for i in range(n - 1)]
    starts = {a for a, _, _ in regions}
    bare = {r[0] for r in regions if lacks_header(text, r)}
    lead = [next((len(h) for a, b, h in regions if a < s < b or s == a in bare), 0) for s in start] if regions else [0] * n
    for i in range(n - 1):  # a table is a unit of its own
        if start[i + 1] in starts:
            strength[i] = PARAGRAPH

    before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(strength[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        power, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and end[j] - start[i] == size):
            continue
        if start[j] in bare or size > (room if start[i] else most) - lead[i]:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if (k := after[i]) >= 0:
            before[k] = i
            heapq.heappush(heap, (strength[k - 1], end[k] - start[i], i, k))
        if (k := before[i]) >= 0:
            heapq.heappush(heap, (strength[i - 1], end[i] - start[k], k, i))

    out = []
    for i in (i for i in range(n) if alive[i]):
        a, b = start[i], end[i]
        region = next((r for r in regions if r[0] < a < r[1] or a == r[0] in bare), None)
        head = region[2] if region else ""
        low = max(0, a - back) if a else 0
        if a and low:
            spare = most - len(head) - (b - low)
            stop = text.rfind("\n", 0, low) + 1 if region else next((k for k in range(low, 0, -1) if text[k - 1].isspace()), 0)
            low = stop if low - stop <= spare else low
        if region:
            low = max(low, region[0] + len(region[2]) if text.startswith(region[2].rstrip("\n"), region[0]) and region[2] else region[0])
            low = min(low, a)
        out.append((a, b, head + text[low:b]))
    return out


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items over the limit: ``tab, row_id, piece_no, start, end, tokens, text``.

    ``items`` has ``tab, row_id, text, table_header``.  Items within the limit, null
    and empty texts give no piece; a text without any boundary is cut at the limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (tab, row_id, n, a, b, max(1, len(piece) // CHARS), piece)
                for tab, row_id, text, header in batch.itertuples(index=False)
                for n, (a, b, piece) in enumerate(split_text(text, header, limit, overlap), 1)
            ]
            yield pd.DataFrame(rows, columns=["tab", "row_id", "piece_no", "start", "end", "tokens", "text"])

    return items.where(tokens(F.col("text")) > limit).select("tab", "row_id", "text", "table_header").mapInPandas(
        run, "tab string, row_id long, piece_no int, start int, end int, tokens int, text string"
    )


def items(spark, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").select(F.lit("blocks").alias("tab"), F.col("block_id").alias("row_id"), "text", "table_header")
    chunks = table(spark, sf_dir, "chunks").select(
        F.lit("chunks").alias("tab"), F.col("chunk_id").alias("row_id"), "text", F.lit(None).cast("string").alias("table_header")
    )
    return blocks.unionByName(chunks)


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of all blocks and chunks over 400 tokens."""
    return split_oversized(items(spark, sf_dir))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The rows that had to be cut: those of which the operator made a second piece."""
    return p4_pieces(spark, sf_dir).where("piece_no = 2").select("tab", "row_id")


def p4_cover(spark, sf_dir: str) -> DataFrame:
    """Of every row that was cut: whether its own parts cover the text without gap, and whether every piece keeps the limit."""
    rows = items(spark, sf_dir).select("tab", "row_id", F.length("text").alias("length"))
    parts = p4_pieces(spark, sf_dir).groupBy("tab", "row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.max("tokens").alias("most"), F.max((F.length("text") / CHARS).cast("int")).alias("longest")
    )
    gapless = F.forall(F.transform("spans", lambda s, i: F.when(i == 0, s["start"] == 0).otherwise(s["start"] == F.get("spans", i - 1)["end"])), lambda ok: ok)
    return parts.join(rows, ["tab", "row_id"]).select(
        "tab", "row_id", (gapless & (F.element_at("spans", -1)["end"] == F.col("length"))).alias("covered"), ((F.col("most") <= LIMIT) & (F.col("longest") <= LIMIT)).alias("within")
    )


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover}
ORACLES = {
    "p4_found": """
        SELECT 'blocks' AS tab, block_id AS row_id FROM blocks WHERE greatest(1, length(text) // 3) > 400
        UNION ALL
        SELECT 'chunks', chunk_id FROM chunks WHERE greatest(1, length(text) // 3) > 400""",
    "p4_cover": """
        SELECT 'blocks' AS tab, block_id AS row_id, true AS covered, true AS within FROM blocks WHERE greatest(1, length(text) // 3) > 400
        UNION ALL
        SELECT 'chunks', chunk_id, true, true FROM chunks WHERE greatest(1, length(text) // 3) > 400""",
}
