"""Column expressions for text: cleaning, clauses, tokens, numbers and citation markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIP = r"(?U)\A\s+|\s+\z"


def stripped(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, STRIP, "")


# Characters that cleaning deletes, and those that it reads as a space.
DELETED = "[\\u00ad\\u200b]"
ODD_SPACES = "[\\u00a0\\u202f\\u2007]"
# A plain space between capitals that stand alone, at least three in a row.
SPACED_CAPITALS = r"(?U)(?<=\b[А-ЯЁ]) (?=[А-ЯЁ]\s[А-ЯЁ]\b)|(?<=\b[А-ЯЁ]\s[А-ЯЁ]) (?=[А-ЯЁ]\b)"


def clean_page_text(c: Column) -> Column:
    """Line ends, soft hyphens, odd spaces, wrapped words, spaced capitals, blank runs; null stays null, the empty text empty."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, DELETED, "")
    c = F.regexp_replace(c, ODD_SPACES, " ")
    c = F.regexp_replace(c, r"(?U)(\w)[-‐‑]\s*\n\s*(\w)", "$1$2")
    c = F.regexp_replace(c, SPACED_CAPITALS, "")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"(?U)(?m)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    return stripped(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clause_number(line: Column) -> Column:
    """The clause that the line opens, null where it opens none (at least three letters must follow)."""
    number = F.regexp_extract(line, r"^\s*(\d{1,3}(?:\.\d{1,3}){0,4})\.?\s+\S", 1)
    rest = F.regexp_replace(F.regexp_replace(line, r"^\s*\d{1,3}(?:\.\d{1,3}){0,4}\.?\s+", ""), r"[^\p{L}]+", "")
    return F.when((number != "") & (F.length(rest) >= 3), number)


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(c) / 3).cast("int"))


def numbers(c: Column) -> Column:
    """Numbers as written, with a sign directly before them."""
    return F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_,.])[-+±]?\d+(?:[.,]\d+)?"), F.lit(0))


def canonical_number(x: Column) -> Column:
    return F.translate(F.regexp_replace(x, r"^[-+±]", ""), ".", ",")


def citation_ids(answer: Column) -> Column:
    """Cited positions in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def strip_citations(answer: Column) -> Column:
    """The answer without markers, doubled spaces and spaces before punctuation."""
    c = F.regexp_replace(answer, r"\[S\d+\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r" +([.,;:])", "$1"))


def point_id(doc_id: Column, index: Column, text_hash: Column, namespace: str = "6f0b9d1e3a4c4f8b9c2a1d5e7f0a2b31") -> Column:
    """UUID version 5 of ``doc:index:hash``, computed in the JVM."""
    name = F.concat_ws(":", doc_id, index.cast("string"), text_hash)
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
