"""Problem 2: one form for text that looks the same but differs in its characters.

``canonical`` is the canonicaliser of one value: compatibility normalisation to the
composed form, mapped white space, removal of default-ignorable characters, dashes of
codes, and look-alike letters put back into the script of their word.  A word wholly
made of look-alike letters (``HB`` in either alphabet) gets the script that most of its
occurrences have among neighbours of the same script, counted over the whole corpus.
``folded`` adds full case folding and compatibility normalisation of signs, for
comparing.  Values are computed once each: repeated ones of a batch together, short
ones once a worker.

Both queries use it: ``p2_canonical`` gives the forms, ``p2_found`` the values that
differ from theirs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.session import checkpointed, table

# Letters of Latin and Greek and the Cyrillic letters they look like.
LATIN = "ABCEHKMOPTXYaceopxykëË"
LATIN_AS_CYRILLIC = "АВСЕНКМОРТХУасеорхукёЁ"
GREEK = "ΑΒΕΗΚΜΟΡΤΥΧαορχνκ"
GREEK_AS_CYRILLIC = "АВЕНКМОРТУХаорхук"
GREEK_AS_LATIN = "ABEHKMOPTYXaopxvk"
# Default-ignorable code points, as the inside of a character class.
IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
SPACES = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085"
WIDE = "\uff01-\uff60\uffe0-\uffe6"
MARKS = "\u0300-\u036f"
DASHES = "\u2010-\u2015\u2212\u00ac\ufe58\ufe63\uff0d"
CYR = "Ѐ-ӿ"
LAT = "A-Za-zëË"
GRE = "Α-Ωα-ω"

_IGNORABLE = re.compile(f"[{IGNORABLE}]")
_SPACES = re.compile(f"[{SPACES}]")
_CONTROL = re.compile("[\t\x0b\x0c]")
_WIDE = re.compile(f"[{WIDE}]")
_MIXED = f"[{CYR}][0-9]*[{LAT}{GRE}]|[{LAT}{GRE}][0-9]*[{CYR}]|[A-Za-z][{GRE}]|[{GRE}][A-Za-z]"
_ODD = re.compile(f"[A-Za-z{CYR}][{MARKS}]|[{IGNORABLE}{SPACES}{WIDE}]|{_MIXED}")
_DASH = re.compile(f"[{DASHES}]")
_WORDS = re.compile(f"[0-9{LAT}{CYR}{GRE}]+")
_MIXED_WORD = re.compile(_MIXED)
_ONLY_LOOKS = re.compile(f"(?<![0-9A-Za-z{CYR}{GRE}])[0-9{LATIN}{LATIN_AS_CYRILLIC}{GREEK}]+(?![0-9A-Za-z{CYR}{GRE}])")
_FOREIGN = re.compile(f"[{LAT}{GRE}]")
_CYRILLIC = re.compile(f"[{CYR}]")
_DIGIT = re.compile("[0-9]")
_TO_CYRILLIC = str.maketrans(LATIN + GREEK, LATIN_AS_CYRILLIC + GREEK_AS_CYRILLIC)
_TO_LATIN = str.maketrans(LATIN_AS_CYRILLIC + GREEK, LATIN + GREEK_AS_LATIN)
_FIRM_CYRILLIC = re.compile(f"[{CYR}]").findall
_FIRM_FOREIGN = re.compile(f"[{LAT}{GRE}]").findall

#: Characters on either side of a word whose letters decide which script it stands among.
CONTEXT = 30


def _mend(match: re.Match) -> str:
    word = match[0]
    if not _MIXED_WORD.search(word):
        return word
    cyrillic, foreign = _FIRM_CYRILLIC(word), _FIRM_FOREIGN(word)
    own = sum(c not in LATIN_AS_CYRILLIC for c in cyrillic)
    other = sum(c not in LATIN and c not in GREEK for c in foreign)
    # letters with no double in the other script decide, then the majority
    return word.translate(_TO_CYRILLIC if (own, len(cyrillic)) >= (other, len(foreign)) and cyrillic else _TO_LATIN)


def plain_breaks(text: str) -> str:
    """Line ends as LF and control spaces as spaces: differences that are no disguise."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _CONTROL.sub(" ", text)


def canonical(text: str, dash: bool = False) -> str:
    """One value in its consistent form, but for words wholly of look-alikes.  Signs such as superscripts keep their meaning."""
    text = plain_breaks(text)
    if _ODD.search(text):
        text = _SPACES.sub(" ", _IGNORABLE.sub("", text))
        text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
        text = _WORDS.sub(_mend, unicodedata.normalize("NFC", text))
    elif not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _DASH.sub("-", text) if dash else text


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


class Known:
    """Results for short values, kept by the worker: designations, statuses and other values that recur."""

    def __init__(self, compute, most: int = 100_000, length: int = 200) -> None:
        self.compute, self.most, self.length, self.done = compute, most, length, {}

    def __call__(self, *value):
        if len(value[0]) > self.length:
            return self.compute(*value)
        if value not in self.done:
            if len(self.done) >= self.most:
                self.done.clear()
            self.done[value] = self.compute(*value)
        return self.done[value]


def canonical_text(column: Column | str, fold: bool = False) -> Column:
    """``canonical`` over a string column, folded where asked for; null stays null and the empty text stays empty."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values, use_na_sentinel=True)
        done = [folded(canonical(v)) if fold else canonical(v) for v in distinct]
        return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)

    return run(F.col(column) if isinstance(column, str) else column)


def skeleton(column: Column) -> Column:
    """A comparison key computed in the JVM: lower case, one script, no marks, nothing ignorable.

    Look-alikes fold whatever their word, so the key is for comparing, not for reading.
    """
    looks = dict(zip("abcehkmoptxyëαβεηκμορτυχνйё", "авсенкмортхуеавенкмортухвие"))
    # wide forms and look-alikes in one pass over the lower-cased text
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    steps = {**looks, **{w: looks.get(n.lower(), n.lower()) for w, n in wide.items()}}
    plain = F.regexp_replace(column, f"[{MARKS}{IGNORABLE}]", "")
    return F.translate(F.lower(plain), "".join(steps), "".join(steps.values()))


def _look_words(text: str) -> Iterator[tuple[re.Match, str]]:
    """Each word wholly made of look-alike letters, and its ``skeleton|script|context``."""
    foreign = _FOREIGN.search(text) is not None
    for m in _ONLY_LOOKS.finditer(text):
        word = m[0]
        script = "c" if _CYRILLIC.search(word) else "f" if _FOREIGN.search(word) else ""
        if not script:
            continue
        context = "c"
        if foreign:
            around = text[max(0, m.start() - CONTEXT) : m.start()] + " " + text[m.end() : m.end() + CONTEXT]
            context = "f" if len(_FIRM_FOREIGN(around)) > len(_FIRM_CYRILLIC(around)) else "c"
        yield m, f"{_DIGIT.sub('#', word.translate(_TO_CYRILLIC))}|{script}|{context}"


def _looks(text: str) -> list[str]:
    return [key for _, key in _look_words(text)]


def _rewritten(text: str, minority: set[str]) -> str:
    """The text with the words of the minority in the script of the majority."""
    out, at = [], 0
    for m, key in _look_words(text):
        if key in minority:
            out += [text[at : m.start()], m[0].translate(_TO_LATIN if key.split("|")[1] == "c" else _TO_CYRILLIC)]
            at = m.end()
    return "".join([*out, text[at:]])


def _parts(scanned: DataFrame, key: list[str]) -> DataFrame:
    return scanned.select(*key, F.explode("_s.looks").alias("_w")).select(*key, "_w", *(F.split("_w", r"\|")[i].alias(c) for i, c in enumerate(("_skel", "_script", "_context"))))


def _minority(parts: DataFrame) -> DataFrame:
    """``_skel, _context, _script``: words in the script that fewer of their occurrences have; one row for each shape of word and context."""
    return (
        parts.groupBy("_skel", "_context")
        .agg(F.sum(F.when(F.col("_script") == "c", 1).otherwise(0)).alias("_c"), F.count("*").alias("_n"))
        .where("_c > 0 and _c < _n")
        .select("_skel", "_context", F.when(F.expr("2 * _c >= _n"), "f").otherwise("c").alias("_script"))
    )


def _scanned(values: DataFrame, key: list[str], value: str, dash: str) -> DataFrame:
    """``key, _s``: whether the canonical form of the value differs from it, and the look-alike words of the form."""

    def look(text: str, dashed: bool) -> tuple[bool, list[str]]:
        form = canonical(text, dashed)
        return form != plain_breaks(text), _looks(form)

    known = Known(look)

    @F.pandas_udf("odd boolean, looks array<string>")
    def scan(texts: pd.Series, dashed: pd.Series) -> pd.DataFrame:
        out = [(False, []) if t is None else known(t, bool(d)) for t, d in zip(texts, dashed)]
        return pd.DataFrame(out, columns=["odd", "looks"])

    # keys and marks without the texts are read more than once, the texts once
    return checkpointed(values.select(*key, scan(F.col(value), F.expr(dash)).alias("_s")))


def _hidden(scanned: DataFrame, key: list[str]) -> DataFrame:
    """``key, _w``: the words of a row that are in the script of the minority."""
    parts = _parts(scanned, key)
    return parts.join(_minority(parts), ["_skel", "_context", "_script"], "left_semi").select(*key, "_w")


def disguised_rows(values: DataFrame, key: list[str], value: str, dash: str = "false") -> DataFrame:
    """Keys of the rows whose ``value`` differs from its canonical form by more than line ends, tabs and letter case.

    ``dash`` is a SQL condition telling in which rows every dash is ``-``.
    Null and empty values are no case; repeated rows come out as often as they came in.
    """
    scanned = _scanned(values, key, value, dash)
    minority = _minority(_parts(scanned, key))
    rest = _parts(scanned.where("not _s.odd"), key).join(minority, ["_skel", "_context", "_script"], "left_semi").select(*key).distinct()
    return scanned.where("_s.odd").select(*key).unionByName(rest)


def canonical_values(values: DataFrame, key: list[str], value: str, fold: str = "false", dash: str = "false") -> DataFrame:
    """``key, canonical, folded``: the consistent form of each value, whose ``key`` is unique, and the form for comparing.

    ``fold`` and ``dash`` are SQL conditions telling in which rows ``canonical`` has its
    case folded too and every dash is ``-``.
    """

    def finish(text: str, minority: tuple, fold_: bool, dashed: bool) -> tuple[str, str]:
        plain = _rewritten(canonical(text, dashed), set(minority))
        low = folded(plain)
        return (low if fold_ else plain), low

    known = Known(finish)

    @F.pandas_udf("canonical string, folded string")
    def run(texts: pd.Series, minority: pd.Series, folds: pd.Series, dashed: pd.Series) -> pd.DataFrame:
        out = [
            (None, None) if t is None else known(t, () if w is None else tuple(sorted(w)), bool(f), bool(d)) for t, w, f, d in zip(texts, minority, folds, dashed)
        ]
        return pd.DataFrame(out, columns=["canonical", "folded"])

    scanned = _scanned(values, key, value, dash)
    hidden = _hidden(scanned.where("size(_s.looks) > 0"), key).groupBy(*key).agg(F.collect_set("_w").alias("_m"))
    done = values.join(hidden, key, "left").select(*key, run(F.col(value), F.col("_m"), F.expr(fold), F.expr(dash)).alias("_c"))
    return done.select(*key, "_c.canonical", "_c.folded")


def look_alike_values(spark, sf_dir: str) -> DataFrame:
    """The values of the problem in long form: ``tab, row_id, field, value``."""
    meta = table(spark, sf_dir, "doc_meta").select(
        F.lit("doc_meta").alias("tab"),
        F.col("meta_id").alias("row_id"),
        F.explode(F.create_map(F.lit("designation"), "designation", F.lit("status"), "status")).alias("field", "value"),
    )
    chunks = table(spark, sf_dir, "chunks").select(
        F.lit("chunks").alias("tab"), F.col("chunk_id").alias("row_id"), F.lit("text").alias("field"), F.col("text").alias("value")
    )
    return meta.unionByName(chunks)


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Values that differ from their canonical form."""
    return disguised_rows(look_alike_values(spark, sf_dir), ["tab", "row_id", "field"], "value", "field = 'designation'")


def p2_canonical(spark, sf_dir: str) -> DataFrame:
    """Every value in its consistent form, designation and status with full case folding, and folded for comparing."""
    return canonical_values(look_alike_values(spark, sf_dir), ["tab", "row_id", "field"], "value", "field <> 'text'", "field = 'designation'")


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
ORACLES: dict[str, str] = {}
