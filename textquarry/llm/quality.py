"""Problem 8: text quality statistics of each document, and its shape from them.

The statistics are JVM expressions over the whole text.  Each labelling function cuts
one statistic at its thresholds; single cuts are noisy and contradict one another (a
list in sentences, a table of words, prose with a list in it).  What each function
says of each type of text, and how common the types are, is learnt by
expectation-maximisation on the agreements of all documents.  Documents with equal
answers are counted first: the patterns number at most the product of the levels,
whatever the size of the corpus, and the iteration runs over them.  A shape has several types; its
posterior is their sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.session import checkpointed, pinned, table

SHAPES = ("prose", "list", "table", "junk")

# Frequent function words of Russian and English.
COMMON = (
    "и в во на с со к ко по от до из за у о об при для не ни что как так то либо или если после пока где "
    "который которого которой котором должен должна должны более менее также этом его их чем без между "
    "the of and to in is are be a an for with by from at that this it or not if any each its shall than on when where which"
)

_BULLET = r"(?m)^[ \t]*([-–—•*·‣]|\(?\d{1,3}[.)]|[а-яёa-z]\)|\d{1,2}(\.\d{1,3})+\.?)[ \t].{1,150}$"
_LEADER = r"(?m)^[^\n]*?\.[. ]{4,}[ \t]*\d+[ \t]*$"
_CODES = r"(?mU)^(ГОСТ|ОСТ|СП|РД|СТО|ТУ|ISO|EN|DIN|IEC)( Р)? [\d.]+[-–—]\d{2,4}[ ,.].{0,100}$"
_ITEM = r"(?mU)^[ \t]*\p{Lu}[^.;:!?\n]{0,70};?[ \t]*$"
_CELLS = r"(?m)^(?:[^|\n]*+\|[^|\n]*+\|.*|[^\t\n]*+\t[^\t\n]*+\t.*|[^;\n]++;[^ ;\n][^;\n]*+;[^ ;\n].*|[ \t]*+\S++(?: \S++)*+ {2,}\S++(?: \S++)*+ {2,}\S.*)$"
_NUMBER_ROW = r"(?mU)^[ \t]*(\p{Lu}{0,3}\d[\d.,]*|—)([ \t]+(—|[\d.,]*\d[\d.,]*)){2,}[ \t]*$"
_CODE_LINE = r"(?m)^[ \t]*([A-Za-z_$][\w.$]*[ \t]*[={(\[:]|[{}\[\]<]|0x[0-9a-fA-F]+).{0,150}$"
_SYMBOL = r"[^\p{L}\p{N}\s.,;:!?()\"'«»„“”%№°²³·/—–\-+=|•*]"
_STUTTER = r"(?U)(?<![\w])((\p{L})\2{0,3}|[_.,-]{1,3})(?![\w.,-])"
_SENTENCE = r"(?U)\p{L}\p{L}[»\")]?[.!?…]+(\s|$)"


def _share(column: str, pattern: str, needs: str | None = None) -> Column:
    """Share of the text's characters that the pattern covers; ``needs`` is a simpler pattern that any match holds."""
    share = 1 - F.length(F.regexp_replace(column, pattern, "")) / F.greatest(F.length(column), F.lit(1))
    return F.when(F.col(column).rlike(needs), share).when(F.col(column).isNotNull(), 0.0) if needs else share


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of statistics for each document.

    A null or blank text has word count 0 and null for every ratio; repeated
    documents keep a row each.
    """
    base = documents.select(key, F.nullif(F.regexp_replace(F.col(text), r"(?U)\A\s+|\s+\z", ""), F.lit("")).alias("_t"))
    base = pinned(base, "_w", F.split(F.lower("_t"), r"(?U)\s+"))
    base = pinned(base, "_l", F.filter(F.split("_t", r"\r?\n"), lambda x: x.rlike(r"(?U)\S")))
    n_words, n_lines = F.nullif(F.size("_w"), F.lit(0)), F.nullif(F.size("_l"), F.lit(0))
    letters = F.length(F.regexp_replace("_t", r"[^\p{L}]+", ""))
    return base.select(
        key,
        F.coalesce(F.when(F.col("_w").isNotNull(), n_words), F.lit(0)).alias("word_count"),
        (F.length(F.array_join("_w", "")) / n_words).alias("mean_word_length"),
        (F.regexp_count("_t", F.lit(_SYMBOL)) / F.length("_t")).alias("symbol_ratio"),
        (F.regexp_count("_t", F.lit(r"(?m)[.!?…;:][»\")\]]?[ \t]*$")) / n_lines).alias("line_end_punctuation"),
        (F.size(F.filter("_w", lambda w: w.isin(COMMON.split()))) / n_words).alias("common_words"),
        F.when(F.col("_l").isNotNull(), n_lines).alias("line_count"),
        (F.length("_t") / n_lines).alias("mean_line_length"),
        (letters / F.length("_t")).alias("letter_share"),
        (F.size(F.array_distinct("_l")) / n_lines).alias("distinct_lines"),
        (F.size(F.array_distinct("_w")) / n_words).alias("distinct_words"),
        _share("_t", _BULLET).alias("bullet_share"),
        (F.regexp_count("_t", F.lit(_BULLET)) / n_lines).alias("bullet_lines"),
        _share("_t", _LEADER, r"\.[. ]{4}").alias("leader_share"),
        _share("_t", _CODES).alias("reference_share"),
        _share("_t", _ITEM).alias("item_share"),
        _share("_t", _CELLS, r"[|\t;]| {2}").alias("cell_share"),
        _share("_t", _NUMBER_ROW).alias("number_row_share"),
        _share("_t", _CODE_LINE).alias("code_share"),
        (F.regexp_count("_t", F.lit(_STUTTER)) / n_words).alias("stutter_share"),
        F.regexp_count("_t", F.lit(_SENTENCE)).alias("sentences"),
    )


#: Labelling functions: name, statistic, thresholds.  The answer is the number of thresholds reached.
FUNCTIONS = (
    ("common", "common_words", (0.03, 0.12)),
    ("symbols", "symbol_ratio", (0.04,)),
    ("lines", "distinct_lines", (0.4,)),
    ("words", "distinct_words", (0.35,)),
    ("stutter", "stutter_share", (0.5,)),
    ("code", "code_share", (0.5,)),
    ("long", "mean_word_length", (20,)),
    ("bullets", "bullet_share", (0.5,)),
    ("cells", "cell_share", (0.5,)),
    ("rows", "number_row_share", (0.5,)),
    ("leaders", "leader_share", (0.4,)),
    ("references", "reference_share", (0.5,)),
    ("items", "item_share", (0.6,)),
    ("sentences", "sentences", (1,)),
    ("letters", "letter_share", (0.4, 0.68)),
    ("height", "line_count", (2, 3)),
    ("width", "word_count / line_count", (6,)),
)
LEVELS = [len(cuts) + 1 for _, _, cuts in FUNCTIONS]
_PLAIN = {"bullets": 0, "leaders": 0, "references": 0, "items": 0, "cells": 0, "rows": 0}
#: Types of text: shape, and the answers that are expected at the start of the learning.
TYPES = (
    ("prose", {"common": 2, "sentences": 1, "width": 1, "letters": 2}),
    ("prose", {"common": 2, "sentences": 0, "width": 1, "letters": 2, **_PLAIN}),
    ("prose", {"common": 1, "sentences": 1, "width": 1, "letters": 2, **_PLAIN}),
    ("list", {"bullets": 1, "common": 0}),
    ("list", {"leaders": 1}),
    ("list", {"references": 1}),
    ("list", {"items": 1, "lines": 1, "long": 0, "common": 0, "height": 2, "width": 0, "letters": 2}),
    ("table", {"cells": 1, "common": 0}),
    ("table", {"rows": 1, "letters": 0}),
    ("junk", {"symbols": 1}),
    ("junk", {"lines": 0, "words": 0}),
    ("junk", {"words": 0}),
    ("junk", {"stutter": 1}),
    ("junk", {"code": 1}),
    ("junk", {"long": 1, "common": 0, "letters": 2, "items": 0}),
    ("junk", {"common": 0, "sentences": 0, "letters": 2, "width": 1, **_PLAIN}),
)
#: Chance of an expected answer at the start, and what the start weighs, as a share of the documents, so that it counts alike at every size.
EXPECTED, STRENGTH = 0.9, 0.002


def answers(patterns: np.ndarray) -> np.ndarray:
    """Answers of the functions, from their code in one number."""
    out = np.zeros((len(patterns), len(LEVELS)), dtype=np.int64)
    for f in range(len(LEVELS) - 1, -1, -1):
        patterns, out[:, f] = np.divmod(patterns, LEVELS[f])
    return out


def fit(given: np.ndarray, count: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, list[np.ndarray]]:
    """Share of each type and, for each function, the chances of its answers by type; ``rounds`` of 0 gives the start.

    The start takes an expected answer for likely and spreads the others evenly, half
    of it as all documents have them, so that types without documents keep a meaning.
    """
    start = []
    for f, (name, _, _) in enumerate(FUNCTIONS):
        common = np.bincount(given[:, f], weights=count, minlength=LEVELS[f]) / max(count.sum(), 1)
        p = np.tile(0.5 / LEVELS[f] + 0.5 * common, (len(TYPES), 1))
        for k, (_, expected) in enumerate(TYPES):
            if name in expected:
                p[k] = (1 - EXPECTED) / (LEVELS[f] - 1)
                p[k, expected[name]] = EXPECTED
        start.append(p)
    share, chance = np.full(len(TYPES), 1 / len(TYPES)), start
    strength = STRENGTH * count.sum()
    for _ in range(rounds):
        weight = posterior(given, share, chance) * count[:, None]
        share = (weight.sum(axis=0) + strength) / (weight.sum() + strength * len(TYPES))
        chance = []
        for f in range(len(FUNCTIONS)):
            seen = np.zeros((LEVELS[f], len(TYPES)))
            np.add.at(seen, given[:, f], weight)
            chance.append((seen.T + strength * start[f]) / (weight.sum(axis=0) + strength)[:, None])
    return share, chance


def posterior(given: np.ndarray, share: np.ndarray, chance: list[np.ndarray]) -> np.ndarray:
    """Probability of each type for each pattern of answers."""
    logs = np.log(share)[None, :] + sum(np.log(chance[f]).T[given[:, f]] for f in range(len(FUNCTIONS)))
    raw = np.exp(logs - logs.max(axis=1, keepdims=True))
    return raw / raw.sum(axis=1, keepdims=True)


def shapes_of(given: np.ndarray, share: np.ndarray, chance: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest shape (ties in the order of ``SHAPES``) and its posterior, for each pattern."""
    types = posterior(given, share, chance)
    by_shape = np.stack([types[:, [k for k, (t, _) in enumerate(TYPES) if t == shape]].sum(axis=1) for shape in SHAPES], axis=1)
    return np.array(SHAPES, dtype=object)[by_shape.argmax(axis=1)], by_shape.max(axis=1)


def text_shapes(documents: DataFrame, statistics: bool = True) -> DataFrame:
    """``doc_id, shape, confidence, answers`` and, where wanted, the statistics.

    Null and blank texts have no shape and are left out; repeated documents keep a
    row each; a statistic that is null reaches no threshold.
    """
    spark = documents.sparkSession
    code = F.lit(0)
    for (_, statistic, cuts), levels in zip(FUNCTIONS, LEVELS):
        value = F.expr(statistic)
        code = code * levels + sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    every = text_statistics(documents).where("word_count > 0").withColumn("answers", code)
    voted = checkpointed(every if statistics else every.select("doc_id", "answers"))
    patterns = sorted((r["answers"], r["n"]) for r in voted.groupBy("answers").agg(F.count("*").alias("n")).collect())
    given = answers(np.array([p for p, _ in patterns], dtype=np.int64))
    shape, confidence = shapes_of(given, *fit(given, np.array([n for _, n in patterns], dtype=float))) if patterns else ((), ())
    rows = [(p, str(s), float(c)) for (p, _), s, c in zip(patterns, shape, confidence)]
    # one row for each pattern: at most the product of the levels, half a million
    return voted.join(F.broadcast(spark.createDataFrame(rows, "answers int, shape string, confidence double")), "answers")


def p8_shapes(spark, sf_dir: str) -> DataFrame:
    """Statistics, shape and confidence of every document."""
    return text_shapes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_statistics(spark, sf_dir: str) -> DataFrame:
    """The statistics alone, null and blank texts included."""
    return text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose, with their shape."""
    shapes = text_shapes(table(spark, sf_dir, "documents").select("doc_id", "text"), statistics=False)
    return shapes.where("shape <> 'prose'").select("doc_id", "shape")


QUERIES = {"p8_found": p8_found, "p8_shapes": p8_shapes, "p8_statistics": p8_statistics}
ORACLES: dict[str, str] = {}
