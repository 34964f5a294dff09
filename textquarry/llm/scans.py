"""Problem 1: noise in text from scanned pages.

A hidden Markov model labels the lines of every row as header (running headers,
footers and page numbers), body or break (a body line that ends inside a word).  A
line is observed by its layout: its place on the page, its length against the page's
median with its share of digits and whether its number agrees with the page, how it
ends, how the next line begins, and how often the corpus shows its form at page edges.  Each of these
has a distribution of its own in each state; these and the transitions start from
rough weights and are re-estimated by Viterbi training on all scanned rows: every
round labels all their lines where they lie, and only counts come to the driver.
The counts of forms and words cover all rows too.

Only lines that the path labels as break are read as such: the lexicon then tells a
cut word from a compound cut at its own hyphen.  A word is misread when it is rare and
one visual confusion away from a far more frequent word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import product
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.glyphs import _ODD, canonical
from textquarry.session import checkpointed, table

#: Least share of a word among all words, and of a form among the lines at page edges.  At most the
#: inverse of it reach the share, which bounds what is broadcast at any size of the corpus.
LEXICON, FORMS = 1e-7, 1e-4
#: Rounds of training.
ROUNDS = 4
#: Times that a word must be more frequent than its misreading.
RATIO = 12

MARKS = "-‐‑–—¬­"
LETTERS = "А-Яа-яЁёA-Za-z"
# Strings that recognition confuses, what is read and what was printed.
CONFUSED = (
    ("0", "о"), ("3", "з"), ("4", "ч"), ("6", "б"), ("8", "в"), ("@", "а"), ("|с", "к"), (">к", "ж"), ("|(", "к"),
    ("ср", "ф"), ("ьт", "ы"), ("ьг", "ы"), ("и", "м"), ("и", "н"), ("н", "и"), ("н", "п"), ("п", "н"), ("п", "ц"), ("п", "л"),
    ("д", "л"), ("л", "д"), ("л", "я"), ("г", "т"), ("т", "г"), ("с", "е"), ("е", "с"), ("ш", "щ"), ("щ", "ш"), ("ц", "п"),
    ("ж", "х"), ("х", "ж"), ("о", "с"), ("с", "о"), ("ь", "ъ"), ("в", "з"), ("з", "в"), ("1", "l"), ("|", "l"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("c", "e"), ("0", "o"), ("5", "s"),
)
ALPHABET = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"

_WORD = re.compile(f"[{LETTERS}0-9@|>$?<]*[{LETTERS}][{LETTERS}0-9@|>$?<]*(?:-[{LETTERS}0-9@|>$?<]*[{LETTERS}][{LETTERS}0-9@|>$?<]*)*")
_PLAIN = re.compile(f"[{LETTERS}]+(?:-[{LETTERS}]+)*")
_END = re.compile(rf"([{LETTERS}0-9@|>$<]*[{LETTERS}0-9@|>$<])[{MARKS}] ?$")
_BEGIN = re.compile(rf"\s*([{LETTERS}0-9@|>$?<]+)")
_NUM = "[0-9|бчзЗОоlI?%$@]"
_DESIGNATION = re.compile(rf"(?<!\w)[А-ЯЁA-Z]{{2,5}}( ?[РP])? ?{_NUM}{{4,6}} ?[-–—‑] ?{_NUM}{{2,4}}(?!\w)")
_DIGITS, _CAPITALS = re.compile("[0-9|]"), re.compile("[А-ЯЁA-Z]{2}")
_NUMBER = re.compile(rf"{_NUM}+")
_BAD_NUMBER = re.compile(r"(?=.*[0-9])(?=.*[|бчз?%$@])[0-9|бчзЗОо?%$@]+(?:[.,][0-9|бчзЗОо?%$@]+)?")
_FORMULA = re.compile(r"^\s*[A-Za-zА-Я]\w{0,3}\s*=")


def plain_characters(text: str) -> str:
    return canonical(text) if _ODD.search(text) or "\r" in text or "\t" in text else text


def cut_word(line: str) -> re.Match | None:
    """The part of a word before a mark at the line's end."""
    end = line.rstrip(" ")
    if not end or end[-1] not in MARKS:
        return None
    at = len(end) - 1
    while at and end[at - 1] not in " \t\xa0":
        at -= 1
    return _END.search(line, at)


def form(line: str) -> str:
    """The line with its designations and numbers masked."""
    if not _DIGITS.search(line):
        return " ".join(line.split()).lower()
    masked = _DESIGNATION.sub("§", line) if _CAPITALS.search(line) else line
    masked = re.sub(rf"(?<![\w.,]){_NUM}*[0-9|]{_NUM}*(?![\w])", "#", masked)
    return re.sub(r"\s+", " ", re.sub(r" ?\.+(?=\s|$)", "", masked) if "§" in masked else masked).strip().lower()


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) - (1 << 63)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashed forms of the lines of pages, counted at the edges and inside."""
    for batch in batches:
        edge, inside = Counter(), Counter()
        for text in batch["text"]:
            lines = [x for x in text.split("\n") if x.strip()]
            for k, line in enumerate(lines):
                (edge if k < 2 or k >= len(lines) - 1 else inside)[_hash(form(line))] += 1
        keys = sorted(set(edge) | set(inside))
        if keys:
            yield pd.DataFrame({"form": keys, "edge": [edge[x] for x in keys], "inside": [inside[x] for x in keys]})


def _begins(line: str) -> str:
    c = line.lstrip()[:2]
    if c[:1] == "|":
        return "bar" if c[1:] in ("", " ") else "digit"
    return "none" if not c else "lower" if c[0].islower() else "upper" if c[0].isalpha() else "digit" if c[0].isdigit() else "sign"


def observe(lines: list[str], forms: dict[int, str], first: int | None, last: int | None, page: bool) -> tuple[list[int], list[tuple]]:
    """Places of the lines that are not blank, and the layout of each."""
    at = [k for k, x in enumerate(lines) if x.strip()]
    if not at:
        return [], []
    median = sorted(len(lines[k]) for k in at)[len(at) // 2]
    bins = [forms.get(_hash(form(lines[k])), "inside") for k in at]
    # what follows a line is the next one that is no running line by its form
    follows, after = [], "none"
    for k, known in zip(reversed(at), reversed(bins)):
        follows.append(after)
        after = after if known == "edge" else _begins(lines[k])
    seen = []
    formula = False
    for n, (k, known, following) in enumerate(zip(at, bins, reversed(follows))):
        line = lines[k]
        place = "chunk" if not page else "top" if n == 0 else "second" if n == 1 else "bottom" if n == len(at) - 1 else "inside"
        signs = line.replace(" ", "")
        digits = sum(map(signs.count, "0123456789|")) / len(signs)
        agrees = "-"
        number = _NUMBER.search(line) if digits >= 0.2 and len(signs) <= 12 else None
        if number and first is not None:
            value = re.sub(r"\D", "", number[0].replace("|", "1").replace("б", "6"))[:6]
            agrees = "yes" if value and first <= int(value) <= (last or first) + (not page) else "no"
        end = line.rstrip()[-1]
        size = "short" if 3 * len(line) < median else "middle" if 4 * len(line) < 3 * median else "full"
        size = "short" if 3 * len(line) < median else "middle" if 4 * len(line) < 3 * median else "full"
        kind = (size, "none" if not digits else "some" if digits < 0.5 else "most", agrees)
        ends = "cut" if cut_word(line) else "stop" if end in ".;:!?" else "bar" if end == "|" else "other"
        # a number after a formula is the formula's
        seen.append((place, (known, kind, formula), ends, following))
        formula = _FORMULA.match(line) is not None
    return at, seen


STATES = ("header", "body", "break")
#: Values of each feature of a line's layout, all layouts that follow, and their numbers.
FEATURES = (
    ("top", "second", "bottom", "inside", "chunk"),
    tuple(product(("edge", "mixed", "inside"), product(("short", "middle", "full"), ("none", "some", "most"), ("-", "yes", "no")), (False, True))),
    ("cut", "stop", "bar", "other"),
    ("none", "lower", "upper", "digit", "sign", "bar"),
)
LAYOUTS = list(product(*FEATURES))
CODES = {layout: n for n, layout in enumerate(LAYOUTS)}
# Rough weights that training starts from: (header, body, break) for the values of each feature; what is not named shares the rest.
PLACE = {"top": (0.27, 0.03, 0.03), "second": (0.1, 0.03, 0.03), "bottom": (0.21, 0.03, 0.03), "chunk": (0.4, 0.4, 0.4)}
FORM = {"edge": (0.75, 0.005, 0.005), "mixed": (0.15, 0.02, 0.01)}
KIND = {
    ("short", "most", "yes"): (0.3, 0.005, 0.001), ("short", "most", "no"): (0.1, 0.02, 0.001), ("short", "some", "yes"): (0.1, 0.005, 0.001), ("short", "none", "-"): (0.2, 0.05, 0.05),
    ("short", "some", "-"): (0.1, 0.05, 0.02), ("middle", "none", "-"): (0.08, 0.1, 0.1), ("middle", "some", "-"): (0.05, 0.1, 0.1), ("full", "none", "-"): (0.02, 0.35, 0.4), ("full", "some", "-"): (0.01, 0.3, 0.3),
}
FORMULA = {True: (0.0001, 0.05, 0.01)}
ENDS = {"cut": (0.0003, 0.03, 0.98), "stop": (0.1, 0.3, 0.005), "bar": (0.002, 0.1, 0.001)}
NEXT = {"lower": (0.2, 0.35, 0.7), "upper": (0.4, 0.35, 0.1), "digit": (0.1, 0.1, 0.06), "none": (0.15, 0.05, 0.06)}


def _rough(weights: dict, value, state: int) -> float:
    return weights[value][state] if value in weights else max(0.01, (1 - sum(w[state] for w in weights.values())) / 3)


def rough_weight(feature: int, value, state: int) -> float:
    if feature == 1:  # form, kind and formula say much the same, so they are one feature, which starts as if they were three
        return _rough(FORM, value[0], state) * _rough(KIND, value[1], state) * _rough(FORMULA, value[2], state)
    return _rough((PLACE, None, ENDS, NEXT)[feature], value, state)


class LineModel:
    """First-order hidden Markov model whose states emit each feature of a line's layout by itself."""

    def __init__(self, transitions: bool = True) -> None:
        self.transitions = transitions
        self.start = {"header": log(0.5), "body": log(0.4), "break": log(0.1)}
        move = {"header": (0.2, 0.7, 0.1), "body": (0.05, 0.75, 0.2), "break": (0.04, 0.76, 0.2)}
        self.move = {s: dict(zip(STATES, map(log, p))) for s, p in move.items()}
        self.seen: list[dict] = [{} for _ in range(4)]
        self.total = [0.0] * len(STATES)
        self.memo: dict[tuple, tuple[float, ...]] = {}

    def emit(self, line: tuple, strength: float = 20.0) -> tuple[float, ...]:
        out = [0.0] * len(STATES)
        for feature, value in enumerate(line):
            seen = self.seen[feature].get(value, (0.0,) * len(STATES))
            for s in range(len(STATES)):
                out[s] += log((seen[s] + strength * rough_weight(feature, value, s)) / (self.total[s] + strength))
        return tuple(out)

    def best(self, sequence: list[tuple]) -> list[str]:
        """Viterbi path."""
        if not sequence:
            return []
        memo, every = self.memo, range(len(STATES))
        if len(memo) > 200_000:
            memo.clear()
        for x in sequence:
            if x not in memo:
                memo[x] = self.emit(x)
        move = [[self.move[p][s] if self.transitions else self.start[s] for p in STATES] for s in STATES]
        score = [self.start[s] + e for s, e in zip(STATES, memo[sequence[0]])]
        back = []
        for x in sequence[1:]:
            step, new = [], []
            for s in every:
                ways = [a + b for a, b in zip(score, move[s])]
                top = max(ways)
                step.append(ways.index(top))
                new.append(top + memo[x][s])
            back.append(step)
            score = new
        path = [score.index(max(score))]
        for step in reversed(back):
            path.append(step[path[-1]])
        return [STATES[p] for p in reversed(path)]

    def paths(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """States, by number, of sequences of layouts that lie one after the other; as ``best`` finds them, all at once."""
        used, which = np.unique(codes, return_inverse=True)
        emitted = np.array([self.emit(LAYOUTS[c]) for c in used])[which]
        start = np.array([self.start[s] for s in STATES])
        move = np.array([[self.move[p][s] if self.transitions else self.start[s] for p in STATES] for s in STATES])
        # the longest come first, so that those that go on at a step are the first ones
        order = np.argsort(-lengths, kind="stable")
        first, falling = (np.cumsum(lengths) - lengths)[order], -lengths[order]
        back, out = np.zeros((len(codes), len(STATES)), dtype=np.int8), np.empty(len(codes), dtype=np.int8)
        score = start + emitted[first]
        steps = range(1, int(lengths.max()))
        for t in steps:
            n = np.searchsorted(falling, -t)
            here = first[:n] + t
            ways = score[:n, None] + move
            back[here] = ways.argmax(axis=2)
            score[:n] = ways.max(axis=2) + emitted[here]
        state = score.argmax(axis=1)
        for t in reversed(steps):
            n = np.searchsorted(falling, -t)
            here = first[:n] + t
            out[here] = state[:n]
            state[:n] = back[here, state[:n]]
        out[first] = state
        return out

    def tally(self, codes: np.ndarray, lengths: np.ndarray) -> Counter:
        """How often the paths show a state with a layout, at the start and after another: (what, layout or state, state) -> times."""
        if not len(lengths):
            return Counter()
        path, n = self.paths(codes, lengths).astype(np.int64), len(STATES)
        inner = np.ones(len(codes), dtype=bool)
        first = np.cumsum(lengths) - lengths
        inner[first] = False
        pairs = {"seen": codes.astype(np.int64) * n + path, "start": path[first], "move": path[:-1][inner[1:]] * n + path[1:][inner[1:]]}
        return Counter({(what, k // n, k % n): times for what, keys in pairs.items() for k, times in zip(*(x.tolist() for x in np.unique(keys, return_counts=True)))})

    def learn(self, times: Counter) -> None:
        """Distributions from the counts of all sequences."""
        seen: list[dict] = [defaultdict(lambda: [0] * len(STATES)) for _ in FEATURES]
        start, move = Counter({s: 1 for s in STATES}), {s: Counter({t: 5 for t in STATES}) for s in STATES}
        for (what, k, s), n in times.items():
            if what == "seen":
                for feature, value in enumerate(LAYOUTS[k]):
                    seen[feature][value][s] += n
            elif what == "start":
                start[STATES[s]] += n
            else:
                move[STATES[k]][STATES[s]] += n
        self.seen = [{v: tuple(n) for v, n in feature.items()} for feature in seen]
        self.total = [sum(n[s] for n in self.seen[0].values()) for s in range(len(STATES))]
        self.memo = {}
        self.start = {s: log(start[s] / sum(start.values())) for s in STATES}
        self.move = {s: {t: log(move[s][t] / sum(move[s].values())) for t in STATES} for s in STATES}

    def train(self, sequences: list[list[tuple]], rounds: int = ROUNDS) -> LineModel:
        joined, lengths = packed([encoded(x) for x in sequences])
        for _ in range(rounds):
            self.learn(self.tally(joined, lengths))
        return self

    def train_on(self, layouts: DataFrame, rounds: int = ROUNDS) -> LineModel:
        """Train on a column of encoded sequences; what comes to the driver is bounded by the number of layouts."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            times = Counter()
            for batch in batches:
                times.update(self.tally(*packed(batch["lines"])))
            if times:
                yield pd.DataFrame([(*k, n) for k, n in times.items()], columns=["what", "k", "s", "n"])

        for _ in range(rounds):
            counted = layouts.mapInPandas(count, "what string, k int, s int, n long").groupBy("what", "k", "s").agg(F.sum("n").alias("n"))
            self.learn(Counter({(r["what"], r["k"], r["s"]): r["n"] for r in counted.collect()}))
        return self


def encoded(sequence: list[tuple]) -> bytes:
    """The numbers of the layouts of a row's lines."""
    return np.array([CODES[x] for x in sequence], dtype="<u2").tobytes()


def packed(sequences: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded sequences that are not empty, one after the other, and their lengths."""
    kept = [x for x in sequences if x]
    return np.frombuffer(b"".join(kept), dtype="<u2"), np.array([len(x) // 2 for x in kept], dtype=np.int64)


class Lexicon:
    """Frequent words of the corpus, less those that are misreadings of far more frequent ones."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.count = counts
        self.confused: dict[str, list[str]] = defaultdict(list)
        for read, printed in CONFUSED:
            self.confused[read].append(printed)
        self.longest = max(map(len, self.confused))
        self.left = {w.split("-")[0] for w in counts if "-" in w}
        doubtful = [w for w in counts if self._printed(w, counts[w] * RATIO)]
        self.good = {w: n for w, n in counts.items() if w not in set(doubtful)}
        self.known: dict[str, tuple[str, int] | None] = {}
        self.fine: set[str] = set()  # tokens found faultless, as they stand

    def _printed(self, word: str, least: int) -> tuple[str, int] | None:
        best = None
        for i in range(len(word)):
            for n in range(1, self.longest + 1):
                for printed in self.confused.get(word[i : i + n], ()) if i + n <= len(word) else ():
                    other = word[:i] + printed + word[i + n :]
                    count = self.count.get(other, 0)
                    if count >= max(least, 3) and (best is None or count > self.count[best[0]]):
                        best = (other, i)
        return best

    def misread(self, word: str) -> tuple[str, int] | None:
        """(printed word, place of the fault), or None where the word may stand."""
        word = word.lower()
        if word in self.good or len(word) < 2:
            return None
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = self._search(word)
        return self.known[word]

    def _search(self, word: str) -> tuple[str, int] | None:
        found = self._printed(word, self.count.get(word, 1) * RATIO)
        if found:
            return found
        parts = word.split("-")
        if len(parts) > 1:
            at = 0
            for k, part in enumerate(parts):
                inner = None if part in self.good or len(part) < 3 else self._search(part)
                if inner:
                    return "-".join([*parts[:k], inner[0], *parts[k + 1 :]]), at + inner[1]
                at += len(part) + 1
            return None
        # any one letter of a longer word
        if len(word) >= 5:
            least, best = max(3, self.count.get(word, 1) * 2 * RATIO), None
            for i in range(len(word)):
                for c in ALPHABET:
                    n = self.good.get(word[:i] + c + word[i + 1 :], 0)
                    if n >= least and (best is None or n > best[2]):
                        best = (word[:i] + c + word[i + 1 :], i, n)
            if best:
                return best[0], best[1]
        odd = re.search(r"[а-яё]{2}[0-9@|>$?<]+[а-яё]|^[0-9@|>$<][а-яё]{3,}$|[а-яё]{3,}[0-9@|>$<]$", word)
        return (word, odd.start()) if odd else None


#: A cut word and its rest, on either side of the end of a page.
Cut = tuple[str, bool, str]  # part before the mark, whether the mark is a hyphen, rest


def body_lines(text: str | None, page_no: int | None, forms: dict[int, str], model: LineModel) -> list[str]:
    """Lines of a neighbouring page that are not furniture."""
    lines = plain_characters(text or "").split("\n")
    at, symbols = observe(lines, forms, page_no, page_no, True)
    return [lines[k] for k, s in zip(at, model.best(symbols)) if s != "header"]


def cut_between(before: str, after: str) -> Cut | None:
    """The cut word at the end of a line, if its rest begins the line after."""
    cut, begin = cut_word(before), _BEGIN.match(after)
    if not cut or not begin or before.lstrip().startswith("|") or after.lstrip().startswith("|") or not begin[1][0].islower() and begin[1][0].isalpha():
        return None
    return cut[1], before.rstrip()[-1] == "-", begin[1]


def _token(rest: str) -> str:
    """What follows the rest of a cut word up to the next space, such as punctuation."""
    token = re.match(r"\S*", rest)[0]
    return "" if token and token[-1] in MARKS else token


def judge(cut: Cut, lexicon: Lexicon) -> tuple[bool, tuple[str, int] | None]:
    """Whether the word is broken (else a compound cut at its hyphen), and its misreading."""
    low, hyphen, right = cut[0].lower(), cut[1], cut[2].lower()
    whole, compound = low + right, f"{low}-{right}"
    if whole in lexicon.good:
        return True, None
    if hyphen and (compound in lexicon.good or low in lexicon.left and right in lexicon.good):
        return False, None
    wrong = lexicon.misread(whole)
    other = lexicon.misread(compound) if hyphen else None
    return (False, other) if wrong is None and other is not None else (True, wrong)


def read_lines(
    text: str, page: bool, first: int | None, last: int | None, forms: dict[int, str], model: LineModel, lexicon: Lexicon, before: str | None = None, after: str | None = None, moved: bool = True
) -> tuple[list[tuple[int, str]], str]:
    """Flaws as (line number, flaw), and the text in continuous paragraphs.

    ``before`` and ``after`` are the texts of the pages on either side.  A word cut
    between pages is judged whole; it goes to the first of them, and its rest leaves
    the second unless the first is no scan (``moved`` false).
    """
    lines = plain_characters(text).split("\n")
    at, symbols = observe(lines, forms, first, last, page)
    states = dict(zip(at, model.best(symbols)))
    flaws = {(k + 1, "furniture") for k, s in states.items() if s == "header"}
    body = [k for k in at if states[k] != "header"]
    following = dict(zip(body, body[1:]))
    joins: dict[int, str] = {}  # line -> what stands between it and the next
    skip_last, skip_first, fixes = set(), set(), defaultdict(list)
    # a neighbour is labelled only where its lines can matter
    begins = body and before and _BEGIN.match(lines[body[0]])
    head = body_lines(before, first and first - 1, forms, model) if begins and (begins[1][0].islower() or not begins[1][0].isalpha()) else []
    next_ = body_lines(after, first and first + 1, forms, model) if body and after and states[body[-1]] == "break" else []
    opening = cut_between(head[-1], lines[body[0]]) if head else None
    closing = cut_between(lines[body[-1]], next_[0]) if next_ else None
    ended = None  # the whole word at the end of the page
    if opening:
        skip_first.add(body[0])
        wrong = judge(opening, lexicon)[1]
        if wrong and wrong[1] >= len(opening[0]):
            flaws.add((body[0] + 1, "misread"))
    for k in body:
        cut = cut_word(lines[k]) if states[k] == "break" else None
        if not cut or lines[k].lstrip().startswith("|"):
            continue
        left, hyphen = cut[1], lines[k].rstrip()[-1] == "-"
        if k == body[-1] and next_ and not next_[0].lstrip().startswith("|"):
            if closing and not (k in skip_first and _BEGIN.match(lines[k]).end() > cut.start()):
                is_break, wrong = judge(closing, lexicon)
                if is_break:
                    flaws.add((k + 1, "break"))
                if wrong and wrong[1] < len(left):
                    flaws.add((k + 1, "misread"))
                ended = wrong[0] if wrong else left + ("" if is_break else "-") + closing[2]
                skip_last.add(k)
            continue
        begin = _BEGIN.match(lines[following[k]]) if k in following else None
        if begin and not begin[1][0].islower() and begin[1][0].isalpha():
            continue
        if k in following and not begin:
            continue
        low = left.lower()
        if begin:
            is_break, wrong = judge((left, hyphen, begin[1]), lexicon)
            if is_break:
                flaws.add((k + 1, "break"))
                joins[k] = ""
            else:
                joins[k] = "-"
            if wrong:
                early = wrong[1] < len(low)
                flaws.add(((k if early else following[k]) + 1, "misread"))
                fixes["join"].append((k, wrong[0]))
            skip_last.add(k)
            skip_first.add(following[k])
        elif not (hyphen and low in lexicon.left and low in lexicon.good):
            flaws.add((k + 1, "break"))
            skip_last.add(k)
    out_lines = {}
    for k in body:
        line = lines[k]
        is_table = line.lstrip().startswith("|")
        begin = _BEGIN.match(line) if k in skip_first else None
        cut = cut_word(line) if k in skip_last else None
        low, high = begin.end() if begin else 0, cut.start() if cut else len(line)
        if low > high:
            out_lines[k] = line
            continue

        def mend(m: re.Match, k: int = k, is_table: bool = is_table) -> str:
            token = m[0]
            core = token.strip("().,;:«»\"!")
            if not core or is_table and core == "|":
                return token
            if core == "|" or (len(core) > 1 and _BAD_NUMBER.fullmatch(core)):
                flaws.add((k + 1, "misread"))
                return token.replace(core, core.translate(str.maketrans("|бчзЗОо", "1643300")))
            for w in _WORD.finditer(token):
                word = w[0]
                if word.lower() in lexicon.good or not re.search("[а-яёa-z]", word) or re.search("[0-9].*[А-ЯЁA-Z]|[А-ЯЁA-Z]{2}.*[0-9]", word):
                    continue
                wrong = lexicon.misread(word)
                if wrong:
                    flaws.add((k + 1, "misread"))
                    fixed = wrong[0].capitalize() if word[:1].isupper() else wrong[0]
                    return token[: w.start()] + fixed + token[w.end() :]
            return token

        middle = line[low:high]
        fine = lexicon.fine
        strange = [t for t in middle.split() if t not in fine]
        if not is_table and "|" in strange or any(t != "|" for t in strange):
            before = len(flaws)
            middle = re.sub(r"\S+", mend, middle)
            if len(flaws) == before and (k + 1, "misread") not in flaws:
                if len(fine) > 1_000_000:
                    fine.clear()
                fine.update(t for t in strange if t != "|")
        out_lines[k] = line[:low] + middle + line[high:]
    if ended is not None:
        # the mark and the first part give way to the whole word
        out_lines[body[-1]] = re.sub(rf"[{MARKS}] ?$", "", out_lines[body[-1]].rstrip())
        out_lines[body[-1]] = out_lines[body[-1]][: -len(closing[0])] + (ended.capitalize() if closing[0][:1].isupper() else ended) + _token(next_[0].lstrip()[len(closing[2]) :])
    if opening and moved:
        rest = out_lines[body[0]].lstrip()[len(opening[2]) :]
        out_lines[body[0]] = rest[len(_token(rest)) :]
    mended = dict(fixes["join"])
    text_out, carry = [], ""
    for n, k in enumerate(body):
        line = out_lines[k].strip()
        if carry:
            line = carry + line
            carry = ""
        if k in joins:
            stem = re.sub(rf"[{MARKS}] ?$", "", line)
            nxt = following[k]
            if k in mended:
                stem = stem[: len(stem) - len(cut_word(lines[k])[1])]
                out_lines[nxt] = out_lines[nxt].lstrip()
                out_lines[nxt] = mended[k] + out_lines[nxt][len(_BEGIN.match(lines[nxt])[1]) :]
                carry = stem
            else:
                carry = stem + joins[k]
            continue
        nxt = following.get(k)
        blank = nxt is not None and any(not lines[x].strip() for x in range(k + 1, nxt))
        own = line.startswith("|") or (nxt is not None and lines[nxt].lstrip().startswith("|")) or _FORMULA.match(line)
        text_out.append(line + ("" if nxt is None else "\n\n" if blank and not states[k] == "break" else "\n" if own else " "))
    joined = "".join(text_out)
    return sorted(flaws), joined.lstrip() if opening else joined


def scanned_rows(spark, sf_dir: str) -> DataFrame:
    """``tab, row_id, page, first, last, text, from_ocr, doc_id`` of pages and chunks."""
    pages = table(spark, sf_dir, "page_docs").select(
        F.lit("page_docs").alias("tab"), F.col("page_id").alias("row_id"), F.lit(True).alias("page"), F.col("page_no").alias("first"), F.col("page_no").alias("last"), "text", "from_ocr", "doc_id"
    )
    chunks = table(spark, sf_dir, "chunks").select(
        F.lit("chunks").alias("tab"), F.col("chunk_id").alias("row_id"), F.lit(False).alias("page"), F.col("page_start").alias("first"), F.col("page_end").alias("last"), "text", "from_ocr", F.lit(None).cast("string").alias("doc_id")
    )
    return pages.unionByName(chunks)


def open_end_of(text: str) -> Column:
    """Whether a line near the end, before as many as may be furniture, ends with a mark."""
    return F.substring(F.col(text), -600, 600).rlike(rf"[{MARKS}][^\p{{L}}\p{{N}}\n]*(?:\n\s*[^\n]+){{0,3}}\s*\z")


def with_neighbours(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """Scanned rows with ``before, moved, after``: texts of the pages on either side, where a word may be cut between them.

    Texts move only for pages of which one of the last lines ends with a mark.  Of a
    page that comes twice the copy of the lowest id with a text (at its end, with a mark) is the neighbour.
    """
    none = scans.select("*", F.lit(None).cast("string").alias("before"), F.lit(True).alias("moved"), F.lit(None).cast("string").alias("after"))
    if "doc_id" not in rows.columns:
        return none
    pages = rows.where("page and text <> '' and doc_id is not null and first is not null")
    single = lambda df: df.groupBy("doc_id", "first").agg(F.min_by(F.struct("text", "from_ocr"), "row_id").alias("p"))
    ends = single(pages.where(open_end_of("text"))).select("doc_id", (F.col("first") + 1).alias("first"), F.col("p.text").alias("before"), F.col("p.from_ocr").alias("moved"))
    starts = single(pages).select("doc_id", (F.col("first") - 1).alias("first"), F.col("p.text").alias("after"))
    here = scans.where("page").join(ends, ["doc_id", "first"], "left").join(starts, ["doc_id", "first"], "left")
    here = here.withColumn("after", F.when(open_end_of("text"), F.col("after"))).withColumn("moved", F.coalesce("moved", F.lit(True)))
    return none.where("not page").unionByName(here.select(none.columns))


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words of a partition; parts of words at line ends are left out."""
    glued = re.compile(rf"[{MARKS}] ?\n\s*")
    word = re.compile(rf"(?<![{LETTERS}0-9@|>$?<\x01-])[{LETTERS}]+(?:-[{LETTERS}]+)*(?![{LETTERS}0-9@|>$?<\x01-])")
    counts: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update(word.findall(glued.sub("\x01", text.lower())))
        if len(counts) > 500_000:
            yield pd.DataFrame({"w": list(counts), "n": list(counts.values())})
            counts = Counter()
    if counts:
        yield pd.DataFrame({"w": list(counts), "n": list(counts.values())})


def read_scans(rows: DataFrame) -> DataFrame:
    """``tab, row_id, flaws, repaired`` of every row that comes from a scan.

    Rows without text give no flaw and a null or empty text; rows that repeat are
    each read.  Where ``rows`` has ``doc_id``, a word cut at the end of a page is read with
    its rest on the next page; where there is no next page, or none with text, the
    lexicon decides by the first part alone.
    """
    spark = rows.sparkSession
    counted = checkpointed(rows.where("text <> ''").select("text").mapInPandas(_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1"))
    least = max(2, LEXICON * (counted.agg(F.sum("n")).first()[0] or 0))
    lexicon = {r["w"]: r["n"] for r in counted.where(F.col("n") >= least).collect()}
    scans = rows.where("from_ocr and text <> ''")
    edges = checkpointed(scans.where("page").select("text").mapInPandas(_edges, "form long, edge long, inside long").groupBy("form").agg(F.sum("edge").alias("edge"), F.sum("inside").alias("inside")).where("edge >= 4"))
    least = max(4, FORMS * (edges.agg(F.sum("edge")).first()[0] or 0))
    forms = {r["form"]: "edge" if r["edge"] > 4 * r["inside"] else "mixed" for r in edges.where((F.col("edge") >= least) & (F.col("edge") >= F.col("inside"))).collect()}
    known = spark.sparkContext.broadcast(forms)

    def layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, first, last, text in batch.itertuples(index=False):
                span = tuple(None if pd.isna(x) else int(x) for x in (first, last))
                out.append(encoded(observe(plain_characters(text).split("\n"), known.value, *span, page)[1]))
            yield pd.DataFrame({"lines": out})

    lines = checkpointed(scans.select("page", "first", "last", "text").mapInPandas(layouts, "lines binary"))
    shared = spark.sparkContext.broadcast((LineModel().train_on(lines), Lexicon(lexicon)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, (model, lexicon) = known.value, shared.value
        for batch in batches:
            out = []
            for tab, row_id, page, first, last, text, before, moved, after in batch.itertuples(index=False):
                span = tuple(None if pd.isna(x) else int(x) for x in (first, last))
                flaws, repaired = read_lines(text, page, *span, forms, model, lexicon, before, after, moved)
                out.append((tab, row_id, [{"line_no": a, "flaw": b} for a, b in flaws], repaired))
            yield pd.DataFrame(out, columns=["tab", "row_id", "flaws", "repaired"])

    return with_neighbours(rows, scans).select("tab", "row_id", "page", "first", "last", "text", "before", "moved", "after").mapInPandas(
        run, "tab string, row_id long, flaws array<struct<line_no: int, flaw: string>>, repaired string"
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Flaws of the lines of scanned rows."""
    return read_scans(scanned_rows(spark, sf_dir)).select("tab", "row_id", F.explode("flaws").alias("f")).select("tab", "row_id", "f.line_no", "f.flaw")


def p1_repaired(spark, sf_dir: str) -> DataFrame:
    """Scanned rows as continuous paragraphs of whole words."""
    return read_scans(scanned_rows(spark, sf_dir)).select("tab", "row_id", "repaired")


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
ORACLES: dict[str, str] = {}
