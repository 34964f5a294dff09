"""Pictures of pages: ruled lines from pixels, skew, cells between rules; recognition is a port."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Half the window of the local threshold, and how much darker than its mean a pixel of ink is.
WINDOW, DARKER = 15, 10


def ink(gray: np.ndarray) -> np.ndarray:
    """Pixels darker than the mean around them, from sums over windows."""
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = np.cumsum(np.cumsum(gray.astype(float), axis=0), axis=1)
    y0, y1 = np.clip(np.arange(h) - WINDOW, 0, h), np.clip(np.arange(h) + WINDOW + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - WINDOW, 0, w), np.clip(np.arange(w) + WINDOW + 1, 0, w)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / area
    return gray < mean - DARKER


def runs(dark: np.ndarray, least: int) -> np.ndarray:
    """``row, begin, end`` of the horizontal runs of at least so many pixels."""
    edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    long = end - begin >= least
    return np.stack([row[long], begin[long], end[long]], axis=1)


def joined(spans: np.ndarray) -> list[tuple[float, int, int]]:
    """``middle row, begin, end`` of runs that touch, also across one row or column."""
    parent = list(range(len(spans)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_row: dict[int, list[int]] = {}
    for i, (row, begin, end) in enumerate(spans.tolist()):
        for above in range(row - 2, row + 1):
            for j in by_row.get(above, ()):
                if spans[j, 1] <= end + 2 and begin <= spans[j, 2] + 2:
                    parent[root(i)] = root(j)
        by_row.setdefault(row, []).append(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(spans)):
        groups.setdefault(root(i), []).append(i)
    return sorted(((spans[g, 0].min() + spans[g, 0].max()) / 2, int(spans[g, 1].min()), int(spans[g, 2].max())) for g in groups.values())


def rules_in(gray: np.ndarray, scale: float) -> list[tuple[float, float, float, float]]:
    """``x0, top, x1, bottom`` of the centre lines of ruled lines, in points of ``scale`` a pixel."""
    dark = ink(gray)
    h, w = dark.shape
    flat = [(a * scale, y * scale, b * scale, y * scale) for y, a, b in joined(runs(dark, max(20, w // 25)))]
    upright = [(x * scale, a * scale, x * scale, b * scale) for x, a, b in joined(runs(dark.T, max(20, h // 60)))]
    return flat + upright


def skew(gray: np.ndarray, most: float = 15.0, step: float = 0.1) -> float:
    """Degrees by which lines of the page climb: the shear whose row sums differ most; under 0.1 and over ``most`` count as none."""
    y, x = np.nonzero(ink(gray))
    if not len(y):
        return 0.0

    def sharp(angle: float) -> float:
        rows = np.round(y + x * np.tan(np.radians(angle))).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    coarse = max(np.arange(-most, most + 0.5, 0.5), key=lambda a: (sharp(a), -abs(a)))
    best = max(np.arange(coarse - 0.5, coarse + 0.5 + step / 2, step), key=lambda a: (sharp(a), -abs(a)))
    return round(float(best), 1) if step <= abs(best) <= most else 0.0


def cells_between(rules: list[tuple[float, float, float, float]], tolerance: float = 3.0) -> list[tuple[float, float, float, float]]:
    """The smallest boxes that rules enclose on all four sides."""
    flat = [r for r in rules if r[2] - r[0] >= r[3] - r[1]]
    upright = [r for r in rules if r[2] - r[0] < r[3] - r[1]]

    def distinct(values: list[float]) -> list[float]:
        out: list[float] = []
        for v in sorted(values):
            if not out or v - out[-1] > tolerance:
                out.append(v)
        return out

    ys, xs = distinct([r[1] for r in flat]), distinct([r[0] for r in upright])
    across = lambda y, a, b: any(abs(r[1] - y) <= tolerance and r[0] - tolerance <= a and b <= r[2] + tolerance for r in flat)
    along = lambda x, a, b: any(abs(r[0] - x) <= tolerance and r[1] - tolerance <= a and b <= r[3] + tolerance for r in upright)
    out = []
    for i, top in enumerate(ys):
        for j, x0 in enumerate(xs):
            box = next(((x1, bottom) for bottom in ys[i + 1 :] for x1 in xs[j + 1 :] if across(top, x0, x1) and across(bottom, x0, x1) and along(x0, top, bottom) and along(x1, top, bottom)), None)
            if box:
                out.append((x0, top, *box))
    return out


def page_rules(pages: DataFrame) -> DataFrame:
    """``id, rule, x0, top, x1, bottom`` of pictures ``id, pixels, width, height, scale`` (one byte a pixel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, pixels, width, height, scale in batch[["id", "pixels", "width", "height", "scale"]].itertuples(index=False):
                gray = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width)
                out += [(i, n, *r) for n, r in enumerate(rules_in(gray, scale), 1)]
            yield pd.DataFrame(out, columns=["id", "rule", "x0", "top", "x1", "bottom"])

    return pages.where("pixels is not null").mapInPandas(run, "id long, rule int, x0 double, top double, x1 double, bottom double")


#: What a recogniser gives for a picture: (block, par, line, word, text, confidence) for each word.
Recogniser = Callable[[bytes, int, int], list[tuple[int, int, int, int, str, float]]]


def recognise(pages: DataFrame, recogniser: Recogniser) -> DataFrame:
    """``id, block, par, line, word, text, conf`` of pictures; a page that fails gives no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, pixels, width, height in batch[["id", "pixels", "width", "height"]].itertuples(index=False):
                try:
                    out += [(i, *w) for w in recogniser(pixels, width, height)]
                except Exception:  # noqa: BLE001 - an unreadable page is an empty page
                    continue
            yield pd.DataFrame(out, columns=["id", "block", "par", "line", "word", "text", "conf"])

    return pages.where("pixels is not null").mapInPandas(run, "id long, block int, par int, line int, word int, text string, conf double")
