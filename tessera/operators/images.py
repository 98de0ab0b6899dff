"""Page images as grey arrays: ink, straightening, columns and reading order (IMG1-4). Arrays are rows by columns, 0 is black.

Used inside Arrow functions over decoded pages (see sources.documents.image_frames); models that read regions are injected (IMG5).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Thresholds of the page layout, as shares of the page where they are below 1.
INK, MAX_ANGLE, ANGLE_STEP, MIN_ANGLE = 128, 3.0, 0.25, 0.3
HEADER_ZONE, SEGMENT, SOLID = 0.15, 25, 0.6
ZONE, PROBE, INK_RATIO, MIN_WIDTH, RULE_WIDTH, CLEARANCE = (0.3, 0.7), 0.75, 0.25, 0.004, 0.01, 0.004
SPAN_HEIGHT, MERGE_GAP, BLANK_INK = 0.004, 0.02, 0.002
LONG_SIDE, MOST_UPSCALE = 3000, 3.0


def ink(grey: np.ndarray) -> np.ndarray:
    """IMG1: which pixels are ink."""
    return grey < INK


def ink_share(grey: np.ndarray) -> float:
    return float(ink(grey).mean()) if grey.size else 0.0


def rotated(grey: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Rotation about the centre, nearest pixel, same size; positive turns counter-clockwise."""
    h, w = grey.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sx, sy = np.rint(np.cos(a) * x - np.sin(a) * y + (w - 1) / 2).astype(int), np.rint(np.sin(a) * x + np.cos(a) * y + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(grey, fill)
    out[inside] = grey[sy[inside], sx[inside]]
    return out


def resized(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixel."""
    h, w = grey.shape
    return grey[(np.arange(height) * h // height)[:, None], (np.arange(width) * w // width)[None, :]]


def skew(grey: np.ndarray) -> float:
    """IMG2: the angle whose rows of ink differ most; the smaller of equals."""
    small = resized(grey, 600, max(1, round(600 * grey.shape[0] / grey.shape[1])))
    n = int(MAX_ANGLE / ANGLE_STEP)
    sharp = {a: float(((r := ink(rotated(small, a)).mean(1)) - r.mean()).__pow__(2).sum()) for a in (i * ANGLE_STEP for i in range(-n, n + 1))}
    return max(sharp, key=lambda a: (round(sharp[a], 12), -abs(a)))


def deskewed(grey: np.ndarray) -> np.ndarray:
    a = skew(grey)
    return rotated(grey, a) if abs(a) >= MIN_ANGLE else grey


def header_end(mask: np.ndarray) -> int:
    """IMG3: the row below the header's rule; 0 without one."""
    zone = mask[: int(mask.shape[0] * HEADER_ZONE)]
    if not zone.size:
        return 0
    thick = np.logical_or.reduce([np.roll(zone, d, 0) for d in range(-3, 4)])
    n = max(1, zone.shape[1] // SEGMENT)
    edges = np.linspace(0, zone.shape[1], n + 1).astype(int)
    filled = np.add.reduceat(thick, edges[:-1], axis=1) / np.diff(edges) > 245 / 255
    rows = np.flatnonzero(filled.mean(1) >= SOLID)
    return int(rows[-1]) + 1 if len(rows) else 0


def _strips(flags: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """(first, last) of stretches of true places; stretches at most `gap` apart are one."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > gap)
    return list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), at[np.concatenate([cuts, [len(at) - 1]])].tolist()))


def gutter(profile: np.ndarray) -> tuple[int, int] | None:
    """IMG3: the blank strip between two columns of text."""
    w = len(profile)
    body = np.sort(profile[int(w * 0.1) : int(w * 0.9)])
    if not len(body) or body[len(body) // 2] <= 0:
        return None
    limit = max(0.003, float(body[len(body) // 2]) * INK_RATIO)
    lo, hi = int(w * ZONE[0]), int(w * ZONE[1])
    strips = _strips(profile[lo:hi] < limit, max(2, int(w * RULE_WIDTH)))
    if not strips:
        return None
    a, b = max(strips, key=lambda s: s[1] - s[0])
    a, b = a + lo, b + lo
    sides = [profile[:a].mean() if a else 0.0, profile[b + 1 :].mean() if b + 1 < w else 0.0]
    return (a, b) if b - a >= w * MIN_WIDTH and min(sides) >= limit else None


def bands(mask: np.ndarray, profile: np.ndarray, strip: tuple[int, int]) -> list[tuple[int, int, bool]]:
    """IMG3: (top, bottom, whole width) from top to bottom: columns, and blocks of text that cross the strip."""
    a, b = strip
    h, w = mask.shape
    x = np.arange(a, b + 1)
    clean = profile[a : b + 1] <= profile[a : b + 1].min() + 0.002
    rule = x[~clean]
    away = max(3, int(w * CLEARANCE))
    far = np.array([c for c in x[clean] if not len(rule) or np.abs(rule - c).min() > away], int)
    at = far if len(far) else x[clean]
    left, right = at[at < (a + b) / 2], at[at >= (a + b) / 2]
    crossing = np.minimum(mask[:, left].sum(1), mask[:, right].sum(1)) >= 2
    gap = int(h * MERGE_GAP)
    out, top = [], 0
    for y0, y1 in _strips(crossing, gap):
        if y1 - y0 < h * SPAN_HEIGHT:
            continue
        y0, y1 = max(top, y0 - gap // 2), min(h, y1 + gap // 2)
        out += [(top, y0, False), (y0, y1, True)]
        top = y1
    out.append((top, h, False))
    return [x for x in out if x[1] > x[0]]


def regions(grey: np.ndarray) -> list[np.ndarray]:
    """IMG3: a page's columns and whole-width blocks in reading order, the right column first; no running header."""
    grey = deskewed(grey)
    grey = grey[header_end(ink(grey)) :]
    mask = ink(grey)
    profile = mask[: int(grey.shape[0] * PROBE)].mean(0)
    strip = gutter(profile)
    if strip is None:
        return [grey]
    middle = (strip[0] + strip[1]) // 2
    out = []
    for top, bottom, whole in bands(mask, profile, strip):
        out += [grey[top:bottom]] if whole else [grey[top:bottom, middle:], grey[top:bottom, :middle]]
    return out


def prepared(grey: np.ndarray) -> np.ndarray:
    """IMG4: small scans enlarged, the darkest and lightest hundredth spread to black and white."""
    scale = min(MOST_UPSCALE, LONG_SIDE / max(grey.shape))
    if scale > 1.1:
        grey = resized(grey, round(grey.shape[1] * scale), round(grey.shape[0] * scale))
    lo, hi = np.percentile(grey, (1, 99))
    return grey if hi <= lo else np.clip((grey.astype(float) - lo) * 255 / (hi - lo), 0, 255).astype(np.uint8)


@dataclass
class Page:
    text: str
    cost: float = 0.0
    fallback: bool = False
    disputed: bool = False


def read_page(grey: np.ndarray, readers: list[Callable[[np.ndarray], tuple[str, float]]], fallback: Callable[[np.ndarray], str] | None = None) -> Page:
    """IMG5/AGG15: two readers, a third if they disagree; a plain reader where none answers; blank regions are skipped."""
    from tessera.operators.readings import measured, settled, words_of

    agree = lambda got: len(got) > 1 and measured(*(words_of(t) for t, _ in got[:2]))[3]
    done = []
    for region in (r for r in regions(grey) if ink_share(r) > BLANK_INK):
        got: list[tuple[str, float]] = []
        for i, read in enumerate(readers[:3]):
            if i == 2 and (len(got) < 2 or agree(got)):
                break
            try:
                got.append(read(region))
            except OSError:
                continue
        cost = sum(c for _, c in got)
        if not got:
            if fallback is None:
                raise OSError("no reader could read the page")
            done.append(Page(fallback(region), cost, fallback=True))
        elif len(got) > 1 and not agree(got):
            text, disputed = settled([t for t, _ in got])
            done.append(Page(text, cost, disputed=disputed))
        else:
            done.append(Page(got[0][0], cost))
    return Page("\n\n".join(p.text for p in done if p.text), sum(p.cost for p in done), any(p.fallback for p in done), any(p.disputed for p in done))


# --- tables of page images ---------------------------------------------------------------------------------------------

_REGIONS = "path string, frame int, region int, width int, height int, ink double, skew double"
_PAGES = "path string, frame int, text string, cost double, fallback boolean, disputed boolean, error string"


def page_regions(files: DataFrame) -> DataFrame:
    """IMG1-3, SRC7: one row per region of each frame, in reading order. files: path, content."""
    from tessera.sources.documents import image_frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                for n, frame in enumerate(image_frames(bytes(data))):
                    rows += [(path, n, i, r.shape[1], r.shape[0], ink_share(r), skew(frame)) for i, r in enumerate(regions(frame))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REGIONS.split(", ")])

    return files.select("path", "content").mapInPandas(run, _REGIONS)


def read_pages(files: DataFrame, readers: list[Callable[[np.ndarray], tuple[str, float]]], fallback: Callable[[np.ndarray], str] | None = None) -> DataFrame:
    """IMG4-5, AGG15: one row per frame, read by the readers given (prepared for the plain one); a page that none can read is a row with an error."""
    from tessera.sources.documents import image_frames

    plain = (lambda region: fallback(prepared(region))) if fallback else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                for n, frame in enumerate(image_frames(bytes(data))):
                    try:
                        p = read_page(frame, readers, plain)
                        rows.append((path, n, p.text, p.cost, p.fallback, p.disputed, None))
                    except OSError as e:
                        rows.append((path, n, None, 0.0, False, False, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, _PAGES)
