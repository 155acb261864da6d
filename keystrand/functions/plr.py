"""Error-bounded piecewise linear functions over sorted points, and segments of pages built on them.

Plain Python on one sorted run of keys; Spark calls it per key range.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched
from math import fma

import numpy as np

#: Pages that a segment may have, and the widest key span that a double holds exactly.
SEGMENT_PAGES = (1, 2, 4, 8, 16)
MAX_SPAN = 2**53
#: Points of a run read at once, and bytes of a run that stay in memory before the rest goes to a local file.
READ_POINTS = 1 << 16
HELD_BYTES = 16 << 20


@dataclass(frozen=True)
class Line:
    slope: float
    intercept: float

    def __call__(self, x: float) -> float:
        return fma(self.slope, x, self.intercept)

    def scaled(self, by: float) -> Line:
        return Line(self.slope / by, self.intercept / by)


class GreedyFit:
    """One-pass fit within ``delta``: a cone of admissible slopes through a fixed apex narrows point by point."""

    def __init__(self, delta: float):
        self.delta, self.first, self.apex = delta, None, None
        self.low = self.high = 0.0

    def offer(self, x: float, y: float) -> bool:
        d = self.delta
        if self.first is None:
            self.first = (x, y)
            return True
        if self.apex is None:
            x0, y0 = self.first
            width = x - x0
            self.low, self.high = ((y - d) - (y0 + d)) / width, ((y + d) - (y0 - d)) / width
            # the two extreme lines cross half way
            if self.high > self.low:
                cross = x0 + 2 * d / (self.high - self.low)
                self.apex = (cross, fma(self.low, cross - x0, y0 + d))
            else:
                self.apex = (x0, y0)
            return True
        dx, dy = x - self.apex[0], y - self.apex[1]
        if fma(self.low, dx, -d) > dy or fma(self.high, dx, d) < dy:
            return False
        if dx > 0:
            self.low, self.high = max(self.low, (dy - d) / dx), min(self.high, (dy + d) / dx)
        return True

    def line(self) -> Line:
        if self.apex is None:
            return Line(0.0, self.first[1] if self.first else 0.0)
        slope = (self.low + self.high) / 2
        return Line(slope, fma(-slope, self.apex[0], self.apex[1]))


class Hull:
    """One side of the convex hull of points that come by ``x``, from the last support of a tangent on.

    ``sign`` 1 keeps the lower side, -1 the upper one.  A narrower tangent never rests on a point before
    the last support, so those are left behind, and all searches together pass each point once.
    """

    __slots__ = ("sign", "points", "start")

    def __init__(self, sign: int, first: tuple[float, float]):
        self.sign, self.points, self.start = sign, [first], 0

    def push(self, p: tuple[float, float]) -> None:
        points, least, (px, py) = self.points, self.start + 1, p
        while len(points) > least:
            (ax, ay), (bx, by) = points[-2], points[-1]
            if self.sign * ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) > 0:
                break
            points.pop()
        points.append(p)

    def tangent(self, p: tuple[float, float]) -> tuple[tuple[float, float], float]:
        """The point that the line to ``p`` rests on, and that line's slope: the least from an upper side, the greatest from a lower one."""
        points, sign, (px, py) = self.points, self.sign, p
        best, at = None, self.start
        for i in range(self.start, len(points)):
            x, y = points[i]
            slope = (py - y) / (px - x)
            # along the hull slopes change for the better, then for the worse
            if best is None or sign * slope > sign * best:
                best, at = slope, i
            elif slope != best:
                break
        found, self.start = points[at], at
        if at > 1024 and 2 * at > len(points):
            del points[:at]
            self.start = 0
        return found, best


class OptimalFit:
    """Longest feasible segments (O'Rourke's on-line algorithm on two convex hulls).

    A line within ``delta`` of all points must pass under every ``(x, y + delta)`` and over every
    ``(x, y - delta)``.  The hulls of both point sets give the steepest and the flattest such line.
    """

    def __init__(self, delta: float):
        self.delta = delta
        self.tops: Hull | None = None  # lower hull of the tops
        self.bottoms: Hull | None = None  # upper hull of the bottoms
        self.flat = self.steep = None  # (point, slope)

    def offer(self, x: float, y: float) -> bool:
        top, bottom = (x, y + self.delta), (x, y - self.delta)
        if self.tops is None:
            self.tops, self.bottoms = Hull(1, top), Hull(-1, bottom)
            return True
        if self.flat is None:
            self.steep, self.flat = self.bottoms.tangent(top), self.tops.tangent(bottom)
        else:
            (px, py), s = self.flat
            (qx, qy), t = self.steep
            low, high = fma(s, x - px, py), fma(t, x - qx, qy)
            if low > top[1] or high < bottom[1]:
                return False
            # steepest line: from an earlier bottom up to a top; flattest: from an earlier top down to a bottom
            # a point that narrows nothing holds no later line
            if high > top[1]:
                if (found := self.bottoms.tangent(top))[1] < t:
                    self.steep = found
            else:
                top = None
            if low < bottom[1]:
                if (found := self.tops.tangent(bottom))[1] > s:
                    self.flat = found
            else:
                bottom = None
        if top:
            self.tops.push(top)
        if bottom:
            self.bottoms.push(bottom)
        return True

    def line(self) -> Line:
        if self.flat is None:
            return Line(0.0, self.tops.points[0][1] - self.delta if self.tops else 0.0)
        (px, py), s = self.flat
        (qx, qy), t = self.steep
        if t - s > 1e-18:
            x = ((qy - t * qx) - (py - s * px)) / (s - t)
            y = fma(s, x - px, py)
            slope = (s + t) / 2
            return Line(slope, fma(-slope, x, y))
        return Line(s, (fma(-s, px, py) + fma(-s, qx, qy)) / 2)


FITS = {"greedy": GreedyFit, "optimal": OptimalFit}


@dataclass
class FitRun:
    """A maximal run of points from ``base``, its first ``x``, and its line."""

    start: int
    count: int
    line: Line
    worst: float = 0.0
    base: float = 0


class _HeldRun:
    """The points of one run, as doubles; a long run goes to a local file."""

    def __init__(self):
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file = tempfile.SpooledTemporaryFile(HELD_BYTES, dir=local if os.path.isdir(local) else None)
        self.count = 0

    def add(self, xs: list[float], ys: list[float]) -> None:
        self.file.write(np.column_stack([xs, ys]).tobytes())
        self.count += len(xs)

    def worst(self, line: Line) -> float:
        """The greatest distance of a point from the line.

        Plain products find the points that come near it, within what rounding can do; they are
        compared by the line's own fused value.
        """
        found = 0.0
        self.file.seek(0)
        while data := self.file.read(16 * READ_POINTS):
            xs, ys = np.frombuffer(data).reshape(-1, 2).T
            product = line.slope * xs
            off = np.abs(product + line.intercept - ys)
            slack = 2.0**-48 * (np.abs(product).max() + abs(line.intercept) + np.abs(ys).max())
            near = ~(off < off.max() - slack)
            found = max(found, max(abs(line(x) - y) for x, y in zip(xs[near].tolist(), ys[near].tolist(), strict=True)))
        return found

    def clear(self) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.count = 0


def fit_blocks(blocks: Iterable[tuple[list, list[float]]], delta: float, method: str = "greedy") -> Iterator[FitRun]:
    """Cuts sorted points, which come as blocks of ``x`` and ``y``, into runs that one line holds within ``delta``.

    ``x`` counts from the run's first point.  Memory holds a block and the state of the fit; the points of the
    open run are kept for its worst error, in a local file where they are many.
    """
    fit, start, base, held = None, 0, None, _HeldRun()

    def close() -> FitRun:
        line = fit.line()
        return FitRun(start, held.count, line, held.worst(line), base)

    for xs, ys in blocks:
        at, n = 0, len(xs)
        while at < n:
            if fit is None:
                fit, base = FITS[method](delta), xs[at]
            first, offsets, offer = at, [], fit.offer
            for at in range(first, n):
                x = float(xs[at] - base)
                if not offer(x, ys[at]):
                    break
                offsets.append(x)
            else:
                at = n
            held.add(offsets, ys[first:at])
            if at < n:
                yield close()
                start, fit = start + held.count, None
                held.clear()
    if fit is not None:
        yield close()


def fit_runs(points: Iterable[tuple[float, float]], delta: float, method: str = "greedy") -> Iterator[FitRun]:
    """``fit_blocks`` on single points."""
    return fit_blocks((tuple(map(list, zip(*block, strict=True))) for block in batched(points, 1024)), delta, method)


@dataclass
class Segment:
    base: int
    pages: int
    line: Line | None
    keys: list[int] = field(default_factory=list)


def build_segments(keys: Iterable[int], goal: float, epsilon: float, method: str = "optimal") -> Iterator[Segment]:
    """Groups sorted keys into segments of 1, 2, 4, 8 or 16 pages of about ``goal`` records.

    A run of keys grows while one line holds the record index within ``epsilon`` records, up to the
    records that the largest segment may have.  Where it stops, the largest allowed number of pages
    that the line's value at the last key fills decides the cut; what is left over starts the next
    run.  A run that fills no more than a page becomes one page of ``goal`` records without a model.
    The model's value divided by ``goal`` is the page of a key.
    """
    most = int((goal + epsilon) * SEGMENT_PAGES[-1])
    source, ended = iter(keys), False
    held: list[int] = []
    one_page = max(1, int(goal))
    while True:
        # grow a run from what is held, then from the source
        fit, used, waiting = FITS[method](epsilon), 0, held
        held = []
        queue = iter(waiting)
        rest: list[int] = []
        while True:
            key = next(queue, None)
            if key is None:
                key = next(source, None)
                if key is None:
                    ended = True
                    break
            base = held[0] if held else key
            if held and (used >= most or key - base > MAX_SPAN or not fit.offer(float(key - base), float(used))):
                rest = [key, *queue]
                break
            if not held:
                fit.offer(0.0, 0.0)
            held.append(key)
            used += 1
        if not held:
            return
        line = fit.line()
        filled = 1 + max(0.0, line(float(held[-1] - held[0])))
        fits = [p for p in SEGMENT_PAGES if p * goal <= filled]
        pages = fits[-1] if fits else 1
        if pages == 1:
            while len(held) < one_page and rest:
                held.append(rest.pop(0))
            while len(held) < one_page and (key := next(source, None)) is not None:
                held.append(key)
            cut, model = min(one_page, len(held)), None
        else:
            cut = next((i for i, k in enumerate(held) if line(float(k - held[0])) >= pages * goal), len(held))
            model = line.scaled(goal)
        yield Segment(held[0], pages, model, held[:cut])
        held = held[cut:] + rest
        if ended and not held:
            return


def page_of(line: Line | None, pages: int, base: int, key: int) -> int:
    if line is None:
        return 0
    return min(pages - 1, max(0, int(line(float(key - base)))))


def page_lower_bounds(segment: Segment, upper: int) -> list[int]:
    """Smallest key of each page: bisection on the key domain, so that only integers are compared later."""
    bounds = [segment.base]
    for page in range(1, segment.pages):
        low, high = bounds[-1], upper
        while low < high:
            mid = (low + high) // 2
            if page_of(segment.line, segment.pages, segment.base, mid) >= page:
                high = mid
            else:
                low = mid + 1
        bounds.append(low)
    return bounds
