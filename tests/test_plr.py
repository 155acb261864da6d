import random
import tracemalloc

import pytest

from keystrand.functions import plr
from keystrand.functions.plr import OptimalFit, fit_runs
from keystrand.operators import layout


def slopes(points, delta):
    """The steepest and the flattest line within ``delta`` of the points, by all pairs."""
    pairs = [(a, b) for i, a in enumerate(points) for b in points[i + 1 :]]
    return min((b[1] + delta - (a[1] - delta)) / (b[0] - a[0]) for a, b in pairs), max((b[1] - delta - (a[1] + delta)) / (b[0] - a[0]) for a, b in pairs)


def test_optimal_fit_against_all_pairs():
    rng = random.Random(7)
    for case in range(60):
        xs = sorted(rng.sample(range(400), 40))
        points = [(float(x), float(i) if case % 2 else x * x / 50) for i, x in enumerate(xs)]
        at = 0
        while at < len(points):
            fit, end = OptimalFit(2.0), at
            while end < len(points) and fit.offer(*points[end]):
                end += 1
            if end - at > 1:
                assert (fit.steep[1], fit.flat[1]) == slopes(points[at:end], 2.0)
            if end < len(points) and end - at > 1:
                steep, flat = slopes(points[at : end + 1], 2.0)
                assert steep < flat  # no line holds one point more
            at = end


def test_optimal_fit_passes_each_hull_point_once():
    class Counted(float):
        n = 0

        def __sub__(self, other):
            Counted.n += 1
            return float.__sub__(self, other)

    fit, n = OptimalFit(10.0), 0
    for k in range(1, 60_000):
        if not fit.offer(Counted(k * 7 + k * k // 500), float(k)):
            fit = OptimalFit(10.0)
        n += 1
    assert Counted.n < 40 * n


@pytest.mark.parametrize("method", ["greedy", "optimal"])
def test_runs_on_a_curve_hold(method):
    points = [(k * 7 + k * k // 500, float(k)) for k in range(1, 20_000)]
    runs = list(fit_runs(points, 10.0, method))
    assert sum(r.count for r in runs) == len(points) and len(runs) > 1 and max(r.worst for r in runs) <= 10 + 1e-6


@pytest.mark.parametrize("method", ["greedy", "optimal"])
def test_a_long_run_is_not_held_in_memory(method, monkeypatch):
    monkeypatch.setattr(plr, "HELD_BYTES", 1 << 16)
    tracemalloc.start()
    (run,) = fit_runs(((float(k * 40 + k % 13 * 3), float(k)) for k in range(100_000)), 10.0, method)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert run.count == 100_000 and peak < 6 << 20
    assert run.worst == max(abs(run.line(float(k * 40 + k % 13 * 3)) - k) for k in range(100_000))


@pytest.mark.parametrize("method", ["greedy", "optimal"])
def test_runs_of_a_table_are_those_of_one_list(spark, method):
    points = [(k * 7 + k * k // 50, float(k)) for k in range(1, 12_000)]
    rows = random.Random(3).sample(points, len(points))
    got = layout.plr_runs(spark.createDataFrame(rows, "x long, y double").repartition(7), 10.0, method).orderBy("start_x").collect()
    assert [tuple(r) for r in got] == [(r.base, r.count, r.line.slope, r.line.intercept, r.worst) for r in fit_runs(points, 10.0, method)]
    assert layout.plr_runs(spark.createDataFrame([], "x long, y double"), 10.0, method).count() == 0
