"""Vector codes and clusters: against brute force in Python's whole numbers, on odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import clustering, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, cluster int, n long, v array<int>, grp int, s0 long"
REST = ("x", 1, 2, 3, [4], 5, 6)


def odd_rows(width, seed):
    """Rows of few values, so that there are ties; repeated rows, null ids and labels, and rows that are dropped."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.51, -0.25, 0.0, 0.004, 0.3)) for _ in range(width)], rng.choice((0, 0, 0, 1, None)), *REST) for i in range(60)]
    rows += [rows[7], rows[7], (8, rows[9][1], None, *REST), (None, rows[3][1], 1, *REST), (None, rows[4][1], 1, *REST), (70, [1e300] + [0.0] * (width - 1), 2, *REST), (-5, [-1e300] * width, 2, *REST)]
    bad = [(1, None, 1), (2, [], 1), (3, [0.0] * (width - 1), 1), (4, [None] + [0.0] * (width - 1), 1), (5, [math.nan] * width, 1), (6, [math.inf] * width, 1), (-9, [0.0] * (width + 1), None)]
    rows += [(*x, *REST) for x in bad]
    rng.shuffle(rows)
    return rows


def kept(rows, width, scale):
    top = vectors.bound(width)
    fits = [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [max(-top, min(top, math.floor(scale * x))) if abs(x) < 1e200 else int(math.copysign(top, x)) for x in r[1]], r[2]) for r in fits]


def near(x, centres):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres))


def moved(points, centres):
    at = [near(x, centres)[1] for x in points]
    out = []
    for i, c in enumerate(centres):
        own = [x for x, j in zip(points, at) if j == i]
        out.append([sum(col) // len(own) for col in zip(*own)] if own else c)
    return out


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


@pytest.mark.parametrize(("entries", "seed"), [(5, 1), (256, 2)])
def test_vector_codes_by_brute_force(spark, entries, seed):
    rows = odd_rows(8, seed)
    points = sorted(kept(rows, 8, 1024), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[x[2 * p : 2 * p + 2] for _, x, _ in points[:entries]] for p in range(4)]
    for _ in range(3):
        books = [moved([x[2 * p : 2 * p + 2] for _, x, _ in points], books[p]) for p in range(4)]
    want = []
    for i, x, label in points:
        d = [near(x[2 * p : 2 * p + 2], books[p]) for p in range(4)]
        want.append((i, label, "".join(f"{j:02x}" for _, j in d), sum(e for e, _ in d)))
    of = {label: sum(e for _, la, _, e in want if la == label) for _, label, _, _ in want}
    every = digest(z for book in books for entry in book for z in entry)
    df = spark.createDataFrame(rows, SCHEMA)
    assert vector_codes.usual_width(df, 4) == 8 and vector_codes.usual_width(df.limit(0), 4) == 4
    got = vector_codes.vector_codes(df, entries=entries, rounds=3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*w, of[w[1]] if of[w[1]] < 2**63 else None, every)) for w in want)


@pytest.mark.parametrize(("centroids", "segment", "seed"), [(4, 2, 1), (16, 4, 2), (300, 8, 3)])
def test_clusters_by_brute_force(spark, centroids, segment, seed):
    rows = odd_rows(8, seed)
    points = sorted(kept(rows, 8, 64), key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [x for _, x, _ in points[:centroids]]
    for _ in range(3):
        centres = moved([x for _, x, _ in points], centres)
    want = [(i, *near(x, centres)[::-1]) for i, x, _ in points]
    total = sum(d for _, _, d in want)
    of = {c: sum(d for _, e, d in want if e == c) for _, c, _ in want}
    fits = lambda n: n if n < 2**63 else None
    got = clustering.clusters(spark.createDataFrame(rows, SCHEMA), 8, centroids, segment=segment).drop("computed")
    got = got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, c, d, fits(of[c]), fits(total), digest(centres[c]))) for i, c, d in want)


def test_no_rows(spark):
    for rows in ([], [(1, None, 1, *REST)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert vector_codes.vector_codes(df, 8).count() == 0 and clustering.clusters(df, 8).count() == 0


@pytest.mark.parametrize("top", [3, 40, vectors.bound(64)])
def test_screening_loses_no_centre(top):
    """The bound is at most the distance, for small and for the largest components; on data in groups most are screened out."""
    rng = np.random.default_rng(top)
    centres = rng.integers(-top, top + 1, (16, 64))
    x = np.clip(centres[rng.integers(0, 16, 500)] + rng.integers(-(top // 8) - 1, top // 8 + 2, (500, 64)), -top, top)
    held = clustering.compressed(x, 8)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in centres] for p in x]
    least = clustering.least_distances(held, centres, 8)
    assert all(int(lo) <= d for los, ds in zip(least.tolist(), exact) for lo, d in zip(los, ds))
    at, d, computed = clustering.nearest(x, held, centres, 8)
    assert [(e, i) for e, i in zip(d.tolist(), at.tolist())] == [min((e, i) for i, e in enumerate(es)) for es in exact]
    assert computed.min() >= 1 and (top < 40 or computed.mean() < 4)


def test_roots_are_rounded_up():
    x = np.array([0, 1, 2, 3, 4, 5, 2**53 + 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 + 1, 2**62 - 1], np.int64)
    assert clustering.roots(x).tolist() == [math.isqrt(v) + (math.isqrt(v) ** 2 < v) for v in x.tolist()]
