"""The source mix: against a sequential version, over odd rows, at any size of bucket."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from quire.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, rank int, key string, bucket int, room long, more long, source_size long, target int, pieces int"


def odd_rows(seed=4):
    rng = random.Random(seed)
    words = lambda n: " \t".join(["w　x\x1c"] * n)  # noqa: E731  a word holds any space but six
    rows = [(i, words(rng.choice((1, 2, 3, 5, 8, 400 if i % 40 == 0 else 4))), rng.choice(("hot", "hot", "hot", "b", "é", "\U0001f600", None))) for i in range(300)]
    rows += [(500, None, "hot"), (501, "", "b"), (502, " \n", None), (503, None, "only nothing"), (504, words(3000), "one long"), (None, words(6), "hot"), (None, words(6), "hot"), (None, words(2), None), (7, words(4), "hot"), (7, words(4), "hot"), (600, words(9), "zz"), (601, words(1), "a")]
    rows += rows[5:8]
    return [(*r, 1, 2, "k", 3, 4, 5, 6, 7, 8) for r in rows]


def slow(rows):
    """Per row doc_id, source, size, source_size, target, copies; words, times and thresholds one by one."""
    docs = [(r[0], r[2], len(re.findall(mixing.WORD, r[1] or ""))) for r in rows]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for _, t, n in docs if t == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(own.values()), set()
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(3 * own[s] for s in full)
        target = {s: Fraction(3 * own[s]) if s in full else Fraction(weight[s] * rest, sum(weight[t] for t in left)) for s in names}
        over = {s for s in left if target[s] > 3 * own[s]}
        if not over:
            break
        full |= over
    copies = {}
    for s in names:
        groups = defaultdict(int)
        for i, t, n in docs:
            if t == s and n:
                groups[(hashlib.md5(str(i).encode()).hexdigest() if i is not None else "~", n, i)] += 1
        rounds = min(3, target[s] // own[s]) if own[s] else 0
        room, times = int(target[s]) - rounds * own[s], dict.fromkeys(groups, 0)
        for i in range(mixing.PASSES + mixing.SPARE):
            most, got = room, 0
            for g in sorted(groups):
                if times[g] < (1 if i < mixing.PASSES else 3 - rounds) and g[1] <= most:
                    if got + g[1] * groups[g] > most:
                        break
                    got += g[1] * groups[g]
                    times[g] += 1
            room -= got
        near = [(abs(g[1] * groups[g] - room), g) for g in sorted(groups) if times[g] < 3 - rounds and g[1] * groups[g] < 2 * room]
        if near:
            times[min(near)[1]] += 1
        for g in groups:
            copies[(g[2], s, g[1])] = rounds + times[g]
    return sorted(repr((i, s, n, own[s], f"{float(target[s]):.9g}", copies.get((i, s, n), 0))) for i, s, n in docs)


@pytest.mark.parametrize("bucket_rows", [2, 1 << 20])
def test_mix_by_brute_force(spark, bucket_rows):
    rows = odd_rows()
    got = mixing.curriculum(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket_rows=bucket_rows).collect()
    assert sorted(repr((r.doc_id, r.source, r["size"], r.source_size, f"{r.target:.9g}", r["copies"])) for r in got) == slow(rows)
    assert all(r.taken == r["copies"] * r["size"] and len(r.positions) == r["copies"] and r["copies"] <= 3 for r in got)
    words = defaultdict(int)
    for r in got:
        words[(r.source, r.target)] += r.taken
    assert sum(words.values()) > 0 and all(abs(n - t) <= 3 for (s, t), n in words.items() if s in ("hot", "b", "é", None))


def test_no_rows_and_rows_without_words(spark):
    assert mixing.curriculum(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.curriculum(spark.createDataFrame([r for r in odd_rows() if not (r[1] or "").strip()], SCHEMA)).collect()
    assert {(r.source, r.target, r.taken) for r in got} == {("hot", 0.0, 0), ("b", 0.0, 0), (None, 0.0, 0), ("only nothing", 0.0, 0)}


def test_places_follow_the_schedules(spark):
    """A copy stands where the integral of its source's schedule reaches the words before it; all copies in order make the run."""
    from pyspark.sql import functions as F

    knots = {1: [(0.0, 0.0), (0.25, 4.0), (1.0, 0.0)], 2: [(0.0, 1.0), (1.0, 1.0)]}

    def schedule(rank):
        made = lambda k: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in k])
        return F.when(rank == 1, made(knots[1])).otherwise(made(knots[2]))

    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i % 4 else "b") for i in range(200)], "doc_id long, text string, source string")
    mixed = mixing.stored(mixing.curriculum(docs, schedule), "mixed")
    order = mixing.training_order(mixed)
    placed = [tuple(r) for part in order.rdd.glom().collect() for r in part]
    assert [r[4] for r in placed] == sorted(r[4] for r in placed) and len(placed) == sum(r["copies"] for r in mixed.collect())
    for i, (source, k) in enumerate((("a", knots[1]), ("b", knots[2]))):
        own = [r for r in placed if r[1] == source]
        total = sum(r[2] for r in own)
        area = lambda t: sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(k, k[1:]) if t > a[0])  # noqa: E731,B023
        before = 0
        for r in own:
            assert abs(area(r[4]) / area(1.0) * total - before) < 1e-6 * total, (source, r)
            before += r[2]
