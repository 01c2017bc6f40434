"""Columns with clashing names, threads, recall at every item length, a null host, and quotes in given conversations."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quire.llm import common, decontaminate, near_dedup, quality_rules, quotations, secrets
from quire.llm.queries import QUERIES

ITEM = " ".join(f"k{i}" for i in range(30))


@pytest.mark.parametrize("few", [0, 100_000])
def test_columns_of_any_name_stay(spark, few, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    own = lambda i: " ".join(f"u{i}v{j}" for j in range(14))
    names = ["__t", "__u", "__id", "__gone", "__kept", "__t_", "host", "t", "u", "key", "v", "h", "pos", "component_id", "kept", "words", "n"]
    rows = [(i, own(i), "s" if i % 2 else None, len(own(i)), *[f"{n}{i}" for n in names]) for i in range(6)] + [(9, f"{own(7)} {ITEM}", None, len(f"{own(7)} {ITEM}"), *names), (None, own(0), None, len(own(0)), *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    plain = sorted(map(repr, rows))
    for stage, lost in ((quality_rules.stage_quality_rules, 0), (near_dedup.stage_near_dedup, 0), (decontaminate.stage_decontaminate, 1), (secrets.stage_secret_scan, 0))[: 1 if few else None]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, stage
        got = sorted(repr(tuple(r)) for r in out.collect())
        assert set(got) <= set(plain) and len(got) == len(plain) - lost, stage
        assert few or stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_two_threads_keep_their_own_folders(spark):
    """Each finished() deletes what its own thread wrote, while the other's is still read."""
    began, out = threading.Barrier(2), {}

    def work(k):
        def make():
            held = common.stored(spark.range(k), "t")
            began.wait(60)
            if k == 7:
                common.finished(spark, lambda: common.stored(spark.range(2), "inner"), "inner")
            began.wait(60)
            return held

        out[k] = common.finished(spark, make, "out").count()

    threads = [threading.Thread(target=work, args=(k,)) for k in (7, 11)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert out == {7: 7, 11: 11}


def similarity(a, b):
    """Of two lists of words, by their multisets of five-word shingles."""
    from collections import Counter

    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_every_item_length_is_found(spark):
    """Items of 5 to 80 words, some with repeated shingles, behind a prompt that all share; texts that hold all of an item,
    or a part or a change of it that leaves about 0.8. Every window of the item's length counts."""
    rng = random.Random(2)
    prompt = [f"p{i}" for i in range(8)]
    items, docs, want = [], [], set()
    for m in [*range(5, 60), 70, 80]:
        words = [rng.choice("abcd") if m % 7 == 0 else f"w{m}x{i}" for i in range(m)]
        item = (prompt + words)[:m] if m > 30 else words
        items.append((m, " ".join(item)))
        for kind in range(5):
            part = list(item)
            if kind == 1:
                part = item[:-1]
            elif kind == 2:
                part = item[: max(5, round(4 + 0.8 * (m - 4)))]
            elif kind == 3:
                part[-1 - m // 12] = "changed"
            elif kind == 4:
                part = [f"f{rng.random()}"] * 3 + item[m // 9 :] + ["after"]
            docs.append((100 * m + kind, " ".join(part)))
    for i in range(150):
        docs.append((100_000 + i, " ".join(prompt + [f"z{i}y{j}" for j in range(20)])))
    for d, text in docs:
        w = text.split()
        for m, item in items:
            x = item.split()
            if set(zip(x, x[1:], x[2:], x[3:], x[4:])) & set(zip(w, w[1:], w[2:], w[3:], w[4:])) and max(similarity(w[s : s + m], x) for s in range(max(1, len(w) - m + 1))) >= 0.8:
                want.add((d, m))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(1000 + m, t) for m, t in items[:3]], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {x for x in got if x[1] < 1000} == want and {(d, m + 1000) for d, m in want if m < 8} == {x for x in got if x[1] >= 1000}
    assert len({m for _, m in want}) == len(items)


def test_a_null_source_is_a_host_of_its_own(spark):
    own = lambda i: " ".join(f"u{i}v{j}" for j in range(12))
    rows = [(i, f"same line on each page\n{own(i)}", None if i % 2 else "") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.n_removed_words for r in quality_rules.quality_rules(docs).collect()} == {0}
    more = docs.unionByName(spark.createDataFrame([(100 + i, f"same line on each page\n{own(100 + i)}", None) for i in range(10)], docs.schema))
    gone = {r.doc_id for r in quality_rules.quality_rules(more).collect() if r.n_removed_words}
    assert gone == {i for i in range(30) if i % 2 and i != 1} | {100 + i for i in range(10)}


def test_given_conversations_with_quotes(spark, sf):
    got = QUERIES["quoted_conversations"](spark, sf)
    n = got.agg(F.count_if(F.expr("n_linked > 0")).alias("linked"), F.count_if(F.expr("n_quotes > n_linked")).alias("unlinked"), F.count_if(F.expr("position <> reply_position")).alias("moved"), F.count_if(F.col("content").rlike("(?m)^>")).alias("left")).first()
    assert n.linked > 20 and n.unlinked > 0 and n.left == 0
    assert quotations.quoted_conversations.__doc__


def test_quality_scores_by_brute_force(spark):
    """A score is the softmax of the mean vector of a text's features: words, pairs of words and byte n-grams with their borders."""
    import re

    import numpy as np

    from quire.llm import quality_model as Q
    from quire.llm import shingles as S

    rng = np.random.default_rng(3)
    model = Q.Model(rng.normal(size=(Q.BUCKETS, 4)).astype(np.float32), rng.normal(size=(4, 2)).astype(np.float32), np.array([0.3, -0.1], np.float32))
    cut = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & cut
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & cut
        return x ^ (x >> 31)

    def slow(text):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
        h = [mix(sum(int(S._BYTE[b]) * pow(S._BASE, i, 2**64) for i, b in enumerate(w)) & cut) for w in words]
        found = h + [mix((a * int(S._PLACE[1]) + b * int(S._PLACE[2])) & cut) for a, b in zip(h, h[1:])]
        for n in Q.GRAMS:
            for w in words:
                s = b"\0" + w + b"\0"
                found += [mix((int.from_bytes(s[i : i + n], "big") + int(S._PLACE[8 + n])) & cut) for i in range(len(s) - n + 1)]
        v = np.mean([model.vectors[x >> 47] for x in found], axis=0) if found else np.zeros(4)
        z = v @ model.output + model.bias
        return 1 / (1 + np.exp(z[0] - z[1]))

    texts = ["One two  one\nTHREE é", "a", "", None, "x y " * 50, "Ünï ﬀ  nb", "long" * 300]
    got = {r.doc_id: r.score for r in Q.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - slow(t)) < 1e-5 for i, t in enumerate(texts))
