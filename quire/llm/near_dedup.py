"""MinHash near-duplicates: circulant MinHash signatures, banding, exact Jaccard verification, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, batches, each, finished, merged, spread, stored, table, tune
from .graph import components
from .shingles import _PLACE, mix, shingle_sets

#: 60 bands of 7 coordinates miss a pair of similarity 0.8 with a probability of (1 - 0.8**7)**60, 7.4e-7, and put a
#: pair of similarity 0.3, as of short texts that share a passage, into a common bucket with one of 0.013.
BANDS, ROWS = 60, 7
#: Dimension of the two permutations.
DIMENSION = 1 << 20
#: A block of texts of a group has about so many texts or bytes on average, or one longer text; two blocks are compared in one task.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
#: Columns of the incidence matrices of two blocks at a time.
BLOCK_COLUMNS = 8192

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_tables: dict[str, np.ndarray] = {}


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and all windows of pi as a view: row x holds pi[x], pi[x + 1], ... cyclically, one value for each coordinate."""
    if not _tables:
        rng = np.random.default_rng(8128)
        k = BANDS * ROWS
        pi = rng.permutation(DIMENSION).astype(np.int32)
        _tables["sigma"] = rng.permutation(DIMENSION).astype(np.int32)
        _tables["pi"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    return _tables["sigma"], _tables["pi"]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a non-empty set: sigma places each shingle once; coordinate j takes the least value of pi
    shifted by j. The shifts of one place are neighbours in memory, so a shingle costs one short row."""
    sigma, pi = _permutations()
    at = sigma[(shingles >> np.uint64(44)).astype(np.int64)]
    out = np.full(BANDS * ROWS, DIMENSION, np.int32)
    for i in range(0, len(at), 2048):
        np.minimum(out, pi[at[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    s = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((s * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[63]).view(np.int64)


def _features(words: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column("text"), words)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        sigs = [signature(s) if len(s) else np.zeros(BANDS * ROWS, np.int32) for s in sets]
        keys = band_keys(np.stack(sigs))
        bands = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum([BANDS * bool(len(s)) for s in sets])]).astype(np.int32), keys[[bool(len(s)) for s in sets]].ravel())
        return batches({"doc_id": b.column("doc_id"), "n_shingles": [len(s) for s in sets], "d1": d[:, 0], "d2": d[:, 1], "bands": bands}, _SCHEMA)

    return run


def _verify(words: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for node, text in (("a", "ta"), ("b", "tb")):  # a hub is in many pairs of a batch; its set is made once
            _, one, of = np.unique(b.column(node).to_numpy(), return_index=True, return_inverse=True)
            sets = shingle_sets(b.column(text).take(pa.array(one)), words)
            sides.append([sets[i] for i in of.tolist()])
        keep = []
        for x, y in zip(*sides):
            small, large = sorted((len(x), len(y)))
            both = len(np.intersect1d(x, y, assume_unique=True)) if small and 100 * small >= percent * large else 0
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=schema).filter(pa.array(keep))

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, by products of incidence matrices."""
    vocabulary, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    lengths = np.array([len(x) for x in [*left, *right]])
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(codes, kind="stable")
    codes, row = codes[order], row[order]
    cuts = np.searchsorted(codes, np.arange(0, len(vocabulary) + BLOCK_COLUMNS, BLOCK_COLUMNS))
    out = np.zeros((len(left), len(right)), np.int64)
    for n, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        m = np.zeros((len(lengths), BLOCK_COLUMNS), np.float32)
        m[row[i:j], codes[i:j] - n * BLOCK_COLUMNS] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def _compare(words: int, percent: int):
    """Two blocks of a group -> pairs of components that a link joins, as many as a forest of these needs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        side, comp = t.column("side").to_numpy(), t.column("comp").to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(one) or not len(two):
            return schema.empty_table()
        sets = shingle_sets(t.column("text"), words)
        n = np.array([len(x) for x in sets])
        both = _intersections([sets[i] for i in one], [sets[i] for i in two])
        linked = (100 * both >= percent * (n[one][:, None] + n[two] - both)) & (comp[one][:, None] != comp[two])
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        pairs = []
        for i, j in np.argwhere(linked):
            x, y = int(comp[one[i]]), int(comp[two[j]])
            if (p := top(x)) != (q := top(y)):
                parent[max(p, q)] = min(p, q)
                pairs.append((x, y))
        return pa.table([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], schema=schema)

    return run


def _main(df: DataFrame, *group: str) -> DataFrame:
    """For each group of df(..., comp): its largest component, its members, how many are outside that, and the
    comparisons of these with all."""
    sizes = df.groupBy(*group, "comp").agg(F.count("*").alias("c")).groupBy(*group).agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("u"))
    return sizes.where("u > 0").withColumn("cost", F.col("u") * F.col("m"))


def _between(left: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """left(key, node, comp), the members of buckets -> (a, b), pairs of components that a link joins.

    Buckets within one component are done. The others are gathered into clusters that share members; a cluster is
    compared as one group where this takes fewer comparisons than its buckets one by one (else a pair that shares many
    buckets would be compared in each). In a group, the members outside its largest component are compared with all,
    block by block: u members against m take about 2 * u * m / BLOCK_ROWS rows with texts, not u * m. As many blocks are
    laid as the members' rows and bytes fill, and members are dealt to them by hash.
    """
    open_ = stored(left.join(_main(left, "key").select("key", "cost"), "key"), "open")
    if open_.isEmpty():
        return open_.select(F.col("comp").alias("a"), F.col("comp").alias("b"))
    first = open_.groupBy("key").agg(F.min("node").alias("a"))
    clusters = components(open_.join(first, "key").select("a", F.col("node").alias("b"))).select("node", F.col("root").alias("cluster"))
    rows = stored(open_.join(merged(clusters), "node"), "clusters")
    single = rows.groupBy("cluster", "key").agg(F.first("cost").alias("cost")).groupBy("cluster").agg(F.sum("cost").alias("singly"))
    members = rows.select("cluster", "node", "comp").distinct()
    whole = _main(members, "cluster").select("cluster", "cost").join(single, "cluster").select("cluster", (F.col("cost") <= F.col("singly")).alias("whole"))
    members, whole = stored(members, "members"), stored(whole, "whole")
    # no aggregation follows these joins by cluster, so a cluster of many rows can be split over tasks
    together = members.join(merged(whole.where("whole")), "cluster").select("cluster", F.lit(0).cast("long").alias("key"), "node", "comp")
    rows = together.union(rows.join(merged(whole.where("not whole")), "cluster").select("cluster", "key", "node", "comp"))
    rows = stored(rows.join(merged(held.select(F.col("doc_id").alias("node"), "size")), "node"), "groups")
    # a member's part of a block, of its rows or of its bytes: a long text takes much of one block and makes no other smaller
    rows = rows.withColumn("part", F.greatest(F.lit(1 / BLOCK_ROWS), F.col("size") / BLOCK_BYTES))
    parts = rows.groupBy("cluster", "key").agg(F.sum("part").alias("all"))
    main = _main(rows, "cluster", "key").select("cluster", "key", "main")
    outside = rows.join(main, ["cluster", "key"]).where("comp != main").groupBy("cluster", "key", "main").agg(F.sum("part").alias("out"))
    plan = outside.join(parts, ["cluster", "key"]).select("cluster", "key", "main", F.ceil("out").cast("int").alias("na"), F.ceil("all").cast("int").alias("nb"))
    rows = rows.drop("size", "part").join(merged(stored(plan, "plan")), ["cluster", "key"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where("comp != main").select("cluster", "key", "node", "comp", F.lit(0).alias("side"), own("na").alias("i"), every("nb").alias("j"))
    two = rows.select("cluster", "key", "node", "comp", F.lit(1).alias("side"), every("na").alias("i"), own("nb").alias("j"))
    dealt = stored(one.union(two), "blocks").join(merged(held.select(F.col("doc_id").alias("node"), "text")), "node")
    return stored(dealt.groupBy("cluster", "key", "i", "j").applyInArrow(_compare(words, percent), "a long, b long").distinct(), "between")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of at least ``percent`` % are linked;
    component_id is the least doc_id of a document's component and kept marks that document. Null and wordless texts
    have no shingles and no links. A row with a null doc_id is compared with nothing: its component_id is null and it
    is kept. Repeated rows give repeated results; a doc_id should name one text. Columns other than doc_id and text are
    not read, whatever they are called.

    Documents with equal sets form one class, of which only the one with the least doc_id goes on. In each bucket
    of the banding, the member that shares most buckets with others is compared with all the rest, which joins a group
    of n copies by about n comparisons. Members of a bucket that are in different components after that are compared
    with each other, in blocks of bounded size (see _between). So no link between components is lost, no bucket is
    gathered in one place, and no row is made for each pair of a bucket.
    """
    return finished(docs.sparkSession, lambda: _near_duplicates(docs, words, percent), "near-duplicates")


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    features = stored(docs.mapInArrow(each(_features(words)), schema), "features")
    classes = stored(features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = features.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node")).distinct()
    sizes = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    live = stored(rows.join(sizes, "key"), "buckets")
    nodes = live.groupBy("node").agg(F.sum("c").alias("score"))
    held = stored(docs.join(merged(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        one = held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        two = held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        return stored(pairs.join(one, "a").join(two, "b").mapInArrow(each(_verify(words, percent)), "a long, b long"), "links")

    def as_pairs(df: DataFrame) -> DataFrame:
        return df.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).where("a != b").distinct()

    hubs = stored(live.join(nodes, "node").groupBy("key").agg(F.max_by("node", "score").alias("hub")), "hubs")
    links = verified(stored(as_pairs(live.join(hubs, "key")), "pairs"))
    roots = stored(components(links), "roots")
    left = stored(live.join(hubs, "key").where("node != hub").select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")), "left")
    # each link between components as they were joins their roots
    moved = stored(components(_between(left, held, words, percent)), "moved")
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = known.union(moved.join(roots.select("node"), "node", "left_anti").select("node", "root"))
    ids = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "d1", "d2").join(ids, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8) stays: the one with the least doc_id. Rows with
    a null doc_id all stay, as rows of their own that are compared with nothing; a doc_id should name one text, and rows
    that repeat it stay or go together. Null, empty and wordless texts are like nothing and stay; texts of any length are
    compared whole; an empty table stays empty; other columns, of any name, stay as they are."""
    docs, back = apart(docs, "__kept")
    keep = near_duplicates(docs, words=5).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(merged(keep), F.col("doc_id").cast("long") == F.col("__kept"), "left_semi")
    return back(named.union(docs.where(F.col("doc_id").cast("long").isNull())))


#: Exact links for a small corpus: all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, g.y FROM r JOIN both_ways g ON g.x = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
