"""N-gram Jaccard self-join of documents by chosen paths.

A document is the set of its word 5-grams (of all its words, if it has fewer). Documents of equal sets are one
class from the start; one of each goes on. Each set is embedded as ``coordinates`` min-hashes, which two sets share
in proportion to their Jaccard similarity.

Chosen paths: a run starts with all sets in one node. A node samples one coordinate (by a hash of the path so far)
and splits its sets by their token there; nodes of at most ``leaf`` sets are brute-forced, larger ones are split
again, up to ``depth`` times. Two sets of similarity s follow the same path to depth d with chance s**d, so
``runs_for`` repeats runs until a pair at the threshold is met with the target recall even on the deepest paths.
Leaves compare sketches with a lenient bound; what they link makes up loose clusters. Within those, every pair of
sets is compared exactly, in blocks of bounded size, and links are counted, not listed.

A node that is large at the deepest level mostly holds near copies of each other: its sets are compared with the first of
them, and those alike are linked to it, which puts them into one loose cluster. The others are compared with all sets of
the node, in pairs of blocks of half a ``chunk``, so that no task holds it whole and no pair is left out.

Edge cases: a null or blank text is linked to nothing; rows that share an id are one document with two texts and
come out in one class; null ids are one such document.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.llm.common import bounded_batches, drop, table, written
from mendspan.llm.components import connected_components
from mendspan.llm.words import batches, buffers, gram_hashes, mix, spans, word_hashes

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.998
COORDINATES, LEAF, DEPTH, CHUNK = 64, 64, 4, 1024
#: Standard deviations of the sketch's estimate that leaves allow below the threshold.
SLACK = 3.5
LAST = (1 << 63) - 1
BIN_ROWS, BIN_GRAMS = 20_000, 2_000_000


def runs_for(threshold: float = THRESHOLD, depth: int = DEPTH, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def gram_sets(column: pa.Array, gram: int = GRAM) -> list[np.ndarray]:
    """The sorted set of gram hashes of each text."""
    raw, offsets = buffers(column)
    starts, ends, of = spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    bounds = np.searchsorted(of, np.arange(len(offsets)))
    grams = gram_hashes(words, gram)
    return [np.unique(grams[a : b - gram + 1]) if b - a >= gram else gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def _sketches(batch_iter, gram: int, coordinates: int):
    """(key, a, b, n, sketch): two digests and the size of the set, and its min-hashes (null for an empty set)."""
    up, add = _permutations(coordinates)
    for batch in batches(batch_iter):
        sets = gram_sets(batch.column(1), gram)
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        full = np.flatnonzero(sizes)
        sketch = np.zeros((len(sets), coordinates), dtype=np.uint32)
        a, b = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
        if len(full):
            grams = np.concatenate([sets[i] for i in full])
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            short = (grams >> np.uint64(32)).astype(np.uint32)
            for i in range(coordinates):
                sketch[full, i] = np.minimum.reduceat(short * up[i] + add[i], at)
            a[full] = np.add.reduceat(mix(grams + np.uint64(1)), at)
            b[full] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), at)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, coordinates, 0))]).astype(np.int32)), pa.array(sketch[full].ravel().view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sizes), lists], ["key", "a", "b", "n", "sketch"])


def _paths(runs: int, depth: int, coordinates: int):
    """Nodes of a sketch on each run: an array of arrays, one node for each depth."""

    def run(number):
        node, nodes = F.xxhash64(number), []
        for _ in range(depth):
            node = F.xxhash64(node, F.element_at("sketch", (F.pmod(node, F.lit(coordinates)) + 1).cast("int")))
            nodes.append(node)
        return F.struct(*[x.alias(f"n{i}") for i, x in enumerate(nodes)])

    return F.explode(F.array(*[run(F.lit(i)) for i in range(runs)])).alias("path")


def labels(linked: np.ndarray) -> np.ndarray:
    """Component numbers (the smallest index) of a symmetric link matrix."""
    n = len(linked)
    own = np.arange(n)
    if n == 2:
        return np.array([0, 0]) if linked[0, 1] else own
    while True:
        least = np.minimum(own, np.where(linked, own[None, :], n).min(axis=1))
        least = least[least]
        if (least == own).all():
            return own
        own = least


def _leaves(rows: pd.DataFrame, bound: float) -> pd.DataFrame:
    """Spanning links (a, b) of the sets that seem similar in each node."""
    rows = rows.drop_duplicates(["node", "rep"]).sort_values(["node", "rep"], kind="stable")
    node, rep = rows["node"].to_numpy(), rows["rep"].to_numpy(np.int64)
    out: set[tuple[int, int]] = set()
    if len(rows):
        sketch = np.stack(rows["sketch"].to_numpy())
        need = bound * sketch.shape[1]
        edges = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if y - x == 2:
                if (sketch[x] == sketch[x + 1]).sum() >= need:
                    out.add((int(rep[x]), int(rep[x + 1])))
            elif y - x > 2:
                part = sketch[x:y]
                same = np.zeros((y - x, y - x), dtype=np.int16)
                for c in range(part.shape[1]):
                    same += part[:, c][:, None] == part[:, c][None, :]
                root = labels(same >= need)
                out.update((int(rep[x + r]), int(rep[x + i])) for i, r in enumerate(root.tolist()) if r != i)
    a, b = zip(*out, strict=True) if out else ((), ())
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def common_grams(rows: list[np.ndarray], columns: list[np.ndarray] | None = None, wide: int = 4096) -> np.ndarray:
    """How many grams each set of ``rows`` shares with each of ``columns`` (of ``rows``, if none)."""
    every = [*rows, *(columns or [])]
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    values, code, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    n, n_codes = len(rows), int(code[-1]) + 1 if len(code) else 0
    total = np.zeros((n, len(every) - n if columns else n), dtype=np.float32 if max(len(x) for x in every) < 1 << 24 else np.float64)
    wide = min(wide, max(1, n_codes))
    for at in range(0, n_codes, wide):
        x, y = np.searchsorted(code, [at, at + wide])
        dense = np.zeros((len(every), wide), dtype=total.dtype)
        dense[owner[x:y], code[x:y] - at] = 1
        total += dense[:n] @ (dense[n:] if columns else dense).T
    return total


def _similar(shared: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    return shared >= threshold * (left[:, None] + right[None, :] - shared) - 1e-6


def _verify(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Exact links in each (cluster, i, j): for each set the documents it is linked to (n), and spanning links (root)."""
    out = []
    rows = rows.sort_values(["cluster", "i", "j", "block", "rep"], kind="stable")
    for (_, i, j), part in rows.groupby(["cluster", "i", "j"], sort=False):
        rep, copies = part["rep"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
        sets = [np.asarray(x).view(np.uint64) for x in part["grams"]]
        sizes = np.array([len(x) for x in sets], dtype=np.float64)
        if i == j:
            linked = _similar(common_grams(sets), sizes, sizes, threshold)
            np.fill_diagonal(linked, False)
        else:
            cut = int((part["block"] == i).sum())
            if cut in (0, len(sets)):
                continue
            linked = np.zeros((len(sets), len(sets)), dtype=bool)
            linked[:cut, cut:] = _similar(common_grams(sets[:cut], sets[cut:]), sizes[:cut], sizes[cut:], threshold)
            linked |= linked.T
        root = labels(linked | np.eye(len(sets), dtype=bool))
        out.append(pd.DataFrame({"rep": rep, "root": rep[root], "n": linked @ copies}))
    return pd.concat(out) if out else pd.DataFrame({"rep": [], "root": [], "n": []}).astype("int64")


def _with_grams(batch_iter, gram: int):
    for batch in batches(batch_iter):
        sets = gram_sets(batch.column(3), gram)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["cluster", "rep", "copies", "grams"])


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, coordinates: int = COORDINATES, leaf: int = LEAF, depth: int = DEPTH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the smallest id of its class, and how many other documents it is similar to."""
    docs = docs.select(docs["doc_id"], docs["text"]).withColumn("key", F.coalesce("doc_id", F.lit(LAST)))
    runs = runs_for(threshold, depth, recall)
    bound = max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / coordinates))
    sketched = written(docs.select("key", "text").mapInArrow(partial(_sketches, gram=gram, coordinates=coordinates), "key long, a long, b long, n long, sketch array<int>"))
    reps = written(sketched.filter("n > 0").groupBy("a", "b", "n").agg(F.min("key").alias("rep"), F.count("*").alias("copies")))
    tops = reps.groupBy("rep").agg(F.sum("copies").alias("copies"), F.count("*").alias("sets"))
    sets = written(sketched.filter("n > 0").join(reps.select("rep", "a", "b", "n"), ["a", "b", "n"]).filter("key = rep").select("rep", "sketch").dropDuplicates(["rep", "sketch"]))

    walk = start = written(sets.select("rep", _paths(runs, depth, coordinates)).select("rep", "path.*"))
    found = None
    for level in range(depth):
        sizes = walk.groupBy(f"n{level}").agg(F.count("*").alias("m")).filter("m > 1")
        walk = walk.join(sizes, f"n{level}")
        last = level == depth - 1
        here = walk.filter((F.col("m") <= leaf) | F.lit(last)).select(F.col(f"n{level}").alias("node"), "rep", "m")
        found = here if found is None else found.unionByName(here)
        if not last:
            walk = written(walk.filter(F.col("m") > leaf).drop("m"))
    found = written(found)
    large = found.filter(F.col("m") > chunk).select("node", "rep")
    heads = large.groupBy("node").agg(F.min("rep").alias("head"))
    first = heads.join(sets.select(F.col("rep").alias("head"), F.col("sketch").alias("head_sketch")), "head").dropDuplicates(["node"])
    same = F.size(F.filter(F.zip_with("sketch", "head_sketch", lambda x, y: x == y), lambda x: x))
    told = written(large.join(first, "node").join(sets, "rep").groupBy("node", "rep", "head").agg(F.max(same >= bound * coordinates).alias("alike")))
    crossed = _crossed(told, max(1, chunk // 2))
    dealt = found.filter(F.col("m") <= chunk).select("node", "rep").unionByName(crossed)
    n_bins = max(1, -(-found.count() // BIN_ROWS))
    linked = dealt.join(sets, "rep").withColumn("bin", F.pmod(F.xxhash64("node"), F.lit(n_bins))).groupBy("bin").applyInPandas(lambda rows: _leaves(rows, bound), "a long, b long")
    linked = linked.unionByName(told.filter("alike AND rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")))
    loose = written(connected_components(linked).select(F.col("node").alias("rep"), F.col("root").alias("cluster")))
    drop(start, walk, found, told)

    texts = docs.join(loose, docs["key"] == loose["rep"]).join(tops.select(F.col("rep").alias("r"), "copies"), F.col("key") == F.col("r"))
    grams = written(texts.select("cluster", "rep", "copies", "text").mapInArrow(partial(_with_grams, gram=gram), "cluster long, rep long, copies long, grams array<long>"))
    per = grams.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.size("grams")).alias("size"))
    n_bins = max(1, -(-int(per.agg(F.sum("size")).first()[0] or 0) // BIN_GRAMS))
    blocks = F.greatest(F.ceil(F.col("m") / chunk), F.ceil(F.col("size") / F.lit(4 * BIN_GRAMS))).cast("int")
    placed = grams.join(per.select("cluster", blocks.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    binned = paired.withColumn("bin", F.when(F.col("blocks") > 1, F.xxhash64("cluster", "i", "j")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(n_bins))))
    verified = written(binned.groupBy("bin").applyInPandas(lambda rows: _verify(rows, threshold), "rep long, root long, n long"))
    roots = connected_components(verified.select(F.col("root").alias("a"), F.col("rep").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("n").alias("n"))
    told = written(tops.join(links, "rep", "left").join(roots, tops["rep"] == roots["node"], "left").select(tops["rep"], "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", tops["rep"]).alias("root")))
    of_set = written(reps.select("a", "b", F.col("n").alias("size"), "rep").join(told, "rep"))
    drop(loose, grams, verified, told, reps, sets)
    keyed = sketched.withColumnRenamed("n", "size")
    same = keyed.join(of_set, ["a", "b", "size"], "left")
    null_if_last = lambda c: F.when(c != LAST, c)
    return same.select(null_if_last(F.col("key")).alias("doc_id"), null_if_last(F.coalesce("root", "key")).alias("class_id"), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"))


def _crossed(told: DataFrame, size: int) -> DataFrame:
    """(node, rep) of pairs of blocks, of which one at least holds sets that aren't alike the first: of a node's (rep, alike)."""
    ceil = lambda n: F.ceil(n / F.lit(size)).cast("int")
    per = told.groupBy("node").agg(ceil(F.count_if(~F.col("alike"))).alias("others"), ceil(F.count_if("alike")).alias("near"))
    hash_of = F.pmod(F.xxhash64("rep", "node"), F.when(F.col("alike"), F.col("near")).otherwise(F.col("others"))).cast("int")
    placed = told.join(per.filter("others > 0"), "node").withColumn("block", hash_of)
    partners = F.when(F.col("alike"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("near") - 1))
    met = placed.withColumn("other", F.explode(partners))
    i = F.when(F.col("alike"), F.col("other")).when(F.col("other") < F.col("others"), F.least("block", "other")).otherwise(F.col("block"))
    j = F.when(F.col("alike"), F.col("others") + F.col("block")).otherwise(F.greatest("block", "other"))
    j = F.when(F.col("alike") | (F.col("other") < F.col("others")), j).otherwise(F.col("other"))
    return met.select(F.xxhash64("node", i, j).alias("node"), "rep")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-6),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, min(root) AS class_id, CAST((SELECT count(*) FROM e WHERE e.a = r.doc_id) AS BIGINT) AS n_links FROM r GROUP BY doc_id
"""
