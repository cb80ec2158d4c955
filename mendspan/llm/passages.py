"""Removal of passages that repeat: every window of 20 words whose words stand earlier loses its words.

1. Anchors. Of the 7-grams inside each window the one of smallest hash is its anchor, so equal windows have equal
   anchors. One pass hashes all whole texts and keeps one 7-gram in about seven.
2. Exact copies of a smaller id's text are found by digest and lose all their words. Anchors that occur in two
   different texts, or twice in one, are found by counting hashes, and joined back to their places.
3. Confirming and locating. The windows that a place is the anchor of form a segment of words. Segments are dealt
   over bounded shards by anchor, where windows that stand there twice are confirmed as passages; the shard's
   passages are compiled into one Aho-Corasick automaton over words, and its segments are streamed through it to
   find every occurrence, of which all but the first are removed. An anchor's places all meet in one shard, so the
   first one is the corpus's first. Anchors with more than ``HOT`` places don't meet in a task: their windows' earliest
   places are summed up by 128-bit hash instead, which combines before the shuffle, and joined back.
4. Documents drop the words that the removed windows cover.

Automata over shards keep the work in proportion to the repeated text: no document meets an automaton that none of
its anchors leads to.

Edge cases: a null or blank text has no words; ids that are null come after all others; rows that share an id are
judged by their texts in the order of a digest; a window that stands twice in rows of equal id and text may be removed from both.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.llm.common import bounded_batches, table, written
from mendspan.llm.words import batches, buffers, gram_hashes, spans, word_hashes

WINDOW, GRAM = 20, 7
#: Places from which on an anchor is summed up by hash, and segments in a shard.
HOT, SHARD = 20_000, 20_000
LAST = (1 << 63) - 1


def window_anchors(grams: np.ndarray, of: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words, the index of its leftmost smallest gram; -1 where words of two documents meet."""
    wide = window - gram + 1
    value, place, size = grams.copy(), np.arange(len(grams)), 1
    while size * 2 <= wide:
        later = value[size:] < value[: len(value) - size]
        place = np.where(later, place[size:], place[: len(place) - size])
        value = np.where(later, value[size:], value[: len(value) - size])
        size *= 2
    if size < wide:
        step = wide - size
        later = value[step:] < value[: len(value) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
    n = max(0, len(of) - window + 1)
    return np.where(of[:n] == of[window - 1 : window - 1 + n], place[:n], -1)


def _hashed(column, window: int, gram: int):
    raw, offsets = buffers(column)
    starts, ends, of = spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    return words, of, np.searchsorted(of, np.arange(len(offsets) - 1)), gram_hashes(words, gram)


def _anchors(batch_iter, window: int, gram: int):
    """(anchor, key, pos, digest, again): the document's digest, and whether its anchor stands in it more than once."""
    for batch in batches(batch_iter):
        _, of, first, grams = _hashed(batch.column(1), window, gram)
        chosen = window_anchors(grams, of, window, gram) if len(of) >= window else np.zeros(0, dtype=np.int64)
        at = np.unique(chosen[chosen >= 0])
        anchor, doc = grams[at].view(np.int64), of[at]
        order = np.lexsort((anchor, doc))
        twin = (anchor[order][1:] == anchor[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][twin]] = True
        again[order[:-1][twin]] = True
        keys, digests = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(keys[doc]), pa.array(at - first[doc]), pa.array(digests[doc]), pa.array(again)], ["anchor", "key", "pos", "digest", "again"])


def _sorted_out(batch_iter, window: int):
    """What is known of each document before windows are compared; candidates keep their text and places."""
    for batch in batches(batch_iter):
        n_words, removed, digest, texts, places = [], [], [], [], []
        for text, first, pos in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = (text or "").encode().split()
            copy = not first and len(words) >= window
            keep = pos if pos and first else None
            n_words.append(len(words))
            removed.append(len(words) if copy else 0)
            digest.append(None if keep else hashlib.sha256(b"" if copy else b" ".join(words)).hexdigest())
            texts.append(text if keep else None)
            places.append(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(4), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string()), pa.array(places, pa.list_(pa.int64()))], ["key", "digest", "doc_id", "n_words", "n_removed", "kept_sha256", "text", "places"])


def _segments(batch_iter, window: int, gram: int):
    """(anchor, key, digest, start, words): the stretch of the windows that have a place as anchor, for each that isn't hot."""
    for batch in batches(batch_iter):
        raw, offsets = buffers(batch.column(1))
        starts, ends, of = spans(raw, offsets)
        first = np.searchsorted(of, np.arange(batch.num_rows))
        grams = gram_hashes(word_hashes(raw, starts, ends), gram)
        chosen = window_anchors(grams, of, window, gram)
        wanted = np.zeros(len(grams) + 1, dtype=bool)
        for i, places in enumerate(batch.column(2).to_pylist()):
            wanted[[first[i] + (x >> 1) for x in places if not x & 1]] = True
        begin = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))  # windows of one anchor follow each other
        end = np.append(begin[1:], len(chosen)) - 1
        good = (chosen[begin] >= 0) & wanted[chosen[begin]]
        begin, end = begin[good], end[good]
        data = raw.tobytes()
        text = [data[a:b] for a, b in zip(starts[begin].tolist(), ends[end + window - 1].tolist(), strict=True)]
        keys, digests = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
        doc = of[begin]
        yield pa.RecordBatch.from_arrays([pa.array(grams[chosen[begin]].view(np.int64)), pa.array(keys[doc]), pa.array(digests[doc]), pa.array(begin - first[doc]), pa.array(text, pa.binary()).cast(pa.string())], ["anchor", "key", "digest", "start", "words"])


def _hot_windows(batch_iter, window: int, gram: int):
    """(hash, anchor, key, digest, start) of each window around hot places; a window that repeats in its document comes once more with its later starts."""
    for batch in batches(batch_iter):
        words, of, first, grams = _hashed(batch.column(1), window, gram)
        whole = gram_hashes(words, window)
        chosen = window_anchors(grams, of, window, gram)
        hot = np.zeros(len(grams) + 1, dtype=bool)
        for i, places in enumerate(batch.column(2).to_pylist()):
            hot[[first[i] + (x >> 1) for x in places if x & 1]] = True
        at = np.flatnonzero((chosen >= 0) & hot[chosen])
        keys, digests = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
        yield pa.RecordBatch.from_arrays([pa.array(whole[at].view(np.int64)), pa.array(grams[chosen[at]].view(np.int64)), pa.array(keys[of[at]]), pa.array(digests[of[at]]), pa.array(at - first[of[at]])], ["hash", "anchor", "key", "digest", "start"])


def _locate(keys: np.ndarray, starts: np.ndarray, words: np.ndarray, of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed passages of a shard, compiled and found in its segments: (key, start) of the windows that stand earlier elsewhere.

    Segments come in the order of the corpus; ``words`` are their words' hashes, ``of`` the segment of each word.
    """
    import ahocorasick

    codes = pd.factorize(words)[0]
    grams = gram_hashes(words, window)
    inside = np.flatnonzero(of[: len(grams)] == of[window - 1 : window - 1 + len(grams)])
    _, at, which, count = np.unique(grams[inside], return_index=True, return_inverse=True, return_counts=True)
    passages = inside[at[count > 1]]
    if not len(passages):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    listed = codes.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for number, x in enumerate(passages.tolist()):
        automaton.add_word(tuple(listed[x : x + window]), number)
    automaton.make_automaton()
    met = np.unique(of[inside[count[which] > 1]])  # the other segments hold no passage
    offsets = np.searchsorted(of, np.arange(len(keys) + 1))
    seen = [False] * len(passages)
    segment, end_word = [], []
    for i in met.tolist():
        for end, passage in automaton.iter(tuple(listed[offsets[i] : offsets[i + 1]])):
            if seen[passage]:
                segment.append(i)
                end_word.append(end)
            else:
                seen[passage] = True
    segment = np.array(segment, dtype=np.int64)
    return keys[segment], starts[segment] + np.array(end_word, dtype=np.int64) - window + 1


def _stretches(key: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed windows as stretches of words: neighbours joined."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + window)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1 if len(at) else at
    return key[at], start[at], start[last] + window


def _located(shard: pa.Table, window: int) -> pa.Table:
    shard = shard.sort_by([("key", "ascending"), ("digest", "ascending"), ("start", "ascending")])
    raw, offsets = buffers(shard["words"])
    starts, ends, of = spans(raw, offsets)
    digests, begins = (shard[x].to_numpy() for x in ("digest", "start"))
    found = _stretches(*_locate(digests, begins, word_hashes(raw, starts, ends), of, window), window)
    return pa.table(dict(zip(("digest", "begin", "end"), found, strict=True)))


def _removed(batch_iter):
    for batch in batches(batch_iter):
        n_removed, digest, texts = [], [], []
        for text, stretches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.encode().split()
            keep = np.ones(len(words), dtype=bool)
            for x in stretches or ():
                keep[x["begin"] : x["end"]] = False
            left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            n_removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_rows: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row a document, from (doc_id, text)."""
    size = dict(window=window, gram=gram)
    docs = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("digest")).withColumn("key", F.coalesce("doc_id", F.lit(LAST)))
    anchors = written(docs.select("key", "text", "digest").mapInArrow(partial(_anchors, **size), "anchor long, key long, pos long, digest long, again boolean"))
    counted = anchors.groupBy("anchor").agg(F.count("*").alias("n"), (F.max("again") | (F.min("digest") != F.max("digest"))).alias("repeats"))
    twice = written(counted.filter("repeats").select("anchor", (F.col("n") > hot).cast("long").alias("hot")))
    places = written(anchors.select("anchor", "key", "digest", "pos").join(twice, "anchor").groupBy("key", "digest").agg(F.collect_list(F.col("pos") * 2 + F.col("hot")).alias("places")))
    # a document is known by its key and text: ids may repeat or be null
    firsts = docs.groupBy(F.md5("text").alias("md5"), "digest").agg(F.min("key").alias("key")).select("key", "digest", F.lit(True).alias("first"))
    known = firsts.join(places, ["key", "digest"], "full")
    told = docs.join(known, ["key", "digest"], "left").select("key", "text", F.coalesce("first", F.lit(False)).alias("first"), "places", "doc_id", "digest")
    sorted_out = written(told.mapInArrow(partial(_sorted_out, window=window), "key long, digest long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, places array<long>"))
    candidates = sorted_out.filter("text IS NOT NULL")
    n = places.agg(F.sum(F.size("places"))).first()[0] or 0
    segments = candidates.select("key", "text", "places", "digest").mapInArrow(partial(_segments, **size), "anchor long, key long, digest long, start long, words string")
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-n // shard_rows)))))
    located = dealt.groupBy("shard").applyInArrow(lambda shard: _located(shard, window), "digest long, begin long, end long")
    warm = candidates.filter(F.exists("places", lambda x: x.bitwiseAND(F.lit(1)) == 1)).select("key", "text", "places", "digest").mapInArrow(partial(_hot_windows, **size), "hash long, anchor long, key long, digest long, start long")
    in_doc = written(warm.groupBy("hash", "anchor", F.struct("key", "digest").alias("doc")).agg(F.min("start").alias("first_start"), F.collect_list("start").alias("starts")))
    earliest = written(in_doc.groupBy("hash", "anchor").agg(F.min("doc").alias("first_doc")))
    again = in_doc.join(earliest, ["hash", "anchor"]).filter((F.col("doc") != F.col("first_doc")) | (F.size("starts") > 1)).select("doc", F.explode("starts").alias("begin"), "first_doc", "first_start")
    again = again.filter((F.col("doc") != F.col("first_doc")) | (F.col("begin") != F.col("first_start"))).select("doc.digest", "begin", (F.col("begin") + window).alias("end"))
    # of each text only the first key's rows are candidates, so that the digest tells them apart
    cut = located.unionByName(again).groupBy("digest").agg(F.collect_list(F.struct("begin", "end")).alias("stretches"))
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    changed = candidates.join(cut, "digest", "left").select("doc_id", "n_words", "text", "stretches").mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return sorted_out.filter("text IS NULL").select(*names).unionByName(changed.select(*names))


def op6_passages(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(w[start:start + 19], ' ') ORDER BY doc_id, start) AS nth FROM p),
c AS (SELECT doc_id, list_distinct(flatten(list(range(start, start + 20)))) AS gone FROM g WHERE nth > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""
