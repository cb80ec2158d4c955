"""Quality classifier: perplexity under an interpolated modified Kneser-Ney character n-gram model.

A text is read as symbols: digits alike, white space alike, controls alike, any other character by its code point (those
beyond ``DIRECT`` by a hash of it into as many classes again). ``ORDER`` symbols make a gram, packed into a long, so that
contexts and suffixes are bit operations; a text is preceded by start symbols.

1. Distinct texts are dealt into blocks of about ``BLOCK`` characters by their digest; they travel compressed. A block's
   task counts the grams of its trusted texts and lists the distinct grams of all. That is a row for each gram and block.
2. The count tables of all orders, their discounts and interpolation weights are made from these rows by aggregation and
   hash joins, sharded by gram and by context; they grow with the trusted text. Each distinct gram that was asked for gets
   its probability by joins from the shortest order to the longest.
3. The probabilities are joined back to the blocks that asked for them and summed up over each text there.

A text's score is the mean negative log probability of its symbols. Each language has two limits: the quantile ``LOWER`` of
its trusted texts, below which a text repeats itself, and the quantile ``UPPER`` of those that were not trained on (one in
``HELD_OUT``), above which it is no language known. A short text's mean varies more, so it is moved towards the limits by ``SPREAD`` over the square root of its length.

Edge cases: null and blank texts are rejected with null perplexity; a document without language, or of one with fewer
than ``LEAST_TRUSTED`` trusted documents, is held to the limits of all trusted ones; with nothing trusted, all but blank
texts are kept; repeated ids are judged each by their own text, and equal texts are trained on once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendspan.llm.common import bounded_batches, drop, table, written
from mendspan.llm.words import batches

ORDER, WIDTH = 4, 15
DIRECT = 1 << (WIDTH - 1)
BLOCK, PIECE = 8 << 20, 1 << 20
LOWER, UPPER = 0.001, 0.999
HELD_OUT, LEAST_TRUSTED = 5, 20
#: Mean score's allowance for a text of one symbol, in nats.
SPREAD = 4.0

_CLASS = np.arange(DIRECT, dtype=np.int64)
_CLASS[:32] = 1
_CLASS[127:160] = 1
_CLASS[9:14] = 32
_CLASS[48:58] = 48


def symbols(text: str) -> np.ndarray:
    """The symbols of a text; none is 0, the start symbol."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(code < DIRECT, _CLASS[np.minimum(code, DIRECT - 1)], DIRECT + (code * 0x9E3779B1 >> 12) % DIRECT)


def pieces(texts: list[str], order: int = ORDER, most: int = PIECE):
    """(text number, grams) of all symbols of the texts, about ``most`` at a time, however long a text is."""
    lead = order - 1
    parts: list[tuple[int, np.ndarray]] = []

    def grams() -> tuple[np.ndarray, np.ndarray]:
        s = np.concatenate([x for _, x in parts])
        of = np.repeat([i for i, _ in parts], [len(x) - lead for _, x in parts])
        inner = np.concatenate([np.arange(lead, len(x)) + at for (_, x), at in zip(parts, np.cumsum([0, *[len(x) for _, x in parts[:-1]]]), strict=True)])
        out = np.zeros(len(inner), dtype=np.int64)
        for back in range(lead, -1, -1):
            out = out << WIDTH | s[inner - back]
        return of, out

    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), most):
            s = symbols(text[max(0, at - lead) : at + most])
            parts.append((i, np.concatenate([np.zeros(max(0, lead - at), dtype=np.int64), s])))
            held += len(s)
            if held >= most:
                yield grams()
                parts, held = [], 0
    if parts:
        yield grams()


def _packed(batch_iter, blocks: int):
    """(block, digests, sizes, data): the batch's distinct texts, compressed, a row for each block they are dealt to."""
    for batch in batches(batch_iter):
        texts = {d: t.encode("utf-8", "surrogatepass") for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t}
        dealt: dict[int, list[int]] = {}
        for d in texts:
            dealt.setdefault(d % blocks, []).append(d)
        rows = [(b, of, [len(texts[d]) for d in of], pa.compress(b"".join(texts[d] for d in of), codec="zstd", asbytes=True)) for b, of in dealt.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["block", "digests", "sizes", "data"])


def _texts(block: pa.Table):
    """The block's distinct texts, some at a time: (digests, texts)."""
    seen: set[int] = set()
    for digests, sizes, data in zip(*[block[c].to_pylist() for c in ("digests", "sizes", "data")], strict=True):
        raw = pa.decompress(data, sum(sizes), codec="zstd", asbytes=True)
        ends = np.cumsum(sizes).tolist()
        new = [(d, raw[end - n : end].decode("utf-8", "surrogatepass")) for d, n, end in zip(digests, sizes, ends, strict=True) if d not in seen]
        seen.update(digests)
        yield [d for d, _ in new], [t for _, t in new]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def _counted(block: pa.Table, trusted: pa.Table, order: int) -> pa.Table:
    """(gram, n, block): each gram of the block's texts, and how often its trusted texts have it."""
    good = set(trusted["digest"].to_pylist())
    parts, held = [], 0
    for digests, texts in _texts(block):
        train = np.array([d in good for d in digests], dtype=bool)
        for of, grams in pieces(texts, order):
            found, at = np.unique(grams, return_inverse=True)
            parts.append((found, np.bincount(at, weights=train[of], minlength=len(found))))
            held += len(found)
            if held > 1 << 20:
                parts = [_summed(parts)]
                held = 0
    grams, n = _summed(parts) if parts else (np.zeros(0, dtype=np.int64),) * 2
    number = block["block"][0].as_py() if block.num_rows else 0
    return pa.table({"gram": grams, "n": n, "block": np.full(len(grams), number, dtype=np.int64)})


def _scored(block: pa.Table, told: pa.Table, order: int) -> pa.Table:
    """(digest, n_symbols, mean) of the block's texts."""
    known = told["gram"].to_numpy()
    by = np.argsort(known)
    known, log = known[by], np.log(told["p"].to_numpy()[by])
    digest, size, mean = [], [], []
    for digests, texts in _texts(block):
        total = np.zeros(len(texts))
        for of, grams in pieces(texts, order):
            total += np.bincount(of, weights=log[np.searchsorted(known, grams)], minlength=len(texts))
        n = np.array([len(t) for t in texts])
        digest += digests
        size += n.tolist()
        mean += (-total / n).tolist()
    return pa.table({"digest": pa.array(digest, pa.int64()), "n_symbols": pa.array(size, pa.int64()), "mean": pa.array(mean, pa.float64())})


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (WIDTH * order)) - 1))


def count_tables(counts: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """(gram, c) of each order from (gram, c) of the highest: below it, c is in how many different symbols' wake a gram stands."""
    tables = {order: written(counts)}
    for k in range(order - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c")))
    return tables


def discounts(tables: dict[int, DataFrame]) -> dict[int, list[float]]:
    """The three discounts of each order, for grams that stand once, twice and more often."""
    how_many = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    rows = None
    for k, t in tables.items():
        one = t.agg(*how_many).select(F.lit(k).alias("k"), "n1", "n2", "n3", "n4")
        rows = one if rows is None else rows.unionByName(one)
    out = {}
    for r in rows.collect():
        n = [r[f"n{i}"] for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out[r["k"]] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), float(i)) if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return out


def probabilities(asked: DataFrame, tables: dict[int, DataFrame], off: dict[int, list[float]], order: int = ORDER) -> DataFrame:
    """(gram, p) of each distinct gram asked for: the probability of its last symbol after those before it."""
    lower, wanted = None, {order: asked}
    for k in range(order - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(_suffix(F.col("gram"), k).alias("gram")).distinct()
    for k in range(1, order + 1):
        cut = F.when(F.col("c") == 1, off[k][0]).when(F.col("c") == 2, off[k][1]).otherwise(off[k][2])
        contexts = tables[k].groupBy(F.shiftright("gram", WIDTH).alias("context")).agg(F.sum("c").alias("total"), F.sum(cut).alias("off"))
        rows = wanted[k].join(tables[k], "gram", "left").withColumn("context", F.shiftright("gram", WIDTH)).join(contexts, "context", "left")
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / (1 << WIDTH)))
        else:
            rows = rows.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
        own = F.coalesce(F.col("c") - cut, F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((own + F.col("off") * F.col("q")) / F.col("total"))
        done, lower = lower, written(rows.select("gram", p.alias("p")))
        if done is not None:
            drop(done)
    return lower


def scores(texts: DataFrame, trusted: DataFrame, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """(digest, n_symbols, mean) of each distinct text of (digest, text); trained on the texts of ``trusted`` (digest)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    packed = texts.mapInArrow(partial(_packed, blocks=blocks), "block long, digests array<long>, sizes array<long>, data binary").groupBy("block")
    good = trusted.select("digest", F.pmod("digest", F.lit(blocks)).alias("block")).groupBy("block")
    seen = written(packed.cogroup(good).applyInArrow(lambda a, b: _counted(a, b, order), "gram long, n long, block long"))
    drop()
    tables = count_tables(seen.filter("n > 0").groupBy("gram").agg(F.sum("n").alias("c")), order)
    asked = written(seen.select("gram").distinct())
    told = probabilities(asked, tables, discounts(tables), order)
    answers = seen.select("block", "gram").join(told, "gram").groupBy("block")
    out = written(packed.cogroup(answers).applyInArrow(lambda a, b: _scored(a, b, order), "digest long, n_symbols long, mean double"))
    drop(seen, asked, told, *tables.values())
    return out


def limits(scored: DataFrame, lower: float = LOWER, upper: float = UPPER, step: float = 1e-3) -> DataFrame:
    """(lang, low, high) from trusted documents' (lang, above, below, held), and one row of null lang for all. Quantiles over bins of ``step``, the same however rows are dealt."""
    side = F.explode(F.array(F.struct(F.lit(False).alias("upper"), F.col("above").alias("x")), F.struct(F.lit(True).alias("upper"), F.when(F.col("held"), F.col("below")).alias("x")))).alias("s")
    binned = scored.select("lang", side).filter("s.x IS NOT NULL").groupBy("lang", "s.upper", F.floor(F.col("s.x") / step).alias("bin")).agg(F.count("*").alias("n"))
    every = binned.groupBy("upper", "bin").agg(F.sum("n").alias("n")).select(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang"), "upper", "bin", "n")
    both = binned.filter("lang IS NOT NULL").select(F.lit(False).alias("all"), "lang", "upper", "bin", "n").unionByName(every)
    key = ["all", "lang", "upper"]
    ranked = both.withColumn("to_here", F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))).withColumn("of", F.sum("n").over(Window.partitionBy(*key)))
    low = F.min(F.when(~F.col("upper") & (F.col("to_here") > F.col("of") * lower), F.col("bin") * step))
    high = F.min(F.when(F.col("upper") & (F.col("to_here") >= F.col("of") * upper), (F.col("bin") + 1) * step))
    return ranked.groupBy("all", "lang").agg(low.alias("low"), high.alias("high"), F.min("of").alias("of")).filter(F.col("all") | (F.col("of") >= LEAST_TRUSTED)).select("lang", "low", "high")


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, perplexity, low, high, kept) for every row of (doc_id, text, lang); ``digest`` is the text's; ``trusted_ids``: the ids (doc_id) of trusted text."""
    plain = docs.select(docs["doc_id"], docs["lang"], docs["text"], F.xxhash64(docs["text"]).alias("digest"))
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # ids grow with the corpus: never broadcast, whatever the size at hand
    ids = trusted_ids.select(trusted_ids["doc_id"]).filter("doc_id IS NOT NULL").distinct().select("doc_id", F.lit(True).alias("good")).hint("merge")
    rows = written(plain.select("doc_id", "lang", "digest", blank.alias("blank")).join(ids, "doc_id", "left"))
    held = F.pmod(F.xxhash64("digest"), F.lit(HELD_OUT)) == 0
    told = scores(plain.select("digest", "text"), rows.filter("good AND NOT blank").filter(~held).select("digest").distinct(), order, block)
    joined = written(rows.join(told.hint("merge"), "digest", "left"))
    give = F.lit(SPREAD) / F.sqrt("n_symbols")
    moved = joined.withColumn("above", F.col("mean") + give).withColumn("below", F.col("mean") - give)
    known = limits(moved.filter("good AND NOT blank").withColumn("held", held))
    whole = known.filter("lang IS NULL").select(F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    of_lang = known.filter("lang IS NOT NULL").select(F.col("lang").alias("l"), "low", "high")
    limited = moved.join(of_lang, F.col("lang") == F.col("l"), "left").join(whole, F.lit(True), "left")
    low, high = F.coalesce("low", "all_low", F.lit(0.0)), F.coalesce("high", "all_high", F.lit(float("inf")))
    kept = ~F.col("blank") & (F.col("above") >= low) & (F.col("below") <= high)
    return limited.select("doc_id", "digest", F.when(~F.col("blank"), F.exp("mean")).alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"), F.coalesce(kept, F.lit(False)).alias("kept"))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids whose labels call them good and none calls them bad or toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 AND t = 0").select("doc_id")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return classify(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels"))).drop("digest")
