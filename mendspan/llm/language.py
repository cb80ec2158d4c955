"""Language identification: multinomial naive Bayes over hashed character n-grams.

Documents are lower-cased and read as code points, digits left out. Character bigrams and trigrams are hashed into
``buckets`` cells each. Training counts cells over every document that is learned from; the counts are summed by
Spark and only the finished matrix comes to the driver and is broadcast: 2 x ``buckets`` cells for each language. The number
of cells is halved, the same way for training and scoring, as often as it takes for ``MATRIX`` numbers to hold all languages,
so that its size is bounded however many there are. Scoring makes a batch's documents a sparse matrix of cell counts
and multiplies it with the rows of the matrix that it needs.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from every text
is ``und``; ids that are null or repeated change nothing, save that a null id is never learned from and never held out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.llm.common import bounded_batches, only, table
from mendspan.llm.words import batches

BUCKETS = 1 << 14
#: Numbers of the matrix at most, and cells at least.
MATRIX, LEAST_BUCKETS = 1 << 24, 1 << 6
#: Code points of a text that are scored at a time.
PIECE = 1 << 20


def cells(text: str, buckets: int) -> np.ndarray:
    """Cells of the bigrams and trigrams of a text, a space standing before and after it."""
    if len(text) > PIECE:  # neighbouring pieces share the two characters that their n-grams span
        return np.concatenate([_cells(text[max(0, i - 2) : i + PIECE], buckets, i == 0, i + PIECE >= len(text), 2 if i else 0) for i in range(0, len(text), PIECE)])
    return _cells(text, buckets, True, True, 0)


def _cells(text: str, buckets: int, first: bool, last: bool, overlap: int) -> np.ndarray:
    padded = f"{' ' * first}{text}{' ' * last}"
    code = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    two = two[max(0, overlap - 1) :]
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out = np.empty(len(two) + len(three), dtype=np.int32)
    out[: len(two)] = (two * np.uint32(0x2C1B3C6D)) >> shift
    out[len(two) :] = ((three * np.uint32(0x297A2D39)) >> shift) + np.uint32(buckets)
    return out


_DIGITS = {ord(c): None for c in "0123456789"}


def prepared(text: str | None) -> str | None:
    """The text as it is read, or None if it has no letter."""
    if text is None:
        return None
    text = text.lower().translate(_DIGITS)
    return text if any(map(str.isalpha, text)) else None


def _count(batch_iter, langs: list[str], buckets: int):
    total = np.zeros((len(langs), 2 * buckets), dtype=np.int64)
    at = {x: i for i, x in enumerate(langs)}
    for batch in batches(batch_iter):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (text := prepared(text)) is not None:
                total[at[lang]] += np.bincount(cells(text, buckets), minlength=2 * buckets)
    lang, cell = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[lang, cell])], ["lang", "cell", "n"])


def _posteriors(seen: list[np.ndarray], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each document and its probability, from the documents' cells."""
    size = len(matrix)
    pairs, count = np.unique(np.concatenate([i * size + x.astype(np.int64) for i, x in enumerate(seen)]), return_counts=True)
    doc, cell = pairs // size, pairs % size
    log = np.zeros((len(seen), matrix.shape[1]))
    for at in range(0, len(pairs), step := max(1, (1 << 21) // matrix.shape[1])):
        part = slice(at, at + step)
        first = np.flatnonzero(np.concatenate([[True], doc[part][1:] != doc[part][:-1]]))
        log[doc[part][first]] += np.add.reduceat(matrix[cell[part]] * count[part][:, None], first)
    log += prior
    best = log.argmax(axis=1)
    return best, 1.0 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)


def _predict(batch_iter, langs: list[str], weights, buckets: int):
    matrix, prior = weights.value
    for batch in batches(batch_iter, 1 << 20):
        texts = [prepared(x) if langs else None for x in batch.column(2).to_pylist()]
        full = [i for i, x in enumerate(texts) if x is not None]
        found, score = ["und"] * len(texts), [0.0] * len(texts)
        if full:
            for i, b, p in zip(full, *_posteriors([cells(texts[i], buckets) for i in full], matrix, prior), strict=True):
                found[i], score[i] = langs[b], float(p)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def held_out(doc_id, folds: int = 5):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, buckets: int = BUCKETS, most: int = MATRIX) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their log probabilities (cells x languages) and priors, from (text, lang)."""
    docs = only(docs, "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    # names of languages: a table as small as the matrix, whatever the corpus
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    while buckets > LEAST_BUCKETS and 2 * buckets * len(langs) > most:
        buckets //= 2
    counts = np.zeros((2 * buckets, len(langs)))
    if langs:
        rows = docs.mapInArrow(partial(_count, langs=langs, buckets=buckets), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
        counts[rows["cell"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    counts += 0.5
    prior = np.log(np.array([sizes[x] for x in langs], dtype=float) / max(1, sum(sizes.values())))
    for part in (counts[:buckets], counts[buckets:]):  # bigrams and trigrams are two multinomials
        part /= part.sum(axis=0)
        np.log(part, out=part)
    return langs, counts, prior


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], flag) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; ``flag`` is the held_out column."""
    langs, matrix, prior = model
    weights = docs.sparkSession.sparkContext.broadcast((matrix, prior))
    return docs.select(docs["doc_id"], flag.alias("held_out"), docs["text"]).mapInArrow(partial(_predict, langs=langs, weights=weights, buckets=len(matrix) // 2), "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    flag = held_out(docs["doc_id"])
    model = fit(docs.filter(docs["doc_id"].isNotNull() & ~flag))
    return predict(docs, model, flag)
