"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of consecutive tokens of all templates. A file's tokens are streamed through it and
give, at each place, the longest match that ends there. Matches of ``least`` tokens or more are chained, by
template (texts and notices of public licences, ``mendspan.llm.notices``), into spans with growing places in both file and template; a template is found where a chain covers
``share`` of it. Tokens that no template has cut the stream, so only runs of known tokens are walked.

The base phrases are found in the same stream of tokens, as whole runs. ``score`` is 1 if a base phrase stands in
the text, otherwise the largest share of a template that a chain covers (0 if none).

Edge cases: a null text is empty and gives 0 words, empty labels and score 0; repeated rows are scanned each.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mendspan.llm.common import bounded_batches, only, table
from mendspan.llm.notices import NOTICES
from mendspan.llm.words import batches, buffers, spans

# Phrases and labels of the base scan.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Bytes of words: digits, small letters and all beyond ASCII, once A-Z are lower-cased.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_BYTES = np.array([c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
SPACED = bytes(c if WORD_BYTES[c] else 32 for c in LOWER)


class SuffixAutomaton:
    """Of several token sequences. ``ends[state]``: where its runs end in each template, in order."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for number, tokens in enumerate(templates):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                at = last
                while at > 0:
                    self.ends[at].setdefault(number, []).append(place + 1)
                    at = self.link[at]

    def _state(self, length: int, link: int, follow: dict[int, int], ends: dict[int, list[int]]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        self.ends.append(ends)
        return len(self.length) - 1

    def _clone(self, at: int, token: int, old: int) -> int:
        new = self._state(self.length[at] + 1, self.link[old], dict(self.next[old]), {k: list(v) for k, v in self.ends[old].items()})
        self.link[old] = new
        while at >= 0 and self.next[at].get(token) == old:
            self.next[at][token] = new
            at = self.link[at]
        return new

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            old = self.next[last][token]
            return old if self.length[old] == self.length[last] + 1 else self._clone(last, token, old)
        new, at = self._state(self.length[last] + 1, 0, {}, {}), last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][token]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._clone(at, token, old)
        return new

    def statistics(self, tokens: list[int]):
        """For each place: the state and length of the longest match that ends with its token."""
        at, length = 0, 0
        for token in tokens:
            while at and token not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if token in self.next[at]:
                at = self.next[at][token]
                length += 1
            else:
                length = 0
            yield at, length


class Scanner:
    def __init__(self, phrases=PHRASES, templates=NOTICES, least: int = 3, share: float = 0.6) -> None:
        words = [(label, text.encode().translate(SPACED).split()) for label, text in templates]
        self.base = [(label, text.encode().translate(SPACED).split()) for text, label in phrases]
        self.vocabulary: dict[bytes, int] = {}
        for _, tokens in [*words, *self.base]:
            for x in tokens:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        coded = lambda tokens: [self.vocabulary[x] for x in tokens]
        self.labels, self.sizes = [label for label, _ in words], [len(x) for _, x in words]
        self.automaton = SuffixAutomaton([coded(x) for _, x in words])
        self.phrases = [(label, np.array(coded(x))) for label, x in self.base]
        self.least, self.share = least, share
        self.shortest = min([least, *(len(x) for _, x in self.phrases)])

    def scan(self, tokens: np.ndarray) -> tuple[list[int], set[str], list[tuple[str, int, int, float]]]:
        """Base places, base labels, and template spans (label, first word, end word, share covered)."""
        known = tokens >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        places: list[int] = []
        base: set[str] = set()
        matches: dict[int, list[tuple[int, int, list[int]]]] = {}
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < self.shortest:
                continue
            run = tokens[start:end]
            for label, phrase in self.phrases:
                if len(run) >= len(phrase):
                    hit = np.ones(len(run) - len(phrase) + 1, dtype=bool)
                    for i, x in enumerate(phrase):
                        hit &= run[i : len(run) - len(phrase) + 1 + i] == x
                    if hit.any():
                        base.add(label)
                        places += (np.flatnonzero(hit) + start).tolist()
            if end - start >= self.least:
                self._matches(run.tolist(), start, matches)
        return places, base, [x for number, found in matches.items() for x in self._chains(number, found)]

    def _matches(self, run: list[int], start: int, matches: dict) -> None:
        """For each template the matches that it can't carry on, as (end in file, length, ends in template)."""
        before, pending = 0, None
        ends = self.automaton.ends
        for i, (state, length) in enumerate([*self.automaton.statistics(run), (0, 0)]):
            if pending and before >= self.least:
                at, end = pending
                goes_on = ends[state] if length > before else {}
                if len(goes_on) < len(ends[at]):
                    for number, places in ends[at].items():
                        if number not in goes_on:
                            matches.setdefault(number, []).append((end, before, places))
            before, pending = length, (state, start + i + 1)

    def _chains(self, number: int, found: list[tuple[int, int, list[int]]]):
        """Matches joined while they move on in both file and template, no further apart than the template is long."""
        size, chain = self.sizes[number], None
        for end, length, places in found:
            first = end - length
            if chain and first >= chain[1] and first - chain[1] <= size:
                place = next((x for x in places if x - length >= chain[2]), None)
                if place is not None:
                    chain = [chain[0], end, place, chain[3] + length]
                    continue
            if chain and chain[3] >= self.share * size:
                yield self.labels[number], chain[0], chain[1], min(1.0, chain[3] / size)
            chain = [first, end, places[0], length]
        if chain and chain[3] >= self.share * size:
            yield self.labels[number], chain[0], chain[1], min(1.0, chain[3] / size)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: int, end_word: int, covered: double>>"


def _scan(batch_iter, scanner: Scanner):
    vocabulary = scanner.vocabulary
    for batch in batches(batch_iter):
        raw, offsets = buffers(batch.column(1))
        _, _, of = spans(np.frombuffer(LOWER, np.uint8)[raw], offsets, WORD_BYTES)
        counts = np.bincount(of, minlength=batch.num_rows)
        rows = []
        data = raw.tobytes().translate(SPACED)
        for i, n in enumerate(counts.tolist()):
            words = data[offsets[i] : offsets[i + 1]].split()
            tokens = np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int64, count=n)
            places, base, found = scanner.scan(tokens)
            best = 1.0 if base else max((x[3] for x in found), default=0.0)
            rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in found})), best, [dict(zip(("label", "first_word", "end_word", "covered"), x, strict=True)) for x in found]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("covered", pa.float64())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row a document, with the covered template spans, from (doc_id, text). The automaton's size is fixed by its templates."""
    return only(docs, "doc_id", "text").mapInArrow(partial(_scan, scanner=scanner or Scanner()), SCHEMA)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
