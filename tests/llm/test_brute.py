"""Operators that SQL can't express, against brute force, planted cases or held-out accuracy."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpora import SF, frame, prose
from oracle import same
from pyspark.sql import functions as F

from mendspan.llm import chosen_path, common, language, licenses, lines, mixing, passages, perplexity, private, registry, templates, topk

RNG = random.Random(3)


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 13 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
)


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_private_base(spark):
    pieces = ["a@b.co", "@", ".", "x_y%z@q-r.s.t", "1.2.3.4", "300.1.1.1", "01.002.0003.4.5", "4539 1488-0343 6467", "4539148803436468", "+1 (555) 010-9999", "+12", "é", " ", "-", "a.b@c", "1", "+", "()", "😀", "\n", "a@b.c@d.e", "12345678901234567890"]
    texts = ["".join(RNG.choice(pieces) for _ in range(RNG.randrange(1, 25))) for _ in range(600)]
    frame(spark, texts).createOrReplaceTempView("d")
    for r in private.find_private(spark.table("d")).collect():
        assert [f"{x['kind']}:{x['start']}:{x['end']}" for x in r["found"] if x["base"]] == base_spans(texts[r["doc_id"]])


def test_private_base_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    for r in registry.QUERIES["op1_private"](spark, SF).collect():
        expected = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k, _, _ in BASE] == [sum(x.startswith(f"{k}:") for x in expected) for k, _, _ in BASE]


def test_private_bootstraps(spark):
    seeds = [f"notes on record contact mail u{i}@x{i}.org please" for i in range(6)]
    hidden = [f"more prose here contact mail agent-{i}77 please" for i in range(3)]
    clean = [f"chapter number 10{i}0 of the book" for i in range(3)]
    found = {r["doc_id"]: r["found"] for r in private.find_private(frame(spark, seeds + hidden + clean)).collect()}
    assert all([x["kind"] for x in found[i]] == ["id"] for i in range(6, 9))
    assert hidden[0][found[6][0]["start"] : found[6][0]["end"]] == "agent-077"
    assert all(not found[i] for i in range(9, 12))


def test_private_finds_spaced_numbers_names_and_keys(spark):
    rng = random.Random(17)
    noise = lambda: prose(rng, 8, 3000)
    texts = [f"{noise()} call our office number +1 (555) 010-1{i:03d} today {noise()}" for i in range(12)]
    texts += [f"{noise()} call our office number (555) 010-2{i:03d} today {noise()}" for i in range(12)]
    texts += [f"{noise()} please write to u{i}@x{i}.org about it {noise()}" for i in range(12)]
    texts += [f"{noise()} please write to {a} Miller about it {noise()}" for a in ("Anna", "Bert", "Carla")]
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts += [f'{noise()} token = "{key}" {noise()}', f"{noise()} his number 123-45-6789 {noise()}"]
    clean = [f"{noise()} in 1984 and 300 years later The Old House {noise()}" for _ in range(5)]
    rows = {r["doc_id"]: r["found"] for r in private.find_private(frame(spark, texts + clean)).collect()}
    got = {i: [(texts + clean)[i][x["start"] : x["end"]] for x in found if x["kind"] == "id"] for i, found in rows.items()}
    assert all(got[i] == [] for i in (*range(12), *range(24, 36), *range(len(texts), len(texts) + 5)))
    assert [got[12 + i] for i in range(12)] == [[f"555) 010-2{i:03d}"] for i in range(12)]
    assert [got[i] for i in (36, 37, 38)] == [["Anna Miller"], ["Bert Miller"], ["Carla Miller"]]
    assert (got[39], got[40]) == ([key], ["123-45-6789"])


def test_private_is_linear(spark):
    long = ["a" * 400_000, "1." * 200_000, "1 " * 200_000, "+1" * 200_000, "a@b." * 100_000, "@" * 400_000]
    assert private.find_private(frame(spark, long)).count() == 6


@pytest.mark.parametrize("n", [1, 7, 200, 255, 256, 700])
def test_simhash(spark, n):
    hashes = [RNG.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    got = lines.simhash(spark.createDataFrame([(1, "x", hashes)], "k long, more string, hashes array<long>"), ["k", "more"]).first()["sim"]
    assert got == sum(1 << p for p in range(63) if 2 * sum(h >> p & 1 for h in hashes) > n)


def test_line_groups(spark):
    rng = random.Random(8)
    long = [prose(rng, 80, 3000) for _ in range(60)]
    near = [" ".join("changed" if i == 7 else w for i, w in enumerate(x.split())) for x in long[:20]]
    texts = ["\n".join(long[:30]), "\n".join(long[30:] + ["Les!", "les"]), "\n".join([*near, "", "new line of its own here now"]), long[5].upper() + ".\nles ,"]
    got = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert (got[0]["n_removed"], got[1]["n_removed"], got[3]["n_removed"]) == (0, 1, 2)
    assert got[3]["text"] == ""
    assert got[2]["text"].endswith("\nnew line of its own here now")
    assert 10 <= got[2]["n_removed"] <= 20  # most lines with one word in eighty changed are close enough to be met


def test_pigeonhole_finds_all_close_hashes(spark):
    rng = random.Random(2)
    base = [rng.randrange(1 << 63) for _ in range(300)]
    near = [x ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 4))) for x in base]
    rows = spark.createDataFrame([(x,) for x in [*base, *near]], "sim long")
    pairs = {frozenset(r) for r in lines.candidates(rows, 600).collect()}
    assert {frozenset(x) for x in zip(base, near, strict=True)} <= pairs


def test_mix_takes_its_targets(spark):
    docs = common.table(spark, SF, "documents")
    queue = common.written(mixing.schedule(docs))
    rows = queue.collect()
    told = {r["doc_id"]: r["taken"] for r in registry.QUERIES["op4_mixing"](spark, SF).collect()}
    by, order = {}, []
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        order += [((r["start"] + r["size"] + e * r["source_size"]) / r["target"], r["source"], r["doc_id"], r["size"]) for e in range(2) if r["size"]]
    left, taken = math.floor(1.5 * sum(r["size"] for r in rows)), Counter()
    for _, _, doc, size in sorted(order):
        taken[doc] += min(size, left)
        left -= min(size, left)
    assert left == 0
    assert told == {r["doc_id"]: taken[r["doc_id"]] for r in rows}
    for source in by.values():
        near = sum(told[r["doc_id"]] for r in source)
        assert abs(near - source[0]["target"]) <= 2 * max(r["size"] for r in source)
    mix = mixing.mix(docs).collect()
    assert [r["finish"] for r in mix] == sorted(r["finish"] for r in mix)
    given = Counter()
    for r in mix:
        given[r["doc_id"]] += r["words"]
    assert all(given[d] == n for d, n in told.items())


@pytest.mark.parametrize("slots", [1, 3, 4096])
def test_cut_of_the_queue(spark, slots):
    rng = random.Random(slots)
    rows = [(i, rng.choice([0, 1, 5, 900]), rng.choice(["a", "b", "c", None])) for i in range(200)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    queue = mixing.schedule(docs).collect()
    order = sorted((((r["start"] + r["size"] + e * r["source_size"]) / r["target"], r["source"] is None, r["source"] or ""), r["size"]) for r in queue for e in range(2) if r["size"])
    left = math.floor(1.5 * sum(r["size"] for r in queue))
    for key, size in order:
        if left < size:
            break
        left -= size
    got = mixing.cut(mixing.schedule(docs), slots=slots).first()
    assert ((got["finish"], got["last"], got["source"] or ""), got["words"]) == (key, left)


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], "source string, source_size long")
    weights = {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    most = {"a": 20.0, "b": 2000.0, "c": 2000.0, None: 100.0}
    target, open_, left = {}, set(weights), 1.5 * 2060
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most[s]}
        if not over:
            target |= share
            break
        target |= {s: most[s] for s in over}
        left -= sum(most[s] for s in over)
        open_ -= over
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert all(math.isclose(got[s], target[s]) for s in weights)


def test_language_is_right_on_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    rows = [r for r in language_rows(spark) if r["held_out"]]
    assert len(rows) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.98


def language_rows(spark):
    return registry.QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()


def test_language_pieces_of_long_texts():
    rng = random.Random(1)
    text = "".join(rng.choice("abc é") for _ in range(3000))
    whole = np.sort(language.cells(text, 1 << 10))
    old, language.PIECE = language.PIECE, 700
    try:
        assert (np.sort(language.cells(text, 1 << 10)) == whole).all()
    finally:
        language.PIECE = old


def test_language_scores_against_plain_counts(spark):
    """Six hundred languages, fewer cells for them, and every document's posterior by plain sums."""
    common.bounded_batches(spark)
    rng = random.Random(13)
    rows = [(i, prose(rng, 12, 50 + i % 7), f"l{i % 600:03d}") for i in range(1200)] + [(5000, None, "l000"), (5001, "12 !", "l001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix, prior = model = language.fit(docs, most=1 << 18)
    assert len(langs) == 600
    assert matrix.size <= 1 << 18
    got = {r["doc_id"]: r for r in language.predict(docs, model, F.lit(False)).collect()}
    assert {got[5000]["lang_pred"], got[5001]["lang_pred"]} == {"und"}
    for i, text, _ in rows[:50]:
        log = matrix[language.cells(language.prepared(text), len(matrix) // 2)].sum(axis=0) + prior
        p = np.exp(log - log.max())
        assert math.isclose(got[i]["score"], (p / p.sum()).max(), rel_tol=1e-6)
        assert math.isclose(log[langs.index(got[i]["lang_pred"])], log.max(), rel_tol=1e-9)


@pytest.mark.parametrize(("hot", "rows"), [(1, 20), (3, 100)])
def test_passages_of_hot_anchors(spark, duck, hot, rows):
    common.bounded_batches(spark)
    same(passages.remove_repeats(common.table(spark, SF, "documents"), hot=hot, shard_rows=rows), duck.sql(passages.OP6_SQL))


def test_passages_of_few_words(spark):
    common.bounded_batches(spark)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(15, 90))) for _ in range(40)] + ["x " * 70, "x " * 30, None]
    got = {r["doc_id"]: r for r in passages.remove_repeats(frame(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        words, gone = (t or "").split(), set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone |= set(range(s, s + 20))
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def kneser_ney(trusted, order=4):
    """Mean negative log probability of a text by dictionaries of tuples."""
    read = lambda t: [0] * (order - 1) + perplexity.symbols(t).tolist()
    counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in map(read, trusted) for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, total, rest = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        off[k] = [0.0, *[min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i) if n[i] else i / 2 for i in (1, 2, 3)]]
        total[k], rest[k] = Counter(), Counter()
        for g, v in c.items():
            total[k][g[:-1]] += v
            rest[k][g[:-1]] += off[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / (1 << perplexity.WIDTH)
        k, below = len(g), p(g[1:])
        if not total[k][g[:-1]]:
            return below
        v = counts[k][g]
        return (v - off[k][min(v, 3)] + rest[k][g[:-1]] * below) / total[k][g[:-1]]

    return lambda t: -sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for s in [read(t)] for i in range(order - 1, len(s))) / len(t)


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_perplexity_of_every_document(spark, monkeypatch, piece):
    common.bounded_batches(spark)
    monkeypatch.setattr(perplexity.pieces, "__defaults__", (perplexity.ORDER, piece))
    rng = random.Random(1)
    texts = [prose(rng, 40, 60) for _ in range(40)] + ["é 漢字 漢字 12 7\t9 😀", "zz", "q", "", None]
    told = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "digest long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 41, 2)], "digest long")
    got = {r["digest"]: (r["n_symbols"], r["mean"]) for r in perplexity.scores(told, trusted, block=1000).collect()}
    brute = kneser_ney(texts[0:41:2])
    assert set(got) == {i for i, t in enumerate(texts) if t}
    for i, (n, mean) in got.items():
        assert n == len(texts[i])
        assert math.isclose(mean, brute(texts[i]), rel_tol=1e-9)


def test_perplexity_limits(spark):
    rows = [("a", float(i), float(i) + 0.5, i % 2 == 0) for i in range(100)] + [("b", 7.0, 8.0, True)]
    got = {r["lang"]: r for r in perplexity.limits(spark.createDataFrame(rows, "lang string, above double, below double, held boolean"), 0.1, 0.9, 0.5).collect()}
    assert set(got) == {"a", None}
    assert (got["a"]["low"], got["a"]["high"]) == (10.0, 89.0)


def test_quality_tells_junk(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in registry.QUERIES["op7_quality"](spark, sf).collect() if r["doc_id"] in labels]
    kept = {q: [r["kept"] for r in rows if labels[r["doc_id"]]["quality"] == q and labels[r["doc_id"]]["toxic"] == 0] for q in (0, 1)}
    assert sum(kept[1]) / len(kept[1]) > 0.997
    assert sum(kept[0]) / len(kept[0]) < 0.05


def grams(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize(("leaf", "chunk", "depth"), [(64, 1024, 4), (4, 16, 3)])
def test_classes_against_all_pairs(spark, leaf, chunk, depth):
    """Chains, near copies in a large group, exact copies, and a passage that many documents share."""
    common.bounded_batches(spark)
    rng = random.Random(6)
    shared, base = prose(rng, 60), prose(rng, 120).split()
    texts = [f"{shared} {prose(rng, 60)}" for _ in range(60)]
    texts += [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(0, 120, 2)] * 2
    chain = prose(rng, 60).split()
    texts += [" ".join(chain[2 * i : 2 * i + 45]) for i in range(7)] + ["tiny text", "tiny text", "", None]
    docs = frame(spark, texts)
    sets = [grams(t or "") for t in texts]
    links = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([root[i], *(root[j] for j in near)])
            changed |= low != root[i]
            root[i] = low
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(docs, leaf=leaf, chunk=chunk, depth=depth).collect()}
    assert got == {i: (root[i], len(links[i])) for i in range(len(texts))}


def test_recall_sets_the_runs():
    assert chosen_path.runs_for(0.8, 1, 0.99) == 3
    assert chosen_path.runs_for(0.8, 4, 0.99) > chosen_path.runs_for(0.8, 4, 0.9)


def test_templates(spark):
    bench = spark.createDataFrame([(1, "If Anna buys 12 apples and gives 12 apples to Bob within 3 hours, how many apples remain in the basket?"), (2, "a short one"), (3, "The quick zebra jumps over fences while reciting ancient poetry loudly")], "item_id long, text string")
    texts = [
        "Intro words. If Anna buys 12 apples and gives 12 apples to Bob within 3 hours, how many apples remain in the basket? Outro.",
        "if CLARA buys 7 apples and gives 7 apples to Dan within 5 minutes, how many apples remain in the basket",
        "so Clara buys 7 apples and gives 9 apples then",
        "the | quick | zebra | jumps | over | fences | while | reciting | ancient | poetry",
        "The quick zebra jumps over fences and sleeps",
        "nothing of the kind stands here at all, not even by chance or so",
    ]
    got = {r["doc_id"]: r for r in templates.decontaminate(frame(spark, texts), bench).collect()}
    assert [got[i]["contaminated"] for i in range(6)] == [True, True, False, True, False, False]
    assert (got[0]["items"], got[0]["changed_items"], got[1]["changed_items"], got[3]["items"]) == ("1", "", "1", "3")


def test_templates_find_every_whole_item(spark):
    docs, bench = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "benchmark")
    plain = lambda t: " ".join(re.sub(templates.PUNCTUATION, "", t).lower().split())
    texts, items = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}, {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in templates.matches(docs, bench).collect()}
    assert whole
    assert whole <= found
    assert len(found - whole) <= 0.05 * len(whole)


def test_automaton_statistics():
    rng = random.Random(7)
    for _ in range(20):
        patterns = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        text = [rng.randrange(4) for _ in range(40)]
        automaton = licenses.SuffixAutomaton(patterns)
        for i, (state, length) in enumerate(automaton.statistics(text)):
            best = max(k for k in range(i + 2) if k == 0 or any(text[i + 1 - k : i + 1] == p[j : j + k] for p in patterns for j in range(len(p))))
            assert length == best
            run = text[i + 1 - length : i + 1]
            for number, ends in automaton.ends[state].items() if length else ():
                assert ends == [j for j in range(length, len(patterns[number]) + 1) if patterns[number][j - length : j] == run]


def test_license_base(spark):
    common.bounded_batches(spark)
    pieces = ["under", "the", "MIT", "license", "Apache", "License,", "Version", "2.0", "2", "CC-BY-NC", "cc by", "nc", "x", "é", "license;Apache"]
    rng = random.Random(9)
    texts = [" ".join(rng.choice(pieces) for _ in range(80)) for _ in range(300)] + ["released UNDER the (MIT) license", None]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            here = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_license_templates(spark):
    common.bounded_batches(spark)
    label, text = licenses.NOTICES[1]
    broken = f"prose before. {text.upper().replace(', FREE OF CHARGE,', ' free of all charge')} and after"
    rows = licenses.scan_licenses(frame(spark, [broken, "permission is hereby granted", "all prose of no licence"])).collect()
    assert [r["labels"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [label, "", ""]


def test_every_notice_and_an_edited_copy(spark):
    """Each notice is found by its label, whole and with one word in ten changed."""
    common.bounded_batches(spark)
    rng = random.Random(23)
    edited = [" ".join("changed" if i % 10 == 7 else w for i, w in enumerate(text.split())) for _, text in licenses.NOTICES]
    texts = [f"{prose(rng, 9, 3000)} {t} {prose(rng, 9, 3000)}" for t in [*[t for _, t in licenses.NOTICES], *edited]]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    n = len(licenses.NOTICES)
    for i, (label, _) in enumerate(licenses.NOTICES):
        assert label in got[i]
        assert label in got[n + i]


def test_threshold_search_stops_early():
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((3000, 4)) * 1000).astype(np.int64)
    rows[5] = [9000, 9000, 9000, 9000]
    down = np.argsort(-rows, axis=0, kind="stable").T.copy()
    ids = np.arange(3000)
    for q in (np.array([1, 1, 1, 1]), np.array([-3, 0, 2, 5]), np.zeros(4, dtype=np.int64)):
        found, score = topk.threshold_search(ids, rows, q, 17, 10, down)
        every = [(-int(s), int(i)) for i, s in zip(ids, rows @ q, strict=True) if i != 17]
        assert sorted(zip((-score).tolist(), found.tolist(), strict=True)) == sorted(every)[:10]
        floor = -sorted(every)[4][0]
        found, score = topk.threshold_search(ids, rows, q, 17, 10, down, floor)
        assert sorted(zip((-score).tolist(), found.tolist(), strict=True)) == [x for x in sorted(every)[:10] if -x[0] >= floor]


@pytest.mark.parametrize("shard_rows", [7, 2048])
def test_repeated_vectors(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(5)]) for i in range(60)]
    rows += [rows[3]] * 12 + [(70, rows[3][1]), (100, rows[9][1]), (None, rows[5][1]), (71, None), (72, [1.0, None, 0.0, 0.0, 0.0]), (73, [float("nan")] * 5)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scaled = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows[:60] + [(70, rows[3][1]), (100, rows[9][1])]}
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_pipeline_stages(spark, tmp_path):
    """Each stage does to its own input what its operator says."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf))
        before, after = docs.count(), out.count()
        if name == "quality":
            assert after == registry.QUERIES["op7_quality"](spark, sf).filter("kept").count()
        elif name == "lines":
            assert out.join(docs, "doc_id").filter(F.length(out["text"]) > F.length(docs["text"])).isEmpty()
        elif name == "near_duplicates":
            assert after == chosen_path.jaccard_classes(docs).select("class_id").distinct().count()
        elif name == "decontaminated":
            assert after == before - templates.matches(docs, common.table(spark, sf, "benchmark")).select("doc_id").distinct().count()
            assert templates.matches(out, common.table(spark, sf, "benchmark")).isEmpty()
        else:
            assert out.select("doc_id").distinct().count() <= before
            continue
        assert out.columns == columns
        assert out.join(docs, "doc_id", "left_anti").isEmpty()
        docs = out


def removed_copies(spark, lines_, copies):
    """How many of the copies, one in a document after the lines' own, are removed."""
    rows = lines.dedup_lines(frame(spark, ["\n".join(lines_), *copies])).collect()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] == 0)
    return sum(r["n_removed"] for r in rows)


@pytest.mark.parametrize("n", [5, 10, 30, 60])
def test_lines_at_the_threshold_are_met(spark, n):
    rng = random.Random(n)
    base = [prose(rng, n, 3000).split() for _ in range(60)]
    copies = []
    for i, words in enumerate(base):
        gone = set(rng.sample(range(n), n // 5))
        copies.append(" ".join(f"other{i}x{j}" if j in gone else w for j, w in enumerate(words)))
    assert removed_copies(spark, [" ".join(x) for x in base], copies) >= 58


def test_lines_with_one_word_changed_are_met(spark):
    rng = random.Random(21)
    for n in (10, 20, 30, 80):
        base = [prose(rng, n, 3000).split() for _ in range(100)]
        copies = [" ".join("changed" if j == i % n else w for j, w in enumerate(x)) for i, x in enumerate(base)]
        assert removed_copies(spark, [" ".join(x) for x in base], copies) >= 98


def test_bitmaps_leave_no_similar_pair_out(spark):
    """Pairs at all similarities: those that the exact edit similarity passes pass the bitmaps too, and few of the others do."""
    rng = random.Random(8)
    rows = []
    for n in (5, 10, 31, 64, 120):
        for edits in range(0, n, max(1, n // 10)):
            for _ in range(5):
                a = [f"w{rng.randrange(4000)}" for _ in range(n)]
                b = list(a)
                for _ in range(edits):
                    i = rng.randrange(len(b))
                    b[i : i + rng.choice((0, 1, 1, 1))] = rng.choice(([], [f"w{rng.randrange(4000)}"]))
                    b = b or ["w"]
                rows.append((" ".join(a), " ".join(b)))
    rows += [(" ".join(f"a{rng.randrange(4000)}" for _ in range(40)), " ".join(f"b{rng.randrange(4000)}" for _ in range(40))) for _ in range(50)]
    two = spark.createDataFrame(rows, "a string, b string")
    words = {c: lines.words_of(F.col(c)) for c in "ab"}
    sides = [F.struct(F.size(w).alias("n"), *lines.bitmaps(F.transform(w, lambda x: F.xxhash64(x)))) for c, w in words.items()]
    told = two.select(lines.similar(lines.coded(words["a"]), lines.coded(words["b"])).alias("is"), *[x.alias(n) for x, n in zip(sides, "xy")]).select("is", lines.may_be_similar("x", "y").alias("may")).collect()
    assert sum(r["is"] for r in told) > 50
    assert all(r["may"] for r in told if r["is"])
    assert not any(r["may"] for r in told[-50:])


def test_similar_long_lines_always_share_an_anchor(spark):
    """A fifth of the words changed, everywhere and where it breaks most: none may be missed, in lines longer than any sketch."""
    rng = random.Random(31)
    rows = []
    for n in (5, 6, 9, 14, 40, 97, 160):
        for i in range(12):
            a = prose(rng, n, 3000).split()
            most = n // 5
            at = sorted(rng.sample(range(n), most)) if i % 2 else [1 + j * (n - 1) // most for j in range(most)]
            b = [w if j not in at else f"longerwordthanothers{i}x{j}" for j, w in enumerate(a)]
            rows.append((" ".join(a), " ".join(b)))
            most = int((n + most) * 0.2 + 1e-9)  # words added alone
            b = list(a)
            for j in sorted(rng.sample(range(1, n), min(most, n - 1)), reverse=True):
                b[j:j] = [f"longerwordthanothers{i}x{j}"]
            rows.append((" ".join(a), " ".join(b)))
    two = spark.createDataFrame(rows, "a string, b string")
    heavy = F.split(F.lit(",".join(str(0x5555 << 3 * (i % 9)) for i in range(1 << lines.HEAVY_BITS - 6))), ",").cast("array<long>")
    words = {c: lines.words_of(F.col(c)) for c in "ab"}
    told = two.select(lines.similar(lines.coded(words["a"]), lines.coded(words["b"])).alias("is"), F.arrays_overlap(*[lines.anchors(w, heavy) for w in words.values()]).alias("meet")).collect()
    assert sum(r["is"] for r in told) > 120
    assert all(r["meet"] for r in told if r["is"])


def test_copies_of_a_line_and_lines_around_a_passage_make_few_pairs(spark):
    """Near copies are joined by stars, and lines that share a passage alone aren't similar by their bitmaps."""
    rng = random.Random(32)
    base = prose(rng, 50, 3000).split()
    copies = [" ".join(w if rng.random() > 0.08 else f"new{i}x{j}" for j, w in enumerate(base)) for i in range(150)]
    passage = prose(rng, 40, 3000)
    around = [f"{prose(rng, 10, 3000)} {passage} {prose(rng, 10, 3000)}" for _ in range(150)]
    counts = []
    met = lines.met
    lines.met = lambda *a, **k: counts.append((out := met(*a, **k)).count()) or out
    try:
        removed = removed_copies(spark, [" ".join(base)], copies)
        assert removed == 150
        assert removed_copies(spark, [around[0]], around[1:]) == 0
    finally:
        lines.met = met
    assert sum(counts) < 1000


def test_lines_that_share_pairs_of_words_by_chance_are_not_listed(spark):
    """Runs of two of few words stand in most lines: lists of them grow with the square of the lines. Copies are met all the same."""
    rng = random.Random(41)
    base = [prose(rng, n, 150).split() for n in [30] * 300 + [7] * 20]
    copies = [" ".join("changed" if j == len(x) // 2 else w for j, w in enumerate(x)) for x in base[-40:]]
    listed, nodes = lines.listed, []
    lines.listed = lambda *a, **k: (out := listed(*a, **k), nodes.extend(x.select("node") for x in out), counts.append(lines._union_all(nodes).distinct().count()))[0]
    counts = []
    try:
        assert removed_copies(spark, [" ".join(x) for x in base], copies) == 40
    finally:
        lines.listed = listed
    assert counts[0] < 200


@pytest.mark.parametrize("least, run", [(2, 2), (6, 3)])
def test_runs_that_similar_lines_always_share(spark, least, run):
    """From so many words on a run is left by whatever edits; with one word less edits can break all."""
    assert lines.least_words_of(run) == least
    whole = lambda n: n - run + 1 > run * int(0.2 * n + 1e-9)
    assert all(whole(n) for n in range(max(least, run), 400))


def test_long_lines_in_another_order_are_kept(spark):
    words = [f"word{i}number" for i in range(2400)]
    assert removed_copies(spark, [" ".join(words)], [" ".join(words[::-1]), " ".join(["other"] * 40 + words[40:])]) == 1


def test_lines_of_crowded_buckets_are_all_met(spark):
    """Hashes of one bucket in an order that keeps each line's copy away from it, more lines than a block holds."""
    rng = random.Random(1)
    base = [f"every line begins alike {prose(rng, 16, 3000)}".split() for _ in range(600)]
    copies = [" ".join(w if j % 5 != 4 else f"new{i}x{j}" for j, w in enumerate(x)) for i, x in enumerate(base)]
    assert removed_copies(spark, [" ".join(x) for x in base], copies) >= 594


def test_lines_of_equal_hash_are_compared_with_each_other(spark):
    """Long words, which alone vote, are the same in all lines; short ones tell them apart but for pairs."""
    rng = random.Random(5)
    long = ["constant", "wording", "throughout", "template", "columns"]
    base = [[*long, *[f"{rng.randrange(36**3):03x}"[:4] for _ in range(15)]] for _ in range(20)]
    copies = [" ".join([*x[:12], "zz", *x[13:]]) for x in base]
    assert removed_copies(spark, [" ".join(x) for x in base], copies) == 20


def test_templates_of_items_with_few_literals(spark):
    items = ["a short one", "The Quick Zebra Jumps Over Seven Fences", "Is 5 km or 3 miles 8 feet longer?", "Add 3 kg 40 g 7 lb 9 oz 12 mg 2 l of water and then boil everything slowly", "何が一番大きいですか", "12"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Some prose before. {x} And after" for x in items]
    texts += ["here the quick zebra jumps over nine fences", "then add 4 kg 50 g 8 lb 6 oz 11 mg 5 l of water and then boil everything", "is 6 km or 4 miles 9 feet longer", "a shorter one, a short two", None]
    got = {r["doc_id"]: r["items"] for r in templates.decontaminate(frame(spark, texts), bench).collect()}
    assert got == {0: "0", 1: "1", 2: "2", 3: "3,5", 4: "4", 5: "5", 6: "1", 7: "3", 8: "", 9: "", 10: ""}


@pytest.mark.parametrize("hot", [1, 20_000])
def test_passages_of_rows_without_an_id_of_their_own(spark, hot):
    common.bounded_batches(spark)
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 40, 3000) for _ in range(4))
    texts = [(1, a), (2, f"{b} {b}"), (5, a), (5, c), (None, d), (None, f"{c} {d[:9]}"), (None, a), (None, None)]
    rows = passages.remove_repeats(frame(spark, texts), hot=hot).collect()
    got = sorted(((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in rows))
    n = len(f"{c} {d[:9]}".split())
    assert got == sorted([(1, 40, 0), (2, 80, 40), (5, 40, 40), (5, 40, 0), (99, 40, 0), (99, n, 40), (99, 40, 40), (99, 0, 0)])


def test_pipeline_drops_copies_without_an_id(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c = (prose(rng, 40, 3000) for _ in range(3))
    out = corpus_pipeline.near_duplicates(spark, frame(spark, [(1, a), (None, a), (None, b), (None, b), (None, c), (None, None)]), SF)
    assert sorted((r["doc_id"] or 99, r["text"] or "") for r in out.collect()) == sorted([(1, a), (99, b), (99, c), (99, "")])
