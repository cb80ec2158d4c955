"""Small corpora."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    """Documents of the given texts (or (id, text) pairs)."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'xyz'[i % 3] * (i % 5)}" for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))
