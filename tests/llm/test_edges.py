"""Defined results for nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from mendspan.llm import chosen_path, common, language, licenses, lines, mixing, passages, perplexity, private, templates, topk

N = 15


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "What does the baker of Rome sell for 5 dollars every day now"), (2, None), (None, "short"), (3, "")], "item_id long, text string")


def operators(spark, bench, docs):
    ids = spark.createDataFrame([(1,), (None,), (6,)], "doc_id long")
    flag = language.held_out(docs["doc_id"])
    return {
        "private": lambda: private.find_private(docs),
        "lines": lambda: lines.dedup_lines(docs),
        "mixing": lambda: mixing.schedule(docs),
        "language": lambda: language.predict(docs, language.fit(docs.filter(~flag)), flag),
        "passages": lambda: passages.remove_repeats(docs),
        "perplexity": lambda: perplexity.classify(docs, ids),
        "chosen_path": lambda: chosen_path.jaccard_classes(docs),
        "templates": lambda: templates.decontaminate(docs, bench),
        "licenses": lambda: licenses.scan_licenses(docs),
    }


NAMES = ["private", "lines", "mixing", "language", "passages", "perplexity", "chosen_path", "templates", "licenses"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, bench, empty, name):
    common.bounded_batches(spark)
    assert operators(spark, bench, empty)[name]().count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_one_row_each(spark, bench, odd, name):
    common.bounded_batches(spark)
    rows = operators(spark, bench, odd)[name]().collect()
    assert len(rows) == N
    assert sum(r["doc_id"] is None for r in rows) == 2


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_defined_results(spark, bench, odd):
    common.bounded_batches(spark)
    found = {k: by_id(v()) for k, v in operators(spark, bench, odd).items()}
    assert all(found["private"][i]["found"] == [] for i in (3, 4, 5))
    assert (found["lines"][3]["text"], found["lines"][3]["n_lines"]) == (None, 0)
    assert found["lines"][2]["text"] == ""  # its one line stands in document 1
    assert found["lines"][10]["n_removed"] == 49
    assert found["mixing"][3]["size"] == 0
    assert all((found["language"][i]["lang_pred"], found["language"][i]["score"]) == ("und", 0.0) for i in (3, 4, 5, 12))
    assert (found["passages"][2]["n_removed"], found["passages"][2]["n_words"]) == (120, 120)
    assert (found["passages"][3]["n_words"], found["passages"][9]["n_removed"]) == (0, 0)
    assert found["passages"][7]["n_removed"] == 60_000
    assert [found["perplexity"][i]["kept"] for i in (3, 4, 5)] == [False] * 3
    classes = found["chosen_path"]
    assert (classes[2]["class_id"], classes[7]["class_id"], classes[9]["class_id"], classes[3]["class_id"]) == (1, 6, 9, 3)
    assert classes[1]["n_links"] == 3
    assert not any(r["contaminated"] for r in found["templates"].values())
    assert (found["licenses"][3]["n_words"], found["licenses"][3]["labels"], found["licenses"][3]["score"]) == (0, "", 0.0)


def test_nothing_to_learn_from(spark, odd):
    common.bounded_batches(spark)
    none = spark.createDataFrame([], "doc_id long")
    kept = by_id(perplexity.classify(odd, none))
    assert kept[6]["kept"]
    assert not kept[4]["kept"]
    assert perplexity.trusted(spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, 1, 1), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")).collect() == [(4,)]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, None), (None, [1.0, 1.0]), (7, [-1.0, 0.0]), (8, [1.0]), (8, [1.0]), (9, []), (100, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("scaled", F.lit(1))
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=2).collect()))
    assert got == [(0, 1, 1, 1024**2 + 512**2), (0, 2, 2, 1024**2 + 512**2), (100, 1, 0, 0), (100, 2, 1, 0)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "What does the baker of Rome sell for 5 dollars every day now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {1, 6}
    odd.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
