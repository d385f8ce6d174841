"""The registered queries: SQL, stable columns, and the pipeline against brute force."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import compare, duck_rows, spark_rows
from trapline.llm import queries
from test_llm_duplicates import brute_components, brute_passages

COLUMNS = {
    "op1_": ["page_id", "host", "path", "rule", "verdict"],
    "op2_": ["query_id", "rank", "vec_id", "score"],
    "op3_": ["doc_id", "item_id", "window", "matched"],
    "op4_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_": ["doc_id", "n_tokens", "log_probability", "per_token"],
    "op6_": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_": ["doc_id", "line_no", "first_doc", "first_line"],
    "op8_": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_": ["doc_id", "held_out", "score", "predicted"],
    "op10_": ["doc_id", "n_shingles", "component_id"],
    "op13_": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op11_": ["page_id", "url", "text", "n_chars"],
    "op12_": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


def test_one_query_for_each_operator():
    assert sorted(queries.QUERIES) == sorted(next(n for n in queries.QUERIES if n.startswith(p)) for p in COLUMNS)
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    wanted = COLUMNS[re.match(r"op\d+_", name)[0]]
    assert got.columns[: len(wanted)] == wanted
    rows = spark_rows(got)
    assert rows[1]
    if name in queries.ORACLES:
        assert compare(rows, duck_rows(folder, queries.ORACLES[name])) is None


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = corpus_pipeline.identify_language(spark, docs, folder)
    assert kept.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    read = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, _ in read)
    single = corpus_pipeline.join_near_duplicates(spark, kept, folder)
    assert single.columns == docs.columns
    groups = brute_components(read)
    left = sorted(set(groups.values()))
    assert sorted(r["doc_id"] for r in single.collect()) == left
    clean = corpus_pipeline.decontaminate_benchmark(spark, single, folder)
    assert clean.columns == docs.columns
    bad = {i for i, *_ in brute_passages([(i, t) for i, t in read if i in set(left)], items)}
    assert bad and sorted(r["doc_id"] for r in clean.collect()) == sorted(set(left) - bad)
    mixed = corpus_pipeline.mix_sources(spark, clean, folder)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(left) - bad


def test_stages_keep_what_they_cannot_judge(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long"
    texts = [f"a clean document of several words number {i} and nothing else at all" for i in range(20)]
    docs = spark.createDataFrame([(i, t, None, "a", 1, 5) for i, t in enumerate(texts)] + [(30, "12 34", None, "a", 1, 5)], schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()) == list(range(20))
    apart = ["one text about a fox that sleeps", "another text, on owls and their nests", "one text about a fox that sleeps"]
    docs = spark.createDataFrame([(1, t, None, "a", 1, 5) for t in apart] + [(2, apart[1], None, "a", 1, 5), (1, None, None, "a", 1, 5), (1, None, None, "a", 1, 5)], schema)
    left = corpus_pipeline.join_near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == [(1, ""), (1, apart[1]), (1, apart[0])]


def test_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    rows = got.collect()
    assert rows and {r["shard"] for r in rows} == set(range(8))
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(0, "one two three four five six seven eight", 1)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "words of a text", "en", "a", 9), (1, "words of a text", "en", "a", 9), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id at all", "en", "b", 1), (4, "Words of a TEXT", None, "b", 3), (5, "one two three four five six seven eight nine", "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for extra in ("component_id long", "shard int", "lang_pred string", "seed long"):
        name = extra.split()[0]
        docs = spark.createDataFrame([(*r, None) for r in rows], f"{schema}, {extra}")
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[-1] == name
        assert {r["doc_id"] for r in docs.collect()} <= {1, None}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
