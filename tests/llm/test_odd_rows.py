"""Odd rows and empty tables through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from sessionlore.llm import decontaminate, hyperminhash, language_id, line_dedup, lm_score, passage_dedup
from sessionlore.llm import piece_codec, secret_scan, token_counts, vector_dedup

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Hello WORLD"), (1, "Hello WORLD"), (None, "0123456789abcdef0123"), (2, None), (3, "...")],
                                 "item_id long, text string")


OPERATORS = {
    "lm": lambda d, i: lm_score.score_documents(d, PIECES, learn=F.col("doc_id") < 6, kind="lang"),
    "counts": lambda d, i: token_counts.count_tokens(d, BYTES),
    "language": lambda d, i: language_id.identify(d, language_id.train(d)),
    "passages": lambda d, i: passage_dedup.remove_passages(d),
    "near": lambda d, i: hyperminhash.near_duplicates(d),
    "secrets": lambda d, i: secret_scan.scan(d),
    "lines": lambda d, i: line_dedup.mark_lines(d),
    "codec": lambda d, i: piece_codec.encode_decode(d, PIECES),
    "benchmark": lambda d, i: decontaminate.match_benchmark(d, i),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(odd, none, items, name):
    assert len(OPERATORS[name](odd, items).collect()) == 12
    assert OPERATORS[name](none, items.limit(0)).collect() == []


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect() if r["doc_id"] is not None}


def test_values_of_odd_rows(odd, items):
    near = by_id(OPERATORS["near"](odd, items), "n_shingles", "component_id", "kept")
    assert near[2] == (0, 2, True) and near[3] == (0, 3, True) and near[6] == (2, 5, False) and near[8] == (1, 8, True)
    cut = by_id(OPERATORS["passages"](odd, items), "n_words", "n_removed", "kept")
    assert cut[6] == (10000, 10000, "") and cut[5][:2] == (10000, 0) and cut[2] == (0, 0, "")
    found = by_id(OPERATORS["benchmark"](odd, items), "n_words", "n_hit", "items")
    assert found[1] == (4, 2, ["1"]) and found[8] == (1, 1, []) and found[2] == (0, 0, [])
    told = by_id(OPERATORS["language"](odd, items), "lang_pred")
    assert told[2] == told[3] == told[9] == ("und",) and told[1] == ("en",)
    spans = {k: [tuple(s) for s in v[0]] for k, v in by_id(OPERATORS["secrets"](odd, items), "spans").items()}
    assert spans[1] == [(13, "assign", 39)] and spans[8] == [(0, "hex", 20)] and spans[2] == []
    scores = by_id(OPERATORS["lm"](odd, items), "n_tokens", "held_out")
    assert scores[2] == (1, False) and scores[8] == (2, True)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, odd, none, items, stage, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, odd, str(tmp_path)).columns == odd.columns
    rows = stage(spark, odd, str(tmp_path)).collect()
    assert 0 < len(rows) <= 12 and all(r["items"] == ["z"] and r["score"] == 0.5 for r in rows)
    assert stage(spark, none, str(tmp_path)).collect() == []


def test_last_stage(spark, odd, none, tmp_path):
    last = corpus_pipeline.STAGES[-1][1]
    rows = last(spark, odd, str(tmp_path)).collect()
    assert len(rows) == 12 and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert last(spark, none, str(tmp_path)).collect() == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e200, 1e190]), (11, [-1.0, 0.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = vector_dedup.link_vectors(table).collect()
    assert len(got) == len(rows)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert found[1] == (3, 1, True) and found[2] == (3, 1, False) and found[10] == (3, 1, False)
    assert found[None] == (0, None, True)
    assert all(found[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11))
    assert vector_dedup.link_vectors(table.limit(0)).collect() == []


def test_near_duplicates_tell_texts_that_share_an_id_apart(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue"))
    close = two.replace("blue39", "changed")
    rows = [(1, one), (1, two), (2, one), (3, close), (4, two), (1, one), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = hyperminhash.near_duplicates(docs, percent=80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [
        (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True), (5, 5, True)]
    kept = [tuple(r) for r in hyperminhash.keep_first(docs, percent=80).collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (1, two), (5, None), (5, "")], key=str)
    apart = spark.createDataFrame([(0, two), (1, one), (1, close)], "doc_id long, text string")
    assert sorted(map(tuple, hyperminhash.keep_first(apart, percent=80).collect())) == [(0, two), (1, one)]


def test_long_texts_of_many_lines(spark):
    shared = "a line that many of these documents share"
    body = "\n".join(f"{shared} {k % 50}" if k % 2 else f"line {k} is found in one document only" for k in range(20_000))
    docs = spark.createDataFrame([(i, body.replace("one", f"one{i}")) for i in range(3)], "doc_id long, text string")
    found = {r.doc_id: (r.n, r.kept) for r in line_dedup.mark_lines(docs).select(
        "row.doc_id", F.size("all_lines").alias("n"), F.size("kept_lines").alias("kept")).collect()}
    assert found == {0: (20_000, 10_000), 1: (20_000, 10_000), 2: (20_000, 20_000)}
