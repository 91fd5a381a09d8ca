"""The pipeline's stages on small tables."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_one_after_the_other(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        f(spark, docs, sf).write.parquet(f"{tmp_dir}/{n}")
        docs = spark.read.parquet(f"{tmp_dir}/{n}")
        after = sorted((r["doc_id"], r["text"]) for r in docs.collect()) if name != "encode" else None
        if name != "encode":
            assert docs.columns == columns
        if name == "language_id":
            assert set(after) <= set(before) and len(after) > 0.95 * len(before)
        elif name == "line_dedup":
            assert [d for d, _ in after] == sorted(d for d, _ in before)
            assert all(len(t) <= len(dict(before)[d]) for d, t in after)
        elif name == "simhash":
            assert [d for d, _ in after] == sorted({c for *_, c in brute.simhash(before)})
        elif name == "decontaminate":
            assert [d for d, _ in after] == sorted(x[0] for x in brute.decontaminate(before, items) if not x[-1])
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sorted(map(tuple, docs.collect())) == sorted(brute.bpe(before, library))


def test_odd_and_empty_tables(spark, tmp_dir):
    r = random.Random(1)
    text = " ".join(r.choices(["the", "there", "of"], k=60))
    rows = [(1, text, "en", "s", 1, "x"), (1, text, "en", "s", 1, "x"), (2, None, "en", "s", None, None), (3, "123 456", None, None, 7, None),
            (None, "quite another text without an id", "en", "s", 3, "x"), (5, "", "en", "s", 0, "x"), (9, "und noch ein anderer text ohne mehr", "de", "s", 3, "x")]
    spark.createDataFrame([(1, "unlike all " * 12)], "item_id bigint, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], COLUMNS)
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, tmp_dir)
            out.write.parquet(f"{tmp_dir}/{n}-{name}")
            if name != "encode":
                assert out.columns == docs.columns
                docs = spark.read.parquet(f"{tmp_dir}/{n}-{name}")
        kept = [r["doc_id"] for r in spark.read.parquet(f"{tmp_dir}/{n}-encode").collect()]
        assert sorted(kept, key=str) == ([1, 9, None] if n else [])


def test_run_keeps_the_contract(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < out.count() < 200
