"""The pipeline against its stages' decisions worked out apart."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from careflow.llm.additive import quality
from careflow.llm.common import read
from careflow.llm.contamination import contamination
from careflow.llm.jaccard import near_duplicates
from careflow.llm.surrogates import surrogates
from tests.llm.conftest import SMALL


def test_run_applies_every_stage(spark, tmp_path):
    docs = read(spark, SMALL, "documents")
    scored = quality(docs, read(spark, SMALL, "labels")).where("predicted = 1")
    kept = docs.join(scored.select("doc_id"), "doc_id").select(docs.columns)
    kept = kept.join(near_duplicates(kept).where("doc_id = component_id").select("doc_id"), "doc_id").select(docs.columns)
    kept = kept.join(contamination(kept, read(spark, SMALL, "benchmark")).where("not contaminated").select("doc_id"), "doc_id")
    texts = {r.doc_id: r.text for r in surrogates(kept.select(docs.columns)).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for i, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            want.add((doc_id, i, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert 100 < len(texts) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = read(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(30), SMALL)
        assert out.dtypes == docs.dtypes
    assert [name for name, _ in corpus_pipeline.STAGES].__len__() == 5


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, no rows, and columns named like those the stages add."""
    plain = read(spark, SMALL, "documents").limit(40)
    clash = ["__quality", "__id", "__key", "__rows", "__stay", "__found", "__rid", "__entities", "rid", "score", "key", "component"]
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", None, 0), (-1, None, None, "s", 0), (-2, "", "", "", 0),
         (-3, "x@y.example.com", "en", "s", 15), (-3, "x@y.example.com", "en", "s", 15)],
        plain.schema,
    )
    docs = plain.unionByName(odd).unionByName(plain.limit(5)).withColumns({c: F.lit("x") for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if stage is not corpus_pipeline.pack_sequences:
            assert after.dtypes == docs.dtypes and 0 < after.count() <= docs.count()
            if stage is corpus_pipeline.replace_entities:
                assert after.count() == docs.count()
            docs = after
    assert after.select("doc_id", "piece").count() >= docs.count()
