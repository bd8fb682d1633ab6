"""Token ids of documents in compressed files, in the order of their ids, and back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from careflow.llm.common import slices, small, text_key, written
from careflow.llm.rangecoder import BLOCK, LANES, read_chunk, write_chunk
from careflow.llm.tokens import encoder
from careflow.session import shared_path

END_ID, VOCABULARY = 2, 50_257
# A chunk closes after the document that reaches this many ids.
CHUNK = BLOCK * LANES

CHUNKS = "part bigint, chunk bigint, doc_ids array<bigint>, lengths array<bigint>, ids binary"


def code_texts(path: str, end_id: int, vocabulary: int, chunk: int):
    """Sorted Arrow batches of (doc_id, text) to chunks of whole documents."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    lists = pa.list_(pa.int64())

    def run(batches):
        own, part, number = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            columns = [
                pa.array([part]), pa.array([number]), pa.array([doc_ids], lists), pa.array([np.concatenate(lengths)], lists),
                pa.array([write_chunk(np.concatenate(held), vocabulary)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches, "text"):
            ids, counts = own.arrays(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            ends, at, before = np.cumsum(counts), 0, 0
            while at < len(counts):
                # Up to the document that makes the chunk full, or all.
                to = min(len(counts), int(np.searchsorted(ends, before + chunk - size)) + 1)
                upto = int(ends[to - 1])
                doc_ids += batch.column("doc_id").slice(at, to - at).to_pylist()
                lengths.append(counts[at:to])
                held.append(ids[before:upto])
                size += upto - before
                at, before = to, upto
                if size >= chunk:
                    yield close()
                    doc_ids, lengths, held, size, number = [], [], [], 0, number + 1
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, vocabulary: int = VOCABULARY, chunk: int = CHUNK) -> None:
    """Writes every document's ids and `end_id` to the folder `path`.

    Documents are range-partitioned by doc_id, nulls first, equal ids by text; each file holds
    the chunks of one range in order. Null text is empty.
    """
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "__key"]
    ranged = wanted.withColumn("__key", text_key(F.col("text"))).repartitionByRange(*order).sortWithinPartitions(*order)
    coded = ranged.select("doc_id", "text").mapInArrow(code_texts(tokenizer, end_id, vocabulary, chunk), CHUNKS)
    coded.write.option("compression", "none").parquet(path)


DIGESTS = "part bigint, chunk bigint, nth bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def decode_chunks(batches):
    """Arrow batches of chunks to a row per document, with the ids before it in the chunk."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            data = read_chunk(row["ids"])
            ends = np.cumsum(row["lengths"], dtype=np.int64)
            begins = ends - row["lengths"]
            if len(data) != (int(ends[-1]) if len(ends) else 0):
                raise ValueError("a chunk holds other than its documents' ids")
            checks = [zlib.crc32(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            n = len(ends)
            columns = [[row["part"]] * n, [row["chunk"]] * n, range(n), row["doc_ids"], begins, row["lengths"], checks]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    rows = written(chunks.mapInArrow(decode_chunks, DIGESTS), "id-digests")
    sums = rows.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n"))
    # One row per file, so the window over all of them is small; chunks are numbered within it.
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "chunk", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("chunk_start"))
    starts = small(written(starts.join(parts, "part"), "id-starts"), 40)
    start = F.col("part_start") + F.col("chunk_start") + F.col("before")
    return rows.join(starts, ["part", "chunk"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def coded_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, vocabulary: int = VOCABULARY) -> DataFrame:
    """Writes the ids of `docs` and reads them back: doc_id, start, n_tokens, ids_crc32 per document.

    Null or empty text is the end id alone. Repeated rows are written each. No rows give no
    rows; columns other than doc_id and text are not read.
    """
    path = shared_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id, vocabulary)
    return read_digests(docs.sparkSession, path)
