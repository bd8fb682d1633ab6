"""Sets of word shingles as 64-bit hashes, over Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from careflow.llm.common import mixed

STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words, A-Z in lower case, and each text's end among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    codes = coded.indices.to_numpy(zero_copy_only=False)[real]
    ends = np.cumsum(np.bincount(owner[real], minlength=len(counts)))
    return (known[codes] if len(known) else np.zeros(0, np.uint64)), ends


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words make one shingle, no words none."""
    words, ends = hashed_words(texts)
    long = words
    for i in range(1, size):
        long = mixed(long[:-1] * STEP + words[i:]) if len(long) else long
    out, begin = [], 0
    for end in ends.tolist():
        if end - begin >= size:
            out.append(np.unique(long[begin : end - size + 1]))
        elif end > begin:
            h = words[begin : begin + 1]
            for i in range(begin + 1, end):
                h = mixed(h * STEP + words[i : i + 1])
            out.append(mixed(h + np.uint64(end - begin)))
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out
