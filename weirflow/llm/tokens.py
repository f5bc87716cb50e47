"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Default vocabulary: ranks of a byte-level BPE. Executors look for it at this path, else for a file of its name shipped by ship(); pass another path to use another file.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the public pattern that splits text before the merges of such rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship(spark: SparkSession, path: str = RANKS) -> str:
    """Sends a rank file from the driver to all executors, which need not have it; returns the path to name."""
    spark.sparkContext.addFile(path)
    return path


def _found(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def encoding(path: str = RANKS):
    """The tokenizer of a rank file; one per Python worker."""
    import tiktoken

    with open(_found(path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str = RANKS) -> np.ndarray:
    """The number of bytes of each token."""
    coder = encoding(path)
    return np.array([len(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)], np.int64)


def token_counts(df: DataFrame, doc_id: str, text: str, path: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every row; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for b in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def piece_bytes(path: str = RANKS):
    """For mapInArrow: doc_id, pieces (first_token, n_tokens), text and n_overfull to doc_id, the bytes of all tokens in the pieces, n_overfull."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, size = encoding(path), token_bytes(path)
        for b in batches:
            out = []
            for t, pieces in zip(b["text"].to_pylist(), b["pieces"].to_pylist()):
                each = size[np.array(coder.encode_ordinary(t or ""), np.int64)]
                # a token that two pieces had would count twice
                out.append(int(sum(each[p["first_token"] : p["first_token"] + p["n_tokens"]].sum() for p in pieces)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.int64()), b["n_overfull"]], names=["doc_id", "n_bytes", "n_overfull"])

    return run
