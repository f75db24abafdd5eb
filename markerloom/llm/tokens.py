"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Vocabulary of the byte-level BPE; the folder is a parameter of every operator that measures texts.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how this vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(name: str, raw: bytes):
    """The tokenizer, kept for the life of the Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def load_encoding(path: str):
    return _encoding(os.path.basename(path), _vocabulary(path))


def _count_task(keep: list[str], name: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name, shared.value)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("measured_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return run


def token_counts(docs: DataFrame, keep: Sequence[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` with ``tokens``, the length of the whole text; null and empty texts have 0. Strings of special tokens are ordinary text.

    The vocabulary is read where the plan is made and sent along (about a megabyte), so workers need no file.
    """
    keep = list(keep)
    types = dict(docs.select(*keep).dtypes)
    work = spread(docs.select(*keep, F.col(text).alias("measured_text")))
    return work.mapInArrow(_count_task(keep, os.path.basename(vocabulary), docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))), ", ".join([*[f"`{k}` {types[k]}" for k in keep], "tokens BIGINT"]))
