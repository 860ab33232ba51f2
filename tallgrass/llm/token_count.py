"""Token counts by a compiled finite-state tokenizer (operator 7).

The vocabulary is compiled into a deterministic transducer whose transitions
carry the number of tokens they emit (:mod:`automaton`).  A batch of texts is
one string of symbols cut into chunks; each chunk's state map (entry state to exit
state and number of tokens) is made on the states it can be entered in, and a
parallel prefix scan composes the maps.  Differences between two text starts are the
counts.  The tokenizer library is not called.

Rows: null and empty texts have 0 tokens; repeated rows are counted each; an
empty table gives an empty result; other columns of the input are not read.
One very long text is cut into chunks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, sources
from .wordvocab import word_vocabulary

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = sources(docs, id_col, text=text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = word_vocabulary(path)
        for batch in batches:
            texts = batch.column(1)
            size = np.asarray(pa.compute.binary_length(texts)).astype(np.int64)
            tokens = vocab.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
