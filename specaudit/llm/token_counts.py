"""Token counts without token ids.

The number of pieces of a pre-token does not depend on the text around it. So each task counts the pieces once per
distinct pre-token, joins the counts to the pre-token frequencies of each document and sums; ids of a document are never
built. The join stays inside the task: a shuffle of (document, pre-token, frequency) rows would move several times the
input, while the distinct pre-tokens of a few megabytes of text fit a dictionary that is reused from batch to batch.

Rows and edge cases: one row per input row, repeated rows and null ids included. Null text counts as empty: 0 bytes,
0 tokens, not over the limit. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from specaudit.llm.batches import sliced
from specaudit.llm.pretokens import TOKEN_SLICE, Vocabulary

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_pretokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_pretokens, over_limit) for the whole text of every row of (doc_id, text).

    `path`: a byte-level BPE file of the tokenizers library, present on every executor.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabulary = Vocabulary(path, len)
        for part in sliced(batches, most=TOKEN_SLICE):
            texts = [x or "" for x in part.column("text").to_pylist()]
            frequencies = [Counter(vocabulary.split(x)) for x in texts]
            pieces = vocabulary.learn(chain.from_iterable(frequencies))
            tokens = [sum(n * pieces[item] for item, n in f.items()) for f in frequencies]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()), "n_pretokens": pa.array([f.total() for f in frequencies], pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            })

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(count, SCHEMA)
