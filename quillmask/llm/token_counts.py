"""Token counts by compiled finite-state transducers (machines: see bpe.py).

Input: any table with an id and a text column.  Each text counts whole and on its own.  Null and empty texts have 0
bytes and 0 tokens; repeated rows are counted row by row; a null id stays null; other columns are not looked at, so
their names cannot clash; an empty table gives an empty result.  Very long texts are run in chunks whose state
maps compose, with memory in proportion to one batch of texts.  Special strings in a text are one token each, the
library's default.  Files other than byte-level BPE raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import bpe


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).  One narrow pass, no shuffle."""
    packed = bpe.class_table(tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        splitter, transducer = bpe.compiled(tokenizer, packed)
        for batch in batches:
            counts = [transducer.counts(splitter.groups(texts)) for _, texts in bpe.parts(batch.column(1))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = read.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
