"""Operator 8: SentencePiece encoding and decoding through distinct chunks.

Pieces of the model never join a character with the white-space mark after it,
so each distinct marked word is segmented once by the library and its ids are
joined back by position (``tokens.piece_table``).  Everything happens inside a
task, on whole texts; nothing is shuffled and memory is bounded by the table's
limit and one slice of texts.

Edge cases: null text is empty text (the end id alone); repeated rows and null
ids stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.token_output import with_end
from foliant.llm.tokens import loaded, piece_model, piece_table, sliced


def encode_pieces(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids and the decoded text of ``docs`` (doc_id, text)."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, library = loaded(piece_table, model), loaded(piece_model, model)
        decimal = [str(i) for i in range(library.get_piece_size())]
        for batch in batches:
            ids_of, texts, at = batch.column("doc_id"), batch.column("text").cast(pa.large_string()).fill_null(""), 0
            for piece in sliced(texts):
                ids, bounds = with_end(*table.texts(piece), library.eos_id())
                flat = ids.tolist()
                lists = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                decoded = [library.decode(x) for x in lists]
                columns = [
                    ids_of.slice(at, len(piece)),
                    np.diff(bounds),
                    [hashlib.sha256(" ".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in lists],
                    [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                ] + [lists, decoded] * keep_ids
                at += len(piece)
                yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
