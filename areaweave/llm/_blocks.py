"""Documents in blocks: runs of whole texts of a few MB, written once to the shared folder.

A block is the unit that repeat detection sends anchors for and gets answers for. Blocks are made from whatever rows a
task reads, so copies, repeated ids and null ids spread like any other rows, and since the blocks are written before
they are used, every later stage sees the same ones, also after an executor is lost.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.llm._common import cut, slices
from areaweave.llm._hash import text_bytes, word_bounds

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 3 << 20
SCHEMA = "block long, ids array<long>, sizes array<int>, n_bytes long, body binary"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def plain_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows, each two parted by one blank, and the number of words of each row."""
    starts, ends, first = word_bounds(raw, offsets)
    parts, w = [], 0
    while w < len(starts):
        # as many words as make about 1 MB
        v = max(w + 1, int(np.searchsorted(starts, starts[w] + (1 << 20))))
        size = ends[w:v] - starts[w:v] + 1
        close = np.cumsum(size)
        at = np.arange(int(close[-1])) + np.repeat(starts[w:v] - (close - size), size)
        part = raw[np.minimum(at, len(raw) - 1)]
        part[close - 1] = 32
        parts.append(part)
        w = v
    return (np.concatenate(parts)[:-1] if parts else np.zeros(0, np.uint8)), np.diff(first)


def pack(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, words: bool = False) -> DataFrame:
    """The block table of ``docs``: ids, sizes and compressed bytes of the texts (null: empty).

    Sizes are bytes; with ``words``, the texts are kept as `plain_words` and sizes are numbers of words.
    """

    def run(batches):
        for whole in batches:
            for part in slices(whole, "text", block_bytes):
                raw, offsets = text_bytes(part.column(1))
                raw, sizes = plain_words(raw, offsets) if words else (raw, np.diff(offsets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().int >> 65], pa.int64()),
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([len(raw)], pa.int64()),
                        pa.array([_codec().compress(raw.tobytes(), asbytes=True)], pa.binary()),
                    ],
                    names=["block", "ids", "sizes", "n_bytes", "body"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return cut(rows.mapInArrow(run, SCHEMA), "text-blocks")


def unpack(batch: pa.RecordBatch, i: int) -> tuple[int, list, np.ndarray, np.ndarray]:
    """Block number, ids, bytes and offsets (in the unit of the sizes) of row ``i`` of a batch with the block columns."""
    col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    n = col["n_bytes"][i].as_py()
    raw = np.frombuffer(_codec().decompress(col["body"][i].as_buffer(), n), np.uint8) if n else np.zeros(0, np.uint8)
    sizes = np.array(col["sizes"][i].as_py(), np.int64)
    return col["block"][i].as_py(), col["ids"][i].as_py(), raw, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
