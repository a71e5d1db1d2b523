"""Large fixed-size arrays that every task of a scan adds to: sent as compressed chunks, combined by chunk, never grouped in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

CHUNK = 1 << 16


def packed(array: np.ndarray, dtype=None):
    """(chunk number, compressed bytes) of every chunk that is not all zero, as ``dtype`` if given."""
    pack = zstandard.ZstdCompressor(level=1)
    for k, at in enumerate(range(0, len(array), CHUNK)):
        part = array[at:at + CHUNK]
        if part.any():
            yield k, pack.compress((part if dtype is None else part.astype(dtype)).tobytes())


def combined(parts: DataFrame, dtype: str, combine: str, finish=None) -> dict[int, bytes]:
    """Chunks of ``parts`` (chunk int, held binary) added up (``add``) or joined bit by bit (``bitwise_or``), then passed through ``finish``.

    Rows stream through the owner of their chunk, which holds one array per chunk; the result is the array itself, whose
    size is fixed by the caller's parameter.
    """

    def run(batches):
        held: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(unpack.decompress(data), dtype)
                held[k] = part.copy() if k not in held else getattr(np, combine)(held[k], part)
        done = {k: (finish(v) if finish else v).tobytes() for k, v in held.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array(list(done.values()), pa.binary())], names=["chunk", "held"])

    got = parts.repartition("chunk").mapInArrow(run, "chunk int, held binary").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def whole(found: dict[int, bytes], size: int, dtype: str) -> np.ndarray:
    out = np.zeros(size, dtype)
    for k, data in found.items():
        out[k * CHUNK:(k + 1) * CHUNK] = np.frombuffer(data, dtype)
    return out
