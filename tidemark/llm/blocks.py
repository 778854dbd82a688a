"""Documents in compressed blocks, and columns of numbers as bytes, for exchanges between tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def gather(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, data): whole rows of ``rows``, which has a column ``text``, in compressed blocks
    of about ``block_bytes`` characters of text; a longer text is a block of its own. Blocks
    are named by their contents, so a task that is repeated names them alike."""

    def gathered(batches):
        import hashlib
        import io

        import pyarrow as pa
        import zstandard

        compressor = zstandard.ZstdCompressor(level=6)

        def block(parts: list):
            table = pa.Table.from_batches(parts).combine_chunks()
            raw = io.BytesIO()
            with pa.ipc.new_stream(raw, table.schema) as stream:
                stream.write_table(table)
            raw = raw.getvalue()
            name = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([compressor.compress(raw)], pa.binary())],
                names=["block", "data"])

        parts, size = [], 0
        for batch in batches:
            a = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                size += len(text) if text else 0
                if size >= block_bytes:
                    yield block([*parts, batch.slice(a, i + 1 - a)])
                    parts, size, a = [], 0, i + 1
            if a < batch.num_rows:
                parts.append(batch.slice(a))
        if parts:
            yield block(parts)

    return rows.mapInArrow(gathered, "block bigint, data binary")


def opened(data: bytes):
    """The rows of a block."""
    import pyarrow as pa
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of their place, so that rising ones by their steps and
    small ones compress."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def steps(rising: np.ndarray) -> bytes:
    """Rising unsigned numbers as their steps."""
    return packed(np.diff(rising, prepend=np.uint64(0)))


def summed(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)
