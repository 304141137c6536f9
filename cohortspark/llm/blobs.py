"""Columns of numpy entries that travel between stages as one binary value per target partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def packed(arrays: list[np.ndarray]) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(blob, dtypes: list[str]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for d in dtypes:
        a = np.frombuffer(blob, d, n, at)
        out.append(a)
        at += a.nbytes
    return out


def joined(blobs: list, dtypes: list[str]) -> list[np.ndarray]:
    """The entries of all blobs, column by column."""
    parts = [unpacked(b, dtypes) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d) for i, d in enumerate(dtypes)]


def dealt(target: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(target, blob of its entries), entries in their given order."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    t = target[order]
    arrays = [a[order] for a in arrays]
    cuts = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(t[a]), packed([x[a:b] for x in arrays])


def rows(kind: int, pairs) -> pa.RecordBatch | None:
    """A batch of (target, kind, blob); None for no pairs."""
    pairs = list(pairs)
    if not pairs:
        return None
    return pa.RecordBatch.from_pydict({"target": pa.array([p[0] for p in pairs], pa.int32()), "kind": pa.array([kind] * len(pairs), pa.int32()), "blob": pa.array([p[1] for p in pairs], pa.binary())})


SCHEMA = "target int, kind int, blob binary"


def gathered(batches) -> dict[int, list]:
    """All blobs of a partition by kind."""
    out: dict[int, list] = {}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            out.setdefault(kind, []).append(blob.as_buffer())
    return out
