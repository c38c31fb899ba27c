"""Splitting whole Arrow batches of texts into words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BYTES = np.arange(256, dtype=np.uint8)


def byte_table(lower: bool = False, only_alphanumeric: bool = False) -> np.ndarray:
    """A map of bytes: A-Z to a-z; ASCII other than letters and digits to a blank."""
    table = _BYTES.copy()
    if only_alphanumeric:
        ascii_letters = ((table | 32) >= 97) & ((table | 32) <= 122)
        digits = (table >= 48) & (table <= 57)
        table[(table < 128) & ~ascii_letters & ~digits] = 32
    if lower:
        table[65:91] += 32
    return table


LOWER = byte_table(lower=True)
LOWER_ALPHANUMERIC = byte_table(lower=True, only_alphanumeric=True)


class Words(NamedTuple):
    """The words of text i are ``vocab[ids[offsets[i]:offsets[i + 1]]]``."""

    offsets: np.ndarray
    ids: np.ndarray
    vocab: list[bytes]


def split(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """Words between ASCII white space (\\x20, \\x09-\\x0D); a null text has none.

    ``table`` maps bytes before the split; bytes of 128 and more must map to themselves.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or starts[0] == starts[-1]:
        return Words(np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32), [])
    if table is not None:
        data = table[np.frombuffer(texts.buffers()[2], dtype=np.uint8)]
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(starts.copy()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.values.dictionary_encode()
    bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    ids, bounds = ids[bounds[0] : bounds[-1]], bounds - bounds[0]
    vocab = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in vocab:  # before leading and after trailing white space
        real = ids != vocab.index(b"")
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        ids = ids[real]
    return Words(bounds, ids, vocab)


def hashes(vocab: Iterable[bytes]) -> np.ndarray:
    """64 bits for each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in vocab], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def chained(parts: Iterable[np.ndarray]) -> np.ndarray:
    """One 64-bit value for each sequence of values; parts holds the sequences' columns."""
    out = None
    for part in parts:
        out = mixed(part + _STEP) if out is None else mixed(out * _STEP + part)
    return out


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The value of h[i : i + size] for each i; shorter by size - 1."""
    n = len(h) - size + 1
    return chained(h[i : i + n] for i in range(size)) if n > 0 else np.zeros(0, np.uint64)


def release() -> None:
    """Give freed memory back to the machine: a worker lives on between tasks, beside others that need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row; memory is given back after the last."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
    release()
