"""Counting of hashed keys over all chunks of a corpus, with the keys packed into arrays.

A chunk is some rows that one task handles together.  It sends, for each bucket of keys that
it has any of, one row with its distinct keys and how often it has each; a bucket's task adds
up the counts over all chunks and answers each chunk with the totals of its keys, in their
order.  A key travels once per chunk however common it is.

Keys are hashes of KEY_BITS = 56 bits (of 10^11 different ones, one in 10^6 shares its hash with
another) and sent whole: 5 bytes each, and how many there are of each value of the upper 2
bytes.  Buckets are ranges of keys, so a chunk's sorted keys are its buckets' one after
another.  Counts and totals, most of them small, are deflated by planes of bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUESTS = "bucket int, chunk long, keys binary, counts binary, told binary"
REPLIES = "chunk long, bucket int, keys binary, counts binary, totals binary, n_keys long, n_counted long, told binary"
KEY_BITS = 56
_LOW = KEY_BITS - 16
MOST_BUCKETS = 1 << 16
BUCKET_BYTES = 16 << 20  # of text, whose keys a bucket's task holds at once


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def key_of(x: np.ndarray) -> np.ndarray:
    """Keys of 64-bit hashes."""
    return mixed(x) >> np.uint64(64 - KEY_BITS)


def buckets_for(size: int, least: int) -> int:
    """How many buckets the keys of so many bytes of text need."""
    return min(MOST_BUCKETS, max(1, least, -(-size // BUCKET_BYTES)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(_LOW)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)


def bounds(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys."""
    return np.searchsorted(bucket_of(sorted_keys, buckets), np.arange(buckets + 1))


def squeezed(data: bytes) -> bytes:
    """Deflated bytes of which runs are the only repeats."""
    out = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return out.compress(data) + out.flush()


def planes(numbers: np.ndarray) -> bytes:
    """The bytes of unsigned numbers by place: all lowest ones first, the upper ones, nearly all 0, last."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def pack(sorted_keys: np.ndarray) -> bytes:
    if not len(sorted_keys):
        return b""
    top, n = np.unique((sorted_keys >> np.uint64(_LOW)).astype(np.uint16), return_counts=True)
    head = zlib.compress(top.tobytes() + n.astype(np.uint32).tobytes(), 1)
    low = sorted_keys.astype(np.uint32).tobytes() + (sorted_keys >> np.uint64(32)).astype(np.uint8).tobytes()
    return len(head).to_bytes(4, "little") + head + low


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    body = 4 + int.from_bytes(data[:4], "little")
    head = zlib.decompress(data[4:body])
    top, counts = np.frombuffer(head, np.uint16, len(head) // 6), np.frombuffer(head, np.uint32, len(head) // 6, len(head) // 3)
    n = (len(data) - body) // 5
    out = np.frombuffer(data, np.uint32, n, body).astype(np.uint64)
    out |= np.frombuffer(data, np.uint8, n, body + 4 * n).astype(np.uint64) << np.uint64(32)
    return out | np.repeat(top.astype(np.uint64) << np.uint64(_LOW), counts)


def deflated(numbers: np.ndarray) -> bytes:
    small = not len(numbers) or int(numbers.max()) < 1 << 32
    return (b"4" if small else b"8") + squeezed(planes(numbers.astype(np.uint32 if small else np.uint64)))


def inflated(data: bytes) -> np.ndarray:
    return unplanes(zlib.decompress(data[1:]), np.uint32 if data[:1] == b"4" else np.uint64).astype(np.int64)


def requests(chunk: int, sorted_keys: np.ndarray, counts: np.ndarray, buckets: int, told: bytes | None = None) -> pd.DataFrame:
    """One row for each bucket of which the chunk has a key; told is handed through to the chunk's replies."""
    starts = bounds(sorted_keys, buckets)
    rows = [(b, chunk, pack(sorted_keys[i:j]), deflated(counts[i:j]), None) for b, (i, j) in enumerate(zip(starts, starts[1:])) if i < j]
    if told is not None:
        rows.append((chunk % buckets, chunk, None, None, told))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "counts", "told"])


def totals(sent: DataFrame, keep: str | None = None) -> DataFrame:
    """Replies to requests: totals of the chunk's keys of a bucket.

    keep='even': with the even ones among the keys and the counts sent of these, and for each
    bucket a row of the chunk -1 - bucket with its number of distinct even keys counted and the
    sum of their counts.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["keys"].notna()]
        told = rows.loc[rows["keys"].isna(), ["chunk", "bucket", "told"]]
        parts = [unpack(x) for x in asked["keys"]]
        out = [told]
        if parts:
            ends = np.cumsum([len(x) for x in parts])
            keys = np.concatenate(parts)
            counts = [inflated(x) for x in asked["counts"]]
            order = np.argsort(keys, kind="stable")
            by = keys[order]
            first = np.ones(len(by), dtype=bool)
            first[1:] = by[1:] != by[:-1]
            starts = np.flatnonzero(first)
            sums = np.add.reduceat(np.concatenate(counts)[order], starts)
            total = np.empty(len(by), dtype=np.int64)
            total[order] = np.repeat(sums, np.diff(np.append(starts, len(by))))
            own = {"chunk": asked["chunk"], "bucket": asked["bucket"], "totals": [deflated(total[e - len(x) : e]) for x, e in zip(parts, ends, strict=True)]}
            if keep == "even":
                evens = [(x & np.uint64(1)) == 0 for x in parts]
                own["keys"] = [pack(x[e]) for x, e in zip(parts, evens, strict=True)]
                own["counts"] = [deflated(n[e]) for n, e in zip(counts, evens, strict=True)]
                even = (by[starts] & np.uint64(1)) == 0
                bucket = int(asked["bucket"].iloc[0])
                out.append(pd.DataFrame({"chunk": [-1 - bucket], "bucket": [bucket], "n_keys": [int((sums[even] > 0).sum())], "n_counted": [int(sums[even].sum())]}))
            out.append(pd.DataFrame(own))
        both = pd.concat(out, ignore_index=True)
        for name in ("keys", "counts", "totals", "n_keys", "n_counted", "told"):
            if name not in both:
                both[name] = None
        return both[["chunk", "bucket", "keys", "counts", "totals", "n_keys", "n_counted", "told"]].astype({"n_keys": "Int64", "n_counted": "Int64"})

    return sent.groupBy("bucket").applyInPandas(add, REPLIES)


def answered(replies: pd.DataFrame, n: int) -> np.ndarray:
    """The totals of a chunk's n sorted keys from the replies to it."""
    replies = replies[replies["totals"].notna()].sort_values("bucket")
    parts = [inflated(x) for x in replies["totals"]]
    out = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(out) != n:
        raise ValueError("replies don't fit their requests")
    return out


def chunk_of(key, chunks: int):
    """The chunk number of a column of hashes."""
    return F.pmod(key, F.lit(chunks)).cast("long")
