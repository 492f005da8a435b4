"""Token ids in a wavelet matrix: one compressed file per shard, read by rank and select.

File: magic, a JSON header's length, the header, then chunks.  A bit-plane holds, for each place of
the sequence as the planes above have sorted it, one bit of the id, highest first.  Planes are cut
into chunks, packed and compressed each on its own, with the ones before each chunk in the header's
directory; so a lookup unpacks one chunk of each plane.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs

MAGIC = b"CWWM0001"
CHUNK_BITS = 1 << 18
STEP = 1 << 16  # places sorted at once


def _sorted(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ids whose bit is 0, then the others, each in their order."""
    out, lo = np.empty_like(ids), 0
    hi = len(ids) - int(np.count_nonzero(bits))
    for a in range(0, len(ids), STEP):
        part, ones = ids[a : a + STEP], np.flatnonzero(bits[a : a + STEP])
        zeros = np.flatnonzero(~bits[a : a + STEP])
        np.take(part, zeros, out=out[lo : lo + len(zeros)], mode="clip")
        np.take(part, ones, out=out[hi : hi + len(ones)], mode="clip")
        lo, hi = lo + len(zeros), hi + len(ones)
    return out


def _unsorted(ids: np.ndarray, bits: np.ndarray, n_zeros: int) -> np.ndarray:
    """Undoes ``_sorted``."""
    out, lo, hi = np.empty_like(ids), 0, n_zeros
    for a in range(0, len(ids), STEP):
        part, ones, zeros = out[a : a + STEP], np.flatnonzero(bits[a : a + STEP]), np.flatnonzero(~bits[a : a + STEP])
        part[zeros], part[ones] = ids[lo : lo + len(zeros)], ids[hi : hi + len(ones)]
        lo, hi = lo + len(zeros), hi + len(ones)
    return out


class Planes:
    """A wavelet matrix in memory, from ids or from a file's bytes."""

    def __init__(self, n: int, width: int, zeros: list[int], chunk):
        self.n, self.width, self.zeros = n, width, zeros
        self._chunk = functools.lru_cache(maxsize=max(64, 4 * width))(chunk)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before place i."""
        at, rest = divmod(i, CHUNK_BITS)
        if at * CHUNK_BITS >= self.n and rest == 0:
            return self.n - self.zeros[plane]
        before, bits = self._chunk(plane, at)
        return before + int(np.bitwise_count(bits[: rest // 8]).sum()) + (int(bits[rest // 8] >> (8 - rest % 8)).bit_count() if rest % 8 else 0)

    def _bit(self, plane: int, i: int) -> int:
        at, rest = divmod(i, CHUNK_BITS)
        return int(self._chunk(plane, at)[1][rest // 8] >> (7 - rest % 8)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.width):
            bit, ones = self._bit(p, i), self._rank1(p, i)
            out, i = out << 1 | bit, self.zeros[p] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's places among the first i end up: a range of the last order."""
        lo, hi = 0, i
        for p in range(self.width):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.width - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Times that the token stands before place i."""
        if not 0 <= token < 1 << self.width:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return self.rank(token, self.n if hi is None else hi) - self.rank(token, lo)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit, by bisection over ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Place where the token stands for the k-th time, from 0."""
        lo, hi = self._range(token, self.n) if 0 <= token < 1 << self.width else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for p in reversed(range(self.width)):
            bit = token >> (self.width - 1 - p) & 1
            at = self._select_bit(p, bit, at - self.zeros[p] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def plane(self, p: int) -> np.ndarray:
        parts = [self._chunk.__wrapped__(p, c)[1] for c in range(-(-self.n // CHUNK_BITS))]
        return np.unpackbits(np.concatenate(parts), count=self.n) if parts else np.zeros(0, np.uint8)

    def decode(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for p in reversed(range(self.width)):
            ids[self.zeros[p] :] |= kind(1 << (self.width - 1 - p))
            ids = _unsorted(ids, self.plane(p).view(bool), self.zeros[p])
        return ids


def encode(ids: np.ndarray, documents: list[tuple[int | None, int]]) -> bytes:
    """A shard's file: the ids and (doc_id, tokens) of its documents in order."""
    ids = ids.astype(np.uint32)
    n, width = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    if not len(ids) or ids.max() < 1 << 16:
        ids = ids.astype(np.uint16)
    zeros, directory, body, at = [], [], [], 0
    for p in range(width):
        is_one, ones, row = (ids & ids.dtype.type(1 << (width - 1 - p))) != 0, 0, []
        packed = np.packbits(is_one)
        for c in range(0, n, CHUNK_BITS):
            raw = packed[c // 8 : (c + CHUNK_BITS) // 8]
            data = zstandard.compress(raw.tobytes(), 1)
            row.append((at, len(data), ones))
            body.append(data)
            at, ones = at + len(data), ones + int(np.bitwise_count(raw).sum())
        zeros.append(n - ones)
        directory.append(row)
        ids = _sorted(ids, is_one)
    head = zlib.compress(json.dumps({"n": n, "width": width, "zeros": zeros, "chunks": directory, "docs": documents}).encode(), 1)
    data = b"".join(body)
    return MAGIC + struct.pack("<QQI", len(head), len(data), zlib.crc32(head + data)) + head + data


def decode_file(blob: bytes | memoryview) -> tuple[Planes, list[tuple[int | None, int]]]:
    """A shard's matrix and documents.  A file that is cut or altered raises."""
    head_n, data_n, crc = struct.unpack_from("<QQI", blob, 8) if len(blob) >= 28 else (0, 0, 0)
    if bytes(blob[:8]) != MAGIC or len(blob) != 28 + head_n + data_n or zlib.crc32(blob[28:]) != crc:
        raise ValueError("not a whole token file")
    head, data = json.loads(zlib.decompress(blob[28 : 28 + head_n])), memoryview(blob)[28 + head_n :]

    def chunk(p: int, c: int) -> tuple[int, np.ndarray]:
        at, size, ones = head["chunks"][p][c]
        return ones, np.frombuffer(zstandard.decompress(data[at : at + size]), np.uint8)

    return Planes(head["n"], head["width"], head["zeros"], chunk), [tuple(x) for x in head["docs"]]


def put(path: str, data: bytes) -> None:
    system, name = pafs.FileSystem.from_uri(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None) as out:
        out.write(data)


def get(path: str) -> bytes:
    system, name = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(name, compression=None) as f:
        return f.read()


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of shard files given as rows (path, base): doc_id, start, n_tokens, ids_crc32."""
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            planes, documents = decode_file(get(path))
            raw, at, rows = memoryview(planes.decode().astype("<u4").view(np.uint8)), 0, []
            for doc_id, n in documents:
                rows.append((doc_id, base + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                at += n
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])
