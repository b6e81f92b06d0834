"""Patched frame-of-reference coding of unsigned 32-bit integers, with numpy.

A *segment* is coded in blocks of ``BLOCK`` integers (the last is filled up with
the block minimum).  A block stores its minimum, the width that ``PERCENTILE`` of
its differences fit into, the differences' low bits packed at that width, and the
others as exceptions: their places and the bits above the width.  The header holds the
byte at which each block starts, so a reader can decode any block alone:

    magic 'PF01', count u32, blocks u32, starts u32[blocks]
    block: minimum u32, width u8, exceptions u16, packed u32[BLOCK/32*width],
           places u16[exceptions], high bits u32[exceptions]
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
PERCENTILE = 95
MAGIC = b"PF01"
_HEAD = struct.Struct("<IBH")


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) differences below 2**width -> (k, BLOCK/32*width) words."""
    k = len(v)
    lanes = v.reshape(k, BLOCK // 32, 32)
    out = np.zeros((k, BLOCK // 32, width + 1), np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[:, :, word] |= lanes[:, :, j] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= lanes[:, :, j] >> np.uint32(32 - shift)
    return out[:, :, :width].reshape(k, -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`_pack`."""
    k = len(words)
    w = words.reshape(k, BLOCK // 32, width) if width else words
    out = np.zeros((k, BLOCK // 32, 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j in range(32 if width else 0):
        word, shift = divmod(j * width, 32)
        v = w[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            v = v | (w[:, :, word + 1] << np.uint32(32 - shift))
        out[:, :, j] = v & mask
    return out.reshape(k, BLOCK)


def bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def encode(ids: np.ndarray) -> bytes:
    """Code a segment of uint32; an empty one gives a header without blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return MAGIC + struct.pack("<II", 0, 0)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[(blocks - 1) * BLOCK:].min()
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    kth = -(-BLOCK * PERCENTILE // 100) - 1
    widths = bit_length(np.partition(diff, kth, axis=1)[:, kth])
    parts: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        d = diff[at]
        over = (d >> np.uint32(width)) if width < 32 else np.zeros_like(d)
        packed = _pack(d & np.uint32((1 << width) - 1), width)
        rows, places = np.nonzero(over)
        ends = np.searchsorted(rows, np.arange(len(at) + 1))
        high = over[rows, places]
        for i, b in enumerate(at.tolist()):
            s, e = ends[i], ends[i + 1]
            parts[b] = b"".join((_HEAD.pack(int(low[b]), width, int(e - s)),
                                 packed[i].astype("<u4").tobytes(),
                                 places[s:e].astype("<u2").tobytes(),
                                 high[s:e].astype("<u4").tobytes()))
    head = 12 + 4 * blocks
    starts = head + np.cumsum([0, *map(len, parts[:-1])])
    return b"".join((MAGIC, struct.pack("<II", n, blocks), starts.astype("<u4").tobytes(), *parts))


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The uint32 of blocks ``first`` to ``last`` (exclusive; all by default)."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of this format")
    n, blocks = struct.unpack_from("<II", data, 4)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, np.uint32)
    starts = np.frombuffer(data, "<u4", blocks, 12)[first:last].astype(np.int64)
    heads = [_HEAD.unpack_from(data, s) for s in starts.tolist()]
    low = np.array([h[0] for h in heads], np.uint32)
    widths = np.array([h[1] for h in heads])
    out = np.empty((last - first, BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        size = BLOCK // 32 * width
        words = np.array([np.frombuffer(data, "<u4", size, s + _HEAD.size)
                          for s in starts[at].tolist()], np.uint32).reshape(len(at), size)
        out[at] = _unpack(words, width)
        for b in at.tolist():
            e = heads[b][2]
            if e:
                p = int(starts[b]) + _HEAD.size + 4 * size
                places = np.frombuffer(data, "<u2", e, p)
                out[b, places] |= np.frombuffer(data, "<u4", e, p + 2 * e) << np.uint32(width)
    out += low[:, None]
    return out.reshape(-1)[:max(0, n - first * BLOCK)]
