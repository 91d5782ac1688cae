"""Baseline JPEG without chroma subsampling, from arrays: transform, quantiser and entropy coder are whole-array operations."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The standard's example quantisers, in rows.
LUMA = np.array("""
16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99
""".split(), int)
CHROMA = np.array("""
17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99
""".split(), int)
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def quantiser(table: np.ndarray, quality: int) -> np.ndarray:
    s = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * s + 50) // 100, 1, 255).astype(int)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths, 16 at most, with the code of all ones left free."""
    heap = [(int(n), k, [k]) for k, n in enumerate(counts) if n] + [(0, 1000, [-1])]
    heapq.heapify(heap)
    length = {k: 0 for _, _, (k,) in heap}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in a[2] + b[2]:
            length[k] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    bits = np.bincount(list(length.values()), minlength=64)
    for n in range(63, 16, -1):  # move pairs of too long codes up
        while bits[n] > 0:
            j = n - 2
            while bits[j] == 0:
                j -= 1
            bits[n] -= 2
            bits[n - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    longest = max(n for n in range(1, 17) if bits[n])
    bits[longest] -= 1  # the free code
    order = sorted((k for k in length if k >= 0), key=lambda k: (length[k], k))
    return dict(zip(order, (n for n in range(1, 17) for _ in range(bits[n])), strict=True))


def _table(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as it is stored, and code and length by symbol."""
    code, size, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    symbols = sorted(lengths, key=lambda k: (lengths[k], k))
    for k in symbols:
        at <<= lengths[k] - last
        last = lengths[k]
        code[k], size[k] = at, last
        at += 1
    counts = [sum(1 for k in symbols if lengths[k] == n) for n in range(1, 17)]
    return bytes(counts) + bytes(symbols), code, size


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of bits of each value, and those bits."""
    n = np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    return n, np.where(v > 0, v, v + (1 << n) - 1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(x: np.ndarray, quality: int = 95) -> bytes:
    """Planes (3, h, w) in 0..1 as a JPEG file."""
    quality = int(min(100, max(1, quality)))
    h, w = x.shape[1:]
    r, g, b = np.floor(np.clip(np.pad(x, ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge"), 0, 1).astype(np.float64) * 255 + 0.5)
    planes = (0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b)
    k = np.arange(8)
    d = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    d[0] /= np.sqrt(2)
    tables = [quantiser(LUMA, quality), quantiser(CHROMA, quality)]
    blocks = []
    for c, p in enumerate(planes):
        t = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        blocks.append(np.rint((d @ t @ d.T).reshape(-1, 64) / tables[c > 0])[:, ZIGZAG].astype(np.int64))
    n = len(blocks[0])
    q = np.stack(blocks, axis=1).reshape(3 * n, 64)  # a block of each component in turn
    kind = np.tile([0, 1, 1], n)
    diff = np.stack([np.diff(x[:, 0], prepend=0) for x in blocks], axis=1).ravel()
    # Symbols: where they stand (block, place), the table, the symbol, how many further bits and which.
    size, extra = _magnitude(diff)
    parts = [(np.arange(3 * n) * 4096, kind, size, size, extra)]
    block, place = np.nonzero(q[:, 1:])
    place += 1
    before = np.where(np.diff(block, prepend=-1) != 0, 0, np.roll(place, 1))
    run = place - before - 1
    size, extra = _magnitude(q[block, place])
    parts.append((block * 4096 + place * 8 + 7, kind[block] + 2, run % 16 * 16 + size, size, extra))
    for j in range(3):  # sixteen zeros each
        long = run >= 16 * (j + 1)
        parts.append((block[long] * 4096 + place[long] * 8 + j, kind[block[long]] + 2, np.full(long.sum(), 0xF0), np.zeros(long.sum(), int), np.zeros(long.sum(), int)))
    last = np.zeros(3 * n, int)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    parts.append((ends * 4096 + 4000, kind[ends] + 2, np.zeros(len(ends), int), np.zeros(len(ends), int), np.zeros(len(ends), int)))
    key, table, symbol, size, extra = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    table, symbol, size, extra = table[order], symbol[order], size[order], extra[order]
    stored, codes, lengths = zip(*(_table(code_lengths(np.bincount(symbol[table == t], minlength=256))) for t in range(4)), strict=True)
    code, length = np.stack(codes)[table, symbol], np.stack(lengths)[table, symbol]
    value, bits = (code << size) | extra, length + size
    total = np.repeat(np.cumsum(bits) - bits, bits)
    at = np.arange(len(total)) - total
    stream = (np.repeat(value, bits) >> (np.repeat(bits, bits) - 1 - at)) & 1
    data = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, int)]).astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    head += b"".join(_segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables))
    head += _segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([c + 1, 0x11, int(c > 0)]) for c in range(3)))
    head += b"".join(_segment(0xC4, bytes([i]) + s) for i, s in zip((0x00, 0x01, 0x10, 0x11), stored, strict=True))
    return head + _segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"
