"""PNG by the book: filters, 1 to 16 bits, all colour types without interlacing; written with filter 0."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(x: np.ndarray, depth: int = 16) -> bytes:
    """Planes (3, h, w) in 0..1 as an RGB file of 8 or 16 bits, rounded half up."""
    top = 65535 if depth == 16 else 255
    rows = np.moveaxis(np.clip(x, 0, 1), 0, -1).astype(np.float64) * top + 0.5
    rows = rows.astype(">u2" if depth == 16 else "u1")
    h, w = rows.shape[:2]
    raw = b"".join(b"\0" + rows[y].tobytes() for y in range(h))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def size_of(data: bytes) -> tuple[int, int]:
    """Height and width, from the header alone."""
    w, h = struct.unpack(">II", data[16:24])
    return h, w


def decode(data: bytes) -> np.ndarray:
    """Planes (3, h, w) float32 in 0..1; grey is repeated, alpha dropped."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, idat, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if not head or head[6]:
        raise ValueError("no header, or an interlaced file")
    w, h, depth, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, line = max(1, channels * depth // 8), (w * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, line + 1)
    out, above = np.empty((h, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            for k in range(step):
                row[k::step] = np.cumsum(row[k::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            a = np.zeros(step, np.int16)
            c = np.zeros(step, np.int16)
            pad = -line % step
            values, over = np.pad(row, (0, pad)).reshape(-1, step).astype(np.int16), np.pad(above, (0, pad)).reshape(-1, step).astype(np.int16)
            for k in range(len(values)):
                b = over[k]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                    c = b
                values[k] = a = (values[k] + guess) & 255
            row = values.astype(np.uint8).ravel()[:line]
        elif kind:
            raise ValueError("unknown filter")
        out[y] = above = row
    if depth == 16:
        v = out.view(">u2").reshape(h, w, channels) / np.float32(65535)
    elif depth == 8:
        v = out.reshape(h, w, channels)
    else:
        v = np.unpackbits(out, axis=1).reshape(h, -1, depth)
        v = (v * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, : w * channels].reshape(h, w, channels)
    if colour == 3:
        v = palette[v[..., 0].astype(int)] / np.float32(255)
    elif depth < 16:
        v = v / np.float32((1 << depth) - 1)
    v = v[..., :3] if v.shape[-1] >= 3 else np.repeat(v[..., :1], 3, axis=-1)
    return np.ascontiguousarray(np.moveaxis(v, -1, 0), dtype=np.float32)
