"""Chunk codecs: zlib, gzip, zstd and Blosc containers (LZ4, zstd, zlib; byte
and bit shuffle)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np


class CodecError(ValueError):
    """A chunk that cannot be decoded."""


def lz4_block(src: bytes, size: int) -> bytes:
    """A raw LZ4 block of known decoded size: literals, then copies from what
    is already there."""
    out, at, end = bytearray(), 0, len(src)

    def more(n: int, at: int) -> tuple[int, int]:
        while True:
            b = src[at]
            at, n = at + 1, n + b
            if b != 255:
                return n, at

    try:
        while at < end:
            token, at = src[at], at + 1
            n = token >> 4
            if n == 15:
                n, at = more(n, at)
            out += src[at : at + n]
            at += n
            if at >= end:
                break
            back = src[at] | src[at + 1] << 8
            at += 2
            n = token & 15
            if n == 15:
                n, at = more(n, at)
            n += 4
            start = len(out) - back
            if back == 0 or start < 0:
                raise CodecError("LZ4 copy before the beginning")
            if back >= n:
                out += out[start : start + n]
            else:
                piece = bytes(out[start:])
                out += (piece * (n // back + 1))[:n]
    except IndexError:
        raise CodecError("LZ4 block is cut short") from None
    if len(out) != size:
        raise CodecError(f"LZ4 block has {len(out)} bytes, not {size}")
    return bytes(out)


def unshuffle(data: bytes, width: int) -> bytes:
    """Bytes of each item together again; a rest stays as it is."""
    n = len(data) // width
    body = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return body.tobytes() + data[n * width :]


def bit_unshuffle(data: bytes, width: int) -> bytes:
    """Bits of each item together again, for whole groups of 8 items."""
    n = len(data) // width // 8 * 8
    planes = np.unpackbits(np.frombuffer(data, np.uint8, n * width), bitorder="little").reshape(width * 8, n)
    return np.packbits(planes.T, axis=1, bitorder="little").tobytes() + data[n * width :]


def zstd(data: bytes, size: int | None = None) -> bytes:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return d.decompress(data, max_output_size=size or 0) if size else d.decompressobj().decompress(data)


def blosc(data: bytes) -> bytes:
    """A Blosc 1 container."""
    if len(data) < 16:
        raise CodecError("Blosc header is cut short")
    _, _, flags, width = data[:4]
    size, block, total = struct.unpack("<III", data[4:16])
    if total != len(data):
        raise CodecError("Blosc container is cut short")
    if flags & 2:
        return data[16 : 16 + size]
    codec = flags >> 5
    if codec not in (1, 3, 4):  # fixed values of the format: 1 LZ4, 3 zlib, 4 zstd
        raise CodecError(f"Blosc codec {codec} is not supported")
    n = -(-size // block) if block else 0
    starts = struct.unpack(f"<{n}I", data[16 : 16 + 4 * n])
    out = []
    for i, at in enumerate(starts):
        want = min(block, size - i * block)
        split = width if not flags & 16 and codec != 4 and width <= 16 and want == block and block // width >= 128 else 1
        parts = []
        for _ in range(split):
            (length,) = struct.unpack("<i", data[at : at + 4])
            piece, at = data[at + 4 : at + 4 + length], at + 4 + length
            whole = want // split
            if length == whole:
                parts.append(piece)
            elif codec == 1:
                parts.append(lz4_block(piece, whole))
            else:
                parts.append(zlib.decompress(piece) if codec == 3 else zstd(piece, whole))
        body = b"".join(parts)
        if flags & 1 and width > 1:
            body = unshuffle(body, width)
        elif flags & 4:
            body = bit_unshuffle(body, width)
        out.append(body)
    return b"".join(out)


DECODERS: dict[str, Callable[[bytes], bytes]] = {
    "none": lambda b: b,
    "zlib": zlib.decompress,
    "gzip": lambda b: zlib.decompress(b, 47),
    "zstd": zstd,
    "blosc": blosc,
}


def encode(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "zlib":
        return zlib.compress(data, 5)
    if codec == "gzip":
        import gzip

        return gzip.compress(data, 5, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(data)
    raise CodecError(f"no encoder for {codec!r}")
