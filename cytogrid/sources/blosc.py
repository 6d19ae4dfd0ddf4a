"""Blosc frames: blocks of bytes, shuffled by their place in an element, in streams of a common compressor.

A frame is a header of 16 bytes, the start of every block, and the blocks. A block is one stream, or one per byte of an
element, each with its length before it; a stream as long as what it holds is stored as it is.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

# Fixed values of the format.
HEADER = "<BBBBiii"  # versions of format and codec, flags, element size, bytes, block size, frame size
SHUFFLED, STORED, BIT_SHUFFLED, ONE_STREAM = 0x01, 0x02, 0x04, 0x10
CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
MOST_STREAMS, LEAST_STREAM = 16, 128


def _expand(stream: bytes, size: int, codec: str) -> bytes:
    if codec == "zlib":
        return zlib.decompress(stream)
    return pa.decompress(stream, decompressed_size=size, codec=codec, asbytes=True)


def _shuffle(block: bytes, width: int, back: bool) -> bytes:
    """First bytes of all elements, then second bytes; an incomplete element at the end stays."""
    whole = len(block) // width * width
    shape = (width, -1) if back else (-1, width)
    moved = np.frombuffer(block, np.uint8, whole).reshape(shape).T
    return moved.tobytes() + block[whole:]


def unpack(frame: bytes) -> bytes:
    """The bytes a frame holds."""
    _, _, flags, width, total, block_size, _ = struct.unpack_from(HEADER, frame)
    body = struct.calcsize(HEADER)
    if flags & STORED:
        return frame[body : body + total]
    if flags & BIT_SHUFFLED:
        raise ValueError("bit-shuffled frames are not supported")
    kind = flags >> 5
    if kind not in CODECS:
        raise ValueError(f"compressor {kind} of a frame is not supported")
    starts = struct.unpack_from(f"<{-(-total // block_size)}i", frame, body) if total else ()
    blocks = []
    for i, at in enumerate(starts):
        size = min(block_size, total - i * block_size)
        split = not flags & ONE_STREAM and width <= MOST_STREAMS and block_size // width >= LEAST_STREAM
        streams = width if split and size == block_size else 1
        parts = []
        for _ in range(streams):
            (length,) = struct.unpack_from("<i", frame, at)
            stream = frame[at + 4 : at + 4 + length]
            parts.append(stream if length == size // streams else _expand(stream, size // streams, CODECS[kind]))
            at += 4 + length
        block = b"".join(parts)
        blocks.append(_shuffle(block, width, back=True) if flags & SHUFFLED and width > 1 else block)
    return b"".join(blocks)


def pack(data: bytes, width: int, codec: str = "lz4_raw", block_size: int = 1 << 16, split: bool = True) -> bytes:
    """A shuffled frame of the bytes; ``width`` is the size of an element."""
    kind = next(k for k, name in CODECS.items() if name == codec)
    block_size = max(width, min(block_size, len(data)) // width * width)
    flags = SHUFFLED | kind << 5 | (0 if split else ONE_STREAM)
    blocks = []
    for low in range(0, len(data), block_size):
        block = data[low : low + block_size]
        streams = width if split and width <= MOST_STREAMS and block_size // width >= LEAST_STREAM and len(block) == block_size else 1
        if width > 1:
            block = _shuffle(block, width, back=False)
        step, out = len(block) // streams, b""
        for i in range(streams):
            stream = block[i * step : (i + 1) * step]
            packed = zlib.compress(stream) if codec == "zlib" else pa.compress(stream, codec=codec, asbytes=True)
            best = packed if len(packed) < len(stream) else stream
            out += struct.pack("<i", len(best)) + best
        blocks.append(out)
    first = struct.calcsize(HEADER) + 4 * len(blocks)
    starts = first + np.cumsum([0, *map(len, blocks)])
    head = struct.pack(HEADER, 2, 1, flags, width, len(data), block_size, int(starts[-1]))
    return head + struct.pack(f"<{len(blocks)}i", *starts[:-1].tolist()) + b"".join(blocks)
