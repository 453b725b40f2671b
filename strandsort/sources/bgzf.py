"""Block gzip: blocks of at most 64 KiB, each a gzip member that tells its own size."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

HEADER = 18
#: The empty block that ends a file.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 0xFF00


class NotBlockGzip(ValueError):
    pass


def check(head: bytes, name: str) -> None:
    """Fail, telling how to recompress, unless these first bytes begin a block-gzip file."""
    help_ = f"Recompress it by block, for example: gunzip -c {name} | bgzip > out.fastq.gz"
    if head[:3] != b"\x1f\x8b\x08":
        raise NotBlockGzip(f"{name} is in an unknown format, not block gzip. {help_}")
    if len(head) < HEADER or not head[3] & 4 or head[12:14] != b"BC":
        raise NotBlockGzip(f"{name} is gzip, but not block gzip. {help_}")


def block(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    if len(body) + HEADER + 8 > 0x10000:
        z = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + HEADER + 7)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(parts: Iterator[bytes], level: int = 5) -> Iterator[bytes]:
    """Blocks of the parts' bytes, without the end block."""
    held = bytearray()
    for p in parts:
        held += p
        while len(held) >= MOST:
            yield block(bytes(held[:MOST]), level)
            del held[:MOST]
    if held:
        yield block(bytes(held), level)


def next_block(stream: BinaryIO, at: int, end: int, span: int = 1 << 17) -> int:
    """Where the first block begins that starts in [at, end); end if none does.

    Its first bytes may also stand inside compressed data: a block counts if another one, or the file's end, follows it.
    """

    def header(place: int) -> bytes:
        stream.seek(place)
        return stream.read(HEADER)

    def begins(head: bytes) -> bool:
        return len(head) == HEADER and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"BC"

    while at < end:
        stream.seek(at)
        data = stream.read(span)
        if not data:
            return end
        found = data.find(b"\x1f\x8b\x08\x04")
        while found >= 0 and at + found < end:
            head = header(at + found)
            if begins(head):
                after = header(at + found + struct.unpack_from("<H", head, 16)[0] + 1)
                if not after or begins(after):
                    return at + found
            found = data.find(b"\x1f\x8b\x08\x04", found + 1)
        at += max(1, len(data) - 3)
    return end


def blocks(stream: BinaryIO, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(start, size, data) of the blocks from a block's start on, up to ``end``."""
    stream.seek(at)
    while end is None or at < end:
        head = stream.read(HEADER)
        if not head:
            return
        check(head, getattr(stream, "name", "stream"))
        size = struct.unpack_from("<H", head, 16)[0] + 1
        rest = stream.read(size - HEADER)
        if len(rest) != size - HEADER:
            raise NotBlockGzip("The last block is cut off")
        yield at, size, zlib.decompress(rest[:-8], -15)
        at += size
