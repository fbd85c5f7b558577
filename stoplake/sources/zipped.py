"""The frame of a zip archive whose members are deflated elsewhere: checksums of joined parts, headers and directory."""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: The polynomial of CRC-32, its lowest bit last, and the limit of 32-bit fields.
POLYNOMIAL, FULL = 0xEDB88320, 0xFFFFFFFF
#: 1980-01-01, so that the bytes do not depend on the clock.
DATE, UTF8, DEFLATED = 0x21, 0x800, 8


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """The checksum of two texts behind one another, of theirs and the length of the second one."""
    shift, power = 1 << 31, 1 << 23  # one, and x to the eighth
    while length:
        if length & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        length >>= 1
    return _times(first, shift) ^ second


@dataclass
class Entry:
    """A member: its name, checksum, size, packed size and first packed bytes."""

    name: str
    crc: int
    size: int
    packed: int
    start: bytes


def local_header(e: Entry) -> bytes:
    large = e.size >= FULL or e.packed >= FULL
    extra = struct.pack("<HHQQ", 1, 16, e.size, e.packed) if large else b""
    sizes = (FULL, FULL) if large else (e.packed, e.size)
    return struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if large else 20, UTF8, DEFLATED, 0, DATE, e.crc, *sizes, len(e.name.encode()), len(extra)) + e.name.encode() + extra


def offsets(entries: list[Entry]) -> list[int]:
    """Where each member's header begins, and the directory after the last one."""
    out = [0]
    for e in entries:
        out.append(out[-1] + len(local_header(e)) + e.packed)
    return out


def directory(entries: list[Entry], starts: list[int]) -> bytes:
    out = b""
    for e, at in zip(entries, starts):
        large = max(e.size, e.packed, at) >= FULL
        extra = struct.pack("<HHQQQ", 1, 24, e.size, e.packed, at) if large else b""
        fields = (FULL, FULL) if large else (e.packed, e.size)
        out += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if large else 20, UTF8, DEFLATED, 0, DATE, e.crc, *fields, len(e.name.encode()), len(extra), 0, 0, 0, 0, FULL if large else at)
        out += e.name.encode() + extra
    size, begin, n = len(out), starts[-1], len(entries)
    if begin + size >= FULL:
        out += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, begin) + struct.pack("<4sIQI", b"PK\x06\x07", 0, begin + size, 1)
        begin = FULL
    return out + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, min(size, FULL), begin, 0)
