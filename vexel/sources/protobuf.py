"""The protobuf wire format, as far as vector tiles need it."""

from __future__ import annotations

import struct
from collections.abc import Iterator


class WireError(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("bad varint")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value): an int, or bytes for what is delimited or fixed."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if number == 0:
            raise WireError("field 0")
        if kind == 0:
            value, at = varint(data, at)
            yield number, kind, value
            continue
        if kind == 2:
            size, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise WireError(f"wire type {kind}")
        if at + size > len(data):
            raise WireError("truncated field")
        yield number, kind, data[at : at + size]
        at += size


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def put_varint(n: int) -> bytes:
    out = bytearray()
    n &= 0xFFFFFFFFFFFFFFFF
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def put(number: int, value) -> bytes:
    """A field: ints as varints, floats as doubles, bytes and str delimited."""
    if isinstance(value, float):
        return put_varint(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return put_varint(number << 3) + put_varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return put_varint(number << 3 | 2) + put_varint(len(raw)) + raw


def put_packed(number: int, values: list[int]) -> bytes:
    return put(number, b"".join(map(put_varint, values)))
