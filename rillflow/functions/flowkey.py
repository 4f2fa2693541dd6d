"""Flow keys: 4, 8 or 13 bytes for an address, a pair of addresses, or a 5-tuple.

Keys are BinaryType: source address at 0, destination at 4, source port at 8,
destination port at 10, protocol at 12, each little-endian.  Field accessors
give signed integers (``unsigned`` has the other reading).  Positions out of
range raise ValueError when the plan is built, or give null for null keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS = (4, 8, 13)
#: Field -> offset, bytes.
FIELDS = {"ip": (0, 4), "src_ip": (0, 4), "dst_ip": (4, 4), "src_port": (8, 2), "dst_port": (10, 2), "protocol": (12, 1)}
_ALLOWED = {4: {"ip"}, 8: {"src_ip", "dst_ip"}, 13: {"src_ip", "dst_ip", "src_port", "dst_port", "protocol"}}
_TYPE = {1: "tinyint", 2: "smallint", 4: "int"}


def _le(c: Column, size: int) -> Column:
    """Little-endian bytes of an integer column."""
    digits = F.lpad(F.hex(c.cast("long").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def pack(*fields: Column) -> Column:
    """A key of one address, two addresses, or a 5-tuple; any other number of fields is an error."""
    sizes = {1: (4,), 2: (4, 4), 5: (4, 4, 2, 2, 1)}.get(len(fields))
    if sizes is None:
        raise ValueError("a flow key has 1, 2 or 5 fields")
    return F.concat(*(_le(f, s) for f, s in zip(fields, sizes, strict=True)))


def zero(length: int) -> Column:
    _check(length)
    return F.lit(bytes(length))


def _check(length: int) -> None:
    if length not in LENGTHS:
        raise ValueError("a flow key has 4, 8 or 13 bytes")


def unsigned(key: Column, offset: int, size: int) -> Column:
    """The little-endian number at a place."""
    part = F.hex(key.substr(offset + 1, size))
    turned = F.concat(*(F.substring(part, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("long")


def network(key: Column, offset: int, size: int) -> Column:
    """The number at a place, most significant byte first."""
    return F.conv(F.hex(key.substr(offset + 1, size)), 16, 10).cast("long")


def accessor(key: Column, field: str, length: int) -> Column:
    """A field as a signed integer; a field that keys of this length lack is an error."""
    _check(length)
    if field not in _ALLOWED[length]:
        raise ValueError(f"keys of {length} bytes have no {field}")
    offset, size = FIELDS[field]
    u = unsigned(key, offset, size)
    half, whole = 1 << 8 * size - 1, 1 << 8 * size
    return F.when(u >= half, u - whole).otherwise(u).cast(_TYPE[size])


def dotted(key: Column, offset: int = 0) -> Column:
    """An address for display, most significant byte first."""
    return F.concat_ws(".", *(unsigned(key, offset + k, 1).cast("string") for k in (3, 2, 1, 0)))


def copy(key: Column, length: int, at: int, other: Column, other_length: int, other_at: int, size: int) -> Column:
    """key with ``size`` bytes from ``at`` on replaced by those of other from ``other_at`` on; ranges beyond either key are errors."""
    if size < 0 or min(at, other_at) < 0 or at + size > length or other_at + size > other_length:
        raise ValueError("range out of bounds")
    empty = F.lit(b"")
    head = key.substr(1, at) if at else empty
    tail = key.substr(at + size + 1, length - at - size) if at + size < length else empty
    return F.concat(head, other.substr(other_at + 1, size) if size else empty, tail)


def rekey(key: Column, to: int) -> Column:
    """The shorter key that a longer one starts with (5-tuple to pair to address)."""
    _check(to)
    return key.substr(1, to)


def get_bit(key: Column, length: int, at: int) -> Column:
    """Bit ``at``, least significant first in each byte."""
    if not 0 <= at < 8 * length:
        raise ValueError("bit out of range")
    return F.shiftright(unsigned(key, at >> 3, 1), at & 7).bitwiseAND(1).cast("int")


def set_bit(key: Column, length: int, at: int, on: bool) -> Column:
    if not 0 <= at < 8 * length:
        raise ValueError("bit out of range")
    byte, mask = unsigned(key, at >> 3, 1), 1 << (at & 7)
    new = byte.bitwiseOR(mask) if on else byte.bitwiseAND(255 ^ mask)
    return copy(key, length, at >> 3, _le(new, 1), 1, 0, 1)


def xor(a: Column, b: Column, length: int) -> Column:
    return F.concat(*(_le(unsigned(a, k, 1).bitwiseXOR(unsigned(b, k, 1)), 1) for k in range(length)))


def less(a: Column, b: Column, length: int) -> Column:
    """Lexicographic order of signed bytes (Spark compares bytes unsigned: flipping the sign bits gives the same order)."""
    flip = F.lit(bytes([0x80] * length))
    return xor(a, flip, length) < xor(b, flip, length)
