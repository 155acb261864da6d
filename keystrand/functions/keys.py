"""Key expressions: reserved keys, order-preserving bytes, composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType

#: Native keys are longs in 1 .. 2^63 - 1; 0 is reserved, and so is the largest unsigned key.
MIN_KEY, MAX_KEY = 1, 2**63 - 1
UNSIGNED_MAX = 2**64 - 1


def is_reserved(key: Column, kind: DataType | None = None) -> Column:
    """Keys that no record may have: null, and long keys under 1."""
    return key.isNull() if isinstance(kind, (BinaryType, StringType)) else key.isNull() | (key < MIN_KEY)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two byte keys."""
    same = lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
    lengths = F.sequence(F.lit(0), F.least(F.octet_length(a), F.octet_length(b)))
    return F.substring(a, F.lit(1), F.array_max(F.filter(lengths, same)))


def key_bytes(key: Column) -> Column:
    """Eight big-endian bytes; binary order equals key order."""
    return F.unhex(F.lpad(F.hex(key), 16, "0"))


def key_head(key: Column) -> Column:
    """First eight bytes of a binary key, zero-filled, as an unsigned decimal(20,0)."""
    head = F.rpad(F.hex(F.substring(key, 1, 8)), 16, "0")
    return F.conv(head, 16, 10).cast("decimal(20,0)")


def composite_key(high: Column, low: Column, low_bits: int = 48) -> Column:
    """``high`` above ``low_bits`` bits of ``low``."""
    return F.shiftleft(high.cast("long"), low_bits).bitwiseOR(low.cast("long").bitwiseAND(F.lit((1 << low_bits) - 1)))


def split_key(key: Column, low_bits: int = 48) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, low_bits), key.bitwiseAND(F.lit((1 << low_bits) - 1))


def z_order(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaves the low bits of two cell coordinates; near cells get near keys."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for c, k in ((x, 2 * i), (y, 2 * i + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), k))
    return out
