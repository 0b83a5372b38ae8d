"""Bit fields of binary columns, as column expressions; checksums and codes where Python is needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def uint(raw: Column, at: int | Column, size: int = 1) -> Column:
    """Big-endian unsigned integer of ``size`` bytes from 0-based byte ``at`` (null beyond the end)."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.substring(raw, at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def uint_le(raw: Column, at: int, size: int) -> Column:
    """Little-endian unsigned integer."""
    out = uint(raw, at)
    for k in range(1, size):
        out = out + F.shiftleft(uint(raw, at + k), 8 * k)
    return out


def bits(value: Column, shift: int, mask: int) -> Column:
    """``(value >> shift) & mask``."""
    return F.shiftright(value, shift).bitwiseAND(mask)


def flag(value: Column, mask: int) -> Column:
    """Whether any bit of ``mask`` is set."""
    return value.bitwiseAND(mask) != 0


def be(value: Column, size: int) -> Column:
    """An unsigned value as ``size`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def ipv4_text(value: Column) -> Column:
    """Dotted text of a 32-bit address."""
    return F.concat_ws(".", *[bits(value, s, 255).cast("string") for s in (24, 16, 8, 0)])


def ipv4_value(text: Column) -> Column:
    """32-bit address of dotted text; null if it is not one."""
    parts = F.split(text, r"\.")
    ok = text.rlike(r"^(\d{1,3})(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.cast("int") <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long")))


def set_bits(value: Column, width: int = 16) -> Column:
    """Numbers of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftright", value, i).bitwiseAND(1) == 1)


def _crc_table() -> np.ndarray:
    rows = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        rows.append(c)
    return np.array(rows, np.uint32)


_CRC = _crc_table()


def crc32_mpeg_of(data: bytes, crc: int = 0xFFFFFFFF) -> int:
    """CRC-32 of polynomial 04C11DB7, not reflected, from all ones."""
    table = _CRC
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ int(table[crc >> 24 ^ b])
    return crc


@F.pandas_udf(T.LongType())
def crc32_mpeg(raw: pd.Series) -> pd.Series:
    """CRC-32/MPEG-2 of a binary column, all rows of a batch together."""
    rows = [x or b"" for x in raw]
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(x) for x in rows])
    for at in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > at)
        byte = np.fromiter((rows[i][at] for i in on), np.uint32, len(on))
        crc[on] = crc[on] << np.uint32(8) ^ _CRC[crc[on] >> np.uint32(24) ^ byte]
    return pd.Series(crc.astype(np.int64)).where(raw.notna().to_numpy())


class BitReader:
    """Bits of a byte string from the most significant on."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        """The next n bits."""
        if n > self.left:
            raise EOFError("out of bits")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def ue(self) -> int:
        """Unsigned Exp-Golomb code."""
        zeros = 0
        while not self.read(1):
            zeros += 1
        return (1 << zeros) - 1 + (self.read(zeros) if zeros else 0)

    def se(self) -> int:
        """Signed Exp-Golomb code."""
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def unescape(data: bytes) -> bytes:
    """Removes emulation prevention: the 03 of each 00 00 03."""
    out, at, zeros = bytearray(), 0, 0
    for at in range(len(data)):
        b = data[at]
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        zeros = zeros + 1 if b == 0 else 0
        out.append(b)
    return bytes(out)


def escape(data: bytes) -> bytes:
    """Inserts 03 before any byte of 3 or less after two zeros."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        zeros = zeros + 1 if b == 0 else 0
        out.append(b)
    return bytes(out)


@F.pandas_udf(T.BinaryType())
def remove_emulation_prevention(raw: pd.Series) -> pd.Series:
    """Emulation prevention removed from a binary column."""
    return raw.map(lambda x: x if x is None or b"\x00\x00\x03" not in x else unescape(x))


@F.pandas_udf(T.ArrayType(T.LongType()))
def exp_golomb(raw: pd.Series, n: pd.Series) -> pd.Series:
    """The first n unsigned Exp-Golomb values of a binary column (fewer if bits run out)."""

    def one(data, count):
        out, reader = [], BitReader(data or b"")
        try:
            for _ in range(count):
                out.append(reader.ue())
        except EOFError:
            pass
        return out

    return pd.Series([one(x, k) for x, k in zip(raw, n)])
