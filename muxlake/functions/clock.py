"""33-bit and 27 MHz clock arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PTS_MOD = 1 << 33
PCR_MOD = 300 << 33
PCR_HZ = 27_000_000


def pts_signed_diff(x: Column, y: Column) -> Column:
    """x - y of two 33-bit times, as the nearest signed distance."""
    return F.shiftright(F.shiftleft((x - y).cast("long"), 31), 31)


def pts_diff_abs(x: Column, y: Column) -> Column:
    """Distance of two 33-bit times."""
    return F.abs(pts_signed_diff(x, y))


def pcr_unsigned_diff(x: Column, y: Column, compat: bool = False) -> Column:
    """x - y of two 27 MHz times going forward; equal times are 0 (compat: a whole turn)."""
    forward = F.pmod((x - y).cast("long"), F.lit(PCR_MOD))
    return F.when(forward == 0, F.lit(PCR_MOD)).otherwise(forward) if compat else forward


def pcr_signed_diff(x: Column, y: Column) -> Column:
    """x - y of two 27 MHz times, as the nearest signed distance."""
    forward = pcr_unsigned_diff(x, y)
    return F.when(forward > PCR_MOD // 2, forward - PCR_MOD).otherwise(forward)


def pcr_unsigned_wrap(x: Column) -> Column:
    """A 27 MHz time brought into one turn."""
    return F.pmod(x.cast("long"), F.lit(PCR_MOD))


def estimate_pcr(pos: Column, prev_pos: Column, prev_pcr: Column, rate: Column) -> Column:
    """The time expected at ``pos`` from the last time and a rate in bytes a second."""
    return (prev_pcr.cast("double") + (F.lit(27000000.0) * (pos - prev_pos).cast("double")) / rate).cast("long")


def format_hms(pcr: Column, signed: bool = False) -> Column:
    """h:mm:ss.mmmm of a 27 MHz time; the fraction is milliseconds in four digits."""
    n = F.abs(pcr) if signed else pcr
    us = F.floor(n / 27).cast("long")
    sec = F.floor(us / 1_000_000).cast("long")
    text = F.format_string("%d:%02d:%02d.%04d", F.floor(sec / 3600).cast("long"), F.floor(sec / 60).cast("long") % 60, sec % 60, F.floor((us % 1_000_000) / 1000).cast("long"))
    return F.when(pcr < 0, F.concat(F.lit("-"), text)).otherwise(text) if signed else text


#: Names of time formats on the command line of reports.
FORMATS = ("90", "27", "32", "ms", "hms")


def format_time(pcr: Column, kind: str) -> Column:
    """A 27 MHz time in one of ``FORMATS``."""
    if kind == "90":
        return F.format_string("%dt", F.floor(pcr / 300).cast("long"))
    if kind == "27":
        return F.format_string("%d:%03dt", F.floor(pcr / 300).cast("long"), F.pmod(pcr, F.lit(300)))
    if kind == "32":
        return F.format_string("%dt", F.floor(pcr / 300).cast("long").bitwiseAND(0xFFFFFFFF))
    if kind == "ms":
        return F.format_string("%dms", F.floor(pcr / 27000).cast("long"))
    if kind == "hms":
        return format_hms(pcr)
    raise ValueError(f"time format {kind}: not one of {FORMATS}")
