"""Row hashes over canonical text, their 32-bit slices, and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlake.functions.canonical import SEPARATOR

#: 2**64: checksums are sums modulo this number.
MODULUS = 18446744073709551616


def row_hash(texts: Sequence[Column], *, exact: bool = False) -> Column:
    """MD5 of the texts joined by the separator; ``exact`` prefixes lengths, so that no two rows share a text."""
    parts = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts] if exact else texts
    return F.md5(F.concat_ws(SEPARATOR, *parts))


def crc_hash(texts: Sequence[Column]) -> Column:
    """CRC-32 of the texts joined by the separator (cheaper, for rough comparisons)."""
    return F.crc32(F.concat_ws(SEPARATOR, *texts))


def hash_slice(h: Column, i: int) -> Column:
    """Slice i (0 to 3) of a hash: 8 hex digits as a number."""
    return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")


def half(h: Column, i: int) -> Column:
    """Half i (0 or 1) of a hash: 16 hex digits as a signed number."""
    return F.conv(F.substring(h, 16 * i + 1, 16), 16, -10).cast("bigint")


def whole(h0: Column, h1: Column) -> Column:
    """The hash whose halves these are."""
    return F.lower(F.concat(F.lpad(F.hex(h0), 16, "0"), F.lpad(F.hex(h1), 16, "0")))


def slices_of_halves(h0: Column, h1: Column) -> list[Column]:
    """All four slices of a hash, from its halves."""
    return [x for h in (h0, h1) for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def bucket(h: Column, n: int) -> Column:
    return hash_slice(h, 0) % F.lit(n)


def sum_modulo(slices: Column) -> Column:
    """The sum of 32-bit numbers modulo 2**64 as decimal(20,0), exact for up to 2**46 rows.

    The halves are summed as bigint, so the aggregation stays in generated code.
    """
    low, high = F.sum(slices.bitwiseAND(65535)), F.sum(F.shiftright(slices, 16))
    total = high.cast("decimal(38,0)") * F.lit(65536).cast("decimal(6,0)") + low.cast("decimal(38,0)")
    return (F.coalesce(total, F.lit(0).cast("decimal(38,0)")) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")
