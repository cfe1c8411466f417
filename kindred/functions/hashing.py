"""Columns over 16-digit hexadecimal hashes: bits, distances, chunks, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID = "^[0-9a-fA-F]{16}$"
CHUNKS, CHUNK_BITS = 4, 16


def is_valid_hash(h: Column) -> Column:
    return F.coalesce(h.rlike(VALID), F.lit(False))


def bits_of(h: Column) -> Column:
    """Signed long with the hash's 64 bits; null for a null or malformed hash."""
    return F.when(is_valid_hash(h), F.conv(h, 16, -10).cast("long"))


def hex_of(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal strings of 16 digits."""
    return hamming(bits_of(a), bits_of(b))


def chunk(bits: Column, k: int) -> Column:
    """The k-th 16 bits, 0 being the highest."""
    return F.shiftrightunsigned(bits, CHUNK_BITS * (CHUNKS - 1 - k)).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")


def chunk_hex(h: Column, k: int) -> Column:
    """The k-th four hexadecimal digits as a number."""
    return F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("int")


def masks(radius: int) -> list[int]:
    """All 16-bit masks of at most ``radius`` (0 to 2) bits, by number of bits."""
    ones = [1 << i for i in range(CHUNK_BITS)]
    twos = [a | b for i, a in enumerate(ones) for b in ones[i + 1 :]]
    return [0, *ones, *twos][: (1, 17, 137)[radius]]


def first_hash(hashes: Column) -> Column:
    return F.coalesce(F.get(hashes, F.lit(0)), F.lit("unknown"))


def evidence(h: Column) -> Column:
    return F.concat(F.lit("Perceptual hash · "), h)
