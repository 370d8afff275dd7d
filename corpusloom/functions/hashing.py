"""Unsigned 64-bit arithmetic on signed longs, and the salts of n-gram addresses."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Salts are drawn from this name; give another to get another family of addresses.
DOMAIN = "corpusloom.v1"
#: Added to every canonical id before mixing (2**64 over the golden ratio).
GOLD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def const64(order: int, head: int, field: str, domain: str = DOMAIN) -> int:
    """First eight bytes, little-endian, of the SHA-256 of the salt's name.

    Fields are ``mul``, ``seed``, ``affA`` and ``affB``: fixed values of the addresses' format.
    """
    return int.from_bytes(hashlib.sha256(f"{domain}:n={order}:k={head}:{field}".encode()).digest()[:8], "little")


def multiplier(order: int, head: int, domain: str = DOMAIN) -> int:
    return const64(order, head, "mul", domain) | 1


def affine(head: int, modulus: int, domain: str = DOMAIN) -> tuple[int, int]:
    """Factor and offset of the one-to-one address of single ids."""
    return const64(1, head, "affA", domain) % (modulus - 1) + 1, const64(1, head, "affB", domain)


def smallest_prime_at_least(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def mul64(a: Column, by: int) -> Column:
    """``a * by`` modulo 2**64 in limbs of 22, 22 and 20 bits: six products, and no step leaves the range of long."""
    low = (1 << 22) - 1
    x = [a.bitwiseAND(F.lit(low)), F.shiftrightunsigned(a, 22).bitwiseAND(F.lit(low)), F.shiftrightunsigned(a, 44)]
    m = [F.lit((by & MASK) >> (22 * k) & low).cast("long") for k in range(3)]
    s0 = x[0] * m[0]
    s1 = x[0] * m[1] + x[1] * m[0] + F.shiftrightunsigned(s0, 22)
    s2 = x[0] * m[2] + x[1] * m[1] + x[2] * m[0] + F.shiftrightunsigned(s1, 22)
    return s0.bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(s1.bitwiseAND(F.lit(low)), 22)).bitwiseOR(F.shiftleft(s2, 44))


def umod(a: Column, modulus: int) -> Column:
    """The unsigned value of ``a`` modulo ``modulus``."""
    m = F.lit(modulus).cast("long")
    return F.pmod(F.pmod(a, m) + F.when(a < 0, F.lit((1 << 64) % modulus)).otherwise(F.lit(0)), m)
