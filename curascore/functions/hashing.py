"""Reproducible randomness: every draw is a function of a seed and a row id, never of the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seed_key(seed: int | str, row_id: Column | str) -> Column:
    """Sort key of a seeded shuffle; ties cannot differ between runs once ``row_id`` follows in the order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_of(row_id).cast("string")))


def hex_word(digest: Column, word: int) -> Column:
    """The ``word``-th (0-3) unsigned 32-bit integer of an md5 digest, as bigint."""
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def seeded_int(seed: int | str, row_id: Column | str, n: int) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(hex_word(seed_key(seed, row_id), 0), F.lit(n).cast("bigint"))


def key_below(share: Column) -> Column:
    """Text bound below which about ``share`` of all ``seed_key`` values lie; above every key from a share of 1 on."""
    digits = F.lower(F.lpad(F.hex(F.floor(F.greatest(share, F.lit(0.0)) * float(16**13)).cast("bigint")), 13, "0"))
    return F.when(share >= 1, F.lit("g")).otherwise(digits)


def seeded_unit(seed: int | str, row_id: Column | str) -> Column:
    """Uniform double in [0, 1) with 52 random bits."""
    digest = seed_key(seed, row_id)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def salt_of(row_id: Column | str, salts: int) -> Column:
    """Salt that depends on row content only, so that a retried task sends each row to the same place."""
    return F.pmod(F.xxhash64(col_of(row_id)), F.lit(salts)).cast("int")
