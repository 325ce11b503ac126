"""A seeded uniform order on ids that every engine and every run computes alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import as_column

SEED = 42
BUCKET_DIGITS = 4


def seeded_hash(key: Column | str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), as_column(key).cast("string")))


def bucket(hashed: Column | str, digits: int = BUCKET_DIGITS) -> Column:
    """Leading hex digits of a hash: 16**digits buckets of about equal size, whatever the keys."""
    return F.substring(as_column(hashed), 1, digits)


def in_share(hashed: Column, share: float) -> Column:
    """True for the hashes below the share; a share that rounds to none or all is no comparison at all."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    bound = share_bound(share)
    if int(bound, 16) == 0:
        return F.lit(False)
    return F.lit(True) if len(bound) > 8 else hashed < bound


def share_bound(share: float, digits: int = 8) -> str:
    """The hex prefix below which the given share of all hashes lies."""
    return format(round(share * 16**digits), f"0{digits}x")
