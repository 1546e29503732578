"""Pseudo-random whole numbers from ids and a seed, by arithmetic that any SQL engine has.

Each id is mixed in by a shift, an xor and a product modulo 2 ** 32, so that equal ids and seeds give equal numbers
wherever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixing step.
RANGE, FACTOR, SHIFTS = 1 << 32, 0x45D9F3B, (16, 15)


def spread(seed: int, *ids: str) -> Column:
    """A number from 0 to 2 ** 32 - 1 for the ids in these columns; null if one is null."""
    x = F.lit(seed % RANGE).cast("long")
    for name in ids:
        x = F.pmod(x + F.pmod(F.col(name).cast("long"), F.lit(RANGE)), F.lit(RANGE))
        for shift in SHIFTS:
            x = F.pmod(x.bitwiseXOR(F.shiftright(x, shift)) * FACTOR, F.lit(RANGE))
    return x.bitwiseXOR(F.shiftright(x, SHIFTS[0]))


def spread_sql(seed: int, *ids: str) -> str:
    """The same as SQL; ids are not negative there."""
    x = str(seed % RANGE) + "::BIGINT"
    for name in ids:
        x = f"(({x} + {name}) % {RANGE})"
        for shift in SHIFTS:
            x = f"((xor({x}, {x} >> {shift}) * {FACTOR}) % {RANGE})"
    return f"xor({x}, {x} >> {SHIFTS[0]})"
