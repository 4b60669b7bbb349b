"""Unsigned 64-bit arithmetic in BIGINT columns that carry the same bits.

Products wrap modulo 2**64 only where ANSI mode is off while the expression is analysed, so plans that multiply
are built within ``wrapping(spark)``. The setting is restored afterwards and the built plan keeps wrapping.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MASK = 2**64 - 1
SIGN = -(2**63)

# The factors and addends of the first 32 linear transforms, the seed of further ones, the
# window fold's start and factor, the multiplier of the window's bits and the mixer's factors.
LINEAR_A = (
    0x76931FAC9DAB2B36, 0xC248B87D6AE33F9A, 0x62D7183A5D5789E4, 0xB2D6B441E2411DC7, 0x09E111C7E1E7ACB6, 0xF8CAC0BB2FC4C8BC, 0x2AE3BAAAB9165CC4, 0x58E199CB89F51B13,
    0x5F7091A5ABB0874D, 0xF3E8CB4543A5EB93, 0xB0441E9CA4C2B0FB, 0x3D30875CBF29ABD5, 0xB1ACF38984B35AE8, 0x82809DD4CFE7ABC5, 0xC61BAA52E053B4C3, 0x643F204EF259D2E9,
    0x8042A948AAC5E884, 0xCB3EC7DB925643FD, 0x34FDD467E2CCA406, 0x035CB2744CB90A63, 0xE51C973790334394, 0x7E02086541E4C48A, 0x99630AA9AECE1538, 0x43A4B190274EBC95,
    0x5F8592E30A2205A4, 0x85846248987550AA, 0xF2094EC59E7931DC, 0x650C7451CC61C0CB, 0x2C46A1B3F2C349FA, 0xFF763C7F8D14DDFF, 0x946351744378D62C, 0x59285A8D7915614F,
)
LINEAR_B = (
    0x38667B6ED2B2FCAB, 0x04ABAE8676E318B4, 0x02A7D15B30D2D7DD, 0xB78650CC6AF82BC3, 0xD7AA805B02DD9AA5, 0x23B7374A1323EE6B, 0x516D1B81E5F709C2, 0xC790EDAF1C3FA9B0,
    0xA1DBC6DABC2B5ED2, 0x67244C458752002B, 0x106D6381FAD58A7E, 0x193657BDE0FE0291, 0x20F8379316891F82, 0x8B8D24A049E5B86D, 0x855BCFED56765F9D, 0xA1AC54CAEAF9257A,
    0xBC67B451BC70B0E5, 0x2817DD1B704A6B41, 0x8A83FD4A9CA4C89E, 0x1A6E779F8D9E9DF1, 0x8747591E5B314C05, 0x763EDCD59632423C, 0xA83F14D6F073D784, 0xDB2B7001643A6760,
    0xF9F0DD6DDD0A59E2, 0x41DC1ED720287896, 0x286F5CC3ADDF6C1A, 0xDF6ED35F477B0022, 0x981E5E1FBFE1BFB8, 0xE26B5BA93253275B, 0xF6A44B3FA1051CDF, 0xE3B3F5D2725A9A58,
)
TRANSFORM_SEED = 0x7F4A7C159E3779B9
FOLD_START, FOLD_FACTOR = 1469598103934665603, 1099511628211
BITS_FACTOR = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Within it, arithmetic of plans being built wraps."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def signed(x: int) -> int:
    """The BIGINT of the same 64 bits."""
    x &= MASK
    return x - 2**64 if x >= 2**63 else x


def lit(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def linear_parameters(n: int, seed: int = TRANSFORM_SEED) -> list[tuple[int, int]]:
    """(a, b) of ``n`` transforms: the fixed ones first, then a SplitMix64 stream whose factors are made odd."""
    state = seed

    def draw() -> int:
        nonlocal state
        state = (state + SPLITMIX[0]) & MASK
        z = state
        z = (z ^ z >> 30) * SPLITMIX[1] & MASK
        z = (z ^ z >> 27) * SPLITMIX[2] & MASK
        return z ^ z >> 31

    out = list(zip(LINEAR_A, LINEAR_B, strict=True))[:n]
    while len(out) < n:
        a = draw()
        out.append((a if a & 1 else a + 1 & MASK, draw()))
    return out


def mixed(x: Column) -> Column:
    """The 64-bit mixer; build it within ``wrapping``."""
    for factor in (MIX_1, MIX_2):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 33)) * lit(factor)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def ordered(x: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of ``x``; the same step undoes it."""
    return x.bitwiseXOR(lit(SIGN))


def decimal_text(x: Column) -> Column:
    """The unsigned decimal of the bits."""
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)")).cast("string")


def fnv(values: Column) -> Column:
    """Fold of an array of BIGINT: xor, then multiply; build it within ``wrapping``."""
    return F.aggregate(values, lit(FOLD_START), lambda a, v: a.bitwiseXOR(v) * lit(FOLD_FACTOR))
