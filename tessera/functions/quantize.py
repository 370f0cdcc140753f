"""Quantisation of numbers and unit vectors, as column expressions.

Half numbers and shortened floats round to nearest with ties away from zero, flush what is below the least normal number to zero, and
overflow to infinity; the normalised integers clamp to their range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a half number: the bias of its exponent, the bits of its mantissa, and the pattern of infinity; fixed by IEEE 754.
BIAS, MANTISSA, INFINITY = 15, 10, 0x7C00


def _sign(v: Column) -> Column:
    return F.when(v < 0, -1.0).otherwise(1.0)


def unorm(v: Column, bits: int) -> Column:
    """0 to 1 as a whole number of so many bits; below 0 is 0, above 1 is 1, NaN and null are null."""
    return F.when(~F.isnan(v), F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * float((1 << bits) - 1) + 0.5)).cast("int")


def from_unorm(q: Column, bits: int) -> Column:
    return q / F.lit(float((1 << bits) - 1))


def snorm(v: Column, bits: int) -> Column:
    """-1 to 1 as a signed whole number of so many bits."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v))
    return F.when(~F.isnan(v), _sign(v) * F.floor(F.abs(clamped) * float((1 << bits - 1) - 1) + 0.5)).cast("int")


def from_snorm(q: Column, bits: int) -> Column:
    return F.greatest(F.lit(-1.0), q / F.lit(float((1 << bits - 1) - 1)))


def _exponent(x: Column) -> Column:
    """The exponent of two of x > 0; the logarithm may be off by a rounding next to a power."""
    e = F.floor(F.log2(x))
    return e + F.when(F.pow(F.lit(2.0), e) > x, -1).when(F.pow(F.lit(2.0), e + 1) <= x, 1).otherwise(0)


def half(v: Column) -> Column:
    """The 16 bits of the half number (as an int)."""
    x = F.abs(v.cast("double"))
    e = _exponent(x)
    m = F.floor(x / F.pow(F.lit(2.0), e - MANTISSA) + 0.5)
    bits = F.when(x < 2.0 ** (1 - BIAS), 0).when(x >= 2.0 ** (BIAS + 1), INFINITY).otherwise(F.least(F.lit(INFINITY).cast("double"), (e + BIAS) * 1024 + m - 1024))
    nan = F.isnan(v)
    return F.when(nan, INFINITY | 512).otherwise(F.when(v < 0, 0x8000).otherwise(0) + bits).cast("int")


def from_half(h: Column) -> Column:
    """The number that the 16 bits stand for, as a double."""
    low = h.bitwiseAND(F.lit(0x7FFF))
    e, m = F.floor(low / 1024), low % 1024
    size = F.when(low < 1024, 0.0).when(low == INFINITY, float("inf")).when(low > INFINITY, float("nan")).otherwise(F.pow(F.lit(2.0), e - BIAS) * (1 + m / 1024))
    return size * F.when(h >= 0x8000, -1.0).otherwise(1.0)


def shortened(v: Column, bits: int) -> Column:
    """The float with a mantissa of so many bits."""
    x = F.abs(v.cast("double"))
    step = F.pow(F.lit(2.0), _exponent(x) - bits)
    rounded = _sign(v) * F.floor(x / step + 0.5) * step
    return F.when(F.isnan(v) | (x == float("inf")), v.cast("double")).when(x < 2.0**-126, 0.0).otherwise(rounded).cast("float")


def octahedral(x: Column, y: Column, z: Column, bits: int) -> tuple[Column, Column]:
    """A direction as two signed whole numbers: projected on an octahedron, whose lower half is folded outwards."""
    size = F.abs(x) + F.abs(y) + F.abs(z)
    px, py = (F.when(size > 0, c / size).otherwise(0.0) for c in (x, y))
    u = F.when(z >= 0, px).otherwise((1 - F.abs(py)) * _sign(px))
    v = F.when(z >= 0, py).otherwise((1 - F.abs(px)) * _sign(py))
    return snorm(u, bits), snorm(v, bits)


def from_octahedral(u: Column, v: Column, bits: int) -> tuple[Column, Column, Column]:
    """The unit vector that two signed whole numbers stand for."""
    x, y = from_snorm(u, bits), from_snorm(v, bits)
    z = 1 - F.abs(x) - F.abs(y)
    fold = F.least(z, F.lit(0.0))
    x, y = x + _sign(x) * fold, y + _sign(y) * fold
    size = F.sqrt(x * x + y * y + z * z)
    return x / size, y / size, z / size


#: Least exponent of a shared power of two; a fixed value of the format.
LEAST_POWER = -100


def quaternion(q: tuple[Column, Column, Column, Column], bits: int) -> tuple[Column, ...]:
    """A unit quaternion as three signed whole numbers of so many bits and the place of the fourth: the greatest component (the first on
    ties) is left out and made positive, the others follow it in a circle; the last number is full scale but for its two low bits, which hold the place."""
    size = [F.abs(c) for c in q]
    place = F.lit(0)
    for k in (1, 2, 3):  # the greatest before k is the greatest of all those
        place = F.when(size[k] > F.greatest(*size[:k], F.lit(0.0)), k).otherwise(place)
    parts = F.array(*q)
    sign = _sign(parts[place])
    others = [snorm(parts[(place + k) % 4] * 2.0**0.5 * sign, bits) for k in (1, 2, 3)]
    return (*others, (F.lit(((1 << bits - 1) - 1) & ~3) + place).cast("int"))


def from_quaternion(d: tuple[Column, Column, Column, Column]) -> tuple[Column, ...]:
    """The four components as signed whole numbers of 16 bits."""
    full, place = (d[3].bitwiseOR(F.lit(3))).cast("double"), d[3].bitwiseAND(F.lit(3))
    left = 2 * full * full - sum(c.cast("double") * c for c in d[:3])
    every = [F.sqrt(F.greatest(left, F.lit(0.0))), *(c.cast("double") for c in d[:3])]
    scaled = F.array(*(_sign(c) * F.floor(F.abs(c) * (32767 / 2.0**0.5) / full + 0.5) for c in every))
    return tuple(scaled[F.pmod(F.lit(k) - place, F.lit(4))].cast("int") for k in range(4))


def power(v: Column, least: int = LEAST_POWER) -> Column:
    """The least power of two above |v| as an exponent, 0 for zero, and not below ``least``. The greatest over the components of a vector, or
    over the rows of a column, is a power that they can share."""
    x = F.abs(v.cast("double"))
    return F.greatest(F.when(x == 0, 0).otherwise(_exponent(x) + 1), F.lit(least)).cast("int")


def exponential(v: Column, power_of: Column, bits: int) -> Column:
    """v as a whole number of so many bits times a power of two: the number in 24 bits, the exponent in the 8 above (an int)."""
    e = power_of - (bits - 1)
    m = _sign(v) * F.floor(F.abs(v.cast("double")) * F.pow(F.lit(2.0), -e) + 0.5)
    return F.shiftleft(e.cast("int"), 24).bitwiseOR(m.cast("int").bitwiseAND(F.lit(0xFFFFFF)))


def from_exponential(code: Column) -> Column:
    return F.shiftright(F.shiftleft(code, 8), 8) * F.pow(F.lit(2.0), F.shiftright(code, 24))


def color(r: Column, g: Column, b: Column, a: Column, bits: int) -> tuple[Column, ...]:
    """Red, green, blue and alpha (0 to 1) as luma, two signed differences and alpha with a bit less, whose highest bit tells how many bits there are."""
    red, green, blue = (unorm(c, bits) for c in (r, g, b))
    orange = ((red - blue) / 2).cast("int")
    base = blue + orange
    lime = ((green - base) / 2).cast("int")
    return base + lime, orange, lime, F.shiftright(unorm(a, bits), 1) + (1 << bits - 1)


def from_color(y: Column, orange: Column, lime: Column, a: Column, width: int = 8) -> tuple[Column, ...]:
    """Red, green, blue and alpha as whole numbers of ``width`` bits."""
    full = (F.pow(F.lit(2.0), _exponent(a.cast("double")) + 1) - 1).cast("int")
    alpha = F.shiftleft(a, 1).bitwiseAND(full).bitwiseOR(a.bitwiseAND(F.lit(1)))
    return tuple(F.floor(c * (F.lit(float((1 << width) - 1)) / full) + 0.5).cast("int") for c in (y + orange - lime, y + lime, y - orange - lime, alpha))
