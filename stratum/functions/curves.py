"""Space-filling curves, tiles and map projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks that spread the bits of a 32-bit number to every second place of 64.
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
#: Fixed value: the latitude at which the square Mercator world ends.
MERCATOR_LIMIT = 85.051129


def _let(v: Column, f) -> Column:
    """f(v) with v computed once, however often f names it."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def _spread(v: Column) -> Column:
    for shift, mask in _SPREAD:
        v = _let(v, _spread_step(shift, mask))
    return v


def _spread_step(shift: int, mask: int):
    return lambda a: a.bitwiseOR(F.shiftleft(a, shift)).bitwiseAND(F.lit(mask))


def _gather_step(shift: int, mask: int):
    return lambda a: a.bitwiseOR(F.shiftrightunsigned(a, shift)).bitwiseAND(F.lit(mask))


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0xFFFFFFFF]):
        v = _let(v, _gather_step(shift, mask))
    return v


def z_order(x: Column, y: Column) -> Column:
    """Interleaves two numbers below 2**31: x on the odd bits, y on the even ones."""
    return F.shiftleft(_spread(x.cast("long")), 1).bitwiseOR(_spread(y.cast("long")))


def z_decode(z: Column) -> tuple[Column, Column]:
    return _gather(F.shiftrightunsigned(z, 1)), _gather(z)


def z_range_box(first: Column, last: Column) -> Column:
    """Struct (x1, y1, x2, y2), whole numbers, both ends included: the rectangle of the least aligned block of the curve that holds all places from ``first`` to ``last``."""
    differ = first.bitwiseXOR(last).cast("long")
    below = F.when(differ == 0, F.lit(0).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(differ))).cast("long") - 1)
    (x1, y1), (x2, y2) = z_decode(first.bitwiseAND(F.bitwise_not(below))), z_decode(first.bitwiseOR(below))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def scaled(v: Column, low: float, high: float, bits: int) -> Column:
    """A coordinate as a whole number of ``bits`` bits, clamped."""
    top = (1 << bits) - 1
    extent = (high - low) or 1.0
    return F.least(F.greatest(F.floor((v - low) / extent * top), F.lit(0)), F.lit(top)).cast("long")


def hilbert(x: Column, y: Column, order: int = 15) -> Column:
    """Place on the Hilbert curve of 2**order cells a side, as one expression without a UDF: a fold over the bits."""
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(order))])
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a, s):
        s = s.cast("long")
        rx = F.when(a["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(a["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        x0, y0 = a["x"].bitwiseAND(s - 1), a["y"].bitwiseAND(s - 1)
        fx = F.when((ry == 0) & (rx == 1), s - 1 - x0).otherwise(x0)
        fy = F.when((ry == 0) & (rx == 1), s - 1 - y0).otherwise(y0)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(bits, start, step, lambda a: a["d"])


def tile_encode(z: Column, x: Column, y: Column) -> Column:
    return F.shiftleft(z.cast("long"), 40).bitwiseOR(F.shiftleft(x.cast("long"), 20)).bitwiseOR(y.cast("long"))


def tile_decode(t: Column) -> tuple[Column, Column, Column]:
    part = F.lit((1 << 20) - 1).cast("long")
    return F.shiftright(t, 40).cast("int"), F.shiftright(t, 20).bitwiseAND(part).cast("int"), t.bitwiseAND(part).cast("int")


def tile_parent(t: Column) -> Column:
    z, x, y = tile_decode(t)
    return F.when(z > 0, tile_encode(z - 1, F.shiftright(x, 1), F.shiftright(y, 1)))


def tile_box(t: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Struct of the tile's rectangle within the space x1..y2."""
    z, x, y = tile_decode(t)
    n = F.pow(F.lit(2.0), z)
    w, h = F.lit(x2 - x1) / n, F.lit(y2 - y1) / n
    return F.struct((x1 + x * w).alias("x1"), (y1 + y * h).alias("y1"), (x1 + (x + 1) * w).alias("x2"), (y1 + (y + 1) * h).alias("y2"))


def mercator_y(lat: Column) -> Column:
    """Degrees to degrees: the world is 360 by 360."""
    clamped = F.least(F.greatest(lat, F.lit(-MERCATOR_LIMIT)), F.lit(MERCATOR_LIMIT))
    return F.degrees(F.log(F.tan(F.radians(clamped) / 2 + F.lit(0.7853981633974483))))


def mercator_world(lon: Column, lat: Column, size: float = 256.0) -> tuple[Column, Column]:
    """To the unit square of ``size``, y downwards."""
    return (lon + 180) / 360 * size, (0.5 - mercator_y(lat) / 360) * size


def sinusoidal_tile(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(h, v) of the 10-degree tile of the sinusoidal grid: h 0-35, v 0-17 from the north."""
    h = F.floor((lon * F.cos(F.radians(lat)) + 180) / 10)
    v = F.floor((90 - lat) / 10)
    return F.least(F.greatest(h, F.lit(0)), F.lit(35)).cast("int"), F.least(F.greatest(v, F.lit(0)), F.lit(17)).cast("int")


def sinusoidal_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """From sinusoidal degrees back; y is the latitude."""
    return x / F.cos(F.radians(y)), y
