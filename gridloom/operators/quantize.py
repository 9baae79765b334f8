"""Bytes whose block sums are exact, with or without ordered dither."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import Index, at, div, grid, let, lit


class Dither(IntEnum):
    NONE = 0
    ORDERED = 1


AMPLITUDE = 0.5
#: Largest sample of bytes, and of planes of counts that are no bytes.
BYTE, COUNT = 255, 2**31 - 1


def bayer(n: int = 8) -> list[int]:
    """The n x n ordered-dither matrix (n a power of 2), row by row."""
    m = [[0]]
    while len(m) < n:
        k = len(m)
        m = [[4 * m[y % k][x % k] + (0, 2, 3, 1)[2 * (y >= k) + (x >= k)] for x in range(2 * k)] for y in range(2 * k)]
    return [v for row in m for v in row]


def bayer_threshold(y: Column, x: Column, amplitude: float = AMPLITUDE) -> Column:
    table = F.array(*(F.lit((b / 64.0 - 0.5) * amplitude) for b in bayer()))
    return at(table, (y % 8) * 8 + x % 8)


def byte(v: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), v))


def exact_block(block: Column, target: Column) -> Column:
    """Bytes (int array) of a block that add up to ``target`` as nearly as bytes can.

    Samples are rounded; what the sum misses is made up in unit steps, first
    where the rest is largest in the needed direction, then at the lowest
    place, a sample's k-th step counting k less. Saturated samples stay.
    """

    def fixed(c: Column) -> Column:
        def stepped(q: Column) -> Column:
            # Half away from zero, as for targets that are no whole numbers.
            aim = F.when(target >= 0, F.floor(target + 0.5)).otherwise(-F.floor(0.5 - target)).cast("int")
            missing = aim - F.aggregate(q, F.lit(0), lambda a, b: a + b)

            def steps(e: Column) -> Column:
                up, need = e > 0, F.abs(e)

                def of(v: Column, i: Column) -> Column:
                    room = F.least(F.when(up, 255 - at(q, i)).otherwise(at(q, i)), need)
                    rest = v - at(q, i)
                    key = F.when(up, rest).otherwise(-rest)
                    return F.when(room > 0, F.transform(F.sequence(F.lit(0), F.greatest(room - 1, F.lit(0))), lambda k: F.struct((k - key).alias("late"), i.alias("i"))))

                every = F.flatten(F.filter(F.transform(c, of), lambda a: a.isNotNull()))
                taken = F.transform(F.slice(F.array_sort(every), F.lit(1), F.greatest(need, F.lit(1))), lambda s: s["i"])
                moved = let(taken, lambda t: F.transform(q, lambda b, i: (b + F.when(up, 1).otherwise(-1) * F.size(F.filter(t, lambda j: j == i))).cast("int")))
                return F.when(e == 0, q).otherwise(moved)

            return let(missing, steps)

        return let(F.transform(c, lambda v: F.floor(v + 0.5).cast("int")), stepped)

    return let(F.transform(block, byte), fixed)


def exact(x: Column, y: Column, w: Index, h: Index, scale: int, dither: Dither = Dither.NONE, amplitude: float = AMPLITUDE) -> Column:
    """The plane x (scale times as large as y) in bytes; each block sums to scale * scale times y's sample."""
    w, h = lit(w), lit(h)
    wide = w * scale

    def planes(u: Column, t: Column) -> Column:
        def sample(by: Column, bx: Column, dy: int, dx: int) -> Column:
            v = at(u, (by * scale + dy) * wide + bx * scale + dx)
            return byte(v + bayer_threshold(by * scale + dy, bx * scale + dx, amplitude)) if dither else v

        blocks = grid(w, h, lambda by, bx: exact_block(F.array(*(sample(by, bx, dy, dx) for dy in range(scale) for dx in range(scale))), float(scale * scale) * at(t, by * w + bx)))
        return let(blocks, lambda b: grid(wide, h * scale, lambda oy, ox: at(at(b, div(oy, scale) * w + div(ox, scale)), (oy % scale) * scale + ox % scale)))

    return let(x, lambda u: let(y, lambda t: planes(u, t)))
