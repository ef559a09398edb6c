"""A space-filling curve over the globe: a number for each box, and the numbers that boxes near a shape can have.

Latitude and longitude are cut into ``2 ** DEPTH`` steps. A box belongs to the finest level on which it spans at most two squares each way, and to the
square of its lower corner there; so a small box that lies across a coarse border stays on a fine level, and every box of a square lies within that
square and its upper neighbours. ``place`` is the level, then the Morton number of the square. A table that is sorted by place keeps
near boxes together, and a query needs few ranges of it: per level those squares whose reach the shape touches. Whole numbers are compared
throughout, and steps keep the order of coordinates, so no box is missed. Coordinates beyond the globe count as its edge.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions.geo import Rect, Shape, box_columns

DEPTH, LEVELS = 20, tuple(range(0, 21, 2))
#: Ranges of a level, about; where a shape needs more, squares beside it are taken along.
RANGES = 12
NAME = "place"
BEYOND = 1e6


def _step(value: float, low: float, width: float) -> int:
    return min((1 << DEPTH) - 1, max(0, floor((value - low) / width * (1 << DEPTH))))


def _step_of(value: str, low: float, width: float) -> str:
    return f"IF({value} IS NULL, NULL, CAST(LEAST({(1 << DEPTH) - 1}, GREATEST(0, FLOOR(({value} - ({low!r}D)) / {width!r}D * {1 << DEPTH}))) AS BIGINT))"


def with_place(table: DataFrame, box: tuple[str, str, str, str] = box_columns(), name: str = NAME) -> DataFrame:
    """table with the place of the box in these columns: lowest and highest latitude, lowest and highest longitude. Null where one of them is."""
    steps = {"_y": (box[0], -90.0, 180.0), "_yy": (box[1], -90.0, 180.0), "_x": (box[2], -180.0, 360.0), "_xx": (box[3], -180.0, 360.0)}
    cut = table.select("*", *(F.expr(_step_of(*s)).alias(c) for c, s in steps.items()))
    level = "CASE " + " ".join(f"WHEN (_yy >> {DEPTH - k}) - (_y >> {DEPTH - k}) <= 1 AND (_xx >> {DEPTH - k}) - (_x >> {DEPTH - k}) <= 1 THEN {k}" for k in reversed(LEVELS)) + " END"
    level = cut.withColumn("_level", F.expr(level))
    spread = lambda c: f"CAST(CONV(BIN(SHIFTRIGHT({c}, {DEPTH} - _level)), 4, 10) AS BIGINT)"  # noqa: E731  a bit at every other place
    return level.select(*table.columns, F.expr(f"CAST(_level AS BIGINT) * {1 << 2 * DEPTH} + 2 * {spread('_y')} + {spread('_x')}").alias(name))


def _reach(level: int, bottom: int, top: int, left: int, right: int) -> Rect:
    """What boxes of these squares of a level can touch: one more square above and to the right, all beyond at the edges of the globe, and a little more than rounding."""
    last, high, wide, slack = (1 << level) - 1, 180.0 / (1 << level), 360.0 / (1 << level), 1e-9
    return Rect(
        -BEYOND if bottom == 0 else bottom * high - 90 - slack,
        BEYOND if top >= last - 1 else (top + 2) * high - 90 + slack,
        -BEYOND if left == 0 else left * wide - 180 - slack,
        BEYOND if right >= last - 1 else (right + 2) * wide - 180 + slack,
    )


def _ranges(shape: Shape, level: int) -> list[tuple[int, int]]:
    """Morton numbers of the squares of a level whose boxes can touch the shape, as ranges with both ends."""
    box, shift = shape.box, DEPTH - level
    bottom, top = (_step(v, -90.0, 180.0) >> shift for v in (box.min_lat, box.max_lat))
    left, right = (_step(v, -180.0, 360.0) >> shift for v in (box.min_lon, box.max_lon))
    bottom, left = max(0, bottom - 1), max(0, left - 1)
    done: list[tuple[int, int, int]] = []  # depth, and the square there
    open_ = [(0, 0)]
    for depth in range(level + 1):
        down = level - depth
        partly = []
        for y, x in open_:
            low_y, high_y, low_x, high_x = y << down, ((y + 1) << down) - 1, x << down, ((x + 1) << down) - 1
            if high_y < bottom or low_y > top or high_x < left or low_x > right:
                continue
            if not shape.touches(_reach(level, low_y, high_y, low_x, high_x)):
                continue
            partly.append((y, x))
        if depth == level or len(partly) + len(done) > RANGES:
            done += [(depth, y, x) for y, x in partly]
            break
        open_ = []
        for y, x in partly:
            inside = (y << down) >= bottom and ((y + 1) << down) - 1 <= top and (x << down) >= left and ((x + 1) << down) - 1 <= right
            if inside and isinstance(shape, Rect):
                done.append((depth, y, x))
            else:
                open_ += [(2 * y + b, 2 * x + a) for b in (0, 1) for a in (0, 1)]
    spread = lambda v: int(bin(v)[2:], 4)
    found = sorted((m << 2 * (level - d), ((m + 1) << 2 * (level - d)) - 1) for d, y, x in done for m in [2 * spread(y) + spread(x)])
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cover(shape: Shape, levels: tuple[int, ...] = LEVELS) -> list[tuple[int, int]]:
    """Ranges of place, with both ends, in which all boxes that touch the shape lie."""
    return [((level << 2 * DEPTH) + a, (level << 2 * DEPTH) + b) for level in levels for a, b in _ranges(shape, level)]


def near(table: DataFrame, shape: Shape, name: str = NAME) -> DataFrame:
    """Rows of a stored table that can touch the shape, by ranges that reach the scan; all of a table without places."""
    if name not in table.columns:
        return table
    tests = [f"{name} = {a}" if a == b else f"{name} BETWEEN {a} AND {b}" for a, b in cover(shape)]
    return table.filter(F.expr(" OR ".join(tests) or "false"))


def laid_out(table: DataFrame, name: str = NAME) -> DataFrame:
    """table in the order of place: each file a range of it."""
    return table.repartitionByRange(name).sortWithinPartitions(name)
