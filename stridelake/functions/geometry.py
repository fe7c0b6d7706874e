"""Grid geometry as column expressions: positions, cells, boundaries, wall sensing and map text.

Maps are centred at the origin, row 0 at the top.  Floats are widened before they
are compared, because cell borders are sensitive to rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbour statuses and directions in their order.
FREE, WALL, RISK = 0, 1, 2
DIRECTIONS = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}
VERSIONS = ("v1", "v2", "v3", "v4", "v5")


def to_cell(x: Column, y: Column, rows: Column | int, cols: Column | int, scale: float = 1.0) -> tuple[Column, Column]:
    """Row and column of a position, kept inside the map."""
    rows, cols = (F.lit(v) if isinstance(v, int) else v for v in (rows, cols))
    x, y = x.cast("double"), y.cast("double")
    row = F.floor((rows / 2 * scale - y) / scale)
    col = F.floor((x + cols / 2 * scale) / scale)
    keep = lambda v, n: F.greatest(F.lit(0).cast("long"), F.least(v, n.cast("long") - 1))
    return keep(row, rows), keep(col, cols)


def cell_center(row: Column, col: Column, rows: Column | int, cols: Column | int, scale: float = 1.0) -> tuple[Column, Column]:
    rows, cols = (F.lit(v) if isinstance(v, int) else v for v in (rows, cols))
    return (col + 0.5) * scale - cols / 2 * scale, rows / 2 * scale - (row + 0.5) * scale


def cell_bounds(row: Column, col: Column, rows: Column | int, cols: Column | int, scale: float = 1.0) -> dict[str, Column]:
    cx, cy = cell_center(row, col, rows, cols, scale)
    return {"left": cx - scale / 2, "right": cx + scale / 2, "bottom": cy - scale / 2, "top": cy + scale / 2}


def near_mask(x: Column, y: Column, bounds: dict[str, Column], threshold: float, scale: float = 1.0) -> Column:
    """Bits 1 left, 2 right, 4 bottom, 8 top for each side no farther than the threshold."""
    t = threshold * scale
    bit = lambda c, v: F.when(c <= t, v).otherwise(0)
    return bit(x - bounds["left"], 1) + bit(bounds["right"] - x, 2) + bit(y - bounds["bottom"], 4) + bit(bounds["top"] - y, 8)


def snap(positions: DataFrame, cells: DataFrame, rows: int, cols: int, scale: float = 1.0) -> DataFrame:
    """Positions with their cell; one inside a wall gets the nearest free cell, ties to the first in row order.

    ``cells`` (row, col, is_free) of one map is small and broadcast; only wall hits meet its free cells.
    """
    r, c = to_cell(F.col("x"), F.col("y"), rows, cols, scale)
    p = positions.withColumn("row", r).withColumn("col", c)
    p = p.join(F.broadcast(cells.select("row", "col", "is_free")), ["row", "col"], "left")
    cx, cy = cell_center(F.col("fr"), F.col("fc"), rows, cols, scale)
    free = cells.filter("is_free").agg(F.array_sort(F.collect_list(F.struct(F.col("row").alias("fr"), F.col("col").alias("fc")))).alias("free"))
    d = lambda s: (F.col("x") - ((s["fc"] + 0.5) * scale - cols / 2 * scale)) ** 2 + (F.col("y") - (rows / 2 * scale - (s["fr"] + 0.5) * scale)) ** 2
    p = p.crossJoin(F.broadcast(free))  # one row: the list of a map's free cells
    near = F.array_min(F.transform("free", lambda s: F.struct(d(s).alias("d"), s["fr"].alias("fr"), s["fc"].alias("fc"))))
    best = F.when(~F.col("is_free"), near)
    return p.withColumn("_b", best).withColumn("row", F.coalesce("_b.fr", "row")).withColumn("col", F.coalesce("_b.fc", "col")).drop("_b", "free", "is_free")


def status_table(cells: DataFrame, version: str) -> DataFrame:
    """Neighbour status for every cell, mask of near sides, and direction: (map_id, row, col, mask, direction, status).

    Built once for each map and looked up.  A neighbour outside the map is a wall.
    v1 looks at the neighbour alone; v2 also sees a wall diagonally ahead on a near side;
    v3 to v5 see it only where that side is open, v5 as a risk, and v4 overlooks a wall while the
    opposite side is near.
    """
    if version not in VERSIONS:
        raise ValueError(f"unknown version: {version}")
    spark = cells.sparkSession
    dirs = [(n, dr, dc, i) for i, (n, (dr, dc)) in enumerate(DIRECTIONS.items())]
    d = spark.createDataFrame(dirs, "direction string, dr long, dc long, ord int")
    masks = spark.range(16).select(F.col("id").cast("int").alias("mask"))
    wall = cells.filter("not is_free").select("map_id", F.col("row").alias("r"), F.col("col").alias("c"))
    size = cells.groupBy("map_id").agg(F.max("row").alias("maxr"), F.max("col").alias("maxc"))
    walls = F.collect_set(F.struct("r", "c")).alias("walls")
    size = size.join(wall.groupBy("map_id").agg(walls), "map_id", "left")
    k = cells.select("map_id", "row", "col").join(size, "map_id").crossJoin(F.broadcast(d))

    def is_wall(r: Column, c: Column) -> Column:
        out = (r < 0) | (c < 0) | (r > F.col("maxr")) | (c > F.col("maxc"))
        return out | F.coalesce(F.array_contains("walls", F.struct(r.alias("r"), c.alias("c"))), F.lit(False))

    across = F.col("dc") != 0  # moving sideways, the sides are above and below
    s1r, s1c = F.when(across, -1).otherwise(0), F.when(across, 0).otherwise(-1)
    k = k.withColumn("direct", is_wall(F.col("row") + F.col("dr"), F.col("col") + F.col("dc")))
    for n, sign in ((1, 1), (2, -1)):
        sr, sc = s1r * sign, s1c * sign
        k = k.withColumn(f"side{n}", is_wall(F.col("row") + sr, F.col("col") + sc))
        k = k.withColumn(f"diag{n}", is_wall(F.col("row") + F.col("dr") + sr, F.col("col") + F.col("dc") + sc))
    k = k.drop("walls").crossJoin(F.broadcast(masks))
    bit = lambda v: F.col("mask").bitwiseAND(v) > 0
    near1, near2 = F.when(across, bit(8)).otherwise(bit(1)), F.when(across, bit(4)).otherwise(bit(2))
    opposite = F.when(F.col("dr") < 0, bit(4)).when(F.col("dr") > 0, bit(8)).when(F.col("dc") < 0, bit(2)).otherwise(bit(1))
    corner = (near1 & ~F.col("side1") & F.col("diag1")) | (near2 & ~F.col("side2") & F.col("diag2"))
    status = {
        "v1": F.when(F.col("direct"), WALL).otherwise(FREE),
        "v2": F.when(F.col("direct") | (near1 & F.col("diag1")) | (near2 & F.col("diag2")), WALL).otherwise(FREE),
        "v3": F.when(F.col("direct") | corner, WALL).otherwise(FREE),
        "v4": F.when(F.col("direct"), F.when(opposite, FREE).otherwise(WALL)).when(corner, WALL).otherwise(FREE),
        "v5": F.when(F.col("direct"), WALL).when(corner, RISK).otherwise(FREE),
    }[version]
    return k.select("map_id", "row", "col", "mask", "direction", "ord", status.alias("status"))


def status_text(status: Column, zh: bool = False) -> Column:
    words = ("可走", "墙", "风险") if zh else ("free", "wall", "risk")
    return F.element_at(F.array(*map(F.lit, words)), status + 1)


def sensing_text(row: Column, col: Column, goal_row: Column, goal_col: Column, statuses: Column, zh: bool = False) -> Column:
    """One line: cell and goal counted from 1, then the four neighbours (array in the order of directions)."""
    names = ("上", "下", "左", "右") if zh else tuple(DIRECTIONS)
    parts = F.array_join(F.array(*(F.concat(F.lit(f"{n}="), status_text(statuses[i], zh)) for i, n in enumerate(names))), ", ")
    head = "位于({},{}) 目标({},{}) " if zh else "at ({},{}) goal ({},{}) "
    a, b, c, d, e = head.split("{}")
    one = lambda v: (v + 1).cast("string")
    return F.concat(F.lit(a), one(row), F.lit(b), one(col), F.lit(c), one(goal_row), F.lit(d), one(goal_col), F.lit(e), parts)


def dynamic_map(grid: Column, row: Column, col: Column, goal_row: Column, goal_col: Column) -> Column:
    """The map with 2 at the position, 3 at the goal and 4 where both are."""

    def put(v: Column, r: Column, c: Column) -> Column:
        here, goal = (r == row) & (c == col), (r == goal_row) & (c == goal_col)
        return F.when(here & goal, 4).when(here, 2).when(goal, 3).otherwise(v)

    return F.transform(grid, lambda line, r: F.transform(line, lambda v, c: put(v, r, c)))


def map_text(grid: Column, sep: str = "") -> Column:
    return F.array_join(F.transform(grid, lambda line: F.array_join(F.transform(line, lambda v: v.cast("string")), sep)), "\n")


def map_features(grid: Column, rows: int, cols: int) -> Column:
    """The map padded with -1 to a family's shape and flattened by rows."""
    fill = F.array_repeat(F.lit(-1), cols)
    wide = F.transform(grid, lambda line: F.slice(F.concat(line, fill), 1, cols))
    return F.flatten(F.slice(F.concat(wide, F.array_repeat(fill, rows)), 1, rows))


def parse_map(text: Column) -> Column:
    """Lines of characters to an array of rows; '#' and '1' are walls, all else is free."""
    lines = F.filter(F.split(F.trim(text), F.lit("\n")), lambda s: s != "")
    chars = lambda s: F.filter(F.split(s, F.lit("")), lambda c: c != "")
    return F.transform(lines, lambda s: F.transform(chars(s), lambda c: F.when(c.isin("#", "1"), 1).otherwise(0)))


def find_marker(text: Column, marker: str) -> Column:
    """(row, col) of the first marker in a map's text, or null."""
    lines = F.filter(F.split(F.trim(text), F.lit("\n")), lambda s: s != "")
    at = F.transform(lines, lambda s, r: F.struct(r.alias("row"), (F.locate(marker, s) - 1).alias("col")))
    return F.get(F.filter(at, lambda p: p["col"] >= 0), F.lit(0))


def boundary_ok(grid: Column) -> Column:
    """Rectangular, and walled all around."""
    n, first = F.size(grid), F.element_at(grid, 1)
    same = F.forall(grid, lambda line: F.size(line) == F.size(first))
    solid = lambda line: F.forall(line, lambda v: v == 1)
    ends = F.forall(grid, lambda line: (F.element_at(line, 1) == 1) & (F.element_at(line, -1) == 1))
    return (n >= 3) & same & solid(first) & solid(F.element_at(grid, -1)) & ends


#: Versions of wall sensing, the default one, and the default threshold of a boundary's risk.
SENSING_VERSIONS = ("v1", "v2", "v3", "v4", "v5")
DEFAULT_SENSING = "v3"
DEFAULT_RISK = 0.10


def sensing_version(value: Column) -> Column:
    """The version in lower case without blanks around it; null is the default, another value an error."""
    v = F.lower(F.trim(value))
    wrong = F.raise_error(F.concat(F.lit("not a version of wall sensing: "), value)).cast("string")
    return F.when(value.isNull(), F.lit(DEFAULT_SENSING)).when(v.isin(*SENSING_VERSIONS), v).otherwise(wrong)


def risk_threshold(value: Column) -> Column:
    """A finite threshold of at least 0; null is the default, another value an error."""
    t = value.cast("double")
    fine = (t >= 0) & ~F.isnan(t) & (t < float("inf"))
    return F.when(value.isNull(), F.lit(DEFAULT_RISK)).when(fine, t).otherwise(F.raise_error(F.lit("a threshold is finite and at least 0")).cast("double"))
