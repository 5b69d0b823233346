"""Areas as cells of a grid: inner cells need no side, border cells only the sides that pass through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A power of two, so that cells and their edges are exact numbers.
STEP = 2.0**-7
#: Runs of inner cells are cut at multiples of it, for points to meet them by equality.
RUN = 64
_NEAR = 1e-9
SIDE = ("x1", "y1", "x2", "y2")


def crossing(lat: Column) -> Column:
    """Where a side meets the latitude, kept between its ends; for a level side one of them."""
    x1, y1, x2, y2 = (F.col(c) for c in SIDE)
    x = F.try_divide((x2 - x1) * (lat - y1), y2 - y1) + x1
    return F.greatest(F.least(x, F.greatest(x1, x2)), F.least(x1, x2))


def crosses(lat: Column) -> Column:
    return (F.col("y1") > lat) != (F.col("y2") > lat)


def border(edges: DataFrame, names: list[str], step: float = STEP) -> DataFrame:
    """names, _row, _col and the side: each side once for every cell that it passes through or all but touches."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
    sides = edges.dropna(subset=list(SIDE)).select(*names, *SIDE)
    rows = sides.withColumn("_row", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))))
    # The part within the row; its ends reach out a little, so that rounding can't lose a cell.
    at_low = crossing(F.greatest(low, F.col("_row") * step - _NEAR))
    at_high = crossing(F.least(high, (F.col("_row") + 1) * step + _NEAR))
    level = F.col("y1") == F.col("y2")
    ends = rows.withColumns({
        "_a": F.when(level, west).otherwise(F.least(at_low, at_high)) - _NEAR,
        "_b": F.when(level, east).otherwise(F.greatest(at_low, at_high)) + _NEAR,
    })
    return ends.withColumn("_col", F.explode(F.sequence(F.floor(F.col("_a") / step), F.floor(F.col("_b") / step)))).drop("_a", "_b")


def parities(sides: DataFrame, names: list[str], step: float = STEP) -> DataFrame:
    """names, _row, _col, _odd, _next: whether the lower right corner of each border cell is inside, and the area's next
    border cell to the right in the row.  All cells between the two are as that corner is."""
    foot = F.col("_row") * step
    here = crosses(foot) & (F.ceil(crossing(foot) / step) - 1 == F.col("_col"))
    counted = sides.groupBy(*names, "_row", "_col").agg(F.count_if(here).alias("_n"))
    east = Window.partitionBy(*names, "_row").orderBy(F.desc("_col"))
    beyond = F.coalesce(F.sum("_n").over(east.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select(*names, "_row", "_col", (beyond % 2 == 1).alias("_odd"), F.lag("_col").over(east).alias("_next"))


def runs(corners: DataFrame, names: list[str]) -> DataFrame:
    """names, _row, _block, _from, _to: inner cells in runs, cut at multiples of ``RUN``."""
    inner = corners.where("_odd AND _next > _col + 1").select(*names, "_row", (F.col("_col") + 1).alias("_from"), (F.col("_next") - 1).alias("_to"))
    return inner.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / RUN), F.floor(F.col("_to") / RUN))))


def _above(lat: Column, right: Column) -> Column:
    """For a side with one end beyond the line ``right``: whether the latitude is above where the two meet."""
    top_beyond = F.when(F.col("y1") > F.col("y2"), F.col("x1") > right).otherwise(F.col("x2") > right)
    within = top_beyond == (crossing(lat) > right)
    return F.when(crosses(lat), within).otherwise(F.greatest("y1", "y2") <= lat)


def inside_cells(spots: DataFrame, edges: DataFrame, names: list[str], step: float = STEP) -> DataFrame:
    """lng, lat and names of the areas that hold each spot, by the even-odd rule, for any number of spots and sides.

    The sides of an area must form closed rings.  A spot of an inner cell is answered by a run of cells; a spot of a
    border cell begins with its cell's lower right corner, goes up the cell's right edge to its own latitude and left to
    its place, and turns over at each side on the way: all of these pass through the cell.
    """
    sides = border(edges, names, step)
    corners = parities(sides, names, step)
    at = spots.withColumns({"_row": F.floor(F.col("lat") / step), "_col": F.floor(F.col("lng") / step)})
    whole = (
        at.withColumn("_block", F.floor(F.col("_col") / RUN)).join(runs(corners, names), ["_row", "_block"])
        .where(F.col("_col").between(F.col("_from"), F.col("_to"))).select("lng", "lat", *names)
    )
    right, foot = (F.col("_col") + 1) * step, F.col("_row") * step
    mixed = (F.col("x1") > right) != (F.col("x2") > right)
    up = mixed & (_above(F.col("lat"), right) != _above(foot, right))
    x = crossing(F.col("lat"))
    left = crosses(F.col("lat")) & (F.col("lng") < x) & (x <= right)
    turns = F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(left, F.lit(False)).cast("int")
    met = at.join(sides, ["_row", "_col"]).groupBy(*names, "_row", "_col", "lng", "lat").agg(F.sum(turns).alias("_turns"))
    edge = met.join(corners.drop("_next"), [*names, "_row", "_col"]).where((F.col("_turns") + F.col("_odd").cast("int")) % 2 == 1)
    return whole.unionByName(edge.select("lng", "lat", *names))
