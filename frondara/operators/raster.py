"""Rasters as tables of cells (col, row, value): sampling points, cells of regions, cells in a band."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frondara.operators.spherical import reach_join
from frondara.session import broadcast_if_small

#: Values below this are no data.
LEAST_VALUE = -500


@dataclass(frozen=True)
class Grid:
    """The place of a raster: its western and northern edge, the size of a cell in degrees, and how many there are."""

    west: float
    north: float
    step: float
    cols: int
    rows: int

    def col(self, lon: Column) -> Column:
        return F.floor((lon - self.west) / self.step)

    def row(self, lat: Column) -> Column:
        return F.floor((self.north - lat) / self.step)

    def lon(self, col: Column) -> Column:
        return self.west + (col + 0.5) * self.step

    def lat(self, row: Column) -> Column:
        return self.north - (row + 0.5) * self.step

    def cells(self, spark) -> DataFrame:
        """(col, row, lon, lat): every cell with its centre."""
        ids = spark.range(self.cols * self.rows).select((F.col("id") % self.cols).alias("col"), F.floor(F.col("id") / self.cols).alias("row"))
        return ids.select("col", "row", self.lon(F.col("col")).alias("lon"), self.lat(F.col("row")).alias("lat"))


def usable_value(value: Column) -> Column:
    """The value, null where there is no data."""
    return F.when(~F.isnan(value) & (value >= LEAST_VALUE), value)


def sampled(points: DataFrame, raster: DataFrame, grid: Grid, name: str = "altitud", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with the value of the cell each lies in; null off the raster and where it has no data.

    A raster of counted size goes to the tasks; a larger one is joined by cell.
    """
    r = raster.select(F.col("col").cast("long").alias("_col"), F.col("row").cast("long").alias("_row"), usable_value(F.col("value")).alias(name))
    x = points.withColumns({"_col": grid.col(F.col(lon)), "_row": grid.row(F.col(lat))})
    return x.join(broadcast_if_small(r), ["_col", "_row"], "left").drop("_col", "_row")


def cells_of_regions(places: DataFrame, raster: DataFrame, grid: Grid) -> DataFrame:
    """(place_id, col, row, lon, lat, value): the cells whose centre lies within each place; see reach_join for places."""
    cells = sampled(grid.cells(raster.sparkSession), raster, grid, "value").withColumns({"_cx": F.col("lon"), "_cy": F.col("lat")})
    return reach_join(cells, places, ["col", "row", "_cx", "_cy", "value"]).select("place_id", "col", "row", F.col("_cx").alias("lon"), F.col("_cy").alias("lat"), "value")


def half_of(lon: Column, lat: Column, side: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """Whether a position lies in the named half (N, S, E, O, W) of its region's box; any other side keeps all."""
    x_mid, y_mid = (x_min + x_max) / 2, (y_min + y_max) / 2
    return F.when(side == "N", lat >= y_mid).when(side == "S", lat <= y_mid).when(side == "E", lon >= x_mid).when(side.isin("O", "W"), lon <= x_mid).otherwise(True)
