"""Sources and sinks: cells, points, attribute tables, tiles, result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BAND_ROWS = 50
BAND_COLS = 64
#: The portable generator behind every pseudo-random choice: same integers in any SQL engine.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648


def lcg(x: Column) -> Column:
    return F.pmod(x.cast("long") * F.lit(LCG_A) + F.lit(LCG_C), F.lit(LCG_M).cast("long"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def band_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of gradient bands: tid, r, c, v, veg_class, elev, veg1, veg2, excl; a null mask is an absent cell.

    veg1 fades out with the column and veg2 fades in, so that each band has a boundary zone.
    """
    emb = read(spark, sf_dir, "embeddings")
    cells = emb.select(
        F.floor(F.col("vec_id") / BAND_ROWS).cast("int").alias("tid"), (F.col("vec_id") % BAND_ROWS + 1).cast("int").alias("r"),
        F.col("label").alias("veg_class"), F.posexplode("embedding").alias("c0", "v0"),
    )
    c, v = F.col("c"), F.col("v")
    return cells.select(
        "tid", "r", (F.col("c0") + 1).cast("int").alias("c"), F.col("v0").cast("double").alias("v"), "veg_class"
    ).select(
        "*", (1500.0 + 12.0 * c + 40.0 * v).alias("elev"),
        F.when((v > (c - 32.5) / 80.0) & (F.abs(v) < (c - 3.0) / 60.0), 1).alias("veg1"),
        F.when((v < (c - 32.5) / 80.0 - 0.02) & (F.abs(v) < (63.0 - c) / 60.0), 1).alias("veg2"),
        F.when(v > 0.3, 1).alias("excl"),
    )


def path_points(spark: SparkSession, sf_dir: str, res_m: float = 30.0) -> DataFrame:
    """Ordered 1-D paths: tid, seq, dist_m, elev, veg_class."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = F.row_number().over(w)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("tid"), seq.alias("seq"), (seq * res_m).alias("dist_m"), F.col("value").alias("elev"), F.col("event_type").alias("veg_class"))


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many points per cell: c, r, value, flag, class (null: none), tile."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 64).cast("int").alias("c"), F.col("l_suppkey").cast("int").alias("r"), F.col("l_quantity").cast("double").alias("value"),
        F.col("l_returnflag").alias("flag"), F.nullif(F.col("l_linenumber").cast("int"), F.lit(7)).alias("class"), F.col("l_linestatus").alias("tile"),
    )


def attribute_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and their fields: value, level3, macro, frm."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("value"), F.col("p_size").alias("level3"), F.col("p_brand").alias("macro"), F.col("p_type").alias("frm"))


def mosaic(tiles: DataFrame, keys=("r", "c"), tile: str = "tile", value: str = "value") -> DataFrame:
    """One grid of many tiles: points of a tile give its cell value, overlapping tiles are averaged."""
    of_tile = tiles.groupBy(*keys, tile).agg(F.avg(value).alias(value))
    return of_tile.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n_tiles"))


def like_first(tiles: DataFrame, tile: str = "tile", fields=("crs", "res_m")) -> DataFrame:
    """Points of the tiles that have the geometry of the first tile, the one of the smallest name; nulls are equal.

    A tile whose points state more than one geometry goes by the smallest.
    """
    of_tile = tiles.groupBy(tile).agg(F.min(F.struct(*fields)).alias("geometry"))
    first = of_tile.where(F.col(tile).isNotNull()).agg(F.min(F.struct(tile, "geometry"))["geometry"].alias("first"))
    good = of_tile.join(F.broadcast(first), F.col("geometry").eqNullSafe(F.col("first"))).select(tile)
    return tiles.join(good, tile, "left_semi")


def same_geometry(grids: DataFrame, fields=("crs", "res_m", "longlat", "rotation")) -> DataFrame:
    """Do all layers share one geometry? One row, valid; layers without cells don't count."""
    return grids.where("ncell > 1").agg((F.countDistinct(F.struct(*fields)) <= 1).alias("valid"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append scalar result rows as CSV with a header; nested columns are refused."""
    nested = [f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")]
    if nested:
        raise ValueError(f"columns are not scalar: {nested}")
    rows.write.mode("append").option("header", True).csv(path)


def max_timing(timings: DataFrame, column: str = "time_h", add_hours: float = 2.0) -> DataFrame:
    """The longest time so far and a margin; the margin alone where there is none."""
    return timings.agg((F.coalesce(F.max(column), F.lit(0.0)) + add_hours).alias("max_time_h"))


def reproject_bilinear(cells: DataFrame, targets: DataFrame, keys=("tid",), value: str = "v") -> DataFrame:
    """Values at fractional places (y, x) of targets from the four cells around each: weighted by overlap, null cells left out."""
    y0, x0 = F.floor("y"), F.floor("x")
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    near = targets.withColumn("corner", corner).withColumns({"r": (y0 + F.col("corner.i")).cast("int"), "c": (x0 + F.col("corner.j")).cast("int")})
    weight = (1 - F.abs(F.col("y") - F.col("r"))) * (1 - F.abs(F.col("x") - F.col("c")))
    joined = near.join(cells.select(*keys, "r", "c", value), [*keys, "r", "c"]).withColumn("w", weight).where(F.col("w") > 0).where(F.col(value).isNotNull())
    return joined.groupBy(*keys, "y", "x").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
