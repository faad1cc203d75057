"""Spatial filters and joins without cross joins.

``radius_join`` turns "within R km" into an equi join on grid tiles. ``nearest`` and ``radius_parts`` walk down a packed
tree of the targets (see ``tree``) and drop every node that cannot matter, so a site is compared with few points however
many there are. All are exact at cell borders, poles and the date line.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glebe.functions import geo
from glebe.functions.numbers import rounded
from glebe.operators.tree import Sphere, Tree, build, far, in_range, near, staged_places, with_axes
from glebe.session import scratch_path

# More points than this in one cell are spread over several join keys.
HOT_CELL_ROWS = 200_000
# A tile with fewer pairs to compare than this is never split on both sides.
CELL_PAIRS = 2_000_000
# Rows of a side that a tile may hold, and its width in radii at most.
TILE_ROWS = 400_000
TILE_RADII = 4
# Targets that a site is compared with in one go.
BLOCK_ROWS = 1024


def within_box(df: DataFrame, lat: float, lon: float, radius_km: float,
               lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Rows inside the box around one point. Plain column bounds, so they reach the file scan."""
    lon_min, lat_min, lon_max, lat_max = geo.bounding_box_of(lat, lon, radius_km)
    return df.filter(F.col(lat_col).between(lat_min, lat_max) & F.col(lon_col).between(lon_min, lon_max))


def with_distance(df: DataFrame, lat: float, lon: float, lat_col: str = "latitude",
                  lon_col: str = "longitude", decimals: int | None = None) -> DataFrame:
    """Add ``distance_km`` from one point; null where a coordinate is missing (0.0 is a coordinate)."""
    km = geo.haversine_km(F.lit(float(lat)), F.lit(float(lon)), F.col(lat_col), F.col(lon_col))
    return df.withColumn("distance_km", km if decimals is None else rounded(km, decimals))


def within_radius(df: DataFrame, lat: float, lon: float, radius_km: float,
                  lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Rows within a distance of one point; rows without coordinates are dropped.

    A latitude bound from the sphere itself narrows the scan first; it never cuts a matching row.
    """
    reach = math.degrees(radius_km / geo.EARTH_KM) * (1 + 1e-6)
    near = df.filter(F.col(lat_col).between(lat - reach, lat + reach) & F.col(lon_col).isNotNull())
    return with_distance(near, lat, lon, lat_col, lon_col).filter(F.col("distance_km") <= radius_km)


# ---- radius join ------------------------------------------------------------------------------------


class _LatLonGrid:
    """Latitude bands of equal height, each cut into equal longitude cells about as wide: one radius, or ``scale`` radii."""

    def __init__(self, radius_km: float, scale: float = 1):
        if radius_km <= 0:
            raise ValueError("the radius must be positive")
        self.angle = min(radius_km / geo.EARTH_KM, math.pi)
        self.reach = math.degrees(self.angle) * (1 + 1e-6)
        self.step = self.reach * scale

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.step)

    def cells_in_band(self, band: Column) -> Column:
        low = band * F.lit(self.step) - 90.0
        widest = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(low + self.step)))
        return F.greatest(F.lit(1), F.floor(F.cos(F.radians(widest)) * 360.0 / self.step)).cast("bigint")

    def own_cell(self, points: DataFrame, lat: Column, lon: Column) -> DataFrame:
        """Points with their ``_band`` and ``_cell``."""
        banded = points.withColumn("_band", self.band(lat)).withColumn("_n", self.cells_in_band(F.col("_band")))
        return banded.withColumn("_cell", F.least(F.col("_n") - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * F.col("_n") / 360.0))).drop("_n")

    def cells_around(self, points: DataFrame, lat: Column, lon: Column) -> DataFrame:
        """A row of each point for each cell that a circle around it can touch."""
        reach = self.reach * (1 + 1e-9)
        banded = points.withColumn("_band", F.explode(F.sequence(self.band(lat - reach), self.band(lat + reach)))).withColumn(
            "_n", self.cells_in_band(F.col("_band")))
        n = F.col("_n")
        tip = F.sin(F.lit(min(self.angle, math.pi / 2))) / F.cos(F.radians(lat))
        reaches_pole = F.abs(lat) + math.degrees(self.angle) >= 90.0 - 1e-9
        half = F.when(reaches_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), tip))) * (1 + 1e-9) + 1e-9)
        low = F.floor((lon + 180.0 - half) * n / 360.0)
        high = F.floor((lon + 180.0 + half) * n / 360.0)
        listed = banded.withColumn("_cell", F.explode(F.sequence(low, F.least(high, low + n - 1))))
        return listed.withColumn("_cell", F.pmod("_cell", n)).drop("_n")


def radius_join(sites: DataFrame, targets: DataFrame, radius_km: float,
                site_lat: str = "lat", site_lon: str = "lon",
                target_lat: str = "latitude", target_lon: str = "longitude",
                cell_pairs: int = CELL_PAIRS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """All (site, target) pairs within ``radius_km``, with ``distance_km``.

    Inputs must have different column names; all columns are sent, so give those that are wanted. Rows without valid
    coordinates never match. Give distinct places (see ``enrichment``) when many rows share one coordinate.

    What is sent: a target goes to its tile, a site to each tile that its circle touches, and nothing else is written. A
    tile is several radii wide, so that most sites are sent once or twice: as wide as leaves half a tile for a task at
    least, and a quarter of ``tile_rows`` targets in a tile. Tiles with more than ``cell_pairs`` pairs to compare and more
    than twice a task's share, or with more than ``tile_rows`` rows, are split on both sides, so that no task gets them
    all, whichever side is crowded; either side is repeated for the parts of the other. Only those few tiles are listed,
    and broadcast. Two jobs of their own count the rows and the pairs first; nothing but three numbers comes to the driver.

    Within a tile, the targets of a cell (half a radius) are rows of up to ``BLOCK_ROWS`` points each, and such a row meets
    the sites that come near its box. Pairs are told by the product of their points on the unit sphere; only on the rim
    of the circle does the distance itself decide, and only hits have it worked out, once.
    """
    shared = set(sites.columns) & set(targets.columns)
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}")
    tasks = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t_lat, t_lon = F.col(target_lat), F.col(target_lon)
    s_lat, s_lon = F.col(site_lat), F.col(site_lon)
    placed, probes = targets.filter(in_range(t_lat, t_lon)), sites.filter(in_range(s_lat, s_lon))

    taken = _LatLonGrid(radius_km).own_cell(placed, t_lat, t_lon).groupBy("_band", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    n_cells, rows = taken.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    scale = max(1, min(TILE_RADII, int(math.sqrt(min(n_cells * 2 / tasks, n_cells * tile_rows / 4 / max(1, rows))))))
    tiles = _LatLonGrid(radius_km, scale)
    tile = ["_band", "_cell"]
    placed, probes = tiles.own_cell(placed, t_lat, t_lon), tiles.cells_around(probes, s_lat, s_lon)

    counts = placed.select(*tile, F.lit(1).alias("_t"), F.lit(0).alias("_s")).unionByName(
        probes.select(*tile, F.lit(0).alias("_t"), F.lit(1).alias("_s"))).groupBy(*tile).agg(F.sum("_t").alias("_t"), F.sum("_s").alias("_s"))
    pairs = F.col("_t").cast("double") * F.col("_s")
    share = (counts.agg(F.sum(pairs)).first()[0] or 0.0) / tasks
    much = pairs > max(float(cell_pairs), share * 2)
    wanted = pairs / max(float(cell_pairs), share / 4)

    def parts(mine: str, other: str) -> Column:
        # Parts of a side go with the root of its share, which repeats the fewest rows.
        least = F.greatest(F.lit(1), F.ceil(F.col(mine) / tile_rows))
        root = F.ceil(F.sqrt(wanted * F.col(mine) / F.col(other)))
        return F.greatest(least, F.when(much & (F.col(other) > 0), F.least(mine, root))).cast("int")

    crowded = F.broadcast(counts.filter(much | (F.greatest("_t", "_s") > tile_rows)).select(
        *tile, parts("_t", "_s").alias("_tparts"), parts("_s", "_t").alias("_sparts")))
    t_parts, s_parts = (F.coalesce(F.col(c), F.lit(1)) for c in ("_tparts", "_sparts"))

    def every(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), parts - 1))

    def own(columns: list[str], parts: Column) -> Column:
        # From the row alone, so that a task that runs again deals its rows alike.
        return F.pmod(F.xxhash64(*columns), parts).cast("int")

    placed = placed.join(crowded, tile, "left").withColumn("_tpart", own(targets.columns, t_parts)).withColumn("_spart", every(s_parts))
    probes = probes.join(crowded, tile, "left").withColumn("_spart", own(sites.columns, s_parts)).withColumn("_tpart", every(t_parts))
    tile = [*tile, "_tpart", "_spart"]

    def sent(side: DataFrame, columns: list[str], lat: Column, lon: Column) -> DataFrame:
        """Points dealt by their tile, then with their axes and the cosine of their latitude."""
        dealt = side.select(*columns, *(F.col(c).alias(f"_tile{c}") for c in tile)).repartition(tasks, *(f"_tile{c}" for c in tile))
        return with_axes(dealt, Sphere, lat, lon).withColumn("_cos", F.cos(F.radians(lat)))

    axes = Sphere.axes
    blocks = _LatLonGrid(radius_km, 0.5).own_cell(sent(placed, targets.columns, t_lat, t_lon), t_lat, t_lon).groupBy(
        *(f"_tile{c}" for c in tile), "_band", "_cell").agg(
            F.collect_list(F.struct(*targets.columns, *axes, "_cos")).alias("_all"),
            *(f(a).alias(f"_{end}{a}") for a in axes for end, f in (("lo", F.min), ("hi", F.max))))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(BLOCK_ROWS))
    blocks = blocks.withColumn("_block", F.explode(F.transform(starts, lambda i: F.slice("_all", i, BLOCK_ROWS)))).drop("_all", "_band", "_cell")

    inside, reach = _chords(radius_km)
    apart = F.expr(" + ".join(f"pow(greatest(_lo{a} - {a}, {a} - _hi{a}, 0D), 2D)" for a in axes))
    # Row by row of targets, so that neighbouring pairs share targets and a stored result is small.
    met = blocks.join(sent(probes, sites.columns, s_lat, s_lon).hint("merge"), [f"_tile{c}" for c in tile]).filter(apart <= reach)
    met = met.select(*sites.columns, *axes, "_cos", F.explode("_block").alias("_target"))
    target = F.col("_target").getField
    product = sum((F.col(a) * target(a) for a in axes[1:]), F.col(axes[0]) * target(axes[0]))
    haversine = geo.haversine(s_lat, s_lon, target(target_lat), target(target_lon), F.col("_cos"), target("_cos"))
    # The product is one minus half the squared chord, and known to less than 1e-14.
    return (
        met.filter((product >= 1 - reach / 2 - 1e-14) & ((product >= 1 - inside / 2 + 1e-14) | (geo.km_of_haversine(haversine) <= radius_km)))
        .select(*sites.columns, *(target(c).alias(c) for c in targets.columns), haversine.alias("_haversine"))
        .select(*sites.columns, *targets.columns, geo.km_of_haversine(F.col("_haversine")).alias("distance_km")))


def _chords(radius_km: float) -> tuple[float, float]:
    """Squared chords of the unit sphere: up to the first a point is within the radius, beyond the second it is not.
    Between the two, rounding could tip the scale."""
    chord = (2 * math.sin(min(radius_km / geo.EARTH_KM, math.pi) / 2)) ** 2
    return chord * (1 - 1e-9) - 1e-15, chord * (1 + 1e-9) + 1e-15


# ---- k nearest --------------------------------------------------------------------------------------



def nearest(sites: DataFrame, targets: DataFrame, k: int = 1, metric: str = "haversine",
            site_lat: str = "lat", site_lon: str = "lon",
            target_lat: str = "latitude", target_lon: str = "longitude", tie_break: list[str] | None = None) -> DataFrame:
    """The k nearest targets of every site: site columns, target columns, ``distance``, ``rank``.

    ``distance`` is km for "haversine" and squared degrees for "planar". Ties go to the smallest
    ``tie_break`` columns (default: the target coordinates, then all target columns). Sites or targets
    without valid coordinates never match. Each place is searched once, however many sites share it;
    at one coordinate only the k first targets can win, so the others are dropped before the search.
    """
    shared = set(sites.columns) & set(targets.columns)
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    order = _order(targets, target_lat, target_lon, tie_break)
    points = targets.filter(in_range(F.col(target_lat), F.col(target_lon)))
    if k == 1:
        first = F.min(F.struct(*order)).alias("_t")
        points = points.groupBy(target_lat, target_lon).agg(first).select("_t.*").select(*targets.columns)
    else:
        here = Window.partitionBy(target_lat, target_lon).orderBy(*order)
        points = points.withColumn("_here", F.row_number().over(here)).filter(F.col("_here") <= k).drop("_here")
    return nearest_in(build(points, metric, lat=target_lat, lon=target_lon), sites, k, site_lat, site_lon, tie_break)


def _order(targets: DataFrame, lat: str, lon: str, tie_break: list[str] | None) -> list[str]:
    order = tie_break or [lat, lon]
    return [*order, *(c for c in targets.columns if c not in order)]


def nearest_in(tree: Tree, sites: DataFrame, k: int = 1, site_lat: str = "lat", site_lon: str = "lon",
               tie_break: list[str] | None = None) -> DataFrame:
    """``nearest`` in a tree that is there already, whose points are all candidates. With weights only k = 1 is right."""
    space, axes = tree.space, tree.space.axes
    columns = [c for c in tree.points.columns if c not in (*axes, "_key")]
    s_lat, s_lon, t_lat, t_lon = (F.col(c) for c in (site_lat, site_lon, tree.lat, tree.lon))
    order = _order(tree.points.select(*columns), tree.lat, tree.lon, tie_break)
    place = ["_place", "_slat", "_slon"]
    found = with_axes(staged_places(sites, site_lat, site_lon), space, F.col("_slat"), F.col("_slon")).withColumn(
        "_bound", F.lit(math.inf))
    # Rounding may tell two distances apart that are one.
    limit = "_bound * 1.000000001D + 1e-20D"
    for i in range(len(tree.shifts)):
        step = found.withColumn("_children", tree.top()) if i == 0 else found.join(tree.level(i), "_node")
        # A node that holds k points bounds the k-th distance; nodes beyond the bound are dropped at once.
        # The one-element explode keeps the bound from being worked out again for every child.
        local = f"array_min(transform(filter(_children, c -> c._n >= {k}), c -> {far(axes, 'c')}))"
        step = (
            step.selectExpr(*place, *axes, "_children", f"explode(array(least(_bound, {local}))) AS _bound")
            .selectExpr(*place, *axes, "_bound", f"explode(filter(_children, c -> {near(axes, 'c')} <= {limit})) AS _kid")
            .selectExpr(*place, *axes, "_bound", "_kid", f"{far(axes, '_kid')} AS _far")
        )
        # The bound over all remaining nodes of the place: nodes in order of their far side up to k points.
        kth = "_far"
        if k > 1:
            step = step.selectExpr("*", "sum(_kid._n) OVER (PARTITION BY _place ORDER BY _far) AS _upto")
            kth = f"IF(_upto >= {k}, _far, NULL)"
        found = (
            step.selectExpr(*place, *axes, "_kid", f"least(_bound, min({kth}) OVER (PARTITION BY _place)) AS _bound")
            .filter(f"{near(axes, '_kid')} <= {limit}")
            .selectExpr(*place, *axes, "_bound", "_kid._node AS _node")
        )
    candidates = found.select("_place", "_slat", "_slon", "_node").join(tree.leaf_points().drop(*axes), "_node").select(
        "_place", *columns, space.distance(F.col("_slat"), F.col("_slon"), t_lat, t_lon).alias("distance"))
    if k == 1:
        row = F.struct("distance", *order)
        best = candidates.groupBy("_place").agg(F.min(row).alias("_t")).select("_place", "_t.*").select(
            "_place", *columns, "distance", F.lit(1).alias("rank"))
    else:
        by_distance = Window.partitionBy("_place").orderBy("distance", *order)
        best = candidates.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k)
    return sites.select("*", F.concat_ws(" ", s_lat, s_lon).alias("_place")).join(best, "_place").drop("_place")


def nearest_listing(df: DataFrame, n: int = 15, by: str = "distance_km", key: str = "code_bss") -> DataFrame:
    """The n rows closest by a ready distance column."""
    return df.orderBy(F.col(by).asc_nulls_last(), F.col(key)).limit(n)


def by_distance(df: DataFrame, by: str = "distance_km", key: str = "code_bss") -> DataFrame:
    """All rows by distance; rows without a distance last."""
    return df.orderBy(F.col(by).asc_nulls_last(), F.col(key))


# ---- radius aggregates ------------------------------------------------------------------------------

@dataclass(frozen=True)
class RadiusParts:
    """What lies within a radius of each place, for aggregates.

    ``pairs``: place and spot columns of single hits. ``blocks``: place, block key and weight ``_n`` of nodes of spots
    that lie inside the circle as a whole. ``members``: spots with the key of every node they belong to.
    """

    pairs: DataFrame
    blocks: DataFrame
    members: DataFrame
    block_key: tuple[str, ...]


def radius_parts(places: DataFrame, tree: Tree, radius_km: float, place_lat: str = "lat", place_lon: str = "lon") -> RadiusParts:
    """Split "all spots within the radius of each place" into single pairs and whole nodes of a tree of the spots.

    Nodes inside the circle are taken whole, nodes outside are dropped, and only the leaves on the rim are compared spot
    by spot. A place next to a million spots thus yields some hundred nodes and the spots of a thin rim, not a million
    pairs. Results have the place's coordinates only.
    """
    axes = tree.space.axes
    columns = [c for c in tree.points.columns if c not in (*axes, "_key")]
    mine = [place_lat, place_lon]
    # Nodes between the two limits are looked into.
    inside, reach = _chords(radius_km)
    dealt = staged_places(places, place_lat, place_lon).select(F.col("_slat").alias(place_lat), F.col("_slon").alias(place_lon))
    beside = with_axes(dealt, tree.space, F.col(place_lat), F.col(place_lon))
    blocks = None
    for i, shift in enumerate(tree.shifts):
        found = beside.withColumn("_children", tree.top()) if i == 0 else beside.join(tree.level(i), "_node")
        reached = found.selectExpr(*mine, *axes, f"explode(filter(_children, c -> {near(axes, 'c')} <= {reach!r}D)) AS _kid")
        reached = reached.selectExpr(*mine, *axes, "_kid._node", "_kid._n", f"{far(axes, '_kid')} <= {inside!r}D AS _whole")
        whole = reached.filter("_whole").select(*mine, F.lit(shift).alias("_shift"), "_node", "_n")
        blocks = whole if blocks is None else blocks.unionByName(whole)
        beside = reached.filter("NOT _whole").drop("_n", "_whole")
    pairs = beside.select(*mine, "_node").join(tree.leaf_points().drop(*axes), "_node").withColumn(
        "distance_km", geo.haversine_km(F.col(place_lat), F.col(place_lon), F.col(tree.lat), F.col(tree.lon)))
    members = tree.points.withColumn("_shift", F.explode(F.array(*(F.lit(x) for x in tree.shifts)))).select(
        *columns, "_shift", F.expr("shiftright(_key, _shift)").alias("_node"))
    return RadiusParts(pairs.filter(F.col("distance_km") <= radius_km).select(*mine, *columns, "distance_km"), blocks, members,
                       ("_shift", "_node"))


# ---- points in polygons -----------------------------------------------------------------------------


def points_in_zones(points: DataFrame, zones: DataFrame, shape_col: str, lat_col: str, lon_col: str,
                    cell_degrees: float = 0.1, max_cells_per_zone: int = 4096,
                    hot_cell_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Each point with the zones that hold it (left join, "within"): the columns of both but the shape.

    A zone is listed under the cells it touches. A cell carries the edges whose boxes meet it, and the parity of the chains
    of edges that pass to its right: of such a chain only its two ends matter, and they belong to edges at the cell's
    column. So inner cells carry no edge and outer ones are not listed. A zone too large for ``max_cells_per_zone`` uses
    coarser cells (twice the size until it fits), and points look it up at that size, so no zone is lost. Each place is
    looked up once, however many points share it; crowded cells are split by a hash of the place, and their zones are
    repeated. Rings that are not closed are closed. The zones are numbered and staged once, by a job of their own.
    """
    shared = set(points.columns) & set(zones.columns)
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}")
    lat, lon = F.col("_lat"), F.col("_lon")
    places = points.select(F.col(lat_col).alias("_lat"), F.col(lon_col).alias("_lon")).dropna().distinct()
    staged = scratch_path(zones.sparkSession, "zones")
    zones.withColumn("_zone", F.monotonically_increasing_id()).write.parquet(staged)
    box = geo.envelope(F.col(shape_col))
    boxed = zones.sparkSession.read.parquet(staged).withColumn("_box", F.struct(*(v.alias(n) for n, v in box.items())))
    boxed = boxed.filter("_box.lon_min is not null")
    width = (F.col("_box.lon_max") - F.col("_box.lon_min")) / cell_degrees + 1
    height = (F.col("_box.lat_max") - F.col("_box.lat_min")) / cell_degrees + 1
    doublings = F.ceil(F.log2(F.greatest(F.lit(1.0), F.sqrt(width * height / max_cells_per_zone),
                                         F.greatest(width, height) / max_cells_per_zone)))
    boxed = boxed.withColumn("_level", F.greatest(F.lit(0), doublings).cast("int"))
    size = F.lit(cell_degrees) * F.pow(F.lit(2.0), F.col("_level"))

    def cells(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(f"_box.{low}") / size), F.floor(F.col(f"_box.{high}") / size))

    # A little more than the cell, so that rounding at its border does not matter.
    slack = size * 1e-6
    sides = boxed.select("_zone", "_level", F.explode(geo.edges(F.col(shape_col))).alias("_e"))
    sides = sides.select("_zone", "_e", *(F.floor(v / size).alias(n) for n, v in (
        ("_column_1", F.col("_e.x1") - slack), ("_column_2", F.col("_e.x2") - slack),
        ("_right", F.greatest("_e.x1", "_e.x2") + slack), ("_low", F.least("_e.y1", "_e.y2") - slack),
        ("_high", F.greatest("_e.y1", "_e.y2") + slack))))
    first, last = F.least("_column_1", "_column_2"), F.greatest("_column_1", "_column_2")
    # An edge reaches beyond a column's right border with one end: the end of a chain that lies wholly to the right.
    reaching = F.when(F.col("_column_1") > F.col("_x"), F.col("_e.y1")).otherwise(F.col("_e.y2"))
    tip = F.when((first <= F.col("_x")) & (F.col("_x") < last), reaching)
    carried = (
        sides.withColumn("_x", F.explode(F.sequence(first, F.col("_right"))))
        .withColumn("_y", F.explode(F.sequence("_low", "_high")))
        .groupBy("_zone", "_x", "_y").agg(F.collect_list(F.struct("_e.*", tip.alias("tip"))).alias("_edges"))
    )
    passed = F.explode(F.sequence(first, last - 1)).alias("_x")
    above = sides.filter(first < last).select("_zone", passed, (F.col("_low") - 1).alias("_y"))
    above = above.groupBy("_zone", "_x", "_y").agg(F.count(F.lit(1)).alias("_above"))
    from_top = Window.partitionBy("_zone", "_x").orderBy(F.desc("_y")).rowsBetween(Window.unboundedPreceding, 0)
    cell_of_zone = ["_zone", "_x", "_y"]
    listed = (
        boxed.drop(shape_col)
        .withColumn("_y", F.explode(cells("lat_min", "lat_max"))).withColumn("_x", F.explode(cells("lon_min", "lon_max")))
        .join(carried, cell_of_zone, "left").join(above, cell_of_zone, "left")
        .withColumn("_odd", F.coalesce(F.sum("_above").over(from_top), F.lit(0)) % 2 == 1)
        .filter(F.col("_odd") | F.col("_edges").isNotNull()).drop("_zone", "_above")
    )
    # Few sizes are ever in use: one per doubling of the largest zone.
    sizes = boxed.select(F.sort_array(F.collect_set("_level")).alias("levels")).scalar()
    tagged = (
        places.withColumn("_level", F.explode(sizes))
        .withColumn("_x", F.floor(lon / size))
        .withColumn("_y", F.floor(lat / size))
    )
    cell = ["_level", "_x", "_y"]
    crowded = (
        tagged.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_cell_rows)
        .select(*cell, F.ceil(F.col("_n") / hot_cell_rows).alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    spread = (
        tagged.join(crowded, cell, "left")
        .withColumn("_part", F.pmod(F.xxhash64("_lat", "_lon"), parts)).drop("_parts")
    )
    listed = (
        listed.join(crowded, cell, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    )
    tips_above = F.size(F.filter("_edges", lambda e: e.tip > lat)) % 2 == 1
    hits = (
        spread.join(listed, [*cell, "_part"])
        .filter(lon.between(F.col("_box.lon_min"), F.col("_box.lon_max"))
                & lat.between(F.col("_box.lat_min"), F.col("_box.lat_max")))
        .filter(F.when(F.col("_edges").isNull(), F.col("_odd")).otherwise(
            geo.within_edges(F.col("_edges"), lon, lat) != (F.col("_odd") != tips_above)))
        .select("_lat", "_lon", *(c for c in zones.columns if c != shape_col))
    )
    return points.join(hits, (F.col(lat_col) == lat) & (F.col(lon_col) == lon), "left").drop("_lat", "_lon")
