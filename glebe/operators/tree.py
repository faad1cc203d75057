"""A packed tree of points: built once per table, walked by nearest searches and radius aggregates.

Points are sorted along a space-filling curve over all tasks and numbered in that order; the numbers' leading bits are the
nodes. So every leaf holds at most 64 points and every node at most 64 nodes below it, however crowded a spot is, and the
depth follows from the number of points. A node carries the weight and the tight box of its points.

The numbered points and the nodes are written to the work folder: all walks read the same numbers, whatever is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.functions import geo
from glebe.session import scratch_path

#: Bits of a point's number that one level of nodes stands for.
FAN_BITS = 6
#: Bits of a number that count within a partition, as ``monotonically_increasing_id`` gives them.
_WITHIN = 33


class Plane:
    """Raw degrees: rank by squared degrees, no wrap at the date line."""

    axes = ("_u", "_v")
    size, offset = 1024.0, 512.0

    @staticmethod
    def coordinates(lat: Column, lon: Column) -> tuple[Column, ...]:
        return lat, lon

    distance = staticmethod(geo.squared_degrees)


class Sphere:
    """Points on the unit sphere: rank by great-circle distance, no special case anywhere."""

    axes = ("_u", "_v", "_w")
    size, offset = 2.0, 1.0

    @staticmethod
    def coordinates(lat: Column, lon: Column) -> tuple[Column, ...]:
        phi, lam = F.radians(lat), F.radians(lon)
        return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)

    distance = staticmethod(geo.haversine_km)


METRICS = {"planar": Plane, "haversine": Sphere}


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-540.0, 540.0)


def with_axes(points: DataFrame, space, lat: Column, lon: Column) -> DataFrame:
    return points.select("*", *(c.alias(a) for a, c in zip(space.axes, space.coordinates(lat, lon))))


def near(axes: tuple[str, ...], box: str) -> str:
    """Squared distance from a place to the near side of a box."""
    return " + ".join(f"pow(greatest({box}._lo{a} - {a}, {a} - {box}._hi{a}, 0D), 2D)" for a in axes)


def far(axes: tuple[str, ...], box: str) -> str:
    """Squared distance from a place to the far side of a box."""
    return " + ".join(f"pow(greatest({box}._hi{a} - {a}, {a} - {box}._lo{a}), 2D)" for a in axes)


@dataclass(frozen=True)
class Tree:
    """``points``: the table's columns, the axes and the number ``_key``. ``nodes``: (_shift, _node, _children), the nodes
    at ``_shift`` bits below node ``_node``. ``shifts``: those of all levels, top first; the last are the leaves.
    """

    space: type
    points: DataFrame
    nodes: DataFrame
    shifts: tuple[int, ...]
    lat: str
    lon: str

    def top(self) -> Column:
        """The nodes of the top level, in one array: few, whatever the table."""
        return self.level(0).select("_children").scalar()

    def level(self, place: int) -> DataFrame:
        """(_node, _children): the nodes of one level by the node above."""
        return self.nodes.filter(F.col("_shift") == self.shifts[place]).drop("_shift")

    def leaf_points(self) -> DataFrame:
        """The points with their leaf in ``_node``."""
        return self.points.withColumn("_node", F.shiftright("_key", self.shifts[-1])).drop("_key")


def _curve(space) -> Column:
    """A place's number along the curve: the leading bits of all axes, interleaved."""
    dims = len(space.axes)
    bits = 60 // dims
    scaled = [f"cast(floor(({a} + {space.offset}D) / {space.size}D * {float(1 << bits)}D) AS bigint)" for a in space.axes]
    names = [f"q{i}" for i in range(dims)]
    cells = ", ".join(f"'{n}', least({(1 << bits) - 1}L, greatest(0L, {q}))" for n, q in zip(names, scaled))
    digit = " + ".join(f"(shiftright(c.{n}, b) & 1L) * {1 << i}" for i, n in enumerate(names))
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), 0L, (code, b) -> code * {1 << dims} + "
                  f"transform(array(named_struct({cells})), c -> {digit})[0])")


def _levels(sizes: dict[int, int]) -> tuple[int, ...]:
    """Shifts of all levels, top first, from the number of points per partition; at most 64 nodes are at the top."""

    def nodes(shift: int) -> int:
        if shift >= _WITHIN:
            return len({part >> (shift - _WITHIN) for part in sizes})
        return sum(-(-n >> shift) if n else 0 for n in sizes.values())

    shifts = [FAN_BITS]
    while nodes(shifts[-1]) > 1 << FAN_BITS:
        # Once every partition is one node, the levels up to the partition's own bits would hold one node each.
        single = shifts[-1] < _WITHIN and nodes(shifts[-1]) == len(sizes)
        shifts.append((_WITHIN if single else shifts[-1]) + FAN_BITS)
    return tuple(reversed(shifts))


def build(points: DataFrame, metric: str = "haversine", weight: str | None = None,
          lat: str = "latitude", lon: str = "longitude") -> Tree:
    """The tree of all rows with valid coordinates. ``weight`` is a column that says how many a row stands for."""
    space = METRICS[metric]
    axes, spark = space.axes, points.sparkSession
    placed = with_axes(points.filter(in_range(F.col(lat), F.col(lon))), space, F.col(lat), F.col(lon)).withColumn("_code", _curve(space))
    # Places closer together than the curve tells apart are in the order of their coordinates.
    order = ["_code", *axes]
    path = scratch_path(spark, "tree-points")
    placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_code").withColumn(
        "_key", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    # A row a partition.
    sizes = {r.part: r.n for r in numbered.groupBy(F.shiftright("_key", _WITHIN).alias("part")).agg(
        (F.max(F.col("_key").bitwiseAND((1 << _WITHIN) - 1)) + 1).alias("n")).collect()}
    shifts = _levels(sizes)

    low, high = [f"_lo{a}" for a in axes], [f"_hi{a}" for a in axes]
    cells = numbered.groupBy(F.shiftright("_key", shifts[-1]).alias("_node")).agg(
        F.sum(weight if weight else F.lit(1)).cast("bigint").alias("_n"),
        *(F.min(a).alias(c) for a, c in zip(axes, low)), *(F.max(a).alias(c) for a, c in zip(axes, high)))
    children = F.collect_list(F.struct("_node", "_n", *low, *high)).alias("_children")
    as_cells = [
        "_node", "aggregate(_children, 0L, (n, c) -> n + c._n) AS _n",
        *(f"array_min(transform(_children, c -> c.{c})) AS {c}" for c in low),
        *(f"array_max(transform(_children, c -> c.{c})) AS {c}" for c in high),
    ]
    nodes = None
    for shift, above in zip(reversed(shifts), [*reversed(shifts[:-1]), None]):
        parent = F.lit(0).cast("bigint") if above is None else F.shiftright("_node", above - shift)
        level = cells.groupBy(parent.alias("_node")).agg(children)
        cells = level.selectExpr(*as_cells)
        level = level.select(F.lit(shift).alias("_shift"), "_node", "_children")
        nodes = level if nodes is None else nodes.unionByName(level)
    path = scratch_path(spark, "tree-nodes")
    nodes.write.parquet(path)
    return Tree(space, numbered, spark.read.schema(nodes.schema).parquet(path), shifts, lat, lon)


#: Places that one task searches for, at least where there are many.
PLACES_PER_TASK = 20_000


def staged_places(sites: DataFrame, lat: str, lon: str) -> DataFrame:
    """The distinct valid places (_place, _slat, _slon) of a table, written to the work folder and dealt to tasks.

    A search takes far more work than a place's few bytes tell, so the tasks come from the number of places: as many as
    the cluster has cores, and more once each has ``PLACES_PER_TASK``. The key is text, since partitioning by doubles is
    not kept from one level to the next.
    """
    spark = sites.sparkSession
    s_lat, s_lon = F.col(lat), F.col(lon)
    path = scratch_path(spark, "places")
    sites.filter(in_range(s_lat, s_lon)).groupBy(F.concat_ws(" ", s_lat, s_lon).alias("_place")).agg(
        F.first(s_lat).alias("_slat"), F.first(s_lon).alias("_slon")).write.parquet(path)
    places = spark.read.parquet(path)
    n = places.count()
    tasks = max(min(n, 2 * spark.sparkContext.defaultParallelism), math.ceil(n / PLACES_PER_TASK), 1)
    return places.repartition(tasks, "_place")
