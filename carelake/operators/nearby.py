"""Nearest facilities within a radius, for a whole frame of query points.

Positions become points in space cut into cubes, which have no poles and no
date line. The points, the large side, keep one cube key each and are never
multiplied; per occupied point cube the cubes of facilities that can hold one
of the ``k`` nearest are worked out from counts alone, from wide cubes to fine
ones where facilities crowd, and only their facilities meet the points. The
result is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions.geo import SPHERE_M, facility_tier, great_circle_m, sphere_xyz
from carelake.operators.filters import with_position
from carelake.operators.layout import spread

AXES = ("x", "y", "z")
SLACK_M = 0.01   # rounding of positions against the cube tests
FIRST_SPLIT = 8  # cubes per radius at the first level
FINER = 4        # each further level cuts a cube this much finer per axis
LEVELS = 5       # down to about a metre for a radius of some kilometres
CROWDED = 512    # positions in one cube that ask for a finer level


def _cell(df: DataFrame, width: float, radius_m: float, prefix: str) -> DataFrame:
    xyz = sphere_xyz(F.col("lat").cast("double"), F.col("lon").cast("double"), radius_m)
    return df.withColumns({f"{prefix}{a}": F.floor(v / width) for a, v in zip(AXES, xyz)})


def _names(prefix: str) -> list[str]:
    return [f"{prefix}{a}" for a in AXES]


def _coarser(prefix: str, ratio: int, name: str) -> list[Column]:
    """The same cubes, ``ratio`` times wider, under a new prefix."""
    return [F.floor(F.col(f"{prefix}{a}") / ratio).alias(f"{name}{a}") for a in AXES]


def _colocated(facilities: DataFrame, k: int) -> DataFrame:
    """At one position only the ``k`` smallest ids of a rank group can be among the ``k`` best."""
    w = Window.partitionBy("lon", "lat", "tier").orderBy("facility_id")
    return (facilities.withColumn("_at", F.row_number().over(w))
            .where(F.col("_at") <= k).drop("_at"))


def busiest_cell(facilities: DataFrame, radius_km: float, split: int,
                 radius_m: float = SPHERE_M) -> int:
    """Most positions in one cube, with ``split`` cubes per radius."""
    places = with_position(facilities).select("lon", "lat").distinct()
    cells = _cell(places, radius_km * 1000 / split, radius_m, "f").groupBy(*_names("f")).count()
    return cells.agg(F.max("count")).first()[0] or 0


def levels_for(facilities: DataFrame, radius_km: float, radius_m: float = SPHERE_M) -> int:
    """As many levels as it takes until no cube is crowded."""
    for levels in range(1, LEVELS):
        if busiest_cell(facilities, radius_km, FIRST_SPLIT * FINER ** (levels - 1), radius_m) <= CROWDED:
            return levels
    return LEVELS


def _pruned(pairs: DataFrame, width: float, reach: float, k: int) -> DataFrame:
    """Pairs of cubes that can hold one of the k nearest of a point cube.

    The k nearest lie within the far side of the closest cubes that hold k
    together, so a cube whose near side is beyond that is of no use.
    """
    def span(extra):
        steps = [F.greatest(F.abs(F.col(f"p{a}") - F.col(f"f{a}")) + extra, F.lit(0)) for a in AXES]
        return F.sqrt(reduce(Column.__add__, [(s * s).cast("double") for s in steps])) * width
    keys = [*_names("p"), *_names("f"), "tier"]
    measured = pairs.select(*keys, "n", span(-1).alias("near"), span(1).alias("far")).where(F.col("near") <= reach)
    per_cube = Window.partitionBy(*_names("p"), "tier")
    held = F.sum("n").over(per_cube.orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    bound = F.min(F.when(F.col("held") >= k, F.col("far"))).over(per_cube)
    return (measured.withColumn("held", held).withColumn("bound", bound)
            .where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") + SLACK_M)).select(*keys))


def _useful_pairs(pts: DataFrame, fac: DataFrame, levels: int, width: float, reach: float, k: int) -> DataFrame:
    """Pairs of finest cubes, found from wide cubes to fine ones, pruned at each level."""
    pairs = None
    for level in range(levels):
        ratio = FINER ** (levels - 1 - level)
        asked = pts.select(*_coarser("p", ratio, "p")).distinct()
        filled = fac.select("tier", *_coarser("f", ratio, "f")).groupBy("tier", *_names("f")).agg(
            F.count(F.lit(1)).alias("n"))
        if pairs is None:
            # Occupied facility cubes, seen from the 27 radius-wide cubes around them.
            asked = asked.select("*", *_coarser("p", FIRST_SPLIT, "c"))
            for a in AXES:
                wide = F.floor(F.col(f"f{a}") / FIRST_SPLIT)
                filled = filled.withColumn(f"c{a}", F.explode(F.sequence(wide - 1, wide + 1)))
            met = asked.join(filled, _names("c"))
        else:
            parents = pairs.select("tier", *[F.col(f"p{a}").alias(f"c{a}") for a in AXES],
                                   *[F.col(f"f{a}").alias(f"d{a}") for a in AXES])
            met = (parents.join(asked.select("*", *_coarser("p", FINER, "c")), _names("c"))
                   .join(filled.select("*", *_coarser("f", FINER, "d")), ["tier", *_names("d")]))
        pairs = _pruned(met, width * ratio, reach, k)
    return pairs


def nearby_facilities(points: DataFrame, facilities: DataFrame, radius_km: float = 5.0,
                      k: int = 10, order: str = "distance", levels: int | None = None, salts: int = 4,
                      radius_m: float = SPHERE_M) -> DataFrame:
    """``points(point_id,lon,lat)`` x ``facilities(facility_id,lon,lat[,kind])``.

    Returns ``point_id, facility_id, tier, distance_km, rank`` with rank up to
    ``k``. ``order`` is ``distance``, or ``tier`` for hospital type first.
    ``levels`` of ever finer cubes are counted from the facilities when not
    given; ``salts`` spreads the points of a hot cube.
    """
    if order not in ("distance", "tier"):
        raise ValueError(order)
    levels = levels or levels_for(facilities, radius_km, radius_m)
    width = radius_km * 1000 / (FIRST_SPLIT * FINER ** (levels - 1))
    tier = facility_tier(F.col("kind")) if order == "tier" else F.lit(0)
    located = with_position(facilities).select("facility_id", "lon", "lat", tier.alias("tier"))
    fac = _cell(_colocated(located, k), width, radius_m, "f")
    pts = _cell(spread(with_position(points).select("point_id", "lon", "lat")), width, radius_m, "p")
    useful = _useful_pairs(pts, fac, levels, width, radius_km * 1000 + SLACK_M, k)
    offered = (useful.join(fac, ["tier", *_names("f")])
               .select(*_names("p"), "tier", "facility_id", F.col("lon").alias("flon"),
                       F.col("lat").alias("flat"))
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))

    salted = pts.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(salts)).cast("int"))
    metres = great_circle_m(F.col("lat").cast("double"), F.col("lon").cast("double"),
                            F.col("flat").cast("double"), F.col("flon").cast("double"), radius_m)
    found = (salted.join(offered, [*_names("p"), "salt"])
             .select("point_id", "facility_id", "tier", (metres / 1000).alias("distance_km"))
             .where(F.col("distance_km") <= radius_km))
    best = Window.partitionBy("point_id").orderBy("tier", "distance_km", "facility_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def prefer_open(found: DataFrame, fallback: int = 3) -> DataFrame:
    """Open facilities of each point; where none is open, its first few."""
    w = Window.partitionBy("point_id")
    return (found.withColumn("any_open", F.max("is_open").over(w))
            .where(F.col("is_open") | (~F.col("any_open") & (F.col("rank") <= fallback)))
            .drop("any_open"))
