"""Queries on projected observations: boxes, reductions over a box, extents and nearest neighbours."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import numeric
from gridloom.functions.kinds import KINDS
from gridloom.functions.projection import DEFAULT, Projection
from gridloom.functions.reductions import Observed, reduction
from gridloom.operators.assign import box_distances
from gridloom.plans.gridspec import Bounds
from gridloom.sources.scratch import written


def observe(obs: DataFrame, projection: Projection | str = DEFAULT, mode: str = "failfast") -> DataFrame:
    """Project observations: lon and lat become 32-bit x and y; a missing t is 0.

    ``mode`` says what a coordinate or time that isn't finite does: ``failfast`` stops the query, ``drop`` leaves the row out.
    """
    if mode not in ("failfast", "drop"):
        raise ValueError(f"unknown mode {mode!r}")
    p = Projection.parse(projection) if isinstance(projection, str) else projection
    t = F.col("t").cast("float") if "t" in obs.columns else F.lit(0.0).cast("float")
    given = obs.withColumns({"lon": F.col("lon").cast("float"), "lat": F.col("lat").cast("float"), "t": t})
    ok = F.lit(True)
    for c in ("lon", "lat", "t"):
        ok = ok & (F.abs(c) < F.lit(math.inf))  # neither null nor NaN
    if mode == "drop":
        given = given.where(ok)
    stop = lambda c: F.when(ok, c).otherwise(F.raise_error(F.lit("an observation isn't finite")).cast("float"))
    if mode == "failfast" and p.kind in KINDS:
        given = given.withColumn("lon", stop(F.col("lon")))
    x, y = p.forward(F.col("lon"), F.col("lat"))
    if mode == "failfast" and p.kind not in KINDS:  # around the short formulas, where it stands once: filters on x copy all of it
        x = stop(x)
    return given.select(*(c for c in obs.columns if c not in ("lon", "lat", "t")), x.alias("x"), y.alias("y"), "t")


def range_query(observed: DataFrame, bounds: Bounds) -> DataFrame:
    """The observations in a closed box; finite bounds are pushed to the scan."""
    return observed.where(bounds.predicate())


def reduce_box(observed: DataFrame, name: str, bounds: Bounds, input_fill: float = -999.0, output_fill: float = -999.0, restrict: bool = True, compat: bool = False) -> DataFrame:
    """One row: the reduction of a box.  ``restrict=False`` takes all rows and uses the box for its centre alone."""
    r = reduction(name)
    rows = range_query(observed, bounds) if restrict else observed
    edge = lambda v: F.lit(float(v)).cast("float")
    d2, d = box_distances(edge(bounds.x_lo), edge(bounds.x_hi), edge(bounds.y_lo), edge(bounds.y_hi), compat)
    if r.style == "coded":
        return rows.agg(r.build(Observed(F.col("value"), F.col("t"), F.col("record_index"), d2, d)).alias("value"))
    value = numeric(F.col("value"))
    rows = rows.where(value != F.lit(float(input_fill)))
    return rows.agg(F.coalesce(r.build(Observed(value, F.col("t"), F.col("record_index"), d2, d)), F.lit(float(output_fill))).alias("value"))


def observation_extent(observed: DataFrame) -> DataFrame:
    """One row: smallest and largest x, y and t, and the number of observations."""
    return observed.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y", "t") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("num_observations"))


#: Targets up to this number are broadcast to the tiles around them.
FEW_TARGETS = 1 << 16


def nearest_neighbour(observed: DataFrame, targets: DataFrame, tile: float | None = None) -> DataFrame:
    """The nearest observation of each target (target_id, x, y): target_id, record_index, d2.  The smallest index wins ties.

    Observations are put into tiles, and the list of tiles that hold any is written, each with the box of what it holds.  Rings grow
    around the targets; in each round a target meets the occupied tiles of its ring only, found by a join on blocks of tiles as wide as
    the ring, and keeps those that may hold a nearer observation than another tile surely does.  A target is settled when nothing
    further out can be nearer, so most are settled after a few rounds, and an empty region costs nothing but rounds.  The rounds work on
    tiles alone: however many they are, the places of the observations are read three times, for their extent, for the tiles and for the
    distances within the tiles that are left.  All joins are equi-joins; every round is a written table, so lost executors cost no more
    than their tasks.
    """
    # written, because a filter on x and y would copy their whole projection into each of its conditions
    places = written(observed.select("record_index", "x", "y"), "places")
    obs = places.select("record_index", F.col("x").cast("double").alias("ox"), F.col("y").cast("double").alias("oy")).where(~F.isnan("x") & (F.abs("x") != math.inf) & (F.abs("y") != math.inf))
    west, east, south, north, n = obs.agg(F.min("ox"), F.max("ox"), F.min("oy"), F.max("oy"), F.count("*")).first()
    target = targets.select("target_id", F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty"))
    index = observed.schema["record_index"].dataType
    if not n:
        return target.select("target_id", F.lit(None).cast(index).alias("record_index"), F.lit(None).cast("double").alias("d2"))
    span = max(east - west, north - south, 1e-9)
    tile = tile or max(span / max(1.0, math.sqrt(n / 8)), span / 1e6)
    at = lambda c, low, high: F.floor(F.least(F.greatest(c, F.lit(low)), F.lit(high)) / F.lit(tile)).cast("long")
    obs = obs.select("*", at(F.col("ox"), west, east).alias("i"), at(F.col("oy"), south, north).alias("j"))
    edges = (f(c).alias(f"{c}_{k}") for c in ("ox", "oy") for k, f in (("low", F.min), ("high", F.max)))
    occupied = written(obs.groupBy("i", "j").agg(*edges), "tiles")
    # ti, tj: the tile of the place within the extent that is nearest to the target; bound: some observation is as near as this
    left = written(target.select("*", at(F.col("tx"), west, east).alias("ti"), at(F.col("ty"), south, north).alias("tj"), F.lit(None).cast("double").alias("bound")), "targets")
    target = left.select("target_id", "tx", "ty")
    wide = max(math.floor(east / tile) - math.floor(west / tile), math.floor(north / tile) - math.floor(south / tile)) + 1
    asked, mets, bounds, inner, outer = left.count(), [], [], -1, 1
    few = asked <= FEW_TARGETS
    while asked:
        met = written(_ring(left, occupied, inner, outer, asked <= FEW_TARGETS), "met")
        least = met.groupBy("target_id").agg(F.min("most").alias("most"))
        now = written(left.join(least, "target_id", "left").select("target_id", "tx", "ty", "ti", "tj", F.least("bound", "most").alias("bound")), "bounds")
        # the distance to the nearest edge of the square of tiles seen so far
        side = lambda t, k: F.least(F.col(t) - (F.col(k) - outer) * tile, (F.col(k) + outer + 1) * tile - F.col(t))  # noqa: B023, E731
        reach = F.least(side("tx", "ti"), side("ty", "tj"))
        slack = 1 + 1e-9  # against rounding at a tile's edge
        settled = F.coalesce(F.col("bound") * slack < F.when(reach > 0, reach * reach).otherwise(0.0), F.lit(False))
        mets.append(met)
        bounds.append((now if outer >= wide else now.where(settled)).select("target_id", "bound"))
        left = now.where(~settled)
        asked = left.count() if outer < wide else 0
        inner, outer = outer, min(wide, 2 * outer + 1)
    if not mets:
        return target.select("target_id", F.lit(None).cast(index).alias("record_index"), F.lit(None).cast("double").alias("d2"))
    bound = reduce(DataFrame.union, bounds)
    near = reduce(DataFrame.union, mets).join(F.broadcast(bound) if few else bound, "target_id").where(F.col("least") <= F.col("bound"))
    near = written(near.select("target_id", "tx", "ty", "i", "j"), "near")
    dx, dy = F.col("tx") - F.col("ox"), F.col("ty") - F.col("oy")
    found = near.join(obs, ["i", "j"]).select("target_id", (dx * dx + dy * dy).alias("d2"), "record_index")
    found = found.groupBy("target_id").agg(F.min(F.struct("d2", "record_index")).alias("m"))
    return written(target.join(found, "target_id", "left").select("target_id", F.col("m.record_index").alias("record_index"), F.col("m.d2").alias("d2")), "nearest")


def _ring(left: DataFrame, occupied: DataFrame, inner: int, outer: int, few: bool) -> DataFrame:
    """The targets with the occupied tiles ``inner`` + 1 to ``outer`` away that may hold the nearest observation.

    ``least`` and ``most`` are squared distances to the nearest and the furthest place of what a tile holds.  Rounding keeps the order of
    differences, squares and sums, so no observation's d2 as computed is outside them.
    """
    block = outer + 1
    part = lambda c: F.floor(F.col(c) / F.lit(block)).cast("long")
    tiles = occupied.select("*", part("i").alias("bi"), part("j").alias("bj"))
    around = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    asked = left.select("target_id", "tx", "ty", "ti", "tj", "bound", around.alias("a")).select("*", around.alias("b"))
    asked = asked.select("target_id", "tx", "ty", "ti", "tj", "bound", (part("ti") + F.col("a")).alias("bi"), (part("tj") + F.col("b")).alias("bj"))
    away = F.greatest(F.abs(F.col("i") - F.col("ti")), F.abs(F.col("j") - F.col("tj")))
    met = tiles.join(F.broadcast(asked) if few else asked, ["bi", "bj"]).where((away > inner) & (away <= outer))
    gap = lambda t, o: F.greatest(F.col(f"{o}_low") - F.col(t), F.col(t) - F.col(f"{o}_high"), F.lit(0.0))
    far = lambda t, o: F.greatest(F.abs(F.col(f"{o}_low") - F.col(t)), F.abs(F.col(f"{o}_high") - F.col(t)))
    square = lambda f: f("tx", "ox") * f("tx", "ox") + f("ty", "oy") * f("ty", "oy")
    met = met.select("target_id", "tx", "ty", "bound", "i", "j", square(gap).alias("least"), square(far).alias("most"))
    return met.where(F.col("bound").isNull() | (F.col("least") <= F.col("bound"))).drop("bound")
