"""Matching of supplier sites to registered labs by distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions import geo, text
from assayline.functions.nulls import paste
from assayline.operators.lookups import attach, is_small, keep_listed

# Countries from which suppliers send data, as fixed values.
SUPPLIER_COUNTRIES = ("Eswatini", "Kenya", "Nigeria", "Uganda", "Zambia", "Zimbabwe", "Mozambique")

# Labs are put in an order in which neighbours on the ground mostly follow each other: that of cells of some 12 m, which
# the cube around the unit sphere is cut into, with the axes' bits taken in turn. Quantiles cut the order into RANGES, a leaf
# is LEAF labs that follow each other, and a node is FAN leaves or nodes: so cells are small where labs are dense.
GRID_BITS = 20
RANGES = 64
LEAF = 32
FAN = 32
# Rounding allowance for straight-line distances on the unit sphere (some micrometres on the ground).
SLACK = 1e-12


def geocode_queries(site: DataFrame, country: DataFrame) -> DataFrame:
    """Search text for the place of each site: name, city and country, ASCII, and "laboratory"."""
    placed = attach(site.select("supplier_site_id", "supplier_site_name", "city", "country_code"), country, "country_code")
    address = text.squish(text.ascii_only(paste("supplier_site_name", "city", "country_name")))
    return placed.withColumn("site_name_city_country", address).withColumn(
        "query", paste("site_name_city_country", F.lit("laboratory"))
    )


def flatten_candidates(replies: DataFrame) -> DataFrame:
    """One row per candidate of a place-search reply; a site without candidates keeps one empty row.

    ``candidates`` is an array of ``(name, formatted_address, geometry(location(lat, lng)))``.
    """
    one = replies.select(
        "supplier_site_id",
        F.col("site_name_city_country").alias("supplier_site_name_city_country"),
        F.explode_outer("candidates").alias("c"),
    )
    return one.select(
        "supplier_site_id",
        "supplier_site_name_city_country",
        F.col("c.name").alias("candidate_name"),
        F.col("c.formatted_address").alias("candidate_address"),
        F.col("c.geometry.location.lat").alias("candidate_lat"),
        F.col("c.geometry.location.lng").alias("candidate_lon"),
    )


def labs_in(labs: DataFrame, countries: Sequence[str] = SUPPLIER_COUNTRIES) -> DataFrame:
    """Labs of the listed countries."""
    return labs.filter(F.col("countryname").isin(*countries))


def active_sites(sites: DataFrame, active: DataFrame) -> DataFrame:
    """Sites that are listed as active."""
    return keep_listed(sites, active, "supplier_site_id")


_AXES = ("x", "y", "z")
_BOX = ("one", *[f"{f}_{a}" for a in _AXES for f in ("min", "max")])


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    vector = geo.unit_vector(F.col(lat), F.col(lon))
    return df.withColumns(dict(zip(_AXES, vector)))


def _every_third(number: Column) -> Column:
    """The bits of a number, two free places after each: halves are moved apart, then their halves, and so on."""
    out = number.cast("long")
    for width in (32, 16, 8, 4, 2):
        kept = sum(1 << (3 * width // 2 * (bit // (width // 2)) + bit % (width // 2)) for bit in range(GRID_BITS + 1))
        out = (out.bitwiseOR(F.shiftleft(out, width))).bitwiseAND(F.lit(kept))
    return out


def _cell() -> Column:
    """Number of a point's cell."""
    cells = 1 << GRID_BITS
    axes = [F.least(F.floor((F.col(a) + 1.0) * (cells / 2)), F.lit(cells - 1)) for a in _AXES]
    spread = [F.shiftleft(_every_third(n), i) for i, n in enumerate(axes)]
    return spread[0].bitwiseOR(spread[1]).bitwiseOR(spread[2])


def _leaves(places: DataFrame) -> DataFrame:
    """Leaves of labs: range, no (in the range), the labs, and the box around them with one of them."""
    celled = places.withColumn("cell", _cell())
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = celled.agg(F.percentile_approx("cell", steps, F.lit(100 * RANGES))).scalar()
    ranged = celled.withColumn("cuts", F.coalesce(cuts, F.array().cast("array<bigint>")))
    ranged = ranged.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("cell")))).drop("cuts")
    row = F.row_number().over(Window.partitionBy("range").orderBy("cell", "latitude", "longitude")) - 1
    numbered = ranged.withColumn("no", F.floor(row / LEAF).cast("long"))
    labs = F.collect_list(F.struct("latitude", "longitude", "lab.id", "lab.name")).alias("inside")
    bounds = [f(a).alias(f"{f.__name__}_{a}") for a in _AXES for f in (F.min, F.max)]
    return numbered.groupBy("range", "no").agg(labs, F.min(F.struct(*_AXES)).alias("one"), *bounds)


def _nodes(below: DataFrame) -> DataFrame:
    """Nodes of at most FAN leaves or nodes, which they hold as ``inside``."""
    up = below.withColumn("up", F.floor(F.col("no") / FAN).cast("long"))
    held = F.collect_list(F.struct("range", "no", *_BOX)).alias("inside")
    bounds = [f(f"{f.__name__}_{a}").alias(f"{f.__name__}_{a}") for a in _AXES for f in (F.min, F.max)]
    return up.groupBy("range", "up").agg(held, F.min("one").alias("one"), *bounds).withColumnRenamed("up", "no")


def _length(parts: list[Column]) -> Column:
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def _near(box: Column) -> Column:
    """Smallest possible distance from a site to the labs in a box."""
    return _length([F.greatest(box[f"min_{a}"] - F.col(a), F.col(a) - box[f"max_{a}"], F.lit(0.0)) for a in _AXES])


def _to_one(box: Column) -> Column:
    """Distance from a site to the one lab known of a box, which the nearest lab cannot exceed."""
    return _length([F.col(a) - box["one"][a] for a in _AXES])


def _descended(frontier: DataFrame, boxes: Column, carried: Sequence[str]) -> DataFrame:
    """The boxes that may still hold the nearest lab of a site, a row each: range and no."""
    nearest = F.least(F.col("reach"), F.array_min(F.transform(boxes, _to_one)))
    met = frontier.select(*carried, boxes.alias("boxes"), nearest.alias("reach"))
    kept = F.filter("boxes", lambda b: _near(b) <= F.col("reach") + SLACK)
    return met.select(*carried, "reach", F.explode(kept).alias("b")).select(*carried, "reach", "b.range", "b.no")


def nearest_lab(sites: DataFrame, labs: DataFrame) -> DataFrame:
    """For each site the nearest lab: name, id, distance in km to two decimals, and place.

    Among labs at the same distance the lowest id wins; a site without coordinates gets NULLs.

    The search is exact and never compares all sites with all labs. Labs at one place count as one (the lowest id), sites at one
    place are searched once. Labs are held in a tree of boxes by their own density: leaves of LEAF labs, nodes of FAN leaves or nodes
    (``_leaves``). A site starts from the uppermost boxes, one for some 32,000 labs, which are one value; at each of the further
    levels it meets the node it came to, as one row, and goes on to those of its boxes whose nearest possible lab is not farther
    than the nearest lab known so far, one of each box it has seen. So a join brings a row per site and node, and dense places have
    no more of them than others. Distances are bounded along the straight line through the sphere, where longitudes do not wrap and
    poles are no special case.
    """
    small = is_small(labs)
    places = (
        labs.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy("latitude", "longitude")
        .agg(F.min(F.struct("id", "name")).alias("lab"))
    )
    leaves = _leaves(_on_sphere(places, "latitude", "longitude"))
    lower = _nodes(leaves)
    upper = _nodes(lower)
    top = upper.agg(F.collect_list(F.struct("range", "no", *_BOX))).scalar()

    # The place as text is an exact key by which the results of a place's rows meet.
    placed = sites.withColumn("_place", F.concat("candidate_lat", F.lit(" "), "candidate_lon"))
    searched = placed.filter(F.col("_place").isNotNull()).groupBy("_place").agg(
        F.first("candidate_lat").alias("lat"), F.first("candidate_lon").alias("lon")
    )
    carried = ["_place", "lat", "lon", *_AXES]
    start = _on_sphere(searched, "lat", "lon").withColumns({"reach": F.lit(float("inf")), "all": top})
    frontier = _descended(start, F.col("all"), carried)
    for level in (upper, lower):
        held = level.select("range", "no", "inside")
        frontier = _descended(frontier.join(F.broadcast(held) if small else held, ["range", "no"]), F.col("inside"), carried)

    held = leaves.select("range", "no", "inside")
    measured = F.transform(
        "inside",
        lambda lab: F.struct(
            geo.haversine_m(F.col("lat"), F.col("lon"), lab["latitude"], lab["longitude"]).alias("metres"),
            lab["id"].alias("id"),
            lab["name"].alias("name"),
            lab["latitude"].alias("latitude"),
            lab["longitude"].alias("longitude"),
        ),
    )
    best = (
        frontier.join(F.broadcast(held) if small else held, ["range", "no"])
        .select("_place", F.array_min(measured).alias("best"))
        .groupBy("_place")
        .agg(F.min("best").alias("best"))
    )
    return attach(placed, best, "_place", small=False).select(
        *sites.columns,
        F.col("best.name").alias("datim_name"),
        F.col("best.id").alias("id"),
        F.round(F.col("best.metres") / 1000, 2).alias("distance_nearest_datim_loc_km"),
        F.col("best.latitude").alias("datim_lat"),
        F.col("best.longitude").alias("datim_lon"),
    )
