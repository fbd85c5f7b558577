"""Metro stations as features: platforms beside their tracks, exits, and a concourse around all that belongs to a station."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from stoplake.functions.geo import from_metres, to_metres
from stoplake.functions.modes import metro_colour, relabel_branch
from stoplake.functions.text import slug
from stoplake.operators import extract, geometry
from stoplake.operators.places import nearest
from stoplake.session import ship_package

#: Fixed value: how far an exit may be from its station's centre, in metres.
EXIT_M = 400.0
#: Grid cells of the first search for a track, and how far a track may be from a stop at all, in metres.
NEAR_M, REACH_M = 500.0, 20_000.0
POINTS = "array<struct<x: double, y: double>>"
#: Rings of a batch, at most.
RINGS = 4096


def polylines(tracks: DataFrame) -> DataFrame:
    """track and its vertices in order, of two at least. tracks: track, pos, x, y; a track is a way, so its vertices are few."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return tracks.groupBy("track").agg(line.alias("line")).filter(F.size("line") >= 2)


def platforms(stops: DataFrame, tracks: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """stops with ring, the closed strip beside the nearest track; null without a track within reach_m.

    stops: stop (a key), x, y and more; tracks: track, pos, x, y. Among equally near vertices the first of the smallest track counts.
    Stops without a track in their grid cells are looked for once more in cells of reach_m.
    """
    ship_package(stops.sparkSession)
    lines = polylines(tracks)
    vertices = lines.select("track", F.posexplode("line").alias("at", "p")).select(F.struct("track", "at").alias("name"), "p.x", "p.y")
    points = stops.select(F.col("stop").alias("point_id"), "x", "y")
    near = nearest(points, vertices, NEAR_M)
    far = nearest(points.join(near, "point_id", "left_anti"), vertices, reach_m)
    chosen = near.unionByName(far).select(F.col("point_id").alias("stop"), "name.track", "name.at")
    # a track goes to its stops' vertices, not to each stop
    drawn = chosen.groupBy("track").agg(F.array_sort(F.collect_set("at")).alias("ats")).join(lines, "track").select("track", "ats", "line")
    track_type = pa_type(drawn.schema["track"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("track", track_type), ("at", pa.int32()), ("ring", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]
        for batch in batches:
            for k in range(batch.num_rows):
                track, ats, points = batch.column("track")[k].as_py(), batch.column("ats")[k].as_py(), batch.column("line")[k].values
                line = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1)
                for low in range(0, len(ats), RINGS):
                    some = ats[low : low + RINGS]
                    rings = [geometry.platform_ring(line, at) for at in some]
                    rings = [None if ring is None else [{"x": x, "y": y} for x, y in ring.tolist()] for ring in rings]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(([track] * len(some), some, rings), kinds)], names=[n for n, _ in kinds])

    rings = drawn.mapInArrow(work, f"track {drawn.schema['track'].dataType.simpleString()}, at int, ring {POINTS}")
    return stops.join(chosen.join(rings, ["track", "at"]).select("stop", "ring"), "stop", "left")


def concourses(parts: DataFrame) -> DataFrame:
    """station and ring (closed, in metres) of each station (J03, J05, J06, C23). parts: station, kind (stop, strip, exit), points.

    A station's points have a hull, which is smoothed and joined with the strips that straddle it. Under three points, or
    points on one line, are no concourse.
    """
    ship_package(parts.sparkSession)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        points = {k: [[(p["x"], p["y"]) for p in x] for x in g.points[g.kind == k]] for k in ("stop", "strip", "exit")}
        stops = [p for x in points["stop"] for p in x]
        hull = geometry.concave_hull(p for k in points.values() for x in k for p in x)
        if hull is None:
            return pd.DataFrame({"station": [], "ring": []})
        ring = geometry.dissolve(geometry.smooth(hull, stops), [np.array(x[:-1]) for x in points["strip"]], stops)
        return pd.DataFrame({"station": [g.station.iloc[0]], "ring": [[{"x": x, "y": y} for x, y in [*ring.tolist(), ring[0].tolist()]]]})

    # hulls and unions are of sets: what lies at one place counts once
    return parts.select("station", "kind", "points").distinct().groupBy("station").applyInPandas(one, f"station string, ring {POINTS}")


def _coordinates(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(*from_metres(p["x"], p["y"])))


def _feature(properties: Column, kind: str, coordinates: Column) -> Column:
    geometry_ = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry_.alias("geometry"))).alias("feature")


LAYERS = ("concourse", "platform", "exit")


def features(stops: DataFrame, tracks: DataFrame, entrances: DataFrame) -> DataFrame:
    """layer, station, rel_id, seq, exit_id and feature (GeoJSON) of stations (B06, H02); in the order of these columns they make up the document.

    stops: rel_id, line, seq, name, x, y (null where the stop's node is missing); tracks: track, pos, x, y; entrances: exit_id,
    name, x, y; all in metres. Layers are numbered in the order concourses, platforms, exits.
    """
    named = stops.withColumn("station", slug(F.coalesce("name", F.lit(""))))
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    served = F.collect_set(F.when(there, F.col("station")))
    by_rel = named.groupBy("rel_id").agg(F.max_by(F.when(there, F.coalesce("name", F.lit(""))), "seq").alias("terminus"), F.coalesce(relabel_branch(F.first("line"), served), F.first("line")).alias("line"))
    keyed = named.filter(there).select(F.struct("rel_id", "seq").alias("stop"), "rel_id", "seq", "station", "x", "y")
    strips = platforms(keyed, tracks)
    point = F.array(F.struct("x", "y"))
    parts = strips.select("station", F.lit("stop").alias("kind"), point.alias("points")).unionByName(strips.filter("ring IS NOT NULL").select("station", F.lit("strip").alias("kind"), F.col("ring").alias("points")))
    centres = parts.select("station", F.explode("points").alias("p")).groupBy("station").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    assigned = nearest(entrances.select(F.col("exit_id").alias("point_id"), "x", "y"), centres.withColumnRenamed("station", "name"), EXIT_M)
    exits = entrances.join(assigned.select(F.col("point_id").alias("exit_id"), F.col("name").alias("station")), "exit_id")
    rings = concourses(parts.unionByName(exits.select("station", F.lit("exit").alias("kind"), point.alias("points"))))
    layer = lambda kind: F.lit(LAYERS.index(kind)).alias("layer")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rel_type, exit_type, seq_type = (dict(df.dtypes)[c] for df, c in ((stops, "rel_id"), (entrances, "exit_id"), (stops, "seq")))
    about = F.struct(F.lit("concourse").alias("kind"), "station", F.lit(0).alias("level"))
    first = rings.select(layer("concourse"), "station", none(rel_type, "rel_id"), none(seq_type, "seq"), none(exit_type, "exit_id"), _feature(about, "Polygon", F.array(_coordinates(F.col("ring")))))
    about = F.struct(F.lit("platform").alias("kind"), "station", "line", metro_colour(F.col("line")).alias("color"), F.lit(-1).alias("level"), F.concat(F.lit("dir. "), "terminus").alias("name"))
    drawn = strips.filter("ring IS NOT NULL").join(by_rel, "rel_id")
    second = drawn.select(layer("platform"), "station", "rel_id", "seq", none(exit_type, "exit_id"), _feature(about, "Polygon", F.array(_coordinates(F.col("ring")))))
    about = F.struct(F.lit("exit").alias("kind"), "station", "name")
    third = exits.select(layer("exit"), "station", none(rel_type, "rel_id"), none(seq_type, "seq"), "exit_id", _feature(about, "Point", F.array(*from_metres(F.col("x"), F.col("y")))))
    return first.unionByName(second).unionByName(third)


def of_extract(elements: DataFrame) -> DataFrame:
    """Station features of a map extract's elements."""
    metres = lambda df: df.withColumns(dict(zip("xy", to_metres(F.col("lon"), F.col("lat")))))
    members = extract.metro_stops(elements)
    stops = members.join(metres(extract.stop_nodes(elements, members)).select("node_id", "name", "x", "y"), "node_id", "left")
    refs = extract.track_ways(elements).select(F.col("way_id").alias("track"), F.posexplode("refs").alias("pos", "node_id"))
    tracks = refs.join(metres(extract.nodes(elements)).select("node_id", "x", "y"), "node_id").select("track", "pos", "x", "y")
    entrances = metres(extract.entrances(elements)).select(F.col("node_id").alias("exit_id"), "name", "x", "y")
    return features(stops, tracks, entrances)
