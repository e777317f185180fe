"""File sources: manifests, boxes, line networks, tile graphs. All read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Collections within collections that are taken apart; deeper ones are an error.
NESTED = 4
TILE = "struct<tile_id:string,id:string,image_path:string,bbox:array<double>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """tile_id, image_path, minx, miny, maxx, maxy, pos from a JSON list, {"tiles": [...]}, or CSV.

    In CSV the id is tile_id or else id. Other endings are an error.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "json":
        raw = spark.read.text(path, wholetext=True)
        listed = F.from_json(F.when(F.col("value").rlike(r"^\s*\{"), F.get_json_object("value", "$.tiles")).otherwise(F.col("value")), f"array<{TILE}>")
        rows = raw.select(F.posexplode(listed).alias("pos", "t")).select("pos", "t.*")
        box = lambda i: F.get("bbox", F.lit(i))
        return rows.select(F.coalesce("tile_id", "id").alias("tile_id"), "image_path", *[box(i).alias(n) for i, n in enumerate(("minx", "miny", "maxx", "maxy"))], "pos")
    if kind == "csv":
        rows = spark.read.csv(path, header=True)
        id_ = F.coalesce(*[F.col(c) for c in ("tile_id", "id") if c in rows.columns])
        return rows.select(id_.alias("tile_id"), "image_path", *[F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")], F.monotonically_increasing_id().alias("pos"))
    raise ValueError(f"not a manifest: {path}")


def invalid_records(rows: DataFrame) -> DataFrame:
    """tile_id and reason of records that lack a key or a whole, ordered box."""
    reason = (
        F.when(F.col("tile_id").isNull(), "tile_id")
        .when(F.col("image_path").isNull(), "image_path")
        .when(F.col("minx").isNull() | F.col("miny").isNull() | F.col("maxx").isNull() | F.col("maxy").isNull(), "bbox")
        .when((F.col("minx") >= F.col("maxx")) | (F.col("miny") >= F.col("maxy")), "order")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("tile_id", "reason")


def boxes_from_json(text: Column) -> Column:
    """array<struct<south,west,north,east>> of a JSON list of four-number lists."""
    return F.transform(F.from_json(text, "array<array<double>>"), lambda b: F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("south", "west", "north", "east"))]))


def manifest_from_boxes(boxes: DataFrame, pattern: str, start: int = 0, existing: DataFrame | None = None) -> DataFrame:
    """A manifest from boxes (i, south, west, north, east): axis order turned, names from ``pattern``.

    ``existing`` (column image_path): rows without a file go.
    """
    rows = boxes.select(
        F.format_string("tile_%05d", "i").alias("tile_id"),
        F.format_string(pattern, F.col("i") + start).alias("image_path"),
        F.col("west").alias("minx"),
        F.col("south").alias("miny"),
        F.col("east").alias("maxx"),
        F.col("north").alias("maxy"),
    )
    return rows if existing is None else rows.join(existing.select("image_path"), "image_path", "left_semi").select(*rows.columns)


def parse_box(text: str) -> tuple[float, float, float, float]:
    """``south,west,north,east`` with the order checked (on the driver, for options)."""
    try:
        south, west, north, east = (float(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"four numbers are needed: {text!r}") from None
    if not (south < north and west < east):
        raise ValueError(f"a box has south < north and west < east: {text!r}")
    return south, west, north, east


def select_records(rows: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Records of the given ids, the first ``limit`` by pos."""
    some = rows.where(F.col("tile_id").isin(ids)) if ids else rows
    return some.orderBy("pos").limit(limit) if limit else some


def geojson_lines(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(fid, part, seq, x, y) of GeoJSON geometry texts: LineString and MultiLineString, collections taken apart.

    ``features`` has fid and the geometry as JSON. Lines of under two points go, and third coordinates.
    """
    rest, plain = features.select("fid", F.col(geometry).alias("g")), None
    for _ in range(NESTED + 1):  # a plan, not a loop over data: each level takes one layer of collections apart
        kind = F.get_json_object("g", "$.type")
        flat = rest.where(kind != "GeometryCollection")
        plain = flat if plain is None else plain.unionByName(flat)
        rest = rest.where(kind == "GeometryCollection").select("fid", F.explode(F.from_json(F.get_json_object("g", "$.geometries"), "array<string>")).alias("g"))
    too_deep = F.raise_error(F.lit(f"collections nested over {NESTED} deep")).cast("string")
    flat = plain.unionByName(rest.select("fid", F.when(F.get_json_object("g", "$.type") == "GeometryCollection", too_deep).otherwise(F.col("g")).alias("g")))
    kind, coords = F.get_json_object("g", "$.type"), F.get_json_object("g", "$.coordinates")
    one = F.array(F.from_json(coords, "array<array<double>>"))
    lines = F.when(kind == "LineString", one).when(kind == "MultiLineString", F.from_json(coords, "array<array<array<double>>>"))
    parts = flat.withColumn("ls", lines).where("ls IS NOT NULL").select("fid", F.posexplode("ls").alias("part", "l")).where(F.size("l") >= 2)
    return parts.select("fid", "part", F.posexplode("l").alias("seq", "p")).select("fid", "part", "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """(fid, part, seq, x, y, epsg) of a line network: GeoJSON, or graph JSON (one line an edge).

    epsg is the legacy crs member's, else 4326 where all coordinates lie within degrees,
    else null. Longitude (or x) comes first; graph JSON has latitude first.
    """
    doc = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    graph = doc.where(F.col("value").rlike(r"^\s*\["))
    nodes, edges = graph_json(graph.select(F.lit(0).alias("gid"), F.col("value").alias("doc")))
    numbered = edges.select("u", "v", F.xxhash64("u", "v").alias("fid"))
    ends = numbered.select("fid", F.posexplode(F.array("u", "v")).alias("seq", "id")).join(nodes.select("id", "lat", "lon"), "id")
    lines = ends.select("fid", F.lit(0).alias("part"), "seq", F.col("lon").alias("x"), F.col("lat").alias("y"))
    other = doc.where(~F.col("value").rlike(r"^\s*\["))
    feats = F.coalesce(F.from_json(F.get_json_object("value", "$.features"), "array<string>"), F.array("value"))
    shapes = other.select(F.posexplode(feats).alias("fid", "f"), geojson_crs(F.col("value")).alias("crs"))
    shaped = geojson_lines(shapes.select(F.col("fid").cast("long").alias("fid"), F.coalesce(F.get_json_object("f", "$.geometry"), F.col("f")).alias("geometry")))
    every = shaped.unionByName(lines)
    said = shapes.agg(F.max("crs").alias("said"))
    return every.crossJoin(F.broadcast(sniff_crs(every))).crossJoin(F.broadcast(said)).select("fid", "part", "seq", "x", "y", F.coalesce("said", "epsg").alias("epsg"))


def geojson_crs(doc: Column) -> Column:
    """EPSG number of a legacy crs member, else null."""
    return F.nullif(F.regexp_extract(F.get_json_object(doc, "$.crs.properties.name"), r"(\d+)$", 1), F.lit("")).cast("int")


def sniff_crs(points: DataFrame) -> DataFrame:
    """One row, epsg: 4326 if all coordinates lie within degrees, else null (the caller must be told)."""
    inside = (F.min("x") >= -180) & (F.max("x") <= 180) & (F.min("y") >= -90) & (F.max("y") <= 90)
    return points.agg(F.when(inside, 4326).alias("epsg"))


def graph_json(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (gid, id, lat, lon, key) and edges (gid, u, v) of texts (gid, doc): [nodes, edges] in JSON.

    key: the place to seven decimals, by which equal places are told.
    """
    doc = F.from_json("doc", "array<string>")
    nodes = text.select("gid", F.posexplode(F.from_json(F.get(doc, F.lit(0)), "array<array<double>>")).alias("id", "p"))
    edges = text.select("gid", F.explode(F.from_json(F.get(doc, F.lit(1)), "array<array<bigint>>")).alias("e"))
    lat, lon = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return nodes.select("gid", F.col("id").cast("long").alias("id"), lat.alias("lat"), lon.alias("lon"), F.format_string("%.7f_%.7f", lat, lon).alias("key")), edges.select("gid", F.get("e", F.lit(0)).alias("u"), F.get("e", F.lit(1)).alias("v"))


def pixel_key(text: Column) -> Column:
    """struct<r, c> of "(r, c)", "[r, c]" or "r,c"."""
    at = lambda i: F.regexp_extract(text, r"(-?\d+)\s*,\s*(-?\d+)", i).cast("long")
    return F.struct(at(1).alias("r"), at(2).alias("c"))


def natural_key(name: Column) -> Column:
    """The number before the ending, for sorting file names."""
    return F.try_cast(F.nullif(F.regexp_extract(name, r"(\d+)\.[A-Za-z]+$", 1), F.lit("")), "bigint") if hasattr(F, "try_cast") else F.nullif(F.regexp_extract(name, r"(\d+)\.[A-Za-z]+$", 1), F.lit("")).cast("long")


def expand_ids(spec: DataFrame) -> DataFrame:
    """Tile numbers of specs (column spec): a number, or lo-hi in either order, both ends in."""
    lo, hi = (F.nullif(F.regexp_extract("spec", r"^\s*(\d+)(?:\s*-\s*(\d+))?\s*$", i), F.lit("")).cast("long") for i in (1, 2))
    hi = F.coalesce(hi, lo)
    return spec.where(lo.isNotNull()).select(F.explode(F.sequence(F.least(lo, hi), F.greatest(lo, hi))).alias("tile")).distinct()


def tile_edges(raw: DataFrame) -> DataFrame:
    """Edges of saved tiles of any age: score from edge_score or else edge_prob, synthetic false if missing.

    bad: why a tile must be made anew (no score, or no type where there are edges).
    """
    has = lambda c, kind: F.col(c) if c in raw.columns else F.lit(None).cast(kind)
    score = F.coalesce(has("edge_score", "double"), has("edge_prob", "double"))
    synthetic = F.coalesce(has("synthetic", "boolean"), F.lit(False))
    bad = F.when(~synthetic & score.isNull(), "score").when(has("edge_type", "int").isNull(), "type")
    return raw.select("tile_id", "u", "v", score.alias("score"), has("edge_type", "int").alias("edge_type"), synthetic.alias("synthetic"), bad.alias("bad"))


def latest(files: DataFrame) -> DataFrame:
    """(dir, path): the file of greatest time in each dir; ties to the greatest path."""
    return files.groupBy("dir").agg(F.max(F.struct("time", "path")).alias("m")).select("dir", F.col("m.path").alias("path"))


def walkways(ways: DataFrame) -> DataFrame:
    """Ways (id, tags as a map, geometry) that pass one of three tag filters; one of equal geometries."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    has = lambda k, word: F.coalesce(t(k).contains(word), F.lit(False))
    sidewalk = has("highway", "footway") & has("footway", "sidewalk")
    designated = has("foot", "designated")
    not_crossing = F.coalesce(t("highway") == "footway", F.lit(False)) & ~has("footway", "crossing")
    return ways.where((sidewalk | designated | not_crossing) & F.col("geometry").isNotNull()).dropDuplicates(["geometry"])


def box_option(text: Column, order: str) -> Column:
    """struct<west, south, east, north> of four numbers parted by commas, in the order "swne" or "wsen"; null if they are no box."""
    names = {"swne": ("south", "west", "north", "east"), "wsen": ("west", "south", "east", "north")}[order]
    number = F.transform(F.split(text, ","), lambda x: F.nullif(F.regexp_extract(F.trim(x), r"^[+-]?[0-9]+(?:\.[0-9]*)?$", 0), F.lit("")).cast("double"))
    at = {n: F.get(number, F.lit(i)) for i, n in enumerate(names)}
    good = (F.size(number) == 4) & (at["south"] < at["north"]) & (at["west"] < at["east"])
    return F.when(good, F.struct(*[at[n].alias(n) for n in ("west", "south", "east", "north")]))


def union_networks(parts: list[DataFrame]) -> DataFrame:
    """(line, seq, x, y) in mercator metres of line networks in degrees (line, seq, x, y); empty ones add nothing."""
    from functools import reduce

    from waygraph.functions import geo

    every = reduce(DataFrame.unionByName, parts)
    x, y = geo.mercator(F.col("x"), F.col("y"))
    return every.where("x IS NOT NULL AND y IS NOT NULL").select("line", "seq", x.alias("x"), y.alias("y"))


def checked_crs(points: DataFrame) -> DataFrame:
    """``sniff_crs``, but an error where the coordinates are no degrees."""
    return sniff_crs(points).select(F.coalesce("epsg", F.raise_error(F.lit("coordinates are not degrees, and no system is named")).cast("int")).alias("epsg"))
