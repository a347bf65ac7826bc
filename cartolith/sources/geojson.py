"""GeoJSON collections and other small files: strict readers, readers that forgive, and staged writers."""

from __future__ import annotations

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions.geometry import RING
from cartolith.operators.ranking import numbered
from cartolith.session import written

#: A feature as read: properties and coordinates stay JSON until a caller names their types.
FEATURE = "struct<type:string,id:string,properties:string,geometry:struct<type:string,coordinates:string>>"
COLLECTION = f"type string, features array<{FEATURE}>"


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON file of settings, one object; settings that it leaves out have their defaults, in nested objects too."""
    import json

    found = json.loads(spark.read.text(path, wholetext=True).first()[0])

    def filled(have: dict, want: dict) -> dict:
        return {**want, **{k: filled(v, want[k]) if isinstance(v, dict) and isinstance(want.get(k), dict) else v for k, v in have.items()}}

    return filled(found, defaults)


def base_datasets(spark: SparkSession, paths: dict[str, str], debug: tuple[str, ...], with_debug: bool) -> dict[str, DataFrame]:
    """The features of each dataset; those for debugging are empty, and not read, unless they are asked for."""
    return {name: read_features(spark, path) if with_debug or name not in debug else spark.createDataFrame([], "ord int, id string, type string, properties string, coordinates string") for name, path in paths.items()}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_features(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """(ord, id, type, properties, coordinates) of a collection's features, properties and coordinates as JSON.

    A feature without an id of its own has that of its properties.
    Fails where the file isn't a FeatureCollection; a missing file is an empty collection if missing_ok is set.
    """
    schema = "ord int, id string, type string, properties string, coordinates string"
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    good = F.coalesce((F.col("type") == "FeatureCollection") & F.col("features").isNotNull(), F.lit(False))
    found = F.when(good, F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")))
    own = F.get_json_object("f.properties", "$.id")
    return raw.select(F.posexplode(found).alias("ord", "f")).select("ord", F.coalesce(F.col("f.id"), own).alias("id"), F.col("f.geometry.type").alias("type"), F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("coordinates"))


def properties(features: DataFrame, schema: str) -> DataFrame:
    """features with their properties as columns of the schema."""
    return features.withColumn("p", F.from_json("properties", schema)).select("*", "p.*").drop("p", "properties")


def points(features: DataFrame) -> DataFrame:
    """features with x and y of point coordinates."""
    at = F.from_json("coordinates", "array<double>")
    return features.withColumns({"x": F.get(at, F.lit(0)), "y": F.get(at, F.lit(1))}).drop("coordinates")


def shapes(features: DataFrame) -> DataFrame:
    """features with the shape of Polygon and MultiPolygon coordinates."""
    polygon = F.from_json("coordinates", "array<array<array<double>>>")
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    both = F.when(F.col("type") == "Polygon", F.array(polygon)).when(F.col("type") == "MultiPolygon", multi)
    struct = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    shape = F.transform(both, lambda poly: F.transform(poly, lambda ring: F.transform(ring, struct)))
    return features.withColumn("shape", shape.cast(f"array<array<{RING}>>")).drop("coordinates")


def read_geometries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, properties, geometry) of a collection's features with geometries of any kind, as JSON."""
    feature = "struct<type:string,id:string,properties:string,geometry:string>"
    raw = spark.read.schema(f"type string, features array<{feature}>").option("multiLine", True).json(path)
    good = F.coalesce((F.col("type") == "FeatureCollection") & F.col("features").isNotNull(), F.lit(False))
    found = F.when(good, F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")))
    own = F.get_json_object("f.properties", "$.id")
    return raw.select(F.posexplode(found).alias("ord", "f")).select("ord", F.coalesce(F.col("f.id"), own).alias("id"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


def flattened(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """rows once for each simple geometry of theirs: `place` (its places in collections, from outside in), type and coordinates.

    A GeometryCollection may hold others, to any depth; each round takes one level off those that are left. Null
    geometries, such without a type, empty collections and what isn't JSON give no rows.
    """
    names = [c for c in rows.columns if c != geometry]
    now = rows.select(*names, F.array().cast("array<int>").alias("place"), F.try_parse_json(geometry).alias("g"))
    out = None
    while True:
        kind = F.try_variant_get("g", "$.type", "string")
        now = written(now.withColumn("type", kind).where(F.col("type").isNotNull()), "geometries")
        flat = now.where(F.col("type") != "GeometryCollection").select(*names, "place", "type", F.to_json(F.try_variant_get("g", "$.coordinates", "variant")).alias("coordinates"))
        out = flat if out is None else out.unionByName(flat)
        held = now.where(F.col("type") == "GeometryCollection")
        if held.isEmpty():
            return out
        inner = F.posexplode(F.try_variant_get("g", "$.geometries", "array<variant>")).alias("i", "h")
        now = held.select(*names, "place", inner).select(*names, F.concat("place", F.array("i")).alias("place"), F.col("h").alias("g"))


def polygonal(rows: DataFrame, key: list[str], geometry: str = "geometry") -> DataFrame:
    """(key, shape): all polygons of each row's geometry, however deep in collections, in their order; points and lines are dropped.

    Rows without polygons have an empty shape; a row is told from others by its key.
    """
    parts = shapes(flattened(rows.select(*key, geometry), geometry).where(F.col("type").isin("Polygon", "MultiPolygon")))
    whole = parts.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "shape"))), lambda s: s["shape"])).alias("shape"))
    none = F.array().cast(f"array<array<{RING}>>")
    return rows.select(*key).distinct().join(whole, key, "left").select(*key, F.coalesce("shape", none).alias("shape"))


def _numbers(p: Column) -> Column:
    return F.array(p["x"], p["y"])


def geometry_json(kind: str, value: Column) -> Column:
    """A geometry as JSON: kind is Point (a struct), LineString (a ring) or Shape (an array of polygons)."""
    if kind == "Point":
        return F.to_json(F.struct(F.lit("Point").alias("type"), _numbers(value).alias("coordinates")))
    if kind == "LineString":
        return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(value, _numbers).alias("coordinates")))
    rings = F.transform(value, lambda poly: F.transform(poly, lambda ring: F.transform(ring, _numbers)))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(rings, F.lit(0)).alias("coordinates")))
    return F.when(F.size(rings) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates"))))


def feature_lines(rows: DataFrame, geometry: Column, keep: list[str]) -> DataFrame:
    """(value): each row as a GeoJSON feature; null properties are left out. rows: id and what keep names."""
    head = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2))
    return rows.select(F.concat(head, F.lit(',"properties":'), F.to_json(F.struct("id", *keep)), F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))


def write_collection(lines: DataFrame, path: str) -> None:
    """Writes one GeoJSON file of any size, features in the order of their text; a null line is left out.

    Tasks write ranges of lines as parts, which are then joined; no row, task or driver holds more than a part. The file
    appears under its name only when it is whole.
    """
    placed = numbered(lines.where(F.col("value").isNotNull()).select("value"), ["value"], "n")
    last = F.lit((1 << 63) - 1)
    ends = lines.sparkSession.createDataFrame([(True,), (False,)], "first boolean")
    frame = ends.select(F.when(F.col("first"), '{"type":"FeatureCollection","features":[').otherwise("]}").alias("value"), F.when(F.col("first"), 0).otherwise(last).alias("n"))
    rows = placed.select(F.when(F.col("n") > 1, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"), "n").unionByName(frame)
    stage = f"{path}.parts"
    rows.repartitionByRange("n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(stage)
    join_parts(lines.sparkSession, stage, path)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """Makes one file of a folder's parts, by name, and deletes the folder: by the file system itself where it can put
    files together, else by copying through a buffer."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    target, stage, source = fs_path(path), fs_path(f"{path}.staged"), fs_path(folder)
    fs = target.getFileSystem(conf)
    parts = sorted((f.getPath() for f in fs.globStatus(fs_path(f"{folder}/part-*"))), key=lambda p: p.getName())
    parts = [p for p in parts if fs.getFileStatus(p).getLen()]
    fs.delete(stage, True)
    fs.create(stage).close()
    try:
        array = spark.sparkContext._gateway.new_array(fs_path, len(parts))
        for i, p in enumerate(parts):
            array[i] = p
        fs.concat(stage, array)
    except UnsupportedOperationException:
        out = fs.create(stage, True)
        for p in parts:
            part = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.close()
    fs.delete(target, True)
    if not fs.rename(stage, target):
        raise OSError(f"could not move {folder} to {path}")
    fs.delete(source, True)


def replace_text(rows: DataFrame, path: str, spark: SparkSession) -> None:
    """Writes rows (value) as one text file: staged beside its place, then renamed."""
    stage = f"{path}.staged"
    rows.coalesce(1).write.mode("overwrite").text(stage)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(stage)
    fs = target.getFileSystem(conf)
    part = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{stage}/part-*"))[0].getPath()
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"could not move {stage} to {path}")
    fs.delete(folder, True)


def write_state(state: dict[str, DataFrame], folder: str, twins: dict[str, str] | None = None) -> list[str]:
    """Writes each collection that is there as Parquet, and again under its twin's name; returns what was written."""
    done = []
    for name, rows in state.items():
        for target in [name, *([twins[name]] if twins and name in twins else [])]:
            rows.write.mode("overwrite").parquet(f"{folder}/{target}")
            done.append(target)
    return done


def read_state(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The collections of a folder; one that is missing is empty."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") if exists(spark, f"{folder}/{name}") else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def write_ids(rows: DataFrame, path: str, key: str = "id") -> None:
    """One id a line, sorted, as a folder of text parts."""
    rows.select(F.col(key).cast("string").alias("value")).repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def preference(stored: Column, allowed: list[str], default: str) -> Column:
    return F.when(stored.isin(*allowed), stored).otherwise(default)


def rankings(spark: SparkSession, tables: dict[str, list[tuple[str, str | None]]]) -> DataFrame:
    """(ranking, rank, country, value) of inline tables; ranks follow the order of rows."""
    rows = [(name, [{"country": c, "value": v} for c, v in entries]) for name, entries in tables.items()]
    nested = spark.createDataFrame(rows, "ranking string, entries array<struct<country:string,value:string>>")
    return nested.select("ranking", F.posexplode("entries").alias("i", "e")).select("ranking", (F.col("i") + 1).alias("rank"), "e.country", "e.value")
