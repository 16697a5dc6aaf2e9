"""Readers: each returns a DataFrame and leaves the parsing to Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred only where no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_strict(spark: SparkSession, paths: list[str], n_cols: int) -> DataFrame:
    """Rows with exactly ``n_cols`` unquoted comma-separated fields, without each file's header, as array ``fields``."""
    names = [f"c{i}" for i in range(n_cols)]
    reader = spark.read.options(header=True, quote="", mode="DROPMALFORMED").schema(", ".join(f"{c} string" for c in names))
    return reader.csv(paths).select(F.array(*[F.coalesce(c, F.lit("")) for c in names]).alias("fields"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything, on the file system that Spark takes for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of lines of JSON, blank ones skipped; a missing file has no rows.

    Without a schema Spark infers one by a scan of its own; a missing file then has no columns either.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema or "struct<>")
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_doc(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Rows of a document's top-level array."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def read_logs(spark: SparkSession, path: str, number: str = r"-(\d+)\.txt") -> DataFrame:
    """Log lines with their file and the number in its name; null where it has none."""
    file = F.col("_metadata.file_path")
    return spark.read.text(path).select("value", file.alias("file"), F.regexp_extract(file, number, 1).try_cast("int").alias("rep"))


def read_blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with their content, subfolders included; Spark's reader leaves out files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` of lines with two integers; comments, short lines and loops are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(F.get(parts, F.lit(0)).try_cast("bigint").alias("src"), F.get(parts, F.lit(1)).try_cast("bigint").alias("dst")).where("src is not null and dst is not null and src <> dst")


def parse_sse(lines: DataFrame, schema: str) -> DataFrame:
    """Events of a server-sent feed; lines that are no data or no JSON are skipped."""
    data = lines.where(F.col("value").startswith("data: ")).select(F.from_json(F.substring("value", 7, 1 << 30), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("d"))
    return data.where("d is not null").select("d.*").dropna(how="all")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Headerless, possibly compressed CSV with one column, as ``word``."""
    return spark.read.csv(path).withColumnRenamed("_c0", "word")


# Column names of the four vendor layouts (pickup, dropoff, zones, distance, fare).
LAYOUTS = {
    "fhvhv": ("pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID", "trip_miles", "base_passenger_fare"),
    "yellow": ("tpep_pickup_datetime", "tpep_dropoff_datetime", "PULocationID", "DOLocationID", "trip_distance", "fare_amount"),
    "green": ("lpep_pickup_datetime", "lpep_dropoff_datetime", "PULocationID", "DOLocationID", "trip_distance", "fare_amount"),
    "fhv": ("pickup_datetime", "dropOff_datetime", "PUlocationID", "DOlocationID", None, None),
}


def infer_layout(path: str) -> str | None:
    """The layout that a file's name begins with; longer names first, so ``fhvhv`` is no ``fhv``."""
    name = path.rsplit("/", 1)[-1].lower()
    return next((k for k in sorted(LAYOUTS, key=len, reverse=True) if name.startswith(k)), None)


def to_canonical(df: DataFrame, layout: str) -> DataFrame:
    """Trips in one schema; a column that the layout or the file lacks is null."""
    names = [("pickup_datetime", "timestamp"), ("dropoff_datetime", "timestamp"), ("pu_location_id", "bigint"), ("do_location_id", "bigint"), ("trip_distance", "double"), ("fare_amount", "double")]
    cells = [(F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(n) for (n, kind), c in zip(names, LAYOUTS[layout], strict=True)]
    out = df.select(F.lit(layout).alias("service_type"), *cells)
    return out.withColumn("trip_duration_s", F.unix_timestamp("dropoff_datetime") - F.unix_timestamp("pickup_datetime"))


def label_from_name(path, prefixes: dict[str, str], default: str | None = None):
    """The label of the first prefix that a path's file name begins with, without regard to case."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(default)
    for prefix, label in reversed(prefixes.items()):
        out = F.when(name.startswith(prefix.lower()), label).otherwise(out)
    return out


def read_graphml(spark: SparkSession, path: str, max_keys: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Vertices ``ext, lat, lon`` and edges ``src, dst, length_m, travel_time_s`` of a GraphML file.

    Keys are named by their ``attr.name``. Edges without both ends or with no positive length are dropped;
    travel time defaults to the length. Ids stay the file's own strings: ``operators.graph.global_rank`` makes
    dense ones and ``operators.reports.remap_ids`` carries them over.
    """
    tag = lambda t, schema: spark.read.format("xml").option("rowTag", t).schema(schema).load(path)
    found = tag("key", "_id string, `_attr.name` string").limit(max_keys + 1).collect()
    if len(found) > max_keys:
        raise ValueError(f"more than {max_keys} keys")
    cells = "data array<struct<_VALUE: string, _key: string>>"

    def value(name: str):
        ids = [k for k, n in found if n == name] or [name]
        return F.get(F.filter("data", lambda x: x["_key"].isin(ids)), F.lit(0))["_VALUE"].try_cast("double")

    v = tag("node", f"_id string, {cells}").select(F.col("_id").alias("ext"), value("y").alias("lat"), value("x").alias("lon"))
    e = tag("edge", f"_source string, _target string, {cells}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("length").alias("length_m"), value("travel_time").alias("t"))
    ends = v.select("ext")
    e = e.where("length_m > 0").join(ends.withColumnRenamed("ext", "src"), "src", "left_semi").join(ends.withColumnRenamed("ext", "dst"), "dst", "left_semi")
    return v, e.select("src", "dst", "length_m", F.coalesce("t", "length_m").alias("travel_time_s"))


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket, as a stream."""
    return spark.readStream.format("socket").options(host=host, port=port).load()


def read_kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A topic's rows, as a stream (see ``kafka_options``); needs Spark's Kafka package."""
    return spark.readStream.format("kafka").options(**options).load()


def kafka_options(servers: str, topic: str, starting: str = "latest", per_trigger: int | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}
    return out | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def s3a_conf(endpoint: str, key: str, secret: str) -> dict[str, str]:
    at = "spark.hadoop.fs.s3a."
    return {f"{at}endpoint": endpoint, f"{at}access.key": key, f"{at}secret.key": secret, f"{at}path.style.access": "true"}
