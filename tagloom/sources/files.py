"""File sources and sinks (S3-S12) on Spark's readers and writers.

File-per-record inputs are read with one reader call over a folder or glob;
the file name comes from the hidden ``_metadata`` column, never from a
driver-side listing loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# S3 ---------------------------------------------------------------------------

def read_docs_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV documents with quoted multi-line fields and a header."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def write_docs_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


FILES_A_TASK = 1000
#: bytes that a small file counts as where files are dealt to tasks
OPEN_COST = 1 << 16


# S4 ---------------------------------------------------------------------------

def read_text_by_id(spark: SparkSession, path_glob: str, id_col: str = "dataset_id",
                    text: str = "prompt_description", name_pattern: str = r"dataset_(\d+)\.txt$") -> DataFrame:
    """One whole text per file; the id is parsed from the file name."""
    df = spark.read.text(path_glob, wholetext=True)
    return df.select(
        F.regexp_extract(F.col("_metadata.file_name"), name_pattern, 1).cast("bigint").alias(id_col),
        F.col("value").alias(text))


def write_text_by_id(df: DataFrame, path: str, id_col: str = "dataset_id",
                     text: str = "prompt_description") -> None:
    """Write one file per text in a folder named by its id (Spark's layout).

    Ids are unique (rows of a repeated id still get a file each); a null text is
    written as an empty one. Texts are dealt by id, about ``FILES_A_TASK`` to a
    task: a task's time goes by its files. Tasks move their own files into
    place, or the driver would have to move all of them one after the other."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.select(id_col).count() // FILES_A_TASK))
    df.select(F.col(id_col), F.col(text).alias("value")).repartition(tasks, id_col) \
      .write.mode("overwrite").option("maxRecordsPerFile", 1) \
      .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(id_col).text(path)


def read_text_partitioned(spark: SparkSession, path: str, id_col: str = "dataset_id",
                          text: str = "prompt_description") -> DataFrame:
    """Read the files of ``write_text_by_id``: whole texts, without the line
    break that ends each file. Files and folders are small and many: with the
    usual settings each folder is listed by a task of its own and a few files
    (of 4 MB each, as ``spark.sql.files.openCostInBytes`` counts them) make a
    task, so this read has a session of its own with others."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(8 * spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))
    df = own.read.text(path, wholetext=True)
    return df.select(F.col(id_col).cast("bigint").alias(id_col),
                     F.regexp_replace("value", r"\n\z", "").alias(text))


# S5 ---------------------------------------------------------------------------

def read_items(spark: SparkSession, path: str, schema: str | T.StructType,
               multi_line: bool = True) -> DataFrame:
    """JSON records (scraped items, URL lists) with a declared schema."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


# S6 ---------------------------------------------------------------------------

def route_by_domain(df: DataFrame, url: str, sites: dict[str, str]) -> DataFrame:
    """Add ``site``: the first site (in the given order) whose substring the
    URL contains; null when none."""
    site = F.lit(None).cast("string")
    for name, sub in reversed(list(sites.items())):
        site = F.when(F.col(url).contains(sub), F.lit(name)).otherwise(site)
    return df.withColumn("site", site)


def write_by_site(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per site; readers prune partitions with a site filter."""
    df.filter(F.col("site").isNotNull()).write.mode("overwrite").partitionBy("site").format(fmt).save(path)


# S7 ---------------------------------------------------------------------------

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("topic", T.StructType([
        T.StructField("themes", T.ArrayType(T.StringType())),
        T.StructField("overarching_themes", T.ArrayType(T.StringType())),
    ])),
    # values kept as strings: a value may be a number or a nested object
    T.StructField("texts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
])


def parse_payload(text) -> "F.Column":
    """Parse a topic payload JSON string; malformed -> null struct."""
    t = F.col(text) if isinstance(text, str) else text
    return F.from_json(t, PAYLOAD_SCHEMA, {"mode": "PERMISSIVE"})


def read_topic_payloads(spark: SparkSession, folder: str, pattern: str = r"(-?\d+)\.json$") -> tuple[DataFrame, DataFrame]:
    """One JSON file per topic -> (ok, corrupt).

    ok: (topic_id, payload struct); corrupt: (topic_id, raw). A file is
    corrupt when it does not parse as a JSON object.
    """
    raw = (spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
                .select(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("int").alias("topic_id"),
                        F.col("value").alias("raw")))
    parsed = raw.withColumn("payload", parse_payload("raw"))
    ok_cond = F.col("payload").isNotNull() & F.col("payload.texts").isNotNull()
    return (parsed.filter(ok_cond).select("topic_id", "payload"),
            parsed.filter(~ok_cond).select("topic_id", "raw"))


# S8 ---------------------------------------------------------------------------

def nest_tags(tags: DataFrame, id_col: str = "dataset_id") -> DataFrame:
    """(id, kind, tag, score) -> (id, json) with
    {"themes": {tag: score}, "overarching_themes": {...}} per id.

    Grouping is per document; a document's tags are bounded by its topics.
    """
    per_kind = (tags.groupBy(id_col, "kind")
                    .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "score")))).alias("m")))
    nested = per_kind.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("kinds"))
    empty = F.create_map().cast("map<string,double>")
    return nested.select(id_col, F.to_json(F.struct(
        F.coalesce(F.col("kinds")["themes"], empty).alias("themes"),
        F.coalesce(F.col("kinds")["overarching_themes"], empty).alias("overarching_themes"))).alias("json"))


def write_tags(tags: DataFrame, path: str, id_col: str = "dataset_id") -> None:
    """Long parquet is the primary sink; the nested JSON sink is derived."""
    tags.write.mode("overwrite").parquet(path + "/long")
    nest_tags(tags, id_col).write.mode("overwrite").json(path + "/nested")


# S9 ---------------------------------------------------------------------------

RUN_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("Dataset", T.StringType()),
    T.StructField("Dataset Size", T.LongType()),
    T.StructField("Model", T.StringType()),
    T.StructField("Params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("Scores", T.StringType()),
    T.StructField("Computation Time", T.DoubleType()),
]))


def write_runs(df: DataFrame, path: str, file: str = "file", order: str = "pos") -> None:
    """One array of run records per value of ``file``, in the order of
    ``order``, in a folder named ``file=<value>``. Values end in ``.json``; a
    file's records form one row, so the caller bounds them. Fields of
    ``RUN_SCHEMA`` that ``df`` lacks are left out."""
    rec = F.struct(*[F.col(f"`{f.name}`") for f in RUN_SCHEMA.elementType if f.name in df.columns])
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(rec).alias("r"))))
    arrays = df.groupBy(F.col(file).alias("file")).agg(in_order.alias("rs"))
    arrays.select("file", F.concat(F.lit("["), F.array_join("rs.r", ","), F.lit("]")).alias("value")) \
          .write.mode("overwrite").partitionBy("file").text(path)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.json in the folder whose name lacks 'metadata', or every folder
    that ``write_runs`` wrote; each holds one array of run records.
    file_index = dense rank of the file name."""
    raw = spark.read.option("pathGlobFilter", "*.{json,txt}").text(folder, wholetext=True)
    name = F.col("file").cast("string") if "file" in raw.columns else F.col("_metadata.file_name")
    raw = (raw.select(name.alias("file"), F.col("value").alias("raw"))
              .filter(F.col("file").endswith(".json") & ~F.col("file").contains("metadata")))
    runs = raw.select("file", F.posexplode(F.from_json("raw", RUN_SCHEMA)).alias("pos", "r"))
    # one row per file: the ordering window is bounded by the file count
    idx = raw.select("file").distinct().withColumn("file_index", F.row_number().over(Window.orderBy("file")) - 1)
    return runs.join(idx, "file").select("file", "file_index", "pos", "r.*")


# S10 --------------------------------------------------------------------------

def append_records(df: DataFrame, path: str) -> None:
    """Append records as line-delimited JSON (no read-modify-write)."""
    df.write.mode("append").json(path)


# S11 --------------------------------------------------------------------------

def write_timings(df: DataFrame, path: str) -> None:
    """Timing CSVs in one folder per ``Model``."""
    df.write.mode("overwrite").partitionBy("Model").option("header", True).csv(path)


def read_timings(spark: SparkSession, folder: str) -> DataFrame:
    """All timing CSVs unioned; the model name is the file stem, or that of the
    folder that ``write_timings`` made."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(folder)
    if "Model" in df.columns:
        return df.withColumn("Model", F.col("Model").cast("string"))
    return df.withColumn("Model", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))


# S12 --------------------------------------------------------------------------

def save_corpus(df: DataFrame, path: str, text: str = "text") -> None:
    """One document per line."""
    df.select(F.replace(F.col(text), F.lit("\n"), F.lit(" ")).alias("value")).write.mode("overwrite").text(path)
