"""Readers and sinks: JSON lines, Parquet, whole files; manifests, split files, resumable output."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grainmill.functions.hashing import hashed_order
from grainmill.plans.workspace import Workspace


@dataclass(frozen=True)
class Source:
    """Where a dataset lies and what it is."""

    name: str
    path: str
    format: str = "parquet"
    family: str = "general"
    language: str = "en"
    license: str = "unknown"
    restricted: bool = False
    where: dict[str, list[object]] = field(default_factory=dict)
    limit: int | None = None
    oversample: int = 1


def read_source(spark: SparkSession, source: Source, schema: StructType | str | None = None, seed: int = 0, id_col: str | None = None) -> DataFrame:
    """Rows of a source: membership filters reach the scan; a limit takes a hashed sample of limit x oversample rows.

    A transform that drops rows may leave more than the limit; ``load_all`` applies it again.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format("json" if source.format in ("jsonl", "jsonl.gz") else source.format).load(source.path)
    for column, allowed in source.where.items():
        df = df.where(F.col(column).isin(allowed))
    if source.limit is not None:
        key = F.col(id_col).cast("string") if id_col else F.to_json(F.struct(*df.columns))
        df = df.orderBy(hashed_order(seed, key)).limit(source.limit * source.oversample)
    return df


def read_json_lines(spark: SparkSession, paths: list[str] | str, schema: StructType | str) -> DataFrame:
    """JSON lines, gzip or plain, of files, folders or globs, with the file each row is from."""
    return spark.read.schema(schema).json(paths).withColumn("file", F.input_file_name())


def load_all(spark: SparkSession, sources: list[Source], transform: dict[str, object]) -> tuple[DataFrame | None, DataFrame]:
    """Samples of all sources that load, and a manifest row for each source; one that fails leaves the others alone.

    Samples of a source are written in the shared folder before the next one is
    read, so that a file that breaks while it is read fails its own source only.
    A source with a limit gives at most that many samples.
    """
    pools, rows, space = None, [], Workspace(spark, "pools")
    for place, s in enumerate(sources):
        try:
            made = transform[s.name](read_source(spark, s))
            made = made if s.limit is None else made.limit(s.limit)
            made = space.table(f"source{place}", made).withColumn("source", F.lit(s.name)).withColumn("family", F.lit(s.family)).withColumn("language", F.lit(s.language))
            pools = made if pools is None else pools.unionByName(made, allowMissingColumns=True)
            rows.append((s.name, s.license, s.family, s.language, "loaded", ""))
        except Exception as error:  # a broken source becomes a row of the manifest
            rows.append((s.name, s.license, s.family, s.language, "failed", str(error)[:500]))
    return pools, spark.createDataFrame(rows, "dataset_id string, license string, family string, language string, status string, notes string")


def released(sources: list[Source], allow_restricted: bool = False) -> list[Source]:
    return [s for s in sources if allow_restricted or not s.restricted]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_splits(df: DataFrame, path: str, role: str = "role", order: str = "id") -> DataFrame:
    """JSON lines by role, refused if the folder exists; returns rows and content of each role.

    ``content`` is the sum of the lines' hashes: it does not hang on their order,
    and a row that occurs twice counts twice.
    """
    df.repartition(role).sortWithinPartitions(role, order).write.partitionBy(role).mode("errorifexists").json(path)
    line = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return df.groupBy(role).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias("content"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_missing(planned: DataFrame, path: str, key: str, compute, binding: str | None = None) -> None:
    """Compute and append only planned rows that the output lacks; an output row whose binding differs is an error.

    Only an output that does not exist counts as empty; one that cannot be read is an error.
    """
    spark = planned.sparkSession
    if _exists(spark, path):
        done = spark.read.parquet(path)
        if binding is not None:
            wrong = planned.alias("p").join(done.alias("d"), key).where(~F.col(f"p.{binding}").eqNullSafe(F.col(f"d.{binding}")))
            if not wrong.isEmpty():
                raise ValueError("an existing row is bound to other inputs")
        planned = planned.join(done.select(key), key, "left_anti")
    compute(planned).write.mode("append").parquet(path)


def manifest_rows(spark: SparkSession, sources: list[Source]) -> DataFrame:
    rows = [{k: str(v) for k, v in asdict(s).items()} for s in sources]
    return spark.createDataFrame(rows)


def score_batches(questions: DataFrame, score, schema: str) -> DataFrame:
    """The seam for a model: ``score`` maps an iterator of pandas frames to one of scored frames."""
    return questions.mapInPandas(score, schema)


def prometheus(metrics: DataFrame, name: Column | str = "name", labels: Column | str = "labels", value: Column | str = "value") -> DataFrame:
    """Exposition lines of metric rows."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return metrics.select(F.concat(c(name), F.lit("{"), c(labels), F.lit("} "), c(value).cast("string")).alias("value"))
