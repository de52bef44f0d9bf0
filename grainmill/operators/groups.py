"""Evidence groups: rows that share any alias, closed transitively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.components import connected_components


def connected_rows(df: DataFrame, id_col: str, aliases: list[str]) -> DataFrame:
    """``id`` and ``group`` (the least id) of each row; rows with an equal non-null alias of the same name are one group.

    Each alias value points at its least row, so an alias that most rows share
    gives one edge a row and no pairs.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).cast("string").alias("value")) for a in aliases]))
    nodes = df.select(F.col(id_col).alias("id"), pairs.alias("p")).select("id", "p.*").where("value IS NOT NULL")
    heads = nodes.groupBy("name", "value").agg(F.min("id").alias("head"))
    edges = nodes.join(heads, ["name", "value"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    found = connected_components(edges, name="groups")
    return df.select(F.col(id_col).alias("id")).distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group"))
