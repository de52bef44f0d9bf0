"""An endless stream of batches with exact quotas; an offset is the number of the next batch."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from grainmill.operators.epochs import PLACES, batch_places, drawn_rows


#: Parts into which a cell's batches of one micro-batch are cut, at most.
PARTS = 16
#: Rows that a task makes at once.
ROWS = 1 << 16


@dataclass
class CellBatches(InputPartition):
    first: int
    last: int
    cell: str
    n: int
    quota: int


class _Reader(DataSourceStreamReader):
    """Each micro-batch goes ``perTrigger`` batches further, up to ``until`` if that is set."""

    def __init__(self, options: dict[str, str]) -> None:
        self.cells = {c: (n, q) for c, (n, q) in json.loads(options["cells"]).items() if n > 0 and q > 0}
        self.seed = int(options.get("seed", "0"))
        self.start = int(options.get("start", "0"))
        self.step = int(options.get("pertrigger", "1"))
        self.until = int(options["until"]) if "until" in options else None
        self.reached = self.start

    def initialOffset(self) -> dict:
        return {"batch": self.start}

    def latestOffset(self) -> dict:
        self.reached += self.step
        if self.until is not None:
            self.reached = min(self.reached, max(self.until, self.start))
        return {"batch": self.reached}

    def partitions(self, start: dict, end: dict) -> list[CellBatches]:
        low, high = start["batch"], end["batch"]
        self.reached = max(self.reached, high)
        width = max(1, -(-(high - low) // PARTS))
        return [CellBatches(b, min(b + width, high), c, n, q) for b in range(low, high, width) for c, (n, q) in self.cells.items()]

    def read(self, partition: CellBatches) -> Iterator:
        p = partition
        step = max(1, ROWS // p.quota)
        for b in range(p.first, p.last, step):
            yield batch_places(p.cell, p.n, p.quota, b, min(b + step, p.last), self.seed)

    def commit(self, end: dict) -> None:
        pass


class EndlessSource(DataSource):
    """``format("endless_places")``: places of batches without end. Options: ``cells`` (JSON: rows and quota of each), ``seed``, ``start``, ``perTrigger``, ``until``."""

    @classmethod
    def name(cls) -> str:
        return "endless_places"

    def schema(self) -> str:
        return PLACES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def endless_batches(spark: SparkSession, numbered: DataFrame, cell: str, sizes: Mapping[str, int], quotas: Mapping[str, int], **options: str) -> DataFrame:
    """A stream of the rows of one batch after the other, from a table of ``number_cells``.

    The rows of a batch hang on its number, the seed and the table alone: a stream that restarts at any
    offset, with or without its checkpoint, gives the same rows.
    """
    spark.dataSource.register(EndlessSource)
    cells = json.dumps({c: [sizes.get(c, 0), q] for c, q in quotas.items()})
    places = spark.readStream.format("endless_places").options(cells=cells, **options).load()
    return drawn_rows(places, numbered, cell)
