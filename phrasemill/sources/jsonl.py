"""JSON lines: predictions, collections and similarity pairs, with bad lines counted and line order kept.

Spark's readers give no byte offsets, which decide which of two lines with one id stands. ``LineSource`` is a
Python data source that splits files at line ends and yields ``path, byte_off, byte_len, value``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PREDICTION = "_id string, inferences array<string>, costs string"
SECTION = "array<struct<field:string,language:string,languages:string,content:string>>"
ANNOTATION = "array<struct<annotator:string,language:string,languages:string,keyphrases:array<string>>>"
DOCUMENT = f"_id string, metadata string, sections {SECTION}, annotations {ANNOTATION}"
SPLIT_BYTES = 32 << 20


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


class _LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["paths"].split("\n")
        self.size = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[_Range]:
        import os

        return [_Range(p, at, min(at + self.size, n)) for p in self.paths for n in [os.path.getsize(p)] for at in range(0, n, self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """Lines that begin in the range: a range starts after the first line end at or behind its start."""
        with open(partition.path, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.stop:
                line = f.readline()
                if not line:
                    break
                if line.strip():
                    yield partition.path, at, len(line), line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)


class LineSource(DataSource):
    """``spark.read.format("offset_lines").option("paths", "a\\nb").load()``: lines with their byte offsets.

    Paths are on a file system that every executor mounts; for object stores use ``text_lines``.
    """

    @classmethod
    def name(cls) -> str:
        return "offset_lines"

    def schema(self) -> str:
        return "path string, byte_off long, byte_len long, value string"

    def reader(self, schema: object) -> DataSourceReader:
        return _LineReader(self.options)


def offset_lines(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format("offset_lines").option("paths", "\n".join(paths)).option("splitBytes", split_bytes).load()


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, value`` by Spark's own reader, from any store; without offsets."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) <> ''")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Adds ``obj`` (null for a bad line) and ``bad``."""
    obj = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("obj", obj)
    bad = F.col("obj").isNull() | F.col("obj._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    return out.withColumn("bad", bad).withColumn("obj", F.when(~F.col("bad"), F.col("obj")))


def point(lines: DataFrame, path: str, byte_off: int) -> DataFrame:
    """One raw line."""
    return lines.where((F.col("path") == path) & (F.col("byte_off") == byte_off))


def similarity_pairs(lines: DataFrame) -> DataFrame:
    """``dataset_a, doc_id_a, dataset_b, doc_id_b, score, label`` in either spelling of the keys; others are dropped."""

    def field(name: str) -> F.Column:
        return F.coalesce(F.get_json_object("value", f"$.{name}"), F.get_json_object("value", f"$.{name[:-1]}{name[-1].upper()}"))

    keys = [field(k).alias(k) for k in ("dataset_a", "doc_id_a", "dataset_b", "doc_id_b")]
    out = lines.select(*keys, F.get_json_object("value", "$.score").alias("s"), F.get_json_object("value", "$.label").alias("label"))
    return out.withColumn("score", F.expr("try_cast(s AS DOUBLE)")).drop("s").dropna(subset=["dataset_a", "doc_id_a", "dataset_b", "doc_id_b", "score"])
