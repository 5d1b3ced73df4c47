"""Discovery of an experiment tree: what each file is, and what changed since the last scan.

``{documents,models,architectures,insights}`` hold cards and collections, ``inferences/{dataset}/{model}/{arch}/{run}``
predictions. Files are listed by Spark's binary reader, so that any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Path patterns by kind, in order.
KINDS = {
    "dataset_card": r"(?:^|/)documents/document\.([^/]+)\.jsonc?$",
    "collection": r"(?:^|/)documents/document\.([^/]+)\.jsonl$",
    "model_card": r"(?:^|/)models/model\.([^/]+)\.jsonc?$",
    "architecture_card": r"(?:^|/)architectures/architecture\.([^/]+)\.jsonc?$",
    "run_card": r"(?:^|/)inferences/[^/]+/[^/]+/[^/]+/[^/]+/run_([^/]+)\.jsonc?$",
    "batch_meta": r"(?:^|/)inferences/[^/]+/[^/]+/[^/]+/[^/]+/batch_([0-9]+)\.jsonc?$",
    "batch": r"(?:^|/)inferences/[^/]+/[^/]+/[^/]+/[^/]+/batch_([0-9]+)\.jsonl$",
    "pairs": r"(?:^|/)insights/(scores)\.jsonl$",
}
RUN_PATH = r"(?:^|/)inferences/([^/]+)/([^/]+)/([^/]+)/([^/]+)/[^/]+$"


def classified(path: str | Column = "path") -> list[Column]:
    """Columns ``kind, name, dataset, model, arch, run_id, batch_idx`` of a path; nulls where they don't apply."""
    path = F.col(path) if isinstance(path, str) else path
    kind = F.coalesce(*[F.when(path.rlike(p), k) for k, p in KINDS.items()])
    name = F.coalesce(*[F.when(path.rlike(p), F.regexp_extract(path, p, 1)) for p in KINDS.values()])
    run = [F.when(path.rlike(RUN_PATH), F.regexp_extract(path, RUN_PATH, i)) for i in (1, 2, 3, 4)]
    named = F.when(kind.isin("dataset_card", "collection"), name)
    return [
        kind.alias("kind"), name.alias("name"), F.coalesce(run[0], named).alias("dataset"), run[1].alias("model"), run[2].alias("arch"), run[3].alias("run_id"),
        F.when(kind.isin("batch", "batch_meta"), F.regexp_extract(path, r"batch_([0-9]+)\.", 1).cast("int")).alias("batch_idx"),
    ]


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """Manifest ``path, size, mtime, hash, kind, ...`` of all files below ``root`` that are part of the tree.

    Hidden folders are passed over. Contents are hashed where they are read; they don't reach the driver. Line files
    may have any size: their hash is made of their number of lines and two sums of line hashes, which split files add up
    to; cards are hashed whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").where(~F.col("path").rlike(r"/\.[^/]+/"))
    rows = rows.select("*", *classified("path")).where("kind IS NOT NULL")
    cards, lines = rows.where("path NOT LIKE '%.jsonl'"), rows.where("path LIKE '%.jsonl'").drop("content")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    sums = text.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("value", F.lit(1)))), 256).alias("hash")
    )
    lines = lines.join(sums, "path", "left").withColumn("hash", F.coalesce("hash", F.lit("no lines")))
    return cards.withColumn("hash", F.sha2("content", 256)).drop("content").unionByName(lines).select("path", "size", "mtime", "hash", *rows.columns[4:])


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: files added, changed (by content) or removed between two manifests."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def registered(known: DataFrame, found: DataFrame) -> DataFrame:
    """``path, file_id``: known files keep their number, new ones go on from the largest, by folder and path.

    Files are numbered inside their folder; only the folders, of which there are far fewer, are numbered in one task.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    new = found.select("path").distinct().join(known.select("path"), "path", "left_anti").withColumn("folder", folder)
    place = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    sizes = new.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("folder", (F.sum("n").over(Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    top = known.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("place", place).join(before, "folder").crossJoin(F.broadcast(top))  # one row
    return known.select("path", F.col("file_id").cast("long").alias("file_id")).unionByName(numbered.select("path", (F.col("top") + F.col("before") + F.col("place")).cast("long").alias("file_id")))
