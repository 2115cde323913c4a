"""A tile store with a commit log: which version of every segment counts is a table, not a folder listing.

``<store>/tiles/<batch>`` holds the tiles a batch brought, ``<store>/log/<batch>`` its entries (city, seg_row, seg_col, arrived,
batch), ``<store>/state/<batch>`` the winner of every segment after each ``EVERY``-th batch, and ``<store>/head`` names the last
batch and what is stored. Of the tiles of a segment the one that arrived last wins, of equal ones that of the later batch;
an older tile that comes late is logged and loses. Batches are numbered without gaps, so the folders to read follow from
the head and nothing is listed. A batch that is written again replaces itself; readers see it once the head names it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cobblestone.sources.shared_file import read_text, write_text
from cobblestone.sources.tiles import TILE_FILES

KEYS = ["city", "seg_row", "seg_col"]
ENTRY = "city string, seg_row int, seg_col int, arrived bigint, batch bigint"
EVERY = 10


@dataclass
class Head:
    """The last batch, its tiles, the segments it brought first, and the segments stored after it."""

    batch: int = -1
    tiles: int = 0
    added: int = 0
    done: int = 0


class TileLog:
    def __init__(self, spark: SparkSession, store: str, every: int = EVERY):
        self.spark, self.store, self.every = spark, store, every

    def head(self) -> Head:
        text = read_text(self.spark, f"{self.store}/head")
        return Head(**json.loads(text)) if text else Head()

    def entries(self, batch: int | None = None) -> DataFrame:
        """The winner of every segment after ``batch``, the last one unless given."""
        last = self.head().batch if batch is None else batch
        state = (last + 1) // self.every * self.every - 1  # the last batch with a state
        paths = [f"{self.store}/state/{state}"] if state >= 0 else []
        paths += [f"{self.store}/log/{b}" for b in range(state + 1, last + 1)]
        if not paths:
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.max(F.struct("arrived", "batch")).alias("w")).select(*KEYS, "w.arrived", "w.batch")

    def commit(self, batch: int, tiles: DataFrame) -> Head:
        """Adds the tiles of a batch (city, seg_row, seg_col, arrived, ...); of one segment the last arrived is kept."""
        head = self.head()
        if batch <= head.batch:
            return head  # written before a restart
        rest = [c for c in tiles.columns if c not in KEYS]
        # two tiles of one segment that arrived together: the one with the larger hash
        order = F.struct("arrived", F.xxhash64(*rest))
        latest = tiles.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("t")).select(*KEYS, "t.*")
        latest.write.mode("overwrite").options(**TILE_FILES).parquet(f"{self.store}/tiles/{batch}")
        kept = self.spark.read.schema(latest.schema).parquet(f"{self.store}/tiles/{batch}")
        entries = kept.select(*KEYS, "arrived", F.lit(batch).cast("bigint").alias("batch"))
        entries.write.mode("overwrite").parquet(f"{self.store}/log/{batch}")
        before = self.entries(batch - 1).select(*KEYS, F.lit(1).alias("known"))
        counts = entries.join(before, KEYS, "left").agg(F.count("*"), F.count_if(F.col("known").isNull())).first()
        new = Head(batch, counts[0], counts[1], head.done + counts[1])
        if (batch + 1) % self.every == 0:
            state = self.spark.read.schema(ENTRY).parquet(f"{self.store}/log/{batch}").unionByName(self.entries(batch - 1))
            state.groupBy(*KEYS).agg(F.max(F.struct("arrived", "batch")).alias("w")).select(*KEYS, "w.*").write.mode("overwrite").parquet(f"{self.store}/state/{batch}")
        write_text(self.spark, f"{self.store}/head", json.dumps(asdict(new)))
        return new

    def tiles(self, schema, city: str | None = None) -> DataFrame:
        """The winning tiles; ``schema`` is that of the tiles. Batches that hold no winner are not read."""
        winners = self.entries()
        winners = winners if city is None else winners.where(F.col("city") == city)
        batches = [r.batch for r in winners.select("batch").distinct().collect()]  # one number per batch
        if not batches:
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(schema).parquet(*(f"{self.store}/tiles/{b}" for b in sorted(batches)))
        source = F.regexp_extract("_metadata.file_path", r"/tiles/([0-9]+)/[^/]*$", 1).cast("bigint")
        return every.withColumn("batch", source).join(winners.select(*KEYS, "batch"), [*KEYS, "batch"], "left_semi").drop("batch")
