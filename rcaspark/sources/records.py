"""Records of quoted text files whose fields may hold line breaks, read split by split.

Whether a line break ends a record depends on the number of quotes before it. Each split counts its quotes; the sums of
the splits before say whether a split begins inside a quoted field. With that, every split finds the starts of its own
records, and only the lines that belong to a record begun earlier travel to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rcaspark.session import cut_lineage

_PIECE = "path string, block bigint, line bigint, piece bigint, text string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of splits, in order, as records: complete ones, and the head of a split that goes on with an earlier record.

    A head has line -1. A record whose last line is not in its split comes with
    what there is of it; ``piece`` says the order.
    """
    at, inside, line, held = None, False, 0, []

    def record():
        return (*at, line, 0, "\n".join(held))

    for pdf in batches:
        out = []
        for path, block, odd, text in pdf[["path", "block", "odd", "value"]].itertuples(index=False):
            if (path, block) != at:
                if held:
                    out.append(record())
                at, inside, line, held = (path, block), bool(odd), -1 if odd else 0, []
            if not inside and held:
                out.append(record())
                line, held = max(line, 0) + 1, []
            held.append(text)
            inside ^= text.count('"') % 2 == 1
        # The record in hand may go on in the next batch.
        yield pd.DataFrame(out, columns=["path", "block", "line", "piece", "text"])
    if held:
        yield pd.DataFrame([record()], columns=["path", "block", "line", "piece", "text"])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, text): the records of text files in which a double quote encloses a field and doubles to stand for itself.

    ``text`` is a record without its last line break; ``block`` and ``line``
    order the records of a file. Line breaks are \\n, and a \\r before one ends no
    record. A file of any size is read by as many tasks as it has splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    counts = lines.groupBy("path", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = counts.select("path", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("odd"))
    odd = cut_lineage(odd)
    # A row per split; the lines stay where they were read.
    marked = lines.join(F.broadcast(odd), ["path", "block"]).select("path", "block", "odd", "value")
    found = cut_lineage(marked.mapInPandas(_pieces, _PIECE))
    # Heads belong to the last record of the nearest split before that begins one.
    heads = found.where("line = -1")
    ends = found.where("line >= 0").groupBy("path", "block").agg(F.max("line").alias("line"))
    turns = ends.withColumn("head", F.lit(False)).unionByName(heads.select("path", "block", F.lit(-1).cast("bigint").alias("line"), F.lit(True).alias("head")))
    back = Window.partitionBy("path").orderBy("block", F.col("head").desc()).rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(~F.col("head"), F.struct("block", "line")), ignorenulls=True).over(back)
    owned = turns.withColumn("owner", owner).where("head").select("path", F.col("block").alias("piece"), F.col("owner.block").alias("block"), F.col("owner.line").alias("line"))
    tails = heads.drop("piece", "line").withColumnRenamed("block", "piece").join(owned, ["path", "piece"]).select("path", "block", "line", "piece", "text")
    cut = found.where("line >= 0").join(tails.select("path", "block", "line").distinct(), ["path", "block", "line"], "left_semi").unionByName(tails)
    whole = cut.groupBy("path", "block", "line").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rest = found.where("line >= 0").join(tails.select("path", "block", "line").distinct(), ["path", "block", "line"], "left_anti").drop("piece")
    return rest.unionByName(whole)
