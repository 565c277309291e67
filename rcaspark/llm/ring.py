"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A ring has a fixed number of places. Every shard stands at several of them (virtual nodes), which depend on the shard
alone; a row's place depends on its key alone. A row goes to the first shard at or after its place. A shard that is
full takes no more, and what overflows continues clockwise to the next shard with room, until all is placed. Capacities
add up to the load (times 1 + slack), so the balance is guaranteed; with one more shard only rows in front of its
virtual nodes and rows at the ends of what is full move.

All rows of a place meet the same shards, so the walk is done with the load of each place and not with rows: a round
moves every load that is left to its next open shard, shards fill up in the order of places, and what is beyond their
room is the next round. The tables of a round have at most as many rows as the ring has places, whatever the number of
rows. A place's rows are then cut, in a fixed order, at the bounds that the walk has given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Places of the ring (several times shards * nodes, so that few nodes share one), and virtual nodes of a shard.
PLACES, NODES = 1 << 14, 256


def ring(spark: SparkSession, shards: int, nodes: int = NODES, places: int = PLACES) -> DataFrame:
    """(place, shard): the virtual nodes. They depend on a shard's number alone; shards may meet at a place."""
    points = spark.range(shards * nodes).select((F.floor(F.col("id") / nodes)).cast("int").alias("shard"), (F.col("id") % nodes).alias("node"))
    return points.select(F.pmod(F.xxhash64(F.lit("virtual node"), "shard", "node"), F.lit(places)).alias("place"), "shard").distinct()


def _offered(left: DataFrame, nodes: DataFrame, places: int) -> DataFrame:
    """Each load of ``left`` (..., at) with the shard and place (``node``) of the first of ``nodes`` at or after ``at``.

    The window has a row for each load and two for each node, so it is as long as the ring: one task's work.
    """
    turns = nodes.select("shard", F.explode(F.array(F.col("place"), F.col("place") + places)).alias("node"))
    both = left.unionByName(turns.withColumn("at", F.col("node")), allowMissingColumns=True).coalesce(1)
    # Backwards, as Spark carries the last value on but would look through all of what follows for the first one. At one
    # place loads come in front of the nodes, so that they see them, and the smaller shard's node comes first.
    back = Window.orderBy(F.desc("at"), F.col("node").isNull(), F.desc("shard")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last(F.when(F.col("node").isNotNull(), F.struct("shard", "node")), ignorenulls=True).over(back)
    return both.withColumn("near", near).where("node is null").drop("shard", "node").select("*", "near.*").drop("near")


def walk(loads: DataFrame, nodes: DataFrame, room: DataFrame, places: int = PLACES) -> DataFrame:
    """(place, from, to, shard, hop): which part of each place's load each shard takes.

    ``loads`` holds (place, load), ``nodes`` (place, shard) and ``room``
    (shard, room); all the room must be at least all the load, and every shard
    needs a node. ``from`` and ``to`` count from the start of the place's
    load; ``hop`` is the number of full shards that were passed. A shard
    fills up with the nearest loads of its nodes in turn.
    """
    left = cut_lineage(loads.where("load > 0").select(
        "place", F.lit(0).cast("long").alias("from"), F.col("load").cast("long").alias("load"), F.col("place").alias("at")).coalesce(1))
    room = cut_lineage(room.where("room > 0").select("shard", F.col("room").cast("long").alias("room")).coalesce(1))
    nodes = cut_lineage(nodes.coalesce(1))
    taken, hop = [], 0
    while left.limit(1).count():
        offered = _offered(left, nodes.join(F.broadcast(room), "shard", "left_semi"), places).join(F.broadcast(room), "shard")
        turn = Window.partitionBy("shard").orderBy("node", F.desc("at"), "place", "from").rowsBetween(Window.unboundedPreceding, -1)
        fits = F.least(F.col("load"), F.greatest(F.lit(0), F.col("room") - F.coalesce(F.sum("load").over(turn), F.lit(0))))
        offered = cut_lineage(offered.withColumn("fits", fits))
        rest = F.col("from") + F.col("fits")
        taken.append(offered.where("fits > 0").select("place", "from", rest.alias("to"), "shard", F.lit(hop).alias("hop")))
        left = offered.where("fits < load").select(
            "place", rest.alias("from"), (F.col("load") - F.col("fits")).alias("load"), F.pmod("node", F.lit(places)).alias("at"))
        used = offered.groupBy("shard").agg(F.sum("fits").alias("used"))
        room = cut_lineage(room.join(F.broadcast(used), "shard", "left").select(
            "shard", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).where("room > 0").coalesce(1))
        hop += 1
    if not taken:
        return left.select("place", "from", F.col("load").alias("to"), F.lit(0).alias("shard"), F.lit(0).alias("hop"))
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def shard(
    documents: DataFrame, key: Column, shards: int, load: Column | None = None, slack: float = 0.0,
    nodes: int = NODES, places: int = PLACES,
) -> DataFrame:
    """``documents`` with shard (int), slot (long, gapless from 0 in its shard) and hop (int, full shards passed).

    Without ``load`` every row counts 1. With no ``slack`` the room of shards
    is the row count dealt out evenly, so counts are at most one apart. With
    ``load`` (a positive whole number, such as bytes) the room is
    (1 + slack) / shards of the whole; a row goes where its first unit falls,
    so a shard may be over its room by less than a row for each place that is cut.

    A null key is a key like others. Rows with one key share a place, which is
    cut like every other, so a hot key fills several shards in turn. Repeated
    rows each count. Columns named shard, slot or hop are replaced, others
    stay. Empty tables give no rows.
    """
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c not in ("shard", "slot", "hop")]
    held = F.struct(*[F.col(c) for c in kept]).alias("_kept")
    rows = cut_lineage(documents.select(
        held, F.pmod(F.xxhash64(key), F.lit(places)).alias("place"), F.lit(1).cast("long").alias("load") if load is None else load.cast("long").alias("load"),
        F.monotonically_increasing_id().alias("row")))
    loads = cut_lineage(rows.groupBy("place").agg(F.sum("load").alias("load")).coalesce(1))
    whole = loads.agg(F.coalesce(F.sum("load"), F.lit(0)).cast("long").alias("n"))
    numbers = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(whole), F.lit(True))
    if slack:
        room = numbers.select("shard", F.ceil(F.col("n") * (1 + slack) / shards).alias("room"))
    else:
        room = numbers.select("shard", F.expr(f"n div {shards} + if(shard < n % {shards}, 1, 0)").alias("room"))
    # At most a row for each place and one more for each shard and round.
    pieces = cut_lineage(walk(loads, ring(spark, shards, nodes, places), room, places))

    # Where a row begins in its place's load: ranges of rows, so that a hot place is many tasks' work.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut_lineage(rows.repartitionByRange(parts, "place", "row").withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("place", "range").agg(F.sum("load").alias("size"))
    before = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(sizes.select("place", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift")))
    inside = Window.partitionBy("place", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("load").over(inside), F.lit(0))
    number = F.row_number().over(Window.partitionBy("place", "range").orderBy("row"))
    placed = (
        ranges.withColumn("begun", begun).withColumn("number", number).join(F.broadcast(sizes), ["place", "range"])
        .withColumn("begun", F.col("begun") + F.col("shift")).join(F.broadcast(pieces), "place")
        .where("begun >= from and begun < to").drop("begun", "shift", "to", "load", "row"))
    placed = cut_lineage(placed)
    # Slots: stretches of rows that share place, range and piece, one after another; within one, rows keep their numbers.
    stretch = ["shard", "place", "from", "range"]
    found = placed.groupBy(*stretch).agg(F.count("*").alias("n"), F.min("number").alias("first"))
    ahead = Window.partitionBy("shard").orderBy("place", "from", "range").rowsBetween(Window.unboundedPreceding, -1)
    found = cut_lineage(found.select(*stretch, (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("offset")))
    slot = (F.col("number") + F.col("offset")).cast("long").alias("slot")
    return placed.join(F.broadcast(found), stretch).select("_kept.*", "shard", slot, "hop")
