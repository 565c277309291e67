"""Template and line tables to bounded, ordered text per entity.

Templates: (case, entity, event_id, template, occurrence, pos).
Lines: (case, entity, event_id, time, content, pos), ``pos`` unique per entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from rcaspark.operators.order import first_per_group, full_rank

KEYS = ["case", "entity", "event_id"]

# Layout of the log text, and how many templates the released layout lets through.
EVENT_HEAD = "---\nEvent template: %s, with event ID %s, occurred %d times.\n\nHere are some examples of this template:\n\n"
EVENT_LINE = "* The event occurred at %s, and its content was %s."
EVENT_TAIL = "\n---\n\n"
RELEASED_TEMPLATE_CAP = 52
SAMPLES_PER_EVENT = 10


def first_templates(templates: DataFrame) -> DataFrame:
    """The first template and occurrence of each event id, with where it was first seen."""
    return templates.groupBy(*KEYS).agg(
        F.min_by(F.struct("template", "occurrence"), "pos").alias("_first"), F.min("pos").alias("first_pos")
    ).select(*KEYS, "_first.template", "_first.occurrence", "first_pos")


def first_seen_events(rows: DataFrame, keys: list[str], event: str, pos: str) -> DataFrame:
    """Distinct events with the place of their first row."""
    return rows.groupBy(*keys, event).agg(F.min(pos).alias("first_pos"))


def cap_templates(firsts: DataFrame, cap: int = RELEASED_TEMPLATE_CAP) -> DataFrame:
    """The first ``cap`` events of each entity in first-seen order."""
    return first_per_group(firsts, ["case", "entity"], [F.col("first_pos"), F.col("event_id")], cap, "event_rank")


def strided_sample(lines: DataFrame, firsts: DataFrame, n: int = SAMPLES_PER_EVENT, block: int = 1_000_000) -> DataFrame:
    """Every k-th line of each event, k = max(1, occurrence div n), the first n of them.

    Lines are counted per block of ``pos`` first. From the counts follows which
    blocks hold a wanted line, at most n per event, and only those are numbered.
    An event with most of the lines is thus never sorted as a whole, and the
    content is read for the chosen blocks alone.
    """
    lines = lines.withColumn("_block", F.expr(f"pos div {block}"))
    step = firsts.select(*KEYS, F.greatest(F.lit(1), F.expr(f"occurrence div {n}")).alias("_k"))
    counts = lines.groupBy(*KEYS, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(step, KEYS)
    next_wanted = F.expr("(_before + _k - 1) div _k * _k")
    blocks = blocks.where((next_wanted < F.col("_before") + F.col("_n")) & (next_wanted < n * F.col("_k")))
    inside = Window.partitionBy(*KEYS, "_block").orderBy("pos")
    at = F.row_number().over(inside) - 1 + F.col("_before")
    return (
        lines.join(blocks.select(*KEYS, "_block", "_before", "_k"), [*KEYS, "_block"])
        .withColumn("_at", at)
        .where((F.col("_at") % F.col("_k") == 0) & (F.col("_at") < n * F.col("_k")))
        .withColumn("sample", F.expr("_at div _k + 1").cast("bigint"))
        .drop("_block", "_before", "_k", "_at")
    )


def join_templates(firsts: DataFrame, lines: DataFrame) -> DataFrame:
    """Each template with its lines; a template without lines stays, with nulls."""
    return firsts.join(lines.select(*KEYS, "time", "content", "pos"), KEYS, "left")


def event_texts(firsts: DataFrame, samples: DataFrame) -> DataFrame:
    """One text block per event: head, at most n sampled lines, tail."""
    line = F.format_string(EVENT_LINE, F.col("time"), F.col("content"))
    examples = samples.select(*KEYS, "sample", line.alias("line")).groupBy(*KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "line"))), lambda x: x["line"]), "\n").alias("examples"))
    head = F.format_string(EVENT_HEAD, F.col("template"), F.col("event_id"), F.col("occurrence"))
    return firsts.join(examples, KEYS, "left").withColumn(
        "text", F.concat(head, F.coalesce("examples", F.lit("")), F.lit(EVENT_TAIL))).drop("examples")


def entity_log_text(events: DataFrame) -> DataFrame:
    """The capped event blocks of an entity joined in first-seen order."""
    return events.groupBy("case", "entity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_rank", "text"))), lambda x: x["text"]), "").alias("log_text"),
        F.count("*").alias("n_events"))


def log_text(templates: DataFrame, lines: DataFrame, n: int = SAMPLES_PER_EVENT, compat: str = "corrected", block: int = 1_000_000) -> DataFrame:
    """Log text per entity from the two log tables; the released text ends after the first 52 templates."""
    firsts = first_templates(templates)
    if compat == "released":
        firsts = cap_templates(firsts)
    else:
        firsts = full_rank(firsts, ["case", "entity"], [F.col("first_pos"), F.col("event_id")], "event_rank")
    wanted = lines.join(firsts.select(*KEYS), KEYS, "left_semi")
    return entity_log_text(event_texts(firsts, strided_sample(wanted, firsts, n, block)))


# -- bytes -------------------------------------------------------------------

@F.pandas_udf(IntegerType())
def _undecodable(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def count(raw):
        if raw is None:
            return 0
        return sum(0xDC80 <= ord(c) <= 0xDCFF for c in bytes(raw).decode("utf-8", "surrogateescape"))

    for s in parts:
        yield s.map(count).astype("int32")


def invalid_bytes(text: Column) -> Column:
    """Number of bytes of a string that are not part of valid UTF-8."""
    return F.when(~F.is_valid_utf8(text), _undecodable(text.cast("binary"))).otherwise(F.lit(0))


def byte_report(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Undecodable bytes and affected rows per column; good rows never reach Python.

    To be run on text as scanned: regular expressions and ``read.csv`` replace bad bytes.
    """
    bad = None
    for c in columns:
        one = rows.where(~F.is_valid_utf8(F.col(c))).select(
            *keys, F.lit(c).alias("column_name"), _undecodable(F.col(c).cast("binary")).alias("_n"))
        bad = one if bad is None else bad.unionByName(one)
    return bad.groupBy(*keys, "column_name").agg(F.sum("_n").alias("bad_bytes"), F.count("*").alias("bad_rows"))


def bad_byte_samples(rows: DataFrame, keys: list[str], pos: str, text: str, n: int = 12) -> DataFrame:
    """The first n affected rows of each file."""
    bad = rows.where(~F.is_valid_utf8(F.col(text))).select(*keys, pos, F.hex(F.col(text).cast("binary")).alias("bytes_hex"))
    return first_per_group(bad, keys, [F.col(pos)], n, "sample")


# -- counters ----------------------------------------------------------------

def schema_variant(json_text: Column) -> Column:
    """Sorted top-level keys of a JSON object."""
    return F.array_join(F.array_sort(F.map_keys(F.from_json(json_text, "map<string,string>"))), ",")


def log_counters(hits: DataFrame, keys: list[str], time: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def mentions(lines: DataFrame, text: str, names: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Lines that mention each name as a whole token, a line counting once per name.

    Tokens are counted before the names are looked up, so that a token in most
    lines is one row per task when it is shuffled.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9][A-Za-z0-9_.-]*"), F.lit(0)))
    return (
        lines.select(*keys, F.explode(tokens).alias(name))
        .groupBy(*keys, name).agg(F.count("*").alias("n_lines"))
        .join(names.select(name).distinct(), name, "left_semi")
    )
