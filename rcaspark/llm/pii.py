"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Regular forms (e-mail, address, card, phone) are the seeds. The words before a seed and the shape of its token are
lexical patterns. Patterns and the values seen after them form a graph that is scored round by round: a pattern is as
good as the share of its values that are believed, a value is believed as far as good patterns precede it, and one that
fails a form's check never. Values in high-confidence patterns that no form has matched are the unseen identifiers that
are added: addresses spelled out, national numbers, numbers with other separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from ..session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
# The four forms. Each starts where the last match ended or a run of its first characters begins, and
# runs are possessive, so that a text is read once; the matches are those of the plain forms.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPACE = r"\x20\x09-\x0D"
#: Candidates: an address spelled out, a number with its area code in brackets, or a word that holds a digit or an at sign.
TOKEN = (
    rf"(?<![^{SPACE}])(?:"
    r"[A-Za-z0-9._%+-]++\x20(?:\(at\)|\[at\]|at)\x20[A-Za-z0-9-]++(?:\x20(?:\(dot\)|\[dot\]|dot)\x20[A-Za-z0-9-]++)++"
    r"|\([0-9]{2,6}\)\x20?[0-9][0-9-]*+"
    rf"|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)")
SPELLED = r"\x20(?:\(at\)|\[at\]|at)\x20"
MARKS = """.,;:!?()[]{}<>"'"""
#: Seeds that a pattern needs, what weighs against it from the start, how much an unseen value weighs against it, and
#: the confidence that adds a value.
SUPPORT, DOUBT, DISBELIEF, CONFIDENT, ROUNDS = 3, 1.0, 0.2, 0.9, 4
#: Elements that are folded one after another; longer arrays are folded in blocks, as a fold copies what it has.
BLOCK = 512
#: Characters of a stretch of text by which tokens find the spans that they touch.
STRETCH = 64
#: Digits that a value without an at sign needs to be an identifier.
LEAST_DIGITS = 5


def _blocks(items: Column) -> Column:
    last = F.greatest(F.ceil(F.size(items) / BLOCK) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _running(numbers: Column, add) -> Column:
    """For each of an array of longs, ``add`` over all in front of it, from 0; in two levels, so about linear."""
    def fold(values, begun):
        none = F.array().cast("array<bigint>")
        return F.aggregate(
            values, F.struct(begun.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    zero = F.lit(0).cast("bigint")

    def in_blocks(blocks):
        ends = F.transform(blocks, lambda values: F.aggregate(values, zero, add))
        return F.flatten(F.zip_with(blocks, fold(ends, zero), fold))

    return let(numbers, lambda items: let(_blocks(items), in_blocks))


def _plus(a, b):
    return a + b


def _located(text: Column, pattern: str, guard: Column, fields) -> Column:
    """Matches in order as structs (start, end, value, left): code points, from the lengths of the gaps and matches before.

    With ``fields``, ``left`` holds the two whole words in front of a match.
    """
    def two_words(gap):
        words = F.substring_index(F.btrim(F.regexp_replace(gap, f"[{SPACE}]+", " ")), " ", -2)
        return F.nullif(words, F.lit(""))

    def rows(found, gaps, starts):
        def row(value, i):
            start = F.get(starts, i) + F.length(F.get(gaps, i))
            left = F.lit("")
            if fields:
                said = [F.get(found, i - 2), two_words(F.get(gaps, i - 1)), F.get(found, i - 1), two_words(F.get(gaps, i))]
                left = F.substring_index(F.concat_ws(" ", *said), " ", -2)
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), left.alias("left"))

        return F.transform(found, row)

    def from_gaps(found, gaps):
        lengths = F.transform(found, lambda value, i: (F.length(value) + F.length(F.get(gaps, i))).cast("bigint"))
        return let(_running(lengths, _plus), lambda starts: rows(found, gaps, starts))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(
        F.split(text, pattern, -1), lambda gaps: from_gaps(found, gaps))))
    # An empty list of the struct's type where there is no text to look at.
    return F.coalesce(F.when(guard, found), none)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _holding(kind: str):
    return lambda m: _holds(kind, m["value"])


def _as_span(i: int):
    return lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("value"))


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def base_spans(text: Column) -> Column:
    """array<struct<kind:int,start:long,end:long,value:string>> of the four forms, by kind and start; empty for null.

    Values are in lower case.
    """
    text = F.coalesce(text, F.lit(""))
    guards = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"),
              "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}
    return F.concat(*[
        F.transform(
            F.filter(_located(text, FORMS[kind], guards[kind], False), _holding(kind)), _as_span(i))
        for i, kind in enumerate(KINDS)])


def _tokens(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return _located(text, TOKEN, text.rlike("[0-9@]"), True)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plausible(kind: Column, value: Column) -> Column:
    """Whether a value without the plain form may be one of ``kind``."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    by_kind = {"email": F.contains(value, F.lit("@")) | value.rlike(SPELLED), "ip": value.rlike(r"[0-9][^0-9]+[0-9]") & digits.between(4, 12),
               "card": digits.between(12, 19), "phone": digits.between(7, 15)}
    return F.coalesce(*[F.when(kind == i, by_kind[k]) for i, k in enumerate(KINDS)])


def _refused(value: Column) -> Column:
    """A value that has a form's shape and fails its check is known not to be one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    card = value.rlike(r"^[0-9](?:[\x20-]?[0-9]){15,18}$") & ~F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return card | value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")


def discover(tokens: DataFrame) -> DataFrame:
    """(value, kind) of the values that high-confidence patterns add.

    ``tokens`` holds a row per token: value, left, and kind (of the seed that
    starts in it, else null). Values are compared in lower case. A pattern's
    score for a kind is its seeds of the kind, over all its seeds, the values
    that failed a form's check, and ``DISBELIEF`` of the unseen values as far as
    they are not believed yet. A value is believed as far as any of its patterns
    is good. What few unseen values a good pattern has are drawn in round by
    round; where most values are unseen, the score stays low.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("left"), "[0-9]+", "0"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.btrim(w, F.lit(MARKS)))
    shape = F.regexp_replace(F.regexp_replace("value", "[a-z]+", "a"), "[0-9]", "0")
    last = F.element_at(words, -1)
    patterns = F.array_compact(F.array(
        F.when(F.size(words) >= 2, F.concat_ws(" ", F.lit("w"), F.element_at(words, -2), last)),
        F.when(F.size(words) >= 1, F.concat_ws(" ", F.lit("s"), last, shape))))
    edges = cut_lineage(
        tokens.select("value", "kind", F.explode(patterns).alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    # Only patterns that seeds bear out can add anything.
    live = edges.groupBy("pattern").agg(F.count("seed").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    edges = cut_lineage(edges.join(live, "pattern").withColumn("refused", F.col("seed").isNull() & _refused(F.col("value"))))
    against = edges.groupBy("pattern").agg((F.max("seeds") + F.count_if("refused")).alias("judged"))
    scored = cut_lineage(edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("own")).join(against, "pattern"))
    unseen = edges.where("seed is null and not refused").select("pattern", "value")
    unseen = cut_lineage(unseen.join(scored.select("pattern", "kind"), "pattern").where(_plausible(F.col("kind"), F.col("value"))))
    doubted = unseen.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("left"))
    belief = None
    for _ in range(ROUNDS):
        score = F.col("own") / (F.col("judged") + DOUBT + DISBELIEF * F.coalesce("left", F.lit(0.0)))
        good = scored.join(doubted, ["pattern", "kind"], "left").select("pattern", "kind", score.alias("score"))
        belief = cut_lineage(
            unseen.join(good, ["pattern", "kind"]).groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(1 - 1e-9)))))).alias("belief")))
        doubted = unseen.join(belief, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum(1 - F.col("belief")).alias("left"))
    best = belief.groupBy("value").agg(F.max(F.struct("belief", (-F.col("kind")).alias("kind"))).alias("best"))
    return best.where(F.col("best.belief") >= CONFIDENT).select("value", (-F.col("best.kind")).alias("kind"))


def _touched(token: DataFrame, rows: DataFrame) -> DataFrame:
    """``token`` (row, start, end, ...) with ``covered``, whether a base span overlaps it, and ``begun``, the first that starts in it.

    Tokens and spans meet on stretches of their text, so the work is that of the
    spans and not of their product.
    """
    def stretches(start, end):
        return F.explode(F.sequence(F.floor(F.col(start) / STRETCH), F.floor((F.col(end) - 1) / STRETCH)))

    span = rows.select("row", F.explode("base").alias("s")).select("row", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), "s")
    span = span.withColumn("stretch", stretches("s_start", "s_end"))
    near = token.select("row", "start", "end", stretches("start", "end").alias("stretch")).join(span, ["row", "stretch"]).where("s_start < end and s_end > start")
    first = F.when(F.col("s_start") >= F.col("start"), F.struct("s.kind", "s.start", "s.value"))
    near = near.groupBy("row", "start").agg(F.min(first).alias("begun"), F.lit(True).alias("covered"))
    return token.join(near, ["row", "start"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def located(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, added): the spans of every row of ``documents`` (doc_id, text).

    Spans are structs (kind, start, end) in code points, the end exclusive,
    sorted by kind and start. Null and empty texts have none. Repeated rows
    each have the same spans; rows that share a doc_id are told apart by their
    text. Null ids are kept. Other columns are ignored; an empty table gives
    no rows. Time is about linear in the length of a text.
    """
    text = F.col("text")
    rows = cut_lineage(
        documents.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("text_hash"),
                         base_spans(text).alias("base"), _tokens(text).alias("tokens"), F.monotonically_increasing_id().alias("row")))
    token = rows.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t"))
    inner = F.btrim(F.col("t.value"), F.lit(MARKS))
    start = F.col("t.start") + F.length("t.value") - F.length(F.ltrim("t.value", F.lit(MARKS)))
    # A bracket that belongs to an area code stays.
    coded = F.col("t.value").rlike(r"^\([0-9]{2,6}\)")
    start, inner = F.when(coded, F.col("t.start")).otherwise(start), F.when(coded, F.rtrim(F.col("t.value"), F.lit(MARKS))).otherwise(inner)
    token = token.select("row", start.alias("start"), (start + F.length(inner)).alias("end"), F.lower(inner).alias("value"), F.col("t.left").alias("left")).where("end > start")
    identifier = F.contains("value", F.lit("@")) | F.col("value").rlike(SPELLED) | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= LEAST_DIGITS)
    token = _touched(token, rows)
    token = cut_lineage(
        token.withColumns({"kind": F.col("begun.kind"), "value": F.coalesce(F.col("begun.value"), "value")}).drop("begun")
        .where("kind is not null or not covered").where(F.col("kind").isNotNull() | identifier))
    added = (
        token.where("kind is null").drop("kind").join(discover(token), "value")
        .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")))
    none = F.array().cast("array<struct<kind:int,start:long,end:long>>")
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("row", "doc_id", "text_hash", bare.alias("base")).join(added, "row", "left").select(
        "doc_id", "text_hash", "base", F.coalesce("added", none).alias("added"))


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added_spans) for every row, see ``located``.

    The counts and the digest are of the base spans, ``spans`` holds all.
    """
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return located(documents).select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"),
        spans_text(F.col("added")).alias("added_spans"))


def _cut_out(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets, worked on in blocks of spans."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def larger(a, b):
        return F.greatest(a, b)

    def in_blocks(ordered, ends):
        # What an element needs: where the text goes on in front of it, and whether it lies in an earlier span.
        parts = F.zip_with(ordered, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

        def block(items):
            base = F.get(items, 0)["at"]
            length = F.array_max(F.transform(items, lambda s: F.greatest(s["start"], s["at"]))) - base
            here = F.substring(text, (base + 1).cast("int"), length.cast("int"))

            def piece(stretch):
                return lambda s: F.when(s["start"] >= s["at"], F.concat(
                    F.substring(stretch, (s["at"] - base + 1).cast("int"), (s["start"] - s["at"]).cast("int")), F.element_at(names, s["kind"] + 1))).otherwise("")

            return let(here, lambda stretch: F.array_join(F.transform(items, piece(stretch)), ""))

        tail = F.substring(text, (F.array_max(F.transform(ordered, lambda s: s["end"])) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(_blocks(parts), block), ""), tail)

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return let(order, lambda ordered: let(
        _running(F.transform(ordered, lambda s: s["end"]), larger), lambda ends: in_blocks(ordered, ends)))


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one.

    All other columns stay as they are. A null text stays null.
    """
    spans = located(documents).select("doc_id", "text_hash", F.concat("base", "added").alias("spans")).where(F.size("spans") > 0)
    spans = cut_lineage(spans.distinct()).withColumnsRenamed({"doc_id": "_span_id", "text_hash": "_span_hash", "spans": "_spans"})
    key = F.col("doc_id").eqNullSafe(F.col("_span_id")) & (F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")) == F.col("_span_hash"))
    return (
        # One plan at every size: texts are shuffled by id, as spans grow with the texts.
        documents.join(spans.hint("merge"), key, "left")
        .withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_cut_out(F.col("text"), F.col("_spans"))))
        .select(*[F.col(c) for c in documents.columns]))
