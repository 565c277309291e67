"""Parsing of model answers, summaries, citations and search results, mostly as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from rcaspark.functions.vectors import let

# Marks and headings of the answer formats.
SECTION_MARK = "---"
SUMMARY_HEAD = "Summary of the "
DATASET_HEAD = "Dataset Summary: "
REFERENCES_HEAD = "\nReferences:"


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def after_first(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null without one."""
    return F.get(F.split(text, re.escape(mark), 2), 1)


# -- sections --------------------------------------------------------------------

def dataset_summary(text: Column) -> Column:
    return F.get(F.split(F.get(F.split(text, SECTION_MARK), 0), re.escape(DATASET_HEAD)), 1)


def node_sections(rows: DataFrame, text: str, keys: Sequence[str], compat: str = "corrected") -> DataFrame:
    """(keys, name, body, pos) of each ``Summary of the NAME: BODY`` section.

    The released parser ends the body at the next colon; corrected keeps all of it.
    """
    parts = rows.select(*keys, F.posexplode(F.split(F.col(text), SECTION_MARK)).alias("pos", "part")).where("pos > 0")
    rest = after_first(F.col("part"), SUMMARY_HEAD)
    if compat == "released":
        rest = F.get(F.split(F.col("part"), SUMMARY_HEAD), 1)
        body = F.get(F.split(rest, ":"), 1)
    else:
        body = after_first(rest, ":")
    return parts.select(*keys, F.get(F.split(rest, ":", 2), 0).alias("name"), body.alias("body"), "pos").where("body is not null")


def last_section(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A repeated name keeps its last body."""
    return sections.groupBy(*keys, "name").agg(F.max_by("body", "pos").alias("body"))


def sections_by_position(rows: DataFrame, text: str, keys: Sequence[str], labels: DataFrame) -> DataFrame:
    """The i-th section belongs to the i-th label; ``mentions`` tells whether it names it.

    ``labels`` holds (pos, label) from 0; section 0 is about the data set.
    """
    parts = rows.select(*keys, F.posexplode(F.split(F.col(text), SECTION_MARK)).alias("_at", "part")).where("_at > 0")
    # There are few positions, so each label is given to as many tasks as a shuffle has.
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = labels.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = parts.withColumn("pos", F.col("_at") - 1).withColumn("_share", F.pmod(F.xxhash64(*keys, "_at"), F.lit(shares)).cast("int"))
    named = dealt.join(given, ["pos", "_share"])
    return named.select(*keys, "pos", "label", "part", F.contains("part", F.col("label")).alias("mentions"))


_SUMMARY = StructType([
    StructField("error", StringType()),
    StructField("canonical", StringType()),
    StructField("dataset", StringType()),
    StructField("names", ArrayType(StringType())),
    StructField("bodies", ArrayType(StringType())),
])
# How the parts of a summary answer begin.
_PART_HEADS = {"D": ("Dataset Summary:",), "N": ("Summary of the ", "Summary of "), "R": ("Relationships between Nodes:",)}
_WRONG_PART = {"D": "dataset heading", "N": "unknown section", "R": "unknown section", "?": "unknown section"}


def _part(lines: list[str]) -> tuple[str, str, str]:
    """Kind, name and body of the lines between two rules."""
    whole = "\n".join(lines).strip()
    for kind, heads in _PART_HEADS.items():
        head = next((h for h in heads if whole.startswith(h)), None)
        if head is None:
            continue
        rest = whole[len(head):]
        if kind == "N":
            name, colon, rest = rest.partition(":")
            if not colon or not name or "\n" in name:
                return "?", "", whole
            return (kind, name, rest.strip()) if rest.strip() else ("?", "", whole)
        if kind == "R":
            return (kind, "", whole) if rest.startswith("\n") else ("?", "", whole)
        return (kind, "", rest.strip()) if rest.strip() else ("?", "", whole)
    return "?", "", whole


def _canonical_summary(text: str, labels) -> tuple:
    parts, lines = [], []
    for line in [*text.split("\n"), "---"]:
        if line.strip() == "---":
            parts.append(_part(lines))
            lines = []
        else:
            lines.append(line)
    kinds = "".join(k for k, _, _ in parts)
    names = [name for k, name, _ in parts if k == "N"]
    error = None
    if kinds[0] != "D":
        error = "dataset heading"
    else:
        fits = re.match("DN*R?", kinds).end()
        known = [k == "N" and name not in labels for k, name, _ in parts[:fits]]
        again = [k == "N" and name in names[:i - 1] for i, (k, name, _) in enumerate(parts[:fits])]
        faults = [(known.index(True), "unknown node")] if any(known) else []
        faults += [(again.index(True), "repeated node")] if any(again) else []
        faults += [(fits, _WRONG_PART[kinds[fits]])] if fits < len(kinds) else []
        error = min(faults)[1] if faults else None
    if error:
        return error, None, None, None, None
    dataset = "\n\n".join(body for k, _, body in parts if k != "N")
    bodies = [body for k, _, body in parts if k == "N"]
    whole = "\n---\n".join([DATASET_HEAD + dataset, *(f"{SUMMARY_HEAD}{n}: {b}" for n, b in zip(names, bodies))])
    return None, whole, dataset, names, bodies


def canonical_summary(text: Column, labels: Column) -> Column:
    """Struct (error, canonical, dataset, names, bodies) of a whole summary answer.

    Headings may leave out "the"; a trailing block on relationships is kept in the
    data set text. Anything else is refused with a reason, never repaired.
    """
    @F.pandas_udf(_SUMMARY)
    def parse(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_canonical_summary(t or "", set(n)) for t, n in zip(texts, names)], columns=_SUMMARY.names)

    return parse(text, labels)


# -- verdicts --------------------------------------------------------------------

def verdict(answer: Column, yes: str = "Yes", no: str = "No") -> Column:
    """1 when the answer holds the yes word, else 0 when it holds the no word, else null."""
    return F.when(F.contains(answer, F.lit(yes)), 1).when(F.contains(answer, F.lit(no)), 0)


def any_case_verdict(answer: Column) -> Column:
    return verdict(F.lower(answer), "yes", "no")


def guesses(answer: Column) -> Column:
    """Array of (prob, guess): each chunk starting with G that a chunk starting with P follows.

    Only digits and dots of the probability count; none of them means 0, and text
    that is still no number is left out.
    """
    def of_part(part):
        pairs = let(F.split(strip(part), "\n\n"), lambda c: F.arrays_zip(c.alias("g"), F.slice(c, 2, F.size(c)).alias("p")))
        pairs = F.filter(pairs, lambda x: x["g"].startswith("G") & x["p"].startswith("P") & F.contains(x["g"], F.lit(": ")) & F.contains(x["p"], F.lit(": ")))
        return F.transform(pairs, lambda x: F.struct(_number(after_first(x["p"], ": ")).alias("prob"), strip(after_first(x["g"], ": ")).alias("guess")))

    found = F.flatten(F.transform(F.split(answer, SECTION_MARK), of_part))
    return F.filter(found, lambda x: x["prob"].isNotNull())


def _number(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9.]", "")
    return F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double"))


def best_guess(answer: Column) -> Column:
    """The guess with the greatest (probability, text); null without any."""
    return F.array_max(guesses(answer))


_STRICT = StructType([
    StructField("status", StringType()),
    StructField("error", StringType()),
    StructField("normal", StringType()),
    StructField("records", ArrayType(StructType([
        StructField("index", IntegerType()), StructField("guess", StringType()),
        StructField("probability", DoubleType()), StructField("answer", StringType())]))),
])
# Fixed value: a label, with what may stand around it so that near misses are seen.
_LABEL = re.compile(r"([ \t]*)(?:---[ \t]*)?([GP])([0-9]+)(\s*):(.*)", re.S)


def _read_record(guess: str, prob: str, answers) -> tuple[str | None, float, str]:
    """Why a pair of fields is refused, else its probability and answer."""
    if guess.endswith(">") and "<" in guess:
        answer = guess.rstrip(">").rpartition("<")[2]
    else:
        answer = None
    if answer is None or answer not in answers:
        return "answer tag", 0.0, ""
    if SECTION_MARK in guess or any(not line for line in guess.split("\n")):
        return "guess boundary", 0.0, ""
    whole, point, part = prob.partition(".")
    digits = all(c in "0123456789" for c in whole + part)
    if not digits or not (part if point else whole):
        return "probability", 0.0, ""
    return (None, float(prob), answer) if float(prob) <= 1 else ("probability range", 0.0, "")


def _strict(text: str, n: int, answers) -> tuple:
    """Reads line by line: a label opens the next field, other lines belong to the open one."""
    awaited = [f"{kind}{i}" for i in range(1, n + 1) for kind in "GP"]
    fields: list[list[str]] = []
    for line in text.split("\n"):
        label = _LABEL.fullmatch(line)
        if label:
            indent, kind, number, gap, rest = label.groups()
            if len(fields) == len(awaited) or awaited[len(fields)] != kind + number:
                return "rejected", "labels", None, None
            if indent or gap or not rest.startswith((" ", "\t")) or not rest.strip():
                return "rejected", "label form", None, None
            fields.append([rest.strip()])
        elif fields:
            fields[-1].append(line)
        elif line.strip():
            return "rejected", "text before", None, None
    if not fields or len(fields) < len(awaited):
        return "rejected", "labels", None, None
    values = ["\n".join(f).strip().removesuffix(SECTION_MARK).rstrip() for f in fields]
    records = []
    for i in range(n):
        why, p, answer = _read_record(values[2 * i], values[2 * i + 1], answers)
        if why:
            return "rejected", why, None, None
        records.append((i + 1, values[2 * i], p, answer))
    written = [f"{label}: {value}" for label, value in zip(awaited, values)]
    normal = "\n\n---".join("\n\n".join(written[i:i + 2]) for i in range(0, 2 * n, 2))
    same = text.strip() in (normal, "\n\n".join(written))
    return "unchanged" if same else "normalised", None, text if same else normal, records


def strict_guesses(answer: Column, n: int = 2, answers: Sequence[str] = ("yes", "no")) -> Column:
    """Struct (status, error, normal, records): exactly G1, P1 .. Gn, Pn or a rejection with its reason."""
    answers = tuple(answers)

    @F.pandas_udf(_STRICT)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_strict(t or "", n, answers) for t in texts], columns=_STRICT.names)

    return parse(answer)


def probability(answer: Column) -> Column:
    """A reply that is one number from 0 to 1; null otherwise."""
    said = strip(answer)
    p = F.when(said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), said.try_cast("double"))
    return F.when((p >= 0) & (p <= 1), p)


def debate_verdict(p: Column, low: float, high: float, final: bool) -> Column:
    """1 above ``high``, 0 below ``low``, undecided between; after the last round one half decides."""
    early = F.when(p > high, 1).when(p < low, 0)
    return F.coalesce(early, F.when(p > 0.5, 1).when(p < 0.5, 0)) if final else early


# -- citations -------------------------------------------------------------------

def cited_sentences(rows: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, sentence, index) of sentences that end in a [number]; answers need exactly one reference block."""
    blocks = F.split(F.col(text), REFERENCES_HEAD)
    found = F.regexp_extract_all(F.get(blocks, 0), F.lit(r"(?<=[\n.!]).*?\[\d+\]"), F.lit(0))
    cut = rows.where(F.size(blocks) == 2).select(*keys, F.posexplode(found).alias("pos", "_s")).withColumn("_p", F.split("_s", r" \["))
    return cut.where("size(_p) = 2").select(
        *keys, "pos", F.get("_p", 0).alias("sentence"), F.rtrim(F.get("_p", 1), F.lit("]")).cast("int").alias("index"))


def references(rows: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, index, url, source): indexes, urls and quotes of the reference block, by position."""
    blocks = F.split(F.col(text), REFERENCES_HEAD)
    tail = F.get(blocks, 1)
    zipped = F.arrays_zip(
        F.regexp_extract_all(tail, F.lit(r"\[(\d+)\]"), F.lit(1)).alias("index"),
        F.regexp_extract_all(tail, F.lit(r"https://[^\n]+"), F.lit(0)).alias("url"),
        F.regexp_extract_all(tail, F.lit(r"Quoted sentence: (.*?)\n"), F.lit(1)).alias("source"))
    out = rows.where(F.size(blocks) == 2).select(*keys, F.posexplode(zipped).alias("pos", "_r"))
    return out.select(*keys, "pos", F.col("_r.index").cast("int").alias("index"), F.col("_r.url"), F.col("_r.source")).where("index is not null")


def match_references(sentences: DataFrame, refs: DataFrame, keys: Sequence[str], compat: str = "corrected") -> DataFrame:
    """Sentences with what they cite.

    An index listed more than once gives one row per listing; in the released form
    all of them show the last listing.
    """
    if compat == "released":
        r = refs.groupBy(*keys, "index").agg(F.max_by(F.struct("url", "source"), "pos").alias("_r"), F.count("*").alias("_n"))
        both = sentences.join(r, [*keys, "index"]).select(*keys, "pos", "sentence", "index", "_r.url", "_r.source", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i"))
        return both.drop("_i")
    return sentences.join(refs.drop("pos"), [*keys, "index"])


def first_hits(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first hit of each url."""
    return hits.groupBy(*keys, "url").agg(F.min_by(F.struct("title", "snippet", "rank"), "rank").alias("_h")).select(*keys, "url", "_h.*")


def locate_web_info(cited: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cited.join(first_hits(hits, keys), [*keys, "url"])


# -- search results and pages ----------------------------------------------------

SEARCH_SCHEMA = "searchParameters STRUCT<q: STRING>, organic ARRAY<STRUCT<title: STRING, link: STRING, snippet: STRING>>"


def search_hits(rows: DataFrame, response: str, keys: Sequence[str]) -> DataFrame:
    """One row per hit of a JSON search response; absent members become empty text."""
    from rcaspark.functions.names import language_tag

    r = rows.select(*keys, F.from_json(response, SEARCH_SCHEMA).alias("_r"))
    q = F.coalesce("_r.searchParameters.q", F.lit(""))
    out = r.select(*keys, q.alias("query"), language_tag(q).alias("language"), F.coalesce(F.size("_r.organic"), F.lit(0)).alias("n_hits"),
                   F.posexplode("_r.organic").alias("rank", "_h"))
    return out.select(*keys, "query", "language", "n_hits", "rank", *[F.coalesce(f"_h.{c}", F.lit("")).alias(n) for c, n in (("title", "title"), ("link", "url"), ("snippet", "snippet"))])


def not_pdf(url: Column) -> Column:
    return ~url.endswith(".pdf")


def accept_content(narrow: Column, wide: Column) -> Column:
    """The narrow extraction, the wide one when the narrow is short; null unless over 300 characters."""
    content = F.when(F.length(narrow).between(1, 799), wide).otherwise(narrow)
    return F.when(F.length(content) > 300, content)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


# -- chunks ----------------------------------------------------------------------

def fixed_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the one before.

    One linear pass cuts the text into steps; a chunk is a step plus the start of
    what follows. The whole text is covered.
    """
    step = size - overlap
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    if not overlap:
        return pieces
    more = -(-overlap // step)

    def with_start_of_next(steps):
        ahead = lambda i: F.left(F.array_join(F.slice(steps, i + 2, F.lit(more)), ""), F.lit(overlap))
        return F.transform(steps, lambda piece, i: F.concat(piece, ahead(i)))

    chunks = let(pieces, with_start_of_next)
    # A last step that lies wholly inside the chunk before it adds nothing.
    return F.filter(chunks, lambda c, i: (i == 0) | (F.length(c) > overlap))


def _split_at(text: str, size: int, marks: Sequence[str]) -> list[str]:
    """Pieces of at most ``size``, cut at the coarsest mark that helps."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((m for m in marks if m and m in text), "")
    finer = marks[marks.index(mark) + 1:] if mark else []
    if not mark:
        return [text[i:i + size] for i in range(0, len(text), size)]
    out, run = [], ""
    for part in text.split(mark):
        if len(part) > size:
            out += [run] if run.strip() else []
            out, run = out + _split_at(part, size, finer), ""
        elif run and len(run) + len(mark) + len(part) > size:
            out, run = out + [run], part
        else:
            run = run + mark + part if run else part
    return out + ([run] if run.strip() else [])


def separator_chunks(text: Column, size: int = 1000, marks: Sequence[str] = ("\n\n", "\n", " ")) -> Column:
    """Pieces of at most ``size`` characters that end at paragraph, line or word ends where they can."""
    marks = list(marks)

    @F.pandas_udf(ArrayType(StringType()))
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [c.strip() for c in _split_at(t or "", size, marks)])

    return cut(text)
