"""Text generation as resumable table jobs, and the prompts and verdicts around it.

A client is made once per partition by a factory and called as
``client(prompt, system, temperature) -> (text, finish_reason)``.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rcaspark.functions import text as tx
from rcaspark.operators import evidence, logs
from rcaspark.operators.edges import PAIR
from rcaspark.operators.order import full_rank
from rcaspark.operators.profile import GateError
from rcaspark.session import cut_lineage

Client = Callable[[str, str, float], tuple[str, str]]


def coin_client() -> Client:
    """Offline stand-in: yes or no by the prompt's SHA-256."""
    def ask(prompt: str, system: str, temperature: float) -> tuple[str, str]:
        return ("<Yes>" if hashlib.sha256(prompt.encode()).hexdigest()[0] < "8" else "<No>"), "stop"

    return ask


def echo_client() -> Client:
    """Offline stand-in: a digest of the prompt."""
    return lambda prompt, system, temperature: ("digest " + hashlib.sha256(prompt.encode()).hexdigest(), "stop")


def number_client() -> Client:
    """Offline stand-in: a number from 0 to 1 by the prompt's SHA-256."""
    return lambda prompt, system, temperature: (f"{int(hashlib.sha256(prompt.encode()).hexdigest()[:2], 16) / 255:.4f}", "stop")


# -- calls -----------------------------------------------------------------------

def run_calls(prompts: DataFrame, keys: Sequence[str], factory: Callable[[], Client], temperature: float = 0.5, done: DataFrame | None = None) -> DataFrame:
    """One answer row per prompt row (keys, system, prompt): status, text, sizes and seconds.

    An answer that did not stop by itself, or a raised error, is FAILED and not
    repeated. Keys already in ``done`` are left out, so a broken run goes on.
    """
    if done is not None:
        prompts = prompts.join(done.select(*keys).distinct(), list(keys), "left_anti")
    rows = prompts.select(*keys, "system", "prompt")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in keys], *T.StructType.fromDDL(
        "status string, text string, error string, prompt_chars bigint, text_chars bigint, seconds double").fields])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            out = []
            for prompt, system in zip(pdf["prompt"], pdf["system"]):
                began = time.perf_counter()
                try:
                    answer, reason = client(prompt, system, temperature)
                    status, error = ("COMPLETE", None) if reason == "stop" else ("FAILED", f"finish_reason {reason}")
                except Exception as problem:
                    answer, status, error = None, "FAILED", str(problem)
                out.append((status, answer, error, len(prompt), len(answer or ""), time.perf_counter() - began))
            got = pd.DataFrame(out, columns=["status", "text", "error", "prompt_chars", "text_chars", "seconds"], index=pdf.index)
            yield pd.concat([pdf[list(keys)], got], axis=1)

    return rows.mapInPandas(ask, schema)


def record(calls: DataFrame) -> DataFrame:
    """Store answers before anyone reads them, so that none is asked for twice."""
    return cut_lineage(calls)


def complete_only(calls: DataFrame) -> DataFrame:
    """Raise unless every call is COMPLETE."""
    bad = calls.groupBy("status").count().where("status <> 'COMPLETE'").collect()
    if bad:
        raise GateError("calls not complete: " + ", ".join(f"{r['status']} {r['count']}" for r in bad))
    return calls


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of a call store; None where nothing has been committed yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stored_calls(
    prompts: DataFrame, keys: Sequence[str], factory: Callable[[], Client], path: str, temperature: float = 0.5,
    batch: int = 10_000, again: bool = True,
) -> DataFrame:
    """Answers to ``prompts`` by way of a call store: a named table that is only ever appended to.

    What the store has answered completely is not asked again, found by an anti
    join on the keys and a digest of the question; a changed prompt is another
    question. The rest is asked in batches of about ``batch`` prompts, each
    committed by itself, so a run that breaks keeps all but its batch, and the
    next one goes on from there. With ``again`` failed calls are asked once
    more, else they stay as they are. Of several records the last one counts.
    """
    spark, keys = prompts.sparkSession, list(keys)
    same = [*keys, "question"]
    question = F.sha2(F.concat_ws("\n", F.col("system"), F.col("prompt")), 256).alias("question")
    asked = cut_lineage(prompts.select(*keys, "system", "prompt", question))
    held = _stored(spark, path)
    attempt, left = 0, asked
    if held is not None:
        attempt = (held.agg(F.max("attempt")).first()[0] or 0) + 1
        left = asked.join((held.where("status = 'COMPLETE'") if again else held).select(*same).distinct(), same, "left_anti")
    left = cut_lineage(left)
    batches = -(-left.count() // batch)
    for i in range(batches):
        some = left.where(F.pmod(F.xxhash64(*same), F.lit(batches)) == i)
        calls = run_calls(some, same, factory, temperature).withColumn("attempt", F.lit(attempt))
        calls.write.mode("append").parquet(path)
    held = _stored(spark, path)
    if held is None:
        return run_calls(asked, keys, factory, temperature)  # no prompts: no records
    held = held.join(asked.select(*same), same, "left_semi")
    rest = [c for c in held.columns if c not in (*same, "attempt")]
    last = held.groupBy(*same).agg(F.max_by(F.struct(*rest), "attempt").alias("_last"))
    return last.select(*keys, "_last.*")


def admission(prompts: DataFrame, tokens: Column, context: int, reserved: int) -> DataFrame:
    """Whether each whole prompt fits with its reserved output and one spare token; nothing is cut."""
    need = tokens + reserved + 1
    return prompts.withColumn("tokens", tokens).withColumn("required", need).withColumn("fits", need <= context).withColumn(
        "max_output", F.greatest(F.lit(0), context - tokens - 1)).withColumn("status", F.when(need <= context, "ADMITTED").otherwise("BLOCKED_CAPACITY"))


def capacity_curve(prompts: DataFrame, tokens: Column, contexts: Sequence[int], reserved: int) -> DataFrame:
    """How many prompts fit each context size, from one pass."""
    sums = prompts.agg(F.count("*").alias("n"), *[F.count_if(tokens + reserved + 1 <= c).alias(f"_{c}") for c in contexts])
    return sums.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("context"), F.col(f"_{c}").alias("fitting")) for c in contexts])))


def call_statistics(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"),
        F.avg("tokens").alias("mean_tokens"), F.sum("tokens").alias("sum_tokens"), F.sum("seconds").alias("seconds"))


def answer_counts(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    return calls.groupBy(*keys, "text").agg(F.count("*").alias("n"))


# -- pairs and prompts -------------------------------------------------------------

def ordered_pairs(nodes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """All ordered pairs of different entities of a case, or the ``candidates`` (case, cause, effect) among them.

    All pairs are as many as the square of the entities; for large cases give
    candidates, such as neighbours in a skeleton. Positions may have gaps:
    entities are numbered densely here and meet on (case, number), without a
    cross join. ``pos`` itself comes back.
    """
    if candidates is not None:
        at = nodes.select("case", "entity", "pos")
        return candidates.select(*PAIR).distinct().where("cause <> effect").join(
            at.withColumnsRenamed({"entity": "cause", "pos": "cause_pos"}), ["case", "cause"]).join(
            at.withColumnsRenamed({"entity": "effect", "pos": "effect_pos"}), ["case", "effect"])
    numbered = full_rank(nodes.select("case", "entity", "pos"), ["case"], [F.col("pos"), F.col("entity")], "_i")
    size = numbered.groupBy("case").agg(F.max("_i").alias("_n"))
    left = numbered.join(size, "case").select(
        "case", F.col("entity").alias("cause"), F.col("pos").alias("cause_pos"), F.col("_i").alias("_own"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
    right = numbered.select("case", F.col("entity").alias("effect"), F.col("pos").alias("effect_pos"), "_i")
    return left.where("_own <> _i").drop("_own").join(right, ["case", "_i"]).drop("_i")


def with_node_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the texts of both ends."""
    t = texts.select("case", "entity", "text")
    return pairs.join(t.withColumnsRenamed({"entity": "cause", "text": "cause_text"}), ["case", "cause"]).join(
        t.withColumnsRenamed({"entity": "effect", "text": "effect_text"}), ["case", "effect"])


def graph_statements(edges: DataFrame, nodes: DataFrame, compat: str = "corrected") -> DataFrame:
    """A case's graph as sentences. The released text names the ends the wrong way round."""
    at = nodes.select("case", "entity", "pos")
    e = edges.join(at.withColumnsRenamed({"entity": "cause", "pos": "cp"}), ["case", "cause"]).join(at.withColumnsRenamed({"entity": "effect", "pos": "ep"}), ["case", "effect"])
    a, b = ("effect", "cause") if compat == "released" else ("cause", "effect")
    line = F.format_string("%s is the cause of %s.\n", F.col(a), F.col(b))
    return e.groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ep", "cp", line.alias("line")))), lambda x: x["line"]), "").alias("graph_text"))


def explanation_prompts(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, theme: str, algorithm: str, compat: str = "corrected") -> DataFrame:
    """One prompt per ordered pair: data set, graph, node texts where given, task.

    Released prompts repeat the first pair's statement for all pairs, and look for
    the edge in the reversed direction.
    """
    names = nodes.groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"]), ", ").alias("_names"))
    hit = edges.select(*PAIR, F.lit(True).alias("_edge")).distinct()
    if compat == "released":
        hit = edges.where("mark = '->'").select("case", F.col("effect").alias("cause"), F.col("cause").alias("effect"), F.lit(True).alias("_edge")).distinct()
    rows = pairs.join(hit, PAIR, "left").join(names, "case").join(graph_statements(edges, nodes, compat), "case", "left")
    said = F.format_string("It suggests that changes in %s %s %s.\n\n", F.col("cause"), F.when(F.col("_edge"), "directly affect").otherwise("do not directly affect"), F.col("effect"))
    rows = rows.withColumn("_said", said)
    if compat == "released":
        first = rows.groupBy("case").agg(F.min_by("_said", F.struct("cause_pos", "effect_pos")).alias("_said"))
        rows = rows.drop("_said").join(first, "case")
    info = F.lit("")
    if "cause_text" in rows.columns:
        info = F.concat(F.lit("What is known about both:\n"), F.col("cause_text"), F.lit("\n\n"), F.col("effect_text"), F.lit("\n\n"))
    prompt = F.concat(
        F.lit(f"Causal discovery on {theme} with the variables "), F.col("_names"), F.lit(f". The {algorithm} algorithm found:\n"),
        F.coalesce("graph_text", F.lit("")), F.lit("\n"), F.col("_said"), info,
        F.format_string("Explain from domain knowledge whether %s is a cause of %s, and whether the finding is plausible.", F.col("cause"), F.col("effect")))
    return rows.select(*PAIR, F.lit(f"You are an expert in {theme}.").alias("system"), prompt.alias("prompt"))


# The answer forms the parsers expect.
YES_NO_FORM = "Answer with <Yes> or <No> and nothing else."
GUESS_FORM = "Give %d guesses with their probabilities as G1: guess <Yes> or <No>, a blank line, P1: probability, a line of ---, and so on."
NUMBER_FORM = "Answer with one number from 0 to 1 and nothing else."


def _question() -> Column:
    return F.format_string("If %s is changed, does that have a direct effect on %s? ", F.col("cause"), F.col("effect"))


def verdict_prompts(explained: DataFrame, theme: str, form: str = "yes_no", n_guesses: int = 2) -> DataFrame:
    """Ask for a verdict on each explanation (case, cause, effect, text)."""
    ask = YES_NO_FORM if form == "yes_no" else GUESS_FORM % n_guesses
    prompt = F.concat(F.lit(f"An expert in {theme} explains how "), F.col("cause"), F.lit(" and "), F.col("effect"), F.lit(" are related:\n"), F.col("text"), F.lit("\n"), _question(), F.lit(ask))
    return explained.select(*PAIR, F.lit("You help with causal inference.").alias("system"), prompt.alias("prompt"))


def direct_prompts(pairs: DataFrame, theme: str, form: str = "yes_no", with_texts: bool = False, n_guesses: int = 2) -> DataFrame:
    """Ask for a verdict at once, with or without node texts: the single-call variants."""
    ask = YES_NO_FORM if form == "yes_no" else GUESS_FORM % n_guesses
    info = F.concat(F.col("cause_text"), F.lit("\n"), F.col("effect_text"), F.lit("\n")) if with_texts else F.lit("")
    return pairs.select(*PAIR, F.lit(f"You are an expert in {theme}.").alias("system"), F.concat(info, _question(), F.lit(ask)).alias("prompt"))


def verdicts(answers: DataFrame, form: str = "yes_no") -> DataFrame:
    """Answers to the constraint table (case, cause, effect, verdict)."""
    if form == "yes_no":
        v = tx.verdict(F.col("text"))
    elif form == "any_case":
        v = tx.any_case_verdict(F.col("text"))
    else:
        v = tx.verdict(tx.best_guess(F.col("text"))["guess"])
    return answers.select(*PAIR, v.alias("verdict"))


def debate(pairs: DataFrame, theme: str, factory: Callable[[], Client], judge: Callable[[], Client], rounds: int = 3, low: float = 0.2, high: float = 0.8, compat: str = "corrected") -> tuple[DataFrame, DataFrame]:
    """(verdicts, turns) of a debate of at most ``rounds`` rounds per pair.

    A round asks one side for, one against, then a judge for a number. A pair
    leaves as soon as it is decided, so each round works on the undecided ones
    only. The released judge does not see the debate.
    """
    open_ = cut_lineage(pairs.select(*PAIR).withColumn("memory", F.lit("")))
    turns, decided = None, None
    for turn in range(rounds):
        said = open_
        for side, stance in ((0, "supports"), (1, "opposes")):
            q = said.select(*PAIR, F.lit(f"You are an expert in {theme}.").alias("system"), F.concat(
                F.lit("Debate so far:\n"), F.col("memory"), _question(), F.lit(f"Argue as the expert who {stance} it.")).alias("prompt"))
            calls = complete_only(record(run_calls(q, PAIR, factory)))
            speaker = "positive" if side == 0 else "negative"
            said = cut_lineage(said.join(calls.select(*PAIR, "text"), PAIR).withColumn(
                "memory", F.concat("memory", F.lit(f"The {speaker} expert says: "), F.col("text"), F.lit("\n"))).drop("text"))
            mine = calls.select(*PAIR, F.lit(turn * 2 + side).alias("turn"), F.lit(speaker).alias("side"), "text")
            turns = mine if turns is None else turns.unionByName(mine)
        heard = F.lit("") if compat == "released" else F.col("memory")
        q = said.select(*PAIR, F.lit("You judge a debate.").alias("system"), F.concat(heard, _question(), F.lit(NUMBER_FORM)).alias("prompt"))
        marks = complete_only(record(run_calls(q, PAIR, judge))).withColumn("p", tx.probability(F.col("text")))
        if marks.where("p is null").limit(1).count():
            raise GateError("a judge's answer is no number from 0 to 1")
        last = turn == rounds - 1
        judged = cut_lineage(marks.select(*PAIR, "p", tx.debate_verdict(F.col("p"), low, high, last).alias("verdict")))
        settled = judged if last else judged.where("verdict is not null")
        settled = settled.select(*PAIR, "verdict", F.lit(turn + 1).alias("rounds"))
        decided = settled if decided is None else decided.unionByName(settled)
        open_ = cut_lineage(said.join(settled.select(*PAIR), PAIR, "left_anti"))
        if last or not open_.limit(1).count():
            break
    return decided, turns


def replay_debate(turns: DataFrame, judge: Callable[[], Client], low: float = 0.2, high: float = 0.8, compat: str = "corrected") -> DataFrame:
    """(case, cause, effect, verdict, rounds) by judging a debate's recorded ``turns`` again; nobody argues anew.

    ``turns`` is the event log (case, cause, effect, turn, side, text) that
    ``debate`` gives. All rounds of all pairs are put to the judge in one pass;
    the first round that decides a pair counts, and its last recorded round
    decides at half. With the judge and bounds of the debate the verdicts are the same.
    """
    line = F.concat(F.lit("The "), F.col("side"), F.lit(" expert says: "), F.col("text"), F.lit("\n"))
    log = turns.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("log"))
    heard = log.select(*PAIR, (F.size("log") / 2).cast("int").alias("of"), F.col("log.line").alias("lines")).where("of > 0").withColumn(
        "rounds", F.explode(F.sequence(F.lit(1), F.col("of"))))
    memory = F.lit("") if compat == "released" else F.array_join(F.slice("lines", F.lit(1), F.col("rounds") * 2), "")
    q = cut_lineage(heard.select(*PAIR, "rounds", "of", F.lit("You judge a debate.").alias("system"), F.concat(memory, _question(), F.lit(NUMBER_FORM)).alias("prompt")))
    marks = complete_only(record(run_calls(q, [*PAIR, "rounds", "of"], judge))).withColumn("p", tx.probability(F.col("text")))
    if marks.where("p is null").limit(1).count():
        raise GateError("a judge's answer is no number from 0 to 1")
    verdict = F.when(F.col("rounds") == F.col("of"), tx.debate_verdict(F.col("p"), low, high, True)).otherwise(tx.debate_verdict(F.col("p"), low, high, False))
    judged = marks.withColumn("verdict", verdict).where("verdict is not null or rounds = of")
    return judged.groupBy(*PAIR).agg(F.min_by("verdict", "rounds").alias("verdict"), F.min("rounds").alias("rounds"))


# -- entity summaries ----------------------------------------------------------------

def summary_prompts(log_texts: DataFrame, nodes: DataFrame, theme: str) -> DataFrame:
    """One prompt per entity; ``log_text`` stays a column, so the rest can be rebuilt for another entity list."""
    names = nodes.groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"]), ", ").alias("_names"))
    prompt = F.concat(
        F.lit(f"Entities of a {theme}:\n\n"), F.col("_names"), F.lit("\n\nLog events of "), F.col("entity"), F.lit(", each with examples:\n\n"),
        F.col("log_text"), F.lit("\nSummarise the role, key events (frequent and rare), status and likely relations of "), F.col("entity"), F.lit("."))
    return log_texts.join(names, "case").select("case", "entity", "log_text", F.lit(f"You are an expert in {theme} and read log files.").alias("system"), prompt.alias("prompt"))


def entity_summaries(plan: DataFrame, templates: DataFrame, lines: DataFrame, theme: str, factory: Callable[[], Client], done: DataFrame | None = None) -> DataFrame:
    """Plan texts with generated summaries; only entities with evidence reach the generator."""
    present = plan.where("available").select("case", "entity")
    pick = lambda t: t.join(present, ["case", "entity"], "left_semi")
    prompts = summary_prompts(logs.log_text(pick(templates), pick(lines)), plan.select("case", "entity", "pos"), theme)
    calls = complete_only(record(run_calls(prompts, ["case", "entity"], factory, done=done)))
    made = calls.select("case", "entity", "text")
    if done is not None:
        made = made.unionByName(done.select("case", "entity", "text"))
    return evidence.merge_summaries(plan, made)


def narrowed_prompts(prompts: DataFrame, nodes: DataFrame, theme: str) -> DataFrame:
    """The same captured log texts under a shorter entity list."""
    kept = prompts.join(nodes.select("case", "entity"), ["case", "entity"], "left_semi")
    return summary_prompts(kept.select("case", "entity", "log_text"), nodes, theme)
