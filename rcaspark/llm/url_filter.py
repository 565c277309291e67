"""URL filters: explicit rules first, then empirical-Bayes reputation of hosts; DataFrame functions only.

Pages with outcomes give each host a count of bad pages. Outcomes come from a model of words: naive Bayes over hashed
words and runs of symbols, fitted on labelled documents and applied to the text of every page. Rates are shrunk through beta-binomial priors: a host
towards its registered domain, a domain towards its suffix, a suffix towards all pages. How strongly follows from the
spread between groups at each level (method of moments). A host is blocked when the lower bound of its posterior
rate of bad pages lies over a limit, so a few bad pages do not condemn a host that little is known of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Suffixes of two labels, beside which the last label is the suffix.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk"]
#: Hash buckets of the word model, and words that weigh as a prior in each.
BUCKETS, SMOOTHING = 1 << 14, 0.5
#: Labelled documents that the model is fitted on at most, the smallest hashes of ids first.
LABELLED_ROWS = 20_000
#: Blocked if the posterior rate of bad pages is over LIMIT with this many standard deviations to spare.
LIMIT, DEVIATIONS = 0.5, 1.64
#: Pages that a prior weighs at least and at most.
LEAST_PRIOR, MOST_PRIOR = 5.0, 100.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains where the path starts with its own.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
               F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    wide = two.isin(TWO_LABEL_SUFFIXES)
    return F.when(wide, three).otherwise(two), F.when(wide, two).otherwise(F.element_at(labels, -1))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pages that a level's prior weighs: the method of moments for beta-binomial counts around given means.

    ``groups`` holds n and bad. With within-group variance m(1-m)/n, what spread is left is that of the rates; the
    prior's strength is m(1-m)/spread - 1, held between two bounds.
    """
    spread = groups.where("n > 0").select(
        (F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)).alias("seen"), (mean * (1 - mean)).alias("own"),
        F.col("n").cast("double").alias("n")).agg(F.sum("seen"), F.sum("own"), F.sum("n"), F.sum(F.col("own") * F.col("n"))).first()
    seen, own, n, weighted = (float(x or 0) for x in spread)
    if not n:
        return LEAST_PRIOR
    left = (seen - own) / n
    return min(MOST_PRIOR, max(LEAST_PRIOR, weighted / n / left - 1)) if left > 0 else MOST_PRIOR


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound) for each host of ``outcomes`` (host, bad: boolean or null if unknown).

    rate is the posterior mean of the share of bad pages, bound its lower
    bound. Hosts without known outcomes have their domain's rate with the
    prior's width. Without any known outcome rates are 0.5 with the widest
    prior, whose bound blocks nothing.
    """
    domain, suffix = _levels(F.col("host"))
    hosts = cut_lineage(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix}))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    everywhere = F.lit((float(bad or 0) + 0.5) / (float(n or 0) + 1.0))

    k = _strength(suffixes, everywhere)
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * everywhere) / (F.col("n") + k)).alias("suffix_rate"))
    domains = cut_lineage(domains.join(suffixes, "suffix"))
    k = _strength(domains, F.col("suffix_rate"))
    domains = domains.select("domain", ((F.col("bad") + k * F.col("suffix_rate")) / (F.col("n") + k)).alias("domain_rate"))
    hosts = cut_lineage(hosts.join(domains, "domain"))
    k = _strength(hosts, F.col("domain_rate"))
    a, b = F.col("bad") + k * F.col("domain_rate"), F.col("n") - F.col("bad") + k * (1 - F.col("domain_rate"))
    rate = a / (a + b)
    return hosts.select("host", "n", "bad", rate.alias("rate"), (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (a + b + 1))).alias("bound"))


def _buckets(text: Column) -> Column:
    """The bucket of every word and run of symbols of a text, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"), F.lit(0))
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def word_model(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, weight): what a word in each bucket says for a bad text, as log odds; ``BUCKETS`` rows at most.

    ``labels`` (doc_id, quality) call a text good with 1 and bad with 0; the
    labelled rows of ``documents`` (doc_id, text) count as much as they have
    words, at most ``LABELLED_ROWS`` ids. Conflicting labels of one document
    count as bad; null ids and labels say nothing. Without texts of both kinds
    there is no model.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    # A bounded table of ids, so no text is shuffled.
    words = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select((F.col("quality") == 0).alias("bad"), F.explode(_buckets(F.col("text"))).alias("bucket"))
    counts = cut_lineage(words.groupBy("bucket").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")))
    bad, good = counts.agg(F.sum("bad"), F.sum("good")).first()
    if not bad or not good:
        return counts.where("false").select("bucket", F.lit(0.0).alias("weight"))
    share = lambda name, total: (F.col(name) + SMOOTHING) / float(total + SMOOTHING * BUCKETS)
    return cut_lineage(counts.select("bucket", (F.log(share("bad", bad)) - F.log(share("good", good))).alias("weight")))


def page_text(html: Column) -> Column:
    """A page's text without scripts, styles and markup; rough, for its words only."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"<[^<>]*+>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    return bare


def learned_outcomes(pages: DataFrame, model: DataFrame) -> DataFrame:
    """(host, bad) of every page (url, html): bad where the weights of its text's words are over 0 in sum.

    A page without words is bad, and a null page has none; its url may still be
    null. Words that the model does not know say nothing; a page of such words
    alone, and every page where there is no model, has an unknown outcome.
    """
    # Pages are numbered before their words are listed; in one step each word would get a number.
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), host_of(F.col("url")).alias("host"), _buckets(page_text(F.col("html"))).alias("buckets"))
    words = numbered.select("row", "host", F.explode_outer("buckets").alias("bucket"))
    rated = words.join(F.broadcast(model), "bucket", "left")  # at most BUCKETS rows
    whole = rated.groupBy("row").agg(F.first("host").alias("host"), F.count("bucket").alias("words"), F.sum("weight").alias("weight"))
    blank = F.lit(True) if model.limit(1).count() else F.lit(None).cast("boolean")
    return whole.select("host", F.when(F.col("words") == 0, blank).otherwise(F.col("weight") > 0).alias("bad"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], outcomes: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, bound) for every row of ``pages`` (page_id, url).

    The longest fitting rule decides, else the host's reputation: block if its
    bound is over ``LIMIT``, else allow. ``outcomes`` are (host, bad), bad null
    where unknown, see ``learned_outcomes``. The rules are policy and say
    nothing of a host. Null urls and ones without :// have empty hosts and
    paths, no rule, and are one host for reputation. Repeated rows each count;
    other columns are ignored; an empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = cut_lineage(seen.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "best.rule", F.col("best.verdict").alias("ruled")))
    # Hosts that only the pages know are rated by their domains.
    known = outcomes.select("host", "bad").unionByName(seen.select("host", F.lit(None).cast("boolean").alias("bad")))
    held = cut_lineage(reputation(known).select("host", "rate", "bound"))
    return seen.join(held, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bound") > LIMIT, "block").otherwise("allow")).alias("verdict"), "rate", "bound")
