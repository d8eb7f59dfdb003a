"""Quality rules as weak supervision (native).

Each rule votes for (1) or against (-1) a document or abstains (0).
Expectation-maximisation over the counts of vote patterns estimates how
often each rule is right on good and on bad documents and how common good
ones are. Most kinds of bad documents are seen by two rules that look at different things (symbols and the share of short words, capitals
and shouting), whose agreement tells a rule that is right from one that isn't. A document is
kept when its posterior probability of being good reaches one half,
instead of having to pass every rule.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, let, stage, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Code points of a short word: most are words that hold a sentence together.
SHORT = 3
ROUNDS = 30
#: Where estimation starts: share of good documents, and how often a vote is right on good and on bad ones.
PRIOR, GOOD, BAD = 0.8, 0.99, 0.4
#: Bounds of the estimates: a rule is no worse than chance on good documents; of bad ones it may see a few only.
LEAST_GOOD, LEAST_BAD = 0.5, 0.05
#: name, expression, (good from, good to), (bad below, bad above); between the two a rule abstains.
RULES = (
    ("length", "n_words", (50, None), (20, None)),
    ("word_length", "word_chars / n_words", (2.5, 9), (2, 14)),
    ("symbols", "n_symbols / n_words", (None, 0.02), (None, 0.1)),
    ("short_words", "n_short / n_words", (0.2, 0.43), (0.12, 0.47)),
    ("line_repeats", "n_dup_lines / n_lines", (None, 0.05), (None, 0.3)),
    ("word_repeats", "n_repeat_words / n_words", (None, 0.05), (None, 0.2)),
    ("capitals", "n_capitals / n_words", (None, 0.5), (None, 1.5)),
    ("shouting", "n_shouts / n_words", (None, 0.05), (None, 0.3)),
)


def _n_repeat_words(words: Column) -> Column:
    """Words inside windows of 8 that the text holds twice or more."""
    zero = F.lit(0).cast("long")

    def cover(starts: Column) -> Column:
        # sorted starts: each window adds the words before the next one starts
        steps = F.transform(starts, lambda s, i: F.when(i + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, i + 1) - s)).otherwise(F.lit(WINDOW)))
        return F.aggregate(steps, zero, lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        def same(x, y):
            return y.isNotNull() & (x["h"] == y["h"]) & (F.slice(words, x["i"] + 1, WINDOW) == F.slice(words, y["i"] + 1, WINDOW))

        twice = F.filter(pairs, lambda x, j: F.coalesce(same(x, F.get(pairs, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(pairs, j - 1)), F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), cover)

    def of(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(pairs, repeated))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, zero).otherwise(let(hashes, of))


def signals(text: Column) -> Column:
    """The counts that the rules look at, as one struct."""
    text = F.coalesce(text, F.lit(""))

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    n_chars = F.length(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    words = F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))
    line_part = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_part = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _n_repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.length(x) <= SHORT)).cast("long").alias("n_short")))
    return let(F.struct(line_part.alias("l"), word_part.alias("w")), lambda x: F.struct(
        x["w"]["n_words"].alias("n_words"), (n_chars - without(" \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"), x["l"]["n_dup_lines"].alias("n_dup_lines"), x["w"]["n_repeat_words"].alias("n_repeat_words"),
        x["l"]["n_lines"].alias("n_lines"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"), without("!?").cast("long").alias("n_shouts"),
        x["w"]["n_short"].alias("n_short"),
    ))


def _vote_sql(rule, prefix: str = "") -> str:
    _, value, (low, high), (bad_low, bad_high) = rule
    good = [f"{value} >= {low}"] * (low is not None) + [f"{value} <= {high}"] * (high is not None)
    bad = [f"{value} < {bad_low}"] * (bad_low is not None) + [f"{value} > {bad_high}"] * (bad_high is not None)
    empty = -1 if rule[0] == "length" else 0  # without words there is nothing to divide by
    return f"CASE WHEN n_words = 0 THEN {empty} WHEN {' OR '.join(bad)} THEN -1 WHEN {' AND '.join(good)} THEN 1 ELSE 0 END"


def fit(votes: DataFrame, rules=RULES, rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """(prior, accuracies on good, accuracies on bad) by expectation-maximisation.

    votes: one column v, an array of the rules' votes. Runs as one SQL
    expression over at most 3 ** len(rules) counted patterns; an empty
    table leaves the smoothed starting values.
    """
    k = len(rules)
    patterns = votes.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    packed = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))
    weigh = "CASE x.v[j] WHEN 1 THEN ln(m.good[j] / (1D - m.bad[j])) WHEN -1 THEN ln((1D - m.good[j]) / m.bad[j]) ELSE 0D END"
    odds = f"aggregate(sequence(0, {k - 1}), ln(m.prior / (1D - m.prior)), (s, j) -> s + {weigh})"
    expect = f"transform(p, x -> named_struct('v', x.v, 'n', x.n, 'q', 1D / (1D + exp(-({odds})))))"

    def rate(vote: int, q: str, start: float, least: float) -> str:
        right = f"aggregate(e, 0D, (s, x) -> s + x.n * IF(x.v[j] = {vote}, {q}, 0D))"
        cast = f"aggregate(e, 0D, (s, x) -> s + x.n * abs(x.v[j]) * {q})"
        return f"transform(sequence(0, {k - 1}), j -> greatest({least}D, least(0.999D, ({right} + {10 * start}D) / ({cast} + 10D))))"

    prior = f"greatest(0.01D, least(0.99D, (aggregate(e, 0D, (s, x) -> s + x.n * x.q) + {10 * PRIOR}D) / (aggregate(e, 0D, (s, x) -> s + x.n) + 10D)))"
    step = f"transform(array({expect}), e -> named_struct('prior', {prior}, 'good', {rate(1, 'x.q', GOOD, LEAST_GOOD)}, 'bad', {rate(-1, '(1D - x.q)', BAD, LEAST_BAD)}))[0]"
    start = f"named_struct('prior', {PRIOR}D, 'good', array_repeat({GOOD}D, {k}), 'bad', array_repeat({BAD}D, {k}))"
    m = packed.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> {step})").alias("m")).first()["m"]
    return m["prior"], list(m["good"]), list(m["bad"])


SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_short")


def judge(docs: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """docs plus the struct `quality`: the signals, votes, posterior, base_failed and kept.

    Null text is empty: no words, so the base rule fails. Rows are judged
    one by one against the one model, so repeated rows agree; an empty
    table stays empty; other columns pass through, whatever their names, and one called quality is replaced.
    """
    plain = [c for c in docs.columns if c != "quality"]
    return judge_signals(docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"), signals(docs["text"]).alias("quality_signals")), rules, rounds)


def judge_signals(seen: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """Like judge(), from the columns row, a struct, and quality_signals, which signals() made."""
    vote = F.array(*[F.expr(_in_struct(_vote_sql(r), SIGNALS)) for r in rules])
    prior, good, bad = fit(seen.select(vote.alias("v")), rules, rounds)
    seen = seen.withColumn("votes", vote)
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, (g, b) in enumerate(zip(good, bad, strict=True)):
        v = F.col("votes")[j]
        odds = odds + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-odds))
    s = F.col("quality_signals")
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    quality = F.struct("quality_signals.*", "votes", posterior.alias("posterior"), failed.alias("base_failed"), (~failed & (posterior >= 0.5)).alias("kept"))
    return seen.select("row.*", quality.alias("quality"))


def _in_struct(sql: str, names) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", r"quality_signals.\1", sql)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the counts are read twice, by the estimation and by the verdicts; texts only once
    seen = stage(docs.select(F.struct("doc_id").alias("row"), signals(docs["text"]).alias("quality_signals")), "signals")
    return judge_signals(seen).select("doc_id", *[f"quality.{c}" for c in BASE])


def sql() -> str:
    k = len(RULES)
    votes = ", ".join(f"({_vote_sql(r)})::INT AS v{j}" for j, r in enumerate(RULES))
    vs = ", ".join(f"v{j}" for j in range(k))
    leads = ", ".join(f"lead(w, {j}) OVER o" for j in range(1, WINDOW))
    odds = " + ".join(["ln(prior / (1 - prior))"] + [f"CASE v{j} WHEN 1 THEN ln(g{j} / (1 - b{j})) WHEN -1 THEN ln((1 - g{j}) / b{j}) ELSE 0 END" for j in range(k)])
    rate = "greatest({least}, least(0.999, (sum(n * CASE v{j} WHEN {vote} THEN {q} ELSE 0 END) + {start}) / (sum(n * abs(v{j}) * {q}) + 10)))::DOUBLE AS {name}{j}"
    step = ", ".join([rate.format(j=j, vote=1, q="q", start=10 * GOOD, least=LEAST_GOOD, name="g") for j in range(k)] + [rate.format(j=j, vote=-1, q="(1 - q)", start=10 * BAD, least=LEAST_BAD, name="b") for j in range(k)])
    begin = ", ".join([f"{GOOD}::DOUBLE AS g{j}" for j in range(k)] + [f"{BAD}::DOUBLE AS b{j}" for j in range(k)])
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM base
), placed AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM worded WHERE len(words) > {WINDOW}
), windows AS (
  SELECT doc_id, i, concat_ws(' ', w, {leads}) AS k, lead(w, {WINDOW - 1}) OVER o AS ending FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), keyed AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows WHERE ending IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT w)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS w FROM keyed WHERE c > 1) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals, (length(text) - length(translate(text, '!?', '')))::BIGINT AS n_shouts,
    len(list_filter(words, lambda x: length(x) <= {SHORT}))::BIGINT AS n_short
  FROM worded d LEFT JOIN covered c USING (doc_id)
), voted AS (SELECT *, {votes} FROM s
), patterns AS (SELECT {vs}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL
), em AS (
  SELECT 0 AS it, {PRIOR}::DOUBLE AS prior, {begin}
  UNION ALL
  SELECT it + 1, greatest(0.01, least(0.99, (sum(n * q) + {10 * PRIOR}) / (sum(n) + 10)))::DOUBLE AS prior, {step}
  FROM (SELECT em.*, p.*, 1 / (1 + exp(-({odds}))) AS q FROM em, patterns p WHERE it < {ROUNDS}) GROUP BY it
), model AS (SELECT * FROM em WHERE it = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM voted, model"""
