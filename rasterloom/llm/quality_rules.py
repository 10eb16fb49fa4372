"""Quality rules of a document, and of its host, by DataFrame operations only.

The base rules count, in each whole text, words, symbols, repeated lines and words
in repeated three-word windows. A document fails if it is short or repetitive.
Failures are then added up by host; a host's rate is shrunk towards the rate of all
hosts by a beta prior fitted to the hosts' rates (method of moments), so that a host
with a few documents isn't judged on them alone. A host goes, with all its documents,
if its odds of failing are over ``TIMES_ODDS`` times those of all documents beyond
reasonable doubt: the limit lies more than ``DEVIATIONS`` standard deviations of the
host's beta posterior below its shrunk rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import NOT_SPACE, SPACE_CHARS, unlike, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: 1.645 standard deviations are a posterior probability of about 0.95.
TIMES_ODDS, DEVIATIONS = 2.0, 1.645
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _one(**columns: Column) -> Column:
    """A generator of one row. Unlike a projection it is never merged with the one above, so
    an array computed here is computed once, also where a lambda above reads it for each element."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def base_rules(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry, and the base counts of each row's whole text; a null text has no words.

    No shuffle: each count is made from the row's own arrays. Windows are compared by
    64-bit hashes; only texts in which some window repeats go on to the sort that tells
    which words the repeated windows cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    own = [F.col(f"`{c}`") for c in carry]
    df = docs.select(*own, text.alias("text"))
    df = df.select(
        *own,
        _one(
            w=words(F.col("text")),
            lines=lines,
            word_chars=F.length(F.translate("text", SPACE_CHARS, "")).cast("long"),
            n_symbols=(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        ),
    )
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.slice("w", 1, n - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    df = df.select(
        *own,
        "word_chars",
        "n_symbols",
        _one(
            n_words=n.cast("long"),
            n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            windows=F.coalesce(windows, F.array().cast("array<bigint>")),
        ),
    )
    some = F.size("windows") > F.size(F.array_distinct("windows"))
    ordered = F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select(*own, "word_chars", "n_symbols", "n_words", "n_dup_lines", _one(s=ordered))
    same = lambda x, j: (F.get("s", j)["h"] == x["h"])
    hit = F.transform("s", lambda x, j: F.when(F.coalesce(same(x, j + 1), F.lit(False)) | (j > 0) & F.coalesce(same(x, F.greatest(j - 1, F.lit(0))), F.lit(False)), x["i"]))
    df = df.select(*own, "word_chars", "n_symbols", "n_words", "n_dup_lines", _one(p=F.array_sort(F.array_compact(hit))))
    # Each window covers three words, or as many as there are up to the next one's start.
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(docs: DataFrame, host: str = "source") -> DataFrame:
    """host, n, failed, rate and goes: failures by host, shrunk by the beta prior of all hosts, and
    whether the host's posterior lies beyond the limit that the prior's mean gives.

    The prior's mean is the rate over all documents and its weight comes from the
    variance of the hosts' rates beyond that of drawing so many documents; where there
    is no such excess (or one host) the weight is a host's mean count of documents.
    """
    by = docs.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    p = F.col("failed") / F.col("n")
    mean = F.col("all_failed") / F.col("all_n")
    prior = (
        by.agg(F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * p * p).alias("squares"))
        .select("*", mean.alias("mean"), (F.col("squares") / F.col("all_n") - mean * mean).alias("variance"), (F.col("hosts") / F.col("all_n")).alias("drawn"))
        .select("mean", (F.col("variance") - F.col("mean") * (1 - F.col("mean")) * F.col("drawn")).alias("excess"), (F.col("all_n") / F.col("hosts")).alias("usual"))
        .select("mean", F.when(F.col("excess") > 0, F.greatest(F.lit(1.0), F.col("mean") * (1 - F.col("mean")) / F.col("excess") - 1)).otherwise(F.col("usual")).alias("weight"))
    )
    rate = (F.col("failed") + F.col("weight") * F.col("mean")) / (F.col("n") + F.col("weight"))
    doubt = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    limit = TIMES_ODDS * F.col("mean") / (1 + (TIMES_ODDS - 1) * F.col("mean"))
    # The prior is one row.
    found = by.join(F.broadcast(prior)).withColumn("rate", rate)
    return found.select(F.col(f"`{host}`"), "n", "failed", "rate", (F.col("rate") - DEVIATIONS * doubt > limit).alias("goes"))


def judge(docs: DataFrame, host: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, the base counts, base_failed, host_rate and kept for each row.

    A null text has no words and fails. A null host is one host of its own. Repeated
    rows are judged each; an empty table gives no rows; other columns aren't read.
    The counts are made once, written, and read twice: the join by host is one of
    small rows, whose hot hosts adaptive execution splits.
    """
    names = list(dict.fromkeys([*carry, host]))
    rows = written(base_rules(docs, names).withColumn("base_failed", base_failed()), "quality-rules")
    named = unlike(rows.columns, "host")
    hosts = host_rates(rows, host).select(F.col(f"`{host}`").alias(named), F.col("rate").alias("host_rate"), "goes")
    found = rows.join(hosts, F.col(f"`{host}`").eqNullSafe(F.col(named)), "left")
    kept = ~F.col("base_failed") & ~F.col("goes")
    return found.select(*carry, *BASE, "base_failed", "host_rate", kept.alias("kept"))


def only_kept(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that are kept, unchanged. Verdicts meet rows by host and 128 bits of the
    text, on which alone they depend; so rows without a doc_id are judged like any other. Nulls,
    repeated rows and empty tables are as in judge(); other columns may have any name."""
    keys = [F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))]
    own = [unlike(docs.columns, n) for n in ("key_a", "key_b", "judged_host")]
    hashed = docs.select(*[k.alias(n) for k, n in zip(keys, own)], "text", F.col(f"`{host}`").alias(own[2]))
    kept = judge(hashed, own[2], tuple(own)).where("kept").select(*own).distinct()
    return docs.join(kept, (keys[0] == F.col(own[0])) & (keys[1] == F.col(own[1])) & F.col(f"`{host}`").eqNullSafe(F.col(own[2])), "left_semi")


#: judge() with its defaults in DuckDB; host_rate is rounded in the query, as sums may differ in their last bits.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(3) r(k) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM f GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS mean, sum(n * (failed / n) * (failed / n)) / sum(n) - (sum(failed) / sum(n)) ** 2 AS variance, count(*) / sum(n) AS drawn, sum(n) / count(*) AS usual FROM h),
w AS (SELECT mean, 2 * mean / (1 + mean) AS bound, CASE WHEN variance - mean * (1 - mean) * drawn > 0 THEN greatest(1, mean * (1 - mean) / (variance - mean * (1 - mean) * drawn) - 1) ELSE usual END AS weight FROM m),
v AS (SELECT source, n, weight, bound, (failed + weight * mean) / (n + weight) AS rate FROM h, w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate,
       NOT base_failed AND NOT rate - 1.645 * sqrt(rate * (1 - rate) / (n + weight + 1)) > bound AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
