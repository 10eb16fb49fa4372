"""URL verdicts by rules, and by naive Bayes over segmented host and path words.

Hosts are cut at dots and hyphens, paths at everything but letters and digits. A name is
then split into words by Viterbi under a unigram model of the corpus: counts of all words
of ``documents``. Only words that occur in some name are needed, so the names' substrings
(bounded by the names' lengths) are joined with the counts; no dictionary is broadcast.

Multinomial naive Bayes compares the tokens of unwanted and of other sites. A host counts
once, and so does a path shape in each class that it occurs in, however many pages they
have: a host that has a third of all pages can't vouch for itself. A host is unwanted if a
word of its name is a seed (``SEEDS``, the ``UNWANTED`` words that are not ``AMBIGUOUS``),
or if at least half of its path shapes have one; a shape is unwanted if it has a seed or
is of such a host. So the tokens beside seeds are learned from the pages, and a site
without any seed or learned token is allowed. Seeds count as
``LISTED_COUNTS`` more unwanted tokens. Counts are smoothed by ``SMOOTHING`` tokens dealt as the classes are: a
token that nothing is known of has a log ratio of 0. Hosts and paths have counts of their
own. Rules do not train either class: they block by place and language, not by what a site
is. Without a rule a page is blocked if the prior (the classes' hosts) and its tokens' log
ratios sum to over 0. Scores of hosts and of path shapes are made once for each distinct
one and joined back: those of hosts and shapes with over 1/``HOT_PARTS`` of all pages by
broadcast (fewer than ``HOT_PARTS`` rows, whatever the input), all others by a shuffle in
which the pages of the hot ones are dealt by page.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import prefer_names, words, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD = 20


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the start of a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Words of hosts and paths that tell unwanted sites.
UNWANTED = (
    "ads", "adult", "bait", "banner", "bets", "betting", "bonus", "casino", "cheap", "click", "crack", "dating",
    "escort", "farm", "free", "gambling", "jackpot", "keygen", "loans", "lottery", "malware", "pharmacy", "phish",
    "pills", "poker", "popup", "porn", "replica", "sex", "slots", "spam", "torrent", "track", "viagra", "warez",
    "win", "winner", "xxx",
)
#: Listed words that ordinary names have too: they only count as what the pages teach of them.
AMBIGUOUS = ("bait", "banner", "bonus", "cheap", "click", "crack", "farm", "free", "replica", "slots", "track", "win", "winner")
SEEDS = tuple(w for w in UNWANTED if w not in AMBIGUOUS)
LISTED_COUNTS, SMOOTHING = 20, 4.0
#: So often does each listed word count where names are split.
LISTED_COUNT = 1000
#: A host or path shape is hot with over this part of all pages.
HOT_PARTS = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. Of rules of one length, the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name), reverse=True)[::-1]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_names(host: Column) -> Column:
    """A host's names, those of its last label too."""
    return F.array_remove(F.split(host, "[^\\p{L}\\p{N}]+"), "")


def path_shape(path: Column) -> Column:
    """The path's names, lower-cased, digits as #, so that numbered pages share one shape."""
    return F.array_join(F.array_remove(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "#"), "[^\\p{L}\\p{N}#]+"), ""), " ")


def unigrams(texts: DataFrame) -> DataFrame:
    """(word, n) over all of texts: lower-case words of letters alone, punctuation at their ends dropped."""
    found = texts.select(F.explode(words(F.lower(F.col("text")))).alias("w"))
    found = found.select(F.regexp_replace("w", "^[^\\p{L}]+|[^\\p{L}]+$", "").alias("word")).where("word <> ''")
    return found.where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(name: str, counts: dict[str, int], total: float) -> list[str]:
    """The most likely words; an unknown piece of n letters has the probability 10 / (total * 10**n).
    Of equally likely splits, that with the longest last words."""
    if total <= 0:
        return [name] if name else []
    best = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for begin in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(name[begin:end], 0)
            cost = math.log(total / n) if n else math.log(total / 10) + (end - begin) * math.log(10)
            options.append((best[begin][0] + cost, begin))
        best.append(min(options))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, tokens) for each of names (distinct, not empty)."""
    spark = names.sparkSession
    listed = spark.createDataFrame([(w, LISTED_COUNT) for w in UNWANTED], "word string, n long")
    counts = written(counts.unionByName(listed).groupBy("word").agg(F.sum("n").alias("n")), "unigrams")
    n = F.length("name")
    pieces = names.select("name", F.explode(F.sequence(F.lit(1), n)).alias("begin")).select("name", "begin", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), n - F.col("begin") + 1))).alias("size"))
    pieces = pieces.select("name", F.substring("name", F.col("begin"), F.col("size")).alias("word")).distinct()
    known = pieces.join(counts, "word").groupBy("name").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))
    total = counts.agg(F.sum("n")).first()[0]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            tokens = [viterbi(name, dict(zip(ws or (), ns or ())), total) for name, ws, ns in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["name", "tokens"])

    return names.join(known, "name", "left").select("name", "words", "ns").mapInArrow(run, "name string, tokens array<string>")


def with_scores(rows: DataFrame, scores: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows with the columns of scores (one row a key at most), null where a key has none.

    counts has the pages of each key, in one row or more. A hot key meets its rows where
    they are, so that no task gets more than its share of them.
    """
    own = [c for c in scores.columns if c != key]
    total = counts.agg(F.sum("pages")).first()[0] or 0
    hot = counts.groupBy(key).agg(F.sum("pages").alias("pages")).where(F.col("pages") * HOT_PARTS > total).select(key)
    hot = hot.join(scores, key, "left").select(key, F.struct(*own).alias("hot"))
    rows = rows.join(F.broadcast(hot), key, "left")
    deal = F.when(F.col("hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 20)))
    rows = rows.withColumn("deal", deal.cast("long")).join(scores.withColumn("deal", F.lit(0).cast("long")), [key, "deal"], "left")
    return rows.select(*[F.coalesce(F.col(f"hot.{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in rows.columns if c not in ("hot", "deal")])


def judge(pages: DataFrame, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and tokens for each row of pages.

    A null url, or one without ``://``, has an empty host and path, no rule and no tokens,
    and a score of 0: it is allowed. score is the log ratio of block to allow, prior included. Repeated rows are judged alike; a null page_id is
    kept. Empty pages give no rows; without texts, names are single words. Other columns
    are not read.
    """
    host, path = split_url(F.col("url"))
    rows = prefer_names(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), path_shape(F.col("path")).alias("shape"))
    shapes = written(rows.groupBy("host", "shape", "ruled").agg(F.count(F.lit(1)).alias("pages")), "url-shapes")
    hosts = shapes.select("host").distinct().withColumn("names", host_names(F.col("host")))
    paths = shapes.select("shape").distinct().withColumn("names", F.array_remove(F.split("shape", " "), ""))
    names = hosts.select(F.explode("names").alias("name")).unionByName(paths.select(F.explode("names").alias("name"))).distinct()
    tokens = written(segment(names, unigrams(prefer_names(texts, "text"))), "url-tokens")

    def tokens_of(owners: DataFrame, key: str) -> DataFrame:
        """key, token, n: counts of an owner's tokens."""
        found = owners.select(key, F.explode("names").alias("name")).join(tokens, "name").select(key, F.explode("tokens").alias("token"))
        return found.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))

    host_tokens, path_tokens = written(tokens_of(hosts, "host"), "host-tokens"), written(tokens_of(paths, "shape"), "path-tokens")
    # What rules block trains neither class. One row a host and shape, whatever its pages.
    taught = shapes.where("ruled is null or ruled <> 'block'").select("host", "shape").distinct()
    listed = F.col("token").isin(*SEEDS)
    of_listed = lambda own, key: own.where(listed).select(key, F.lit(True).alias(f"{key}_listed")).distinct()
    taught = taught.join(of_listed(path_tokens, "shape"), "shape", "left").select("host", "shape", F.coalesce("shape_listed", F.lit(False)).alias("shape_listed"))
    sites = taught.groupBy("host").agg(F.avg(F.col("shape_listed").cast("int")).alias("share")).join(of_listed(host_tokens, "host"), "host", "left")
    sites = written(sites.select("host", (F.coalesce("host_listed", F.lit(False)) | (F.col("share") >= 0.5)).alias("bad")), "url-sites")
    both = taught.join(sites, "host").withColumn("bad", F.col("bad") | F.col("shape_listed")).groupBy("shape")
    both = both.agg(F.max(F.col("bad").cast("int")).alias("block"), F.max((~F.col("bad")).cast("int")).alias("allow"))
    sites_as = sites.select("host", F.col("bad").cast("int").alias("block"), (~F.col("bad")).cast("int").alias("allow"))
    seen = [owners.join(own, key).select(F.lit(key).alias("field"), "token", *[(F.col(c) * F.col("n")).alias(c) for c in ("block", "allow")]) for key, owners, own in (("host", sites_as, host_tokens), ("shape", both, path_tokens))]
    known = pages.sparkSession.createDataFrame([(field, w, 0, 0) for field in ("host", "shape") for w in SEEDS], "field string, token string, block long, allow long")
    seen = written(seen[0].unionByName(seen[1]).unionByName(known).groupBy("field", "token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-counts")
    ratios = F.lit(0.0)
    for field, block, allow in seen.groupBy("field").agg(F.sum("block"), F.sum("allow")).collect():  # two rows
        share = (block + 1) / (block + allow + 2)
        more = F.when(listed, float(LISTED_COUNTS)).otherwise(0.0)
        own = F.ln((F.col("block") + more + SMOOTHING * share) / (F.col("allow") + SMOOTHING * (1 - share))) - math.log(share / (1 - share))
        ratios = F.when(F.col("field") == field, own).otherwise(ratios)
    ratios = seen.select("field", "token", ratios.alias("ratio"))
    n_block, n_allow = (x or 0 for x in sites_as.agg(F.sum("block"), F.sum("allow")).first())
    prior = min(0.0, math.log((n_block + 1) / (n_allow + 1)))

    def scores(owned: DataFrame, key: str, score: str) -> DataFrame:
        """A token that only pages under blocking rules have tells nothing."""
        found = owned.join(ratios.where(F.col("field") == key), "token", "left")
        return found.groupBy(key).agg(F.sum(F.col("n") * F.coalesce("ratio", F.lit(0.0))).alias(score), F.sort_array(F.collect_set("token")).alias(f"{key}_tokens"))

    for key, owned, score in (("host", host_tokens, "host_score"), ("shape", path_tokens, "path_score")):
        rows = with_scores(rows, written(scores(owned, key, score), f"{key}-scores"), key, shapes)
    # Rounded, so that the order of sums can't tip a verdict.
    score = F.round(F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)) + prior, 6)
    rows = rows.withColumn("score", F.when(F.col("host_score").isNull() & F.col("path_score").isNull(), 0.0).otherwise(score))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.col("host_tokens"), F.col("shape_tokens").alias("path_tokens"))
