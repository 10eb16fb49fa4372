"""Document fingerprints by consistent weighted sampling, by DataFrame operations only.

A text is a bag of words weighted by their counts. In each of ``rounds`` rounds the mass of
a word, its first, second, ... occurrence, is dealt to ``bins`` bins by a hash, so a word
has a weight w in a bin: how many of its occurrences lie there. Of two texts, the one with
fewer of a word has a part of the other's mass, so a bin's min and max of w are the
intersection and union of what was dealt to it. A sample is taken in each bin: each of the
bin's words draws ``r`` and ``c`` from Gamma(2, 1) and ``b`` uniformly, all from hashes of
the word, the round and the bin; with ``t = floor(ln(w) / r + b)`` and
``y = exp(r * (t - b))`` the bin keeps the word and t with the least
``a = c / (y * exp(r))``. Two texts keep the same with a probability equal to the
generalised Jaccard similarity of the bin, sum(min(w)) / sum(max(w)).

Each unit of mass of two texts' union falls into each bin alike, so over the bins that
are not empty in both, the rate of collisions is an unbiased estimate of the texts'
similarity, whatever their lengths and counts: heavy words have mass in many bins. Texts
with little mass leave bins empty, but those that it fills have a unit or two each, and so
are nearly exact. (Draws of each word for each sample would be as many times more. Written
as 96 minimum aggregates, they took 6 times the CPU seconds of all of this.)
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import prefer_names, shards_for, text_hash, words

ROUNDS, BINS = 1, 128
SHARD_MB = 2
#: Ranges of doc_id are units of balance (sorts and aggregates in them spill), so their number has a bound:
#: the driver holds so many bounds, of a sample of so many rows a range.
MOST_RANGES, SAMPLED_A_RANGE = 50_000, 30


def _uniforms(h: Column) -> tuple[Column, Column]:
    """Two uniform numbers in (0, 1) from the halves of a 64-bit hash."""
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return (low + 0.5) * 2.0**-32, (high + 0.5) * 2.0**-32


def _gamma2(h: Column) -> Column:
    u, v = _uniforms(h)
    return -F.ln(u * v)


def signatures(texts: DataFrame, keys: list[str], rounds: int = ROUNDS, bins: int = BINS) -> DataFrame:
    """keys and the sorted array of samples (slot << 16 | 16 bits of the id; null without words) of
    each text of texts (keys, text); slot is round * bins + bin.

    If texts are dealt by some of the keys, nothing is shuffled.
    """
    tf = texts.select(*keys, F.explode_outer(words(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(F.count("word").cast("int").alias("n"))
    # A text without words keeps a row, without a mass.
    mass = tf.select(*keys, F.xxhash64("word").alias("h"), F.explode(F.sequence(F.least(F.col("n"), F.lit(1)), F.col("n"))).alias("nth"))
    mass = mass.select(*keys, "h", "nth", F.explode(F.array(*map(F.lit, range(rounds)))).alias("round"))
    slot = F.col("round") * bins + F.pmod(F.xxhash64("h", "nth", "round"), F.lit(bins)).cast("int")
    weights = mass.select(*keys, F.when(F.col("nth") > 0, slot).alias("slot"), "h").groupBy(*keys, "slot", "h").agg(F.count(F.lit(1)).alias("w"))
    drawn = weights.select(*keys, "slot", "w", F.xxhash64("h", "slot").alias("g"))
    drawn = drawn.select(*keys, "slot", "w", _gamma2(F.col("g")).alias("r"), _gamma2(F.xxhash64("g", F.lit(1))).alias("c"), F.xxhash64("g", F.lit(2)).alias("more"))
    # The logarithm of a weight is cheap where most are 1.
    lnw = F.when(F.col("w") == 1, 0.0).otherwise(F.ln("w"))
    drawn = drawn.select(*keys, "slot", "r", F.ln("c").alias("lnc"), _uniforms(F.col("more"))[1].alias("b"), F.floor(lnw / F.col("r") + _uniforms(F.col("more"))[1]).alias("t"), "more")
    lna = F.col("lnc") - F.col("r") * (F.col("t") - F.col("b") + 1)
    # ln(a) in the upper half, as a fixed-point number: it is within 1024 of 0, as r is below 46 and
    # r * t at most ln(w) + r. In the lower half what tells (word, t).
    packed = F.shiftleft(((lna + 1024) * 2.0**20).cast("long"), 32).bitwiseOR(F.col("more").bitwiseXOR(F.col("t")).bitwiseAND(F.lit(0xFFFFFFFF)))
    least = drawn.select(*keys, "slot", packed.alias("packed")).groupBy(*keys, "slot").agg(F.min("packed").alias("packed"))
    sample = F.shiftleft("slot", 16).bitwiseOR(F.col("packed").bitwiseAND(F.lit(0xFFFF)).cast("int"))
    return least.select(*keys, sample.alias("sample"))


def likeness(a: Column, b: Column) -> Column:
    """The part of the slots that are filled in either fingerprint on which both agree; 1 if neither has any."""
    shared = F.size(F.array_intersect(a, b))
    slots = lambda x: F.transform(x, lambda v: F.shiftright(v, 16))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(slots(a), slots(b)))
    return F.when(either == 0, 1.0).otherwise(shared / either)


def as_text(samples: Column) -> Column:
    """Six hex digits a sample: its slot (2) and id (4). likeness() of what is written here is that of the samples."""
    return F.lower(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v), 6, "0")), ""))


def range_of(docs: DataFrame, ranges: int) -> Column:
    """The number of the range that a row's (doc_id, text_hash) lies in; ranges have about equally many rows.

    Bounds are quantiles of a sample by hash. They are found in as many steps as they have bits.
    """
    n = docs.count()
    part = min(1.0, ranges * SAMPLED_A_RANGE / max(n, 1))
    chosen = docs.select("doc_id", "text_hash").where(F.pmod(F.xxhash64("text_hash", "doc_id", F.lit(7)), F.lit(1 << 20)) < math.ceil(part * (1 << 20)))
    found = chosen.toPandas() if n else None  # bounded by SAMPLED_A_RANGE * MOST_RANGES, about
    if found is None or not len(found) or ranges < 2:
        return F.lit(0)
    rows = sorted(((i is not None, i or 0, h) for i, h in chosen_rows(found)))
    bounds = sorted({rows[k * len(rows) // ranges] for k in range(1, ranges)})
    text = json.dumps([{"doc_id": i if known else None, "h": h} for known, i, h in bounds])
    edges = F.from_json(F.lit(text), "array<struct<doc_id:bigint,h:bigint>>")
    own = F.struct(F.col("doc_id"), F.col("text_hash").alias("h"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(edges, at + step - 1) <= own), at + step).otherwise(at))


def chosen_rows(found) -> list[tuple[int | None, int]]:
    """(doc_id, text_hash) of a data frame in which a column with nulls may have become one of objects."""
    return [(None if i is None or i != i else int(i), int(h)) for i, h in zip(found["doc_id"], found["text_hash"])]


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """range, rn, doc_id, text, next_text, last: each row with the text of the next in order of
    doc_id (nulls first), the text's hash and the text; the last row's next is the first row.

    Texts are dealt once, by range. A range's last row gets its next from a table of one row
    a range, never from a sort of all rows in one task.
    """
    docs = prefer_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", text_hash())
    docs = docs.withColumn("range", range_of(docs, ranges))
    # Two longs a range, and MOST_RANGES bounds the ranges; so does it bound the window's rows.
    firsts = docs.groupBy("range").agg(F.min("doc_id").alias("some"), F.min(F.when(F.col("doc_id").isNull(), F.col("text_hash"))).alias("null_hash"))
    firsts = firsts.select("range", F.when(F.col("null_hash").isNull(), F.col("some")).alias("first_id"))
    order = Window.orderBy("range")
    after = firsts.select(F.col("range").alias("of"), F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("range"))
    heads = docs.join(F.broadcast(firsts.withColumnRenamed("range", "own")), (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("range").agg(F.min(F.struct("text_hash", "text")).alias("head"))
    after = after.join(heads, "range").select("of", F.col("head.text").alias("after_text"))
    by = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash", "text")
    rows = docs.repartition(ranges, "range").select("range", F.row_number().over(by).alias("rn"), "doc_id", "text", F.lead("text").over(by).alias("lead_text"))
    rows = rows.withColumn("last", F.col("lead_text").isNull())
    rows = rows.join(after, F.col("range") == F.col("of"), "left")
    return rows.select("range", "rn", "doc_id", "text", F.when(F.col("last"), F.col("after_text")).otherwise(F.col("lead_text")).alias("next_text"), "last")


def fingerprint_edits(docs: DataFrame, rounds: int = ROUNDS, bins: int = BINS, shard_mb: float = SHARD_MB) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by the first of the
    next row's text. A null text is empty: an empty fingerprint, alike only to itself.
    Rows of equal or null doc_id follow one another by the hash of their texts. Texts are
    read whole, however long. An empty table gives no rows; a single row is its own next.
    Columns besides doc_id and text aren't read.
    """
    rows = in_order(docs, min(MOST_RANGES, shards_for(docs, shard_mb)))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select("*", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"))
    kind = lambda k, text: F.struct(F.lit(k).alias("kind"), F.col(text).alias("text"))
    own = [kind(0, "text"), kind(1, "edited")]
    kinds = F.when(F.col("last"), F.array(*own, kind(2, "next_text"))).otherwise(F.array(*own))
    found = signatures(rows.select("range", "rn", F.inline(kinds)), ["range", "rn", "kind"], rounds, bins)
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("sample"))))
    found = found.groupBy("range", "rn").agg(of(0).alias("own"), of(1).alias("changed"), of(2).alias("beyond"))
    by = Window.partitionBy("range").orderBy("rn")
    found = found.select("range", "rn", "own", "changed", F.when(F.lead("rn").over(by).isNull(), F.col("beyond")).otherwise(F.lead("own").over(by)).alias("next"))
    meta = rows.select("range", "rn", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return meta.join(found, ["range", "rn"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
