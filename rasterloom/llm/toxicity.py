"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are lower-case runs of letters, digits and underscores, known by 64-bit hashes.
Examples are a bounded sample of the distinct labelled texts (``SAMPLE_ROWS`` rows and
``SAMPLE_CHARS`` code points, in order of the texts' hashes); all their terms span the
vector space, so every text that shares a term with any example has a vector. A term's
weight is (1 + ln tf) * idf * evidence: document frequencies are counted over all
documents, and evidence, between ``FLOOR`` and ``FLOOR + 2``, grows with how many standard
deviations above ``CHANCE`` toxic examples have a term beyond their share. No term is dropped.

The examples' inverted index is cut into blocks of like examples, with each term's largest
weight in each block. A query sums these into a bound for each block, computes the blocks
of the highest bounds, and then all whose bound is not below its k-th best cosine so far:
the k nearest are exact. Their cosine-weighted votes are smoothed by the share of toxic
examples, and turned into a probability by isotonic regression on the examples
themselves, each scored without itself.
"""

from __future__ import annotations

import re

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import prefer_names, text_hash, tidy, written

#: Bounds of the labelled texts that are fitted to.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000_000
NEIGHBOURS, BLOCK, FIRST_BLOCKS, ROWS = 15, 256, 2, 250
FLOOR, CHANCE, MOST_DEVIATIONS = 0.05, 3.0, 20.0
PRIOR_WEIGHT = 0.5
#: Words whose terms a worker remembers, and texts whose scores it does; both only save time.
KEPT_WORDS, KEPT_TEXTS = 100_000, 5_000
_WORD = re.compile(r"\w+")


class Terms:
    """Terms of texts as hashes, or, with a vocabulary (sorted hashes), as places in it."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.place = None if vocabulary is None else dict(zip(vocabulary.tolist(), range(len(vocabulary))))
        self.known: dict[str, int] = {}

    def _of_word(self, word: str) -> int:
        """-1 for a word that the vocabulary doesn't have."""
        from xxhash import xxh64_intdigest

        term = xxh64_intdigest(word) >> 1
        if self.place is not None:
            term = self.place.get(term, -1)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self.known[word] = term
        return term

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms in ascending order, counts) of a whole text."""
        sums: dict[int, int] = {}
        known, of_word = self.known, self._of_word
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            t = known.get(w)
            if t is None:
                t = of_word(w)
            if t >= 0:
                sums[t] = sums.get(t, 0) + n
        terms = np.fromiter(sums.keys(), np.int64, len(sums))
        order = np.argsort(terms)
        return terms[order], np.fromiter(sums.values(), float, len(sums))[order]


def in_parts(batch):
    """A batch in slices of few rows, so that little of it is held as Python objects at a time."""
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of starts, so many as sizes tells."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


@dataclass
class Index:
    """Examples' unit vectors as an inverted index in blocks. of_term: the entries of each term, one
    for each block that has it, with the term's largest weight there and the place of its postings."""

    weights: np.ndarray  # by term
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    of_term: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    peak: np.ndarray = field(default_factory=lambda: np.zeros(0))
    posting: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def unit(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weights[ids]
        return w / np.sqrt(np.sum(w * w)) if len(w) else w

    @staticmethod
    def build(weights, vectors, labels, owners) -> "Index":
        """vectors: (ids, counts) of each example, sorted ids; owners: what evidence names the examples by."""
        self = Index(np.asarray(weights, dtype=float))
        units = [(i := np.asarray(ids, dtype=np.int64), self.unit(i, np.asarray(c, dtype=float))) for ids, c in vectors]
        # Examples with the same heaviest terms stand together, so that block maxima are tight.
        lead = [tuple(i[np.argsort(-w, kind="stable")][:3].tolist()) for i, w in units]
        order = sorted(range(len(units)), key=lambda k: (lead[k], k))
        self.labels = np.array([labels[k] for k in order], dtype=float)
        self.owners = np.array([owners[k] for k in order], dtype=np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *[units[k][0] for k in order]])
        weight = np.concatenate([np.zeros(0), *[units[k][1] for k in order]])
        example = np.repeat(np.arange(len(order)), [len(units[k][0]) for k in order])
        by_term = np.lexsort((example, term))
        term, self.weight, self.example = term[by_term], weight[by_term], example[by_term]
        new = np.concatenate(([True], (term[1:] != term[:-1]) | (self.example[1:] // BLOCK != self.example[:-1] // BLOCK))) if len(term) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.block = self.example[first] // BLOCK
        self.example, self.block = self.example.astype(np.int32), self.block.astype(np.int32)
        self.weight = self.weight.astype(np.float32)
        self.peak = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.posting = np.append(first, len(term))
        self.of_term = np.searchsorted(term[first], np.arange(len(self.weights) + 1))
        return self

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cosine, label, owner) of the k nearest with a positive cosine, exactly; ties in the index's order.
        but: the owner of an example that doesn't count."""
        size, q = self.of_term[ids + 1] - self.of_term[ids], q.astype(np.float32)
        entry, of = _runs(self.of_term[ids], size), np.repeat(q, size)
        block = self.block[entry]
        bound = np.bincount(block, weights=of * self.peak[entry], minlength=-(-len(self.labels) // BLOCK))
        cosine, least = np.zeros(len(self.labels)), 0.0
        order = np.argsort(-bound, kind="stable")
        todo = order[:FIRST_BLOCKS]
        while len(todo):
            chosen = np.zeros(len(bound), dtype=bool)
            chosen[todo] = True
            some = chosen[block]
            a, b = self.posting[entry[some]], self.posting[entry[some] + 1]
            at = _runs(a, b - a)
            cosine += np.bincount(self.example[at], weights=np.repeat(of[some], b - a) * self.weight[at], minlength=len(cosine))
            if least < 0:
                break
            if but is not None:
                cosine[self.owners == but] = 0.0
            seen = np.sort(cosine)[-k:]
            least = seen[0] if len(seen) == k else 0.0
            todo = order[FIRST_BLOCKS:]
            todo = todo[(bound[todo] > 0) & (bound[todo] >= least - 1e-6)]  # a float's error
            least = -1.0
        if but is not None:
            cosine[self.owners == but] = 0.0
        cosine = np.round(cosine, 6)
        top = np.argsort(-cosine, kind="stable")[:k]
        top = top[cosine[top] > 0]
        return cosine[top], self.labels[top], self.owners[top]

    def vote(self, cosine: np.ndarray, labels: np.ndarray) -> float:
        """The toxic share of the neighbours' votes, and of all examples with a small weight."""
        w = cosine**2
        return float((np.sum(w * labels) + PRIOR_WEIGHT * self.base * np.mean(w)) / (np.sum(w) + PRIOR_WEIGHT * np.mean(w))) if len(w) else self.base

    def calibrate(self, votes: list[float], labels: list[float]) -> None:
        """Isotonic regression of labels on votes, each level smoothed by one vote of each label."""
        levels: list[list[float]] = []  # toxic, all, least vote
        by: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for v, y in zip(votes, labels):
            by[round(v, 3)][0] += y
            by[round(v, 3)][1] += 1
        for v in sorted(by):
            levels.append([by[v][0], by[v][1], v, v])
            while len(levels) > 1 and levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1]:
                a = levels.pop()
                levels[-1] = [levels[-1][0] + a[0], levels[-1][1] + a[1], levels[-1][2], a[3]]
        xs, ys = [], []
        for toxic, n, low, high in levels:
            p = (toxic + 0.5) / (n + 1)
            xs += [low, high]
            ys += [p, p]
        self.steps = np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.zeros(0)

    def score(self, ids: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        found = self.nearest(ids, self.unit(ids, counts), NEIGHBOURS)
        v = self.vote(found[0], found[1])
        p = float(np.interp(round(v, 3), *self.steps)) if len(self.steps[0]) else v
        # A whisker of the vote keeps the order of votes within a level.
        return min(1.0, max(0.0, 0.999 * p + 0.001 * v)), [(int(o), float(c), int(y)) for c, y, o in zip(found[0][:3], found[1], found[2])]


def pick_examples(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chars: int) -> DataFrame:
    """(text_hash, text, toxic, doc_id): distinct labelled texts outside the held-out fold, in order of
    their hashes, sample_rows at most; of those, each that still has room below sample_chars. doc_id, the
    least, only names an example."""
    rows = prefer_names(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).withColumn("doc_id", F.col("doc_id").cast("long"))
    own = docs.select("doc_id", text_hash().alias("text_hash"), F.length("text").alias("n"))
    found = rows.join(own, "doc_id").groupBy("text_hash").agg(F.max("toxic").cast("int").alias("toxic"), F.min("doc_id").alias("doc_id"), F.max(F.coalesce("n", F.lit(0))).alias("n"))
    chosen, held = [], 0
    for r in found.orderBy("text_hash").limit(sample_rows).collect():  # bounded by sample_rows
        if held + r.n <= sample_chars:  # a text that has no room is passed over, whatever follows
            held += r.n
            chosen.append((r.text_hash, r.toxic, r.doc_id))
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "text_hash long, toxic int, doc_id long"))
    texts = docs.select("text", text_hash().alias("text_hash")).join(picked.select("text_hash"), "text_hash")
    return texts.groupBy("text_hash").agg(F.min("text").alias("text")).join(picked, "text_hash")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, Index]:
    """(the vocabulary, the index of the examples). Both are bounded by sample_rows and sample_chars."""
    spark = docs.sparkSession
    docs = prefer_names(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    examples = written(pick_examples(docs, labels, sample_rows, sample_chars), "examples")

    def vectors(batches):
        import pyarrow as pa

        own = Terms()
        for batch in batches:
            found = [own.counts(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), batch.column(2), batch.column(3), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["text_hash", "toxic", "doc_id", "terms", "counts"])

    found = examples.select("text_hash", "text", "toxic", "doc_id").mapInArrow(vectors, "text_hash long, toxic int, doc_id long, terms array<long>, counts array<double>").toArrow().sort_by("text_hash")
    y = np.array(found.column("toxic").to_pylist(), dtype=float)
    owners = found.column("doc_id").to_pylist()
    split = lambda name: [v.values.to_numpy() for v in found.column(name)]
    terms, counts = split("terms"), split("counts")
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]))
    ids = [np.searchsorted(vocabulary, t) for t in terms]
    of = np.concatenate([np.zeros(0, np.int64), *ids])
    have = np.bincount(of, minlength=len(vocabulary))
    toxic = np.bincount(of, weights=np.repeat(y, [len(i) for i in ids]), minlength=len(vocabulary))
    p = (y.sum() + 1) / (len(y) + 2)
    evidence = FLOOR + np.clip((toxic - have * p) / np.sqrt(np.maximum(have, 1) * p * (1 - p)) - CHANCE, 0, MOST_DEVIATIONS) / 10
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        import pyarrow as pa

        own, df, n = Terms(shared.value), np.zeros(len(shared.value), np.int64), 0
        for part in (p for batch in batches for p in in_parts(batch)):
            for text in part.column(0).to_pylist():
                df[own.counts(text)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "n"])
        tidy()

    df, n = np.zeros(len(vocabulary)), 0
    counted = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # as many rows as terms
    at, values = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df[at[at >= 0]], n = values[at >= 0], values[at < 0].sum()
    index = Index.build(np.log1p(n / (1 + df)) * evidence, list(zip(ids, counts)), y, owners)
    index.base = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    unsteady = spark.sparkContext.broadcast(index)

    def votes(batches):
        import pyarrow as pa

        own, index = Terms(shared.value), unsteady.value
        for batch in batches:
            out = []
            for text, doc_id in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                i, c = own.counts(text)
                out.append(index.vote(*index.nearest(i, index.unit(i, c), NEIGHBOURS, doc_id)[:2]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(1)], names=["vote", "toxic"])

    rows = examples.select("text", "toxic", "doc_id").mapInArrow(votes, "vote double, toxic int").collect() if len(y) else []  # bounded by sample_rows
    index.calibrate([r.vote for r in rows], [float(r.toxic) for r in rows])
    return vocabulary, index


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_id, cosine and label of the three
    nearest examples) for each row of docs.

    A null or empty text, or one without any example's term, scores as examples do on the
    whole. Equal texts score alike; texts are read whole, however long. Rows of equal or null
    doc_id are scored each; a null doc_id is not held out. Labels that are null, or whose
    document is missing, teach nothing; without labels every score is 0. An empty table gives
    no rows. Other columns are not read.
    """
    judged = _judged(docs, labels, sample_rows, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), "score", "evidence")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return judged.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def _judged(docs: DataFrame, labels: DataFrame, sample_rows: int, carry: list[str]) -> DataFrame:
    """A struct row of the columns of carry and the text, score and evidence, in one pass: verdicts need no way back to rows."""
    vocabulary, index = fit(docs, labels, sample_rows)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((vocabulary, index))  # bounded by SAMPLE_ROWS and SAMPLE_CHARS

    def run(batches):
        import pyarrow as pa

        from xxhash import xxh3_128_digest

        (vocabulary, index), seen = shared.value, {}
        own = Terms(vocabulary)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for part in (p for batch in batches for p in in_parts(batch)):
            scores, proof = [], []
            for text in part.column(0).field("text").to_pylist():
                key = xxh3_128_digest(text or "")
                if key not in seen:
                    if len(seen) > KEPT_TEXTS:
                        seen.clear()
                    seen[key] = index.score(*own.counts(text))
                p, near = seen[key]
                scores.append(p)
                proof.append([{"doc_id": o, "cosine": c, "toxic": t} for o, c, t in near])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(proof, kind)], names=["row", "score", "evidence"])
        tidy()

    names = list(dict.fromkeys([*carry, "text"]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, unchanged, whatever their columns are called.
    A verdict depends on the text alone; null and empty texts, repeated rows, missing ids and empty
    tables are as in score()."""
    kept = _judged(docs, labels, SAMPLE_ROWS, docs.columns).where("score < 0.5")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
