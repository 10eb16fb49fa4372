"""Backtracking encoder, repair of conversations and alignment of tokenizers, each against its plain version."""

import hashlib
import random
from array import array
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import alignment, bpe, conversations, queries, tokens
from tests.llm import brute_conversations

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
ODD = st.lists(st.sampled_from(["a", "The", "th", "ing", " ", "  ", "\n", "\t", ".", "'s", "!!", "é", "ß", "1", "²", "́", "\x00", "日本", "\U0001f600", "don't", "<|endoftext|>", "<s>", "<0x41>", "\xa0", "▁"]), max_size=20).map("".join)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(BYTES))


# 11


def plain_merges(piece, joined, made):
    """Merging as it is defined: the pair of the least rank, leftmost first, until none is left."""
    ids = list(piece)
    while pairs := [(joined[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in joined]:
        rank, k = min(pairs)
        ids[k : k + 2] = [made[rank]]
    return ids


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.text("abc", max_size=60))
def test_backtracking_is_merging(seed, text):
    """Random tables of merges over few letters, where tokens overlap a lot."""
    rng, letters = random.Random(seed), tokens._byte_letters()
    vocabulary, names, merges = {c: b for b, c in letters.items()}, list("abc"), []
    for _ in range(rng.randint(0, 25)):
        pair = rng.choice(names), rng.choice(names)
        if "".join(pair) not in vocabulary:
            vocabulary["".join(pair)] = 256 + len(merges)
            names.append("".join(pair))
            merges.append(pair)
    own = bpe.Tables(vocabulary, merges)
    joined = {(vocabulary[a], vocabulary[b]): k for k, (a, b) in enumerate(merges)}
    want = plain_merges(text.encode(), joined, [vocabulary[a + b] for a, b in merges])
    assert own.encode(text.encode()) == want
    assert own.decode(array("I", want).tobytes()) == text


def test_encoding_is_the_library_s(docs):
    own, theirs = bpe.Encoder(tokens.vocabulary(BYTES), kept_bytes=20_000), library()

    @settings(max_examples=300, deadline=None)
    @given(ODD)
    def check(text):
        assert list(array("I", own.encode(text))) == theirs.encode(text, add_special_tokens=False).ids

    check()
    for text in [t or "" for _, t in docs] + ["x" * 5000, "ab" * 9000, "<|endoftext|><|", " " * 500 + "a", "".join(map(chr, range(1, 3000)))]:
        assert list(array("I", own.encode(text))) == theirs.encode(text, add_special_tokens=False).ids


def test_each_letter_is_cut_as_by_the_library():
    own, theirs = bpe.Encoder(tokens.vocabulary(BYTES)), library()
    texts = [f"a{chr(c)}1 {chr(c)}," for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for text, found in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert list(array("I", own.encode(text))) == found.ids, text


def test_special_strings_as_plain_text():
    theirs = library()
    theirs.encode_special_tokens = True
    for text in ("a <|endoftext|>b", "<|endoftext|>", "<|endof"):
        assert list(array("I", bpe.Encoder(tokens.vocabulary(BYTES), special=False).encode(text))) == theirs.encode(text, add_special_tokens=False).ids


def test_decoding_is_the_library_s():
    rng, own, theirs = random.Random(2), bpe.tables(tokens.vocabulary(BYTES)), library()
    for _ in range(500):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50_257)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(array("I", ids).tobytes()) == theirs.decode(ids, skip_special_tokens=False)


def test_vocabularies_that_are_refused():
    letters = {c: b for b, c in tokens._byte_letters().items()}
    for vocabulary, merges in (({"a": 0}, []), (letters | {"abc": 256, "bc": 257}, [("a", "bc"), ("b", "c")])):
        with pytest.raises(ValueError):
            bpe.Tables(vocabulary, merges)


def test_bpe_over_rows(frame, empty, docs, multiset):
    path, theirs = tokens.vocabulary(BYTES), library()
    want = [(i, theirs.encode(t or "", add_special_tokens=False).ids) for i, t in docs]
    got = bpe.encode(frame, path)
    assert multiset((r.doc_id, tuple(r.ids)) for r in got.collect()) == multiset((i, tuple(x)) for i, x in want)
    assert multiset(map(tuple, bpe.decode(got, path).collect())) == multiset((i, t or "") for i, t in docs)
    assert bpe.encode(empty, path).count() == bpe.round_trip(empty, path).count() == 0


def test_op11(spark):
    theirs, digest = library(), lambda raw: hashlib.sha256(raw).hexdigest()
    want = {}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want[doc_id] = (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(theirs.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op11_bpe_backtracking(spark, SF).collect()} == want


# 12


def random_conversations(seed=5):
    rng, rows = random.Random(seed), []
    roles, texts = ["system", "user", "assistant", "tool", None, "user", "assistant", ""], ["ok.", "cut", "", "hm!", "other.", "x?", "y. \x0b", "z", None, "é。", "日本!", "\xa0"]
    for c in range(250):
        rows += [(c, k if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)) for k in range(rng.randint(1, 8))]
    rows += [(1000, k // 2 * 3, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["a. b?", "cut", f"q{k}.", f"q{k}!", f"zz{k}"])) for k in range(800)]
    rows += [(None, None if k < 20 else k, "user", "same." if k % 3 else f"t{k}.") for k in range(50)]
    return rows + [(2000, 5, "user", "r.")] * 40 + [(2001, 1, "user", "long " * 20_000 + "."), (2001, 2, "assistant", "x" * 70_000)]


SCHEMA = "conv_id long, turn long, role string, text string, piece long, gone boolean, kind string, last string, tie string"


@pytest.mark.parametrize("shard_mb, piece", [(8, 1_000_000), (0.0005, 1_000_000), (8, 3000)])
def test_conversations(spark, monkeypatch, shard_mb, piece):
    """Whole conversations, conversations over many partitions, and long ones in many pieces give the same."""
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = random_conversations()
    want = {c: brute_conversations.repaired(r) for c, r in brute_conversations.damaged(rows).items()}
    df = spark.createDataFrame([(*r, 1, True, "k", "l", "t") for r in rows], SCHEMA).repartition(5)
    found = conversations.repair(conversations.damage(df), shard_mb=shard_mb)
    got = conversations.digests(found).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    if shard_mb < 1:
        assert found.where("conv_id = 1000").count() > 3
    assert conversations.digests(conversations.repair(conversations.damage(df.limit(0)))).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text("suaoSUAOx", max_size=9), st.integers(0, 9))
def test_pieces_join(symbols, cut):
    """Costs across two pieces, and edits piece by piece, are those of the whole."""
    left, right = symbols[:cut], symbols[cut:]
    cost, letters, given_ = conversations.solve(symbols)
    behind = conversations.backward(right, conversations.TO_END)[0]
    m = conversations.crossing(left)
    n = conversations.STATES
    assert min(m[e] + behind[e] for e in range(n)) == cost
    fore = tuple(m[:n])
    state = conversations._walk(left, conversations.backward(left, behind), 0, False)
    a = conversations.cheapest(left, conversations.FROM_START, behind, 0, False)
    b = conversations.cheapest(right, fore, conversations.TO_END, state, True)
    assert a[2] == state and a[0] + b[0] == letters and a[1] + b[1] == given_


def test_op12(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.sql(conversations.ORACLE).fetchall()}
    got = queries.op12_conversation_repair(spark, SF)
    assert got.columns == con.sql(conversations.ORACLE).columns
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want and want
    rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    assert {c: brute_conversations.repaired(r) for c, r in brute_conversations.damaged(rows).items()} == want


# 13


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text by both libraries and lists of ends."""
    import sentencepiece

    a_side, b_side = library(), sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(PIECES))
    a_side.encode_special_tokens = True
    octet = {c: b for b, c in tokens._byte_letters().items()}
    spelled_a = {i: bytes(octet[c] for c in t) for t, i in a_side.get_vocab().items() if all(c in octet for c in t)}

    def spelled_b(i):
        name = b_side.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b_side.is_byte(i) else name.replace("▁", " ").encode()

    found, often = [], Counter()
    for text in texts:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        bytes_a, bytes_b, want = [spelled_a[i] for i in a], [spelled_b(i) for i in b], (" " + text).encode() if text else b""
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = [np.cumsum([0, *map(len, x)])[1:].tolist() for x in (bytes_a, bytes_b)]
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links += [(p, q) for p, e in zip(a, ends_a) if e == cut for q, f in zip(b, ends_b) if f == cut]
            i, j = x, y
        often.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in often.items():
        best[b] = max(best[b], n)
    return [(a, b, g, len(k), sum(often[x] == best[x[1]] for x in k), sum(often[x] for x in k), s) for a, b, g, k, s in found]


def test_alignment(spark, frame, empty, docs, multiset):
    rng = random.Random(3)
    parts = ["a", "th", "e", "ing", "▁", " ", "  ", "\n", "é", "1", "日本", "\U0001f600", "<|endoftext|>", "<s>", "<0x41>", "\x00", "don't", "\xa0"]
    rows = docs + [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for k in range(200)]
    df = frame.unionByName(spark.createDataFrame(rows[len(docs) :], "doc_id long, text string"), allowMissingColumns=True)
    paths = tokens.vocabulary(BYTES), tokens.vocabulary(PIECES)
    want = plain_alignment([t for _, t in rows])
    got = alignment.links(df, *paths).collect()
    assert multiset(got) == multiset((i, *w) for (i, _), w in zip(rows, want)) and sum(w[0] == 0 for w in want) > 10
    assert alignment.links(empty, *paths).count() == 0


def test_op13(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for r, w in zip(rows, plain_alignment([r.text for r in rows]))}
    got = queries.op13_token_alignment(spark, SF)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_bits(a, b):
    x, y = (alignment.Bits(np.array(sorted(s), np.int64), 401) for s in (a, b))
    assert (x & y).select().tolist() == sorted(a & b)
    places = np.arange(401)
    assert x.rank(places).tolist() == [sum(v <= p for v in a) for p in places.tolist()]


def test_units_are_aligned_once_and_as_in_whole_texts():
    import pyarrow as pa

    both = alignment.Aligner(tokens.vocabulary(BYTES), tokens.vocabulary(PIECES))
    rng = random.Random(8)
    parts = ["the", " of", " and", ".", ", x", "\nIt", "!!", " d'un", "\u00e9.", "\u00d7.", " 12%", "\u2581", "  ", "\t", "\u4e2d", "<0x41>", "\u0130."]
    texts = [None, "", " ", "\n", "a\n", " a", "a \u2581 b"] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(800)]
    values, counts, whole = both.align_column(pa.array(texts, pa.string()))
    assert 100 < whole.sum() < 700 and not counts[:, whole].any()
    want, n = both.align([t for t, w in zip(texts, whole) if not w])
    assert (counts[:, ~whole] == n).all() and all((x == y).all() for x, y in zip(values, want))
    seen, encode = [], both.a._encode_unit
    both.a._encode_unit = lambda unit: seen.append(unit) or encode(unit)
    both.align_column(pa.array(["One new word, one NEW word."] * 50))
    assert len(seen) == len(set(seen)) < 8
