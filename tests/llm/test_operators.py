"""Each operator against its plain version on one small corpus with every odd case."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import bitplanes, components, packing, quality_rules, queries, simhash, suffix_dedup, tokens, toxicity, url_filter, warc, weighted_sampling, wfst
from tests.llm import brute

WORD_BPE, BYTE_BPE, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", ".", "'s", "!!", "é", "ß", "1", "²", "Σ", "\u0301", "\x00", "\x85", "日本", "don't", "<|endoftext|>", "ing,", "\xa0", "▁"]), max_size=14).map("".join)


# 5 and 10: tokens


def plain_tokenizer(name):
    """The library as the contract calls it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


@pytest.mark.parametrize("kind, name", [("word", WORD_BPE), ("byte", BYTE_BPE)])
def test_cached_encoding_is_the_library_s(kind, name, docs):
    own, theirs = tokens.Encoder(tokens.vocabulary(name), kind, kept_bytes=20_000), plain_tokenizer(name)

    @settings(max_examples=300, deadline=None)
    @given(ODD)
    def check(text):
        assert list(array("I", own.encode(text))) == theirs.encode(text, add_special_tokens=False).ids

    check()
    for text in [t or "" for _, t in docs] + ["hello <|endoftext|> world", "<|ENDOFTEXT|>", "a<|startoftext|>b", "<|", "x" * 5000]:
        assert list(array("I", own.encode(text))) == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind, name", [("word", WORD_BPE), ("byte", BYTE_BPE)])
def test_each_letter_before_punctuation(kind, name):
    """Also letters that normalisation takes apart."""
    own, theirs = tokens.Encoder(tokens.vocabulary(name), kind), plain_tokenizer(name)
    texts = [chr(c) + "," for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for text, found in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert list(array("I", own.encode(text))) == found.ids, text


@pytest.mark.parametrize("name, kind", [(BYTE_BPE, "byte"), (WORD_BPE, "word")])
def test_units_of_many_rows_are_looked_up_once_and_encoded_as_the_library_does(name, kind):
    import pyarrow as pa

    own, theirs, rng = tokens.Encoder(tokens.vocabulary(name), kind, kept_bytes=20_000), plain_tokenizer(name), random.Random(3)
    parts = ["the", " of", "\u00e9.", "\u00d7.", ".", "!'s", "\nIt", " ", "\t", "\u0301", "\u0130.", " d'un", "\u00a0", "\u2026", "<|endoftext|>", "12%"]
    texts = [None, "", " ", "\n", " a", "a\n"] + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(1500)]
    column, found = pa.array(texts, pa.string()), []
    for x, y in tokens.slices(column, 400, 5_000):
        found += own.encode_all(column.slice(x, y - x))
    assert found == [np.array(theirs.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    seen, encode = [], own._encode_unit
    own._encode_unit = lambda unit: seen.append(unit) or encode(unit)
    own.encode_all(pa.array(["Quite unheard, quite UNHEARD."] * 50))
    assert len(seen) == len(set(seen)) < 8


def test_kept_units_are_bounded_and_frequent_ones_stay():
    kept = tokens.Kept(40_000)
    for k in range(2000):
        kept.put(f"unit{k}", b"1234")
        assert kept.get("unit0") == b"1234" and len(kept.young) + len(kept.old) < 250
    assert kept.get("unit1") is None
    kept.put("y" * 200, b"1")
    assert kept.get("y" * 200) is None


def encoded(docs, name, kind):
    theirs = plain_tokenizer(name)
    return [(i, np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6), st.sampled_from(["bit", "byte"]), st.integers(1, 5))
def test_planes_round_trip(lists, planes, block):
    docs = [(i if i % 2 else None, np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)]
    content = (bitplanes.segment(docs, {"part": 3}, planes, block) + b"\n") * 2
    found = list(bitplanes.read_segments(content))
    assert len(found) == 2
    for head, ids, lengths, values in found:
        assert head["part"] == 3 and ids == [i for i, _ in docs] and values.tolist() == sum(lists, []) and lengths.tolist() == list(map(len, lists))


def test_a_damaged_segment_is_told():
    content = bitplanes.segment([(1, b"\1\0\0\0")], {}, "bit", 4) + b"\n"
    for bad in (content[1:], content[:-1], content[:-3] + b"xx\n"):
        with pytest.raises(Exception):
            list(bitplanes.read_segments(bad))


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_files(frame, empty, docs, planes):
    path = tokens.vocabulary(WORD_BPE)
    got = bitplanes.round_trip(frame, path, planes=planes, block_ids=1000, segment_ids=500).collect()
    want, start = [], 0
    for i, ids in encoded(sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")), WORD_BPE, "word"):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((s, i, n, c) for i, s, n, c in want)
    assert bitplanes.round_trip(empty, path).count() == 0


def test_packing(frame, empty, docs):
    path = tokens.vocabulary(BYTE_BPE)
    got = packing.pack(frame, path, group_tokens=6000).collect()
    want = Counter((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in encoded(docs, BYTE_BPE, "byte"))
    by_id = defaultdict(list)
    for i, ids in encoded(docs, BYTE_BPE, "byte"):
        by_id[i].append(ids)
    for r in got:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in by_id[r.doc_id])
    assert sum(r.length for r in got) == sum(n for _, n, _ in want.elements())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=30))
def test_assignment_fills_sequences(lengths):
    found = packing.assign(lengths, capacity=20)
    used, parts = Counter(), defaultdict(list)
    for i, start, n, s, offset in found:
        assert offset == used[s]
        used[s] += n
        parts[i].append((start, n))
    assert sum(used.values()) == sum(lengths) and len(used) <= -(-sum(lengths) // 20)
    assert all(n <= 20 for n in used.values())
    for i, p in parts.items():
        assert [a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) == lengths[i]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=25))
def test_each_piece_goes_to_the_cheapest_sequence(lengths):
    """The assignment as stated, with lists alone."""
    n, cost = -(-sum(lengths) // 20), packing.Cost()
    used, load, want = [0] * n, [0.0] * n, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[i]
        while left:
            fits = [s for s in range(n) if used[s] + left <= 20] or [s for s in range(n) if used[s] < 20]
            s = min(fits, key=lambda s: (load[s], s))
            size = min(left, 20 - used[s])
            want.append((i, start, size, s, used[s]))
            used[s], load[s], start, left = used[s] + size, load[s] + cost.of(size), start + size, left - size
    assert packing.assign(lengths, capacity=20) == want


def test_costs_are_balanced():
    lengths = [2000, 1000, 1000, 500, 500, 500, 500] * 20
    cost, load = packing.Cost(), Counter()
    for _, _, n, s, _ in packing.assign(lengths):
        load[s] += cost.of(n)
    assert max(load.values()) < 1.5 * sum(load.values()) / len(load)


# 1: SimHash


def test_simhash_groups(frame, empty, docs, multiset):
    got = simhash.groups(frame).collect()
    fps = [brute.fingerprint(t) for _, t in docs]
    roots = brute.components(fps)
    least = {}
    for (i, _), r in zip(docs, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(i, f - 2**64 if f >= 2**63 else f, least.get(r)) for (i, _), f, r in zip(docs, fps, roots)]
    assert multiset((r.doc_id, r.fp, r.component_id) for r in got) == multiset(want)
    assert simhash.groups(empty).count() == 0


def test_the_tally_drops_pairs_before_they_are_verified():
    """Of pairs that meet in a list, those that share only its four bytes are dropped; no link is."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ (rng.integers(0, 2**32, 2000, dtype=np.uint64) & rng.integers(0, 2**32, 2000, dtype=np.uint64))  # four equal bytes
    x = fps[::2] ^ fps[1::2]
    shared = np.array([sum((int(v) >> 8 * k & 255) == 0 for k in range(8)) for v in x])
    assert simhash.retained(x, 3).tolist() == np.flatnonzero(shared >= 5).tolist() and 0 < len(simhash.retained(x, 3)) < 1000
    near = fps[:50] ^ np.array([(1 << a) | (1 << b) | (1 << c) for a, b, c in rng.integers(0, 64, (50, 3)).tolist()], dtype=np.uint64)
    assert len(simhash.linked(fps[:50] ^ near, 3)) == 50


def test_large_lists_lose_no_link(monkeypatch):
    rng = np.random.default_rng(7)
    fps = np.unique(rng.integers(0, 2**14, 900, dtype=np.uint64) << np.uint64(20))
    want = brute.components([int(f) for f in fps])
    monkeypatch.setattr(simhash, "DIRECT", 10)
    root = {int(f): int(f) for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in simhash.forest(fps):
        for u, v in zip(a.tolist(), b.tolist()):
            assert bin(u ^ v).count("1") <= 3
            root[max(find(u), find(v))] = min(find(u), find(v))
    assert [find(int(f)) for f in fps] == [int(fps[k]) for k in want]


@pytest.mark.parametrize("limit", [3, 50_000])
def test_links_keep_all_components(spark, limit):
    rng = np.random.default_rng(3)
    near = [int(rng.integers(0, 2**63))]
    for _ in range(60):  # a chain and clusters within few bits of one another
        near.append(near[rng.integers(0, len(near))] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), False)))
    fps = sorted({*near, *map(int, rng.integers(0, 2**63, 40))})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.links(df, list_limit=limit)).collect()}
    parts = defaultdict(set)
    for f, r in zip(signed, brute.components(fps)):
        parts[r].add(f)
    own = defaultdict(set)
    for f in signed:
        own[got.get(f, f)].add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, own.values()))


def test_components_of_stars_chains_and_nothing(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(40)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_each_group(frame, docs):
    kept = simhash.first_of_each(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    roots = brute.components([brute.fingerprint(t) for _, t in docs])
    least = {}
    for (i, _), r in zip(docs, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert set(ids) - {None} == set(least.values())


# 2: SentencePiece


def test_transducer_is_the_library_s(docs):
    from sentencepiece import SentencePieceProcessor

    path = tokens.vocabulary(PIECES)
    own, theirs = wfst.Transducer(wfst.read_model(path)), SentencePieceProcessor(model_file=path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(ODD, st.text(max_size=20)), max_size=5))
    def check(texts):
        texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
        for text, ids in zip(texts, own.encode_all(texts)):
            ids = list(array("I", ids))
            assert ids == theirs.encode(text) and own.decode(ids) == theirs.decode(ids)

    check()
    for text in [t or "" for _, t in docs] + ["a" * 300, "\u4e00" * 50 + "ab" * 90]:
        assert list(array("I", own.encode(text))) == theirs.encode(text)
        assert own.decode(array("I", own.encode(text))) == text


def tiny_model(merges, **more):
    """Pieces over a and b, bytes for the rest."""
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "ba", "aa", "▁a", "aba", "▁ab", "bab", "abab"]
    scores = [0.0] * 257 + [-20.0, -21.0, -22.0, -1.0, -3.0, -2.0, -4.0, -5.0, -6.0, -7.0, -8.0]
    return wfst.Model(tuple(names), tuple(scores), (2, *[6] * 256, *[1] * 11), merges, **more)


def least_cost_paths(model, text):
    """By trying every sequence of pieces: ids of the cheapest (all, if costs are equal)."""
    pieces = {p: (i, -s) for i, (p, s, k) in enumerate(zip(model.pieces, model.scores, model.kinds)) if k == 1}
    dear = max(w for _, w in pieces.values()) + wfst.FALLBACK_COST

    def merged(symbols):
        while True:
            pairs = [(pieces[a + b][1], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in pieces]
            if not pairs:
                return symbols
            k = min(pairs)[1]
            symbols = symbols[:k] + [symbols[k] + symbols[k + 1]] + symbols[k + 2 :]

    def paths(rest):
        if not rest:
            yield 0.0, []
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces or k == 1:
                for cost, tail in paths(rest[k:]):
                    yield cost + pieces.get(rest[:k], (0, dear))[1], [rest[:k], *tail]

    found = [(round(c, 6), p) for c, p in paths(text) if not model.merges or all(merged(list(a + b)) == [a, b] for a, b in zip(p, p[1:]))]
    spell = lambda p: [pieces[p][0]] if p in pieces else [1 + b for b in p.encode()]
    return [sum(map(spell, p), []) for c, p in found if c == min(found)[0]], [p for _, p in found], merged(list(text))


@pytest.mark.parametrize("merges", [True, False])
def test_shortest_paths_are_those_of_all_paths(merges):
    model = tiny_model(merges)
    own = wfst.Transducer(model)

    @settings(max_examples=300, deadline=None)
    @given(st.text("ab é", max_size=8))
    def check(text):
        line = own.normalised(text)
        best, finite, by_merging = least_cost_paths(model, line)
        assert list(array("I", own.encode(text))) in (best or [[]])
        assert not merges or finite == [by_merging]  # the acceptor leaves one path

    check()


def test_the_model_s_normaliser_is_honoured(tmp_path):
    assert wfst.Transducer(tiny_model(True, strip_spaces=True)).normalised("  a   b ") == "▁a▁b"
    assert wfst.Transducer(tiny_model(True, first_space=False)).normalised("a b") == "a▁b"
    raw = open(tokens.vocabulary(PIECES), "rb").read()
    (tmp_path / "charsmap.model").write_bytes(raw + bytes([0x1A, 4, 0x12, 2, 1, 2]))  # a normaliser with a table of characters
    with pytest.raises(ValueError):
        wfst.read_model(str(tmp_path / "charsmap.model"))
    with pytest.raises(ValueError):
        wfst.Transducer(wfst.Model(("x", "y"), (0.0, -1.0), (1, 4)))


def test_sentencepiece_frames(frame, empty, docs):
    path = tokens.vocabulary(PIECES)
    assert wfst.round_trip(frame, path).where("not same").count() == 0
    back = wfst.decode(wfst.encode(frame, path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in docs)
    assert wfst.round_trip(empty, path).count() == 0


# 3: WARC


def test_warc(spark, tmp_path, multiset):
    big, small = "<p>" + "x" * 200, "tiny"
    rows = [(3, "http://a/\r\nWARC-Type: forged", big), (1, "http://b/ c", big), (2, None, big), (5, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 20), (None, "u", big), (9, "u", "é" * 60), (10, "u", "é" * 60), (11, "u", "z" * 150), (11, "u", "z" * 150)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, payload_digest string, original long")
    got = warc.round_trip(pages, archive_mb=0.001).collect()
    groups = defaultdict(list)
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            groups[html].append(i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min(groups[html]) if groups.get(html) and (i, html) != (min(groups[html]), html) else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first is not None else "response", first))
    assert multiset(got) == multiset(want)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, date="2024-01-01T00:00:00Z")
    read = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert bytes(read[8].payload).decode() == rows[7][2] and read[3].uri == "http://a/%20%20WARC-Type:%20forged" and read[2].uri is None
    assert warc.round_trip(pages.limit(0)).count() == 0


# 4: toxicity


def toxic_corpus():
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        own = list(rng.choice(plain, 40))
        toxic = int(rng.random() < 0.2)
        if toxic:
            own += list(rng.choice(["vile", "nasty", "rotten"], 3))
        rows.append((i, " ".join(rng.permutation(own))))
        if i % 3:
            labels.append((i, toxic))
    return rows, labels, {i: "vile" in t or "nasty" in t or "rotten" in t for i, t in rows}


def test_toxicity(spark, frame, empty):
    rows, labels, truth = toxic_corpus()
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "vile nasty vile"), (3, rows[3][1])], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert next(r for r in got if r.predicted).evidence
    clean = toxicity.without_toxic(docs, marks)
    assert clean.where("text like '%vile%'").count() == 0 and clean.where("text is null").count() == 1
    assert toxicity.score(empty, marks).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(docs, marks.limit(0)).collect())


def test_a_long_labelled_text_does_not_end_the_sample(spark):
    rows, labels, truth = toxic_corpus()
    first = next(x for x in ("long" + " long" * 4000 + f" {k}" for k in range(400)) if spark.range(1).select(F.xxhash64(F.lit(x)) < -(2**62)).first()[0])
    docs = spark.createDataFrame(rows + [(9000, first)], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(9000, 0)], "doc_id long, toxic int")
    picked = toxicity.pick_examples(docs, marks, 1200, 15_000).collect()
    assert len(picked) > 40 and 9000 not in {r.doc_id for r in picked} and sum(len(r.text) for r in picked) <= 15_000


def test_nearest_is_exact():
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(700):
        ids = np.sort(rng.choice(40, rng.integers(0, 6), False))
        vectors.append((ids, rng.integers(1, 4, len(ids))))
    index = toxicity.Index.build(rng.random(40) + 0.1, vectors, [float(x) for x in rng.integers(0, 2, 700)], list(range(700)))
    dense = np.zeros((700, 40))
    for k, (ids, counts) in enumerate(vectors):
        dense[k, ids] = index.unit(ids, counts.astype(float))
    for n, (ids, counts) in enumerate(vectors[:120]):
        q = np.zeros(40)
        q[ids] = index.unit(ids, counts.astype(float))
        cosine = np.round(dense @ q, 6)
        but = n if n % 2 else None
        want = sorted((c for k, c in enumerate(cosine) if c > 0 and k != but), reverse=True)[:10]
        found = index.nearest(ids, index.unit(ids, counts.astype(float)), 10, but)
        assert np.allclose(found[0], want, atol=1e-5) and len(found[0]) == len(want) and but not in found[2]
        assert all(np.isclose(cosine[o], c, atol=1e-5) for c, o in zip(found[0], found[2]))


def test_scores_are_those_of_brute_force(spark):
    """Vote, calibration and score of the whole query against plain dictionaries."""
    rows, labels, _ = toxic_corpus()
    docs = spark.createDataFrame(rows + [(700, rows[1][1]), (701, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    texts = dict(rows) | {700: rows[1][1], 701: ""}
    split = lambda t: Counter(re.findall(r"\w+", t.lower()))
    examples = {}
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 5:
            examples[texts[i]] = max(y, examples.get(texts[i], 0))
    bags, p = {t: split(t) for t in examples}, (sum(examples.values()) + 1) / (len(examples) + 2)
    have, bad = Counter(x for b in bags.values() for x in b), Counter(x for t, b in bags.items() if examples[t] for x in b)
    df = Counter(x for t in texts.values() for x in set(split(t)))
    weight = {x: np.log1p(len(texts) / (1 + df[x])) * (0.05 + min(max((bad[x] - n * p) / np.sqrt(n * p * (1 - p)) - 3, 0), 20) / 10) for x, n in have.items()}

    def unit(bag):
        v = {x: (1 + np.log(n)) * weight[x] for x, n in bag.items() if x in weight}
        size = np.sqrt(sum(w * w for w in v.values()))
        return {x: w / size for x, w in v.items()}

    units, base = {t: unit(b) for t, b in bags.items()}, (sum(examples.values()) + 0.5) / (len(examples) + 1)

    def vote(text, but=None):
        q = unit(split(text))
        near = sorted(((round(sum(w * u.get(x, 0) for x, w in q.items()), 12), examples[t]) for t, u in units.items() if t != but), reverse=True)[:15]
        w = np.array([c**2 for c, _ in near if c > 0])
        return (sum(w * [y for c, y in near if c > 0]) + 0.5 * base * w.mean()) / (w.sum() + 0.5 * w.mean()) if len(w) else base

    levels = toxicity.Index(np.zeros(0))
    levels.calibrate([vote(t, t) for t in examples], [float(y) for y in examples.values()])
    for i, t in texts.items():
        v = vote(t)
        assert abs(got[i].score - (0.999 * np.interp(round(v, 3), *levels.steps) + 0.001 * v)) < 0.02, i
    assert sum(abs(got[i].score - (0.999 * np.interp(round(vote(t), 3), *levels.steps) + 0.001 * vote(t))) > 1e-6 for i, t in list(texts.items())[:200]) < 5


# 6: consistent weighted sampling


def test_weighted_sampling(frame, empty, docs):
    got = weighted_sampling.fingerprint_edits(frame).collect()
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed(xxhash.xxh64((d[1] or "").encode(), seed=42).intdigest()), d[1] or ""))
    want = Counter()
    errors, seen = [], {}
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        key = (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        want[key] += 1
        r = by[key]
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
        if edited == text:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
        if len(brute.words(text)) >= 50:
            errors.append(r.near_edited - brute.generalised_jaccard(text, edited))
            errors.append(r.near_next - brute.generalised_jaccard(text, after))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.08
    assert weighted_sampling.fingerprint_edits(empty).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    """Over many pairs of weighted sets the mean error is near zero. Each pair has words, and so draws, of its own."""
    rng = np.random.default_rng(6)
    rows, truth = [], []
    for k in range(60):
        a = rng.integers(0, 6, 80)
        b = np.where(rng.random(80) < 0.5, a, rng.integers(0, 6, 80))
        rows += [(2 * k, " ".join(f"t{k}.{i}" for i in range(80) for _ in range(a[i]))), (2 * k + 1, " ".join(f"t{k}.{i}" for i in range(80) for _ in range(b[i])))]
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    got = {r.doc_id: r for r in weighted_sampling.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = np.array([got[2 * k].near_next for k in range(60)])
    assert abs((found - truth).mean()) < 0.02 and np.abs(found - truth).max() < 0.2


@pytest.mark.parametrize("a, b, own", [(300, 300, 200), (100, 100, 1), (250, 50, 30)])
def test_skewed_counts_have_no_bias(spark, a, b, own):
    """One heavy word, and words of each text's own: the heavy word counts by its weight."""
    rows = []
    for k in range(20):
        rows += [(2 * k + side, " ".join([f"buy{k}"] * n + [f"o{k}.{side}.{i}" for i in range(own)])) for side, n in enumerate((a, b))]
    got = [r.near_next for r in weighted_sampling.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id % 2 == 0]
    truth = min(a, b) / (max(a, b) + 2 * own)
    assert abs(np.mean(got) - truth) < 0.03 and np.abs(np.array(got) - truth).max() < 0.2


def test_likeness_of_zipf_and_short_texts(spark):
    """Counts with a heavy tail, short texts, and one word 200 times: no bias, and the printed fingerprints tell the likeness."""
    rng = np.random.default_rng(9)
    pairs = [(["b"] * 200 + [f"x{i}" for i in range(20)], ["b"] * 200 + [f"y{i}" for i in range(20)])]
    for k in range(60):
        p = 1 / np.arange(1, 301)
        size = 400 if k % 2 else 12
        pairs.append(tuple([f"z{k}.{i}" for i in rng.choice(300, size, p=p / p.sum())] for _ in range(2)))
    rows = [(2 * k + side, " ".join(w)) for k, both in enumerate(pairs) for side, w in enumerate(both)]
    got = {r.doc_id: r for r in weighted_sampling.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = np.array([got[2 * k].near_next for k in range(len(pairs))])
    truth = np.array([brute.generalised_jaccard(" ".join(a), " ".join(b)) for a, b in pairs])
    assert abs(found[0] - truth[0]) < 0.1 and abs((found - truth).mean()) < 0.02 and np.sqrt(((found - truth) ** 2).mean()) < 0.06
    six = lambda text: {text[i : i + 6] for i in range(0, len(text), 6)}
    for k in range(len(pairs)):
        a, b = six(got[2 * k].fingerprint), six(got[2 * k + 1].fingerprint)
        assert got[2 * k].near_next == pytest.approx(len(a & b) / len({x[:2] for x in a | b}))


def test_order_of_extreme_hot_and_missing_ids(spark):
    """Ids at both ends of a long, an id and nulls with a third of the rows each: ranges are split by texts too."""
    rows = [(-(2**63), "low a"), (2**63 - 1, "high b")] + [(None, f"null {k}") for k in range(50)] + [(7, f"hot {k}") for k in range(50)] + [(k, f"own {k}") for k in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = weighted_sampling.in_order(df, 9).collect()
    signed = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    after = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    assert {r.text: r.next_text for r in got} == after
    sizes = Counter(r.range for r in got)
    assert len(sizes) >= 7 and max(sizes.values()) < 60


def test_sampling_runs_no_python(frame):
    plan = weighted_sampling.fingerprint_edits(frame.limit(5))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# 7: URLs


def test_urls(spark, frame, multiset):
    urls = [None, "", "no scheme", "https://A.Example.NET/en/1", "http://x.net/a", "http://net/", "http://bad.net", "http://example.com/de/x?y", "http://notexample.com/de/x", "http://k.org/fr/", "http://k.org/en/", "http://q/x#y", "x://spam-farm.example.com/en/1", "x://freebets.example.com", "x://quiet.example.com/en/2?spam", "a://b://c.net/d", "http://é.net/ü\n"]
    ordinary = [(1000 + k, f"http://site{'abcdefghij'[k % 10]}.example.com/en/{k}", "h", "n") for k in range(400)]
    pages = spark.createDataFrame(ordinary + [(k, u, "h", "n") for k, u in enumerate(urls)] + [(3, urls[3], "h", "n"), (None, urls[4], "h", "n")], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, frame).collect()}
    assert len(got) == 400 + len(urls) + 1 and all(got[1000 + k].verdict == "allow" for k in range(400))
    assert [(got[k].host, got[k].path) for k in (0, 2, 3, 7, 11, 15)] == [("", ""), ("", ""), ("a.example.net", "/en/1"), ("example.com", "/de/x"), ("q", "/x"), ("b:", "//c.net/d")]
    assert [got[k].rule for k in (3, 4, 5, 6, 7, 8, 9, 10, 16)] == ["example.net/en/", "net/", "net/", None, "example.com/de/", None, "org/fr/", None, "net/"]
    assert [got[k].verdict for k in (0, 3, 4, 7, 9, 12, 13, 14)] == ["allow", "allow", "block", "block", "allow", "block", "block", "allow"]
    assert "free" in got[13].host_tokens and "bets" in got[13].host_tokens
    assert url_filter.judge(pages.limit(0), frame).count() == 0
    assert url_filter.judge(pages, frame.limit(0)).count() == 400 + len(urls) + 2


def test_a_hot_unwanted_host_is_blocked(spark, frame):
    """A third of all pages are of one unwanted host: it can't vouch for itself."""
    urls = [f"http://m.casino-win.example.com/en/{k}" for k in range(200)] + [f"http://site{'abcdefghij'[k % 10]}.example.com/en/{k}" for k in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, frame).collect()}
    assert {got[k] for k in range(200)} == {"block"} and {got[k] for k in range(200, 600)} == {"allow"}


def test_unwanted_words_are_learned_from_the_pages(spark, frame):
    """Words beside seeds, in hosts and by paths, block other hosts; single ambiguous words don't; last labels count."""
    hosts = ["a.site.xxx", "online.casino", "nude-cams.example.com", "nude-cams.example.info", "nude-cams.other.info", "www.family-farm.example.org", "track.example.org", "spam-farm.example.com"]
    urls = [f"http://{h}/en/{k}" for h in hosts for k in range(3)]
    urls += [f"http://nude-cams.shop{k}.example.com/casino/porn/{k}" for k in range(6)] + [f"http://site{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghij'[k // 26]}.example.com/en/{k}" for k in range(200)]
    got = {r.host: r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), frame).collect()}
    assert [h for h in hosts if got[h] == "allow"] == ["www.family-farm.example.org", "track.example.org"]
    assert all(v == "allow" for h, v in got.items() if h.startswith("site"))


def test_url_query_is_that_of_brute_force(spark):
    """The whole query over whole tables, each page's host, path, rule and verdict."""
    sf_dir = "/root/testdata/sf0.001"
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op7_url_filter(spark, sf_dir).collect()}
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rules = [(r.host, r.path, r.verdict) for r in url_filter.RULES]
    assert got == brute.url_verdicts(pages, texts, rules, set(url_filter.SEEDS), url_filter.UNWANTED)
    assert {"allow", "block"} == {v for _, _, rule, v in got.values() if rule is None}


@pytest.mark.parametrize("parts", (1, 3))
def test_hot_hosts_meet_their_scores(spark, frame, monkeypatch, parts):
    """With whatever limit of hot keys, each page gets the verdict, score and tokens of its host and shape."""
    urls = [None, "x", *[f"http://casino.example.com/en/{k}" for k in range(60)], *[f"http://site{k % 7}.example.com/{'abc'[k % 3]}/{k}" for k in range(60)]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(map(repr, url_filter.judge(pages, frame).collect()))
    monkeypatch.setattr(url_filter, "HOT_PARTS", parts)
    assert sorted(map(repr, url_filter.judge(pages, frame).collect())) == want and len(want) == len(urls)


def test_viterbi():
    counts = {"the": 50, "them": 20, "me": 30, "park": 10, "mepark": 1}
    assert url_filter.viterbi("themepark", counts, 200) == ["the", "me", "park"]
    assert url_filter.viterbi("zq", counts, 200) == ["zq"] and url_filter.viterbi("", counts, 200) == [] and url_filter.viterbi("ab", {}, 0) == ["ab"]


# 8: substring dedup


@pytest.mark.parametrize("common", [0, 1000])
def test_repeats(frame, empty, docs, multiset, common):
    got = suffix_dedup.repeats(frame, shard_mb=0.0005, common_shards=common).collect()
    want = [(i, len(w), sum(g), " ".join(x for x, gone in zip(w, g) if not gone)) for (i, _), (w, g) in zip(docs, brute.removed(docs))]
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == multiset(want)
    assert suffix_dedup.repeats(empty).count() == 0


def test_without_repeats_keeps_rows(frame, docs):
    kept = suffix_dedup.without_repeats(frame)
    assert kept.columns == frame.columns and kept.count() == len(docs)
    untouched = [i for (i, _), (_, g) in zip(docs, brute.removed(docs)) if i is not None and not any(g)]
    before, after = ({r.doc_id: r for r in f.collect()} for f in (frame, kept))
    assert all(before[i].text == after[i].text and before[i].source == after[i].source for i in untouched)
    assert all(r.n_chars == len(r.text or "") for r in after.values())


# 9: quality rules


def test_quality_rules(frame, empty, docs, multiset):
    got = quality_rules.judge(frame).collect()
    want = []
    for i, t in docs:
        n, chars, symbols, lines, repeats = brute.base_rules(t)
        want.append((i, n, chars, symbols, lines, repeats, n < 50 or 100 * repeats > 50 * n))
    assert multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == multiset(want)
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality_rules.only_kept(frame)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.only_kept(empty).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(k, good if k % 20 == 0 else "short", "farm") for k in range(200)]
    rows += [(1000 + k, "short" if k % 20 == 0 else good, f"site{k % 9}") for k in range(900)] + [(5000, good, "new"), (5001, "short", "unlucky"), (5002, good, None)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0].kept and not got[0].base_failed and got[0].host_rate > 0.8
    assert got[1001].kept and got[5000].kept and got[5002].kept
    # One failure out of one is shrunk well below the rate that it shows.
    assert got[5001].host_rate < 0.8


def test_host_rule_on_the_driver_s_table(spark):
    """On the table as it is no host deviates, so only base failures go; where one host's documents are cut to
    half of them failing, its sound documents go too, and no other host's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    asis = quality_rules.judge(docs).collect()
    assert all(r.kept != r.base_failed for r in asis)
    bad = F.when((F.col("source") == "src3") & (F.col("doc_id") % 40 < 20), "cut").otherwise(F.col("text"))
    got = {r.doc_id: r for r in quality_rules.judge(docs.withColumn("text", bad), carry=("doc_id", "source")).collect()}
    assert {r.source for r in got.values() if not r.kept and not r.base_failed} == {"src3"}
    assert not any(r.kept for r in got.values() if r.source == "src3")


def test_quality_rules_run_no_python(frame):
    plan = quality_rules.base_rules(frame, ["doc_id"])._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


