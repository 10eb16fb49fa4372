"""Plans made of expressions against the writer's choices, on rasters of all kinds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.codec import huffman, writing
from rasterloom.operators import planning
from rasterloom.plans import choices

SF = "/root/testdata/sf0.01"
SCHEMA = "raster_id int, y int, x int, dim int, value double, valid boolean"


def kinds(kind, seed=0):
    """Rasters (values, mask) that take all bodies: even, by depth, smooth, rough, few values, nearly equal dimensions, masked."""
    rng = np.random.default_rng(seed)
    top = 200 if kind in ("u8", "i8") else 30_000 if kind in ("i16", "u16") else 10**6
    low = -top // 2 if kind[0] != "u" and kind != "i8" else -100 if kind == "i8" else 0
    shapes = [(9, 17, 1), (16, 16, 2), (5, 30, 3), (20, 12, 2), (8, 8, 1), (33, 10, 2)]
    out = []
    for h, w, d in shapes:
        y, x = np.indices((h, w))
        rough = rng.integers(low, low + top, (h, w, d)).astype(float)
        near = np.cumsum(np.concatenate([rough[:, :, :1], rng.integers(0, 3, (h, w, d - 1))], axis=2), axis=2)
        near = np.minimum(near, low + top - 1)
        few = rng.choice([low, low + top // 2, low + top - 1], (h, w, d), p=[0.9, 0.05, 0.05])
        found = [np.full((h, w, d), 3.0), np.broadcast_to(np.arange(d) + 3.0, (h, w, d)), (y // 16 + 0 * x)[:, :, None] + np.zeros(d), rough, near, few, (y * 2 + x)[:, :, None] + np.arange(d)]
        for v in found:
            out.append((v, None))
            out.append((v, rng.random((h, w)) < 0.6))
    out.append((np.ones((4, 4, 2)), np.zeros((4, 4), bool)))
    if kind in ("f32", "f64"):
        out += [(np.round(v / 7, 3).astype(np.float32).astype(float), m) for v, m in out[:40]]
    return out


def frame(spark, made):
    rows = []
    for k, (v, mask) in enumerate(made):
        h, w, d = v.shape
        ok = np.ones((h, w), bool) if mask is None else mask
        rows += [(k, y, x, c, float(v[y, x, c]), bool(ok[y, x])) for y in range(h) for x in range(w) for c in range(d)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("kind, error", [("u8", 0.5), ("i8", 0.5), ("i16", 2.0), ("u16", 0.5), ("i32", 0.5), ("u32", 3.0), ("f32", 0.0), ("f64", 0.0), ("f64", 0.6)])
def test_bodies_are_the_writer_s(spark, kind, error):
    made = kinds(kind)
    got = {r.raster_id: r for r in planning.body_plan(frame(spark, made), error, kind).collect()}
    seen = set()
    for k, (v, mask) in enumerate(made):
        p = writing.prepare(v, kind, mask, writing.Options(error))
        if p.max_z != error:  # raised to a decimal grid
            continue
        body = "depths" if p.body == "constant" and p.ranges is not None else p.body
        assert (got[k].body, got[k].micro, got[k].bytes) == (body, p.micro, p.body_size), (k, kind)
        assert got[k].version == (p.version if body not in ("constant", "depths") else 4)
        seen.add((body, p.micro, p.version))
    bodies = {b for b, _, _ in seen}
    assert bodies >= {"constant", "depths", "tiles"} or error == 0
    if kind in ("u8", "i8"):
        assert "huffman" in bodies and any(b == "tiles" and side == 16 for b, side, _ in seen)
    if error == 0.5 and kind in ("i32", "u16", "u8"):
        assert any(version == 5 for _, _, version in seen)


def test_tiles_are_the_writer_s(spark):
    made = kinds("i16", 3)
    got = {}
    for r in planning.tile_plan(frame(spark, made), 0.5, "i16").collect():
        got.setdefault(r.raster_id, []).append(r)
    for k, (v, mask) in enumerate(made):
        p = writing.prepare(v, "i16", mask, writing.Options(0.5))
        (plans, _, grid), size, _ = writing.plan_tiles(p, 8, False)
        across = -(-v.shape[1] // 8)
        for r in got.get(k, []):
            plan, at = plans[r.dim], r.by * across + r.bx
            assert (r.form, r.bytes, r["diff"], r.tabled) == (plan.form[at], plan.size[at], bool(plan.diff[at]), bool(plan.table[at])), (k, r)
        assert sum(r.bytes for r in got.get(k, [])) + int((grid.n == 0).sum()) * v.shape[2] == size


def test_code_lengths_are_the_writer_s(spark):
    rng = np.random.default_rng(2)
    made = [rng.integers(0, 50, 256) * (rng.random(256) < p) for p in (0.02, 0.1, 0.5, 1.0) for _ in range(4)]
    made += [np.eye(256, dtype=int)[7] * 5, np.ones(256, int), 2 ** np.minimum(np.arange(256), 20) * (np.arange(256) < 30), np.zeros(256, int)]
    fibonacci = np.zeros(256, int)
    fibonacci[:2] = 1
    for k in range(2, 40):
        fibonacci[k] = fibonacci[k - 1] + fibonacci[k - 2]
    made.append(fibonacci)  # codes over 31 bits: not written
    rows = [(k, [(int(s), int(n)) for s, n in enumerate(c) if n]) for k, c in enumerate(made)]
    df = spark.createDataFrame(rows, "k int, counts array<struct<symbol:int,n:long>>").withColumn("codes", planning.code_lengths(F.col("counts")))
    got = {r.k: r for r in df.withColumn("bytes", planning.code_size(F.col("codes"))).collect()}
    for k, counts in enumerate(made):
        want = huffman.code_lengths(counts)
        assert (got[k].codes is None) == (want is None)
        if want:
            assert {c.symbol: c.length for c in got[k].codes} == {s: n for s, (n, _) in want.items()}
            assert got[k].bytes == huffman.candidate(np.repeat(np.arange(256), counts) if counts.sum() < 10**6 else np.arange(0))[0] if counts.sum() < 10**6 else True


def test_all_six_bodies_are_taken(spark):
    found = choices.plan_choice_u8(spark, SF).collect()
    assert {r.body for r in found} == {"constant", "depths", "sweep", "huffman", "tiles"} and {r.micro for r in found if r.body == "tiles"} == {8, 16} and {r.version for r in found} == {4, 5}


def test_plans_run_no_python_and_deal_once(spark):
    plan = planning.tile_plan(choices.rasters.order_pairs(spark, SF), 0.5, "i32")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow")) and plan.count("Exchange") == 1
    with pytest.raises(ValueError):
        planning.body_plan(choices._u8(spark, SF), 0.0, "u8")
