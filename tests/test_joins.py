import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.hashing import bucket, hash32, slice_of
from millrace.operators import bloom, distribute, metrics, partition
from millrace.operators import join as joins
from millrace.operators.join import Strategy, relation
from millrace.plans import sizing
from millrace.plans.run import run


def rel(spark, rows):
    return spark.createDataFrame(rows, "key long, val long").repartition(3)


def by_hand(r, s):
    return sorted((k, a, b) for k, a in r for j, b in s if k is not None and k == j)


R = [(i % 7 - 3, i) for i in range(40)] + [(-(1 << 31), 1), (None, 2), ((1 << 31) - 1, 3)]
S = [(i % 11 - 5, i) for i in range(60)] + [(-(1 << 31), 4), (None, 5), ((1 << 31) - 1, 6)]


@pytest.mark.parametrize("strategy", list(Strategy))
def test_strategies_give_every_pair(spark, strategy):
    out = joins.inner_join(rel(spark, R), rel(spark, S), strategy)
    assert sorted(map(tuple, out.collect())) == by_hand(R, S)
    assert joins.match_count(rel(spark, R), rel(spark, S), strategy).first()[0] == len(by_hand(R, S))


def test_counts_by_multiplicity_agree(spark):
    assert joins.counted_matches(rel(spark, R), rel(spark, S)).first()[0] == len(by_hand(R, S))


@pytest.mark.parametrize("r,s", [([], S), (R, []), ([], [])])
def test_empty_sides(spark, r, s):
    a, b = rel(spark, r), rel(spark, s)
    assert joins.inner_join(a, b).count() == 0
    assert joins.counted_matches(a, b).first()[0] == 0
    assert joins.matched_rows(a, b).first()["percent"] == 0
    out = run(a, b, sizing.Options(mode=14, skew=1.4, replicate_ratio=4.5))
    assert out.matches.first()[0] == 0


def test_a_heavy_key_keeps_all_its_pairs(spark):
    r = spark.range(10_100).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("val"))
    s = rel(spark, [(7, 1), (7, 2), (7, 3), (8, 4)])
    assert joins.match_count(r, s).first()[0] == 30_300
    assert joins.first_match_join(r, s).count() == 3
    assert partition.overflows(r, 128, 67).first()["overflows"] == 1


def test_a_replicated_side_that_is_too_large_is_shuffled(spark):
    a, b = joins.placed(rel(spark, R), rel(spark, S), Strategy.REPLICATE_R, limit=1)
    assert "broadcast" not in str(a._jdf.queryExecution().logical()).lower()


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        relation(spark.createDataFrame([("a", 1)], "k string, v long"), "k", "v")


def test_hash_and_buckets_on_unsigned_numbers(spark):
    keys = [0, 1, -1, 5, -5, 2**31 - 1, -(2**31), 123456789]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")

    def expected(v, seed):
        h = (seed ^ v) & 0xFFFFFFFF
        for factor, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
            h = h * factor & 0xFFFFFFFF
            h ^= h >> shift
        return h

    for seed in (0, 1, 2, 7):
        assert [r[0] for r in frame.select(hash32(F.col("key"), seed)).collect()] == [expected(k, seed) for k in keys]
    assert [r[0] for r in frame.select(bucket(F.col("key"), 67)).collect()] == [(k & 0xFFFFFFFF) % 67 for k in keys]


@pytest.mark.parametrize("n,slices", [(10, 4), (3, 4), (8, 4), (0, 2)])
def test_slices_of_positions(spark, n, slices):
    found = [r[0] for r in spark.range(n).select(slice_of(F.col("id"), n, slices)).collect()]
    each = n // slices
    assert found == [min(i // each, slices - 1) if each else slices - 1 for i in range(n)]


@pytest.mark.parametrize("layout", bloom.LAYOUTS)
@pytest.mark.parametrize("rate", [0.1, 0.01])
def test_filters_lose_no_key(spark, layout, rate):
    r = spark.range(2000).select((F.col("id") * 37 - 20_000).alias("key"), F.col("id").alias("val"))
    bits, hashes = sizing.filter_size(2000, rate)
    shape = bloom.Shape(bits, hashes, layout)
    words = bloom.build(r, shape)
    assert bloom.passing(r, words, shape).count() == 2000
    others = spark.range(20_000).select((F.col("id") + 1_000_000).alias("key"), F.col("id").alias("val"))
    share = bloom.candidate_rate(others, words, shape).first()
    assert share["percent"] < 250 * rate
    assert 0.2 < bloom.fill(words, shape).first()["ratio"] < 0.7


def test_partitioned_filters_lose_no_key(spark):
    r = rel(spark, [(i * 3, i) for i in range(-500, 500)])
    shape = bloom.Shape(8192, 3, segments=8)
    words = bloom.build(r, shape)
    assert bloom.passing(r, words, shape).count() == 1000
    flagged = bloom.passing(rel(spark, [(None, 1), (3, 2)]), words, shape, "in")
    assert sorted((r.val, r["in"]) for r in flagged.collect()) == [(1, False), (2, True)]


def test_large_filters_are_shuffled(spark, monkeypatch):
    r, s = rel(spark, R), rel(spark, S)
    shape = bloom.Shape(4096, 3)
    words = bloom.build(r, shape)
    before = sorted(map(str, bloom.passing(s, words, shape).collect()))
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", -1)
    assert sorted(map(str, bloom.passing(s, words, shape).collect())) == before


def test_merged_slices_are_the_whole_filter(spark):
    r = rel(spark, [(i, i) for i in range(300)]).withColumn("slice", F.col("key") % 3)
    shape = bloom.Shape(2048, 3)
    whole = sorted(map(tuple, bloom.build(r, shape).select("seg", "word", "bits").collect()))
    parts = bloom.build(r, shape, "slice")
    assert sorted(map(tuple, bloom.merge(parts).select("seg", "word", "bits").collect())) == whole
    assert sorted(map(tuple, bloom.merge_by_bits(parts).select("seg", "word", "bits").collect())) == whole


def test_without_hashes_all_rows_pass(spark):
    assert sizing.filter_size(1000, 0.6)[1] == 0
    shape = bloom.Shape(1000, 0)
    assert bloom.passing(rel(spark, S), bloom.build(rel(spark, R), shape), shape).count() == len(S) - 1


def test_indexes_end_at_the_number_of_rows(spark):
    r = rel(spark, R)
    rows = partition.level1_index(r, 16).orderBy("b1").collect()
    assert [x.b1 for x in rows] == list(range(16))
    assert rows[-1].bound == len(R) - 1
    assert all(x.bound - x.cnt == x.first for x in rows)
    last = partition.level2_index(r, 16, 5).groupBy("b1").agg(F.max("bound").alias("n")).collect()
    assert {x.b1: x.n for x in last} == {x.b1: x.cnt for x in rows if x.cnt}
    assert partition.clustered(r, 16, 5).count() == len(R)


def greedy(sizes):
    """Surplus goes to deficit in slice order, pair by pair."""
    n, total = len(sizes), sum(sizes)
    goal = [total // n + (i < total % n) for i in range(n)]
    over = [s - g for s, g in zip(sizes, goal, strict=True)]
    out, sent, got = [], [0] * n, [0] * n
    for a in range(n):
        for b in range(n):
            if over[a] > 0 > over[b]:
                x = min(over[a], -over[b])
                out.append((a, b, x, goal[a] + sent[a], sizes[b] + got[b]))
                over[a] -= x
                over[b] += x
                sent[a] += x
                got[b] += x
    return sorted(out)


@pytest.mark.parametrize("sizes", [[10, 0, 2], [0, 0, 0], [5, 5, 5], [1], [7, 0, 0, 0, 9, 1, 30, 2], *np.random.default_rng(0).integers(0, 40, (6, 6)).tolist()])
def test_plans_even_out_sizes(spark, sizes):
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "slice long, n long")
    assert sorted(map(tuple, distribute.plan(frame).collect())) == greedy(sizes)
    goal = [r.target for r in distribute.targets(frame).orderBy("slice").collect()]
    assert sum(goal) == sum(sizes) and max(goal) - min(goal) <= 1
    skew = distribute.skew(frame, 1.4).first()
    mean = sum(sizes) / len(sizes)
    assert skew["imbalance"] == pytest.approx(max(sizes) / mean if mean else 1.0)
    assert skew["rebalance"] == (sum(sizes) > 0 and max(sizes) / mean > 1.4)


def test_gates_and_owners(spark):
    r, c = rel(spark, [(i, i) for i in range(10)]), rel(spark, [(i, i) for i in range(20)])
    for ratio, expected in ((0, True), (5.9, True), (6.1, False), (-1, False)):
        assert distribute.replicate_gate(r, c, 3, ratio).first()["replicate"] is expected
    rows = spark.range(64).select(F.col("id").alias("key"), (F.col("id") % 4).alias("slice"))
    found = distribute.send_matrix(rows, 16, 4)
    assert found.agg(F.sum("n")).first()[0] == 64
    assert found.where("src = 0").agg(F.max("first")).first()[0] == 0


@pytest.mark.parametrize(
    "options",
    [
        sizing.Options(),
        sizing.Options(mode=14, skew=1.01, replicate_ratio=0.5, chunks=3, first=16),
        sizing.Options(mode=5, shuffle_r=True),
        sizing.Options(mode=13, replicate_ratio=0),
        sizing.Options(mode=2, rate=0.9),
        sizing.Options(mode=9, bits=512, hashes=2),
    ],
)
def test_runs_give_the_same_pairs(spark, options):
    out = run(rel(spark, R), rel(spark, S), options)
    assert sorted(map(tuple, out.pairs.collect())) == by_hand(R, S)
    assert out.matches.first()[0] == len(by_hand(R, S))


def test_a_capped_answer_counts_exactly(spark):
    out = run(rel(spark, R), rel(spark, S), sizing.Options(answer_rows=5))
    assert out.pairs.count() == 5
    assert out.matches.first()[0] == len(by_hand(R, S))


@pytest.mark.parametrize("wrong", [{"mode": 11}, {"chunks": 0}, {"shuffle_r": True, "replicate_ratio": 1.0}, {"mode": 3, "replicate_ratio": 0.0}, {"mode": 5, "replicate_ratio": 2.0}])
def test_options_that_dont_go_together(wrong):
    with pytest.raises(ValueError):
        sizing.Options(**wrong)


def test_sizes_of_buckets():
    assert sizing.filter_size(640_000_000, 0.1) == (3_067_218_680, 3) or sizing.filter_size(640_000_000, 0.1)[1] == 3
    assert sizing.first_level(10, 10, False) == 128
    assert sizing.first_level(10, 10, True) == 1
    assert sizing.first_level(10, 10, True, 9999) == 2048
    assert sizing.second_level(1000, 128, False) == 67
    assert sizing.second_level(200_000_000, 128, False) % 2 == 1
    assert sizing.second_level(10**11, 128, True) == 4095
    with pytest.raises(ValueError):
        sizing.second_level(10**11, 128, False)


def test_metric_summary(spark):
    rows = [(0, "Read R", 1.0), (1, "Read R", 3.0), (0, "Probe", 1.0), (1, "Probe", 2.0), (0, "Total", 4.0), (1, "Total", 2.0)]
    found = {r.metric: r for r in metrics.summary(spark.createDataFrame(rows, "pe int, metric string, seconds double")).collect()}
    assert (found["Read R"].max_seconds, found["Read R"].max_percent) == (3.0, None)
    assert (found["Probe"].max_percent, found["Probe"].mean_percent) == (50.0, 50.0)


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("layout", bloom.LAYOUTS)
def test_s_stays_where_it_is_if_the_filter_can_be_sent(spark, layout):
    r, s = rel(spark, R).coalesce(1), spark.range(1000).select((F.col("id") - 5).alias("key"), F.col("id").alias("val"))
    shape = bloom.Shape(4096, 3, layout)
    plan = bloom.passing(s, bloom.build(r, shape), shape)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("scalar-subquery")[0] and shape.passes == 1


@pytest.mark.parametrize("segments", [0, 8])
def test_filters_in_parts_read_s_once_for_each(spark, monkeypatch, segments):
    r = spark.range(3000).select((F.col("id") * 7 - 900).alias("key"), F.col("id").alias("val"))
    s = spark.range(30_000).select((F.col("id") - 2000).alias("key"), F.col("id").alias("val"))
    shape = bloom.Shape(32_768, 3, segments=segments)
    words = bloom.build(r, shape)
    whole = sorted(map(tuple, bloom.passing(s, words, shape, "in").collect()))
    assert sum(x[2] for x in whole) >= 3000
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", 1 << 10)
    assert shape.passes == 4
    parts = bloom.passing(s, words, shape, "in")
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("Union") >= 1
    assert sorted(map(tuple, parts.collect())) == whole
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", 64)
    assert shape.passes == 0
    moved = bloom.passing(s, words, shape)
    assert exchanges(moved) <= 3  # S once, the filter's words and their blocks
    assert sorted(map(tuple, moved.collect())) == [x[:2] for x in whole if x[2]]


def test_runs_keep_candidates_only_for_a_gate(spark):
    out = run(rel(spark, R), rel(spark, S), sizing.Options(mode=14, skew=1.4, replicate_ratio=4.5, first=16))
    assert out.kept and out.candidates.is_cached
    out.release()
    assert not out.candidates.is_cached
    assert not run(rel(spark, R), rel(spark, S), sizing.Options(mode=2)).kept


def test_chunks_are_united(spark):
    out = run(rel(spark, R), rel(spark, S), sizing.Options(mode=2, chunks=3))
    assert sorted(map(tuple, out.pairs.collect())) == by_hand(R, S)
    assert out.pairs._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_pairs_in_one_number(spark):
    rows = [(0, 0), (-1, 5), (5, -1), (-(2**31), 2**31 - 1)]
    packed = joins.as_pairs(rel(spark, rows))
    assert sorted(r.pair for r in packed.collect()) == sorted((k << 32) | (v & 0xFFFFFFFF) for k, v in rows)
    assert sorted(map(tuple, joins.from_pairs(packed).collect())) == sorted(rows)
