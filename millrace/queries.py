"""A query for each operator of the joins, and the statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.hashing import FIRST_FACTOR, SECOND_FACTOR, chunk_of, slice_of
from .operators import bloom, distribute, metrics, partition
from .operators import join as joins
from .operators.join import Strategy, relation
from .plans import sizing
from .plans.run import run
from .sources import generator, raw
from .sources.workspace import new_path
from .streaming import chunks

Query = Callable[[SparkSession, str], DataFrame]

#: Slices, chunks of a slice, buckets of the two levels, and the filter's rate in the queries.
SLICES, CHUNKS, FIRST, SECOND, RATE = 4, 3, 128, 67, 0.1

#: Bits and hashes of the filters that SQL builds too.
SHAPE = bloom.Shape(14_080, 3)
PARTS = bloom.Shape(32_768, 3, segments=16)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "o_orderkey", "o_custkey")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R with duplicate keys."""
    return relation(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S with duplicate keys; its values are positions from 0."""
    return relation(table(spark, sf_dir, "events"), "user_id", "event_id")


R = "select o_orderkey as key, o_custkey as val from orders"
URGENT = f"{R} where o_orderpriority = '1-URGENT'"
S = "select l_orderkey as key, l_partkey as val from lineitem"
CUST = "select o_custkey as key, o_orderkey as val from orders"
EV = "select user_id as key, event_id as val from events"


def pairs_sql(r: str = R, s: str = S) -> str:
    return f"select s.key, r.val as r_val, s.val as s_val from ({r}) r join ({s}) s on r.key = s.key"


@query(pairs_sql())
def inner_join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inner_join(orders(spark, sf_dir), lineitem(spark, sf_dir))


@query(f"select count(*) as matches from ({pairs_sql()})")
def inner_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.match_count(orders(spark, sf_dir), lineitem(spark, sf_dir))


@query(pairs_sql(CUST, EV))
def inner_join_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inner_join(customers(spark, sf_dir), events(spark, sf_dir))


@query(pairs_sql(f"select key, min(val) as val from ({CUST}) group by key", EV))
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_match_join(customers(spark, sf_dir), events(spark, sf_dir))


@query(pairs_sql())
def shuffle_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inner_join(orders(spark, sf_dir), lineitem(spark, sf_dir), Strategy.SHUFFLE_HASH)


@query(pairs_sql())
def sort_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inner_join(orders(spark, sf_dir), lineitem(spark, sf_dir), Strategy.MERGE)


@query(pairs_sql())
def broadcast_r_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inner_join(orders(spark, sf_dir), lineitem(spark, sf_dir), Strategy.REPLICATE_R)


@query(pairs_sql())
def broadcast_s_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inner_join(orders(spark, sf_dir), lineitem(spark, sf_dir), Strategy.REPLICATE_S)


@query(pairs_sql(URGENT))
def filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default run: a partitioned filter, rebalancing and the gate for replication."""
    options = sizing.Options(mode=14, rate=RATE, slices=SLICES, skew=1.4, replicate_ratio=4.5, first=512)
    return run(urgent(spark, sf_dir), lineitem(spark, sf_dir), options).pairs


@query(f"select count(*) as matches from ({pairs_sql(CUST, EV)})")
def sanity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.counted_matches(customers(spark, sf_dir), events(spark, sf_dir))


@query(f"select count(*) as rows, count(*) filter (found) as matched, count(*) filter (found) * 100.0::double / count(*) as percent from (select key in (select key from ({EV})) as found from ({CUST}))")
def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.matched_rows(customers(spark, sf_dir), events(spark, sf_dir))


@query(f"select key, val, key in (select key from ({URGENT})) as member from ({S})")
def exact_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.membership(lineitem(spark, sf_dir), urgent(spark, sf_dir))


def sliced(rel: DataFrame, position: str, slices: int = SLICES) -> DataFrame:
    """The relation with the slice of each position. The number of rows is one value."""
    rows = rel.agg(F.count("*")).scalar()
    return rel.withColumn("rows", rows).withColumn("slice", slice_of(F.col(position), F.col("rows"), slices))


def slice_sql(position: str, source: str, slices: int = SLICES) -> str:
    return f"least({position} // greatest((select count(*) from ({source})) // {slices}, 1), {slices - 1})"


@query(
    f"""with m as (select {slice_sql("s.val", EV)} as slice, count(*) as matches from ({CUST}) r join ({EV}) s on r.key = s.key group by 1)
    select cast(slice as bigint) as slice, matches from m union all select null, cast(sum(matches) as bigint) from m"""
)
def per_slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each slice of S, and of all in the row without a slice."""
    s = sliced(events(spark, sf_dir), "val").select("key", "slice")
    return s.join(customers(spark, sf_dir).select("key"), "key").rollup("slice").agg(F.count("*").alias("matches"))


def u32_sql(key: str) -> str:
    return f"(cast({key} as bigint) & 4294967295)"


COUNTS1 = f"select range as b1, count(r.key) as cnt from range({FIRST}) left join ({CUST}) r on {u32_sql('r.key')} % {FIRST} = range group by 1"


@query(COUNTS1)
def level1_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.histogram(customers(spark, sf_dir), FIRST)


@query(f"select b1, cnt, cast(sum(cnt) over (order by b1) as bigint) as bound, cast(sum(cnt) over (order by b1) - cnt as bigint) as first from ({COUNTS1})")
def level1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.level1_index(customers(spark, sf_dir), FIRST)


COUNTS2 = f"select {u32_sql('key')} % {FIRST} as b1, {u32_sql('key')} % {SECOND} as b2, count(*) as cnt from ({CUST}) group by 1, 2"


@query(f"select b1, b2, cnt, cast(sum(cnt) over (partition by b1 order by b2) as bigint) as bound, cast(sum(cnt) over (partition by b1 order by b2) - cnt as bigint) as first from ({COUNTS2})")
def level2_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.level2_index(customers(spark, sf_dir), FIRST, SECOND)


@query(f"select count(*) filter (cnt >= {partition.TABLE_ROWS}) as overflows, max(cnt) as largest from ({COUNTS2})")
def overflow_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.overflows(customers(spark, sf_dir), FIRST, SECOND)


@query(f"select key, val, {u32_sql('key')} % {FIRST} as b1, {u32_sql('key')} % {SECOND} as b2 from ({R})")
def bucket_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.clustered(orders(spark, sf_dir), FIRST, SECOND)


@query(
    f"""with m as (select cast({slice_sql("val", EV)} as bigint) as src, ({u32_sql("key")} % {FIRST}) // {FIRST // SLICES} as dst, count(*) as n from ({EV}) group by 1, 2)
    select src, dst, n, cast(sum(n) over (partition by dst order by src) - n as bigint) as first from m"""
)
def send_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribute.send_matrix(sliced(events(spark, sf_dir), "val"), FIRST, SLICES)


def times_sql(h: str, factor: int) -> str:
    return f"((({h}) * {factor & 0xFFFF} + ((({h}) * {factor >> 16}) & 65535) * 65536) & 4294967295)"


def hash_sql(key: str, seed: str | int) -> str:
    """A scalar subquery for each step, so that the text doesn't double with each."""
    a = f"xor({u32_sql(key)}, cast({seed} as bigint))"
    b = f"(select {times_sql('x', FIRST_FACTOR)} as x from (select {a} as x))"
    c = f"(select xor(x, x >> 13) as x from {b})"
    d = f"(select {times_sql('x', SECOND_FACTOR)} as x from {c})"
    return f"(select xor(x, x >> 16) from {d})"


def bits_sql(source: str, shape: bloom.Shape, extra: str = "") -> str:
    """(key, val, seg, i, bit) of each hash of each row."""
    seg = f"{u32_sql('key')} % {shape.segments}" if shape.segments else "0"
    rows = f"select *, cast({seg} as bigint) as seg, unnest(range({shape.hashes})) as i from ({source})"
    return f"select *, {hash_sql('key', 1)} % {shape.whole // bloom.BLOCK} * {bloom.BLOCK} + {hash_sql('key', 'i + 1')} % {bloom.BLOCK} as bit from ({rows})"


def words_sql(source: str, shape: bloom.Shape) -> str:
    return f"select seg, bit // 32 as word, bit_or(cast(1 as bigint) << cast(bit % 32 as int)) as bits from ({bits_sql(source, shape)}) group by 1, 2"


def passing_sql(shape: bloom.Shape, r: str = URGENT, s: str = EV, unique: str = "val") -> str:
    """Rows of S all of whose bits some row of R has. `val` tells apart the rows of S."""
    have = f"select distinct seg, bit from ({bits_sql(r, shape)})"
    return f"select key, val from (select b.key, b.val, count(h.bit) as n from ({bits_sql(s, shape)}) b left join ({have}) h on b.seg = h.seg and b.bit = h.bit group by b.key, b.val) where n = {shape.hashes}"


@query(words_sql(URGENT, SHAPE))
def bloom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(urgent(spark, sf_dir), SHAPE)


@query(words_sql(URGENT, PARTS))
def bloom_partitioned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(urgent(spark, sf_dir), PARTS)


def slice_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter for each slice of R. Orders are dense, so a key is a position."""
    rows = table(spark, sf_dir, "orders").agg(F.count("*")).scalar()
    r = urgent(spark, sf_dir).withColumn("rows", rows).withColumn("slice", slice_of(F.col("key"), F.col("rows"), SLICES))
    return bloom.build(r, SHAPE, "slice")


@query(words_sql(URGENT, SHAPE))
def bloom_slice_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.merge(slice_words(spark, sf_dir))


@query(words_sql(URGENT, SHAPE))
def bloom_byte_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.merge_by_bits(slice_words(spark, sf_dir))


@query(passing_sql(SHAPE))
def bloom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.passing(events(spark, sf_dir), bloom.build(urgent(spark, sf_dir), SHAPE), SHAPE)


@query(passing_sql(SHAPE))
def bloom_refiltered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second filtering, as before a late exchange, changes nothing."""
    words = bloom.build(urgent(spark, sf_dir), SHAPE)
    return bloom.passing(bloom.passing(events(spark, sf_dir), words, SHAPE), bloom.merge(words), SHAPE)


@query(f"select cast(sum(bit_count(bits)) as bigint) as set_bits, cast({SHAPE.whole} as bigint) as all_bits, sum(bit_count(bits)) / {SHAPE.whole}::double as ratio from ({words_sql(URGENT, SHAPE)})")
def bloom_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.fill(bloom.build(urgent(spark, sf_dir), SHAPE), SHAPE)


@query(passing_sql(PARTS))
def bloom_partitioned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.passing(events(spark, sf_dir), bloom.build(urgent(spark, sf_dir), PARTS), PARTS)


@query(f"select (select count(*) from ({EV})) as rows, count(*) as candidates, count(*) * 100.0::double / (select count(*) from ({EV})) as percent from ({passing_sql(SHAPE)})")
def bloom_candidate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.candidate_rate(events(spark, sf_dir), bloom.build(urgent(spark, sf_dir), SHAPE), SHAPE)


@query(f"select {u32_sql('key')} % {FIRST} as b1, count(*) as candidates from ({passing_sql(SHAPE)}) group by 1")
def bloom_candidate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.candidate_histogram(events(spark, sf_dir), bloom.build(urgent(spark, sf_dir), SHAPE), SHAPE, FIRST)


def layout_sql(layout: str, shape: bloom.Shape, source: str) -> str:
    two = f"(({hash_sql('key', 1)} + i * {hash_sql('key', 2)}) & 4294967295)"
    bit = {"blocked_double": f"{hash_sql('key', 1)} % {shape.whole // bloom.BLOCK} * {bloom.BLOCK} + {two} % {bloom.BLOCK}", "double": f"{two} % {shape.whole}", "plain": f"{hash_sql('key', 'i')} % {shape.whole}"}[layout]
    return f"select key, val, i, {bit} as bit from (select *, unnest(range({shape.hashes})) as i from ({source}))"


def layout_query(layout: str) -> None:
    """The candidates under one of the other ways to place bits."""
    shape = bloom.Shape(SHAPE.bits, SHAPE.hashes, layout)

    def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bloom.passing(events(spark, sf_dir), bloom.build(urgent(spark, sf_dir), shape), shape)

    name = f"bloom_{layout}_candidates"
    QUERIES[name] = candidates
    ORACLE[name] = f"""with have as (select distinct bit from ({layout_sql(layout, shape, URGENT)}))
    select key, val from (select b.key, b.val, count(h.bit) as n from ({layout_sql(layout, shape, EV)}) b left join have h on b.bit = h.bit group by b.key, b.val) where n = {shape.hashes}"""


for _layout in bloom.LAYOUTS[1:]:
    layout_query(_layout)


@query(
    f"""select 'word' as kind, word as place, bits as value from ({words_sql(URGENT, SHAPE)}) union all
    select 'bucket', range, count(r.key) from range({FIRST}) left join ({URGENT}) r on {u32_sql("r.key")} % {FIRST} = range group by 2"""
)
def build_and_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's words and the buckets' counts, of one reading of R."""
    return bloom.build_with_histogram(urgent(spark, sf_dir), SHAPE, FIRST)


@query(f"select count(*) as rows, p.rate, cast(trunc(-count(*) * ln(p.rate) / (ln(2) * ln(2))) as bigint) as bits, cast(trunc((-count(*) * ln(p.rate) / (ln(2) * ln(2))) / count(*) * ln(2)) as bigint) as hashes from ({URGENT}), (values (0.1::double), (0.01::double), (0.6::double)) p(rate) group by p.rate")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urgent(spark, sf_dir).count()
    return spark.createDataFrame([(rows, p, *sizing.filter_size(rows, p)) for p in (0.1, 0.01, 0.6)], "rows bigint, rate double, bits bigint, hashes bigint")


SIZES = ((1_000, 14_273, False), (200_000_000, 3_067_218_680, True), (200_000_000, 3_067_218_680, False), (5_000_000_000, 23_962_645_943, True))


@query(
    f"""with t(n, bits, part) as (values {", ".join(f"(cast({n} as bigint), cast({b} as bigint), {str(p).lower()})" for n, b, p in SIZES)}),
    a as (select *, case when part then least(greatest((((bits + 7) // 8) + 4194303) // 4194304, (n + 255 * 8005 - 1) // (255 * 8005), 1), 2048) else 128 end as p1 from t),
    b as (select *, case when (n + p1 * 67 - 1) // (p1 * 67) <= 8005 then 67 else (n + p1 * 8005 - 1) // (p1 * 8005) | 1 end as p2 from a)
    select n, bits, part, cast(p1 as bigint) as first, cast(case when p2 > 4096 then 4095 else p2 end as bigint) as second from b"""
)
def auto_partition_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for n, bits, part in SIZES:
        first = sizing.first_level(n, bits, part)
        out.append((n, bits, part, first, sizing.second_level(n, first, part)))
    return spark.createDataFrame(out, "n bigint, bits bigint, part boolean, first bigint, second bigint")


def candidate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each slice of S whose key is an urgent order's."""
    s = joins.membership(sliced(events(spark, sf_dir), "val"), urgent(spark, sf_dir)).where("member")
    return distribute.slice_sizes(s, SLICES)


SIZES_SQL = f"select range as slice, count(s.val) as n from range({SLICES}) left join (select *, {slice_sql('val', EV)} as slice from ({EV}) where key in (select key from ({URGENT}))) s on s.slice = range group by 1"
TARGETS_SQL = f"select slice, n, cast(sum(n) over () // count(*) over () + case when slice < sum(n) over () % count(*) over () then 1 else 0 end as bigint) as target from ({SIZES_SQL})"


@query(TARGETS_SQL)
def redistribute_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribute.targets(candidate_sizes(spark, sf_dir))


@query(
    f"""with t as ({TARGETS_SQL}),
    o as (select slice as src, target, n - target as amount, cast(sum(n - target) over (order by slice) as bigint) as hi from t where n > target),
    u as (select slice as dst, n, target - n as amount, cast(sum(target - n) over (order by slice) as bigint) as hi from t where n < target)
    select src, dst, least(o.hi, u.hi) - greatest(o.hi - o.amount, u.hi - u.amount) as n,
      o.target + greatest(o.hi - o.amount, u.hi - u.amount) - (o.hi - o.amount) as src_first,
      u.n + greatest(o.hi - o.amount, u.hi - u.amount) - (u.hi - u.amount) as dst_first
    from o join u on o.hi - o.amount < u.hi and u.hi - u.amount < o.hi"""
)
def redistribute_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribute.plan(candidate_sizes(spark, sf_dir))


MEMBERS_SQL = f"select key, val, slice, row_number() over (partition by slice order by val) - 1 as place from (select *, {slice_sql('val', EV)} as slice from ({EV}) where key in (select key from ({URGENT})))"


@query(
    f"""with t as ({TARGETS_SQL}), m as ({MEMBERS_SQL}),
    o as (select slice as src, target, cast(sum(n - target) over (order by slice) as bigint) - (n - target) as lo from t where n > target),
    u as (select slice as dst, n, cast(sum(target - n) over (order by slice) as bigint) as hi, cast(sum(target - n) over (order by slice) as bigint) - (target - n) as lo from t where n < target)
    select m.key, m.val, cast(m.slice as bigint) as slice, m.place from m join t on m.slice = t.slice where m.place < t.target
    union all
    select m.key, m.val, cast(u.dst as bigint), u.n + (o.lo + m.place - o.target - u.lo) from m join o on m.slice = o.src join u on o.lo + m.place - o.target >= u.lo and o.lo + m.place - o.target < u.hi where m.place >= o.target"""
)
def redistribute_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slice's candidates, by their order in the slice, and where the plan sends them."""
    s = joins.membership(sliced(events(spark, sf_dir), "val"), urgent(spark, sf_dir)).where("member").select("key", "val", "slice")
    rows = s.withColumn("place", (F.row_number().over(W.partitionBy("slice").orderBy("val")) - 1).cast("bigint"))
    return distribute.exchanged(rows, candidate_sizes(spark, sf_dir))


@query(f"select cast(sum(n) as bigint) as total, max(n) as largest, case when sum(n) > 0 then max(n) / (sum(n) / count(*)::double) else 1 end as imbalance, sum(n) > 0 and max(n) / (sum(n) / count(*)::double) > 1.4 as rebalance from ({SIZES_SQL})")
def skew_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribute.skew(candidate_sizes(spark, sf_dir), 1.4)


@query(f"with c as (select (select count(*) from ({URGENT})) as build, count(*) as candidates from ({passing_sql(SHAPE)})) select build, candidates, candidates * {CHUNKS} / build::double as expected, candidates * {CHUNKS} / build::double >= 4.5 as replicate from c")
def replicate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = urgent(spark, sf_dir)
    return distribute.replicate_gate(r, bloom.passing(events(spark, sf_dir), bloom.build(r, SHAPE), SHAPE), CHUNKS, 4.5)


def chunk_column() -> tuple[Column, Column]:
    """The slice, and the chunk in it, of a row with its position in val and all rows in rows."""
    each = F.greatest(F.floor(F.col("rows") / SLICES), F.lit(1))
    last = F.col("rows") - each * (SLICES - 1)
    own = F.when(F.col("slice") == SLICES - 1, last).otherwise(each)
    return F.col("slice"), chunk_of(F.col("val") - F.col("slice") * each, own, CHUNKS)


@query(
    f"""with e as (select key, val, {slice_sql("val", EV)} as slice, (select count(*) from ({EV})) as n from ({EV})),
    c as (select key, slice, (val - slice * (n // {SLICES})) // cast(ceil((case when slice = {SLICES - 1} then n - (n // {SLICES}) * {SLICES - 1} else n // {SLICES} end) / {CHUNKS}::double) as bigint) as chunk from e)
    select cast(c.slice as bigint) as slice, cast(c.chunk as bigint) as chunk, count(*) as matches from c join ({CUST}) r on r.key = c.key group by 1, 2"""
)
def chunked_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sliced(events(spark, sf_dir), "val").withColumn("chunk", chunk_column()[1]).select("key", "slice", "chunk")
    return s.join(customers(spark, sf_dir).select("key"), "key").groupBy("slice", "chunk").agg(F.count("*").alias("matches"))


@query("select user_id as key, cast(event_id + 1 as int) as r_val, cast(event_id + 100000001 as int) as s_val from events")
def synthetic_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are made from positions, for a build and for a probe side."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("key"))
    sides = [raw.payload(rows.withColumn("key", F.struct("position", "key")), x) for x in (raw.R_OFFSET, raw.S_OFFSET)]
    return sides[0].withColumnRenamed("val", "r_val").join(sides[1].withColumnRenamed("val", "s_val"), "key").select("key.key", "r_val", "s_val")


PAIR = "(cast(key as bigint) << 32) | (cast(val as bigint) & 4294967295)"


@query(f"select {PAIR} as pair, cast(key as int) as key, cast(val as int) as val from ({R})")
def interleaved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values side by side in one number, and what is read from it again."""
    pairs = joins.as_pairs(orders(spark, sf_dir))
    return joins.from_pairs(pairs, keep=True)


@query("select position, key, r_val, s_val from (select o_orderkey as position, cast(o_custkey as int) as key, cast(o_orderkey + 1 as int) as r_val, cast(o_custkey * 7 - o_orderkey as int) as s_val from orders)")
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, and keys with values, written as folders of raw parts by all tasks, and read again by ranges."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("key"), (F.col("o_custkey") * 7 - F.col("o_orderkey")).alias("val"))
    read = []
    for values in (False, True):
        path = new_path(spark, "raw")
        raw.write_parts(rows, path, values, rows=4000)
        read.append(raw.read(spark, path, read_val=values))
    return read[0].withColumnRenamed("val", "r_val").join(read[1].select("position", F.col("val").alias("s_val")), "position")


@query(f"select key, val, {u32_sql('key')} % {FIRST} as b1, {u32_sql('key')} % {SECOND} as b2 from ({passing_sql(SHAPE)})")
def filter_and_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes the filter, dealt by its buckets."""
    r = urgent(spark, sf_dir)
    return partition.clustered(bloom.passing(events(spark, sf_dir), bloom.build(r, SHAPE), SHAPE), FIRST, SECOND)


@query(f"select {u32_sql('key')} % {FIRST} as b1, count(*) as n, cast(1 as bigint) as tasks, cast(0 as bigint) as falls from ({CUST}) group by 1")
def clustered_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each first-level bucket its rows, the tasks that hold them, and how often a row there comes before one of a smaller second-level bucket."""
    return partition.order(partition.clustered(customers(spark, sf_dir), FIRST, SECOND))


@query(f"select ({u32_sql('key')} % {FIRST}) // {FIRST // SLICES} as dst, count(*) as n, cast(1 as bigint) as tasks, cast(0 as bigint) as falls from ({EV}) group by 1")
def ordered_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each owner its rows after the exchange, the tasks that hold them, and how often a row there comes before one that an earlier slice sent."""
    return distribute.arrivals(distribute.sent(sliced(events(spark, sf_dir), "val"), FIRST, SLICES))


@query(pairs_sql(URGENT))
def chunked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of three chunks, whose pairs are united."""
    options = sizing.Options(mode=2, rate=RATE, slices=SLICES, chunks=CHUNKS)
    return run(urgent(spark, sf_dir), lineitem(spark, sf_dir), options).pairs


@query(f"select cast(s.val % {CHUNKS} as bigint) as part, count(*) as matches from ({CUST}) r join ({EV}) s on r.key = s.key group by 1")
def chunk_stream_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S as a stream of three files, a chunk each, joined as they come; matches of each file."""
    source, out = new_path(spark, "stream"), new_path(spark, "matches")
    events(spark, sf_dir).withColumn("part", F.col("val") % CHUNKS).repartition(CHUNKS, "part").sortWithinPartitions("part").write.partitionBy("part").parquet(source)
    stream = spark.readStream.schema("key bigint, val bigint, part bigint").option("maxFilesPerTrigger", 1).parquet(source)
    r = customers(spark, sf_dir)

    def save(pairs: DataFrame, number: int) -> None:
        pairs.groupBy((F.col("s_val") % CHUNKS).alias("part")).agg(F.count("*").alias("matches")).write.parquet(f"{out}/chunk={number}")

    chunks.run_chunks(r, stream.select("key", "val"), new_path(spark, "progress"), save).awaitTermination()
    return spark.read.schema("part bigint, matches bigint").parquet(f"{out}/*").groupBy("part").agg(F.sum("matches").alias("matches"))


@query(f"select count(*) as matches, least(count(*), 50000) as kept from ({pairs_sql(CUST, EV)})")
def answer_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.capped_count(joins.inner_join(customers(spark, sf_dir), events(spark, sf_dir)), 50_000)


@query("select cast(range as int) as key from range(10000)")
def gen_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.build_relation(spark, 10_000, 10_000, 10.0)


@query("select cast(case when range < 1000 then range else 10000 + range - 1000 end as int) as key from range(10000)")
def gen_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.probe_relation(spark, 10_000, 10_000, 10.0).select("key")


@query("select range < 500 or range between 1000 and 2999 as hot, cast(case when range < 1000 then range else 9000 + range end as int) as key from range(10000)")
def gen_s_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.probe_relation(spark, 10_000, 10_000, 10.0, 20.0)


TIMES = ((0, "Read R", 0.5), (1, "Read R", 0.75), (0, "Probe", 2.0), (1, "Probe", 3.0), (0, "Total", 4.0), (1, "Total", 4.5))
TIMES_SQL = ", ".join(f"({pe}, '{name}', {seconds}::double)" for pe, name, seconds in TIMES)


@query(
    f"""with t(pe, metric, seconds) as (values {TIMES_SQL}), m as (select metric, max(seconds) as a, avg(seconds) as b from t group by metric), w as (select a, b from m where metric = 'Total')
    select metric, m.a as max_seconds, case when metric not like 'Read%' then m.a * 100.0::double / w.a end as max_percent, m.b as mean_seconds, case when metric not like 'Read%' then m.b * 100.0::double / w.b end as mean_percent from m, w"""
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(spark.createDataFrame(TIMES, "pe int, metric string, seconds double"))
