"""Joins two raw files from the command line, or generates them: python -m millrace join|generate --help."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import slice_of
from .operators import bloom, metrics
from .operators.join import Strategy, counted_matches, match_count
from .plans.run import run
from .plans.sizing import Options
from .sources import generator, raw


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millrace")
    does = out.add_subparsers(dest="does", required=True)
    join = does.add_parser("join", help="join two raw files of 32-bit keys")
    join.add_argument("r")
    join.add_argument("s")
    join.add_argument("--out", help="write the pairs there as Parquet")
    join.add_argument("--r-rows", type=int, help="an error if the file has another number")
    join.add_argument("--s-rows", type=int)
    join.add_argument("--read-val", action="store_true", help="a block of values follows the keys")
    join.add_argument("--check", action="store_true", help="count by multiplicities too, and compare")
    join.add_argument("--mode", type=int, default=0, help="how the filter is made; 0: none")
    join.add_argument("--rate", type=float, default=0.1, help="false positives of the filter")
    join.add_argument("--num-bits", type=int)
    join.add_argument("--num-hashes", type=int)
    join.add_argument("--slices", type=int, default=4)
    join.add_argument("--chunks", type=int, default=1)
    join.add_argument("--skew", type=float, default=0.0, help="rebalance above this imbalance; 0: never")
    join.add_argument("--first", type=int, help="buckets of the first level")
    join.add_argument("--second", type=int, help="buckets of the second level")
    join.add_argument("--shuffle-r", action="store_true")
    join.add_argument("--replicate-ratio", type=float, default=-1.0, help="send R everywhere from this ratio of candidates on; 0: always; below 0: never")
    join.add_argument("--answer-rows", type=int)
    make = does.add_parser("generate", help="write two raw files of which an exact share matches")
    make.add_argument("r_rows", type=int)
    make.add_argument("s_rows", type=int)
    make.add_argument("percent", type=float)
    make.add_argument("folder")
    make.add_argument("seed", type=int, nargs="?", default=42)
    make.add_argument("--max", type=float, dest="most", help="percentage of matches in the first quarter of S")
    make.add_argument("--parts", action="store_true", help="write folders of raw files, all tasks at once")
    make.add_argument("--verify", action="store_true")
    return out


def join(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, DataFrame]]:
    options = Options(args.mode, args.rate, args.num_bits, args.num_hashes, args.slices, args.chunks, args.skew, args.first, args.second, args.shuffle_r, args.replicate_ratio, args.answer_rows)
    r = raw.read(spark, args.r, args.r_rows, args.read_val, raw.R_OFFSET)
    s = raw.read(spark, args.s, args.s_rows, args.read_val, raw.S_OFFSET)
    began = time.perf_counter()
    done = run(r.select("key", "val"), s.select("position", "key", "val"), options)
    planned = time.perf_counter()
    total = done.matches.first()["matches"]
    counted = time.perf_counter()
    own = done.candidates.withColumn("slice", slice_of(F.col("position"), s.agg(F.count("*")).scalar(), options.slices))
    out = [("matches of each slice of S, and of all", own.join(r.select("key"), "key").rollup("slice").agg(F.count("*").alias("matches")).orderBy(F.asc_nulls_last("slice")))]
    if done.shape:
        out.append(("rows of S that pass the filter", bloom.candidate_rate(s, bloom.build(r, done.shape), done.shape)))
    rows = [(0, "Plan and filter", planned - began), (0, "Join and count", counted - planned), (0, "Total", counted - began)]
    out.append((f"seconds; strategy {done.strategy.value}, buckets {done.first} x {done.second}", metrics.summary(spark.createDataFrame(rows, "pe int, metric string, seconds double"))))
    if args.check:
        again = counted_matches(r, s).first()["matches"]
        if again != total:
            raise SystemExit(f"{total} pairs, but {again} by multiplicities")
    if args.out:
        done.pairs.write.parquet(args.out)
    return out


def generate(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, DataFrame]]:
    sizes = (args.r_rows, args.s_rows, args.percent)
    r, s = generator.build_relation(spark, *sizes), generator.probe_relation(spark, *sizes, args.most, args.seed)
    mixed = r.orderBy(F.xxhash64("key", F.lit(args.seed)))
    for name, rows, rel in (("R", args.r_rows, mixed), ("S", args.s_rows, s)):
        save = raw.write_parts if args.parts else raw.write
        save(raw.positioned(rel.select("key")), f"{args.folder}/{generator.file_name(name, rows, args.percent, args.most)}")
    found = match_count(r.withColumn("val", F.lit(0)), s.withColumn("val", F.lit(0)), Strategy.AUTO)
    if args.verify and found.first()["matches"] != generator.matches(*sizes):
        raise SystemExit("the relations match otherwise than told")
    return [("matches", found)] if args.verify else []


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    for title, frame in {"join": join, "generate": generate}[args.does](spark, args):
        print(f"# {title}")
        frame.show(100, truncate=False)


if __name__ == "__main__":
    main()
