"""Which documents hold passages of a benchmark: a prefix-filtered join of word shingles, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, is_small, operator, pick, saved, small

#: What stands between two words, in texts whose A-Z are small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words of a window; an item of fewer is one window.
WINDOW = 10


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(shingle, items): each distinct window, and the items that have it."""
    items = pick(benchmark, id_col, text_col).select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    each = items.select("doc_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.least(n, F.lit(size))))).alias("shingle"))
    return each.groupBy("shingle").agg(F.collect_set("doc_id").alias("items"))


def prefixes(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, after, at, size): for each window its rarest word in the corpus that has a next one, that one, and its place in the window; after is null in windows of one word.

    A document that holds a window holds all of its words, so the rarest one is the whole prefix that the join needs;
    the one beside it is the first positional test. The counts are taken over all documents.
    """
    listed = windows.select(F.explode("shingle").alias("word")).distinct()
    listed = saved(listed, "listed")
    every = texts.select(F.explode_outer(words(F.col("text"))).alias("word"))
    count = lambda x: x.groupBy("word").agg(F.count("*").alias("n"))
    # where the list is too large to broadcast, all words are counted before they move, so that hot ones don't
    often = count(every.join(F.broadcast(listed), "word")) if is_small(listed) else count(every).join(listed, "word")
    often = saved(often, "often")
    each = windows.select("window", F.size("shingle").alias("size"), "shingle").select("window", "size", "shingle", F.posexplode("shingle").alias("at", "word"))
    each = each.where((F.col("at") < F.col("size") - 1) | (F.col("size") == 1)).withColumn("next", F.get("shingle", F.col("at") + 1)).drop("shingle")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at", "next")
    first = each.join(small(often), "word", "left").groupBy("window").agg(F.min(rank).alias("first"), F.first("size").alias("size"))
    return first.select("first.word", F.col("first.next").alias("after"), "first.at", "size").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (doc_id, row, n_words), and (doc_id, row, start, end, items) of each occurrence of a window."""
    texts = docs.withColumn("row", F.xxhash64("text"))
    windows = saved(benchmark.withColumn("window", F.monotonically_increasing_id()), "windows")
    wanted = saved(prefixes(windows, texts), "prefixes")
    # the number of words is taken before the words are dealt out, so that no row carries them all; outer, as Spark would else split each text once more to see if it has words
    place = texts.select("doc_id", "row", words(F.col("text")).alias("w")).select("doc_id", "row", F.size("w").alias("n_words"), "w", F.slice("w", F.lit(2), F.size("w")).alias("x"))
    place = place.select("doc_id", "row", "n_words", F.posexplode_outer(F.arrays_zip("w", "x")).alias("pos", "pair"))
    place = place.select("doc_id", "row", "n_words", "pos", F.col("pair.w").alias("word"), F.col("pair.x").alias("next"))
    # positional and length bounds: the window must begin and end within the document
    start = F.col("pos") - F.col("at")
    beside = F.col("after").isNull() | (F.col("after") == F.col("next"))
    found = place.join(small(wanted), "word").where(beside & (start >= 0) & (start + F.col("size") <= F.col("n_words")))
    starts = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct(start.alias("start"), "size")).alias("starts"))
    starts = saved(starts, "starts")
    own = texts.alias("t").join(small(starts).alias("s"), (F.col("t.row") == F.col("s.row")) & F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")))
    own = own.select("t.doc_id", "t.row", "starts", words(F.col("text")).alias("w"))
    shingles = F.transform("starts", lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end"), F.slice("w", x["start"] + 1, x["size"]).alias("shingle")))
    each = own.select("doc_id", "row", F.explode(shingles).alias("x")).select("doc_id", "row", "x.*")
    return texts.select("doc_id", "row", F.size(words(F.col("text"))).alias("n_words")), each.join(small(windows.select("shingle", "items")), "shingle").select("doc_id", "row", "start", "end", "items")


def covered(spans: Column) -> Column:
    """How many words lie in any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))
    step = lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reach"]))).alias("sum"), F.greatest(a["reach"], x["end"]).alias("reach"))
    return F.aggregate(spans, zero, step)["sum"]


@operator()
def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row, with the hit items in `items`.

    Null and empty texts have no words; items without words have no windows; repeated rows each get a row; rows without
    an id are kept; an empty benchmark hits nothing, an empty table gives an empty result. What is broadcast has a
    measured size, else Spark shuffles both sides and splits hot words.
    """
    rows, found = hits(pick(docs, id_col, text_col), item_windows(benchmark, size, item_col, item_text_col), size)
    spans = F.sort_array(F.collect_set(F.struct("start", "end")))
    items = F.sort_array(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string")))
    told = saved(found.groupBy("doc_id", "row").agg(covered(spans).alias("n_hit"), items.alias("items")), "hits")
    told = small(told).alias("h")
    rows = rows.alias("r").join(told, (F.col("r.row") == F.col("h.row")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")), "left")
    ids = F.coalesce("h.items", F.array().cast("array<string>"))
    return rows.select(
        "r.doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


@operator()
def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""
    found = hits(pick(docs, id_col, text_col), item_windows(benchmark, size, item_col, item_text_col), size)[1]
    gone = saved(found.select("doc_id", "row").distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(gone["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["row"])
    return docs.join(small(gone), same, "left_anti")


#: The same by SQL.
SQL = rf"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{GAP[1:]}') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{GAP[1:]}') as w from benchmark),
bs as (select item_id, w, least(len(w), {WINDOW}) as size, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from bw where len(w) > 0),
win as (select distinct item_id, size, w[i:i + size - 1] as shingle from bs),
sizes as (select distinct size from win),
ds as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size),
hit as (select ds.doc_id, ds.i, ds.size, win.item_id from (select doc_id, i, size, w[i:i + size - 1] as shingle from ds) ds join win on ds.size = win.size and ds.shingle = win.shingle),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from hit)) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos on dw.doc_id = pos.doc_id left join it on dw.doc_id = it.doc_id
"""
