"""Benchmark decontamination with DataFrame functions alone.

The items' words become windows of WINDOW words, an item of fewer words one window of its own length. Their distinct
hashes are counted and broadcast, in slices of SLICE where there are more; the windows at all positions of every
document are hashed and probed in the scan's own stage of generated code, so no text is moved. The few positions that
hit keep their words as a string, and are verified against the whole windows, which are broadcast in slices, too. A
window that several items share is one row with all their ids, so copies of items are not multiplied by copies of
documents.

Hits fold into maximal runs by a running maximum over a document's hits, in time linear in them but for a sort.

Cases: null and empty texts have no words and are clean; an item without words has no window; a null item_id is
never reported but its hits count; rows that share doc_id and text are one document and are reported once; texts of
any length are read in full; no documents give no rows, no items leave all clean; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, UPPER, fresh, staged

WINDOW = 10
#: Hashes that are broadcast at a time (8 bytes each, some 30 in a hash table), and whole windows (with item ids, some 200).
SLICE, VERIFY_SLICE = 1_000_000, 100_000
#: Documents whose verdicts are broadcast; more meet theirs by a shuffle.
FEW_BAD = 500_000
# The ASCII characters that are no part of a word.
GAPS = "".join(chr(c) for c in [*range(48), *range(58, 65), *range(91, 97), *range(123, 128)])


def word_list(text: Column) -> Column:
    """The words of a text, A-Z in lower case: runs of digits, letters and everything outside ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.array_remove(F.split(plain, " "), "")


def window_at(words: Column, start: Column, size: Column | int) -> Column:
    """The window of `size` words from `start` (from 0) on."""
    return F.slice(words, start + 1, size)


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, window, h, items): the distinct windows of all items, each with the sorted ids of its items as strings."""
    words = items.select("item_id", word_list(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    size = F.least(F.col("n"), F.lit(window))
    starts = words.select("item_id", "w", size.alias("len"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("start"))
    cut = window_at(F.col("w"), F.col("start"), F.col("len"))
    each = starts.select(F.col("item_id").cast("string").alias("item_id"), "len", F.xxhash64(cut).alias("h"), F.array_join(cut, " ").alias("window"))
    return each.groupBy("len", "h", "window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, slice_rows: int = SLICE, verify_rows: int = VERIFY_SLICE) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): doc_id, text_hash, n_words of every document; doc_id, text_hash, pos (from 0), len, items of verified hits."""
    windows = staged(benchmark_windows(items, window), "windows")
    sizes = sorted(r["len"] for r in windows.select("len").distinct().collect())
    told = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), word_list(F.col("text")).alias("w"))
    told = told.withColumn("n_words", F.size("w").cast("long"))
    if not sizes:
        return told.drop("w").distinct(), told.select("doc_id", "text_hash", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.array(F.lit("")).alias("items")).where("false")

    # A row for each word, and one for a document without words; its windows begin there, one for each size.
    spots = told.select("doc_id", "text_hash", "n_words", "w", F.posexplode_outer("w").alias("pos", "word")).drop("word")
    own = [F.when(F.col("pos") + s <= F.col("n_words"), F.xxhash64(window_at(F.col("w"), F.col("pos"), s))) for s in sizes]
    if len(sizes) == 1:
        spots = spots.withColumn("len", F.lit(sizes[0])).withColumn("h", own[0])
    else:
        each = F.array(*[F.struct(F.lit(s).alias("len"), h.alias("h")) for s, h in zip(sizes, own, strict=True)])
        spots = spots.withColumn("e", F.explode(each)).select("doc_id", "text_hash", "n_words", "w", "pos", "e.len", "e.h")
    first = F.col("len") == sizes[0]
    known = windows.select("h").distinct()
    n_slices = max(1, -(-known.count() // slice_rows))
    found = None
    for k in range(n_slices):
        part = F.broadcast(known.where(F.pmod(F.hash("h"), F.lit(n_slices)) == k).withColumn("known", F.lit(True)))
        # In the first slice's pass a document's first row stays, hit or not: it names the document.
        own_hits = spots.join(part, "h", "left").where(F.col("known") if k else F.col("known") | (F.col("pos").isNull() | (F.col("pos") == 0)) & first)
        own_hits = own_hits.withColumn("names", F.lit(not k) & (F.col("pos").isNull() | (F.col("pos") == 0)) & first)
        found = own_hits if found is None else found.unionByName(own_hits)
    text = F.when(F.col("known"), F.array_join(window_at(F.col("w"), F.col("pos"), F.col("len")), " "))
    found = staged(found.select("doc_id", "text_hash", "n_words", "names", "pos", "len", text.alias("window")), "spots")

    n_verify = max(1, -(-windows.count() // verify_rows))
    hits = None
    for k in range(n_verify):
        part = F.broadcast(windows.where(F.pmod(F.hash("window"), F.lit(n_verify)) == k).select("window", "len", "items"))
        own = found.where("window is not null").join(part, ["window", "len"]).select("doc_id", "text_hash", "pos", "len", "items")
        hits = own if hits is None else hits.unionByName(own)
    return found.where("names").select("doc_id", "text_hash", "n_words").distinct(), hits


def hit_runs(hits: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end) of the maximal runs of hit words, from 0, end outside."""
    doc = ["doc_id", "text_hash"]
    ordered = Window.partitionBy(*doc).orderBy("start", "end")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # A hit that begins inside the hits before it, or right after them, belongs to their run.
    spans = hits.select(*doc, F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")).distinct()
    begun = spans.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    numbered = begun.withColumn("run", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*doc, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slice_rows: int = SLICE, verify_rows: int = VERIFY_SLICE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row for each document.

    spans are the maximal runs of hit words as (start, end), counted from 0, end outside.
    """
    documents, hits = find_hits(docs, items, window, slice_rows, verify_rows)
    doc = ["doc_id", "text_hash"]
    runs = hit_runs(hits).groupBy(*doc).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # Windows of the same items are one set of them.
    held = hits.groupBy(*doc).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    told = runs.join(held, runs["doc_id"].eqNullSafe(held["doc_id"]) & (runs["text_hash"] == held["text_hash"])).select(runs["doc_id"].alias("id"), runs["text_hash"].alias("hash"), "n_hit", "spans", "items")
    both = documents.join(told, documents["doc_id"].eqNullSafe(told["id"]) & (documents["text_hash"] == told["hash"]), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, slice_rows: int = SLICE, verify_rows: int = VERIFY_SLICE, few_bad: int = FEW_BAD) -> DataFrame:
    """`docs` without those that hold a window of the benchmark; all columns as they came.

    Up to few_bad contaminated documents are named in a broadcast, so that no text is moved; more meet by a shuffle.
    """
    _, hits = find_hits(docs, items, window, slice_rows, verify_rows)
    bad = staged(hits.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct(), "bad")
    hashed = fresh(docs, "__text")
    keyed = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = F.broadcast(bad) if bad.count() <= few_bad else bad.hint("merge")
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["id"]) & (keyed[hashed] == bad["hash"]), "left_anti").drop(hashed)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the words left of each document, joined by a space, for pipelines that cut spans and keep the rest."""
    _, hits = find_hits(docs, items, window)
    runs = hit_runs(hits).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    keyed = docs.select("doc_id", word_list(F.col("text")).alias("w"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    both = keyed.join(runs, keyed["doc_id"].eqNullSafe(runs["id"]) & (keyed["own"] == runs["hash"]), "left").select("doc_id", "w", "spans")
    # What is left between two runs is a slice.
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.size("w")))
    left = F.flatten(F.zip_with(starts, ends, lambda a, z: F.slice("w", a + 1, z - a)))
    return both.select("doc_id", F.array_join(F.when(F.col("spans").isNull(), F.col("w")).otherwise(left), " ").alias("text"))
