"""Cross-site removal of boilerplate lines with DataFrame functions alone.

A line's key gets a HyperLogLog sketch of the sites it stands on, and the number of its places; both merge in the
map-side aggregation, so a line that stands everywhere costs one entry a task. Lines whose estimate is near the
threshold get an exact distinct count; those clearly above it go without one. Lines are removed from every
document, by position. Boilerplate lines are frequent by nature: those with over a thousandth of all places are
broadcast wherever lines are joined with their keys, so no task gets all places of one.

Cases: null and empty texts have one empty line and stay as they are; blank lines, of white space alone, are never
removed; a null site counts as one site of its own; rows that share doc_id and text are one document; a text of
any number of lines is cut in time linear in it; no rows give no rows; other columns may have any name, and
n_lines and n_removed get underscores after their names where those are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, fresh, keep_matching, staged

MIN_SITES = 5
#: 2**12 registers: a standard error of 1.04 / 64 = 1.6 %; NEAR is over six of them, and one site more for small counts.
LG_K, NEAR = 12, 0.1
#: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, pos, key) of every line that isn't blank; key holds two hashes and the length."""
    split = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce(F.col("source"), F.lit("\0")).alias("site"), split)
    key = F.struct(F.xxhash64("line").alias("a"), F.crc32("line").alias("b"), F.octet_length("line").alias("n"))
    return lines.where(F.btrim("line", F.lit(BLANK)) != "").select("doc_id", "text_hash", "site", "pos", key.alias("key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, int]:
    """(key, n_sites, places) of the lines on min_sites sites or more, and the number of all places; n_sites is an estimate well above the threshold."""
    counted = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n_sites"), F.count("*").alias("places"))
    # A line has at least as many places as sites; all places of rarer ones are less than min_sites a line.
    sketched = staged(counted.where(F.col("n_sites") >= min_sites * (1 - NEAR) - 1), "sketched")
    total = sketched.agg(F.sum("places")).first()[0] or 0
    sure = F.col("n_sites") > min_sites * (1 + NEAR) + 1
    near = sketched.where(~sure)
    at = keep_matching(lines, near, "key", "places", total).select("key", "site").distinct()
    exact = at.groupBy("key").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    found = sketched.where(sure).unionByName(exact.join(near.select("key", "places"), "key"))
    found = staged(found, "boilerplate")
    discard(sketched)
    return found, total


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with n_lines and n_removed added and the boilerplate lines cut out of text."""
    lines = line_rows(docs)
    found, total = boilerplate(lines, min_sites)
    places = keep_matching(lines, found, "key", "places", total)
    gone = places.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    hashed, cut, split = (fresh(docs, n) for n in ("__text", "__gone", "__lines"))
    keyed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias(hashed))
    gone = gone.withColumnRenamed("gone", cut)
    both = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["id"]) & (keyed[hashed] == gone["text_hash"]), "left").select(*[keyed[c] for c in docs.columns], gone[cut])
    both = both.withColumn(split, F.split("text", "\n", -1))

    # What is left between two removed lines is a slice, so each line is copied once.
    n = F.size(split)
    starts, ends = F.concat(F.array(F.lit(-1)), F.col(cut)), F.concat(F.col(cut), F.array(n))
    left = F.flatten(F.zip_with(starts, ends, lambda a, z: F.slice(F.col(split), a + 2, z - a - 1)))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    more = [F.coalesce(n, F.lit(1)).cast("long").alias(fresh(docs, "n_lines")), F.coalesce(F.array_size(cut), F.lit(0)).cast("long").alias(fresh(docs, "n_removed"))]
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *more)
