"""Decontamination, exact dedup, line dedup and near dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import common
from lodestar.llm import exact_dedup as exact
from lodestar.llm import near_dedup as near
from lodestar.llm.common import components
from lodestar.llm.decontaminate import contamination, drop_contaminated, remove_spans
from lodestar.llm.exact_dedup import drop_exact_copies, exact_dedup
from lodestar.llm.line_dedup import line_dedup

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(corpus, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for doc, text, *_ in corpus:
        w = words(text)
        hit, found = set(), set()
        for size in {len(window) for window in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out[doc] = (len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def items(corpus):
    long = [t for _, t, *_ in corpus if t and len(t.split()) > 30]
    return [(1, " ".join(long[0].split()[3:20])), (2, " ".join(long[5].split()[:12])), (10, "two WORDS"), (3, None), (4, "..."), (None, long[9]), (5, "nothing of this is anywhere in there, not a single bit of it at all")]


@pytest.mark.parametrize(("slices", "few"), [(100_000, 100_000), (7, 0)])
def test_contamination(spark, docs, clashing, corpus, items, slices, few):
    docs = docs if few else clashing
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in contamination(docs, table, slice_rows=slices, verify_rows=slices).collect()}
    assert got == hits(corpus, items)
    bad = {d for d, v in got.items() if v[4]}
    assert {r["doc_id"] for r in drop_contaminated(docs, table, slice_rows=slices, few_bad=few).collect()} == set(got) - bad
    cut = {r["doc_id"]: r["text"] for r in remove_spans(docs, table).collect()}
    assert all(len(cut[d].split()) == v[0] - v[1] for d, v in got.items())


def test_contamination_edges(spark, docs, none, clashing, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(none, table).count() == 0 and not any(r["contaminated"] for r in contamination(docs, table.limit(0)).collect())
    assert drop_contaminated(docs, table.limit(0)).count() == docs.count()
    assert contamination(clashing, table.withColumn("doc_id", table["item_id"])).count() == contamination(docs, table).count()
    assert drop_contaminated(clashing, table).columns == clashing.columns


def test_contamination_of_long_texts(spark):
    """Over 300,000 windows in one plan that moves no text, and a text of 200,000 words that all are hit."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(30_000)]
    long = [rng.choice(vocabulary) for _ in range(200_000)]
    items = [(1, " ".join(long)), (2, " ".join(rng.choice(vocabulary) for _ in range(110_000))), (3, " ".join(long[500:520]))]
    rows = [(1, " ".join(long).upper()), (2, " ".join(vocabulary)), (3, "x " + "! ".join(long[510:530]) + " y")]
    table = spark.createDataFrame(items, "item_id long, text string")
    result = contamination(spark.createDataFrame(rows, "doc_id long, text string"), table)
    got = {r["doc_id"]: r for r in result.collect()}
    digest = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items_sha256"], len(got[1]["spans"])) == (200_000, 200_000, digest("1,3"), 1)
    assert not got[2]["contaminated"] and (got[3]["n_words"], got[3]["n_hit"], got[3]["items_sha256"]) == (22, 20, digest("1,3"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = drop_contaminated(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, clashing, corpus, keep):
    docs = docs if keep == "largest" else clashing
    groups = defaultdict(list)
    for d, t, *_ in corpus:
        groups[t or ""].append(d)
    want = []
    for d, t, *_ in corpus:
        ids = [i for i in groups[t or ""] if i is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        want.append((d, best, len(groups[t or ""]), d == best, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(docs, keep).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = drop_exact_copies(docs, keep)
    # One row a text, though some rows are repeated as a whole.
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted({d: d for d, _, _, k, _ in want if k}, key=str) and left.columns == docs.columns


def test_exact_rounds(spark, docs, monkeypatch):
    """Runs of a few entries: many nodes, and a round for each doubling."""
    seen, real = [], exact._round
    monkeypatch.setattr(exact, "_round", lambda bit, keep: seen.append(bit) or real(bit, keep))
    monkeypatch.setattr(exact, "LEAF_ROWS", 5)
    want = sorted(map(tuple, exact_dedup(docs).collect()), key=str)
    assert seen == [1, 2]  # and the last one tells
    assert sorted(map(tuple, exact_dedup(docs, run_rows=5).collect()), key=str) == want
    assert max(seen) >= 4


def test_exact_merge_verifies():
    e = np.zeros(5, exact._ENTRY)
    e["digest"] = [b"b" * 32, b"a" * 32, b"b" * 32, b"b" * 32, b"a" * 32]
    e["n_bytes"], e["check"] = [1, 1, 2, 1, 1], [7, 7, 7, 7, 8]
    e["best"], e["ties"], e["count"] = [4, 5, 6, 4, 5], 1, 1
    out = exact.merge(e, "largest")
    assert [(x["digest"][:1], x["check"], x["n_bytes"], x["best"], x["ties"], x["count"]) for x in out] == [(b"a", 7, 1, 5, 1, 1), (b"a", 8, 1, 5, 1, 1), (b"b", 7, 1, 4, 2, 2), (b"b", 7, 2, 6, 1, 1)]


def test_exact_repeated_rows(spark):
    rows = [(None, "n", 1), (None, "n", 2), (5, "a", 1), (5, "a", 1), (5, "a", 2), (4, "a", 3), (5, "b", 1), (6, "x" * 2_000_000, 1), (7, "x" * 2_000_000, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = [(r["doc_id"], r["text"][:1]) for r in drop_exact_copies(table).collect()]
    assert sorted(got, key=str) == sorted([(None, "n"), (5, "a"), (5, "b"), (7, "x")], key=str)


def test_exact_edges(spark, none, clashing):
    assert exact_dedup(none).count() == 0 and drop_exact_copies(none).count() == 0
    assert drop_exact_copies(clashing).columns == clashing.columns
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text").repartition(40)
    rows = exact_dedup(hot).where("group_size > 1").agg({"keep_id": "max", "group_size": "max", "doc_id": "count"}).first()
    assert sorted(rows) == [1000, 1000, 2997]


def test_line_dedup(docs, corpus, none, clashing):
    sites = defaultdict(set)
    for _, t, _, s, _ in corpus:
        for line in (t or "").split("\n") if t is not None else ():
            sites[line].add(s)
    gone = {x for x, s in sites.items() if len(s) >= 5 and x.strip()}
    assert gone
    want = {d: "\n".join(x for x in t.split("\n") if x not in gone) if t is not None else None for d, t, *_ in corpus}
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(docs).collect()}
    assert {d: t for d, (t, _) in got.items()} == want
    assert line_dedup(none).count() == 0
    taken = clashing.withColumn("n_lines", clashing["doc_id"])
    rows = line_dedup(taken).collect()
    assert len(rows) == docs.count() and set(taken.columns) | {"n_lines_", "n_removed"} == set(rows[0].asDict())
    assert all(r["__text"] == "__text" and r["n_lines"] == r["doc_id"] and r["text"] == want[r["doc_id"]] for r in rows)


def test_line_dedup_hot_and_blank(spark):
    """Broadcasts off, one line on all rows; blank lines of all kinds stay; a text of 200,000 lines."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, f"all\n\t\nown {i}\n \x0b\nall", f"s{i % 7}" if i % 3 else "hot") for i in range(3000)] + [(9999, "all\nx\n" * 100_000 + "end", None)]
        got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert all(got[i]["text"] == f"\t\nown {i}\n \x0b" and (got[i]["n_lines"], got[i]["n_removed"]) == (5, 2) for i in range(3000))
    assert got[9999]["text"] == "x\n" * 100_000 + "end" and got[9999]["n_removed"] == 100_000


def brute_near(corpus, size, percent):
    sets = {}
    for d, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    # All pairs that have anything in common.
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s if d is not None else ():
            holders[x].append(d)
    common = Counter((a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), d if d is None else find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 4000), (5, 80, 4000), (3, 85, 3), (5, 80, 2)])
def test_near_dedup(docs, clashing, corpus, size, percent, block):
    docs = clashing if block == 3 else docs
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_components(docs, size, percent, block_nodes=block).collect()}
    assert got == brute_near(corpus, size, percent)
    assert len(set(got.values())) < len(got) - 3


def test_near_blocks_with_a_weak_hub(spark):
    """A chain of documents, each near the next alone, in blocks of a few: the hub is near almost none of them."""
    chain = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(chain[4 * i : 4 * i + 200])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows, 3, 85)
    for block in (4, 4000):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_components(table, 3, 85, block_nodes=block).collect()} == want


def test_near_edges(none, clashing, docs):
    assert near.near_dedup(none).count() == 0 and near.drop_near_copies(none).count() == 0
    assert near.drop_near_copies(clashing).columns == clashing.columns
    assert near.near_dedup(docs).where("doc_id is null").first()["kept"]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 5000):
        s = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert (near.sketch([s]) != np.iinfo(np.uint64).max).all()
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    x, y = near.sketch([a]), near.sketch([b])
    assert abs((x == y).mean() - 900 / 1100) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (200, 200)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(100, 100), (101, 100), (103, 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_with_a_hub(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    star = spark.range(1, 5000).selectExpr("id as a", "if(id % 2 = 0, 0L, 9000L) as b").union(spark.createDataFrame([(4999, 2)], "a long, b long"))
    got = components(star)
    assert got.count() == 5001 and got.where("root <> 0").count() == 0
