"""Every operator on texts of some millions of characters, beside short ones."""

import base64
import hashlib
import random

import pytest

from lodestar.llm import byte_bpe, html_text, lm_score, near_dedup, quality, warc
from lodestar.llm.decontaminate import contamination
from lodestar.llm.exact_dedup import exact_dedup
from lodestar.llm.line_dedup import line_dedup
from lodestar.llm.suffix_dedup import suffix_dedup


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    long = " ".join(rng.choice(words) + ("\n" if i % 50 == 49 else "") for i in range(400_000))
    return {1: long, 2: long + " and an end", 3: long, 4: "a short one", 5: long[1000:2000]}


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i}") for i, t in texts.items()], "doc_id long, text string, source string").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_contamination(spark, frame, texts):
    items = spark.createDataFrame([(7, texts[1][2_000_000:2_000_400])], "item_id long, text string")
    got = by_id(contamination(frame, items))
    assert [got[i]["contaminated"] for i in sorted(got)] == [True, True, True, False, False]
    assert got[1]["n_words"] == 400_000 and got[1]["n_hit"] == got[2]["n_hit"] > 20


def test_copies(frame, texts):
    got = by_id(exact_dedup(frame))
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1)}
    near = by_id(near_dedup.near_dedup(frame))
    assert {i: r["component_id"] for i, r in near.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} and near[1]["n_shingles"] > 390_000


def test_repeats(frame, texts):
    got = by_id(suffix_dedup(frame))
    assert (got[1]["n_removed"], got[3]["n_removed"], got[5]["n_removed"]) == (0, len(texts[3]), 1000)
    assert got[2]["n_removed"] == len(texts[1]) and got[2]["kept_sha256"] == hashlib.sha256(b" and an end").hexdigest()


def test_lines(frame, texts):
    got = by_id(line_dedup(frame, min_sites=3))
    assert got[1]["n_lines"] == 8001 and got[1]["n_removed"] >= 7999 and got[4]["text"] == "a short one"


def test_models(frame, texts):
    got = by_id(lm_score.lm_scores(frame, quality.held_out(10)))
    assert got[1]["n_tokens"] == 400_001 and got[1]["score"] < got[5]["score"] < 0 and abs(got[1]["score"] - got[3]["score"]) < 1e-6 * abs(got[1]["score"])
    labels = frame.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert all(0 <= r["score"] <= 1 for r in quality.quality_scores(frame, labels).collect())


def test_tokens(frame, texts):
    import public_tokenizers

    got = by_id(byte_bpe.encode_texts(frame, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() and r["n_chars"] == len(texts[i]) for i, r in got.items())


def test_pages(spark, texts):
    lines = [" ".join(x.split()).capitalize() + "." for x in texts[1].split("\n")[:6000]]
    html = "<nav><ul><li><a href=a>Home</a></li></ul></nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><footer>&copy; x</footer>"
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "<p>Short.</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert got[1]["text"] == got[2]["text"] == "\n".join(lines) and got[1]["n_chars"] == len(got[1]["text"])
    records = {r["page_id"]: r for r in warc.captures(pages).collect()}
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert (records[1]["record_type"], records[1]["refers_to"], records[2]["record_type"]) == ("revisit", 2, "response")
    assert records[1]["payload_digest"] == digest and records[1]["payload_bytes"] == len(html)
