"""Suffix arrays, the quality classifier, language-model scores, tokens, archives, pages and the pipeline."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import byte_bpe, html_text, lm_score, quality, suffix_dedup, warc

SF = "/root/testdata/sf0.001"


# Suffix arrays


def brute_suffix(rows):
    first, out = set(), {}
    for d, t in sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in first:
                gone[p : p + 100] = b"\1" * 100
            first.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[d] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("bucket", "hot"), [(1 << 23, 50_000), (4000, 50_000), (4000, 2)])
def test_suffix_dedup(docs, clashing, corpus, bucket, hot):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(clashing if hot == 2 else docs, bucket_bytes=bucket, hot=hot).collect()}
    assert got == brute_suffix([(d, t) for d, t, *_ in corpus])


def test_suffix_periodic_and_edges(spark, none):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randint(90, 300))) for _ in range(12)]
    rows = [(i, rng.choice([None, "", "x" * rng.randint(50, 400), "ab" * rng.randint(40, 200), "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))])) for i in range(200)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=20_000).collect()}
    assert got == brute_suffix(rows)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_long_text(spark):
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    text = "".join(rng.choice("abcdefgh ") for _ in range(700_000)) + block + "".join(rng.choice("abcd") for _ in range(600_000)) + block
    got = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, text), (2, "z" + block)], "doc_id long, text string"), texts=True)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["n_removed"] == 3000 and rows[1]["n_spans"] == 1 and bytes(rows[2]["kept"]) == b"z"


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_two_stage_order(data):
    n = len(data)
    order = suffix_dedup.two_stage_order(np.frombuffer(data + bytes(n + 2), np.uint8), np.ones(n, bool), n + 1)
    text = data + bytes(n + 2)
    assert sorted(order.tolist()) == list(range(n))
    assert [text[i : i + n + 1] for i in order] == sorted(text[i : i + n + 1] for i in range(n))


def test_marks_come_from_the_order(monkeypatch):
    """Equal pieces, and copies that go on for long: every mark is a neighbour's in the sorted order, and none without it."""
    rng = random.Random(9)
    base = bytes(rng.choice(b"abcdef ") for _ in range(400))
    pieces = suffix_dedup.Pieces()
    for doc, piece in enumerate([base, base[50:300], base, b"x" * 250, base[:120] + b"x" * 130]):
        pieces.add(0, doc, 7, 10, len(piece) - 99, piece)
    marks, left = pieces.solve()
    first, want = set(), set()
    for _, doc, _, start, n, piece in pieces.rows:
        for i in range(n):
            (want if piece[i : i + 100] in first else first).add((doc, start + i) if piece[i : i + 100] in first else piece[i : i + 100])
    assert {(doc, start + i) for _, doc, _, start, n in marks for i in range(n)} == want and want
    assert sum(r[4] for r in left.rows) == sum(r[4] for r in pieces.rows) - len(want)
    assert left.solve()[0] == []
    monkeypatch.setattr(suffix_dedup, "later_copies", lambda data, wanted, place: np.zeros(len(wanted), bool))
    assert pieces.solve()[0] == []


def test_common_prefixes():
    data = b"abcabcabcabd" * 30
    order = np.array(sorted(range(len(data) - 100), key=lambda i: data[i : i + 104]))
    want = [next((k for k in range(100) if data[a + k] != data[b + k]), 100) for a, b in zip(order, order[1:], strict=False)]
    assert suffix_dedup.common_prefixes(suffix_dedup._padded(data), order).tolist() == want


def test_suffix_folds_copies(docs, corpus, monkeypatch):
    """Blocks of a few bytes: groups are folded while they come, string by string."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs, bucket_bytes=3000, hot=5).collect()}
    assert got == brute_suffix([(d, t) for d, t, *_ in corpus])


def test_anchor_counts_are_whole():
    for n in ([1, 254, 255, 256, 60_000, 3], [1, 2], [255], []):
        data = suffix_dedup.write_counts(np.array(n, np.int64))
        assert suffix_dedup.read_counts(data, len(n)).tolist() == n


# Quality


def test_quality(spark, none, clashing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scores = quality.quality_scores(docs, labels)
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.98 * len(rows)
    no_labels = labels.limit(0)
    assert {r["score"] for r in quality.quality_scores(docs.limit(50), no_labels).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
    plain = clashing.select("doc_id", "text")
    told = lambda d: sorted(map(tuple, quality.quality_scores(d, labels).collect()), key=str)
    assert told(clashing) == told(plain) and len(told(plain)) == clashing.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scores.where("predicted = 1").count()


def test_quality_by_brute_force(spark):
    """The same features, one normal equation and pooling over collected rows, by plain numpy."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in rows}
    every = {d: quality.statistics(t).astype("f4").astype("f8") for d, t in rows.items()}
    x, y = np.array([every[d] for d in known]), np.array(list(known.values()), "f8")
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    rng = np.random.default_rng(quality.SEED)
    waves, shift = rng.standard_normal((quality.N_STATS, quality.N_FOURIER)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.N_FOURIER)

    def features(v):
        z = np.minimum(np.maximum((v - mean) / scale, -6), 6)
        return np.append(np.cos(z @ waves + shift) * math.sqrt(2 / quality.N_FOURIER), 1.0)

    z = np.array([features(v) for v in x])
    ridge = quality.RIDGE * np.diag([1.0] * quality.N_FOURIER + [0.0])
    w = np.linalg.solve(z.T @ z / len(z) + ridge, z.T @ y / len(z))
    binned = defaultdict(list)
    for raw, label in zip(z @ w, y, strict=True):
        binned[math.floor((min(2.0, max(-1.0, raw)) + 1) / 3 * quality.N_BINS)].append((raw, label))
    points = [[sum(r for r, _ in v), sum(q for _, q in v), len(v)] for _, v in sorted(binned.items())]
    pooled: list = []
    for p in points:
        pooled.append(p)
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] >= pooled[-1][1] / pooled[-1][2]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last, strict=True)]
    at, share = [p[0] / p[2] for p in pooled], [p[1] / p[2] for p in pooled]
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert set(got) == set(rows)
    want = {d: float(np.interp(features(v) @ w, at, share)) for d, v in every.items()}
    assert all(abs(got[d]["score"] - want[d]) < 1e-4 for d in rows)
    assert all(got[d]["predicted"] == (want[d] >= 0.3) for d in rows if abs(want[d] - 0.3) > 1e-3)
    left = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert left == {d for d in rows if got[d]["predicted"]}


def test_quality_bound(spark):
    labels = spark.range(300).selectExpr("id as doc_id", "id % 2 as label").union(spark.createDataFrame([(None, 1), (4, None), (5, 0)], "doc_id long, label long"))
    assert quality.learnt_from(labels).count() == 300 and quality.learnt_from(labels).where("doc_id = 5").first()["label"] == 0
    assert quality.learnt_from(labels, 10).count() == 10


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]), np.ones(6))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and y[0] == 0 and y[-1] == 1


# Language model


def tok(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


class Trie:
    """PPM as its definition says: a dictionary of contexts, and a walk down from the longest one."""

    def __init__(self, texts):
        self.contexts = defaultdict(Counter)
        for t in texts:
            s = lm_score.stream(tok(t))
            for i in range(1, len(s)):
                for m in range(min(i, lm_score.ORDER) + 1):
                    self.contexts[s[i - m : i]][s[i]] += 1

    def byte(self, before, symbol):
        out, p = set(), 0.0
        for m in range(min(len(before), lm_score.ORDER), -1, -1):
            c = {k: x for k, x in self.contexts.get(before[len(before) - m :], {}).items() if k not in out}
            if c:
                total = 2 * sum(c.values())
                if symbol in c:
                    return p + math.log10((2 * c[symbol] - 1) / total)
                p += math.log10(len(c) / total)
                out |= set(c)
        return p - math.log10(256 - len(out))

    def text(self, t):
        s = lm_score.stream(tok(t))
        return sum(self.byte(s[max(0, i - lm_score.ORDER) : i], s[i]) for i in range(1, len(s)))


@pytest.mark.parametrize(("bucket", "owner"), [(3000, 1000), (1 << 30, 1 << 30)])
def test_lm_scores(docs, clashing, corpus, bucket, owner):
    got = lm_score.lm_scores(clashing if bucket > 3000 else docs, quality.held_out(10), bucket_bytes=bucket, owner_bytes=owner).collect()
    train = Counter(w for d, t, *_ in corpus if not held(d) for w in tok(t))
    n, v = sum(train.values()), len(train)
    trie = Trie(t for d, t, *_ in corpus if not held(d))
    texts = {d: t for d, t, *_ in corpus}
    assert len(got) == len(corpus) and any(r["held_out"] for r in got)
    for r in got:
        words = tok(texts[r["doc_id"]])
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(train[w] > 0 for w in words), n)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - trie.text(texts[r["doc_id"]])) < 1e-6


def test_lm_without_rows(none):
    assert lm_score.lm_scores(none, quality.held_out(10)).count() == 0


def test_lm_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 1000)
    rng = random.Random(6)
    out = [d for d in range(200) if held(d)][:3]
    train = [(d, " ".join(rng.choice(["ab", "cab", "bca", "abba"]) for _ in range(30))) for d in range(200) if not held(d)][:20]
    blob = "".join(rng.choice("abc/+Z9") for _ in range(20_000))
    texts = dict(zip(out, [f"ab {blob} cab", f"{blob} {blob}", blob[:400]], strict=True))
    trie = Trie(t for _, t in train)
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(spark.createDataFrame([*train, *texts.items()], "doc_id long, text string"), quality.held_out(10)).collect()}
    for d, t in texts.items():
        want = trie.text(t)
        assert want < -300 and abs(got[d] - want) < 1e-9 * abs(want)
    # Without training text every byte costs log10(256), the spaces and the end's too.
    untaught = lm_score.lm_scores(spark.createDataFrame([(out[0], blob)], "doc_id long, text string"), quality.held_out(10)).first()
    want = -math.log10(256) * (len(blob) + 2)
    assert untaught["train_tokens"] == 0 and abs(untaught["score"] - want) < 1e-9 * abs(want)


def test_ppm_sums_to_one():
    """Over all bytes that may follow, in every context of every length that the training texts have, across words."""
    rng = np.random.default_rng(2)
    streams = [lm_score.stream(tok(bytes(rng.choice([97, 98, 32, 195, 169], rng.integers(1, 60)).astype(np.uint8)).decode("utf-8", "ignore"))) for _ in range(40)]
    keys, counts = np.unique(np.concatenate([k for k, *_ in lm_score.grams(streams)]), return_counts=True)
    pairs = np.zeros((256, 256))
    np.add.at(pairs, (keys >> 8 & 255, keys & 255), counts)
    contexts = np.unique(keys >> 8)
    assert len(set((contexts >> lm_score.LENGTH_AT - 8).tolist())) == lm_score.ORDER and any(32 in c.tobytes()[1:4] for c in contexts)
    for context in contexts:
        every = context << 8 | np.arange(256)
        own, length = keys >> 8 & 0xFFFF, context >> lm_score.LENGTH_AT - 8
        same = (own == (context & 0xFFFF)) & (keys >> lm_score.LENGTH_AT > 1) if length > 1 else np.zeros(len(keys), bool)
        n = np.concatenate([counts[same].astype(float), np.zeros(256)])
        p = lm_score.ppm(np.concatenate([keys[same], every]), n, pairs, pairs.sum(0))[-256:]
        assert abs((10.0**p).sum() - 1) < 1e-9


# Tokens


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab 'stre\n\té日🙂", max_size=120)))
def test_bpe_equals_tiktoken(both, text):
    own, public = both
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(text) and own.text(ids) == text


def test_bpe_forgets_and_goes_on(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 50)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 20)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 30)
    own, public = both
    text = " ".join(chr(97 + i % 26) * (i % 9 + 1) + str(i) for i in range(600)) + "a" * 3000 + " " * 500
    assert np.frombuffer(own.encode(text), "<u4").tolist() == public.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 7))
def test_utf8_stream(data, step):
    stream = byte_bpe.Utf8Stream()
    assert "".join([*(stream.feed(data[i : i + step]) for i in range(0, len(data), step)), stream.close()]) == data.decode("utf-8", "replace")


def test_encode_texts(docs, corpus, none, clashing, both):
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = {d: t or "" for d, t, *_ in corpus}
    for r in byte_bpe.encode_texts(clashing, *args, ids=True).collect():
        ids = both[1].encode_ordinary(texts[r["doc_id"]])
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["n_chars"] == len(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode_texts(none, *args).count() == 0 and byte_bpe.encode_texts(docs, *args).count() == len(corpus)


# Archives


def test_warc(spark, tmp_path):
    rows = [(1, "u1", "<p>a"), (2, "u2", "<p>a"), (3, "u3", None), (4, None, ""), (5, "u5", "é" * 10), (5, "u5", "é" * 10), (None, "x", "<p>a"), (6, "u\r\n6", "WARC/1.1\r\n\r\n" * 3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as n", "'y' as sha", "'z' as type")
    got = {r["page_id"]: r for r in warc.captures(table, payloads=True).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    for page, _, html in rows:
        data = (html or "").encode()
        r = got[page]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == data
    assert warc.captures(table.limit(0)).count() == 0
    moved = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.captures(table, few=0).collect()}
    assert moved == {k: (r["record_type"], r["refers_to"]) for k, r in got.items()}
    warc.write_archives(table, str(tmp_path / "w"))
    import gzip

    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # splits inside records
    split = warc.read_records(spark, str(tmp_path / "w"))
    assert split.rdd.getNumPartitions() > 8
    own = sorted(map(tuple, split.collect()), key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert own == sorted(map(tuple, warc.read_records(spark, str(tmp_path / "w"), own=False).collect()), key=str) and len(own) == 24

    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC-Type: request") == 8 and data.startswith(b"WARC/1.1\r\n")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=6), st.integers(1, 64))
def test_warc_records_round_trip(blocks, step):
    data = b"".join(warc._member([("WARC-Type", "resource")], b) + warc._EMPTY for b in blocks)
    assert [b for _, b in warc.parse_records(warc.inflate(data, step))] == blocks


def test_warc_damage():
    whole = b"".join(warc.inflate(warc._member([("WARC-Type", "x")], b"abc")))
    for bad in (whole[:-3], b"NO" + whole):
        with pytest.raises(ValueError, match=r".+"):
            list(warc.parse_records(iter([bad])))
    with pytest.raises(ValueError, match="member"):
        list(warc.inflate(warc._member([("WARC-Type", "x")], b"abc")[:-6]))


# Pages


@pytest.fixture(scope="module")
def model():
    return html_text.trained()


def test_blocks():
    page = "<!-- <p>no --><p>A &amp; b&nbsp;c<script>var t='</p>';</script><p>One<br>two <b>th</b>ree<ul><li>x<li>y</ul><a href='>'>z</a><style>p{}</style><p title=\"<p>\">last"
    assert [t for t, *_ in html_text.blocks(page)] == ["A & b c", "One", "two three", "x", "y", "z", "last"]
    assert [t for t, *_ in html_text.blocks("</div></p>a<div><p>b</div>c<h1>d")] == ["a", "b", "c", "d"]
    for odd in ("", "<", "<p", "<p a='", "<!--", "<script>x", "<" * 500, "<div>" * 3000 + "x", "\x00", "&#0;&bogus;&amp"):
        html_text.blocks(odd)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<head><title>t</title><h1>A</h1><p>b<header><p>c</header><p>d", ["A", "b", "c", "d"]),
        ("<head><title>t</title><meta name=x><body><header>a</header>b", ["a", "b"]),
        ("<head><script>s='<body>'</script><style>x</style></head><p>a", ["a"]),
        ("<head><script>x</head><body><p>a", ["a"]),
        ("İ" * 9 + "<p>a<script>x</SCRIPT >b<script>y</script>c", ["İ" * 9, "a", "b", "c"]),
        ("<p>a<script>x</scripted>y</script>b", ["a", "b"]),
        ("<p>a<video src=v><p>b<audio><p>c<canvas><p>d<math><p>e<iframe><p>f", ["a", "b", "c", "d", "e", "f"]),
        ("<p>a<svg/><p>b<svg><text>x</text></svg><p>c<title>t</title", ["a", "b", "c"]),
    ],
)
def test_blocks_skip_no_text(page, texts):
    assert [t for t, *_ in html_text.blocks(page)] == texts


def test_vectors_read_whole_blocks():
    text = "word " * 60 + "menu notice 12345"
    x = html_text.vectors([(text, frozenset(), frozenset(), "p", 0, 0)])[0]
    at = html_text.N_INPUT - html_text.N_MORE - html_text.N_WORDS
    share = Counter(zlib.crc32(w.encode()) % html_text.N_WORDS for w in text.split())
    assert np.allclose(x[at : at + html_text.N_WORDS], [share[i] / 63 for i in range(html_text.N_WORDS)])
    assert abs(x[at + html_text.N_WORDS + 8] - 5 / len(text)) < 1e-6


def layouts():
    """(page, paragraphs) in layouts that the training's rules don't make."""
    rng = random.Random(5)
    words = ["".join(rng.choice("the of and ing er on re ti lo ma ne su".split()) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 18))).capitalize() + "."
    texts = [" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(9)]
    body = "".join(f"<p>{t}</p>" for t in texts)
    menu = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul>'
    pages = {
        "bare": f"<html><body>{body}</body></html>",
        "neutral names": f'<div class="c1">{menu}</div><div class="z3">{body}</div><div class="q7">© 2024 Acme</div>',
        "article in a noise name": f'<div class="page top"><article>{body}</article></div>',
        "block in a noise name": f'<div class="page top"><div class="x">{body}</div></div>',
        "body with a noise name": f'<body class="with-sidebar"><nav>{menu}</nav><div id="content">{body}</div><footer>© x</footer></body>',
        "line breaks": "<body>" + "<br><br>".join(texts) + "</body>",
        "cells": f"<table><tr><td>{menu}</td><td>{body}</td></tr></table>",
        "semantic": f"<header><h1>Site</h1>{menu}</header><main>{body}</main><aside><h3>Related</h3>{menu}</aside><footer><p>© 2024. All rights reserved.</p></footer>",
        "ids": f'<div id="header">{menu}</div>{body}<div id="footer">Copyright 2024</div>',
        "notice": f'<div class="a9">We use cookies to improve. Accept</div><div class="b2">{body}</div>',
        "forms": f"<form><label>Search</label><input><button>Go</button></form><section>{body}</section><form><label>Email</label><button>Subscribe</button></form>",
        "columns": f'<div class="a"><div class="b">{menu}</div><div class="c"><div class="d">{body}</div><div class="e">{menu}</div></div></div><div class="f">Privacy policy</div>',
        "talk": f'<article>{body}</article><section class="comments"><h2>Comments</h2><p>{sentence()}</p><p>{sentence()}</p></section>',
        "named like a header": f'<div id="page-header-wrap"><div class="post">{body}</div></div>',
    }
    return [pytest.param(page, texts, id=name) for name, page in pages.items()]


@pytest.mark.parametrize(("page", "texts"), layouts())
def test_no_article_is_lost(model, page, texts):
    assert html_text.main_texts(model, [page])[0] == "\n".join(texts) or html_text.main_texts(model, [page])[0].split("\n") == " ".join(texts).split("\n")


def test_odd_pages_are_read_in_time(model):
    import time

    began = time.perf_counter()
    for odd in ("<a " * 350_000, "<a \"'>" * 150_000, "<!--" * 200_000, "<script>" * 100_000, "<div>" * 200_000 + "x", "&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;"):
        html_text.main_texts(model, [odd])
    assert [b[0] for b in html_text.blocks("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;")] == ["\ufffdA"]
    assert time.perf_counter() - began < 60


def test_long_pages_carry_states(model, monkeypatch):
    """A page in parts is labelled as in one piece, block by block."""
    rng = random.Random(77)
    page = "".join(html_text.made_page(rng)[0] for _ in range(6))
    found = html_text.blocks(page)
    x, mask = html_text._padded([html_text.vectors(found)])
    whole = model.scores(x, mask)[0]
    for part in (7, 64, 10_000):
        monkeypatch.setattr(html_text, "PART", part)
        assert np.allclose(model.long_scores(html_text.Page(found)), whole, atol=1e-3)
    monkeypatch.setattr(html_text, "STEPS", 50)
    assert html_text.main_texts(model, [page, "", page]) == ["\n".join(b[0] for b, z in zip(found, whole, strict=True) if z > 0)] * 1 + [""] + ["\n".join(b[0] for b, z in zip(found, whole, strict=True) if z > 0)]


def test_labeller(model):
    rng = random.Random(999)
    right = total = 0
    for _ in range(150):
        page, main = html_text.made_page(rng)
        found = html_text.blocks(page)
        x, mask = html_text._padded([html_text.vectors(found)])
        right += sum((s > 0) == (t in main) for s, (t, *_) in zip(model.scores(x, mask)[0], found, strict=True))
        total += len(found)
    assert right > 0.985 * total


def test_gradients():
    own = html_text.Labeller(3)
    own.p = {k: v.astype("f8") for k, v in own.p.items()}
    rng = np.random.default_rng(3)
    x, mask, y = rng.standard_normal((2, 4, html_text.N_INPUT)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]]), np.array([[1, 0, 1, 0], [0, 1, 0, 0.0]])
    x *= mask[:, :, None]
    _, grads = own.gradients(x, mask, y)
    for name in own.p:
        i = tuple(rng.integers(0, s) for s in own.p[name].shape)
        held = own.p[name][i]
        own.p[name][i] = held + 1e-3
        up, _ = own.gradients(x, mask, y)
        own.p[name][i] = held - 1e-3
        down, _ = own.gradients(x, mask, y)
        own.p[name][i] = held
        assert abs((up - down) / 2e-3 - grads[name][i]) < 1e-4


def test_extract(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html
    import re

    for r in html_text.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        parts = (re.sub(r"\s+", " ", html.unescape(p.replace("<b>", ""))).strip() for p in re.split(r"</?(?:p|br|h1)>", inside))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, "u", None, "e"), (2, None, "", "e"), (3, "v", "<p", "e")], "page_id long, url string, html string, n_chars string")
    assert [r["text"] for r in html_text.extract(odd, model).orderBy("page_id").collect()] == ["", "", ""]
    assert html_text.extract(pages.limit(0), model).count() == 0


# Pipeline


def test_pipeline(spark):
    """Every row of every stage, kept and dropped, against brute force over the stage's own input."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as pipeline
    from lodestar.llm.common import staged
    from tests.llm.test_text_operators import brute_near, hits

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    read = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        before, after = read(docs), staged(stage(spark, docs, sf), "test")
        left = {d for d, _ in read(after)}
        assert after.columns == docs.columns and after.count() == len(left)
        if name == "quality":
            # test_quality_by_brute_force recomputes these.
            want = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
        elif name == "exact copies":
            best = {}
            for d, t in before:
                best[t] = max(best.get(t, -1), d)
            want = set(best.values())
        elif name == "near copies":
            want = {d for d, (_, c) in brute_near(before, 5, 80).items() if c == d}
        else:
            bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            want = {d for d, v in hits(before, bench).items() if not v[4]}
        assert left == want and 0 < len(left) < len(before), name
        docs = after
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for d, t in read(docs):
        ids = np.array(public.encode_ordinary(t), "<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), len(t))
    got = [(r["doc_id"], (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_chars"])) for r in pipeline.run(spark, sf).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_pipeline_odd_cases(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, no labels; and no documents at all."""
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, " \t"), (None, "no id"), (6, "a b"), (6, "a b"), (7, "some leak of ten words that the benchmark has too for sure"), (8, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as __text_sha256", "1 as __text", "'h' as digest", "cast(null as string) as own", "0.5D as score")
    kinds = {"documents": documents, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "leak of ten words that the benchmark has too for sure")], "item_id long, text string")}
    for case, frame in (("some", documents), ("none", documents.limit(0))):
        for name, table in (kinds | {"documents": frame}).items():
            table.write.parquet(f"{tmp_path}/{case}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, f"{tmp_path}/some")
        assert after.columns == documents.columns
        docs = after
    got = sorted((r["doc_id"] or 0, r["n_chars"]) for r in pipeline.run(spark, f"{tmp_path}/some").collect())
    assert got == [(0, 5), (1, len(long)), (5, 2), (6, 3), (8, 0)]
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
