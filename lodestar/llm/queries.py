"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.warc import captures

    return captures(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    from lodestar.llm.byte_bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.lm_score import FOLDS, lm_scores
    from lodestar.llm.quality import held_out

    return lm_scores(table(spark, sf_dir, "documents"), held_out(FOLDS))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_text": op4_html_text,
    "op5_warc": op5_warc,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": r"""
        with raw as (
            select item_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        windows as (
            select distinct id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
            from raw, unnest(range(1, len(w) - least(len(w), 10) + 2)) as t(i) where len(w) > 0),
        words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        spots as (
            select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s
            from words, (select distinct n from windows) as sizes, unnest(range(1, len(w) - n + 2)) as t(i)),
        hits as (select doc_id, i, spots.n, id from spots join windows on spots.s = windows.s and spots.n = windows.n),
        hit_words as (select doc_id, count(distinct j) as n_hit from hits, unnest(range(i, i + n)) as t(j) group by doc_id),
        hit_items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as items from (select distinct doc_id, cast(id as varchar) as id from hits) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from words left join hit_words using (doc_id) left join hit_items using (doc_id)""",
    "op2_suffix_dedup": """
        with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
        strings as (select doc_id, p, md5(array_slice(b, p, p + 99)) as s from d, unnest(range(1, n - 98)) as t(p)),
        later as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as r from strings) where r > 1),
        islands as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as new from later)),
        spans as (select doc_id, min(p) as a, max(p) + 99 as z from islands group by doc_id, k),
        gaps as (
            select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as a, a - 1 as z from spans
            union all select doc_id, coalesce(max(spans.z), 0) + 1, any_value(n) from d left join spans using (doc_id) group by doc_id),
        kept as (select doc_id, string_agg(hex(array_slice(b, gaps.a, gaps.z)), '' order by gaps.a) as x from gaps join d using (doc_id) where gaps.z >= gaps.a group by doc_id),
        lost as (select doc_id, sum(z - a + 1) as n_removed, count(*) as n_spans from spans group by doc_id)
        select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(x, ''))) as kept_sha256
        from d left join kept using (doc_id) left join lost using (doc_id)""",
    "op3_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
        best as (select h, max(page_id) as best from p group by h)
        select page_id, cast(strlen(html) as bigint) as payload_bytes,
          array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, cast((i // 4) * 5 + 1 as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31) + 1 as int), 1)), '') as payload_digest,
          case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to, coalesce(url, '') as url
        from p join best using (h) join (select page_id, url from pages) using (page_id)""",
    "op8_line_dedup": r"""
        with lines as (select doc_id, source, pos, l[pos] as line from (select doc_id, coalesce(source, chr(0)) as source, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as t(pos)),
        wide as (select line from lines where trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' group by line having count(distinct source) >= 5),
        marked as (select lines.*, wide.line is not null as gone from lines left join wide using (line)),
        per as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, string_agg(line, chr(10) order by pos) filter (where not gone) as kept from marked group by doc_id)
        select doc_id, coalesce(n_lines, 1) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join per using (doc_id)""",
    "op10_near_dedup": r"""
        with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        sets as (select distinct doc_id, hash(array_to_string(w[i:i + least(len(w), 3) - 1], ' ')) as s from words, unnest(range(1, len(w) - least(len(w), 3) + 2)) as t(i) where len(w) > 0),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as shared from sets as a join sets as b on a.s = b.s and a.doc_id < b.doc_id group by all),
        linked as (select a, b from common join sizes as x on x.doc_id = a join sizes as y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
        edges as (select a, b from linked union all select b, a from linked),
        reach as (select doc_id, doc_id as node from documents union select reach.doc_id, edges.b from reach join edges on reach.node = edges.a),
        found as (select doc_id, min(node) as component_id from reach group by doc_id)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from found left join sizes using (doc_id)""",
}
