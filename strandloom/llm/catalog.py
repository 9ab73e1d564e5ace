"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import (
    bpe,
    conversation_trie,
    decontaminate,
    jaccard_join,
    line_dedup,
    perplexity,
    pii,
    quality_rules,
    simhash,
    token_counts,
    token_output,
    url_filter,
    whitening,
)
from strandloom.llm.common import read

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary() -> str:
    """Content of the vocabulary file, which the driver reads and sends to the tasks."""
    return bpe.Bpe(public_tokenizers.path(BYTE_BPE)).content()


def op1_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(read(spark, sf_dir, "documents"), vocabulary())


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_pages(pages, url_filter.repeated_urls(pages))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.Bpe(public_tokenizers.path(BYTE_BPE)).round_trip(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_after_edits(read(spark, sf_dir, "documents"), vocabulary())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_binary_output,
        op2_simhash_near_dedup,
        op3_quality_rules,
        op4_pii,
        op5_quality_classifier,
        op6_line_dedup,
        op7_benchmark_decontamination,
        op8_url_filters,
        op9_bpe_encode_decode,
        op10_token_counts,
        op11_embedding_whitening,
        op12_ngram_jaccard_join,
        op13_conversation_prefix_trie,
    )
}

_HOST = r"regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1)"
_PATH = r"regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RULES = "\n        ".join(
    f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}'"
    for r in sorted(url_filter.RULES, key=lambda r: -len(r.text))
)
_VERDICTS = " ".join(f"when '{r.text}' then '{r.verdict}'" for r in url_filter.RULES)

SQL: dict[str, str] = {
    "op8_url_filters": f"""
    with parts as (
        select page_id,
               case when strpos(url, '://') > 0
                    then translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
               case when strpos(url, '://') > 0 then {_PATH} else '' end as path
        from pages),
    named as (
        select *, case when host <> '' then regexp_replace(host, '^www[.]', '')
                 || regexp_replace(regexp_replace(path, '[.]html?$', ''), '/+$', '') end as canonical
        from parts),
    repeated as (select canonical from named where canonical is not null group by canonical having count(*) > 1),
    ruled as (
        select named.*, repeated.canonical is not null as listed,
        case {_RULES} end as rule
        from named left join repeated on named.canonical = repeated.canonical)
    select page_id, host, path, rule, listed,
           case when rule is not null then case rule {_VERDICTS} end
                when listed then 'block' else 'allow' end as verdict
    from ruled
    """,
    "op7_benchmark_decontamination": f"""
    with docs as (select doc_id, {_WORDS} as words from documents),
    items as (select item_id, words, least(10, len(words)) as k
              from (select item_id, {_WORDS} as words from benchmark) where len(words) > 0),
    item_windows as (
        select distinct item_id, k, words[i:i + k - 1] as win
        from (select *, unnest(range(1, len(words) - k + 2)) as i from items)),
    doc_windows as (
        select doc_id, k, i, words[i:i + k - 1] as win
        from (select doc_id, words, k, unnest(range(1, len(words) - k + 2)) as i
              from docs, (select distinct k from items) where len(words) >= k)),
    hits as (select doc_id, i, k, item_id from doc_windows join item_windows using (k, win)),
    words_hit as (select doc_id, count(distinct w) as n_hit
                  from (select doc_id, unnest(range(i, i + k)) as w from hits) group by doc_id),
    items_hit as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
                  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
    select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join words_hit using (doc_id) left join items_hit using (doc_id)
    """,
    "op12_ngram_jaccard_join": rf"""
    with recursive docs as (
        select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
    shingles as (
        select distinct doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') as shingle
        from (select *, unnest(range(1, len(words) - least(5, len(words)) + 2)) as i from docs where len(words) > 0)),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as k
               from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
               group by a.doc_id, b.doc_id),
    links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
              where 100 * k >= 80 * (x.n + y.n - k)),
    reach as (select doc_id, doc_id as other from documents union select doc_id, b from reach join links on a = other)
    select doc_id, coalesce(n, 0) as n_shingles, component_id
    from (select doc_id, min(other) as component_id from reach group by doc_id) left join sizes using (doc_id)
    """,
    "op13_conversation_prefix_trie": rf"""
    with recursive given as (
        select conv_id as c, list([coalesce(role, ''), coalesce(text, '')] order by turn nulls first, role, text) as turns
        from conversations where conv_id is not null group by conv_id),
    crc as (
        select c, 0 as bit, 4294967295::bigint as v from given
        union all
        select c, bit + 1, xor(u >> 1, (u & 1) * 3988292384)
        from (select c, bit, case when bit % 8 = 0 then xor(v, ascii(substr(c::varchar, bit // 8 + 1, 1))) else v end as u
              from crc where bit < 8 * length(c::varchar))),
    heads as (select c, xor(v, 4294967295) % 4 as h from crc where bit = 8 * length(c::varchar)),
    rebuilt as (
        select o.c, coalesce(b.turns[1:h], []) || o.turns[h + 1:] as seq
        from given o join heads using (c) left join given b on b.c = o.c - o.c % 20),
    prefixes as (select c, d as depth, seq[1:d] as seq, len(seq) = d as ends
                 from (select *, unnest(range(0, len(seq) + 1)) as d from rebuilt)),
    nodes as (
        select depth, seq, min(c) as conv_id, count(*) as n_convs,
               sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256,
               case when depth = 0 then 0 else
                   (count(*) - 1) * len(regexp_extract_all(seq[depth][2], '[^\x20\x09-\x0D]+')) end as saved
        from prefixes group by depth, seq),
    children as (select depth - 1 as depth, seq[1:depth - 1] as seq, count(*) as n_children from nodes where depth > 0 group by all),
    sized as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (depth, seq)),
    below as (select d as depth, seq[1:d] as seq, n_children, saved
              from (select *, unnest(range(0, depth + 1)) as d from sized)),
    sums as (select depth, seq, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
             from below group by depth, seq)
    select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
    from sized n join sums using (depth, seq) left join nodes p on p.depth = n.depth - 1 and p.seq = n.seq[1:n.depth - 1]
    """,
}
