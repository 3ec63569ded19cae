"""Registered queries of this subpackage over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (
    decontaminate,
    hard_negatives,
    html_text,
    jaccard_join,
    line_dedup,
    quality_rules,
    run_detection,
    secret_scan,
    sentencepiece,
    token_counts,
    topk_search,
    unit_dedup,
    warc_revisits,
)
from flowlens.llm.resources import tokenizer_file


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages").select("page_id", "html")
    text = html_text.extract_text(pages)
    return text.select("page_id", F.char_length("text").cast("long").alias("n_chars"), "text")


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _read(spark, folder, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


#: captures derived from a page: a response, then revisits and now and then another response, under
#: spellings of its URL that name the same resource, some with a validator that changed or is missing
_CAPTURES = """
  select page_id * 8 + c as record_id,
    case c % 4 when 0 then url
      when 1 then concat(replace(url, 'http:', 'HTTPS:'), '#part')
      when 2 then concat(url, case when url like '%#%' then '' when url like '%?%'
        then '&utm_campaign=x' else '?utm_campaign=x' end)
      else replace(url, '://', '://www.') end as url,
    page_id * 10 + c * 7 as ts,
    case when c = 0 or (c = 3 and page_id % 7 = 0) then 200 else 304 end as status,
    case when (page_id + c) % 6 = 5 then null
      when (page_id + c) % 5 = 4 then concat('"', cast(page_id + c as {S}), '"')
      when c > 0 and page_id % 2 = 0 then concat('W/"', cast(page_id as {S}), '"')
      else concat('"', cast(page_id as {S}), '"') end as etag,
    case when (page_id + c) % 3 = 0 then null
      else concat('day ', cast(page_id % 30 as {S})) end as modified,
    html
  from (select page_id, url, html, {each} as c from pages)"""


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl's captures with up to four visits of every page."""
    body = _CAPTURES.format(S="string", each="explode(sequence(0, page_id % 4))")
    rows = spark.sql(body.replace("from pages)", f"from parquet.`{folder}/pages.parquet`)"))
    return rows.selectExpr(
        "record_id",
        "url",
        "ts",
        "status",
        """map_filter(map('ETag', etag, 'Last-Modified', modified, 'Date', cast(ts as string),
          'Content-Length', if(status = 200, cast(length(html) as string), '0'),
          'X-Hop', cast(record_id as string), 'Connection', if(status = 304, 'close, x-hop', null)),
          (k, v) -> v is not null) as headers""",
        "if(status = 200, sha2(html, 256), null) as payload",
    )


def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_revisits.resolve(captures(spark, folder))
    entries = F.transform(
        F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.col("headers")[k])
    )
    return found.select(
        "record_id", "key", "ts", "status", "base_id", "payload", "reason",
        F.array_join(entries, ";").alias("headers"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_read(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    kept = unit_dedup.dedup_units(docs)
    return kept.select(
        "doc_id", "n_units", "n_removed", "spans", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(_read(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    fitted = quality_rules.fit(docs, _read(spark, folder, "labels"))
    return quality_rules.judge(docs, fitted).select("doc_id", "verdict.*")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    ranked = token_counts.ranked_pieces(tokenizer_file("piece_bpe_32k.model"))
    counted = token_counts.count_tokens(docs, token_counts.zipf_scores(ranked))
    return counted.select("doc_id", "n_pretokens", "n_tokens")


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, folder, "documents"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    model = tokenizer_file("piece_bpe_32k.model")
    both = sentencepiece.decode(sentencepiece.encode(docs, model), model)
    return both.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("pieces", ","), 256).alias("pieces_sha256"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


def periodic(docs: DataFrame) -> DataFrame:
    """``docs`` where every tenth text, by a checksum of its id, repeats a stretch of words to its end."""
    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("words", F.when(F.expr("h % 10 = 0"), words))
    sizes = docs.selectExpr("*", "size(words) as n", "h div 10 as g").selectExpr("*", "g % nullif(n, 0) as a")
    return sizes.selectExpr("*", "1 + (n - a) div (3 + g % 8) as p").selectExpr(
        "doc_id",
        """if(n > 0, array_join(transform(sequence(0, n - 1),
          i -> words[int(if(i < a, i, a + (i - a) % p))]), ' '), text) as text""",
    )


def op11_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic(_read(spark, folder, "documents").select("doc_id", "text"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return run_detection.find_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.top_k(_read(spark, folder, "embeddings"), F.expr("vec_id % 100 = 0"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label")
    )
    return hard_negatives.mine(vectors, F.expr("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_run_detection": op11_run_detection,
    "op12_topk_search": op12_topk_search,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

_OP2 = """
with item_words as (
  select cast(item_id as varchar) as item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
phrases as (
  select distinct item, array_to_string(w[i:i + 12], ' ') as phrase, least(len(w), 13) as size
  from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i
        from item_words where len(w) > 0)),
doc_words as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
sizes as (select distinct size from phrases),
found as (
  select d.r, d.i, p.item, p.size
  from (select r, size, w, unnest(generate_series(1, len(w) - size + 1)) as i
        from doc_words, sizes where len(w) >= size) d
  join phrases p on p.size = d.size and p.phrase = array_to_string(d.w[d.i:d.i + d.size - 1], ' ')),
hits as (
  select r, count(distinct j) as n_hit
  from (select distinct r, unnest(generate_series(i, i + size - 1)) as j from found) group by r),
names as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item from found) group by r)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit,
  coalesce(n.n_items, 0) as n_items, sha256(coalesce(n.items, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(w) as contaminated
from doc_words d left join hits h using (r) left join names n using (r)
"""

_OP3 = (
    """
with raw as ("""
    + _CAPTURES.format(S="varchar", each="unnest(generate_series(0, page_id % 4))")
    + """),
bare as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')
    as u from raw),
keyed as (
  select *, concat(
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', ''),
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', ''),
    case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end) as key
  from (select *, list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*[?](.*)$', 1), '&'),
          lambda x: x <> '' and not regexp_matches(x, '^utm_'))) as q from bare)),
ranked as (
  select *, row_number() over (partition by key order by ts, case status when 200 then 0 else 1 end,
    record_id) as n from keyed),
found as (
  select r.*, b.record_id as b_id, b.etag as b_etag, b.modified as b_modified, b.ts as b_ts,
    b.html as b_html
  from ranked r asof left join (select * from ranked where status = 200) b
    on r.key = b.key and r.n >= b.n),
judged as (
  select *, case when status <> 304 then null when b_id is null then 'no-response'
    when etag is not null and b_etag is not null then
      case when regexp_replace(etag, '^W/', '') <> regexp_replace(b_etag, '^W/', '') then 'changed' end
    when modified is not null and b_modified is not null then
      case when modified <> b_modified then 'changed' end
    else 'no-validator' end as reason from found)
select record_id, key, ts, status,
  case when status = 200 then record_id when reason is null then b_id end as base_id,
  case when status = 200 then sha256(html) when reason is null then sha256(b_html) end as payload,
  reason,
  case when status = 304 and reason is null then concat(
      'content-length=', length(b_html), ';date=', ts,
      case when coalesce(etag, b_etag) is not null then ';etag=' || coalesce(etag, b_etag) else '' end,
      case when coalesce(modified, b_modified) is not null
        then ';last-modified=' || coalesce(modified, b_modified) else '' end,
      ';x-hop=', b_id)
    else concat(
      case when status = 304 then 'connection=close, x-hop;' else '' end,
      'content-length=', case when status = 200 then length(html) else 0 end, ';date=', ts,
      case when etag is not null then ';etag=' || etag else '' end,
      case when modified is not null then ';last-modified=' || modified else '' end,
      ';x-hop=', record_id) end as headers
from judged
"""
)

_OP4 = """
with lines as (
  select doc_id, r, generate_subscripts(l, 1) as i, unnest(l) as line
  from (select doc_id, row_number() over () as r,
          string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
firsts as (
  select k, min(doc_id) as first from keyed where length(k) >= 10
  group by k having count(distinct doc_id) > 1),
marked as (
  select x.*, coalesce(x.doc_id <> f.first, false) as gone from keyed x left join firsts f using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id, r
"""

_OP9 = """
with recursive words as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct r, md5(array_to_string(w[i:i + 4], ' ')) as g
  from (select r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i
        from words where len(w) > 0)),
sizes as (select r, count(*) as n from shingles group by r),
sets as (
  select r, n, md5(g) as k from
    (select r, count(*) as n, string_agg(g, '' order by g) as g from shingles group by r)),
reps as (select k, n, min(r) as rep from sets group by k, n),
kept as (select s.r, s.g, p.n from shingles s join reps p on p.rep = s.r),
pairs as (
  select a.r as a, b.r as b from kept a join kept b on a.g = b.g and a.r < b.r
    and 4 * a.n >= 3 * b.n and 4 * b.n >= 3 * a.n
  group by a.r, b.r, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links as (
  select a, b from pairs union select b, a from pairs
  union select s.r, p.rep from sets s join reps p using (k, n)
  union select p.rep, s.r from sets s join reps p using (k, n)),
reach as (
  select r as node, r as seen from words
  union select reach.node, links.b from reach join links on links.a = reach.seen),
ends as (select node, min(doc_id) as component_id from reach join words on words.r = seen group by node)
select w.doc_id, coalesce(s.n, 0) as n_shingles, e.component_id
from words w join ends e on e.node = w.r left join sizes s on s.r = w.r
"""

#: rows with whole vectors; {scale} multiplies a component before it is floored
_VECTORS = """
  select row_number() over () as r, vec_id, label,
    list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as e
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"""

_OP12 = f"""
with v as ({_VECTORS.format(scale=1024)}),
scored as (
  select q.vec_id as query_id, q.r, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 100 = 0),
ranked as (
  select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""

_OP13 = f"""
with v as (
  select r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, e
  from ({_VECTORS.format(scale=256)}) where label is not null),
scored as (
  select a.r as a, a.vec_id as anchor_id, c.r as c, c.vec_id, a.label = c.label as same,
    cast(list_inner_product(a.e, c.e) as bigint) as score
  from v a join v c on a.r <> c.r where a.vec_id % 50 = 0),
positives as (
  select * from (select *, row_number() over (partition by a order by score desc, vec_id) as n
    from scored where same) where n <= 5),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score,
    s.score as negative_score,
    row_number() over (partition by p.a, p.c order by s.score desc, s.vec_id) as rank
  from positives p join scored s on s.a = p.a and not s.same
    and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from ranked where rank <= 3
"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": _OP2,
    "op3_warc_revisits": _OP3,
    "op4_line_dedup": _OP4,
    "op9_ngram_jaccard_join": _OP9,
    "op12_topk_search": _OP12,
    "op13_hard_negatives": _OP13,
}
