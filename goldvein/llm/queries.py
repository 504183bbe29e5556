"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, licences, pieces, pii, quality, secrets, sharding, tokenindex, warc


def tokenizer(name: str) -> str:
    """A file of the public tokenizers; the folder is a parameter (``GOLDVEIN_TOKENIZERS``)."""
    folder = os.environ.get("GOLDVEIN_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_adaptive_quality(spark, sf_dir):
    got = quality.quality(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *quality.COUNTS, "base_failed", *quality.FLOORS, "kept")


def op3_sentencepiece(spark, sf_dir):
    return pieces.encode_frame(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_seekable_warc(spark, sf_dir):
    got = warc.write_and_read(spark, table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_index(spark, sf_dir):
    return tokenindex.encode_and_index(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_licence_digests(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_markov_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_histogram_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op10_contextual_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (
        op1_template_decontamination, op2_adaptive_quality, op3_sentencepiece, op4_seekable_warc, op5_token_index,
        op6_licence_digests, op7_markov_secrets, op8_histogram_shards, op9_jaccard_join, op10_contextual_pii,
    )}


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha256(h) as digest from p),
firsts as (select digest, min(page_id) as first_id from d where n >= 100 group by digest)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from d left join firsts using (digest)"""

#: What ``tokens`` takes for white space and for outer punctuation.
WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
OUTER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{2000}-\x{207F}\x{20A0}-\x{20BF}\x{3000}-\x{3011}]+"
JACCARD_SQL = rf"""
with recursive w as (select doc_id, [y for y in [regexp_replace(lower(x), '^{OUTER}|{OUTER}$', '', 'g') for x in regexp_split_to_array(text, '{WHITE}')] if y <> ''] as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i + 1 : i + least(5, len(ws))], ' ') as sh from (select doc_id, ws, unnest(range(len(ws) - least(5, len(ws)) + 1)) as i from w where len(ws) > 0)),
sets as (select doc_id, md5(string_agg(sh, '|' order by sh)) as node, count(*) as size from s group by doc_id),
nodes as (select node, min(doc_id) as rep, count(*) as copies, min(size) as size from sets group by node),
rs as (select rep, size, sh from nodes join s on rep = doc_id),
common as (select x.rep as a, y.rep as b, count(*) as c, min(x.size) as m, min(y.size) as n from rs x join rs y on x.sh = y.sh and x.rep < y.rep group by 1, 2),
pairs as (select a, b from common where c >= 0.8 * (m + n - c)),
edges as (select a, b from pairs union all select b, a from pairs),
walk(rep, seen) as (select rep, rep from nodes union select walk.rep, edges.b from walk join edges on edges.a = walk.seen),
classes as (select rep, min(seen) as class_id from walk group by rep),
links as (select a as rep, count(*) as n_sets, sum(copies) as n_docs from edges join nodes on b = nodes.rep group by 1),
sizes as (select class_id, cast(sum(copies) as bigint) as class_size from classes join nodes using (rep) group by 1)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, cast(coalesce(copies - 1, 0) + coalesce(n_docs, 0) as bigint) as n_links, coalesce(n_sets, 0) as n_linked_sets, coalesce(class_size, 1) as class_size
from documents d left join sets using (doc_id) left join nodes using (node) left join classes using (rep) left join links using (rep) left join sizes using (class_id)"""


def quality_sql() -> str:
    m = list(quality.FLOORS)
    per = {"symbol_ppm": ("n_symbols", "word_chars", 1_000_000), "upper_ppm": ("n_upper", "word_chars", 1_000_000), "dup_line_ppm": ("n_dup_lines", "n_lines", 1_000_000), "word_mil": ("word_chars", "n_words", 1_000), "mark_ppm": ("n_marks", "word_chars", 1_000_000), "repeat_ppm": ("n_repeat_words", "n_words", 1_000_000)}
    shares = ", ".join(f"case when {b} > 0 then {a} * {unit} // {b} else 0 end as {n}" for n, (a, b, unit) in per.items())
    floor = "case measure " + " ".join(f"when '{n}' then {v}" for n, v in quality.FLOORS.items()) + " end"
    letters = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
    long = " union all ".join(f"select lang, source, '{n}' as measure, {n} as v from r where not base_failed" for n in m)
    use = lambda n, f="f": f"(select {f} from used u where u.lang is not distinct from r.lang and u.source is not distinct from r.source and u.measure = '{n}')"
    white = r"[^\x20\x09-\x0D]"
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
x as (select doc_id, regexp_extract_all(t, '{white}+') as ws from d),
pos as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from x),
win as (select doc_id, i, case when i + 4 <= len(ws) then array_to_string(ws[i : i + 4], chr(1)) end as g from pos),
hit as (select doc_id, i, g is not null and count(*) over (partition by doc_id, g) > 1 as again from win),
rep as (select doc_id, count(*) filter (where covered) as n_repeat_words from (select doc_id, bool_or(again) over (partition by doc_id order by i rows between 4 preceding and current row) as covered from hit) group by 1),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{white}') group by 1),
c as (select doc_id, lang, source, len(ws) as n_words, cast(coalesce(list_sum([length(w) for w in ws]), 0) as bigint) as word_chars, {letters('#*$%&|<>')} as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, {letters('A-Z')} as n_upper, {letters('!?')} as n_marks, coalesce(n_lines, 0) as n_lines from d join x using (doc_id) left join rep using (doc_id) left join lines using (doc_id)),
r as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {shares} from c),
sk as (select lang, source, measure, cast(round(ln(1 + v) * {quality.BINS_PER_E}) as int) as bin, count(*) as n from ({long}) group by all),
lv as (select 2 as level, lang, source, measure, bin, n from sk union all select 1, lang, null, measure, bin, sum(n) from sk group by all union all select 0, null, null, measure, bin, sum(n) from sk group by all),
cum as (select *, sum(n) over (partition by level, lang, source, measure order by bin) as upto, sum(n) over (partition by level, lang, source, measure) as total from lv),
q as (select level, lang, source, measure, min(total) as total, exp(min(bin) filter (where upto >= 0.5 * total) / {float(quality.BINS_PER_E)}) - 1 as m, exp(min(bin) filter (where upto >= 0.75 * total) / {float(quality.BINS_PER_E)}) - 1 as u, exp(min(bin) filter (where upto >= 0.25 * total) / {float(quality.BINS_PER_E)}) - 1 as d from cum group by 1, 2, 3, 4),
f as (select *, greatest({floor}, m + {quality.SPREAD} * greatest(u - m, {quality.REL} * m)) as fence, least(m - {floor}, m - {quality.SPREAD} * greatest(m - d, {quality.REL} * m)) as low from q),
above as (select p.lang, p.source, p.measure, p.total, p.fence, case when l.total >= {quality.LEAST_ROWS} then l.fence else w.fence end as over_it, p.low, case when l.total >= {quality.LEAST_ROWS} then l.low else w.low end as under_it from f p join f l on l.level = 1 and l.lang is not distinct from p.lang and l.measure = p.measure join f w on w.level = 0 and w.measure = p.measure where p.level = 2),
used as (select lang, source, measure, case when total >= {quality.LEAST_ROWS} then least(fence, {quality.WIDEST} * over_it) else over_it end as f, case when total >= {quality.LEAST_ROWS} then greatest(low, under_it / {quality.WIDEST}) else under_it end as g from above)
select doc_id, {', '.join(f'cast({n} as bigint) as {n}' for n in quality.COUNTS)}, base_failed, {', '.join(f'cast({n} as bigint) as {n}' for n in m)}, not base_failed and {' and '.join([*(f'coalesce({n} <= {use(n)}, true)' for n in m), *(f'coalesce({n} >= {use(n, "g")}, true)' for n in quality.LOW)])} as kept from r"""


def oracle_sql():
    return {
        "op2_adaptive_quality": quality_sql(),
        "op4_seekable_warc": WARC_SQL,
        "op6_licence_digests": licences.oracle_sql(),
        "op9_jaccard_join": JACCARD_SQL,
    }
