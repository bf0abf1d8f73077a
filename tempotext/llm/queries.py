"""One query for each training-data operator over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embed_dedup, html_extract, lexical, lm, mixing, shards, simhash, substring, toxicity, url_rules, variants, warc
from pyspark.sql import functions as F

#: (host, path, verdict) of the url query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.cosine_links(_read(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_read(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_read(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[native] Columns only, from the scan to the shards."""
    return shards.byte_shards(_read(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_mixing, op3_decontamination, op4_lm, op5_toxicity, op6_urls, op7_simhash, op8_embeddings, op9_warc, op10_substring, op11_variants, op12_shards, op13_lexical, pipeline)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC32 of a list of hexadecimal bytes: the register goes through the table of its 256 remainders.
_CRC_TABLE = """bits(i, k, c) as (select i, 0, i from range(256) r(i) union all
    select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) t from bits where k = 8)"""
_CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::bigint)),
    lambda r, y: xor(r >> 8, t[(xor(r, y) & 255) + 1])))"""

SQL = {
    "op2_mixing": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':17'), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
         / case when length(text) > 0 then greatest(0.2, 1.0 - 4.0 * (length(text) - length(translate(text, '#$%&*|{}<>', ''))) / length(text)) else 0.2 end k
  from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w, 2.0::double * source_size cap from s),
r as (select *, cap / w r,
        coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) full_,
        sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) open_,
        1.5::double * sum(source_size) over () total, row_number() over (order by cap / w, source nulls last) place from w),
l as (select coalesce((select arg_min((total - full_) / open_, place) from r where (total - full_) / open_ <= r), (select max(r) from r)) level),
t as (select source, source_size, least(cap, level * w) target from r, l),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end epochs from t),
p as (select d.doc_id, d.size, e.source_size::bigint source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size rest,
        coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint prefix
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - prefix)))::bigint taken from p
""",
    "op6_urls": rf"""
with u as (
  select page_id, coalesce({_LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
r(h, p, v) as (values {", ".join(str(x) for x in RULES)}),
m as (select u.page_id, u.host, u.path, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) v
      from u join r on (u.host = h or suffix(u.host, '.' || h)) and starts_with(u.path, p) group by all)
select u.page_id, u.host, u.path, m.rule as rule, coalesce(m.v, 'allow') as verdict
from u left join (select distinct * from m) m on u.page_id is not distinct from m.page_id and u.host = m.host and u.path = m.path
""",
    "op9_warc": r"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h))::bigint payload_bytes, sha1(h) payload_digest from p),
k as (select payload_digest, max(page_id) last from d where payload_bytes >= 1000 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when k.last is not null and d.page_id is distinct from k.last then 'revisit' else 'response' end record_type,
       case when k.last is not null and d.page_id is distinct from k.last then k.last end refers_to
from d left join k on d.payload_digest = k.payload_digest and d.payload_bytes >= 1000
""",
    "op11_variants": rf"""
with recursive {_CRC_TABLE},
run as materialized (select doc_id, {_LOWER.format("w")} w, count(*) n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) w from documents) where length(w) >= 7 group by all),
coded as materialized (select w, n, {_CRC.format("coalesce(doc_id::varchar, '') || ':' || w")} h from run, crc),
word as materialized (select word, sum(n)::bigint n from (select n, case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end word from coded)
  where length(word) >= 7 group by 1 having sum(n) >= 2),
cut as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) rest from word, unnest(range(length(word))) r(i)),
near as (select a.word, b.word form, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from word a join cut b on a.word = b.rest union select b.word, a.word, a.n from word a join cut b on a.word = b.rest),
best as materialized (select word, count(*) n_near, arg_min(form, (-n, encode(form))) form, max(n) form_n from near group by 1),
f as materialized (select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when form_n >= 10 * w.n then form end form, case when form_n >= 10 * w.n then form_n end form_n from word w left join best b on w.word = b.word),
walk(word, root) as (select word, word from f union all select k.word, f.form from walk k join f on f.word = k.root where f.form is not null)
select f.word, f.form, k.root, f.n, f.n_near, f.form_n from f join walk k on k.word = f.word join f e on e.word = k.root and e.form is null
""",
    "op12_shards": rf"""
with recursive {_CRC_TABLE},
d as materialized (select doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::bigint size, {_CRC.format("coalesce(text, '')")} text_crc32 from documents, crc),
o as (select *, coalesce(sum(size) over (order by doc_id nulls first, text_crc32, size rows between unbounded preceding and 1 preceding), 0) before, sum(size) over () total from d),
s as (select *, ((2 * before + size) * 16 // (2 * total))::int shard from o)
select doc_id, size, text_crc32, 'bytes' law, shard, (row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1)::bigint slot, null::int grown_shard from s
""",
    "op13_lexical": rf"""
with d as materialized (select row_number() over () k, doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: {_LOWER.format("x")}) x from documents),
e as (select k, doc_id, len(x)::bigint n from d where len(x) > 0),
c as (select count(*)::bigint docs, sum(n)::bigint total from e),
tf as (select k, term, count(*)::bigint tf from (select k, unnest(x) term from d) group by all),
q as (select item, item_id, term, count(*)::bigint times
  from (select row_number() over () item, item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: {_LOWER.format("x")})) term from benchmark) group by all),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint w from tf, c group by term),
m as (select k, doc_id, 75 + (25 * n * docs) // total m from e, c),
s as (select item, item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
  from q join w using (term) join tf using (term) join m using (k) group by item, item_id, k, doc_id),
r as (select *, (row_number() over (partition by item order by score desc, doc_id nulls last))::int rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
""",
}
