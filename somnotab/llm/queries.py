"""The registered queries of this package, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnotab.llm import (
    archive,
    contamination,
    language,
    manifest,
    middles,
    mixing,
    overlap,
    pii,
    shards,
    simhash,
    storage,
    substrings,
    topk,
    toxicity,
)

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_personal_data")
def op1(spark, folder):
    return pii.report(pii.find(table(spark, folder, "documents")))


@query("op2_virtual_slots")
def op2(spark, folder):
    return shards.assign(table(spark, folder, "documents"))


_OP3 = f"""
with docs as (
  select doc_id, source,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from docs group by source),
ranked as (
  select *, {mixing.MAX_EPOCHS} * source_size as cap,
    coalesce(sum({mixing.MAX_EPOCHS} * source_size) over before, 0) as given,
    sum(source_size) over () as whole,
    sum(weight) over () - coalesce(sum(weight) over before, 0) as open
  from sources
  window before as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
-- The first source, in the order of caps over weights, that the level of the rest does not exceed.
level as (
  select cast(whole - given as double) / cast(open as double) as level from ranked
  where cast(whole - given as double) / cast(open as double) * weight <= cap
  order by source_size / weight, source nulls last limit 1),
targets as (
  select source, source_size,
    least(coalesce((select level from level), 0.0) * weight, cast(cap as double)) as target from ranked),
quota as (
  select *, cast(coalesce(floor(target / nullif(source_size, 0)), 0) as bigint) as reps from targets),
rest as (
  select *, cast(round(target - reps * source_size) as bigint) as rest from quota),
placed as (
  select d.*, r.source_size, r.target, r.reps, r.rest,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0) as before
  from docs d join rest r on d.source is not distinct from r.source)
select doc_id, size, source_size, target,
  cast(reps * size + least(size, greatest(0, rest - before)) as bigint) as taken
from placed"""


@query("op3_source_mix", _OP3)
def op3(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_OP4 = f"""
with docs as (
  select row_number() over () as r, doc_id,
    coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
starts as (
  select r, unnest(range(len(w) - {substrings.PASSAGE - 1})) as s, w from docs where len(w) >= {substrings.PASSAGE}),
hashed as (
  select r, s, md5(array_to_string(w[s + 1 : s + {substrings.PASSAGE}], ' ')) as h from starts),
repeated as (
  select r, s from (select *, count(*) over (partition by h) as n from hashed) where n > 1),
gone as (
  select distinct r, s + o as p from repeated, unnest(range({substrings.PASSAGE})) as t(o)),
words as (select r, unnest(range(len(w))) as p, unnest(w) as word from docs),
kept as (
  select r, string_agg(word, ' ' order by p) as text, count(*) as n
  from words anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (r)"""


@query("op4_repeated_passages", _OP4)
def op4(spark, folder):
    return substrings.report(substrings.deduplicated(table(spark, folder, "documents")))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP5 = f"""
with docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
phrases as (
  select distinct item_id, least(len(w), {contamination.WINDOW}) as n,
    array_to_string(w[s + 1 : s + {contamination.WINDOW}], ' ') as phrase
  from (select *, unnest(range(greatest(len(w) - {contamination.WINDOW - 1}, 1))) as s from items where len(w) > 0)),
widths as (select distinct n from phrases),
grams as (
  select r, n, s, array_to_string(w[s + 1 : s + n], ' ') as phrase
  from (select r, w, n, unnest(range(len(w) - n + 1)) as s from docs, widths where len(w) >= n)),
found as (select r, g.n, s, item_id from grams g join phrases p on g.n = p.n and g.phrase = p.phrase),
hit as (
  select r, count(distinct s + o) as n_hit from found, unnest(range({contamination.WINDOW})) as t(o)
  where o < n group by r),
held as (
  select r, count(*) as n_items, string_agg(i, ',' order by i) as ids
  from (select distinct r, cast(item_id as varchar) as i from found where item_id is not null) group by r),
tokens as (select r, unnest(range(len(w))) as pos, unnest(w) as word from docs),
counts as (select word, count(*) as n from tokens group by word),
windows as (
  select distinct item_id, w[s + 1 : s + {contamination.WINDOW}] as p
  from (select *, unnest(range(greatest(len(w) - {contamination.WINDOW - 1}, 1))) as s from items where len(w) > 0)),
spelled as (select distinct p, unnest(list_distinct(p)) as word from windows),
leads as (
  select p, arg_min(word, (coalesce(n, 0), word)) as lead from spelled left join counts using (word)
  group by p having min(coalesce(n, 0)) > 0),
together as (
  select distinct t.r, cast(v.item_id as varchar) as i
  from leads l join tokens t on t.word = l.lead join docs d on d.r = t.r join windows v on v.p = l.p
  where v.item_id is not null and list_has_all(
    d.w[greatest(t.pos - {contamination.WINDOW - 1}, 0) + 1 : t.pos + {contamination.WINDOW}], l.p)),
near as (
  select r, count(*) as n_near from together
  where (r, i) not in (select r, cast(item_id as varchar) from found where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from docs left join hit using (r) left join held using (r) left join near using (r)"""


@query("op5_benchmark_passages", _OP5)
def op5(spark, folder):
    found = contamination.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), proximity=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


_OP6 = f"""
with p as (
  select page_id, coalesce(html, '') as h, regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') as u,
    sha1(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
k as (select *, max(page_id) over (partition by h) as keeper from p),
t as (
  select *, payload_bytes >= {archive.SHARED_BYTES} and page_id is distinct from keeper as again,
    chr(13) || chr(10) as e from k)
select page_id, payload_bytes, payload_digest,
  case when again then 'revisit' else 'response' end as record_type,
  case when again then keeper end as refers_to,
  sha256('WARC/1.1' || e || 'WARC-Type: ' || case when again then 'revisit' else 'response' end || e
    || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '') || '>' || e
    || 'WARC-Date: {archive.EPOCH}' || e || 'WARC-Target-URI: ' || u || e
    || 'WARC-Payload-Digest: sha1:' || payload_digest || e
    || case when again then 'WARC-Refers-To: <urn:page:' || cast(keeper as varchar) || '>' || e else '' end
    || 'Content-Length: ' || case when again then '0' else cast(payload_bytes as varchar) end || e || e
    || case when again then '' else h end || e || e) as record_sha256
from t"""


@query("op6_content_archive", _OP6)
def op6(spark, folder):
    path = storage.new_path(spark, "warc")
    archive.write(table(spark, folder, "pages"), path)
    records = archive.report(archive.read(spark, path))
    return records.drop("header_digest")


@query("op7_word_languages")
def op7(spark, folder):
    documents = table(spark, folder, "documents")
    predicted = language.predict(documents, language.train(documents))
    switches = F.greatest(F.size("segments") - 1, F.lit(0)).alias("n_switches")
    return predicted.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", switches)


@query("op8_near_copies")
def op8(spark, folder):
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_toxic_terms")
def op9(spark, folder):
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    scored = toxicity.predict(documents, model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("hits").alias("n_hits"),
    )


_OP10 = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({topk.SCALE} * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e::double[], c.e::double[]) as bigint) as score
  from v q join v c on q.vec_id % {topk.EVERY} = 0 and q.vec_id <> c.vec_id)
select query_id, cast(r as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from pairs)
where r <= {topk.K}"""


@query("op10_inner_products", _OP10)
def op10(spark, folder):
    return topk.search(table(spark, folder, "embeddings"))


_OP11 = """
with drawn as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cuts as (
  select doc_id, t, n,
    cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as a, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
        or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 90 then 'plain'
      when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, substr(t, 1, least(a, b)) as prefix, substr(t, least(a, b) + 1, abs(a - b)) as middle,
    substr(t, greatest(a, b) + 1) as suffix from cuts)
select doc_id, n, form,
  case when form <> 'plain' then least(a, b) end as prefix_chars,
  case when form <> 'plain' then abs(a - b) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from parts"""


@query("op11_middles", _OP11)
def op11(spark, folder):
    return middles.report(middles.transform(table(spark, folder, "documents")))


def _sized(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_HEAD = " || ".join(_sized(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ord(c)::bigint)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
      lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_OP12 = f"""
with recursive docs as (
  select row_number() over () as r, doc_id, source,
    sha256({_HEAD} || {_sized("text")}) as leaf,
    sha256({_HEAD} || {_sized("case when " + _CRC32 + " % 2 = 0 then replace(text, chr(10), '') else text end")}) as claim
  from documents),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by source) as n from docs),
lower_tree as (
  select source, 0 as level, pos, n, leaf as digest from placed
  union all
  select source, level + 1, pos // {manifest.ARITY}, (n + 2) // {manifest.ARITY}, sha256(string_agg(digest, '' order by pos))
  from lower_tree where n > 1 group by source, level, pos // {manifest.ARITY}, n),
subroots as (
  select source, level as height, digest, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n
  from lower_tree where n = 1),
upper_tree as (
  select 0 as level, pos, n, digest from subroots
  union all
  select level + 1, pos // {manifest.ARITY}, (n + 2) // {manifest.ARITY}, sha256(string_agg(digest, '' order by pos))
  from upper_tree where n > 1 group by level, pos // {manifest.ARITY}, n),
climb as (
  select r, source, 0 as level, pos from placed
  union all
  select r, c.source, c.level + 1, c.pos // {manifest.ARITY} from climb c
    join subroots s on c.source is not distinct from s.source and c.level < s.height),
steps as (
  select c.r, c.level,
    coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos < c.pos), '') as before,
    coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos > c.pos), '') as behind
  from climb c join lower_tree t on c.source is not distinct from t.source and c.level = t.level
    and c.pos // {manifest.ARITY} = t.pos // {manifest.ARITY}
  where t.n > 1 group by c.r, c.level),
upper_climb as (
  select source, 0 as level, pos from subroots
  union all
  select source, level + 1, pos // {manifest.ARITY} from upper_climb where level < (select max(level) from upper_tree)),
upper_steps as (
  select c.source, c.level,
    coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos < c.pos), '') as before,
    coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos > c.pos), '') as behind
  from upper_climb c join upper_tree t on c.level = t.level and c.pos // {manifest.ARITY} = t.pos // {manifest.ARITY}
  where t.n > 1 group by c.source, c.level),
way as (
  select r, level, before, behind from steps
  union all
  select p.r, s.height + u.level, u.before, u.behind from placed p
    join subroots s on p.source is not distinct from s.source join upper_steps u on u.source is not distinct from s.source),
folded as (
  select r, 0 as level, claim as digest from placed
  union all
  select f.r, f.level + 1, sha256(w.before || f.digest || w.behind) from folded f join way w on f.r = w.r and f.level = w.level),
proofs as (select r, string_agg(before || behind, '' order by level) as proof from way group by r),
ends as (select r, arg_max(digest, level) as digest from folded group by r)
select doc_id, leaf, s.digest as subroot, u.digest as root, sha256(coalesce(proof, '')) as proof_sha256,
  e.digest as folded_root, e.digest = u.digest as verified
from placed p join subroots s on p.source is not distinct from s.source
  join (select digest from upper_tree where n = 1) u on true join ends e using (r) left join proofs using (r)"""


@query("op12_manifest", _OP12)
def op12(spark, folder):
    return manifest.manifest(table(spark, folder, "documents"), manifest.even_checksum(F.col("doc_id")))


_OP13 = f"""
with recursive docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select r, doc_id, list_sort(list_distinct(list_transform(
    range(case when len(w) = 0 then 0 else greatest(len(w) - {overlap.SHINGLE - 1}, 1) end),
    lambda s: array_to_string(w[s + 1 : s + {overlap.SHINGLE}], ' ')))) as grams from docs),
alike as (select min(r) as r, min(doc_id) as least, grams from sets where len(grams) > 0 group by grams),
single as (select r, len(grams) as n, unnest(grams) as gram from alike),
links as (
  select a.r as u, b.r as v from single a join single b on a.gram = b.gram and a.r < b.r
  group by a.r, b.r, a.n, b.n having 100 * count(*) >= {overlap.PERCENT} * (a.n + b.n - count(*))),
edges as (select u, v from links union all select v, u from links),
reach as (select r as u, r as v from alike union select reach.u, edges.v from reach join edges on reach.v = edges.u),
named as (
  select reach.u as r, min(least) as component_id from reach join alike on reach.v = alike.r group by reach.u)
select s.doc_id, cast(len(s.grams) as bigint) as n_shingles,
  case when len(s.grams) = 0 then s.doc_id else component_id end as component_id
from sets s left join alike a on s.grams = a.grams left join named on a.r = named.r"""


@query("op13_shingle_overlap", _OP13)
def op13(spark, folder):
    return overlap.groups(table(spark, folder, "documents"))
