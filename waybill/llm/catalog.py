"""The operators' registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import (byte_bpe, chat, fertility, filter_audit, hidden_markov, mixing, near_copies, periodic_runs, simhash,
                         token_counts, token_files, topk, urls)
from waybill.llm.frames import WORD, read
from waybill.session import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


@query("op1_token_counts")
def op1_token_counts(spark, folder):
    return token_counts.count_tokens(read(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), 4096)


@query("op2_byte_bpe")
def op2_byte_bpe(spark, folder):
    return byte_bpe.round_trip(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


END_ID = 1


@query("op3_token_files")
def op3_token_files(spark, folder):
    out = fresh_folder(spark, "token-files")
    directory, files = token_files.write_token_files(
        read(spark, folder, "documents"), out, vocabulary("word_bpe_49k.json"), END_ID)
    keys = directory.select("key", "copy")
    found = token_files.read_ids(token_files.find(keys, out, files), out, 2)
    starts = token_files.shard_starts(directory)
    return token_files.with_start(found, starts).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_OP4 = """
with t as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls last, coalesce(role, 'unknown'), text) - 1 as place
  from conversations),
speakers as (select distinct conv_id, role as speaker from t where role <> 'system'),
m as (
  select t.conv_id, speaker, place // 64 as page, place, role = speaker as own, text,
         case when role = speaker then '<|assistant|>' when role = 'system' then '<|system|>'
              else '<|user name=' || role || '|>' end || chr(10) as head
  from t join speakers s on t.conv_id is not distinct from s.conv_id),
spans as (
  select *, head || text || '<|end|>' || chr(10) as line, coalesce(sum(length(head || text) + 8) over (
           partition by conv_id, speaker, page order by place rows between unbounded preceding and 1 preceding), 0)
         + length(head) as start from m)
select conv_id, speaker, page, count(*) as n_turns, count(*) filter (own) as n_target_turns,
       string_agg(line, '' order by place) as text,
       coalesce(string_agg(start::bigint || '-' || (start + length(text))::bigint, ',' order by place) filter (own), '') as mask
from spans group by conv_id, speaker, page
"""


@query("op4_perspectives", _OP4)
def op4_perspectives(spark, folder):
    pages = chat.rotate_perspectives(read(spark, folder, "conversations"), page_turns=64)
    spans = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["stop"].cast("string")))
    return pages.select("conv_id", "speaker", "page", "n_turns", "n_target_turns", "text", F.array_join(spans, ",").alias("mask"))


@query("op5_hidden_markov")
def op5_hidden_markov(spark, folder):
    return hidden_markov.score_texts(read(spark, folder, "documents"))


@query("op6_fertility")
def op6_fertility(spark, folder):
    return fertility.judge_quality(read(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op7_near_copies")
def op7_near_copies(spark, folder):
    return near_copies.near_copies(read(spark, folder, "documents"))


#: The rules of the query, fixed: host, path, action.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

_OP8 = r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
rules(h, p, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits as (
  select page_id, max_by(h || p, length(h || p)) as rule, max_by(action, length(h || p)) as action
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from p left join hits using (page_id)
"""


@query("op8_url_filters", _OP8)
def op8_url_filters(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urls.filter_urls(read(spark, folder, "pages"), rules)


_OP9 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


@query("op9_top_k", _OP9)
def op9_top_k(spark, folder):
    return topk.top_k(read(spark, folder, "embeddings"), F.col("id") % 50 == 0, 5)


@query("op10_mixing")
def op10_mixing(spark, folder):
    return mixing.mix_sources(read(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


_OP11 = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
f as (
  select part, quality = 1 as good, toxic = 1 as toxic, map {
         'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
         'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
         'E': coalesce(doc_id > min(doc_id) over (partition by text), false)} as fails
  from w left join l using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
m as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, fails),
s as (
  select part, filter_order, step::int as step, filter_order[step] as x, fails, n, good, toxic,
         len(list_filter(range(1, step), lambda k: fails[filter_order[k]])) = 0 as there
  from m, o, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, step, x, sum(n) filter (there and not fails[x]) as kept,
         sum(n) filter (there and fails[x]) as removed, sum(n) filter (not there and fails[x]) as redundant,
         sum(n) filter (fails[x] and len(list_filter(map_values(fails), lambda v: v)) = 1) as unique_fails,
         sum(good) filter (there and fails[x]) as good_lost, sum(toxic) filter (there and fails[x]) as toxic_lost
  from s group by part, filter_order, step, x)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, x), 0)::bigint as shapley
from r
"""


@query("op11_filter_audit", _OP11)
def op11_filter_audit(spark, folder):
    return filter_audit.audit_filters(read(spark, folder, "documents"), read(spark, folder, "labels")).drop("filter")


_OP12 = r"""
with bytes as (
  select doc_id, list_transform(range(1, len(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))) as codes
  from documents),
h as (
  select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(
           range(0, 8 * len(codes)), lambda k: (codes[k // 8 + 1] >> (k % 8)) & 1)),
         lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) as h from bytes),
w as (
  select doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents join h using (doc_id)),
p as (
  select doc_id, words, len(words) as n, h % 10 = 0 and len(words) > 0 as planted,
         case when len(words) > 0 then (h // 10) % len(words) else 0 end as a, 3 + (h // 10) % 8 as share from w),
t as (
  select doc_id, n, case when planted then list_transform(range(0, n), lambda i: case when i < a then words[i + 1]
           else words[a + (i - a) % (1 + (n - a) // share) + 1] end) else words end as words from p),
each as (select doc_id, n, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from t),
pairs as (
  select x.doc_id, y.i - x.i as period, x.i from each x join each y
  on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 4),
islands as (
  select doc_id, period, i, i - row_number() over (partition by doc_id, period order by i) as island from pairs),
stretches as (
  select doc_id, period, min(i) as start, count(*) + period as length from islands group by doc_id, period, island
  having count(*) + period >= greatest(6, 4 * period)),
runs as (select doc_id, start, length, min(period) as period from stretches group by doc_id, start, length),
listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text,
         first({'start': start, 'length': length, 'period': period} order by length desc, start, period) as longest
  from runs group by doc_id),
dropped as (
  select distinct doc_id, unnest(range((start + period)::bigint, (start + length)::bigint)) as i from runs),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text from each anti join dropped using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, longest.start::bigint as start, longest.length::bigint as length,
       longest.period::bigint as period, (1000 * longest.length // longest.period)::bigint as exponent_milli,
       sha256(coalesce(listed.text, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from t left join listed using (doc_id) left join kept using (doc_id)
"""


def planted(docs: DataFrame) -> DataFrame:
    """Documents with their words made periodic from some word on in a tenth of them, by the checksum of the key."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    rows = rows.select("doc_id", "text", "_words", n.alias("_n"), (g % F.greatest(n, F.lit(1))).alias("_a"), (3 + g % 8).alias("_share"))
    period = 1 + F.floor((F.col("_n") - F.col("_a")) / F.col("_share"))
    rows = rows.withColumn("_p", period)
    moved = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get(F.col("_words"), F.when(i < F.col("_a"), i).otherwise(
        F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.concat_ws(" ", moved)).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", _OP12)
def op12_periodic_runs(spark, folder):
    found = periodic_runs.periodic_runs(planted(read(spark, folder, "documents")))
    first = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"]))
                                      .when(x["start"] != y["start"], F.sign(x["start"] - y["start"]))
                                      .otherwise(F.sign(x["period"] - y["period"])).cast("int")), 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    longest = F.when(F.size("runs") > 0, first)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest["start"].alias("start"), longest["length"].alias("length"),
        longest["period"].alias("period"), F.floor(1000 * longest["length"] / longest["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_simhash")
def op13_simhash(spark, folder):
    return simhash.near_copies(read(spark, folder, "documents"))
