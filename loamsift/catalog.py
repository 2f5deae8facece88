"""Queries over the test tables, one or more per operator, and DuckDB SQL for those that SQL can express.

Each query runs over its whole tables. ``_seq`` of a conversation pair is conv_id x 1000 + turn.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.functions import text as X
from loamsift.models import FakeModel, unit
from loamsift.operators import aggregates, dedup, filters, generate, scoring, similarity
from loamsift.operators import taxonomy as tax
from loamsift.operators.base import Context
from loamsift.schema import CONV, INSTRUCTION, LINEAGE, RESPONSE, as_records, conversation, fields, hashed
from loamsift.sources import readers, sinks
from loamsift.streaming import events as streams

QUERIES, ORACLE_SQL = {}, {}
W = X.SPACE


class Pattern(str):
    """SQL with {0} for an operand; other braces stay, as regular expressions have some."""

    def format(self, operand: str) -> str:
        return self.replace("{0}", operand)


STRIP = Pattern("regexp_replace({0}, '^" + W + "+|" + W + "+$', '', 'g')")
PHRASES = ["schver", "ention an", "ciónes", "the"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    t = readers.pairs_of_turns(table(spark, d, "conversations"))
    return t.select("conv_id", "turn", X.strip(F.col("instruction")).alias("instruction"), X.strip(F.col("response")).alias("response"))


def pair_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the conversation pairs; a pair's parent is the pair two turns before."""
    p = pair_rows(spark, d).withColumn("_seq", F.col("conv_id") * 1000 + F.col("turn"))
    p = p.withColumn("payload", conversation(F.col("instruction"), F.col("response"))).withColumn("record_type", F.lit(CONV))
    up = (F.col("_seq") - 2).cast("string")
    p = p.withColumn("lineage", fields(LINEAGE, root_id=F.col("conv_id").cast("string"), parent_ids=F.array(up), operator=F.lit("seed"), round=F.lit(0), depth=F.lit(0)))
    return as_records(hashed(p).withColumn("id", F.col("_seq").cast("string")))


PAIRS = f"""pairs as (select conv_id, turn, conv_id * 1000 + turn as seq, {STRIP.format('text')} as i, {STRIP.format('nt')} as r from (
  select *, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant')"""


@query(f"with {PAIRS} select conv_id, turn, i as instruction, r as response from pairs")
def conversation_pairs(spark, d):
    return pair_rows(spark, d)


REASON = "case when length(i) < 10 then 'instruction_too_short' when length(i) > 400 then 'instruction_too_long' when length(r) < 60 then 'response_too_short' when length(r) > 800 then 'response_too_long' end"
BOUNDS = filters.Length(10, 400, 60, 800)


@query(f"with {PAIRS} select seq from pairs where {REASON} is null")
def length_filter(spark, d):
    return BOUNDS.transform(pair_records(spark, d), Context()).kept.select(F.col("_seq").alias("seq"))


@query(f"with {PAIRS} select '02a_length_filter' as stage, {REASON} as reason, count(*) as n_rows from pairs where {REASON} is not null group by 2")
def length_drop_reasons(spark, d):
    return aggregates.drop_reasons(BOUNDS.transform(pair_records(spark, d), Context()).dropped)


LATIN = r"length(regexp_replace(i, '[^\p{L}]|[\x{0250}-\x{10FFFF}]', '', 'g'))"
LETTERS = r"length(regexp_replace(i, '[^\p{L}]', '', 'g'))"


@query(f"with {PAIRS} select seq, case when {LETTERS} > 0 then {LATIN}::double / {LETTERS} end as share from pairs where {LETTERS} = 0 or {LATIN}::double / {LETTERS} >= 0.7")
def language_filter(spark, d):
    kept = filters.Language().transform(pair_records(spark, d), Context()).kept
    return kept.select(F.col("_seq").alias("seq"), X.latin_share(F.col(INSTRUCTION)).alias("share"))


@query(
    f"""with {PAIRS}, s as (select seq, list_filter(regexp_split_to_array(r, '[.!?]+'), lambda x: length({STRIP.format('x')}) > 0) as p from pairs),
n as (select seq, list_transform(p, lambda x: len(list_filter(regexp_split_to_array(x, '{W}+'), lambda y: y <> ''))::double) as n from s),
c as (select seq, case when len(n) < 2 then 1.0 when list_avg(n) = 0 then 0.0 else list_stddev_pop(n) / list_avg(n) end as cv from n) select seq, round(cv, 6) as cv, cv >= 0.15 as kept from c"""
)
def sentence_variance(spark, d):
    cv = X.variation(X.sentence_lengths(F.col(RESPONSE)))
    out = filters.SentenceVariance().transform(pair_records(spark, d), Context())
    row = lambda df, kept: df.select(F.col("_seq").alias("seq"), F.round(cv, 6).alias("cv"), F.lit(kept).alias("kept"))
    return row(out.kept, True).unionAll(row(out.dropped, False))


FOUND = "case " + " ".join(f"when contains(i || chr(10) || r, '{p}') then '{p}'" for p in PHRASES) + " end"


@query(f"with {PAIRS} select seq, {FOUND} as phrase from pairs where {FOUND} is not null")
def canary_filter(spark, d):
    gone = filters.Canary(PHRASES).transform(pair_records(spark, d), Context()).dropped
    return gone.select(F.col("_seq").alias("seq"), F.element_at("stage_events", -1)["details"].alias("phrase"))


def document_records(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").withColumn("_seq", F.col("doc_id")).withColumn("id", F.col("doc_id").cast("string")).withColumn("record_type", F.lit(CONV))
    return as_records(t.withColumn("payload", conversation(F.col("text"), F.lit(""))).withColumn("content_hash", F.sha2("text", 256)))


FIRST = "f as (select doc_id, min(doc_id) over (partition by text) as first_id from documents)"


@query(f"with {FIRST} select doc_id from f where doc_id = first_id")
def exact_dedup(spark, d):
    return dedup.ExactDedup().transform(document_records(spark, d), Context()).kept.select(F.col("_seq").alias("doc_id"))


@query(f"with {FIRST} select doc_id, 'duplicate_of=' || first_id as details from f where doc_id <> first_id")
def exact_dedup_dropped(spark, d):
    gone = dedup.ExactDedup().transform(document_records(spark, d), Context()).dropped
    return gone.select(F.col("_seq").alias("doc_id"), F.element_at("stage_events", -1)["details"].alias("details"))


@query("select min(doc_id)::varchar as representative_id, count(*) as member_count, string_agg(doc_id::varchar, ',' order by doc_id) as members from documents group by text having count(*) >= 2")
def exact_clusters(spark, d):
    c = dedup.ExactDedup().transform(document_records(spark, d), Context()).extras["clusters"]
    return c.select("representative_id", "member_count", F.array_join(F.from_json("member_ids_json", "array<string>"), ",").alias("members"))


@query(
    f"""with s as (select doc_id, text, unnest(generate_series(0, length(text) - 1, 2700)) as a from documents where length(text) > 0),
c as (select doc_id, a, {STRIP.format('substr(text, a + 1, 3000)')} as chunk from s)
select doc_id, (a / 2700)::bigint as chunk_idx, a::bigint as char_start, (a + length(chunk))::bigint as char_end, len(list_filter(regexp_split_to_array(chunk, '{W}+'), lambda y: y <> ''))::bigint as word_count, sha256(chunk) as content_hash from c where length(chunk) > 0"""
)
def chunk_documents(spark, d):
    c = readers.chunk_rows(table(spark, d, "documents"), F.col("text"))
    return c.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.col("word_count").cast("long").alias("word_count"), F.sha2("chunk", 256).alias("content_hash"))


@query(f"with {PAIRS}, n as (select seq, row_number() over (order by seq) - 1 as k, count(*) over () as c from pairs), p as (select unnest(generate_series(0, 999)) as plan_index) select p.plan_index, n.seq from p join n on n.k = p.plan_index % n.c")
def seed_plan_cycle(spark, d):
    return generate.seed_plan(pair_records(spark, d), 1000).select("plan_index", F.col("_seq").alias("seq"))


@query(f"with {PAIRS}, n as (select seq, row_number() over (order by seq) - 1 as k, count(*) over () as c from pairs), p as (select unnest(generate_series(0, 11999)) as plan_index) select p.plan_index, n.seq from p join n on n.k = p.plan_index % n.c where p.plan_index not in (select event_id from events)")
def plan_remaining(spark, d):
    plan = generate.seed_plan(pair_records(spark, d), 12000)
    return sinks.remaining(plan, table(spark, d, "events").select(F.col("event_id").alias("plan_index"))).select("plan_index", F.col("_seq").alias("seq"))


HASHES = 32
SHINGLES = r"""tk as (select seq, regexp_extract_all(lower(i), '[\p{L}\p{N}_]+') as t from pairs),
sh as (select distinct seq, array_to_string(t[k:k + 4], ' ') as s from tk, unnest(generate_series(1, greatest(len(t) - 4, 1))) g(k) where len(t) > 0)"""
SIG = f"""{SHINGLES}, mh as (select seq, h, min(substr(sha256(h || ':' || s), 1, 16)) as m from sh, unnest(generate_series(0, {HASHES - 1})) g(h) group by seq, h)"""


@query(f"with {PAIRS}, {SIG} select seq, sha256(string_agg(m, ',' order by h)) as signature from mh group by seq")
def minhash_signatures(spark, d):
    s = dedup.signatures(pair_records(spark, d), F.col(INSTRUCTION), 5, HASHES, "sha256")
    return s.select(F.col("_seq").alias("seq"), F.sha2(F.array_join("sig", ","), 256).alias("signature"))


@query(
    f"""with {PAIRS}, {SIG}, sg as (select seq, list(m order by h) as sig from mh group by seq), nd as (select sig, min(seq) as node from sg group by sig),
bd as (select node, sig, b, sig[b * 1 + 1:(b + 1) * 1] as band from nd, unnest(generate_series(0, {HASHES - 1})) g(b)),
pr as (select distinct x.node as a, y.node as b, x.sig as sa, y.sig as sb from bd x join bd y on x.b = y.b and x.band = y.band and x.node < y.node)
select a, b from pr where len(list_filter(list_zip(sa, sb), lambda z: z[1] = z[2])) >= 0.03 * {HASHES}"""
)
def near_dup_pairs(spark, d):
    return dedup.near_edges(dedup.packed(dedup.signatures(pair_records(spark, d), F.col(INSTRUCTION), 5, HASHES, "sha256")), HASHES, HASHES, 0.03)


@query(
    f"""with {PAIRS}, {SHINGLES}, n as (select seq, count(*) as n from sh group by seq), c as (select a.seq, count(*) as c from sh a join sh b on a.s = b.s and b.seq = a.seq - 2 group by a.seq)
select n.seq, round(coalesce(c.c, 0)::double / (n.n + m.n - coalesce(c.c, 0)), 6) as jaccard from n join n m on m.seq = n.seq - 2 left join c on c.seq = n.seq"""
)
def shingle_jaccard(spark, d):
    s = pair_records(spark, d).select(F.col("_seq").alias("seq"), X.shingles(X.tokens(F.col(INSTRUCTION)), 5).alias("s")).where(F.size("s") > 0)
    both = s.join(s.select((F.col("seq") + 2).alias("seq"), F.col("s").alias("t")), "seq")
    same = F.size(F.array_intersect("s", "t"))
    return both.select("seq", F.round(same / (F.size("s") + F.size("t") - same), 6).alias("jaccard"))


@query("with s as (select embedding from embeddings where label = 0) select e.vec_id, round(max(list_cosine_similarity(e.embedding::double[], s.embedding::double[])), 4) as best from embeddings e, s where e.label <> 0 group by e.vec_id")
def semantic_similarity(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.max_similarity(e.where("label <> 0"), e.where("label = 0"), "vec_id", "embedding").select("vec_id", F.round("best", 4).alias("best"))


@query("with c as (select count(*) as c from embeddings group by label), t as (select sum(c) as t from c) select round(-sum(c / t * ln(c / t + 1e-10)) / ln(10), 4) as diversity from c, t")
def diversity_entropy(spark, d):
    return similarity.entropy(table(spark, d, "embeddings"), "label", 10)


@query()
def kmeans_diversity(spark, d):
    return similarity.diversity(table(spark, d, "embeddings"), "embedding")


@query("with f as (select vec_id, embedding::double[] as v from embeddings order by vec_id limit 200) select count(*) as n_pairs, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) as avg_distance from f a join f b on a.vec_id < b.vec_id")
def avg_pairwise_cosine(spark, d):
    return similarity.average_distance(table(spark, d, "embeddings"), "vec_id", "embedding")


def label_records(spark, d):
    t = table(spark, d, "labels").withColumn("_seq", F.col("doc_id")).withColumn("record_type", F.lit(CONV)).withColumn("payload", conversation(F.col("doc_id").cast("string"), F.lit("")))
    dims = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))
    return scoring.scored(as_records(t.withColumn("id", F.col("doc_id").cast("string"))).join(t.select(F.col("doc_id").alias("_d"), dims.alias("_m")), F.col("_seq") == F.col("_d")), dims=F.col("_m"), quality=X.weighted(F.col("_m"), {"quality": 0.6, "toxic": 0.4})).drop("_d", "_m")


@query("select doc_id, round(quality * 0.6::double + toxic * 0.4::double, 4) as overall from labels")
def judge_overall(spark, d):
    return label_records(spark, d).select(F.col("_seq").alias("doc_id"), F.col("scores.quality").alias("overall"))


@query("with o as (select toxic, round(quality * 0.6::double + toxic * 0.4::double, 4) as v from labels) select toxic, count(*) as n, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as std, round(min(v), 4) as min, round(max(v), 4) as max from o group by toxic")
def quality_distribution(spark, d):
    t = table(spark, d, "labels").withColumn("v", F.round(F.col("quality") * F.lit(0.6) + F.col("toxic") * F.lit(0.4), 4))
    return aggregates.distribution(t, F.col("v"), "toxic")


COMPOSITE = "o as (select doc_id, quality * 0.6::double + toxic * 0.4::double as v, row_number() over (order by round(quality * 0.6::double + toxic * 0.4::double, 4) * 1.0 + toxic * 0.5 desc, doc_id) as rank from labels)"
SELECT = scoring.CompositeSelect({"quality": 1.0, "toxic": 0.5}, 100)


@query(f"with {COMPOSITE} select doc_id from o where rank <= 100")
def composite_select(spark, d):
    return SELECT.transform(label_records(spark, d), Context()).kept.select(F.col("_seq").alias("doc_id"))


@query(f"with {COMPOSITE} select count(*) as n_dropped, sum(doc_id)::bigint as ids from o where rank > 100")
def select_dropped(spark, d):
    return SELECT.transform(label_records(spark, d), Context()).dropped.agg(F.count("*").alias("n_dropped"), F.sum("_seq").alias("ids"))


@query(
    f"""with {PAIRS}, s as (select seq, (length(i) % 100) / 100.0::double as q, length(r) as n from pairs), j as (select c.seq, c.q, p.q as pq, c.n, p.n as pn from s c left join s p on p.seq = c.seq - 2)
select seq, case when pq is null then null when pn > 0 and n::double / pn > 1.3 then 'length_ratio_exceeded' when q - pq < 0.3::double then 'insufficient_delta' end as reason from j"""
)
def pair_delta(spark, d):
    r = pair_records(spark, d)
    r = scoring.scored(r, quality=(F.length(INSTRUCTION) % 100) / F.lit(100.0))
    out = scoring.PairDelta(length_ratio_max=1.3).transform(r, Context())
    row = lambda df, reason: df.select(F.col("_seq").alias("seq"), reason.alias("reason"))
    return row(out.kept, F.lit(None).cast("string")).unionAll(row(out.dropped, F.element_at("stage_events", -1)["reason_code"]))


NORM = Pattern("regexp_replace(" + STRIP.format("lower({0})") + f", '{W}+', ' ', 'g')")


def evol_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Instructions beside that of two turns before."""
    p = pair_rows(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("instruction").alias("i"))
    return p.join(p.select((F.col("seq") + 2).alias("seq"), F.col("i").alias("p")), "seq")


def evol_verdicts(pairs: DataFrame) -> DataFrame:
    return pairs.select("seq", filters.evol_reason(F.col("i"), F.col("p")).alias("reason"))


# DuckDB's levenshtein counts bytes: every character beyond ASCII gets a control character of its own (the tables have fewer)
ONE_BYTE = Pattern("translate({0}, (select coalesce(string_agg(c, '' order by c), '') from beyond), (select coalesce(string_agg(chr(k::int), '' order by c), '') from beyond))")


@query(
    f"""with {PAIRS}, beyond as (select c, case when row_number() over (order by c) < 9 then row_number() over (order by c) else row_number() over (order by c) + 5 end as k
  from (select distinct unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) as c from conversations)),
j as (select c.seq, c.i as c, p.i as p from pairs c join pairs p on p.seq = c.seq - 2)
select seq, case when {NORM.format('c')} = {NORM.format('p')} then 'evol_identical_to_parent' when contains(lower(c), 'i cannot') or contains(lower(c), 'i''m unable') or contains(lower(c), 'as an ai') then 'evol_refusal'
when length({STRIP.format('c')}) < 20 then 'evol_instruction_too_short' when levenshtein({ONE_BYTE.format('c')}, {ONE_BYTE.format('p')}) < 20 then 'evol_edit_distance_too_small' end as reason from j"""
)
def evol_rejection(spark, d):
    """Every pair, whatever its letters."""
    return evol_verdicts(evol_pairs(spark, d))


@query(f"with {PAIRS} select seq, 2::bigint as n_messages, 'user,assistant' as roles, length(i)::bigint as first_chars, sha256(r) as last_hash from pairs")
def export_chatml(spark, d):
    m = F.from_json(sinks.line_chatml(), "struct<messages:array<struct<role:string,content:string>>>")["messages"]
    out = pair_records(spark, d).select(F.col("_seq").alias("seq"), m.alias("m"))
    return out.select("seq", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.length(F.col("m")[0]["content"]).cast("long").alias("first_chars"), F.sha2(F.element_at("m", -1)["content"], 256).alias("last_hash"))


@query(f"with {PAIRS} select seq, sha256(i) as instruction, '' as input, sha256(r) as output from pairs")
def export_alpaca(spark, d):
    m = F.from_json(sinks.line_alpaca(), "struct<instruction:string,input:string,output:string>")
    return pair_records(spark, d).select(F.col("_seq").alias("seq"), m.alias("m")).select("seq", F.sha2("m.instruction", 256).alias("instruction"), "m.input", F.sha2("m.output", 256).alias("output"))


@query(f"with {PAIRS} select seq, length(i)::bigint as instruction_chars, sha256(r) as response_hash from pairs")
def record_round_trip(spark, d):
    """Records to the layout at rest and back."""
    from loamsift.schema import compat, from_compat

    r = from_compat(compat(pair_records(spark, d), seq=True))
    return r.select(F.col("_seq").alias("seq"), F.length(INSTRUCTION).cast("long").alias("instruction_chars"), F.sha2(RESPONSE, 256).alias("response_hash"))


CHAIN = [BOUNDS, filters.Canary(PHRASES[:3])]
FOUND3 = "case " + " ".join(f"when contains(i || chr(10) || r, '{p}') then '{p}'" for p in PHRASES[:3]) + " end"


@query(
    f"""with {PAIRS}, x as (select {REASON} as a, {FOUND3} as b from pairs)
select case when a is not null then '02a_length_filter' else '02g_canary_filter' end as stage, coalesce(a, 'canary_leak') as reason, count(*) as n_rows from x where a is not null or b is not null group by all"""
)
def drop_reason_rollup(spark, d):
    _, gone = filters.chain(pair_records(spark, d), CHAIN)
    return aggregates.drop_reasons(gone[0].unionByName(gone[1]))


@query(
    f"""with {PAIRS}, x as (select {REASON} as a, {FOUND3} as b from pairs)
select 0 as stage_idx, '02a_length_filter' as stage, count(*) as count_in, count(*) filter (a is null) as count_out, count(a) as dropped_count from x
union all select 1, '02g_canary_filter', count(*), count(*) filter (b is null), count(b) from x where a is null"""
)
def stage_yields(spark, d):
    first = CHAIN[0].transform(pair_records(spark, d), Context())
    second = CHAIN[1].transform(first.kept, Context())
    return aggregates.stage_yields([(CHAIN[0].name, first.kept, first.dropped), (CHAIN[1].name, second.kept, second.dropped)])


def critic(messages):
    body = messages[-1]["content"]
    yes = int(hashlib.sha256(body.encode()).hexdigest()[:4], 16) % 10 < 7
    return json.dumps({"verdict": "yes" if yes else "no", "reason": "by hash"})


def _critic_sql(question: str) -> str:
    body = f"'Instruction:' || chr(10) || i || chr(10) || chr(10) || 'Response:' || chr(10) || r || chr(10) || chr(10) || '{question} Answer in JSON: {{\"verdict\": \"yes\" or \"no\", \"reason\": text}}.'"
    return f"(('0x' || substr(sha256({body}), 1, 4))::bigint % 10 < 7)"


@query(f"with {PAIRS} select seq, {_critic_sql('Is the response right and useful for the instruction?')} and not {_critic_sql('Is there anything wrong, unsafe or missing in the response?')} as kept from pairs")
def double_critic(spark, d):
    out = scoring.DoubleCritic().transform(pair_records(spark, d), Context(model=FakeModel(critic), hold=sinks.held))
    row = lambda df, kept: df.select(F.col("_seq").alias("seq"), F.lit(kept).alias("kept"))
    return row(out.kept, True).unionAll(row(out.dropped, False))


UNIT = "('0x' || substr(sha256({0}), 1, 12))::bigint / 281474976710656.0"


def _lp(prompt: str) -> str:
    return f"round(list_avg(list_transform(ws, lambda w: -round({UNIT.format(prompt + ' || chr(31) || w')}, 6))), 6)"


@query(
    f"""with {PAIRS}, t as (select seq, i, list_filter(regexp_split_to_array(r, '{W}+'), lambda y: y <> '') as ws from pairs), x as (select seq, round({_lp('i')} - {_lp("''")}, 4) as ifd from t)
select seq, ifd, coalesce(ifd >= 0.05, true) as kept from x"""
)
def ifd_filter(spark, d):
    out = scoring.Ifd(0.05).transform(pair_records(spark, d), Context(model=FakeModel(), hold=sinks.held))
    row = lambda df, kept: df.select(F.col("_seq").alias("seq"), F.col("scores.ifd").alias("ifd"), F.lit(kept).alias("kept"))
    return row(out.kept, True).unionAll(row(out.dropped, False))


def reward(messages):
    return str(int(unit(messages[0]["content"] + "\x1f" + messages[1]["content"]) * 1000) / 1000)


@query(f"with {PAIRS}, x as (select seq, floor({UNIT.format('i || chr(31) || r')} * 1000) / 1000 as reward from pairs) select seq, reward, reward >= 0.4 as kept from x")
def reward_filter(spark, d):
    out = scoring.RewardScore(0.4).transform(pair_records(spark, d), Context(model=FakeModel(reward), hold=sinks.held))
    row = lambda df, kept: df.select(F.col("_seq").alias("seq"), F.col("scores.reward_model").alias("reward"), F.lit(kept).alias("kept"))
    return row(out.kept, True).unionAll(row(out.dropped, False))


TREE = {"factors": [{"name": "origin", "root": {"name": "all", "children": [{"name": x, "children": [{"name": f"src{k}"} for k in range(40)]} for x in ("en", "de", "fr", "es", "it")]}}]}


@query(
    """with t as (select 1 as depth, unnest(['en', 'de', 'fr', 'es', 'it']) as node union all select 2, 'src' || unnest(generate_series(0, 39))),
s as (select 1 as depth, lang as node from documents union select 2, source from documents where lang in ('en', 'de', 'fr', 'es', 'it'))
select 'origin' as factor, t.depth, count(s.node) as covered, count(*) as total, round(count(s.node)::double / count(*), 6) as ratio from t left join s on s.depth = t.depth and s.node = t.node group by t.depth"""
)
def taxonomy_coverage(spark, d):
    rows = table(spark, d, "documents").select(F.create_map(F.lit("origin"), F.array("lang", "source")).alias("nodes"))
    per, _ = tax.coverage(rows, tax.edges(spark, tax.check_bundle(TREE)))
    return per.select("factor", "depth", "covered", "total", "ratio")


def _ranked(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 97).alias("batch"), F.col("o_custkey").cast("string").alias("c"), F.col("o_totalprice").alias("p"))
    best = o.groupBy("batch", "c").agg(F.max("p").alias("p"))
    top = best.groupBy("batch").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "c"))), 1, 5).alias("t"))
    return top.select("batch", F.transform("t", lambda x: x["c"]).alias("ranked"))


@query(
    """with b as (select o_orderkey % 97 as batch, o_custkey::varchar as c, max(o_totalprice) as p from orders group by 1, 2), r as (select batch, c, row_number() over (partition by batch order by p desc, c) - 1 as k from b)
select x.batch, x.k::int as i, y.k::int as j, x.c as winner, y.c as loser from r x join r y on x.batch = y.batch and x.k < y.k where y.k < 5"""
)
def elo_pairs(spark, d):
    return aggregates.pairs_of_ranked(_ranked(spark, d), "batch", "ranked")


@query(
    """with recursive b as (select o_orderkey % 97 as batch, o_custkey::varchar as c, max(o_totalprice) as p from orders group by 1, 2), r as (select batch, c, row_number() over (partition by batch order by p desc, c) - 1 as k from b),
g as (select x.c as w, y.c as l, row_number() over (order by x.batch, x.k, y.k) as n from r x join r y on x.batch = y.batch and x.k < y.k where y.k < 5),
f as (select 0::bigint as n, map_from_entries((select list({'k': c, 'v': 400.0::double}) from (select w as c from g union select l from g))) as e
  union all select n, map_concat(e, map([w, l], [a + d, b - d])) as e from (select *, 32.0 * (1 - 1 / (1 + pow(10::double, (b - a) / 400))) as d from (select g.n, g.w, g.l, f.e, f.e[g.w] as a, f.e[g.l] as b from f join g on g.n = f.n + 1))),
z as (select unnest(map_entries(e)) as x from f where n = (select max(n) from f))
select x.key as id, round(x.value, 2) as elo from z"""
)
def elo_ratings(spark, d):
    return aggregates.elo_fold(elo_pairs(spark, d))


ELO_PAIR = "o as (select o_orderkey, 1000.0::double + o_orderkey % 700 as a, 1000.0::double + o_custkey % 700 as b, (o_orderkey % 3) / 2.0::double as score from orders)"


@query(f"with {ELO_PAIR} select o_orderkey, round(a + 32 * (score - 1 / (1 + pow(10, (b - a) / 400))), 6) as a_new, round(b + 32 * (1 - score - 1 / (1 + pow(10, (a - b) / 400))), 6) as b_new from o")
def elo_update(spark, d):
    """Wins, draws and losses between ratings of every distance, on every order."""
    base = lambda c: F.lit(1000.0) + F.col(c) % 700
    o = table(spark, d, "orders").select("o_orderkey", base("o_orderkey").alias("a"), base("o_custkey").alias("b"), ((F.col("o_orderkey") % 3) / F.lit(2.0)).alias("score"))
    a, b, won = F.col("a"), F.col("b"), F.col("score")
    return o.select("o_orderkey", F.round(X.elo_updated(a, b, won), 6).alias("a_new"), F.round(X.elo_updated(b, a, 1 - won), 6).alias("b_new"))


@query("select lang, count(*) as n, min(length(text)) as min_chars, max(length(text)) as max_chars, round(avg(length(text)), 4) as mean_chars, median(length(text)) as median_chars from documents group by lang")
def text_stats(spark, d):
    s = aggregates.text_stats(table(spark, d, "documents"), F.col("text"), "lang")
    return s.select("lang", "n", F.col("min_chars").cast("long").alias("min_chars"), F.col("max_chars").cast("long").alias("max_chars"), "mean_chars", "median_chars")


@query(
    r"""with t as (select event_id, case event_id % 3 when 0 then 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' when 1 then 'It is ' || props || ' as asked' else '```json' || props end as t from events)
select event_id, case when event_id % 3 = 2 then null else sha256(props) end as part from t join events using (event_id)"""
)
def json_extraction(spark, d):
    e = table(spark, d, "events")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("It is "), "props", F.lit(" as asked"))).otherwise(F.concat(F.lit("```json"), "props"))
    return e.select("event_id", F.sha2(X.json_part(t), 256).alias("part"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n_events, round(sum(value), 2) as total_value from events group by all")
def event_windows(spark, d):
    return streams.windowed(table(spark, d, "events"))


@query(f"with {PAIRS} select seq, 'HELLO ' || sha256(r) as response, 1 as round from pairs")
def transform_generator(spark, d):
    hello = FakeModel(lambda m: "HELLO " + hashlib.sha256(m[-1]["content"].encode()).hexdigest())
    out = generate.TransformGenerator().transform(pair_records(spark, d), Context(model=hello, hold=sinks.held))
    return out.kept.select(F.col("_seq").alias("seq"), F.col(RESPONSE).alias("response"), "lineage.round")


@query()
def evol_round(spark, d):
    deeper = FakeModel(lambda m: f"Compare {hashlib.sha256(m[-1]['content'].encode()).hexdigest()} with its neighbours and give two reasons")
    out = generate.EvolRound(1, 2).transform(pair_records(spark, d), Context(model=deeper, hold=sinks.held))
    return out.kept.select("_seq", INSTRUCTION, F.col("lineage.operator").alias("operator"))
