"""More queries: sources and sinks through files, model-backed stages, embeddings and near dedup at its defaults."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from loamsift.catalog import BOUNDS, PAIRS, REASON, STRIP, TREE, UNIT, document_records, pair_records, pair_rows, query, table
from loamsift.functions import text as X
from loamsift.models import FakeModel
from loamsift.operators import aggregates, dedup, filters, generate, scoring, similarity
from loamsift.operators import taxonomy as tax
from loamsift.operators.base import Context
from loamsift.plans import evaluate
from loamsift.schema import INSTRUCTION, RESPONSE, SOURCE, fields
from loamsift.sources import readers, sinks


def quoted(text: str) -> str:
    """An SQL string, line feeds spelt out."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# ---- files
def _seeds(spark, d):
    """Pairs as seed rows, every seventh without a response."""
    p = pair_rows(spark, d)
    return p.select("instruction", F.when((F.col("conv_id") * 1000 + F.col("turn")) % 7 == 0, F.lit("  ")).otherwise(F.col("response")).alias("response"))


def _read(spark, path):
    good, bad = readers.read_seeds(spark, path)
    row = lambda df, i, r, why: df.select(F.sha2(i, 256).alias("instruction"), F.sha2(r, 256).alias("response"), why.alias("reason"))
    return row(good, F.col(INSTRUCTION), F.col(RESPONSE), F.lit(None).cast("string")).unionAll(row(bad, X.strip(F.col("instruction")), F.lit(None).cast("string"), F.col("reason")))


SEEDS = f"""with {PAIRS} select sha256(i) as instruction, case when seq % 7 <> 0 and length(i) > 0 and length(r) > 0 then sha256(r) end as response,
case when length(i) = 0 then 'instruction_missing' when seq % 7 = 0 or length(r) = 0 then 'response_missing' end as reason from pairs"""


@query(SEEDS)
def seeds_jsonl(spark, d):
    path = f"{sinks.scratch(spark)}/seeds.jsonl"
    _seeds(spark, d).select(F.to_json(F.struct("instruction", "response")).alias("value")).write.text(path)
    return _read(spark, path)


@query(SEEDS)
def seeds_csv(spark, d):
    path = f"{sinks.scratch(spark)}/seeds.csv"
    how = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _seeds(spark, d).write.options(**how).csv(path)
    return _read(spark, path)


@query(f"with {PAIRS} select seq, sha256(i) as instruction, sha256(r) as response from pairs")
def export_jsonl(spark, d):
    """Written in order of _seq, read again by place in the files."""
    path = f"{sinks.scratch(spark)}/data"
    rows = pair_records(spark, d)
    sinks.export(rows, path, "jsonl")
    m = F.from_json("value", "struct<instruction:string,response:string>")
    back = readers.numbered(spark.read.text(path)).select("_seq", m.alias("m"))
    seqs = readers.numbered(rows.select(F.col("_seq").alias("seq")), "seq")
    return seqs.join(back, "_seq").select("seq", F.sha2("m.instruction", 256).alias("instruction"), F.sha2("m.response", 256).alias("response"))


@query(f"with {PAIRS}, t as (select 'user: ' || i || chr(10) || 'assistant: ' || r as t from pairs union all select i || chr(10) as t from pairs union all select '{{\"other\":' || seq || '}}' from pairs) select sha256(t) as text, count(*) as n from t group by t")
def export_texts(spark, d):
    """Readable texts of exported chats, of lines with an empty response, and of lines that hold neither."""
    rows = pair_records(spark, d)
    half = F.to_json(F.struct(F.col(INSTRUCTION).alias("instruction"), F.lit("").alias("response")))
    lines = rows.select(F.explode(F.array(sinks.line_chatml(), half, F.to_json(F.struct(F.col("_seq").alias("other"))))).alias("value"))
    return lines.select(F.sha2(evaluate.export_text(F.col("value")), 256).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


@query(f"with {PAIRS} select seq, {REASON} as reason, sha256(r) as response from pairs")
def stage_artifacts(spark, d):
    """A stage's data and dropped tables, written and read again."""
    folder = f"{sinks.scratch(spark)}/stage"
    out = BOUNDS.transform(pair_records(spark, d), Context())
    sinks.write_stage(out.kept, folder, out.dropped)
    kept = readers.read_stage(spark, f"{folder}/data").select(F.col("_seq").alias("seq"), F.lit(None).cast("string").alias("reason"), F.sha2(RESPONSE, 256).alias("response"))
    gone = spark.read.parquet(f"{folder}/dropped").where("drop_stage = '02a_length_filter'")
    return kept.unionAll(gone.select(F.col("id").cast("long"), "drop_reason", F.sha2(F.get_json_object("payload_json", "$.response"), 256)))


@query("select event_id::int as plan_index, 's' || user_id as seed_id, sha256(props) as generated, (event_id % 50)::int as total_tokens, case when event_id % 3 = 0 then 0.25 end::double as cost_usd from events where event_id is not null")
def raw_responses(spark, d):
    path = f"{sinks.scratch(spark)}/raw.jsonl"
    usage = F.struct((F.col("event_id") % 50).cast("int").alias("total_tokens"), F.when(F.col("event_id") % 3 == 0, F.lit(0.25)).alias("cost_usd"))
    row = F.struct(F.col("event_id").cast("int").alias("plan_index"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("seed_id"), F.col("props").alias("generated_text"), usage.alias("usage"))
    table(spark, d, "events").select(F.to_json(row).alias("value")).write.text(path)
    return readers.read_raw_responses(spark, path).select("plan_index", "seed_id", F.sha2("generated_text", 256).alias("generated"), "usage.total_tokens", "usage.cost_usd")


@query(f"with {PAIRS} select seq, sha256(i) as instruction, sha256(r) as response, sha256('{{\"instruction\":' || to_json(i)::varchar || ',\"response\":' || to_json(' ' || r || chr(10))::varchar || '}}') as content_hash from pairs")
def normalise(spark, d):
    """Stripped pairs keep the content hash of what came in."""
    from loamsift.schema import CONV, as_records, conversation, hashed

    p = pair_rows(spark, d).withColumn("_seq", F.col("conv_id") * 1000 + F.col("turn")).withColumn("record_type", F.lit(CONV)).withColumn("lineage", F.lit(None))
    p = as_records(hashed(p.withColumn("payload", conversation(F.col("instruction"), F.concat(F.lit(" "), "response", F.lit("\n"))))))
    out = filters.Normalise().transform(p, Context()).kept
    return out.select(F.col("_seq").alias("seq"), F.sha2(INSTRUCTION, 256).alias("instruction"), F.sha2(RESPONSE, 256).alias("response"), "content_hash")


# ---- models
RUBRIC = {
    "version": "2", "description": "pairs", "overall_weights": {"help": 0.6, "truth": 0.4}, "hash": "r",
    "dimensions": [{"name": n, "scale_min": 1, "scale_max": 5, "description": "", "criteria": ""} for n in ("help", "truth")],
}


def judge(messages):
    h = int(hashlib.sha256(messages[-1]["content"].encode()).hexdigest()[:4], 16)
    return "I would rather not" if h % 11 == 0 else f"Here: ```json\n{json.dumps({'scores': {'help': h % 5 + 1, 'truth': h // 5 % 5 + 1}, 'reasoning': 'by hash'})}\n```"


JUDGED = f"""with {PAIRS}, h as (select seq, ('0x' || substr(sha256('Instruction:' || chr(10) || i || chr(10) || chr(10) || 'Response:' || chr(10) || r), 1, 4))::bigint as h from pairs),
o as (select seq, h, case when h % 11 <> 0 then round((h % 5 + 1) * 0.6::double + (h // 5 % 5 + 1) * 0.4::double, 4) end as overall from h)"""


@query(f"{JUDGED} select seq, overall, case when overall is null then 'label_parse_failure' when overall < 3 then 'low_quality_score' end as reason from o")
def label_quality(spark, d):
    out = scoring.LabelQuality(RUBRIC, 3.0).transform(pair_records(spark, d), Context(model=FakeModel(judge), hold=sinks.held))
    row = lambda df, why: df.select(F.col("_seq").alias("seq"), F.col("scores.quality").alias("overall"), why.alias("reason"))
    return row(out.kept, F.lit(None).cast("string")).unionAll(row(out.dropped, F.element_at("stage_events", -1)["reason_code"]))


@query(f"{JUDGED} select seq, overall, case when overall is not null then (h % 5 + 1)::double end as help, case when overall is not null then '2' end as version from o")
def label_score(spark, d):
    out = scoring.LabelScore(RUBRIC).transform(pair_records(spark, d), Context(model=FakeModel(judge), hold=sinks.held)).kept
    return out.select(F.col("_seq").alias("seq"), F.col("scores.quality").alias("overall"), F.try_element_at("scores.dims", F.lit("help")).alias("help"), F.col("scores.rubric_version").alias("version"))


PROMPT = f"replace(replace({quoted(generate.TEMPLATE)}, '{{seed_instruction}}', i), '{{seed_response}}', r)"
PLAN = "n as (select *, row_number() over (order by seq) - 1 as k, count(*) over () as c from pairs), p as (select unnest(generate_series(0, 99)) as plan_index), b as (select p.plan_index, n.seq, " + PROMPT + " as body from p join n on n.k = p.plan_index % n.c)"
TOPIC = f"'Explain topic ' || floor({UNIT.format('body')} * 1000000)::bigint || ' step by step'"


@query(f"with {PAIRS}, {PLAN} select plan_index as seq, {TOPIC} as instruction, 'An answer about ' || floor({UNIT.format('reverse(body)')} * 1000000)::bigint || ' in some detail.' as response, seq::varchar as parent, 1 as depth from b")
def prompt_generator(spark, d):
    out = generate.PromptGenerator(50, 2).transform(pair_records(spark, d), Context(model=FakeModel(), hold=sinks.held))
    return out.kept.select(F.col("_seq").alias("seq"), F.col(INSTRUCTION).alias("instruction"), F.col(RESPONSE).alias("response"), F.col("lineage.parent_ids")[0].alias("parent"), "lineage.depth")


def careless(messages):
    h = hashlib.sha256(messages[-1]["content"].encode()).hexdigest()
    kind = int(h[:2], 16) % 4
    return {0: "no JSON", 1: json.dumps({"instruction": h, "response": "r", "more": 1}), 2: json.dumps({"instruction": h, "response": "  "})}.get(kind) or json.dumps({"instruction": f" {h} ", "response": "fine"})


@query(f"with {PAIRS}, {PLAN}, h as (select plan_index, sha256(body) as h from b) select plan_index as seq, case when ('0x' || h[:2])::bigint % 4 = 3 then h end as instruction, case when ('0x' || h[:2])::bigint % 4 < 3 then 'generator_parse_failure' end as reason from h")
def parse_failures(spark, d):
    out = generate.PromptGenerator(100, 1).transform(pair_records(spark, d), Context(model=FakeModel(careless), hold=sinks.held))
    kept = out.kept.select(F.col("_seq").alias("seq"), F.col(INSTRUCTION).alias("instruction"), F.lit(None).cast("string").alias("reason"))
    return kept.unionAll(out.dropped.select("_seq", F.lit(None).cast("string"), F.element_at("stage_events", -1)["reason_code"]))


TAXONOMY = ", ".join(f"({n}, ['{nodes['origin'][0]}', '{nodes['origin'][1]}'])" for n, _, nodes in generate.taxonomy_plan(tax.check_bundle(TREE), 40))


@query(
    f"""with t(n, path) as (values {TAXONOMY}), b as (select path, 'Write one instruction and its response with exactly these attributes:' || chr(10) || '  - origin: ' || array_to_string(path, ' / ') || chr(10) || 'Answer in JSON with the keys instruction and response.' || chr(10) as body from t),
i as (select path, {TOPIC} as instruction from b)
select 'tax-' || substr(sha256('{{"origin":["' || array_to_string(path, '","') || '"]}}' || instruction), 1, 16) as id, instruction, array_to_string(path, '/') as path from i"""
)
def taxonomy_generator(spark, d):
    out = generate.TaxonomyGenerator(tax.check_bundle(TREE), 40).transform(pair_records(spark, d), Context(model=FakeModel(), hold=sinks.held))
    return out.kept.where("source.type = 'taxonomy'").select("id", F.col(INSTRUCTION).alias("instruction"), F.array_join(F.col("scores.taxonomy_nodes").getItem("origin"), "/").alias("path"))


@query(
    """select event_id, case when event_id % 5 = 0 then event_type end as instruction, case when event_id % 5 = 0 then 'v' || event_id end as response from events"""
)
def strict_json(spark, d):
    """Only exactly two non-blank strings pass."""
    e = table(spark, d, "events")
    kind, name, value = F.col("event_id") % 5, F.col("event_type"), F.concat(F.lit("v"), F.col("event_id").cast("string"))
    whole = F.to_json(F.struct(F.concat(F.lit(" "), name).alias("instruction"), value.alias("response")))
    more = F.to_json(F.struct(name.alias("instruction"), value.alias("response"), name.alias("third")))
    t = F.when(kind == 0, F.concat(F.lit("Sure. "), whole)).when(kind == 1, more).when(kind == 2, F.to_json(F.struct(name.alias("instruction"), F.lit(" ").alias("response")))).when(kind == 3, F.to_json(F.struct(name.alias("instruction")))).otherwise(name)
    return e.select("event_id", X.pair_of_json(t).alias("p")).select("event_id", "p.instruction", "p.response")


# ---- vectors
class Letters:
    """Vectors of letter counts."""

    prefix = "letters:"
    letters = "aeinrstu"

    def column(self, text):
        return F.array(*[F.regexp_count(text, F.lit(c)).cast("double") for c in self.letters])


VECTOR = "list_transform(['" + "', '".join(Letters.letters) + "'], lambda c: (length({0}) - length(replace({0}, c, '')))::double)"


@query(
    f"""with {PAIRS}, v as (select seq, conv_id, {VECTOR.format("(i || chr(10) || r)")} as v from pairs), b as (select x.seq, max(list_cosine_similarity(x.v, y.v)) as best from v x, v y where x.conv_id % 4 <> 0 and y.conv_id % 4 = 0 group by x.seq)
select seq, case when best > 0.97 then 'high_semantic_similarity' end as reason from b"""
)
def semantic_filter(spark, d):
    rows = pair_records(spark, d)
    seed = (F.floor(F.col("_seq") / 1000) % 4) == 0
    made = rows.where(~seed).withColumn("source", fields(SOURCE, type=F.lit("generated")))
    out = similarity.SemanticSimilarity(0.97).transform(made, Context(embedder=Letters(), seeds=rows.where(seed), hold=sinks.held))
    row = lambda df, why: df.select(F.col("_seq").alias("seq"), why.alias("reason"))
    return row(out.kept, F.lit(None).cast("string")).unionAll(row(out.dropped, F.element_at("stage_events", -1)["reason_code"]))


@query(
    f"""with {PAIRS}, k as (select conv_id, 'letters:' || sha256(i) as cache_key, i from pairs), old as (select cache_key from k where conv_id % 2 = 0)
select cache_key, any_value({VECTOR.format('i')})[1] as first_value, count(*) as n_rows from k where cache_key not in (select cache_key from old) group by cache_key"""
)
def embedding_cache(spark, d):
    """What a half-filled cache lacks, embedded once a text."""
    rows = pair_rows(spark, d).select("conv_id", F.col("instruction").alias("text"))
    old = rows.where("conv_id % 2 = 0").select(F.concat(F.lit(Letters.prefix), F.sha2("text", 256)).alias("cache_key"), Letters().column(F.col("text")).alias("vector")).dropDuplicates(["cache_key"])
    every, fresh = similarity.cached_embeddings(rows, old, Letters())
    n = every.groupBy(F.col("cache_key").alias("k")).agg(F.count("*").alias("n_rows"))
    return fresh.join(n, F.col("cache_key") == F.col("k")).select("cache_key", F.col("vector")[0].alias("first_value"), "n_rows")


@query("select min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_samp(value), 6) as stdev from events")
def elo_distribution(spark, d):
    out = aggregates.elo_distribution(table(spark, d, "events"), F.col("value"))
    return out.select("min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")])


# ---- near dedup at its defaults
NEAR = r"""with recursive tk as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as t from documents),
sh as (select distinct doc_id, array_to_string(t[k:k + 4], ' ') as s from tk, unnest(generate_series(1, greatest(len(t) - 4, 1))) g(k) where len(t) > 0),
mh as (select doc_id, h, min(substr(sha256(h || ':' || s), 1, 16)) as m from sh, unnest(generate_series(0, 127)) g(h) group by doc_id, h),
sg as (select doc_id, list(m order by h) as sig from mh group by doc_id), nd as (select sig, min(doc_id) as node from sg group by sig),
bd as (select node, sig, b, sig[b * 8 + 1:(b + 1) * 8] as band from nd, unnest(generate_series(0, 15)) g(b)),
pr as (select distinct x.node as a, y.node as b, x.sig as sa, y.sig as sb from bd x join bd y on x.b = y.b and x.band = y.band and x.node < y.node),
e as (select a, b from pr where len(list_filter(list_zip(sa, sb), lambda z: z[1] = z[2])) >= 0.7 * 128),
q as (select b as node, list(a order by a) as near, row_number() over (order by b) as n from e group by b),
f as (select 0::bigint as n, [-1]::bigint[] as gone, [-1]::bigint[] as cites union all
  select q.n, case when len(k) > 0 then list_append(gone, q.node) else gone end, case when len(k) > 0 then list_append(cites, k[1]) else cites end
  from (select f.*, q.node, q.n as qn, list_filter(q.near, lambda x: not list_contains(f.gone, x)) as k from f join q on q.n = f.n + 1) j join q on q.n = j.qn),
z as (select gone, cites from f order by n desc limit 1), g as (select unnest(gone) as node, unnest(cites) as cite from z),
o as (select d.doc_id, case when sg.doc_id is null then null else coalesce(g.cite, nd.node) end as rep from documents d left join sg using (doc_id) left join nd using (sig) left join g on g.node = nd.node)"""


def _near(spark, d):
    rows = document_records(spark, d).repartition(spark.sparkContext.defaultParallelism)  # a table of one file is one task, and 128 digests a shingle keep that busy
    return dedup.NearDedup().transform(rows, Context(hold=sinks.held))


@query(f"{NEAR} select doc_id from o where rep is null or rep = doc_id")
def near_dedup_kept(spark, d):
    return _near(spark, d).kept.select(F.col("_seq").alias("doc_id"))


@query(f"{NEAR} select rep::varchar as representative_id, count(*) as member_count, string_agg(doc_id::varchar, ',' order by doc_id) as members from o where rep is not null group by rep having count(*) >= 2")
def near_clusters(spark, d):
    c = _near(spark, d).extras["clusters"]
    return c.select("representative_id", "member_count", F.array_join(F.from_json("member_ids_json", "array<string>"), ",").alias("members"))
