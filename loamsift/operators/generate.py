"""Generators: from prompts, by rewriting a field, by evolving instructions, from a taxonomy; and Elo by ranked batches."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.functions import text as X
from loamsift.models import ask, message, messages
from loamsift.operators.aggregates import elo_fold, pairs_of_ranked
from loamsift.operators.base import Context, Stage, StageOutput, split
from loamsift.operators.filters import evol_reason
from loamsift.operators.scoring import scored
from loamsift.schema import CONV, INSTRUCTION, LINEAGE, RESPONSE, SOURCE, as_records, conversation, fields, hashed, is_conversation, with_event

TEMPLATE = "Write one new instruction and a strong response in the spirit of this example, but not a copy.\nAnswer in JSON with the keys instruction and response.\n\nInstruction:\n{seed_instruction}\n\nResponse:\n{seed_response}\n"
CHUNK_TEMPLATE = "Write one instruction that the passage below answers, and its response, from the passage alone.\nAnswer in JSON with the keys instruction and response.\n\nPassage:\n{chunk}\n"
EVOL = {
    "add_constraints": "Add one or two concrete constraints that an answer has to meet.",
    "deepen": "Ask for more depth: finer detail, expert knowledge or harder judgement.",
    "increase_reasoning_steps": "Make an answer need several explicit steps or comparisons.",
    "breadth_mutation": "Write an instruction on another side of the same general subject.",
    "complexify": "Make the task harder along one axis, with the same kind of task, subject and output format.",
}


def seed_plan(seeds: DataFrame, target: int) -> DataFrame:
    """plan_index 0 .. target - 1, each with the seed at plan_index modulo their number."""
    ranked = seeds.where(F.col("record_type").isNotNull())
    n = ranked.count()
    if not n or target <= 0:
        return seeds.limit(0).withColumn("plan_index", F.lit(0).cast("long"))
    from loamsift.sources.readers import numbered

    at = numbered(ranked.withColumnRenamed("_seq", "_seed_seq").repartitionByRange("_seed_seq").sortWithinPartitions("_seed_seq")).withColumnRenamed("_seq", "_k").withColumnRenamed("_seed_seq", "_seq")
    plan = seeds.sparkSession.range(target).select(F.col("id").alias("plan_index"), (F.col("id") % n).alias("_at"))
    return plan.join(at, F.col("_at") == F.col("_k")).drop("_at", "_k")


def children(plan: DataFrame, pair: Column, operator: Column, stage: str, round_: Column, depth: Column) -> DataFrame:
    """Records of generated pairs, with their parent's lineage."""
    rows = plan.withColumn("_pair", pair).withColumn("_parent", F.col("id")).withColumn("_root", F.coalesce("lineage.root_id", "id"))
    rows = rows.withColumn("lineage", fields(LINEAGE, root_id=F.col("_root"), parent_ids=F.array("_parent"), operator=operator, round=round_, depth=depth))
    rows = rows.withColumn("payload", conversation(F.col("_pair.instruction"), F.col("_pair.response"))).withColumn("record_type", F.lit(CONV))
    rows = rows.withColumn("source", fields(SOURCE, type=F.lit("generated"), source_hash=F.col("content_hash"))).withColumn("scores", F.lit(None)).withColumn("stage_events", F.lit(None))
    return with_event(as_records(hashed(rows)), stage, "generated")


@dataclass
class PromptGenerator(Stage):
    """Seeds in turn, target x multiplier prompts, strict JSON answers; seeds whose answer doesn't parse are dropped rows."""

    target_count: int = 1
    generation_multiplier: int = 1
    prompt_template: str = TEMPLATE
    done: DataFrame | None = None  # answers of a stopped run: plan_index, text
    name: str = "02_generate"
    action: str = "generated"

    def prompt(self) -> Column:
        whole = X.fill(self.prompt_template, seed_instruction=F.col(INSTRUCTION), seed_response=F.col(RESPONSE))
        return F.when(is_conversation(), whole).otherwise(X.fill(CHUNK_TEMPLATE, chunk=F.col("payload.chunk.text")))

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        plan = seed_plan(df, self.target_count * self.generation_multiplier)
        todo = plan.join(self.done.select("plan_index"), "plan_index", "left_anti") if self.done is not None else plan
        answers = todo.select("plan_index", ask(ctx.model, messages(message("user", self.prompt())))["text"].alias("text"))
        raw = ctx.held(answers if self.done is None else answers.unionByName(self.done.select("plan_index", "text")))
        both = plan.join(raw, "plan_index").withColumn("_seq", F.col("plan_index"))
        pair = X.pair_of_json(F.col("text"))
        made = children(both.withColumn("_p", pair).where("_p is not null"), F.col("_p"), F.lit("prompt_based"), self.name, F.lit(1), F.lit(1))
        failed = with_event(as_records(both.withColumn("_p", pair).where("_p is null")), self.name, "dropped", F.lit("generator_parse_failure"))
        return StageOutput(made, failed, {"raw": raw})


@dataclass
class TransformGenerator(Stage):
    """Rewrites one field of each conversation; the original may be kept as JSON in the system field."""

    input_field: str = "payload.response"
    output_field: str = "payload.response"
    prompt_template: str = "{value}"
    preserve_original: bool = False
    name: str = "02_transform_generate"
    action: str = "generated"

    def __post_init__(self) -> None:
        for f in (self.input_field, self.output_field):
            if f not in ("payload.instruction", "payload.response", "payload.system"):
                raise ValueError(f"no such field: {f}")

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        source, target = (f.replace("payload.", "payload.conversation.") for f in (self.input_field, self.output_field))
        body = X.fill(self.prompt_template, value=F.col(source), seed_instruction=F.col(INSTRUCTION), seed_response=F.col(RESPONSE))
        out = ctx.held(df.withColumn("_answer", F.when(is_conversation(), ask(ctx.model, messages(message("user", body))))))
        good = is_conversation() & F.col("_answer.text").isNotNull()
        inner = F.col("payload.conversation")
        if self.preserve_original:
            inner = inner.withField("system", F.to_json(F.struct(F.col(INSTRUCTION).alias("instruction"), F.col(RESPONSE).alias("response"), F.col("payload.conversation.system").alias("system"))))
        inner = inner.withField(target.rpartition(".")[2], X.strip(F.col("_answer.text")))
        line = F.col("lineage")
        new_line = fields(LINEAGE, root_id=F.coalesce(line["root_id"], F.col("id")), parent_ids=F.array("id"), operator=F.lit("transform"), round=F.coalesce(line["round"], F.lit(0)) + 1, depth=F.coalesce(line["depth"], F.lit(0)) + 1)
        made = out.where(good).withColumn("lineage", new_line).withColumn("payload", F.col("payload").withField("conversation", inner))
        made = with_event(as_records(hashed(made)), self.name, "generated")
        failed = with_event(as_records(out.where(is_conversation() & F.col("_answer.text").isNull())), self.name, "dropped", F.lit("generator_call_failure"))
        return StageOutput(made.unionByName(as_records(out.where(~is_conversation()))), failed)


@dataclass
class EvolRound(Stage):
    """One round: each row of the frontier branches, each branch rewritten by the next operator in turn, then answered."""

    round: int = 1
    branching_factor: int = 1
    operators: list[str] = field(default_factory=lambda: list(EVOL))
    min_edit_distance_chars: int = 20
    min_instruction_chars: int = 20
    refusal_keywords: tuple[str, ...] = ("I cannot", "I'm unable", "As an AI")
    action: str = "generated"

    def __post_init__(self) -> None:
        unknown = sorted(set(self.operators) - set(EVOL))
        if unknown or not self.operators or self.branching_factor < 1 or self.round < 1:
            raise ValueError(f"unknown or missing operators, or counts below 1: {unknown}")
        self.name = f"{self.round + 2:02d}_evol_round_{self.round:02d}"

    def frontier(self, df: DataFrame) -> DataFrame:
        evolved = F.coalesce(F.col("source.type"), F.lit("")) == "evolved"
        return df.where(is_conversation() & (~evolved if self.round == 1 else evolved & (F.col("lineage.round") == self.round - 1)))

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        from loamsift.sources.readers import numbered

        front = numbered(self.frontier(df).withColumnRenamed("_seq", "_old"), "_old").withColumnRenamed("_seq", "_pos")
        branches = front.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.branching_factor - 1))).alias("_branch"))
        turn = (F.col("_pos") * self.branching_factor + F.col("_branch")) % len(self.operators)
        branches = branches.withColumn("_op", F.element_at(F.array(*[F.lit(o) for o in self.operators]), (turn + 1).cast("int")))
        how = F.element_at(F.create_map(*[F.lit(x) for kv in EVOL.items() for x in kv]), F.col("_op"))
        first = F.concat(how, F.lit("\nAnswer with the new instruction only.\n\nInstruction:\n"), F.col(INSTRUCTION))
        asked = ctx.held(branches.withColumn("_new", ask(ctx.model, messages(message("user", first)))))
        asked = asked.withColumn("_child", X.strip(F.col("_new.text")))
        bad = evol_reason(F.col("_child"), F.col(INSTRUCTION), self.min_edit_distance_chars, self.min_instruction_chars, self.refusal_keywords)
        asked = asked.withColumn("_why", F.when(F.col("_child").isNull(), "evol_parse_failure").otherwise(bad))
        good = ctx.held(asked.where("_why is null").withColumn("_reply", ask(ctx.model, messages(message("user", F.col("_child"))))["text"]))
        reply = F.col("_reply")
        pair = F.struct(F.col("_child").alias("instruction"), X.strip(reply).alias("response"))
        made = good.where(F.length(X.strip(reply)) > 0).withColumn("_seq", F.col("_old"))
        made = children(made, pair, F.concat(F.lit("evol:"), "_op"), self.name, F.lit(self.round), F.coalesce("lineage.depth", F.lit(0)) + 1)
        made = made.withColumn("source", F.col("source").withField("type", F.lit("evolved")))
        top = df.agg(F.coalesce(F.max("_seq"), F.lit(-1)).alias("m")).first()["m"]
        made = numbered(made.withColumnRenamed("_seq", "_s"), "_s", "id").drop("_s").withColumn("_seq", F.col("_seq") + F.lit(top + 1))
        lost = asked.where("_why is not null").unionByName(good.where(reply.isNull() | (F.length(X.strip(reply)) == 0)).drop("_reply").withColumn("_why", F.lit("evol_parse_failure")))
        gone = with_event(lost.withColumn("_seq", F.col("_old")), self.name, "dropped", F.col("_why"), F.concat(F.lit("operator="), "_op"))
        return StageOutput(df.unionByName(as_records(made)), as_records(gone))


def taxonomy_plan(bundle: dict, target: int, seed: int = 0) -> list[tuple[int, str, dict[str, list[str]]]]:
    """(plan_index, strategy, factor -> path): an even budget per strategy, the remainder to the first, a leaf path per factor."""
    rng = random.Random(seed)
    strategies = bundle["strategies"]
    share = max(1, target // len(strategies))
    budget = [share] * len(strategies)
    budget[0] += target - share * len(strategies)
    paths = {f["name"]: leaf_paths(f["root"]) for f in bundle["factors"]}
    out = []
    for s, n in zip(strategies, budget):
        for _ in range(max(0, n)):
            out.append((len(out), s["name"], {f: rng.choice(paths[f]) for f in s["include_factors"]}))
    return out


def leaf_paths(node: dict, above: tuple[str, ...] = ()) -> list[list[str]]:
    """Paths to the leaves below a root; the root's own name isn't part of them."""
    kids = node.get("children") or []
    if not kids:
        return [list(above)]
    return [p for c in kids for p in leaf_paths(c, (*above, c["name"]))]


@dataclass
class TaxonomyGenerator(Stage):
    bundle: dict = field(default_factory=dict)
    target_count: int = 1
    generation_multiplier: int = 1
    seed: int = 0
    name: str = "02_generate"
    action: str = "generated"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        target = self.target_count * self.generation_multiplier
        if target <= 0:
            return StageOutput(df)
        plan = df.sparkSession.createDataFrame(taxonomy_plan(self.bundle, target, self.seed), "plan_index long, strategy string, nodes map<string,array<string>>")
        bullets = F.array_join(F.transform(F.map_entries("nodes"), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), F.when(F.size(e["value"]) == 0, "(root)").otherwise(F.array_join(e["value"], " / ")))), "\n")
        body = F.concat(F.lit("Write one instruction and its response with exactly these attributes:\n"), bullets, F.lit("\nAnswer in JSON with the keys instruction and response.\n"))
        raw = ctx.held(plan.withColumn("text", ask(ctx.model, messages(message("user", body)))["text"])).withColumn("_p", X.pair_of_json(F.col("text")))
        top = df.agg(F.coalesce(F.max("_seq"), F.lit(-1)).alias("m")).first()["m"]
        made = raw.where("_p is not null").withColumn("_seq", F.col("plan_index") + F.lit(top + 1)).withColumn("record_type", F.lit(CONV))
        made = made.withColumn("payload", conversation(F.col("_p.instruction"), F.col("_p.response")))
        made = made.withColumn("id", F.concat(F.lit("tax-"), F.substring(F.sha2(F.concat(F.to_json("nodes"), F.col("_p.instruction")), 256), 1, 16)))
        made = made.withColumn("content_hash", F.sha2(F.concat_ws("\n", "_p.instruction", "_p.response"), 256)).withColumn("config_hash", F.lit("taxonomy"))
        made = made.withColumn("source", fields(SOURCE, type=F.lit("taxonomy"))).withColumn("lineage", fields(LINEAGE, root_id=F.col("id"), parent_ids=F.array().cast("array<string>"), operator=F.concat(F.lit("taxonomy:"), "strategy"), round=F.lit(1), depth=F.lit(1)))
        nodes = F.col("nodes")
        made = with_event(as_records(scored(as_records(made).join(raw.select(F.col("plan_index").alias("_pi"), nodes), F.col("_seq") == F.col("_pi") + F.lit(top + 1)), taxonomy_nodes=nodes)), self.name, "generated")
        return StageOutput(df.unionByName(made), None, {"raw": raw.drop("_p")})


def elo_deck(ids: list[str], samples: int = 4, size: int = 5, seed: int = 0) -> list[tuple[int, list[str]]]:
    """Batches of ids: each id ``samples`` times, shuffled, cut, repeats inside a batch dropped, batches of one dropped."""
    deck = [i for i in ids for _ in range(samples)]
    random.Random(seed).shuffle(deck)
    batches = [list(dict.fromkeys(deck[k : k + size])) for k in range(0, len(deck), size)]
    return [(n, b) for n, b in enumerate(x for x in batches if len(x) >= 2)]


@dataclass
class ComplexityElo(Stage):
    """Batches are ranked by the model; every ordered pair of a batch is a game; ratings start at 400."""

    batch_size: int = 5
    samples_per_record: int = 4
    k_factor: float = 32.0
    name: str = "02s_complexity_elo"
    action: str = "scored"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        spark = df.sparkSession
        ids = [r.id for r in df.where(is_conversation()).select("_seq", "id").orderBy("_seq").select("id").toLocalIterator()]
        deck = spark.createDataFrame(elo_deck(ids, self.samples_per_record, self.batch_size), "batch long, ids array<string>")
        text = df.where(is_conversation()).groupBy(F.col("id").alias("_id")).agg(F.min_by(INSTRUCTION, "_seq").alias("_text"))
        cards = deck.select("batch", F.posexplode("ids").alias("pos", "_id")).join(text, "_id")
        line = F.concat(F.col("_id"), F.lit(": "), F.substring("_text", 1, 600))
        body = cards.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("_b"))
        prompt = F.concat(F.lit('Rank these tasks from the most to the least complex. Answer in JSON: {"ranking": [ids]}.\n'), "_b")
        asked = ctx.held(body.withColumn("_a", ask(ctx.model, messages(message("user", prompt)))["text"]))
        ranking = F.from_json(X.json_part(F.col("_a")), "struct<ranking:array<string>>")["ranking"]
        ranked = asked.join(deck, "batch").withColumn("ranked", F.array_distinct(F.filter(F.coalesce(ranking, F.array().cast("array<string>")), lambda x: F.array_contains("ids", x))))
        pairs = pairs_of_ranked(ranked.select("batch", "ranked"), "batch", "ranked")
        rating = elo_fold(pairs, k=self.k_factor).select(F.col("id").alias("_r"), "elo")
        out = df.join(rating, F.col("id") == F.col("_r"), "left")
        out = scored(out, complexity_elo=F.when(is_conversation(), F.coalesce("elo", F.lit(400.0))).otherwise(F.col("scores.complexity_elo")))
        return StageOutput(out.drop("_r", "elo"), None, {"pairs": pairs})
