"""The record: one fixed, nested row type for every stage, and its provenance columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = "struct<type:string,doc_id:string,chunk_id:string,page_start:int,page_end:int,char_start:int,char_end:int,source_hash:string,seed_file_hash:string>"
LINEAGE = "struct<root_id:string,parent_ids:array<string>,operator:string,round:int,depth:int>"
CONVERSATION = "struct<instruction:string,response:string,system:string,turns:array<struct<role:string,content:string>>>"
CHUNK = "struct<text:string,doc_id:string,chunk_idx:int,page_start:int,page_end:int,char_start:int,char_end:int,word_count:int,chunk_strategy:string>"
CRITIC = "struct<yes_verdict:string,no_verdict:string,yes_reason:string,no_reason:string>"
SCORES = (
    f"struct<quality:double,dims:map<string,double>,double_critic:{CRITIC},taxonomy_nodes:map<string,array<string>>,complexity_elo:double,"
    "rubric_hash:string,rubric_version:string,judge_model:string,judge_prompt_hash:string,ifd:double,reward_model:double>"
)
EVENT = "struct<stage:string,action:string,reason_code:string,details:string,seq:int>"
COLUMNS = {
    "_seq": "bigint", "record_type": "string", "id": "string", "content_hash": "string", "source": SOURCE, "lineage": LINEAGE,
    "payload": f"struct<conversation:{CONVERSATION},chunk:{CHUNK}>", "scores": SCORES, "stage_events": f"array<{EVENT}>", "config_hash": "string", "created_at": "string",
}
CONV, GROUNDED = "ConversationRecord", "GroundedChunkRecord"

INSTRUCTION, RESPONSE = "payload.conversation.instruction", "payload.conversation.response"


def is_conversation() -> Column:
    return F.col("record_type") == CONV


def nulls(kind: str) -> Column:
    return F.lit(None).cast(kind)


def fields(kind: str, **given: Column) -> Column:
    """A struct of that type with the given fields; the others are null."""
    names = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(f"x {kind}")["x"].dataType.fields}
    return F.struct(*[(given[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def conversation(instruction: Column, response: Column, system: Column | None = None) -> Column:
    inner = fields(CONVERSATION, instruction=instruction, response=response, **({"system": system} if system is not None else {}))
    return F.struct(inner.alias("conversation"), nulls(CHUNK).alias("chunk"))


def payload_json() -> Column:
    """Compact JSON of the payload that is there, without nulls."""
    return F.when(is_conversation(), F.to_json("payload.conversation")).otherwise(F.to_json("payload.chunk"))


def hashed(df: DataFrame) -> DataFrame:
    """Content hash of the payload, and an id of payload and lineage together."""
    df = df.withColumn("content_hash", F.sha2(payload_json(), 256))
    return df.withColumn("id", F.sha2(F.concat_ws("\x1f", F.to_json("lineage"), payload_json()), 256))


def as_records(df: DataFrame) -> DataFrame:
    """Complete a frame to the record's columns, types and order; what is missing is null."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def with_event(df: DataFrame, stage: str, action: str, reason: Column | None = None, details: Column | None = None) -> DataFrame:
    """Append a stage event; events are numbered from 1."""
    so_far = F.coalesce("stage_events", F.array().cast(COLUMNS["stage_events"]))
    event = fields(EVENT, stage=F.lit(stage), action=F.lit(action), reason_code=reason if reason is not None else F.lit(None), details=details if details is not None else F.lit(None), seq=F.size(so_far) + 1)
    return df.withColumn("stage_events", F.concat(so_far, F.array(event)))


def compat(df: DataFrame, dropped: bool = False, seq: bool = False) -> DataFrame:
    """The layout at rest: ten string columns, nested parts as JSON; dropped rows carry their last event in three more."""
    out = [
        "record_type", "id", "content_hash", F.to_json("source").alias("source_json"), F.to_json("lineage").alias("lineage_json"), payload_json().alias("payload_json"),
        F.to_json("scores").alias("scores_json"), F.to_json("stage_events").alias("stage_events_json"), "config_hash", "created_at",
    ]
    if dropped:
        last = F.try_element_at("stage_events", F.lit(-1))
        out += [last["stage"].alias("drop_stage"), last["reason_code"].alias("drop_reason"), last["details"].alias("drop_detail")]
    return df.select(*(["_seq"] if seq else []), *out)


def from_compat(df: DataFrame) -> DataFrame:
    """Records from the layout at rest, in the order of ``_seq`` if it was kept."""
    conv, chunk = F.from_json("payload_json", CONVERSATION), F.from_json("payload_json", CHUNK)
    is_conv = F.col("record_type") == CONV
    return as_records(
        df.withColumn("source", F.from_json("source_json", SOURCE)).withColumn("lineage", F.from_json("lineage_json", LINEAGE)).withColumn("scores", F.from_json("scores_json", SCORES))
        .withColumn("stage_events", F.from_json("stage_events_json", COLUMNS["stage_events"]))
        .withColumn("payload", F.struct(F.when(is_conv, conv).alias("conversation"), F.when(~is_conv, chunk).alias("chunk")))
    )
