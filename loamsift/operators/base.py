"""The stage: records in, kept and dropped records out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.schema import with_event
from loamsift.sources.sinks import batches_of


@dataclass
class StageOutput:
    kept: DataFrame
    dropped: DataFrame | None = None
    extras: dict[str, DataFrame] = field(default_factory=dict)
    stats: dict[str, object] = field(default_factory=dict)


@dataclass
class Context:
    """What a stage may use besides its input: models, the run's seeds and earlier rows, and a way to hold a frame."""

    model: object | None = None
    embedder: object | None = None
    seeds: DataFrame | None = None
    parents: DataFrame | None = None
    hold: object = None  # DataFrame -> DataFrame, written or persisted
    config_hash: str | None = None

    def held(self, df: DataFrame) -> DataFrame:
        """Models and embedders take texts and give lists, so they get few rows at once."""
        if not self.hold:
            return df
        with batches_of(df.sparkSession, 500):
            return self.hold(df)


class Stage:
    """Subclass it, set name and action, and pass an instance to the runner."""

    name = "stage"
    action = "transformed"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        raise NotImplementedError


def split(df: DataFrame, stage: Stage, reason: Column, details: Column | None = None) -> StageOutput:
    """Rows whose reason is null are kept; the others are dropped and tagged with stage and reason."""
    tagged = df.withColumn("_reason", reason).withColumn("_details", details if details is not None else F.lit(None).cast("string"))
    kept = tagged.where("_reason is null").drop("_reason", "_details")
    gone = with_event(tagged.where("_reason is not null"), stage.name, "dropped", F.col("_reason"), F.col("_details")).drop("_reason", "_details")
    return StageOutput(kept, gone)
