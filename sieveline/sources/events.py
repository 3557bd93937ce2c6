"""The event log of runs: a number for each event, and what a reader of the log holds at its end.

Events of any steps of any runs are lined up by run, time, phase and key, and numbered from 1 in each run. No task sees a whole run: events are
dealt by ranges and stored, the rows of each run in each range are counted (a number for each), and an event's number is its
place in its range after the ranges before. A reader keeps of each entity its last word: discoveries and enrichments
state it, a removal takes it back, so replaying a log gives the entities of the final report, whatever was said in between.

Defined results: events of equal run, time and phase go by key, then payload, null first; a null key is no entity; kinds that are not known come
last in their time; repeated events are events each; an empty log holds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.stored import stored

# fixed values: kinds of events, in the order of a run's phases; a removal is this engine's own
KINDS = (
    "started", "source_skipped", "source_error", "geoapify_complete", "places_complete", "serper_places_complete", "business_discovered", "business_enrichment_started",
    "search_plan", "search_timeout", "discovery_complete", "extraction_started", "extraction_timeout", "lead_mining_complete", "lead_places_enrichment_started",
    "lead_places_enrichment_complete", "business_enriched", "business_removed", "completed",
)
STATES = ("business_discovered", "business_enriched")
REMOVED = "business_removed"


def numbered(events: DataFrame) -> DataFrame:
    """events(run, at, kind, key, payload) with seq, their number in their run; stored."""
    phase = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = ("run", "at", "_phase", "key", "payload")
    placed = events.withColumn("_phase", F.when(phase > 0, phase).otherwise(len(KINDS) + 1))
    placed = stored(placed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "events")
    sizes = placed.groupBy("run", "_part").count()  # one for each run in each range
    ahead = F.coalesce(F.sum("count").over(Window.partitionBy("run").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("run").alias("_run"), F.col("_part").alias("_in"), ahead.alias("_ahead"))
    own = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "run").orderBy(*order)))
    joined = own.join(sizes, (F.col("_part") == F.col("_in")) & F.col("run").eqNullSafe(F.col("_run")))
    return joined.withColumn("seq", F.col("_n") + F.col("_ahead")).drop("_phase", "_part", "_n", "_run", "_in", "_ahead")


def lines(log: DataFrame) -> DataFrame:
    """(run, seq, value): a JSON line for each event."""
    return log.select("run", "seq", F.to_json(F.struct(F.col("kind").alias("event"), "seq", "key", "payload")).alias("value"))


def replayed(log: DataFrame) -> DataFrame:
    """(run, key, payload, seq) of the entities that a reader of the whole log holds; combined before the shuffle."""
    about = log.where(F.col("key").isNotNull() & F.col("kind").isin(*STATES, REMOVED))
    last = about.groupBy("run", "key").agg(F.max(F.struct("seq", "kind", "payload")).alias("last"))
    return last.where(F.col("last.kind") != REMOVED).select("run", "key", "last.payload", "last.seq")


def progress(log: DataFrame) -> DataFrame:
    """(run, kind, events, first, last): how often each kind came in a run, and between which numbers."""
    return log.groupBy("run", "kind").agg(F.count("*").alias("events"), F.min("seq").alias("first"), F.max("seq").alias("last"))
