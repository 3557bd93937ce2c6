"""Session stores of bounded size, replayed from their logs: which sessions live, and what happened at each entry.

A store holds `most` sessions, one for each query. Entries of its log are of four kinds: `register` (a search: its query's
session is renewed, or made after the store has put out others), `lookup` (by query), `touch` (by run id) and `clear`. Two rules:

- lru: any use renews a session; the least recently used one goes;
- fifo: sessions go in the order they came; renewal keeps the place, and lookups and touches change nothing.

What an entry does depends on all before it, yet a state is a few sessions. So the log is cut into blocks by ranges of time,
stored in order, and every block is replayed at once from a guess of the state before it (at first: nothing). The state a block
ends in is handed to the next one; blocks whose guess proves wrong are replayed again, until all guesses hold. By induction over
the blocks that is the one global replay. Old states are soon forgotten, as `most` new queries push out all others, so two or
three rounds are usual; a session kept by touches alone takes a round for each block it lives through. The driver holds one
state of at most `most` sessions for each block; entries stay in their blocks.

Defined results: queries are compared trimmed and in lower case, null as empty; entries of equal time go by `ord`, null first; an
empty log gives no sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.functions.stored import stored
from sieveline.functions.workers import reach

State = list[tuple[str, str]]  # (query, run_id), first to go first


def step(state: State, kind: str, query: str, run: str, most: int, rule: str) -> tuple[State, str, str | None, State]:
    """(state after the entry, what it did, the session's query, the sessions put out)."""
    if kind == "clear":
        return [], "cleared", None, state
    at = next((i for i, (q, r) in enumerate(state) if (r == run if kind == "touch" else q == query)), None)
    if at is not None:
        own = (state[at][0], run if kind == "register" else state[at][1])
        done = {"register": "updated", "lookup": "hit", "touch": "touched"}[kind]
        if rule == "lru":
            return [*state[:at], *state[at + 1 :], own], done, own[0], []
        return [*state[:at], own, *state[at + 1 :]], done, own[0], []
    if kind != "register":
        return state, "missed", None, []
    out = max(0, len(state) + 1 - most)
    return [*state[out:], (query, run)], "registered", query, state[:out]


class Replay:
    """A log cut into blocks, and the state before each."""

    def __init__(self, log: DataFrame, most: int = 3, rule: str = "lru", blocks: int | None = None):
        """log: ord, at, kind, query, run_id and whatever else; its own outcome, session, evicted and block, if any, are left out."""
        if rule not in ("lru", "fifo") or most < 1:
            raise ValueError("rule is lru or fifo, and a store holds one session at least")
        reach(log.sparkSession)
        self.most, self.rule = most, rule
        order = (F.col("at").asc_nulls_first(), F.col("ord").asc_nulls_first())
        plain = log.drop("outcome", "session", "evicted", "block").withColumn("query", N.filled(F.lower(F.trim("query")))).withColumn("run_id", F.col("run_id").cast("string"))
        dealt = plain.repartitionByRange(blocks, *order) if blocks else plain.repartitionByRange(*order)
        self.blocks = stored(dealt.withColumn("block", F.spark_partition_id()).sortWithinPartitions(*order), "log", "block")
        self.names = sorted(r["block"] for r in self.blocks.select("block").distinct().collect())
        self.before: dict[int, State] = {b: [] for b in self.names}
        self.after: dict[int, State] = {}
        self.rounds = 0
        todo = self.names
        while todo:
            self.rounds += 1
            for r in self._walk(todo, False).collect():  # a state for each block
                self.after[r["block"]] = [(x["query"], x["run_id"]) for x in r["state"]]
            todo = []
            for prior, b in zip(self.names, self.names[1:], strict=False):
                if self.after[prior] != self.before[b]:
                    self.before[b] = self.after[prior]
                    todo.append(b)

    def _walk(self, todo: list[int], told: bool) -> DataFrame:
        """Each block of todo in its order: its last state, or its entries and what they did."""
        before, most, rule = self.before, self.most, self.rule
        order = ["block", "at", "ord"]
        rows = self.blocks.where(F.col("block").isin(todo)) if len(todo) < len(self.names) else self.blocks
        dealt = (rows if told else rows.select("block", "at", "ord", "kind", "query", "run_id")).repartition(max(1, len(todo)), "block").sortWithinPartitions(*order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state = None, []
            last = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([[{"query": q, "run_id": r} for q, r in state]], pa.list_(pa.struct([("query", pa.string()), ("run_id", pa.string())])))], ["block", "state"])
            for b in batches:
                done, whose, gone = [], [], []
                for block, kind, query, run_id in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "query", "run_id")), strict=True):
                    if block != now:
                        if now is not None and not told:
                            yield last()
                        now, state = block, before[block]
                    state, what, own, out = step(state, kind, query, run_id, most, rule)
                    done.append(what)
                    whose.append(own)
                    gone.append([{"query": q, "run_id": r} for q, r in out])
                if told:
                    pair = pa.list_(pa.struct([("query", pa.string()), ("run_id", pa.string())]))
                    extra = [pa.array(done, pa.string()), pa.array(whose, pa.string()), pa.array(gone, pair)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "outcome", "session", "evicted"])
            if now is not None and not told:
                yield last()

        gone = "array<struct<query:string,run_id:string>>"
        if not told:
            return dealt.mapInArrow(run, f"block int, state {gone}")
        schema = dealt.withColumns({"outcome": F.lit(None).cast("string"), "session": F.lit(None).cast("string"), "evicted": F.lit(None).cast(gone)}).schema
        return dealt.mapInArrow(run, schema)

    def outcomes(self) -> DataFrame:
        """The log with outcome (registered, updated, hit, touched, missed, cleared), session (the query whose session it was) and evicted."""
        return self._walk(self.names, True).drop("block")

    def state(self) -> State:
        """The store after the log, first to go first."""
        return self.after[self.names[-1]] if self.names else []

    def sessions(self) -> DataFrame:
        """(query, run_id, created_at, last_used, access_count, chunk_count, place): the sessions that live; the last place goes last.

        Uses since a session was last registered are its own. The log needs chunk_count."""
        spark = self.blocks.sparkSession
        own = spark.createDataFrame([(q, i) for i, (q, _) in enumerate(self.state())], "session string, place int")
        own = F.broadcast(own)  # at most `most` rows
        when = F.struct("at", "ord")
        uses = self.outcomes().join(own, "session").withColumn("when", when)
        begun = uses.where("outcome = 'registered'").groupBy("session").agg(F.max("when").alias("begun"))
        kept = ("registered", "updated") if self.rule == "fifo" else ("registered", "updated", "hit", "touched")
        life = uses.join(F.broadcast(begun), "session").where((F.col("when") >= F.col("begun")) & F.col("outcome").isin(*kept))
        renewed = F.when(F.col("outcome").isin("registered", "updated"), F.col("when"))
        return life.groupBy(F.col("session").alias("query")).agg(
            F.max_by("run_id", renewed).alias("run_id"), F.min("at").alias("created_at"), F.max("at").alias("last_used"), F.count("*").alias("access_count"), F.max_by("chunk_count", renewed).alias("chunk_count"), F.first("place").alias("place")
        )


def touch(rows: DataFrame, run_id: str | Column, now: Column) -> DataFrame:
    """Live sessions after one more use of a run."""
    hit = F.col("run_id") == run_id
    return rows.withColumn("last_used", F.when(hit, now).otherwise(F.col("last_used"))).withColumn("access_count", F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count")))


def resolve(rows: DataFrame, run_id: str | None, query: str | None) -> DataFrame:
    """(run_id, found_by) among live sessions: the id given, else the session of the query, else the current one, else none."""
    given = F.lit(run_id).cast("string")
    run = F.col("run_id").cast("string")
    by_query = F.max(F.when(F.col("query") == F.lower(F.trim(F.lit(query or ""))), run))
    current = F.max_by(run, "last_used")
    got = rows.agg(by_query.alias("q"), current.alias("c"))
    return got.select(F.coalesce(given, "q", "c").alias("run_id"), F.when(given.isNotNull(), "id").when(F.col("q").isNotNull(), "query").when(F.col("c").isNotNull(), "current").otherwise("none").alias("found_by"))
