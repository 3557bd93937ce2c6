"""Votes as state: evidence streams in, changes of winners stream out.

The state of one entity and field is what each group of like values has so far (sum of reliability, rows, different
URLs and kinds, first value), the URLs each group has seen, the leading group, and the row last said. A batch costs
what it brings: a group is looked up where a row names it, and all groups of a field are walked only where the leader
itself falls. Rows are combined inside their task before the shuffle, so a field that holds a third of all rows
sends one row for each of its values, URLs and kinds an Arrow batch. State lies in RocksDB, changelog in the checkpoint.

A change is a row: `op` is 'remove' for what was said before, then 'add' for what holds now; `seq` rises within an
entity and field, also after it was forgotten. With `quiet_ms` a field that nothing came for so long is taken back
and forgotten.

Defined results: after any split of the input into batches, current() equals the batch vote over all rows; empty
values are no evidence; a null reliability counts as 0, a null ord comes last, a null URL is one URL, a null kind
none; a null entity or field is one of its own; repeated rows count as often as they come; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from sieveline.functions import normalize as N
from sieveline.functions.workers import reach

CHANGES = "entity_id string, field string, op string, seq long, value string, confidence double, verified_level string, evidence_count long, n_urls long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = (1 << 63) - 1
KEYS = ["entity_id", "field", "canon", "source_url", "source_type"]


def rounded(x: float, digits: int) -> float:
    """Half up on the shortest decimal form, as SQL's round does."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of like value, URL and kind as one, inside each Arrow batch."""
    for b in batches:
        by = b.sort_values(["ord", "value"], kind="stable").groupby(KEYS, dropna=False, sort=False)
        yield by.agg(total=("reliability", "sum"), n=("reliability", "size"), first=("ord", "first"), value=("value", "first")).reset_index()


class Votes(StatefulProcessor):
    """One entity's field; `quiet_ms` None keeps it for ever."""

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.groups = handle.getMapState("groups", "canon string", "total double, n long, n_urls long, first long, value string, kinds string")
        self.seen = handle.getMapState("seen", "canon string, url string", "there boolean")
        self.best = handle.getValueState("best", "canon string")
        self.said = handle.getValueState("said", "seq long, value string, confidence double, verified_level string, evidence_count long, n_urls long")

    @staticmethod
    def rank(canon: str, group: tuple) -> tuple[float, int, str]:
        """Order of groups, the best least."""
        total, n, n_urls, first, _, kinds = group
        types = len(kinds.split("\n")) if kinds else 0
        return -rounded(total / n * 0.65 + min(n_urls, 4) * 0.08 + min(types, 3) * 0.04, 9), first, canon

    def add(self, rows: pd.DataFrame) -> dict[str, tuple]:
        """The groups that some rows touch, as they are after them; rows of an Arrow batch only are held."""
        touched: dict[str, tuple] = {}
        for canon, url, kind, total, n, first, value in zip(*(rows[c] for c in ("canon", "source_url", "source_type", "total", "n", "first", "value")), strict=True):
            g = touched.get(canon) or self.groups.getValue((canon,)) or (0.0, 0, 0, LAST, None, "")
            url = None if pd.isna(url) else url
            fresh = not self.seen.containsKey((canon, url))
            if fresh:
                self.seen.updateValue((canon, url), (True,))
            kinds = set(g[5].split("\n")) - {""} | (set() if pd.isna(kind) else {kind})
            head = min((x for x in ((g[3], g[4]), (int(first), value)) if x[1] is not None), default=(LAST, None))
            touched[canon] = (g[0] + float(total), g[1] + int(n), g[2] + fresh, *head, "\n".join(sorted(kinds)))
        for canon, g in touched.items():
            self.groups.updateValue((canon,), g)
        return touched

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lead = self.best.get()
        lead = lead and lead[0]
        at = self.rank(lead, self.groups.getValue((lead,))) if lead is not None else None
        fell = False
        for part in rows:
            for canon, g in self.add(part).items():
                r = self.rank(canon, g)
                fell = fell or (canon == lead and r > at)
                if at is None or canon == lead or r < at:
                    lead, at = canon, r
        if fell:
            lead = min(self.rank(k[0], g) for k, g in self.groups.iterator())[2]
        if lead is None:
            return
        self.best.update((lead,))
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.quiet_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + self.quiet_ms)
        yield from self.change(key, self.row(lead), now)

    def row(self, lead: str) -> tuple:
        g = self.groups.getValue((lead,))
        sure = min(-self.rank(lead, g)[0], 0.99)
        level = "high" if g[2] >= 3 and sure >= 0.8 else "medium" if g[2] >= 2 or sure >= 0.72 else "low"
        return g[4], rounded(sure, 3), level, g[1], g[2]

    def change(self, key: tuple, new: tuple | None, now: int) -> Iterator[pd.DataFrame]:
        old = self.said.get()
        if old is not None and tuple(old[1:]) == new:
            return
        seq = max(now, old[0] + 1 if old is not None else 0)
        out = [] if old is None else [(*key, "remove", seq, *old[1:])]
        if new is not None:
            out.append((*key, "add", seq + 1, *new))
            self.said.update((seq + 1, *new))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.change(key, None, timerValues.getCurrentProcessingTimeInMs())
        for state in (self.groups, self.seen, self.best, self.said):
            state.clear()

    def close(self) -> None:
        pass


def vote_changes(evidence: DataFrame, canon: Column | None = None, quiet_ms: int | None = None) -> DataFrame:
    """Changes of the winners of a stream of evidence, as CHANGES; `canon` names like values (by field, if not given)."""
    reach(evidence.sparkSession)
    canon = N.canonical(F.col("field"), F.col("value")) if canon is None else canon
    rows = evidence.where(N.filled(F.col("value")) != "").withColumn("canon", canon).where("canon <> ''")
    rows = rows.select(*KEYS, F.coalesce("ord", F.lit(LAST)).cast("long").alias("ord"), F.coalesce("reliability", F.lit(0.0)).alias("reliability"), N.shown(F.col("field"), F.col("value")).alias("value"))
    few = rows.mapInPandas(combine, "entity_id string, field string, canon string, source_url string, source_type string, total double, n long, first long, value string")
    return few.groupBy("entity_id", "field").transformWithStateInPandas(Votes(quiet_ms), CHANGES, "Append", "None" if quiet_ms is None else "ProcessingTime")


def current(changes: DataFrame) -> DataFrame:
    """What holds after all changes: the last row of each entity and field, unless it takes back."""
    cols = [c for c in changes.columns if c not in ("entity_id", "field", "seq")]
    last = changes.groupBy("entity_id", "field").agg(F.max_by(F.struct(*cols), "seq").alias("r"))
    return last.where("r.op = 'add'").select("entity_id", "field", *[f"r.{c}" for c in cols if c != "op"])


def start(changes: DataFrame, path: str, every: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Runs what is there now, or on and on at an interval, as a stream with `quiet_ms` must: its timers never end.
    Changes are appended to path/changes, the state's checkpoint lies beside them. `partitions` of the state are fixed by
    the first start (shuffle partitions, if not given); each is a RocksDB of its own, which takes a few MB of disk even if empty."""
    conf = changes.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch writes what it changed
    to = changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_checkpoint").option("path", f"{path}/changes")
    to, usual = to.trigger(**({"availableNow": True} if every is None else {"processingTime": every})), conf.get("spark.sql.shuffle.partitions")
    try:
        conf.set("spark.sql.shuffle.partitions", str(partitions or usual))
        return to.start()  # the stream keeps a copy of the settings
    finally:
        conf.set("spark.sql.shuffle.partitions", usual)


def partitions_for(evidence_bytes: int, cores: int) -> int:
    """State partitions for stored evidence: one for each 64 MB, and one for each core at least."""
    return max(cores, -(-evidence_bytes // (64 << 20)))
