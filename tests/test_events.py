"""The event log against a reader that takes one event after the other."""

import random

from sieveline.sources import events as V

LOG = "run string, at long, kind string, key string, payload string, seq0 int"


def test_numbers_and_replay(spark):
    rng = random.Random(7)
    kinds = [*V.KINDS, "unheard", *("business_discovered", "business_enriched", "business_removed") * 6]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), rng.choice(kinds), rng.choice([None, *"klmnopq"]), rng.choice([None, "x", "y"]), 0) for _ in range(900)]
    rows += [("c", 1, "started", None, None, 0)] * 3
    rank = {k: i for i, k in enumerate(V.KINDS)}
    low = lambda x: (x is not None, x or "")
    want, held = [], {}
    for run in ("a", "b", "c", None):
        mine = sorted((r for r in rows if r[0] == run), key=lambda r: (r[1] is not None, r[1] or 0, rank.get(r[2], 99), low(r[3]), low(r[4])))
        for n, r in enumerate(mine, 1):
            want.append((*r[:5], n))
            if r[3] is not None and r[2] in V.STATES:
                held[run, r[3]] = (r[4], n)
            elif r[3] is not None and r[2] == V.REMOVED:
                held.pop((run, r[3]), None)
    log = V.numbered(spark.createDataFrame(rows, LOG).repartition(5))
    assert sorted(((r["run"], r["at"], r["kind"], r["key"], r["payload"], r["seq"]) for r in log.collect()), key=str) == sorted(want, key=str)
    assert {(r["run"], r["key"]): (r["payload"], r["seq"]) for r in V.replayed(log).collect()} == held
    assert sum(r["events"] for r in V.progress(log).collect()) == len(rows)
    assert V.lines(log).count() == len(rows) and V.replayed(V.numbered(log.drop("seq").where("false"))).count() == 0
