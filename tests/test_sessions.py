"""Session stores replayed in blocks against one replay of the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import sessions as S

LOG = "ord long, at long, kind string, query string, run_id string, chunk_count int, outcome int"


def one_by_one(rows, most, rule):
    """(outcomes by ord, live sessions) of the rule itself: a dictionary whose order is the order of going."""
    store, told = {}, {}
    for ord_, at, kind, query, run, chunks, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        query = (query or "").strip().lower()
        out = []
        if kind == "clear":
            out, store = list(store), {}
            told[ord_] = ("cleared", None, out)
            continue
        key = next((k for k, v in store.items() if v["run"] == run), None) if kind == "touch" else query if query in store else None
        if key is None and kind != "register":
            told[ord_] = ("missed", None, out)
            continue
        if key is None:
            while len(store) >= most:
                out.append(next(iter(store)))
                del store[out[-1]]
            store[query] = {"run": run, "created": at, "last": at, "n": 1, "chunks": chunks}
            told[ord_] = ("registered", query, out)
            continue
        if kind == "register":
            store[key] |= {"run": run, "chunks": chunks}
        if rule == "lru" or kind == "register":
            store[key] |= {"last": at, "n": store[key]["n"] + 1}
        if rule == "lru":
            store[key] = store.pop(key)
        told[ord_] = ({"register": "updated", "lookup": "hit", "touch": "touched"}[kind], key, out)
    return told, [(q, v["run"], v["created"], v["last"], v["n"], v["chunks"]) for q, v in store.items()]


def made(seed, n, queries, kinds, weights):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        q = rng.choice(queries)
        rows.append((i, i // 3, rng.choices(kinds, weights)[0], rng.choice([q, f" {q.upper()} "]) if q else None, f"run-{q}", i, 0))
    rng.shuffle(rows)
    return rows


CASES = {
    "mixed": made(1, 900, list("abcdefg"), ["register", "lookup", "touch", "clear"], [4, 3, 3, 0.05]),
    "few queries": made(2, 400, ["a", "b", None], ["register", "lookup"], [1, 1]),
    "registers alone": made(3, 600, [f"q{i}" for i in range(150)], ["register"], [1]),
    "no registers": made(4, 60, ["a"], ["lookup", "touch"], [1, 1]),
    # kept through all blocks by touches alone, while others come and go
    "kept by touches": [(0, 0, "register", "old", "run-old", 1, 0)] + [(i, i, "touch" if i % 2 else "register", "old" if i % 2 else f"q{i}", "run-old" if i % 2 else f"run-{i}", i, 0) for i in range(1, 300)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize(("most", "rule"), [(3, "lru"), (3, "fifo"), (1, "lru")])
def test_blocks_replay_as_the_whole_log(spark, case, most, rule):
    rows = CASES[case]
    told, live = one_by_one(rows, most, rule)
    replay = S.Replay(spark.createDataFrame(rows, LOG).drop("outcome").repartition(3), most, rule, blocks=7)
    got = {r["ord"]: (r["outcome"], r["session"], [x["query"] for x in r["evicted"]]) for r in replay.outcomes().collect()}
    assert got == told and len(replay.names) > 3 and replay.rounds <= len(replay.names) + 1
    kept = sorted(replay.sessions().collect(), key=lambda r: r["place"])
    assert [(r["query"], r["run_id"], r["created_at"], r["last_used"], r["access_count"], r["chunk_count"]) for r in kept] == live


def test_registers_alone_settle_in_two_rounds(spark):
    replay = S.Replay(spark.createDataFrame(CASES["registers alone"], LOG), blocks=7)
    assert replay.rounds == 2


def test_an_empty_log_and_what_is_found(spark):
    df = spark.createDataFrame([(i, i, "register", q, f"r{i}", 1, 0) for i, q in enumerate(["a", "b", " A ", "c", "d"])], LOG)
    live = S.Replay(df).sessions()
    assert {r["query"]: (r["run_id"], r["access_count"]) for r in live.collect()} == {"a": ("r2", 2), "c": ("r3", 1), "d": ("r4", 1)}
    find = lambda *a: tuple(S.resolve(live, *a).first())
    assert [find("r9", "a"), find(None, " A"), find(None, "b"), find(None, None)] == [("r9", "id"), ("r2", "query"), ("r4", "current"), ("r4", "current")]
    none = S.Replay(df.where("false"))
    assert none.sessions().count() == 0 and none.outcomes().count() == 0
    assert tuple(S.resolve(none.sessions(), None, "a").first()) == (None, "none")
    assert {r["access_count"] for r in S.touch(live, "r2", F.lit(99)).where("query = 'a'").collect()} == {3}
