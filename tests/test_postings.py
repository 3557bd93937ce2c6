"""The kept index against every chunk scored for every question."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.operators import retrieval as R
from sieveline.operators.postings import LexicalIndex


def test_a_hundred_questions_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = ["red", "fox", "the", "house", "of", "blue", "é", "x", "ab12", "zed", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = spark.createDataFrame([(i, text(rng.randint(0, 12))) for i in range(150)] + [(900, None), (901, ""), (902, "red fox red fox")], "chunk_id int, chunk string")
    asked = spark.createDataFrame([(i, text(rng.randint(0, 5))) for i in range(97)] + [(200, None), (201, "the of"), (202, "unheard")], "qid int, question string")
    index = LexicalIndex.save(chunks, f"file://{tmp_path}/index", buckets=8)
    every = asked.crossJoin(chunks).withColumn("score", R.lexical_score(F.col("question"), F.col("chunk")))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("chunk_id"))
    want = sorted((r["qid"], r["chunk_id"], r["score"], r["rn"]) for r in every.withColumn("rn", F.row_number().over(best)).where("rn <= 5").collect())
    again = LexicalIndex(spark, index.path, buckets=8)
    assert sorted((r["qid"], r["chunk_id"], r["score"], r["rn"]) for r in again.search(asked, 5).collect()) == want
    few = again.search(asked.where("qid = 202 or qid = 200"), 2).collect()
    assert [(r["chunk_id"], r["score"]) for r in sorted(few, key=lambda r: (r["qid"], r["rn"]))] == [(902, 0.0), (901, 0.0)] * 2
    one = spark.createDataFrame([(1, "zed")], "qid int, question string")
    files = again.search(one, 2).inputFiles()
    assert len({f for f in files if "postings" in f}) >= 1
    none = LexicalIndex.save(chunks.limit(0), f"file://{tmp_path}/none")
    assert none.search(asked, 3).count() == 0 and again.search(asked.limit(0), 3).count() == 0
