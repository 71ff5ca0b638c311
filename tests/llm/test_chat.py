"""The fold of chat logs: random logs against the plain fold, and rows replayed as logs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import chat
from tests.llm.test_small_operators import fold

LOG = "conv_id long, seq long, msg long, kind string, role string, text string"


def test_random_logs_equal_the_fold(spark):
    rng = random.Random(8)
    logs = defaultdict(list)
    for conv in range(120):
        for seq in range(rng.randrange(1, 14)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate"])
            logs[conv].append((seq, rng.randrange(4), kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "<|x", "é\n"])))
    rows = [(c, *e) for c, some in logs.items() for e in some]
    rng.shuffle(rows)
    got = defaultdict(list)
    df = spark.createDataFrame(rows, LOG).withColumn("epoch", F.lit(1)).withColumn("pos", F.lit("p"))
    for r in chat.reconstruct(df).orderBy("conv_id", "pos").collect():
        got[r.conv_id].append((r.role, r.text))
    assert {c: got[c] for c in logs} == {c: fold(some) for c, some in logs.items()}


def test_rows_come_as_deltas_edits_and_regenerations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    log = chat.from_rows(rows)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert all(kinds[k] > 0 for k in ("message", "delta", "edit", "regenerate"))
    want, got, events = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows.orderBy("conv_id", "turn").collect():
        want[r.conv_id].append((r.role, r.text or ""))
    for r in chat.reconstruct(log).orderBy("conv_id", "pos").collect():
        got[r.conv_id].append((r.role, r.text))
    for r in log.collect():
        events[r.conv_id].append((r.seq, r.msg, r.kind, r.role, r.text))
    assert got == want == {c: fold(e) for c, e in events.items()}


def test_long_texts_and_other_columns(spark):
    rows = [(1, 1, "user", "x" * 300000, "m", 9), (1, 2, "assistant", "y<|" * 100000, "m", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg string, n int")
    got = chat.read_back(chat.render(chat.reconstruct(chat.from_rows(df)))).head()
    assert [(t.role, t.text) for t in got.turns] == [(r[2], r[3]) for r in rows]
