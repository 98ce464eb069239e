"""Prefix sums, exact percentiles and state folds against plain Python, with one hot group."""

import random

import numpy as np
from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.operators import scale as C
from rillwork.operators import spatial as S


def test_row_numbers_with_hot_group(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"g{rnd.randint(0, 9)}", i) for i in range(800)]
    rnd.shuffle(rows)
    out = C.row_numbers(spark.createDataFrame(rows, "g string, i bigint"), ["g"], ["i"]).collect()
    want, seen = {}, {}
    for g, i in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[(g, i)] = seen[g]
    assert {(r.g, r.i): r.rn for r in out} == want


def test_running_sum_null_group(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 3, 7)], "g string, i bigint, w bigint")
    out = {(r.g, r.i): r.s for r in C.running_sum(df, ["g"], ["i"], F.col("w"), "s").collect()}
    assert out == {(None, 1): 5, (None, 2): 11, ("a", 3): 7}


def test_exact_percentiles(spark):
    rnd = random.Random(2)
    rows = [("h" if i % 3 else "t", float(rnd.randint(0, 40))) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double")
    fr = [0.0, 0.1, 0.5, 0.9, 1.0]
    for r in C.exact_percentiles(df, "v", fr, ["g"]).collect():
        want = np.percentile([v for g, v in rows if g == r.g], [100 * f for f in fr])
        assert np.allclose([r[f"p{i}"] for i in range(5)], want)
    one = C.exact_percentiles(df, "v", fr).first()
    assert np.allclose(list(one), np.percentile([v for _, v in rows], [100 * f for f in fr]))


def test_lookup_and_skew_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    table = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows.join(table, "k", "left").agg(F.count("*"), F.sum("v")).first()
    assert C.lookup_join(rows, table, "k").agg(F.count("*"), F.sum("v")).first() == want
    inner = rows.join(table, "k").agg(F.count("*"), F.sum("v")).first()
    assert S.skew_join(rows, table, ["k"]).agg(F.count("*"), F.sum("v")).first() == inner


def test_state_fold_over_many_chunks(spark):
    rnd = random.Random(4)
    names = list(X.ORDER_STATUSES)
    rows = [("busy" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", i, rnd.choice(names)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i bigint, t string")
    out = C.fold_states(df, "k", ["i"], "t", X.ORDER_STATUSES, X.ORDER_TRANSITIONS, "submitted", chunk=5)
    state, want = {}, {}
    for k, i, t in rows:
        now = state.get(k, "submitted")
        ok = t in X.ORDER_TRANSITIONS[now]
        state[k] = t if ok else now
        want[(k, i)] = (now, state[k], ok)
    assert {(r.k, r.i): (r.state_before, r.state_after, r.accepted) for r in out.collect()} == want
