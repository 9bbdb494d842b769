"""Stores: steps that resume, token state by versions, counts by chunk."""

import pytest
from pyspark.sql import functions as F

from signalspark.operators import reports, signal
from signalspark.operators.tokens import Rule
from signalspark.sources import tables
from signalspark.sources.store import CountsByChunk, Steps, TokenState, exploded_pairs


def test_steps_resume(spark, tmp_path):
    spark.range(20).select("id", (F.col("id") % 3).alias("g")).write.parquet(str(tmp_path / "in"))

    def run(times=2):
        store = Steps(spark, f"file://{tmp_path}/store")
        rows = spark.read.parquet(str(tmp_path / "in"))
        one = store.step("one", lambda: rows.withColumn("x", F.col("id") * times), [rows], {"times": times}, ("g",))
        two = store.step("two", lambda: one.groupBy("g").agg(F.sum("x").alias("s")), [one])
        return store, {r.g: r.s for r in two.collect()}

    first, want = run()
    assert first.built == ["one", "two"] and want == {0: 126, 1: 140, 2: 114}
    second, got = run()
    assert second.built == [] and got == want
    second.folder.drop_marker(second.held[1])  # as if the attempt had broken off before it was committed
    third, got = run()
    assert third.built == ["two"] and got == want
    fourth, got = run(times=4)
    assert fourth.built == ["one", "two"] and got == {g: 2 * s for g, s in want.items()}
    spark.range(5).select((F.col("id") + 100).alias("id"), F.lit(0).cast("bigint").alias("g")).write.mode("append").parquet(str(tmp_path / "in"))
    fifth, got = run()
    assert fifth.built == ["one", "two"] and got[0] == 126 + 2 * 510 and run()[0].built == []
    assert len(fourth.folder.names("one")) == 3


def test_token_state(spark, tmp_path):
    rows = spark.createDataFrame([("a b", ["a", "b"], []), ("a", ["a"], []), ("c d", ["c", "d"], []), ("e", ["e"], [])], "name string, tokens array<string>, active array<string>")
    state = TokenState(spark, f"file://{tmp_path}/tokens")
    state.start(rows)
    assert state.state() == (0, 0) and state.finished().count() == 0 and state.pending().count() == 4
    state.apply([Rule("move_by_string", "a")])
    state.record([Rule("remove_by_string", "b"), Rule("move_by_string", "c")])
    assert state.state() == (2, 1) and {r.name for r in state.pending().collect()} == {"a b", "c d", "e"}
    again = TokenState(spark, f"file://{tmp_path}/tokens")  # another session goes on from what is kept
    again.apply([Rule("remove_by_string", "d")])
    assert again.state() == (3, 4)
    done = {r.name: (r.active, r.version) for r in again.finished().collect()}
    assert done == {"a": (["a"], 1), "a b": (["a"], 3), "c d": (["c"], 3)} and again.finished().count() == 3
    assert [r.find for r in again.log()] == ["a", "b", "c", "d"] and [r.name for r in again.pending().collect()] == ["e"]
    again.folder.drop_marker("state/000003")  # an application that broke off doesn't count, and may be made again
    assert state.state() == (2, 1) and state.finished().count() == 1
    state.apply([Rule("remove_by_string", "d")])
    assert {r.name for r in state.finished().collect()} == {"a", "a b", "c d"} and state.finished().count() == 3
    state.record([Rule("remove_by_string", "e")])
    state.apply(everything=True)
    assert state.pending().count() == 0 and state.state() == (5, 5)


def test_counts_by_chunk(spark, tmp_path):
    rows = [(k % 2, f"d{k % 3}", f"e{k % 5}") for k in range(60)]
    whole = spark.createDataFrame(rows, "dim int, drug string, event string")
    counts = CountsByChunk(spark, f"file://{tmp_path}/chunks", ["dim"], "drug", "event")
    with pytest.raises(ValueError):
        counts.cube()
    for chunk in (0, 1, 0, 2, 1):  # two of the three come twice
        counts.add(spark.createDataFrame(rows[chunk * 20 : chunk * 20 + 20], whole.schema), chunk)
    want = sorted(map(repr, signal.pair_counts(whole, ["dim"], "drug", "event").collect()))
    assert sorted(map(repr, counts.cube().collect())) == want

    whole.repartition(4).write.parquet(str(tmp_path / "in"))
    streamed = CountsByChunk(spark, f"file://{tmp_path}/streamed", ["dim"], "drug", "event")
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    source.writeStream.foreachBatch(lambda batch, n: streamed.add(batch, n)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(repr, streamed.cube().collect())) == want and len(streamed.folder.names("chunks")) == 4


def test_pairs_of_lists(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, [], ["x"]), (3, ["a"], None)], "id int, drugs array<string>, events array<string>")
    assert sorted(map(tuple, exploded_pairs(rows, ["id"], "drugs", "events").collect())) == [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y")]


def test_literals_that_are_no_lists_of_tuples(spark):
    texts = ["[]", " [ (1, 'a', 'b') , ] ", "[(1, 'a')]", "[[1, 'a', 'b']]", "[(1, (2, 3), 'b')]", "[(1, [2], 'b')]", "(1, 'a', 'b')", "[1, 2]", "[(1, 'a' 'b'), x]", "[(1, \"it's (x)\", 'a]b')]", "", None, r"[(1, 'a\n', '\x41\u20ac\'\q')]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.d for r in rows.select("k", reports.parsed_tuples(F.col("t"), reports.DRUG).alias("d")).collect()}
    assert got[0] == [] and [tuple(x) for x in got[1]] == [(1, "a", "b")] and [tuple(x) for x in got[2]] == [(1, "a", None)]
    assert all(got[k] is None for k in (3, 4, 5, 6, 7, 8, 10, 11)) and [tuple(x) for x in got[9]] == [(1, "it's (x)", "a]b")]
    assert [tuple(x) for x in got[12]] == [(1, "a\n", "A€'q")]


def test_tree_of_variants(spark, tmp_path):
    for variant, column in (("one", "x"), ("two", "y")):
        spark.range(3).select("id", F.lit(1).alias(column)).write.parquet(f"{tmp_path}/tree/{variant}/deep")
        spark.range(2).write.csv(f"{tmp_path}/text/{variant}", header=True)
    got = tables.read_tree(spark, f"{tmp_path}/tree/*/*/part-*.parquet", ["variant", "depth", "stem"])
    assert set(got.columns) == {"id", "x", "y", "variant", "depth", "stem"} and {(r.variant, r.depth, r.x, r.y) for r in got.collect()} == {("one", "deep", 1, None), ("two", "deep", None, 1)}
    assert {r.variant for r in tables.read_tree(spark, f"{tmp_path}/text/*/part-*.csv", ["variant", "stem"]).collect()} == {"one", "two"}
