"""Fuzzy search and rule tables against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from signalspark.operators import fuzzy, tables_of_rules, tokens
from signalspark.plans import searches

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(old[j + 1], row[-1], old[j] + (x == y)))
    return round(2 * row[-1] / (len(a) + len(b)), 3)


def best(asked, entries, least, k):
    out = []
    for a in sorted({x for x in asked if x}):
        found = sorted((-ratio(a, b), b) for b in {x for x in entries if x} if ratio(a, b) >= least)
        out += [(a, b, -s) for s, b in found[:k]]
    return out


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 0.8, 0.85, 1.0])
def test_similar_loses_nothing(spark, least):
    rng = random.Random(int(least * 100))
    made = lambda: "".join(rng.choice("aabcé d") for _ in range(rng.randrange(0, 14)))
    asked, entries = [made() for _ in range(60)] + [None, "aspirin", "a"], [made() for _ in range(60)] + [None, "asprin 5", "ibuprofen"]
    t, e = spark.createDataFrame([(x,) for x in asked], "token string"), spark.createDataFrame([(x,) for x in entries], "entry string")
    for k in (3, 1000):
        assert sorted(map(tuple, fuzzy.similar(t, e, least, k).collect())) == sorted(best(asked, entries, least, k))


def test_similar_words_of_documents(spark):
    """The query without SQL, against all pairs of a share of its tokens."""
    words = lambda name: {w for r in spark.read.parquet(f"{SF}/{name}.parquet").select("text").collect() for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())}
    known = words("benchmark")
    got = {}
    for r in searches.fuzzy_words(spark, SF).collect():
        got.setdefault(r.token, []).append((r.token, r.entry, r.score))
    asked = sorted(words("documents") - known)[::40]
    assert got and [x for a in asked for x in sorted(got.get(a, []), key=lambda x: (-x[2], x[1]))] == best(asked, known, 0.85, 3)


def test_candidates_are_few(spark):
    rng = random.Random(1)
    names = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)),) for _ in range(400)], "token string")
    assert fuzzy.candidates(names, names.withColumnRenamed("token", "entry"), 0.8).count() < 400 * 400 / 4  # letters of equal frequency: the worst case


def test_searched(spark):
    aliases = spark.createDataFrame([("aspirin", "aspirin", 0), ("codeine", "codeine", 0), ("asa", "aspirin", 1), ("asa", "codeine", 1), ("aspirin", "other", 1)], "alias string, entry string, priority int")
    asked = spark.createDataFrame([("aspirin",), ("asa",), ("asprin",), ("zzz",), ("asprin",), (None,), ("",)], "token string")
    got = sorted(map(tuple, fuzzy.searched(asked, aliases).collect()), key=repr)
    assert got == sorted([("aspirin", "aspirin", 0, 1.0), ("asa", "aspirin", 1, 1.0), ("asa", "codeine", 1, 1.0), ("asprin", "aspirin", 2, 0.923), ("zzz", None, 3, None), ("", None, 3, None)], key=repr)
    assert [r.status for r in fuzzy.searched(asked.where("token = 'zzz'"), aliases.limit(0)).collect()] == [3]
    assert fuzzy.searched(asked.limit(0), aliases).count() == 0


def test_similar_keys_by_ratio(spark):
    entries = spark.createDataFrame([("aspirin", ["x"]), ("codeine", ["y", "z"])], "entry string, value array<string>")
    got = fuzzy.similar_keys(spark.createDataFrame([("codein",), ("zzz",)], "token string"), entries).collect()
    assert [tuple(r) for r in got] == [("codein", "codeine", 0.923, ["y", "z"])]


def test_planned_tables(spark):
    """The rules of a table are those of the function for one entry."""
    entries = [("Aspirin", ["acetyl salicylic-acid", "asa"], [("Aspirin plus", ["aspirin", "codeine"]), ("co-pain", ["aspirin", "caffeine"])]), ("b", None, None), (None, ["x"], None)]
    got = tables_of_rules.planned_table(spark.createDataFrame(entries, "name string, synonyms array<string>, mixtures array<struct<name:string,parts:array<string>>>"))
    for name, synonyms, mixtures in entries[:2]:
        own = got.where(F.col("name") == name)
        assert tables_of_rules.from_table(own) == tables_of_rules.planned(name, synonyms or [], dict(mixtures or []))
    assert got.where("name is null").count() == 0


def test_searched_rules(spark):
    rules = tables_of_rules.as_table(spark, [tokens.Rule("capture_by_regex", "codeine"), tokens.Rule("capture_by_regex", "codeine"), tokens.Rule("extend_by_regex", r"co\-pain", "a | b"), tokens.Rule("remove_by_string", "aspirin"), tokens.Rule("remove_by_string", "")])
    asked = spark.createDataFrame([(x,) for x in ("Codeine", "co-pain", "co", "asprin", "qqq", None)], "token string")
    got = sorted((r.token, r.find, r.hit, r.score) for r in tables_of_rules.search(rules, asked).collect())
    assert got == sorted([("Codeine", "codeine", "exact", 1.0), ("co-pain", r"co\-pain", "exact", 1.0), ("co", "codeine", "part", 1.0), ("co", r"co\-pain", "part", 1.0), ("asprin", "aspirin", "similar", 0.923)])
