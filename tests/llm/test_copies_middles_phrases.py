"""Operators 11 to 13 against brute force, on odd rows and at the borders of their parts."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalspark.llm import collocations, exact, middles, queries

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept string, n int, tag int, whole int"


def lower(text):
    return (text or "").translate(LOWER)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties and extra columns with clashing names."""
    long = "Ünd w " * 40_000
    texts = [(None, "No key"), (None, "no KEY"), (1, None), (2, ""), (2, ""), (3, long), (4, long + "x"), (5, long.upper()), (6, "ÄB c"), (6, "ÄB c"), (7, "äB c"), (8, "äb C"), (9, "a <S> b"), (10, " \t\n")]
    return spark.createDataFrame([(k, t, "en" if k else None, "s", 1, "r", "k", 1, 1, 1) for k, t in texts], SCHEMA)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_collocations", "op13_exact_copies"])
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'").fetchall()
    want = duck.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def copies(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    return sorted((repr(doc), repr(max((d for d in g if d is not None), default=None)), len(g)) for g in groups.values() for doc in g), len(groups)


@pytest.mark.parametrize("most_bits, hot", [(1 << 28, None), (exact.ROW_BITS, 2)])
def test_exact_copies(spark, odd, monkeypatch, most_bits, hot):
    """Also with full bitmaps, and with groups that come by broadcast."""
    monkeypatch.setattr(exact, "MOST_BITS", most_bits)
    if hot:
        monkeypatch.setattr(exact, "hot_bound", lambda n: hot)
    rng = random.Random(4)
    made = [(k, "".join(rng.choice("aAbB") for _ in range(rng.randrange(4)))) for k in range(300)]
    same = "x" * exact.BEGINNING  # equal lengths and beginnings
    made += [(400 + k, same + rng.choice(["aa", "ab", "AB", "bb"])) for k in range(40)]
    for df in (odd, spark.createDataFrame(made, "doc_id bigint, text string")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        found = exact.exact_copies(df, digests=True).collect()
        want, groups = copies(rows)
        assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in found) == want
        assert sum(r.kept for r in found) == groups and all(r.doc_id == r.keep_id for r in found if r.kept)
        assert collections.Counter(r.text_sha256 for r in found) == collections.Counter(hashlib.sha256(lower(t).encode()).hexdigest() for _, t in rows)
        left = exact.without_copies(df)
        assert left.columns == df.columns and left.count() == groups


def test_native_plan(spark):
    plan = exact.exact_copies(spark.read.parquet(f"{SF}/documents.parquet"), digests=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bitmap_of_groups(spark):
    rows = spark.range(5_000).select(F.col("id").alias("k"))
    bits = exact.Bitmap(rows.where("k % 3 = 0"), ["k"])
    got = bits.marked(rows, "in", F.col("k")).collect()
    assert all(r["in"] for r in got if r.k % 3 == 0)  # none is lost
    assert sum(r["in"] for r in got) < 1_667 + 3_333 / 8
    bits.drop()


@pytest.mark.parametrize("density", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(density):
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5_000):
        flags = rng.random(size) < density
        bits, places = middles.Bits(flags), np.flatnonzero(flags)
        at = np.arange(size + 1)
        assert (bits.rank(at) == np.concatenate([[0], np.cumsum(flags)])).all()
        if len(places):
            assert (bits.select(np.arange(len(places))) == places).all()


def brute_middle(doc, text):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    x, y, z = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc, len(w), "plain", None, None, text
    if h4 % 100 < 20:
        return doc, len(w), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc, len(w), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_fill_in_middle(spark, odd):
    rng = random.Random(6)
    made = [(k, "".join(rng.choice("aZ é<PM>😀\n1") for _ in range(rng.randrange(30)))) for k in range(-20, 400)]
    for df in (odd, spark.createDataFrame(made, "doc_id bigint, text string")):
        want = [brute_middle(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(repr, map(tuple, middles.fill_in_middle(df).collect()))) == sorted(map(repr, want))
        for r in middles.fill_in_middle(df, keep=True).collect():
            assert middles.restored(r.output.encode(), r.form).decode() == (r.row.text or "")
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = {(r.output_sha256, r.restored_sha256) for r in middles.fill_in_middle(df, digests=True).collect()}
    assert got == {(hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for w, (_, t) in zip(want, made)}


def brute_phrases(rows, least, top):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            count.update((lang or "und", tuple(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    frequent = {k: f for k, f in count.items() if len(k[1]) > 1 and f >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in frequent.items():
        if any(la == lang and len(v) > len(w) and 100 * f >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (la, v), f in frequent.items()):
            continue
        score, _, x, y = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), x, y))
    return sorted((lang, k, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("hot", [None, 1])
def test_collocations(spark, monkeypatch, hot):
    """Also with every part's count coming by broadcast."""
    if hot:
        monkeypatch.setattr(collocations, "hot_bound", lambda n: hot)
    rng = random.Random(7)
    some = ["Red", "blue", "the", "of", "ÉTÉ", "été", "a\x0bb", "x\x1cy", " ", "end."]
    rows = [(rng.choice(["en", "en", None, "de", "und"]), rng.choice([" ", "  ", "\t"]).join(rng.choice(some) for _ in range(rng.randrange(40)))) for _ in range(80)]
    rows += [("en", None), ("en", ""), ("fr", "one two")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for top in (2000, 3):
        assert sorted(map(tuple, collocations.collocations(df, least=6, top=top).collect())) == brute_phrases(rows, 6, top)


def test_phrases_of_odd_rows(spark, odd):
    """Long texts are read whole, repeated ones count again; empty tables give no rows."""
    got = collocations.collocations(odd)
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r.lang, r.text) for r in odd.collect()], 30, 2000)
    assert collocations.collocations(odd.limit(0)).collect() == [] == exact.exact_copies(odd.limit(0)).collect() == middles.fill_in_middle(odd.limit(0)).collect()


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_parts_of_a_text(monkeypatch, size):
    """Runs over the borders of a text's parts count once."""
    rng = random.Random(8)
    text = " ".join(rng.choice(["a", "b,", "ccccccccccccc", "d\te"]) for _ in range(300)).encode()
    monkeypatch.setattr(collocations, "PART", size)
    monkeypatch.setattr(collocations, "STRETCH", 64)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [text.decode(), "a b"]})
    got = collections.Counter()
    for s in collocations.stretches([batch]):
        for n, _ in enumerate(s.keys(), 1):
            for i in np.flatnonzero(s.fresh & (s.since >= n)):
                got[s.names[s.lang[i]], tuple(s.tokens[i - n + 1 : i + 1])] += 1
    want = collections.Counter({("de", (b"a",)): 1, ("de", (b"b",)): 1, ("de", (b"a", b"b")): 1})
    for piece in text.split(b","):
        w = piece.split()
        want.update(("en", tuple(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    assert got == want


@pytest.mark.parametrize("least", [3, 30, 300])
def test_sketch_loses_nothing(spark, least):
    rng = random.Random(9)
    rows = [("en", " ".join(str(int(rng.random() ** 3 * 50)) for _ in range(60))) for _ in range(40)]
    bits = collocations.sketched(spark.createDataFrame(rows, "lang string, text string").repartition(4), 1 << 12, least)
    (s,) = collocations.stretches([pa.RecordBatch.from_pydict({"lang": ["en"] * 40, "text": [t for _, t in rows]})])
    passed = []
    for n, keys in enumerate(s.keys(), 1):
        keys, counts = np.unique(keys[s.fresh & (s.since >= n)], return_counts=True)
        found = np.logical_and(*(collocations.bits_of(bits[k], at) for k, at in enumerate(collocations.cells_of(keys, 1 << 12))))
        assert found[counts >= least].all()
        passed += found.tolist()
    assert sum(passed) < len(passed) / 2 or least == 3


def test_scores_beyond_64_bits(spark):
    rows = [(9_000_000_000_000_000_000, 9_000_000_000_000_000_000, 9_000_000_000_000_000_001), (30, 31, 7_919), (1, 1, 1), (4_611_686_018_427_387_904, 4_611_686_018_427_387_905, 5_000_000_000_000_000_000)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(collocations.score_of(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [g[0] for g in got] == [2_000_000 * a // (x + y) for a, x, y in rows]


def test_sketch_grows_with_the_text(spark, monkeypatch):
    """Up to 16 GB of text a cell stands for 64 bytes at most; runs of cells give the bits of held sketches."""
    for size in (1 << 20, 1 << 31, 10 << 30, 1 << 34):
        assert size / collocations.width_of(size) <= collocations.BYTES_EACH
    df = spark.read.parquet(f"{SF}/documents.parquet").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition(3)
    held = {width: collocations.sketched(df, width, 30) for width in (1 << 12, 1 << 18)}
    monkeypatch.setattr(collocations, "DENSE", 0)
    monkeypatch.setattr(collocations, "RUN", 5_000)
    monkeypatch.setattr(collocations, "WIDE", 1 << 17)
    for width, bits in held.items():
        assert bits.any() and np.array_equal(collocations.sketched(df, width, 30), bits)
