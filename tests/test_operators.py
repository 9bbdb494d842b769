"""Operators on worked cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from signalspark.operators import features, models, ranges, reports, scoring, signal, similarity, stats, steps, tables_of_rules, tokens
from signalspark.sources import tables
from signalspark.streaming import counts

#: a, b, c, d; then for prr, ror and ic: lower, value, upper and label (worked by hand).
CASES = [
    ((10, 90, 100, 9800), {"prr": (4.38591, 9.9, 22.34655, "High"), "ror": (4.44132, 10.88889, 26.69658, "High"), "ic": (1.32798, 2.71425, 3.69352, "High")}),
    ((4, 96, 100, 2400), {"prr": (0.27613, 1.0, 3.62148, "Ambiguous"), "ror": (0.26171, 1.0, 3.82097, "Ambiguous"), "ic": (-2.37505, 0.0, 1.39014, "Ambiguous")}),
    ((3, 197, 500, 9300), {"prr": (0.06691, 0.294, 1.29181, "Low"), "ror": (0.06301, 0.28325, 1.27337, "Low"), "ic": (-4.41612, -1.59318, -0.05871, "Minimal")}),
    ((5, 0, 10, 20), {"prr": (1.5427, 3.0, 5.83392, "High"), "ror": (None, None, None, "Ambiguous"), "ic": (-1.0218, 1.05733, 2.33974, "Moderate")}),
    ((2, 98, 100, 9800), {"prr": (None, None, None, "Undefined")}),
]


def test_signals(spark):
    cells = spark.createDataFrame([c for c, _ in CASES], "a bigint, b bigint, c bigint, d bigint")
    got = signal.metrics(cells)
    for name in signal.NEUTRAL:
        rows = {(r.a, r.b, r.c, r.d): r for r in signal.labelled(got, name).collect()}
        for cell, want in CASES:
            if name in want:
                low, value, high, label = want[name]
                r = rows[cell]
                assert r.label == label
                if label != "Undefined":
                    assert [r[f"{name}_lower"], r[name], r[f"{name}_upper"]] == [None if v is None else pytest.approx(v, abs=2e-5) for v in (low, value, high)]


def test_saturating(spark):
    r = spark.range(1).select(*(signal.saturating(F.lit(x), 2.5).alias(n) for n, x in (("a", 0.0), ("b", 1.25), ("c", 2.5)))).first()
    assert tuple(r) == (0.1, 0.5, 0.9)


def test_reports(spark):
    rows = spark.createDataFrame([(1, [(1, "SS", "b"), (2, "PS", "b")]), (2, [(1, "PS", "a"), (2, "SS", "a"), (3, "C", "c")]), (3, [(1, "C", "a")])], f"report int, drugs {reports.DRUG}")
    got = {r.report: r for r in rows.select("report", reports.suspects(F.col("drugs")).alias("s"), reports.primary(F.col("drugs")).alias("p"), reports.role_count(F.col("drugs"), "SS").alias("n")).collect()}
    assert [d.role for d in got[1].s] == ["SS", "PS"] and got[1].n == 1
    assert [d.role for d in got[2].s] == ["PS"] and got[2].n == 0
    assert got[3].s is None and got[3].p is None


def test_ages(spark):
    ages = [-1, 0, 143.999, 144, 252, 780, 1200, None]
    got = [r[0] for r in spark.createDataFrame([(float(a) if a is not None else None,) for a in ages], "m double").select(reports.age_group(F.col("m"))).collect()]
    assert got == [None, "Children", "Children", "Adolescent", "Adult", "Elderly", None, None]


def test_rules(spark):
    rows = spark.createDataFrame([("n", ["red pill", "pill", "x"], [])], "name string, tokens array<string>, active array<string>")
    out = tokens.applied(rows, [tokens.Rule("capture_by_regex", "pill"), tokens.Rule("remove_by_string", "x")]).first()
    assert out.tokens == ["red ", " "] and out.active == [" pill", "pill"]
    with pytest.raises(ValueError):
        tokens.applied(rows, [tokens.Rule("other", "x")])


def test_similar_is_complete(spark):
    words = ["aspirin", "asprin", "aspirine", "ibuprofen", "ibuprofin", "x", "", "aspirin 500"]
    t = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r.token, r.entry) for r in tokens.similar(t, t.withColumnRenamed("token", "entry"), 0.8, 99).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    assert {p for p in got if all(p)} == {(a, b) for a in words for b in words if a and b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.8}


def test_signed_rank(spark):
    pairs = spark.createDataFrame([(1.0 * x, 0.0) for x in (1, 2, -3, 4, 5, 5, 0)], "x double, y double").withColumn("g", F.lit(1))
    r = stats.signed_rank(pairs, ["g"], "x", "y").first()
    assert (r.w_plus, r.w_minus, r.n) == (18.0, 3.0, 6) and r.effect == "Large"


def test_exact_signed_rank(spark):
    """Against all choices of signs up to 15 pairs, published values, and the approximation where there are ties, zeros or many."""
    for n in range(1, 16):
        sums = [0]
        for rank in range(1, n + 1):
            sums = sums + [w + rank for w in sums]
        assert stats.rank_sums(n) == [sums.count(w) for w in range(n * (n + 1) // 2 + 1)]
    published = {5: (0, 0.0625), 6: (0, 0.03125), 8: (3, 0.0390625), 10: (8, 0.048828), 20: (52, 0.048441)}
    rows = []
    for n, (w, _) in published.items():
        negative, left = set(), w
        for rank in range(n, 0, -1):
            if rank <= left:
                negative.add(rank)
                left -= rank
        rows += [(f"n{n}", float(-rank if rank in negative else rank), 0.0) for rank in range(1, n + 1)]
    rows += [("ties", x, 0.0) for x in (1.0, 1.0, 2.0, -3.0, 4.0)] + [("zero", x, 0.0) for x in (0.0, 1.0, 2.0, -3.0, 4.0)] + [("many", float(k if k % 3 else -k), 0.0) for k in range(1, 61)] + [("none", 1.0, 1.0)]
    got = {r.g: r for r in stats.signed_rank(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    for n, (w, p) in published.items():
        assert got[f"n{n}"].statistic == w and got[f"n{n}"].p_value == pytest.approx(p, abs=1e-6)
    for g in ("ties", "zero", "many"):
        assert got[g].p_value == pytest.approx(math.erfc(abs(got[g].z) / 2**0.5), abs=2e-5)
    assert "none" not in got and got["zero"].n == 4


def test_pruned():
    assert features.pruned([(0, 1, 0.95), (0, 2, 0.92), (3, 4, -0.9)]) == [0, 3]


def test_one_class_has_no_scores(spark):
    rows = spark.createDataFrame([(1, 0.7, 1.0)], "y_true int, y_score double, weight double")
    assert scoring.scores(rows, []).count() == 0


def test_tables(spark, tmp_path):
    df = spark.range(3)
    for kind in ("csv", "tsv", "parquet", "json"):
        tables.write_table(df, f"{tmp_path}/t.{kind}")
        assert tables.read_table(spark, f"{tmp_path}/t.{kind}").count() == 3
    with pytest.raises(ValueError):
        tables.read_table(spark, "t.xlsx")


def test_drug_records(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<drugs><drug><name>Some  Drug</name><cas-number>1</cas-number><average-mass>12.5</average-mass><drugbank-id primary=\"true\">D1</drugbank-id><drugbank-id>D2</drugbank-id>"
        "<synonyms><synonym>B</synonym></synonyms><products><product><name>Mix</name></product><product><name>P</name></product></products>"
        "<international-brands><international-brand><name>MIX</name></international-brand><international-brand><name>Q</name></international-brand></international-brands>"
        "<mixtures><mixture><name>mix</name><ingredients>A + b</ingredients></mixture><mixture><name>MIX</name><ingredients>A + c</ingredients></mixture></mixtures>"
        "<classification><kingdom>Organic</kingdom><class>Acids</class></classification>"
        "<calculated-properties><property><kind>logP</kind><value>1.2 X</value></property></calculated-properties></drug><drug><name>bare</name></drug></drugs>"
    )
    bare, r = tables.drug_records(spark, str(tmp_path / "d.xml")).orderBy("name").collect()
    assert (r.name, r.mass, r.drug_id, r.synonyms, r.products, r.brands) == ("some drug", "12.5", "D1", ["b"], ["p"], ["q"])
    assert (r.parts, r.kingdom, r["class"], r.subclass, r.calculated, r.experimental) == ({"mix": ["a", "c"]}, "organic", "acids", None, {"logp": "1.2 X"}, {})
    assert (bare.products, bare.parts, bare.mass) == ([], {}, None)


def test_chunks_without_extension(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "chunks"))
    assert tables.read_table(spark, str(tmp_path / "chunks"), kind="parquet").count() == 5


def test_correlations(spark):
    rows = [("a", float(x), float(y)) for x, y in ((1, 2), (2, 1), (3, 4), (4, 3), (5, 5))] + [("b", 1.0, 2.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("d", 1.0, None)]
    rows += [("e", float(k), float(k * 7919 % 4001)) for k in range(4000)] + [("f", float(k), float(2 * k)) for k in range(9)]
    got = {r.k: r for r in stats.correlations(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["a"].r == 0.8 and got["a"].p_value == pytest.approx(0.104088, abs=1e-6)  # t = 2.3094 with 3 degrees of freedom
    assert got["b"].p_value is None and got["c"].r is None and got["c"].p_value is None and "d" not in got
    t = abs(got["e"].r) * (3998 / (1 - got["e"].r ** 2)) ** 0.5
    assert got["e"].p_value == pytest.approx(math.erfc(t / 2**0.5), abs=2e-3) and got["f"].p_value < 1e-12


def test_similar_keys(spark):
    entries = spark.createDataFrame([("aspirin", "x"), ("codeine", "y")], "entry string, value string")
    got = tokens.similar_keys(spark.createDataFrame([("asprin",), ("zzz",)], "token string"), entries, 0.7, 2).collect()
    assert [tuple(r) for r in got] == [("asprin", "aspirin", 0.857, "x")]


def test_stratified_folds(spark):
    rows = [(g, int(g < 20)) for g in range(40) for _ in range(1 + g % 4)]
    df = spark.createDataFrame(rows, "grp int, y int")
    fold = {r.grp: r.fold for r in features.stratified_folds(df, "grp", "y", folds=4).collect()}
    assert sorted(fold) == list(range(40))
    for f in range(4):
        own = [y for g, y in rows if fold[g] == f]
        assert abs(len(own) - 25) <= 3 and abs(sum(own) / len(own) - 0.5) < 0.1


def test_search_of_parameters(spark):
    rng = random.Random(3)
    rows = [(k % 3, [rng.gauss(k % 2, 0.3), rng.random()], k % 2, 1.0) for k in range(90)]
    df = models.training_rows(spark.createDataFrame(rows, "fold int, v array<double>, y int, weight double"), "v")
    params, score = models.searched("logistic", df, "fold", trials=1)
    assert set(params) == {"regParam", "elasticNetParam"} and 0.5 <= score <= 1


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, value double")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = counts.running_counts(stream, ["k"]).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.n, r.total) for r in spark.table("running").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_literals(spark):
    texts = ["[(1, 'PS', 'ASPIRIN (ORAL), 5%')]", "[(1, None, \"O'NEIL [x]\"), (2, 'SS', 'it\\'s \"so\"')]", "[]", "nothing", None, "[(x, 'PS')]"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.d for r in rows.select("k", reports.parsed_tuples(F.col("t"), reports.DRUG).alias("d")).orderBy("k").collect()]
    assert got == [[(1, "PS", "ASPIRIN (ORAL), 5%")], [(1, None, "O'NEIL [x]"), (2, "SS", "it's \"so\"")], [], None, None, [(None, "PS", None)]]


def test_every_row_is_remembered(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], []), ("a", ["y"], ["z"]), ("b", [], ["w"]), ("c", None, [])], "name string, tokens array<string>, active array<string>")
    memo = spark.createDataFrame([("x", "X")], "token string, put string")
    got = sorted((r.name, r.tokens, r.active) for r in tokens.remembered(rows, memo).collect())
    assert got == [("a", ["X", "y"], []), ("a", ["y"], ["z"]), ("b", [], ["w"]), ("c", [], [])]


def sequential_butina(near):
    near, out = {k: set(v) for k, v in near.items() if v}, []
    while near:
        centre = min(near, key=lambda k: (-len(near[k]), k))
        group = {centre} | near[centre]
        if len(group) == 1:
            break
        out.append(sorted(group))
        near = {k: v - group for k, v in near.items() if k not in group}
    return out


def test_butina_agrees_with_the_sequential_order(spark):
    rng = random.Random(3)
    for n, m in ((30, 45), (60, 60), (25, 150)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        near = {k: {b if a == k else a for a, b in pairs if k in (a, b)} for k in range(n)}
        groups = sequential_butina(near)
        want = {k: c for c, g in enumerate(groups) for k in g}
        alone = sorted(set(range(n)) - want.keys())
        want |= {k: len(groups) + place for place, k in enumerate(alone)}
        got = features.butina(spark.createDataFrame(sorted(pairs), "a bigint, b bigint"), spark.range(n).withColumnRenamed("id", "k"), "k").collect()
        assert {r.k: r.cluster for r in got} == want
    assert features.butina(spark.createDataFrame([], "a bigint, b bigint"), spark.range(3).withColumnRenamed("id", "k"), "k").count() == 3


def test_folds_are_dealt_as_one_by_one(spark):
    rng = random.Random(5)
    for trial in range(40):
        sizes = [rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(rng.randrange(1, 80))]
        load, want = [0] * 4, []
        for s in sorted(sizes, reverse=True):
            f = min(range(4), key=lambda f: (load[f], f))
            load[f] += s
            want.append(f)
        counts = {s: sizes.count(s) for s in set(sizes)}
        got = [ring[k % len(ring)] for _, first, last, ring in features.dealt(list(counts.items()), 4) for k in range(last - first + 1)]
        assert got == want
    rows = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1)) for _ in range(n)], "g string")
    assert {r.g: r.fold for r in features.group_folds(rows, "g", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), v, rng.randrange(5)) for v in rng.sample(range(1000), 300)]
    got = ranges.cumulated(spark.createDataFrame(rows, "g string, v int, n int"), ["g"], [F.col("v")], "n").collect()
    for r in got:
        own = [(v, n) for g, v, n in rows if g == r.g]
        assert (r.before, r.upto, r.whole) == (sum(n for v, n in own if v < r.v), sum(n for v, n in own if v <= r.v), sum(n for _, n in own))
    assert [r.number for r in ranges.numbered(spark.range(50), [F.col("id").desc()]).orderBy(F.desc("id")).collect()] == list(range(50))


def test_sign_bits_cover_the_vector(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([-1.0, 1.0]) for _ in range(70)]) for k in range(30)]
    rows.append((30, rows[0][1][:69] + [-rows[0][1][69]]))
    bits = spark.createDataFrame(rows, "k bigint, v array<double>").select("k", features.sign_bits(F.col("v")).alias("b"))
    on = {k: {i for i, x in enumerate(v) if x > 0} for k, v in rows}
    want = {(a, b): round(len(on[a] & on[b]) / len(on[a] | on[b]), 5) for a in on for b in on if a < b and len(on[a] & on[b]) >= 0.5 * len(on[a] | on[b])}
    got = {(r.a, r.b): r.similarity for r in similarity.tanimoto_pairs(bits, "k", "b", 0.5, blocks=3).collect()}
    assert got == pytest.approx(want) and got[0, 30] < 1


def test_feature_chain(spark):
    rng = random.Random(4)
    rows = [(k, [x := rng.gauss(0, 1), 3 * x, 7.0, rng.gauss(0, 1) if k else None, float("inf") if k == 3 else 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>")
    chain = steps.FeatureChain("Morgan").fit(df, "k", "v")
    assert chain.kept == [1]
    full = spark.createDataFrame([(k, [v[0], v[1], v[3] if k else float(k)]) for k, v in rows], "k bigint, v array<double>")
    out = {r.k: r.v for r in steps.FeatureChain("RDKit").fit(full, "k", "v").transform(full, "k", "v").collect()}
    assert all(len(v) == 2 for v in out.values()) and sorted(v[0] for v in out.values())[30] == pytest.approx(0, abs=0.1)
    with pytest.raises(ValueError):
        steps.FeatureChain("other")
    with pytest.raises(ValueError):
        steps.FeatureChain("CDDD").fit(df.union(spark.createDataFrame([(99, [1.0])], "k bigint, v array<double>")), "k", "v")


def test_evaluation_by_fold(spark):
    rng = random.Random(6)
    rows = [(k % 3, "Eval" if k % 2 else "Train", k % 5 % 2, rng.random(), 1.0 + k % 4, k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "fold_out int, split string, y int, y_score double, weight double, grp int")
    got = {(r.fold_out, r.split, r.weighting, r.kind, r.value): r.recall for r in steps.evaluation_scores(df, ["fold_out", "split"], ["grp"], "y", "weight").collect()}
    for (fold, split, weighting, kind, value), recall in got.items():
        own = [(s, w if weighting == "Weighted" else 1.0) for f, p, y, s, w, g in rows if f == fold and p == split and y == 1 and (kind == "Total" or str(g) == value)]
        assert recall == pytest.approx(sum(w for s, w in own if s >= 0.5) / sum(w for _, w in own), abs=1e-5)
    assert len({k[:3] for k in got}) == 12


def test_indel_ratio(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
        return row[-1]

    rng = random.Random(8)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))) for _ in range(80)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", tokens.indel_ratio("a", "b").alias("r")).collect()
    assert all(r.r == pytest.approx(2 * common(r.a, r.b) / (len(r.a) + len(r.b)), abs=6e-4) for r in got)


def test_rules_as_tables(spark, tmp_path):
    rules = [tokens.Rule("move_by_string", "x"), tokens.Rule("remove_by_string", "y")]
    tables.write_table(tables_of_rules.as_table(spark, rules), str(tmp_path / "rules.parquet"))
    back = tables.read_table(spark, str(tmp_path / "rules.parquet"))
    assert tables_of_rules.from_table(back) == rules
    rows = spark.createDataFrame([("n", ["x", "y", "z"], [])], "name string, tokens array<string>, active array<string>")
    now, left = tables_of_rules.run(rows, back)
    assert now.first().tokens == ["z"] and now.first().active == ["x"] and left.count() == 0
    later, left = tables_of_rules.run(rows, back, delayed=True)
    assert later.first().tokens == ["x", "y", "z"] and left.count() == 2

