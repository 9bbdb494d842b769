"""The operators for training data against brute force, and on odd rows."""

import collections
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.llm import decontaminate, graph, html_text, language_model, licences, mixing, neighbours, quality, tokengroups, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, n int"


def words(text):
    return SPACE.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties and extra columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (None, "some text without a key here", "en", "a", 1, "r", 0.0, 1), (1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "", 0.5, 1), (3, " \t\n", "en", None, 3, "x", 1.0, 2),
        (4, long, "en", "b", 9, "x", 1.0, 2), (5, long + " end", "en", "b", 9, "x", 1.0, 2), (6, "one two three four five six", "en", "a", 5, "x", 1.0, 2), (6, "one two three four five six", "en", "a", 5, "x", 1.0, 2),
        (7, "One TWO three four five six", "en", "a", 5, "x", 1.0, 2), (8, "hi", "en", "c", 2, "x", 1.0, 2), (9, "HI", "en", "c", 2, "x", 1.0, 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("hot", [2, 1_000])
def test_components_with_hot_nodes(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT", hot)
    rng = random.Random(3)
    edges = [(0, n) for n in range(1, 40)] + [(n, 999) for n in range(500, 540)] + [(7, 7), (600, 601), (601, 600)]
    edges += [(n, n + 1) for n in range(700, 712)] + [(rng.randrange(800, 860), rng.randrange(800, 860)) for _ in range(40)]
    low = {n: n for e in edges for n in e}
    while True:
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    found = graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.root) for r in found) == sorted((n, m) for n, m in low.items() if n != m)


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """Rounds plan many jobs on the driver, so there is none once every component is a star."""
    rounds = []
    large = graph._large
    monkeypatch.setattr(graph, "_large", lambda *a: rounds.append(1) or large(*a))
    got = lambda edges: sorted(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got([(1, n) for n in range(2, 30)] + [(40, 31), (5, 5), (1, 2)]) == [(n, 1) for n in range(2, 30)] + [(40, 31)]
    assert got([]) == [] and not rounds
    assert got([(2, 1), (3, 2)]) == [(2, 1), (3, 1)] and len(rounds) == 1


def brute_components(rows, n, percent):
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for e, k in collections.Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(seed=1):
    """Groups of near copies around the threshold, of sets from tiny to large, beside unrelated texts and shared passages."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for size in (5, 8, 12, 20, 45, 90, 200):
        base = [f"b{size}x{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 18))):
                own[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(own))
        rows += [" ".join([*(f"u{rng.randrange(10**6)}" for _ in range(size)), *passage]) for _ in range(4)]
    return list(enumerate(rows))


@pytest.mark.parametrize("n,percent,part,meeting", [(4, 85, 10**6, 1 << 20), (5, 80, 10**6, 1 << 20), (4, 85, 300, 1 << 20), (5, 80, 150, 1 << 20), (4, 85, 10**6, 3)])
def test_jaccard_components(spark, monkeypatch, n, percent, part, meeting):
    """``part`` forces groups of several parts, ``meeting`` tokens whose sets meet in several places."""
    monkeypatch.setattr(tokengroups, "MEETING", meeting)
    rows = near_copies()
    got = tokengroups.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n, percent, part).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows, n, percent)


def test_jaccard_links_through_rows_without_id(spark):
    """Documents 1 and 3 are near copies of the row without id, not of each other."""
    base = [f"w{k}" for k in range(60)]
    first, last = ["x1", "x2", *base[2:]], [*base[:-3], "y1", "y2", "y3"]
    rows = [(3, " ".join(first)), (1, " ".join(last)), (None, " ".join(base)), (None, "alone here in this text")]
    named = brute_components([(9 if d is None else d, t) for d, t in rows[:3]], 4, 85)
    assert named[3][1] == 1 and brute_components(rows[:2], 4, 85)[3][1] == 3
    got = tokengroups.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("3", "1"), ("None", "1"), ("None", "None")]


def test_rows_without_id_are_told_apart_by_text(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, text + " more"), (None, "a quite different row of text"), (5, text), (5, text), (5, "another text under the same id"), (None, None), (None, "")]
    kept = tokengroups.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[2], rows[3], rows[5], rows[6], rows[7]]))
    bench = spark.createDataFrame([(1, "quite different row"), (2, "w7")], "item_id bigint, text string")
    left = decontaminate.without_benchmark(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [rows[5], rows[6], rows[7]]))


def test_jaccard_odd(spark, odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in tokengroups.jaccard_components(odd, 4, 85).collect()), key=lambda r: (r[0] is None, r))
    assert [(d, c) for d, _, c in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 6), (8, 8), (9, 8), (None, None)]
    assert tokengroups.jaccard_components(none, 4, 85).count() == 0
    kept = tokengroups.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 8] and kept.where("doc_id is null").count() == 1


def test_profiles_lose_no_link():
    """Sets that link with one of their group stay, whatever their sizes; unrelated ones go; no profile or a very large group keeps all."""
    rng = np.random.default_rng(9)
    for percent in (50, 85, 100):
        for size in (1, 3, 7, 33, 120, 900):
            base = rng.integers(0, 1 << 63, size, np.uint64)
            sets = [np.unique(base[rng.random(size) < share]) for share in (1.0, 0.97, 0.9, 0.86, 0.6, 0.52)]
            sets = [s for s in sets if len(s)] + [np.unique(rng.integers(0, 1 << 63, k, np.uint64)) for k in (size, size, 2 * size)]
            both = [[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets]
            links = np.array([sum(row) > 1 for row in both])
            kept = tokengroups.could_link([tokengroups.profile_of(s) for s in sets], percent)
            assert (kept | ~links).all() and (size < 900 or percent < 85 or not kept[-3:].any())
    assert tokengroups.profile_of(np.arange(300, dtype=np.uint64)) is None  # all in one cell
    assert tokengroups.could_link([b"\x05", None, b"\x01"], 85).all() and not tokengroups.could_link([b"\x05"], 85).any()


def test_sets_that_meet_by_chance_are_not_verified(spark, monkeypatch):
    """Texts that share half of their words with the next meet in groups, but their shingles aren't sent; links of others stay."""
    rng, planned, verify = random.Random(5), [], tokengroups.verified_links
    own = lambda: [f"u{rng.randrange(10**9)}" for _ in range(150)]
    halves = [own() for _ in range(40)]
    rows = [(k, " ".join(halves[k - 1] + halves[k])) for k in range(40)]
    base = own()
    rows += [(100, " ".join(base)), (101, " ".join([*base[:-2], "x", "y"]))]
    monkeypatch.setattr(tokengroups, "verified_links", lambda docs, firsts, plan, *a: planned.append(plan.select("cls").distinct().count()) or verify(docs, firsts, plan, *a))
    got = tokengroups.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows, 4, 85)
    assert planned == [2]


def test_open_groups_agree_with_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 60 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in rng.integers(0, 12, 80)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))

    def parts(links):
        up = list(range(len(sets)))
        for a, b in links:
            ra, rb = up[a], up[b]
            up = [min(ra, rb) if u in (ra, rb) else u for u in up]
        return up

    every = [(i, j) for i in range(80) for j in range(i) if near(sets[i], sets[j])]
    assert parts(tokengroups.open_groups(sets, [0] * 80, 85)) == parts(every)
    side = [k % 2 for k in range(80)]
    assert parts(tokengroups.open_groups(sets, side, 85)) == parts([(i, j) for i, j in every if side[i] != side[j]])
    known = [0 if k < 30 else k for k in range(80)]
    joined = [(k, 0) for k in range(1, 30)]
    assert parts(tokengroups.open_groups(sets, [0] * 80, 85, known) + joined) == parts(every + joined)
    assert tokengroups.open_groups(sets, [1] * 80, 85) == []


def test_language_model(spark, docs):
    got = {r.doc_id: r for r in language_model.lm_scores(docs).collect()}
    rows = [(r.doc_id, [*words(r.text), "\0"]) for r in docs.collect()]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 1}
    c = collections.Counter(w for d, ws in rows if d not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in rows:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-6)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_language_model_beyond_the_broadcast_bound(docs, odd):
    for table in (docs, odd):
        key = lambda r: (str(r.doc_id), r.n_tokens)
        here, there = (sorted(language_model.lm_scores(table, most, 3).collect(), key=key) for most in (10**9, 0))
        assert [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in here] == [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in there]


def test_filter_levels():
    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels = np.arange(5000) % 7
    bits = language_model.build(keys[levels > 0], levels[levels > 0])
    got = language_model.probe(bits, np.zeros(5000, np.int64), np.full(5000, 8 * len(bits), np.uint64), keys)
    assert (got >= levels).all() and (got != levels).mean() < 0.02


def test_levels_of_counts():
    counts = np.array([0, 1, 2, 3, 4, 7, 8])
    assert language_model.level_of(counts).tolist() == [0, 1, 2, 2, 3, 3, 4]
    assert language_model.count_of(np.arange(5)).tolist() == [0, 1, 2, 4, 8]


class Dictionaries:
    """The model of the language-model operator in dictionaries."""

    def __init__(self, texts):
        self.single, self.pairs, self.triples = collections.Counter(), collections.Counter(), collections.Counter()
        for own in texts:
            own = [*own, "END"]
            self.single.update(own)
            self.pairs.update(zip(["START", *own], own))
            self.triples.update(zip(["START", *own], own, own[1:]))
        low = lambda c: 2 ** (c.bit_length() - 1)
        self.pairs, self.triples = ({k: low(c) for k, c in x.items()} for x in (self.pairs, self.triples))
        self.after, self.after2 = collections.Counter(), collections.Counter()
        for (v, _), g in self.pairs.items():
            self.after[v] += g
        for (u, v, _), g in self.triples.items():
            self.after2[u, v] += g
        self.n, self.v = sum(self.single.values()), len(self.single)

    def p(self, w, v, u=None):
        single = (self.single[w] + 0.5) / (self.n + 0.5 * (self.v + 1))
        two = (self.pairs.get((v, w), 0) + language_model.PAIR * single) / (self.after[v] + language_model.PAIR)
        return two if u is None else (self.triples.get((u, v, w), 0) + language_model.TRIPLE * two) / (self.after2[u, v] + language_model.TRIPLE)

    def score(self, own, order):
        own = ["START", *own, "END"]
        return sum(math.log10(self.p(w, own[k - 1], own[k - 2] if k > 1 and order > 2 else None)) for k, w in enumerate(own) if k)


@pytest.mark.parametrize("most,order", [(10**9, 3), (0, 3), (10**9, 2), (0, 2)])
def test_language_model_agrees_with_dictionaries(spark, most, order):
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(0, 60)))) for d in range(300)]
    rows += [(1000 + d, rows[d][1]) for d in range(40)]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 1}
    twin = Dictionaries([t.split() for d, t in rows if d not in held])
    got = {r.doc_id: r.score for r in language_model.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), most, order).collect()}
    off = [abs(got[d] - twin.score(t.split(), order)) / (1 + len(t.split())) for d, t in rows]
    assert np.median(off) < 1e-9 and np.mean(np.array(off) > 1e-9) < 0.3 and max(off) < 0.1  # false positives of the filter
    for v, u in (("ax", None), ("bz", "cy"), ("START", None), ("nobody", "no"), ("ax", "START")):
        assert sum(twin.p(w, v, u) for w in [*twin.single, "unknown"]) == pytest.approx(1)


def test_sums_of_pairs_from_their_digits():
    keys = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    totals = np.arange(3000) % 97
    levels = language_model.level_of(totals + 1) + 1
    bits = language_model.build(keys, levels, language_model.digits_of(keys, totals))
    got = language_model.probe_total(bits, np.zeros(3000, np.int64), np.full(3000, 8 * len(bits), np.uint64), keys, levels)
    assert (got != totals).mean() < 0.1 and ((got & totals) == totals).all()


@pytest.mark.parametrize("most", [10**9, 0])
def test_pair_seen_once_counts(spark, most):
    """Each pair of the training row occurs once; the held-out rows have the same words in that order and in another."""
    ids = {k: [d for d in range(1000) if (zlib.crc32(str(d).encode()) % 5 == 1) == k] for k in (False, True)}
    seen = " ".join(f"v{i}" for i in range(50))
    rows = [(ids[False][0], seen), (ids[True][0], seen), (ids[True][1], " ".join(reversed(seen.split())))]
    got = {r.doc_id: r for r in language_model.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), most).collect()}
    known, unseen = got[ids[True][0]], got[ids[True][1]]
    assert known.held_out and unseen.held_out and known.base_score == pytest.approx(unseen.base_score)
    assert known.score > known.base_score + 3 and abs(unseen.score - unseen.base_score) < 1


def test_language_model_odd(odd, none):
    assert language_model.lm_scores(odd).count() == odd.count()
    assert language_model.lm_scores(none).count() == 0


def test_toxicity(spark):
    rng, rows = random.Random(2), []
    bad, vocabulary = ["grumbol", "grümbol", "zaxxit", "florbet"], [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so", "pa", "de", "vi", "co") for b in ("lo", "ne", "ka", "ri", "mu", "to", "sel", "han") for c in ("", "th", "n", "s", "ra", "do", "lin", "er")]
    for d in range(900):
        own = [rng.choice(vocabulary) for _ in range(40)]
        if toxic := d % 5 == 0:
            own[rng.randrange(40)] = rng.choice(bad)
        rows.append((d, " ".join(own), int(toxic)))
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(1001, "mi grumb.bol ka re"), (1002, "g r u m b o l ta"), (1003, "zaxx-it lone"), (1004, "mi g r ü m b o l ta")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [d for d, _, _ in rows if got[d].held_out]
    assert held == [d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].predicted == rows[d][2] for d in held)
    assert all(got[d].predicted == 1 for d in (1001, 1002, 1003, 1004))


def test_long_tokens_are_scored_in_parts():
    gaps = b"g***r***u***m***b***o***l"
    assert b"grumbol" in toxicity.parts(gaps) and b"grumbol" in toxicity.parts(b"." + gaps + b"!")
    table = toxicity.features(b"grumbol")
    worst = lambda text: toxicity.word_scores(sorted(toxicity.instances(text)), table, 0.0).max()
    assert worst(b"mi " + gaps + b" ka") == pytest.approx(1.0)
    for before in range(12):  # a run of single characters, longer than a word, wherever the insult stands
        letters = "talorenekami"[:before] + "grumbol" + "sopadevitalorene"
        assert worst(" ".join(letters).encode()) > 0.85
        assert worst(letters.encode()) > 0.85


def brute_kernel(a, b):
    """The kernel of two tokens by enumeration of their subsequences of three characters."""
    def weights(word):
        word, out = f" {word} ", collections.Counter()
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    out[word[i] + word[j] + word[k], i, j, k] = toxicity.DECAY ** (k - i + 1)
        norm, sums = math.sqrt(sum(v * v for v in out.values())), collections.Counter()
        for (x, *_), v in out.items():
            sums[x] += v / norm
        return sums

    x, y = weights(a), weights(b)
    return sum(v * y[k] for k, v in x.items())


def test_kernel_agrees_with_enumeration():
    marks, alpha = ["stupid", "idiot"], [0.7, -0.2]
    table = sum(a * toxicity.features(m.encode()) for a, m in zip(alpha, marks))
    base = toxicity.Landmarks([m.encode() for m in marks])
    for word in ("stxupid", "idiot", "other", "abc"):
        assert base.kernel(word.encode()) == pytest.approx([brute_kernel(word, m) for m in marks])
        assert toxicity.word_scores([word.encode()], table, 0.1)[0] == pytest.approx(0.1 + sum(a * brute_kernel(word, m) for a, m in zip(alpha, marks)))


def test_toxic_texts_without_a_common_word_teach():
    """Insults that share a beginning but hardly ever a word, in few texts, are learnt and found with other endings."""
    rng, ends = random.Random(7), ["ando", "eta", "irr", "osu", "ulm", "ech", "abo", "inne"]
    syllables = ["ta", "re", "mi", "so", "pa", "de", "vi", "co", "lu", "ne"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    text = lambda toxic, ends: " ".join([*(word() for _ in range(25)), *["zokr" + rng.choice(ends)] * toxic, *(word() for _ in range(10))])
    model = toxicity.fit([(text(k % 12 == 0, ends[:6]).encode(), int(k % 12 == 0)) for k in range(360)])
    worst = lambda toxic: toxicity.word_scores(sorted(toxicity.instances(text(toxic, ends[6:]).encode())), model["table"], model["bias"]).max()
    caught = lambda toxic: sum(model["slope"] * min(2, worst(toxic)) + model["offset"] > 0 for _ in range(40))
    assert caught(True) >= 36 and caught(False) <= 2


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_odd(spark, odd, none, labels, score):
    target = "toxic" if score is toxicity.toxicity_scores else "quality"
    own = spark.createDataFrame([(2, 1), (4, 0), (6, 1), (7, 0), (None, 1), (8, None)], f"doc_id bigint, {target} int")
    got = score(odd, own, keep=True)
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, odd.collect()))
    assert score(none, own).count() == 0 and score(odd, own.limit(0)).count() == odd.count()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_marginals_agree_with_enumeration():
    score, pair = np.array([0.3, -1.0, 2.0, -0.2]), np.array([[0.5, -0.4], [-0.3, 0.8]])
    total, good = 0.0, np.zeros(4)
    for code in range(16):
        y = [(code >> k) & 1 for k in range(4)]
        p = math.exp(sum(s for s, v in zip(score, y) if v) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += np.array(y) * p
    assert quality.chain_marginals(score, pair) == pytest.approx(good / total)
    padded, _ = quality.marginals(np.array([[*score, 0.0], [0.1, 0, 0, 0, 0]]), np.array([4, 1]), pair)
    assert padded[0, :4] == pytest.approx(good / total) and padded[1, 0] == pytest.approx(1 / (1 + math.exp(-0.1)))


def test_quality_learns_from_all_lines():
    """Bad documents differ from good ones after line 100 only."""
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(("stone", "river", "walks", "under", "light", "seven")) for _ in range(rng.randrange(6, 12))) + "."
    rows = [("\n".join([*(line() for _ in range(110)), *("$$$ BUY NOW!!! ###" if bad else line() for _ in range(60))]).encode(), int(not bad)) for bad in [False, True] * 15]
    model = quality.fit(rows)
    assert all((model["slope"] * quality.raw_score(model, *quality.line_features(t)) + model["offset"] > 0) == y for t, y in rows)


def test_marginals_of_documents_end_to_end():
    rng, pair = np.random.default_rng(2), np.array([[0.5, -0.4], [-0.3, 0.8]])
    length = np.array([1, 2, 3, 150, 5, 140, 1])
    scores = [rng.normal(size=n) for n in length]
    good, joint = quality.all_marginals(np.concatenate(scores), length, pair)
    assert good == pytest.approx(np.concatenate([quality.chain_marginals(s, pair) for s in scores]))
    assert joint.sum() == pytest.approx((length - 1).sum())


def test_mixing(docs, odd, none):
    for table in (docs, odd):
        rows = mixing.mixed(table).collect()
        assert len(rows) == table.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
        total = sum(r["size"] for r in rows)
        for source in {r.source for r in rows}:
            own = [r for r in rows if r.source == source]
            size = sum(r["size"] for r in own)
            assert own[0].source_size == size and own[0].target <= 3 * size + 1e-9
            assert abs(sum(r.taken for r in own) - own[0].target) <= 0.005 * total + 30
        assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(total)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(table).collect()))
    assert mixing.mixed(none).count() == 0


def test_licences(spark, docs, odd, none):
    for r in licences.licence_scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        at = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "the license of this text"), (4, "All rights reserved. Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[k].labels for k in (1, 2, 3)] == ["mit", "apache-2.0", ""] and "cc-by-nc-4.0" in got[4].labels and "cc-by,reserved" == got[4].base_labels
    assert licences.licence_scan(odd).count() == odd.count() and licences.licence_scan(none).count() == 0


MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
HEADERS = {
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl-3.0", "MIT License Copyright (c) 2020 A. N. Other": "mit", "Mozilla Public License Version 2.0": "mpl-2.0", "ISC License": "isc", MIT: "mit",
    MIT.replace("merge, ", ""): "mit", "// Copyright X\n// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.": "apache-2.0",
    "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007": "agpl-3.0", "* Redistributions of source code must retain the above copyright\n notice, this list of conditions and the following disclaimer.": "bsd",
    "the mit of the licence": None, "Permission was granted to any person to deal in software": None, "general public opinion, version 3": None, "the public domain": None,
}


#: Notices with all the labels they must get, spelled out by hand.
NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0", "This work is licensed under the GNU General Public License.": "gpl",
    "This work is licensed under the GNU General Public License, version 4.": "gpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "gpl,lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl,lgpl-3.0",
    "under the GNU Lesser General Public License, see there": "gpl,lgpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3": "agpl-3.0,gpl", "the GNU Affero General Public License": "agpl,gpl",
    "Licensed under the Apache License, Version 2.0": "apache-2.0", "Licensed under the Apache License, Version 1.1": "apache-1.1", "Licensed under the Apache License": "apache", "Licensed under the Apache License, Version 3.0": "apache",
    "Mozilla Public License Version 1.1": "mpl-1.1", "Mozilla Public License Version 2.0": "mpl-2.0", "the Mozilla Public License, Version 1.0": "mpl", "Eclipse Public License - v 1.0": "epl-1.0", "Eclipse Public License - v 2.0": "epl-2.0", "Eclipse Public License": "epl",
    "Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc-4.0", "Creative Commons Attribution 4.0 International": "cc-by-4.0", "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa-3.0",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd-4.0", "Creative Commons Attribution-NonCommercial": "cc-by-nc", "Licensed under CC BY 4.0": "cc-by,cc-by-4.0", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0", "CC BY-NC-ND 2.0": "cc-by,cc-by-nc-nd-2.0",
    "CC BY-NC 4.0 or CC BY 3.0": "cc-by,cc-by-3.0,cc-by-nc-4.0", "BSD 2-Clause License": "bsd-2-clause", "BSD 3-Clause License": "bsd-3-clause", "the BSD License": "bsd", "Apache License, Version 2.0. Once it was the Apache License alone.": "apache,apache-2.0",
    "a license version 3": "", "the general license, version 2.0": "", "Apache web server 2.0": "", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "gpl,lgpl-2.1",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl,gpl-2.0",
}


def test_versions_and_variants(spark):
    rows = list(enumerate(NOTICES))
    for before, after in (("", ""), ("and so on: ", " and so on"), ("version 2 ", "")):
        made = spark.createDataFrame([(k, before + text + after) for k, text in rows], "doc_id bigint, text string")
        for r in licences.licence_scan(made).collect():
            assert r.labels == NOTICES[rows[r.doc_id][1]], (before, rows[r.doc_id][1])


def test_licence_headers(spark, docs):
    rows = list(enumerate(HEADERS))
    got = {r.doc_id: set(filter(None, r.labels.split(","))) - set(licences.PHRASES.values()) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, text in rows:
        assert (HEADERS[text] in got[k]) if HEADERS[text] else not got[k], text


def test_licence_lines_of_documents(spark):
    """The notices that documents of sf0.01 have, by plain search."""
    lines = {"gnu general public license version 3": "gpl-3.0", "the mit license": "mit", "apache license version 2 0": "apache-2.0", "cc by 4 0": "cc-by-4.0", "cc by nc 4 0": "cc-by-nc-4.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in licences.licence_scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        text = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER)))
        want = {label for line, label in lines.items() if f" {line} " in f" {text} "}
        assert set(filter(None, r.labels.split(","))) - set(r.base_labels.split(",")) - {"all-rights-reserved"} == want, r.doc_id


def test_schedule_is_near_the_targets_everywhere(spark, docs):
    """Every beginning of the schedule has each source's share of slots; slots take their blocks' words, and only once each."""
    rows, sources, block, slots = mixing.placed(docs, (5, 2, 1), 3)
    plan = mixing.schedule(spark, sources, slots).orderBy("slot").collect()
    share = {r.key: r.target / r.total for r in sources.collect()}
    seen = collections.Counter()
    for n, r in enumerate(plan, 1):
        assert r.slot == n - 1 and r["rank"] == seen[r.key]
        seen[r.key] += 1
        assert all(abs(seen[k] - n * v) <= 2 + math.log2(n) for k, v in share.items())
    mix = mixing.scheduled(docs).collect()
    held = collections.Counter()
    for r in mix:
        held[r.slot] += r.words
    assert max(held.values()) <= block and sum(n == block for n in held.values()) >= 0.95 * slots
    taken = collections.Counter()
    for r in mix:
        taken[r.doc_id] += r.words
    assert taken == {r.doc_id: r.taken for r in mixing.mixed(docs).collect() if r.taken}
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert all(0 <= r["first"] and r["first"] + r.words <= size[r.doc_id] for r in mix)


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        row, old = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_myers():
    rng = random.Random(5)
    for _ in range(200):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (80, 30))
        assert decontaminate.myers(p, t)[0] == brute_distance(p, t)


def test_decontamination(spark, odd, none):
    rng = random.Random(4)
    items = [(k, " ".join(f"q{rng.randrange(900)}" for _ in range(rng.randrange(5, 60)))) for k in range(30)] + [(98, ""), (99, None), (None, "x y z a b c")]
    docs = []
    for d in range(120):
        own = [f"q{rng.randrange(900)}" for _ in range(80)]
        leak = items[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(0, 1 + len(leak) // 6)):
            leak[rng.randrange(len(leak))] = "edited"
        if d % 2:
            own[20:20] = leak
        docs.append((d, " ".join(own)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {(d, i) for d, t in docs for i, x in items[:30] if brute_distance(x.split(), t.split()) <= len(x.split()) // 10}
    assert got == want
    bench = spark.createDataFrame([(1, "One, two three FOUR five six!"), (1, "One, two three FOUR five six!")], "item_id bigint, text string")
    left = decontaminate.without_benchmark(odd, bench)
    assert left.columns == odd.columns and {6, 7} & {r.doc_id for r in left.collect()} == set() and left.count() == odd.count() - 3
    assert decontaminate.benchmark_hits(none, bench).count() == 0 and decontaminate.without_benchmark(odd, bench.limit(0)).count() == odd.count()


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_benchmark_items_of_one_id_and_of_none(spark, monkeypatch, size):
    """Every text of an item counts, with or without item_id, in any number of blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    rng = random.Random(14)
    some = [" ".join(f"q{rng.randrange(400)}" for _ in range(rng.randrange(4, 40))) for _ in range(12)]
    items = [(1, some[0]), (1, some[1]), (1, some[1]), (None, some[2]), (None, some[3]), (2, some[0]), *((k, t) for k, t in enumerate(some[4:], 3))]
    docs = []
    for d in range(60):
        leak = some[d % 12].split()
        if d % 3 == 0 and len(leak) > 10:
            leak[3] = "edited"
        docs.append((d, " ".join([*(f"q{rng.randrange(400)}" for _ in range(30)), *leak, "end"])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    want = [(d, i) for d, t in docs for i, x in set(items) if brute_distance(x.split(), t.split()) <= len(x.split()) // 10]
    assert sorted(map(repr, ((r.doc_id, r.item_id) for r in got))) == sorted(map(repr, want)) and any(i is None for _, i in want)
    held = {d for d, _ in want}
    left = decontaminate.without_benchmark(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - held


def test_benchmark_comes_in_few_jobs(spark):
    """A block of the benchmark takes no job for each partition (on check_h 211 of them filled the driver)."""
    for k, v in (("spark.sql.shuffle.partitions", "40"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("benchmark", "items")
        bench = spark.createDataFrame([(n, f"one two three {n} five six") for n in range(300)], "item_id bigint, text string")
        decontaminate.benchmark_hits(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), bench)
        assert 1 <= len(spark.sparkContext.statusTracker().getJobIdsForGroup("benchmark")) < 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_toxicity_is_fitted_by_a_task(spark, monkeypatch):
    """The sample's texts stay off the driver, and the model is the one of all of them, in order."""
    docs = spark.createDataFrame([(n, "bad word" if n % 3 else None) for n in range(40)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) as toxic")
    want = sorted((r.text or "").encode() for r in toxicity.label_sample(docs, labels, "toxic", toxicity.SAMPLE).collect())
    monkeypatch.setattr(toxicity, "fit", lambda rows: {"table": np.arange(3.0), "bias": float(os.getpid()), "slope": float([t for t, _ in rows] == want), "offset": 0.5})
    got = toxicity.fitted(docs, labels, toxicity.SAMPLE)
    assert got["bias"] != os.getpid() and got["slope"] == 1.0 and got["offset"] == 0.5 and got["table"].tolist() == [0.0, 1.0, 2.0]


def test_runs_of_letters_beyond_ascii():
    low = lambda text: toxicity.tokens(text.encode())
    assert "grümbol".encode() in low("mi g r ü m b o l ta") and "дура".encode() in low("д у р а")
    assert b"ab" not in low("a b cd") and "aü".encode() not in low("a ü cd")


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[400:700] = x[400]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (None, x[0].tolist()), (5200, [None] * 16)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = x.astype(float)
    size, hits = np.sqrt((x * x).sum(1)), 0
    assert sorted(got) == list(range(0, 1500, 50))
    for q, found in got.items():
        near = (x * x[q]).sum(1) / (size * size[q])
        near[q] = -9
        want = np.lexsort((np.arange(1500), -near))[:5]
        hits += len({v for v, _ in found} & set(want.tolist()))
        assert all(s == pytest.approx(near[v]) for v, s in found) and len(found) == 5
        if 400 <= q < 700:
            assert [v for v, _ in found] == want.tolist()
    assert hits >= 0.9 * 5 * len(got)
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")).collect()[0].vec_id == 1


def brute_nearest(rows, every, k):
    x = {d: np.array(v, float) for d, v in rows}
    out = {}
    for q in sorted(d for d in x if d % every == 0):
        near = {d: round(float(x[q] @ v) / math.sqrt(float(x[q] @ x[q]) * float(v @ v)), 12) for d, v in x.items() if d != q}
        out[q] = sorted(near, key=lambda d: (-near[d], d))[:k]
    return out


def found_nearest(df, **more):
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, **more).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    return dict(got)


def test_neighbours_ties(spark):
    """Sixty multiples of one vector, quantised vectors of equal cosines, repeated rows and columns with clashing names."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=8)
    rows = [(k, (v * (k + 1)).tolist()) for k in range(60)] + [(60 + k, rng.choice([-1.0, 0.0, 1.0], 8).tolist()) for k in range(140)]
    rows = [(d, x) for d, x in rows if any(x)]
    named = [(d, x, 1, 2.0, "c1") for d, x in rows + rows[:30]]
    got = found_nearest(spark.createDataFrame(named, "vec_id bigint, embedding array<double>, rank int, score double, leaf string"))
    assert got == brute_nearest(rows, 50, 5) and got[0] == [1, 2, 3, 4, 5]


def test_neighbours_tree_grows(spark):
    """Clustered vectors, a tree that is fitted on few of them and grows by splitting: recall, and the share of leaves visited."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    rows = [(k, (centres[k % 60] + 0.15 * rng.normal(size=24)).tolist()) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want, got = brute_nearest(rows, 50, 5), found_nearest(df, sample=400, split=200)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    entries = df.select(F.col("vec_id").alias("c1"), F.col("vec_id").alias("c2"), "vec_id", F.col("embedding").alias("v"))
    tree = neighbours.grown(entries, 4000, 400, 200)
    leaves = tree.assign(neighbours.unit(np.array([v for _, v in rows])))
    assert np.bincount(leaves).max() <= 200 and len(set(leaves)) > 40
    assert all(sorted(tree.visit(neighbours.unit(np.array([rows[q][1]]))[0], tree.leaves)) == list(range(tree.leaves)) for q in (0, 50))
    at = np.array([v for _, v in rows])
    unit = neighbours.unit(at)
    asked = list(range(0, 4000, 50))
    near = [[int(leaves[b]) for b in np.argsort(-np.where(np.arange(4000) == q, -9, unit @ unit[q]))[:5]] for q in asked]
    tree.calibrate(at[asked], near)
    assert tree.visits < 0.2 * tree.leaves


PAGE = """<html><head><title>t</title><script>var a="<p>";</script></head><body><header><a href=/>Home</a></header><div id="cookie-notice">We use cookies on this site.</div>
<main><article><h1>Title &amp; more</h1><p>First  long paragraph,<br>with <b>words</b> enough.</p><div class="ad">Buy now!</div><ul><li>Point one.<li>Point two.</ul><form>Mail</form></article>
<section class="comments"><p>I think this is a great article, thanks for sharing it with us all.</p></section></main><footer>c 2020</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<p>Just one paragraph of text.", "x"), (None, "u", "<", "x")]
    got = {r.page_id: r for r in html_text.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    assert got[1].text == "Title & more\nFirst long paragraph, with words enough.\nPoint one.\nPoint two."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""
    assert html_text.main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def made_page(rng):
    """A page without telling names or classes but for an advert, and the blocks of its article."""
    word = lambda: rng.choice("stone river walks under light seven green after field music".split())
    line = lambda n: " ".join(word() for _ in range(n))
    want, body = [], []
    for _ in range(rng.randrange(3, 6)):
        tag = rng.choice(["p", "p", "li"])
        for _ in range(rng.randrange(2, 5)):
            text = line(rng.randrange(15, 40)) + ", " + line(6) + "." if rng.random() < 0.6 else line(rng.randrange(1, 5))
            body.append(f"<{tag}>{text}</{tag}>")
            want.append(text)
    long = [k for k, text in enumerate(want) if len(text.split()) > 6] or [0]
    body, want = body[long[0] : long[-1] + 1], want[long[0] : long[-1] + 1]
    body.insert(rng.randrange(1, len(body) + 1), f"<div class='ad'>{line(9)}.</div>")
    menu = [f"<li><a href=/x>{line(2)}</a></li>" for _ in range(8)]
    menu[rng.randrange(1, 7)] = f"<li>{line(6)}.</li>"
    return f"<body><ul>{''.join(menu)}</ul><div>{''.join(body)}</div><div>{''.join(menu)}</div></body>", want


def test_smoothness_edges_matter():
    """Made pages have their article whole with the edges, and lose blocks or take in others without them."""
    rng, right, without, moved = random.Random(11), 0, 0, 0
    for _ in range(100):
        page, want = made_page(rng)
        got = html_text.labelled(page)
        right += [text for text, kept, _ in got if kept] == want
        moved += sum(kept != own for _, kept, own in got)
        without += [text for text, kept, _ in html_text.labelled(page, smooth=False) if kept] == want
    assert right >= 80 and without <= 5 and moved >= 200


ARTICLE = "This is the article's first long paragraph, which has words enough to stand alone.", "And a second one follows it, with more of what the article has to say to us."
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in ARTICLE)
BROKEN_PAGES = {
    "head without end": f"<html><head><title>t</title><meta charset=x><body><article>{PARAGRAPHS}</article></body></html>", "head without end or body": f"<html><head><title>t</title><article>{PARAGRAPHS}</article>",
    "closed script": f"<body><script src=x />var a = 'code, that is no text.';</script><article>{PARAGRAPHS}</article></body>", "closed style": f"<body><style/>p {{ color: red }}</style><article>{PARAGRAPHS}</article></body>",
    **{f"open {x}": f"<body><{x} class=y><article>{PARAGRAPHS}</article></body>" for x in ("button", "canvas", "select", "textarea", "object", "svg", "iframe", "noscript", "template")},
    "open button before another": f"<body><button>Buy<article>{PARAGRAPHS}</article><button>Sell</button></body>",
    "objects in objects": f"<body><object data=a><object data=b>no picture</object> shown here, sorry</object><article>{PARAGRAPHS}</article></body>",
    "svg in a paragraph": f"<body><article><p>{ARTICLE[0][:20]}<svg><g><title>x</title><text>drawn</text></g></svg>{ARTICLE[0][20:]}</p><p>{ARTICLE[1]}</p></article></body>",
    "script in a paragraph": f"<body><article><p>{ARTICLE[0][:20]}<script>if (a < b) x('</p>')</script>{ARTICLE[0][20:]}</p><p>{ARTICLE[1]}</p></article></body>",
    "select with options": f"<body><form><select><option>one<option>two</select></form><article>{PARAGRAPHS}</article></body>",
}


@pytest.mark.parametrize("name", BROKEN_PAGES)
def test_broken_pages_keep_their_text(name):
    assert html_text.main_text(BROKEN_PAGES[name]) == "\n".join(ARTICLE)


def test_pages_of_odd_rows(spark):
    """Nulls, plain text, repeated rows and other columns with clashing names."""
    pages = [(1, "u", BROKEN_PAGES["open svg"], "a", 1, "b"), (1, "u", BROKEN_PAGES["open svg"], "a", 1, "b"), (None, None, None, None, None, None), (2, "u", "", "a", 1, "b"), (3, "u", "Plain  text &amp; no tag\nat all", "a", 1, "b"), (4, "u", "<script>only", "a", 1, "b")]
    got = html_text.main_texts(spark.createDataFrame(pages, "page_id bigint, url string, html string, text string, n_chars int, block string"))
    want = ["\n".join(ARTICLE)] * 2 + ["", "", "Plain text & no tag at all", ""]
    assert sorted((repr(r.page_id), r.text, r.n_chars) for r in got.collect()) == sorted((repr(p[0]), w, len(w)) for p, w in zip(pages, want))


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div>t " * 100_000, "<b>x" * 100_000 + "</i>" * 100_000, "<p>Yes<p>no links here at all, is it.<p><a>go</a>" * 20_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 15


def test_min_cut_agrees_with_enumeration():
    rng = random.Random(6)
    for _ in range(100):
        n = rng.randrange(1, 10)
        score = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda y: sum(max(s, 0) * (not v) + max(-s, 0) * v for s, v in zip(score, y)) + sum(w for i, j, w in edges if y[i] != y[j])
        best = min(cost([bool(code >> k & 1) for k in range(n)]) for code in range(1 << n))
        assert cost(html_text.min_cut(score, edges)) == pytest.approx(best)


def test_url_filter(spark):
    urls = [("http://a.example.com/en/1", "example.com/en/", "block"), ("http://www.example.com/en/1", "www.example.com/en/", "allow"), ("https://X.NET/es/1?q=1", "net/es/", "block"), ("http://example.com/fr/", "com/", "allow"), ("http://example.com", None, None), (None, None, None), ("no scheme", None, None), ("http://notnet/es/", None, None)]
    rows = [(k, u) for k, (u, _, _) in enumerate(urls * 20)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert len(got) == len(rows)
    for k, (u, rule, verdict) in enumerate(urls):
        assert got[k].rule == rule and got[k].verdict in ("allow", "block") and (verdict is None or got[k].verdict == verdict)
    assert (got[2].host, got[2].path, got[5].host) == ("x.net", "/es/1", "")
    odd = [(1, "http://x.net/es/" + "a/" * 20_000), (1, "http://x.net/es/" + "a/" * 20_000), (None, "http://y.org/"), (2, None), (3, ""), (4, "://"), (5, "http:///en/"), (6, "http://A.com/?x=1#y"), (7, "http://b.net/fr/x")]
    odd = spark.createDataFrame([(*r, "x", 1.0, "tld") for r in odd], "page_id bigint, url string, rule string, block_score double, tld string")
    found = url_filter.judged(odd).collect()
    assert len(found) == 9 and all(r.verdict in ("allow", "block") for r in found) and [(r.rule, r.verdict) for r in found if r.page_id == 1] == [("net/es/", "block")] * 2
    assert url_filter.judged(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert {r.verdict for r in url_filter.judged(spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")).collect()} == {"allow"}


def test_url_filter_learns_from_every_labelled_url(spark, monkeypatch):
    """Of more labelled URLs than any sample held, all train; suffix statistics and bins count every row, too."""
    n, fitted = 45_000, []

    class Recorded(url_filter.GBTClassifier):
        def fit(self, train):
            arity = [a.get("vals", ()) for kind in train.schema["features"].metadata["ml_attr"]["attrs"].values() for a in kind]
            fitted.append((train.count(), train.where("label = 1").count(), min(map(len, arity)), max(map(len, arity))))
            return super().fit(train)

    monkeypatch.setattr(url_filter, "GBTClassifier", Recorded)
    k = F.col("id")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://a.net/es/"), k.cast("string"))).when(k < n - 2, F.concat(F.lit("http://b.com/x/"), k.cast("string"))).otherwise(F.concat(F.lit("http://c.org/es/"), k.cast("string")))
    pages = spark.range(n).select(k.alias("page_id"), url.alias("url"))
    got = url_filter.judged(pages)
    blocked = n // 3
    assert fitted[0][:2] == (n - 2, blocked) and 2 <= fitted[0][2] and fitted[0][3] <= url_filter.BINS
    assert got.count() == n and got.where("rule is null").count() == 2
    rows = url_filter.table(spark.createDataFrame([(1.0, 0, "a"), (0.0, 1, "a"), (1.0, 1, "a"), (None, 2, "a"), (0.0, 3, "b")], "label double, fold int, tld string"), "urls")
    for most in (1, 100):  # with and without broadcast
        found = {(r.tld, r.label, r.fold): (round(math.expm1(r.tld_seen)), round(math.expm1(r.tld_seen_others)), round(r.tld_blocked_others, 6)) for r in url_filter.with_statistics(rows, "tld", 0.5, most).collect()}
        assert found == {("a", 1.0, 0): (3, 2, 0.5), ("a", 0.0, 1): (3, 1, round(2 / 3, 6)), ("a", 1.0, 1): (3, 1, round(2 / 3, 6)), ("a", None, 2): (3, 3, 0.6), ("b", 0.0, 3): (1, 0, 0.5)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in left.collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.benchmark_hits(left, bench).count() == 0


def test_near_duplicate_and_decontamination_stages_against_brute_force(spark, tmp_path):
    """The stages on made documents: one of each group of near copies stays, and what holds an edited benchmark item goes."""
    import corpus_pipeline

    rng, rows = random.Random(12), near_copies(4)
    items = [(k, " ".join(f"z{rng.randrange(500)}" for _ in range(n))) for k, n in enumerate((3, 12, 40))]
    for k, (d, t) in enumerate(rows[:12]):
        leak = items[k % 3][1].split()
        if k % 2 and len(leak) > 10:
            leak[5] = "changed"
        rows.append((1000 + k, f"{t} {' '.join(leak)} end of it"))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    single = stages["near_duplicates"](spark, docs, str(tmp_path))
    want = {root for _, root in brute_components(rows, 5, 80).values()}
    assert {r.doc_id for r in single.collect()} == want and single.count() == len(want)
    clean = stages["decontamination"](spark, docs, str(tmp_path))
    held = {d for d, t in rows for _, x in items if brute_distance(x.split(), t.split()) <= len(x.split()) // 10}
    assert held and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - held


def test_pipeline_stages_on_odd_rows(spark, odd, none, labels, tmp_path):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", F.col("row").alias("score"))
    for own, empty in ((docs, False), (docs.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, own, SF)
            rows = got.collect()
            assert (name == "mixing" or got.columns == own.columns) and (not empty or not rows)
            if name in ("toxicity", "quality", "decontamination"):
                assert {repr(tuple(r)) for r in rows} <= {repr(tuple(r)) for r in own.collect()}
            if name == "near_duplicates" and not empty:
                assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "6", "8", "None"]
            if name == "mixing":
                assert len(rows) == own.count()
