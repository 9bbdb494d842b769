"""Toxicity by a gap-weighted subsequence-kernel SVM with Nystroem landmarks (operator 5).

The kernel of two tokens sums, over every subsequence of three characters that both have, decay ** (the spans that it takes
in either), divided by each token's norm for its length; a token has a blank at either end, as it has in its sentence. The
kernel of two sentences is that of their best matching tokens. A token's score is w . phi(token) + b, where phi is the
Nystroem map of the kernel to the landmarks. As phi is linear in the kernel values, that is sum_j alpha_j k(token, landmark_j):
one weight for each subsequence of three characters, so a token is scored by the triples that it has.

Training is multiple-instance: a labelled text is toxic if its worst sentence, and so its worst token, is. Every toxic text
gives the SVM the token that tells it best from the clean ones (by the likelihood ratio of its beginnings at first, by the
SVM's own score in later rounds), whatever its support, and the best supported ones their gapped variants; clean texts give
their worst tokens.
A document's score is that of its worst token (or run of single characters), through a logistic curve.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordIds, as_bytes, label_sample, logistic_fit, mix, remainder, row_schema, rows_kept

DECAY, SPAN = 0.7, 8
#: Odd step between the hash seeds of near-copy keys.
MIX_STEP = 0x9E3779B97F4A7C1
#: Longest token that is scored as one word; lengths of the stretches of longer ones, and how far the next one begins.
LONGEST = 18
STRETCHES = ((18, 9), (12, 4), (8, 2))
#: Characters that count: letters, digits, one code for all else of ASCII, bytes above it folded into 31 codes.
CODES = 68
CODE = np.array([c - 97 if 97 <= c <= 122 else c - 48 + 26 if 48 <= c <= 57 else 37 + c % 31 if c >= 128 else 36 for c in range(256)], np.int64)
#: Bytes of the shortest beginning of a token that can tell.
STEM = 4
EDGE = b".,;:!?\"'()[]{}<>|#$%&*@-_/\\"
INNER = re.compile(rb"[^a-z0-9\x80-\xff]")
#: Single characters (of UTF-8) between blanks, three or more in a row.
ONE = rb"(?:[^\s\x80-\xff]|[\xc0-\xff][\x80-\xbf]*)"
RUN = re.compile(rb"(?<!\S)%b(?:[ \t]+%b){2,}(?!\S)" % (ONE, ONE))
#: Expected number of rows of each label in the training sample.
SAMPLE = {0: 3000, 1: 2000}
#: Numbers of a model besides its table.
CURVE = ("bias", "slope", "offset")


def parts(word: bytes) -> list[bytes]:
    """What is scored of a lower-cased token: without outer punctuation, also without inner; long ones in stretches."""
    word = word.strip(EDGE)
    inner = word if word.isalnum() else INNER.sub(b"", word)
    out = []
    for w in (word,) if inner == word else (word, inner):
        if len(w) > LONGEST:
            out += (w[s : s + size] for size, stride in STRETCHES for s in range(0, len(w) - size + stride, stride))
        elif len(w) > 2:
            out.append(w)
    return out


def tokens(text: bytes) -> set[bytes]:
    """Lower-cased tokens of a text, and its runs of single characters, joined."""
    low = text.translate(ASCII_LOWER)
    out = set(low.split())
    for run in RUN.findall(low):
        out.add(INNER.sub(b"", run))
    return out


def instances(text: bytes) -> set[bytes]:
    """All that is scored of a text."""
    return {w for token in tokens(text) for w in parts(token)}


def _triples() -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length with both blanks: positions i < j < k of the subsequences within a span, and their weights over the length's norm."""
    out = {}
    for n in range(5, LONGEST + 3):
        at = [(i, j, k) for i, j, k in combinations(range(n), 3) if k - i < SPAN]
        weight = np.array([DECAY ** (k - i + 1) for i, _, k in at])
        out[n] = (*np.array(at, np.int64).T, weight / np.sqrt((weight**2).sum()))
    return out


TRIPLES = _triples()


def subsequences(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The word's subsequences of three characters, as numbers, and their normed weights; some may repeat."""
    c = CODE[np.frombuffer(b" %b " % word, np.uint8)]
    i, j, k, w = TRIPLES[len(c)]
    return (c[i] * CODES + c[j]) * CODES + c[k], w


def features(word: bytes) -> np.ndarray:
    """The word's normed weight for each subsequence of three characters (dense, CODES ** 3)."""
    at, w = subsequences(word)
    return np.bincount(at, w, CODES**3)


class Landmarks:
    """Features of the landmark words, for the subsequences that any of them has."""

    def __init__(self, words: list[bytes]):
        pairs = [subsequences(w) for w in words]
        self.codes = np.unique(np.concatenate([at for at, _ in pairs]))
        self.place = np.full(CODES**3, len(self.codes), np.int32)  # of what no landmark has: a row of zeros
        self.place[self.codes] = np.arange(len(self.codes))
        self.weights = np.zeros((len(self.codes) + 1, len(words)))
        for n, (at, w) in enumerate(pairs):
            np.add.at(self.weights[:, n], self.place[at], w)

    def kernel(self, word: bytes) -> np.ndarray:
        """Kernel values of a word and the landmarks."""
        at, w = subsequences(word)
        return w @ self.weights[self.place[at]]

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """Sum of the landmarks' features, weighted."""
        out = np.zeros(CODES**3)
        out[self.codes] = self.weights[:-1] @ alpha
        return out


def word_scores(words: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """w . phi + b of each word, where ``table`` holds the sum of the landmarks' weighted features."""
    out, by_length = np.empty(len(words)), {}
    for n, w in enumerate(words):
        by_length.setdefault(len(w), []).append(n)
    for size, at in by_length.items():
        i, j, k, w = TRIPLES[size + 2]
        for s in range(0, len(at), 4096):
            some = at[s : s + 4096]
            c = CODE[np.frombuffer(b"".join(b" %b " % words[n] for n in some), np.uint8)].reshape(len(some), size + 2)
            out[some] = table[(c[:, i] * CODES + c[:, j]) * CODES + c[:, k]] @ w + bias
    return out


def distinct_rows(docs: list[tuple[tuple[bytes, ...], int]], keys: int = 6, depth: int = 4) -> list[tuple[tuple[bytes, ...], int]]:
    """Rows without those that share one of ``keys`` tuples of ``depth`` least word hashes with an earlier row (near copies)."""
    out, seen, memo = [], set(), WordIds(2_000_000)
    seeds = [np.uint64(k * MIX_STEP & (1 << 64) - 1) for k in range(keys * depth)]
    for words, label in docs:
        ids = memo.of(sorted(words)) if words else np.zeros(1, np.uint64)
        least = [int(mix(ids + seed).min()) for seed in seeds]
        own = {(k, *least[k * depth : (k + 1) * depth]) for k in range(keys)}
        if not own & seen:
            out.append((words, label))
        seen |= own
    return out


def ratio(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Log likelihood ratio of having a share of toxic texts of its own, for what is commoner in them; else 0."""
    log = lambda k, n, p: k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))
    p, q, both = bad / n_bad, good / n_good, (bad + good) / (n_bad + n_good)
    return np.where(p > q, log(bad, n_bad, p) + log(good, n_good, q) - log(bad, n_bad, both) - log(good, n_good, both), 0.0)


def beginnings(word: bytes) -> list[int]:
    """Ids of the word as a whole and of its beginnings of ``STEM`` bytes or more."""
    return [xxhash.xxh3_64_intdigest(word + b" "), *(xxhash.xxh3_64_intdigest(word[:n]) for n in range(STEM, len(word)))]


def telling(docs: list[tuple[tuple[bytes, ...], int]]) -> dict[bytes, float]:
    """Words of toxic texts, with the likelihood ratio of their best beginning."""
    own = lambda words: np.unique(np.array([x for w in words for x in beginnings(w)], np.uint64))
    bad_docs = [words for words, label in docs if label]
    names, bad = np.unique(np.concatenate([own(words) for words in bad_docs]), return_counts=True)
    good, n_good = np.zeros(len(names)), 0
    for words, label in docs:
        if not label:
            found = own(words)
            at = np.searchsorted(names, found)
            at[at == len(names)] = 0
            good[at[names[at] == found]] += 1
            n_good += 1
    value = ratio(bad.astype(float), good, len(bad_docs), max(1, n_good)) * (bad > 1)
    return {w: float(value[np.searchsorted(names, np.array(beginnings(w), np.uint64))].max()) for w in {w for words in bad_docs for w in words}}


def gapped(word: bytes) -> list[bytes]:
    """Variants of an insult: a character inserted after one of its letters, or a letter written twice."""
    out = []
    for n in range(1, len(word)):
        out += [word[:n] + x + word[n:] for x in (b".", b"x", b"q", word[n - 1 : n])]
    return [v for v in out if len(v) <= LONGEST]


def svm(parts: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 60, block: int = 2048) -> np.ndarray:
    """Weights (bias last) of a squared-hinge linear SVM over the rows of ``parts``, by Newton steps on the rows within the margin."""
    x = np.ones((len(y), parts[0].shape[1] + 1))
    np.concatenate(parts, out=x[:, :-1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for step in range(rounds):
        active = np.flatnonzero(y * (x @ w) < 1)
        left, right = np.diag(ridge), np.zeros(len(w))
        for s in range(0, len(active), block):  # no copy of all active rows
            at = active[s : s + block]
            weighed = x[at] * cost[at, None]
            left += weighed.T @ x[at]
            right += weighed.T @ y[at]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-9:
            break
        w = 0.5 * (w + new) if step > 10 else new
    return w


def fit(rows: list[tuple[bytes, int]], landmarks: int = 256, rounds: int = 4, mining: int = 3, best: int = 3, varied: int = 300, mined: int = 600) -> dict:
    """The model from (text, label) rows: table, bias, and slope and offset of the logistic curve.

    Landmarks are the likeliest of the toxic texts' telling tokens and the clean tokens nearest to them. In each of ``rounds``
    every toxic text names up to ``best`` tokens near its worst one, and all that are named train the SVM; gapped variants are
    made of the ``varied`` that most texts name. ``mining`` passes add the ``mined`` clean tokens that score highest beyond the margin.
    Without toxic texts, or without words in them, every document scores the share of toxic rows.
    """
    names: dict[bytes, bytes] = {}  # one object for each word, however many texts have it
    docs = [(tuple(names.setdefault(w, w) for w in instances(text)), label) for text, label in rows]
    del names, rows
    some = distinct_rows(docs)
    bad = [words for words, label in some if label and words]
    if not bad:
        share = min(max(sum(y for _, y in docs) / max(1, len(docs)), 0.01), 0.99)
        return {"table": np.zeros(CODES**3), "bias": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    value = telling(some)
    counts = Counter(w for words, label in docs if not label for w in words)
    pool = sorted(counts, key=lambda w: (-counts[w], w))
    in_clean = set(counts)
    table, bias, marks = None, 0.0, []
    for turn in range(rounds):
        if table is not None:
            asked = list({w for words in bad for w in words})
            value = dict(zip(asked, word_scores(asked, table, bias).tolist()))
        witness: Counter = Counter()
        for words in bad:
            own = sorted(words, key=lambda w: (-value.get(w, 0.0), w))[:best]
            top = value.get(own[0], 0.0)
            witness.update(w for w in own if w == own[0] or (value.get(w, 0.0) > (0.7 * top if turn == 0 else 0.5)))
        witness = Counter({w: n for w, n in witness.items() if w not in in_clean or n > 3 * counts[w]}) or witness
        found = sorted(witness, key=lambda w: (-witness[w], w))
        if not marks:
            near = np.zeros(CODES**3)
            for word in found:
                near += witness[word] * features(word)
            close = [pool[n] for n in np.argsort(-word_scores(pool, near, 0.0), kind="stable")[:1000]] if pool else []
            marks = list(dict.fromkeys(found[:landmarks] + close[:landmarks]))
            base = Landmarks(marks)
            spread, vector = np.linalg.eigh(base.weights.T @ base.weights)
            root = vector @ np.diag(1 / np.sqrt(np.maximum(spread, 1e-4))) @ vector.T
            phi = lambda words: np.array([base.kernel(w) for w in words]) @ root if words else np.zeros((0, len(marks)))  # noqa: B023, E731
            clean = list(dict.fromkeys(close + pool[:1000]))
            x_clean = phi(clean)
        variants = list(dict.fromkeys(v for w in found[:varied] for v in gapped(w) if v not in in_clean))
        x_bad, own = phi(found + variants), set(clean)
        cost_bad = np.concatenate([np.minimum(20.0 * np.array([witness[w] for w in found], float), 200.0), np.full(len(variants), 10.0)])
        for left in range(mining, -1, -1):
            y = np.concatenate([np.ones(len(x_bad)), -np.ones(len(clean))])
            w = svm([x_bad, x_clean], y, np.concatenate([cost_bad, np.full(len(clean), 20.0)]))
            table, bias = base.table(root @ w[:-1]), float(w[-1])
            got = word_scores(pool, table, bias) if left and pool else np.zeros(0)
            more = [pool[n] for n in np.argsort(-got, kind="stable")[:2000] if got[n] > -0.8 and pool[n] not in own][:mined]
            if not more:
                break
            clean += more
            own.update(more)
            x_clean = np.vstack([x_clean, phi(more)])
    worst = np.array([word_scores(list(words), table, bias).max(initial=-2.0) for words, _ in docs])
    curve = logistic_fit(np.clip(worst, -2, 2)[:, None], np.array([label for _, label in docs], float), 0.1)
    return {"table": table, "bias": bias, "slope": float(max(curve[0], 0.0)), "offset": float(curve[1])}


def fitted(docs: DataFrame, labels: DataFrame, sample: dict[int, int]) -> dict:
    """The model of the labelled rows' sample, fitted by a task: the driver holds neither texts nor words, but the model alone."""

    def run(batches):
        rows = sorted((text, int(label > 0)) for batch in batches for text, label in zip(as_bytes(batch.column("text")), batch.column("label").to_pylist()))
        if rows:
            m = fit(rows)
            yield pa.RecordBatch.from_arrays([pa.array([m["table"].tobytes()], pa.binary()), *(pa.array([m[c]], pa.float64()) for c in CURVE)], ["table", *CURVE])

    texts = label_sample(docs, labels, "toxic", sample).select("text", "label").repartition(1)
    got = texts.mapInArrow(run, "table binary, " + ", ".join(f"{c} double" for c in CURVE)).collect()
    if not got:
        return fit([])
    return {"table": np.frombuffer(bytes(got[0]["table"])), **{c: got[0][c] for c in CURVE}}


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: dict[int, int] = SAMPLE, keep: bool = False) -> DataFrame:
    """One row for each document row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    The model is fitted on a sample of labelled rows outside the held-out third (crc32(doc_id) mod 3 = 1), bounded by
    ``sample`` (expected rows of each label, whole texts; see ``fit`` for what it takes of them); it reads texts only. Null and empty texts score as a text without words. A null doc_id has held_out false.
    Repeated rows give repeated rows, an empty table gives no rows. Other
    columns are ignored, or come along in the struct ``row`` with ``keep``.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def score(batches):
        m = model.value
        known: dict[bytes, float] = {}  # the worst part of each token
        for batch in batches:
            worst = []
            for text in as_bytes(batch.column("text")):
                own = tokens(text)
                new = [t for t in own if t not in known]  # own - known.keys() would walk all that is known
                if new:
                    if len(known) + len(new) > 700_000:
                        known.clear()
                        new = list(own)
                    each = [parts(t) for t in new]
                    got = iter(word_scores([w for ws in each for w in ws], m["table"], m["bias"]).tolist())
                    known.update((t, max((next(got) for _ in ws), default=-2.0)) for t, ws in zip(new, each))
                worst.append(max(map(known.__getitem__, own), default=-2.0))
            got = 1 / (1 + np.exp(-(m["slope"] * np.clip(worst, -2, 2) + m["offset"])))
            own = [batch.column("row")] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64()), *own], ["doc_id", "score", *["row"] * keep])

    out = rows_kept(docs, keep).mapInArrow(score, "doc_id bigint, score double" + row_schema(docs, keep))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["row"] * keep)
