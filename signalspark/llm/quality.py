"""Quality by a linear-chain conditional random field over the lines of a document (operator 9).

Each line is labelled good or bad from features of its own and of its neighbours, with a weight for each pair of labels of
consecutive lines. Forward-backward gives every line's marginal of being good; their mean, weighted by line length, passes
through a logistic curve fitted on documents' labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, label_sample, logistic_fit, remainder, row_schema, rows_kept, sigmoid

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = b"#$%&*@^~_=+<>\\/{}[]"
ENDS = (b".", b"!", b"?", b":", b'"')
OWN = 13
#: Expected number of rows of each label in the training sample.
SAMPLE = {0: 1200, 1: 1200}
#: Padded lines whose marginals are computed at once.
CELLS = 1 << 18


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with words, with those of the lines before and after; line lengths in bytes)."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, m = len(line), len(words)
        letters = n - len(line.translate(None, LETTERS))
        upper = n - len(line.translate(None, UPPER))
        rows.append((
            upper / max(1, letters),
            letters / n,
            (n - len(line.translate(None, SYMBOLS))) / m,
            line.count(b"!") / m,
            line.count(b"|") / m,
            (n - len(line.translate(None, b"0123456789"))) / n,
            (n - len(line.translate(None, b".,;:?"))) / m,
            1 - len(set(words)) / m,
            sum(map(bytes.__eq__, words, words[1:])) / m,
            min(n / m, 30) / 10,
            min(np.log(m), 6) / 3,
            line in seen,
            line.rstrip().endswith(ENDS),
        ))
        sizes.append(n)
        seen.add(line)
    if not rows:
        return np.zeros((0, 3 * OWN + 2)), np.zeros(0)
    own = np.array(rows, float)
    blank = np.zeros((1, OWN))
    edge = np.zeros((len(own), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank]), edge]), np.array(sizes, float)


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(score: np.ndarray, length: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the sum over documents of P(label, next label), by forward-backward.

    ``score``: documents x lines, log-odds of good from the features; ``length``: lines of each; ``pair``: 2 x 2 weights.
    """
    n, most = score.shape
    emit = np.stack([np.zeros_like(score), score], -1)
    forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, most):
        before = forward[:, t - 1]
        forward[:, t] = emit[:, t] + _logsum(before[:, :1] + pair[0], before[:, 1:] + pair[1])
    for t in range(most - 2, -1, -1):
        after = emit[:, t + 1] + backward[:, t + 1]
        got = _logsum(after[:, :1] + pair[:, 0], after[:, 1:] + pair[:, 1])
        backward[:, t] = np.where((t + 1 < length)[:, None], got, 0.0)
    both = forward + backward
    total = _logsum(both[..., 0], both[..., 1])
    good = np.exp(both[..., 1] - total)
    if most < 2:
        return good, np.zeros((2, 2))
    after = (emit + backward)[:, 1:]
    joint = np.exp(forward[:, :-1, :, None] + pair[None, None] + after[:, :, None, :] - total[:, :-1, None, None])
    inside = np.arange(1, most)[None, :] < length[:, None]
    return good, (joint * inside[..., None, None]).sum((0, 1))


def padded(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(v) for v in values])
    out = np.zeros((len(values), max(1, length.max(initial=1))))
    for row, v in zip(out, values):
        row[: len(v)] = v
    return out, length


def all_marginals(score: np.ndarray, length: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the lines of documents laid end to end. Documents of like length are padded together, so that padding
    at most doubles what is held."""
    good, joint = np.empty(len(score)), np.zeros((2, 2))
    starts, scale = np.cumsum(length) - length, np.ceil(np.log2(length)).astype(int)
    for s in np.unique(scale):
        own, some = np.flatnonzero(scale == s), max(1, CELLS >> int(s))
        for k in range(0, len(own), some):
            rows = own[k : k + some]
            inside = np.arange(length[rows].max())[None, :] < length[rows][:, None]
            at = (starts[rows][:, None] + np.arange(inside.shape[1])[None, :])[inside]
            block = np.zeros(inside.shape)
            block[inside] = score[at]
            p, both = marginals(block, length[rows], pair)
            good[at] = p[inside]
            joint += both
    return good, joint


def fit(rows: list[tuple[bytes, int]], rounds: int = 25) -> dict:
    """The model from (text, label) rows, by all lines of each."""
    docs = [(*line_features(text), label) for text, label in rows]
    docs = [d for d in docs if len(d[0])]
    labels = {y for _, _, y in docs}
    if len(labels) < 2:
        share = min(max(np.mean([y for _, y in rows]) if rows else 0.5, 0.01), 0.99)
        return {"mean": np.zeros(3 * OWN + 2), "scale": np.ones(3 * OWN + 2), "w": np.zeros(3 * OWN + 3), "pair": np.zeros((2, 2)), "slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    x = np.vstack([d[0] for d in docs])
    ends = np.cumsum([len(d[0]) for d in docs])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    # lines of bad documents start out bad; those that look good turn good, but for the worst of each document
    y = np.concatenate([np.full(len(d[0]), d[2], float) for d in docs])
    for _ in range(3):
        w = logistic_fit(x, y, 1.0)
        good = sigmoid(x @ w[:-1] + w[-1])
        for (d, e) in zip(docs, ends):
            if not d[2]:
                own = good[e - len(d[0]) : e]
                y[e - len(own) : e] = own > 0.5
                y[e - len(own) + int(np.argmin(own))] = 0
    # the random field, from there on by Adam steps on the penalised log-likelihood
    x1 = np.hstack([x, np.ones((len(x), 1))])
    truth = [y[e - len(d[0]) : e].astype(int) for d, e in zip(docs, ends)]
    seen = np.zeros((2, 2))
    for t in truth:
        np.add.at(seen, (t[:-1], t[1:]), 1)
    pair = np.zeros((2, 2))
    theta, first, second = np.concatenate([w, pair.ravel()]), 0.0, 0.0
    length = np.array([len(t) for t in truth])
    for step in range(1, rounds + 1):
        p, joint = all_marginals(x1 @ theta[:-4], length, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x1.T @ (y - p), (seen - joint).ravel()]) / len(x) - 1e-4 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "w": theta[:-4], "pair": theta[-4:].reshape(2, 2), "slope": 1.0, "offset": 0.0}
    value = np.array([raw_score(model, d[0], d[1]) for d in docs])
    curve = logistic_fit(value[:, None], np.array([d[2] for d in docs], float), 0.1)
    return model | {"slope": float(max(curve[0], 0.0)), "offset": float(curve[1])}


def raw_score(model: dict, x: np.ndarray, size: np.ndarray) -> float:
    """Log-odds of the length-weighted mean of the lines' marginals of being good; 0 without lines."""
    if not len(x):
        return 0.0
    score = ((x - model["mean"]) / model["scale"]) @ model["w"][:-1] + model["w"][-1]
    good = chain_marginals(score, model["pair"])
    share = min(max(float(good @ size / size.sum()), 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


def chain_marginals(score: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(good) of each line of one document; the same recursion on log-odds, line by line."""
    bb, bg, gb, gg = (float(v) for v in np.exp(pair - pair.max()).ravel())
    odds = np.exp(np.clip(score, -30, 30)).tolist()
    n = len(odds)
    forward, r = [0.0] * n, odds[0]
    forward[0] = r
    for t in range(1, n):
        r = odds[t] * (bg + r * gg) / (bb + r * gb)
        forward[t] = r
    back, out = 1.0, [0.0] * n
    for t in range(n - 1, -1, -1):
        ratio = forward[t] * back
        out[t] = ratio / (1 + ratio) if ratio < 1e300 else 1.0
        r = odds[t] * back
        back = (gb + r * gg) / (bb + r * bg)
    return np.array(out)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: dict[int, int] = SAMPLE, keep: bool = False) -> DataFrame:
    """One row for each document row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted, n_lines.

    The model is fitted on a sample of labelled rows outside the held-out third (crc32(doc_id) mod 3 = 1), bounded by
    ``sample``; it reads texts only. Null and empty texts have no lines and score the curve's value for even odds. A null
    doc_id has held_out false. Repeated rows give repeated rows, an empty table gives no rows. Other
    columns are ignored, or come along in the struct ``row`` with ``keep``.
    """
    rows = [(r["text"].encode(), int(r["label"] > 0)) for r in label_sample(docs, labels, "quality", sample).collect()]
    model = docs.sparkSession.sparkContext.broadcast(fit(sorted(rows)))

    def score(batches):
        m = model.value
        for batch in batches:
            found = [line_features(text) for text in as_bytes(batch.column("text"))]
            raw = np.array([raw_score(m, x, size) for x, size in found])
            got = sigmoid(m["slope"] * raw + m["offset"])
            own = [batch.column("row")] if keep else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(got, pa.float64()), pa.array([len(x) for x, _ in found], pa.int64()), *own], ["doc_id", "score", "n_lines", *["row"] * keep]
            )

    out = rows_kept(docs, keep).mapInArrow(score, "doc_id bigint, score double, n_lines bigint" + row_schema(docs, keep))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", *["row"] * keep)
