"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from its own features and those of its neighbours. The field is fitted on a bounded
sample of labelled documents, whose label each of their lines takes. A document's quality is the mean of its lines'
forward-backward marginals, weighted by their length, calibrated on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import exp, log1p
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte classes of a line: 0 others, 1 lower case, 2 upper case, 3 digits, 4 spaces, 5 stops, 6 marks, 7 symbols, 8 beyond ASCII.
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"()-", b"!?", b"#*$%&|<>=@_/\\^~+")
OWN = 17
#: Lines of a chain in the fit; scoring runs over whole texts.
SEGMENT = 64


@cache
def _table():
    import numpy as np

    table = np.zeros(256, dtype=np.int64)
    table[128:] = len(GROUPS) + 1
    for k, group in enumerate(GROUPS):
        table[list(group)] = k + 1
    return table


def line_features(text: bytes):
    """(lines, 3 * OWN) features and each line's bytes: own, the line before, the line after (zero beyond the ends)."""
    import numpy as np

    table = _table()
    raw = np.frombuffer(text, dtype=np.uint8)
    n = text.count(b"\n") + 1
    k = len(GROUPS) + 2
    hist = np.zeros(n * k, dtype=np.int64)
    line0 = 0
    for start in range(0, len(raw), 1 << 20):  # bounded memory for very long texts
        part = raw[start : start + (1 << 20)]
        breaks = part == 10
        line = line0 + np.cumsum(breaks) - breaks
        low, high = int(line[0]), int(line[-1])
        codes = (line - low) * k + table[part]
        hist[low * k : (high + 1) * k] += np.bincount(codes[~breaks], minlength=(high - low + 1) * k)
        line0 = high + int(breaks[-1])
    hist = hist.reshape(n, k)
    size = hist.sum(axis=1)
    own = np.zeros((n, OWN))
    own[:, : k - 1] = hist[:, 1:] / np.maximum(size, 1)[:, None]
    seen, earlier = set(), set()
    for i, line in enumerate(text.split(b"\n")):
        words = line.split()
        kinds = set(words)
        m = max(len(words), 1)
        own[i, k - 1 :] = (
            np.log1p(len(words)), size[i] / m / 10, len(kinds) / m, len(kinds & seen) / max(len(kinds), 1), line in earlier,
            line[:1].isupper(), line.rstrip()[-1:] in (b".", b"!", b"?"), min(size[i], 2000) / 2000, not words,
        )
        earlier.add(line)
        seen |= kinds
    full = np.zeros((n, 3 * OWN))
    full[:, :OWN] = own
    full[1:, OWN : 2 * OWN] = own[:-1]
    full[:-1, 2 * OWN :] = own[1:]
    return full, size


@dataclass
class Field:
    """Weights of a fitted field: per feature, of staying with good and with bad, and the calibration's slope and offset."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    stay: tuple[float, float]
    slope: float = 1.0
    offset: float = 0.0

    def node(self, features):
        import numpy as np

        return (features - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.bias


def forward_backward(node, lengths, stay):
    """Marginals of good, expected stays (good, bad) and log Z of chains: node (chains, steps) log odds of good, padded.

    Log potentials: node for a good line, stay[0] for good after good, stay[1] for bad after bad, 0 otherwise.
    """
    import numpy as np

    chains, steps = node.shape
    a = np.zeros((chains, steps, 2))
    b = np.zeros((chains, steps, 2))
    a[:, 0, 0] = node[:, 0]
    for t in range(1, steps):
        good = np.logaddexp(a[:, t - 1, 0] + stay[0], a[:, t - 1, 1]) + node[:, t]
        bad = np.logaddexp(a[:, t - 1, 0], a[:, t - 1, 1] + stay[1])
        inside = t < lengths
        a[:, t, 0], a[:, t, 1] = np.where(inside, good, a[:, t - 1, 0]), np.where(inside, bad, a[:, t - 1, 1])
    for t in range(steps - 2, -1, -1):
        inside = t + 1 < lengths
        g, w = b[:, t + 1, 0] + node[:, t + 1], b[:, t + 1, 1]
        b[:, t, 0] = np.where(inside, np.logaddexp(g + stay[0], w), 0.0)
        b[:, t, 1] = np.where(inside, np.logaddexp(g, w + stay[1]), 0.0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    marginal = np.exp(a[:, :, 0] + b[:, :, 0] - z[:, None])
    mask = np.arange(1, steps)[None, :] < lengths[:, None]
    goods = np.where(mask, np.exp(a[:, :-1, 0] + stay[0] + node[:, 1:] + b[:, 1:, 0] - z[:, None]), 0).sum(axis=1)
    bads = np.where(mask, np.exp(a[:, :-1, 1] + stay[1] + b[:, 1:, 1] - z[:, None]), 0).sum(axis=1)
    return marginal, goods, bads, z


def _segments(features):
    return [features[k : k + SEGMENT] for k in range(0, len(features), SEGMENT)]


def fit_field(sample: list[tuple[object, int]], rounds: int = 250, penalty: float = 1.0) -> Field:
    """Fits by gradient ascent (Adam) on the likelihood of (features of a text, label) with an L2 penalty.

    Texts are cut into segments of ``SEGMENT`` lines. Without any row, all scores are one half.
    """
    import numpy as np

    parts = [(s, y) for f, y in sample for s in _segments(f)]
    if not parts:
        return Field([0.0] * 3 * OWN, [1.0] * 3 * OWN, [0.0] * 3 * OWN, 0.0, (0.0, 0.0))
    lengths = np.array([len(s) for s, _ in parts])
    labels = np.array([y for _, y in parts], dtype=float)
    flat = np.concatenate([s for s, _ in parts])
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    steps = int(lengths.max())
    mask = np.arange(steps)[None, :] < lengths[:, None]
    x = (flat - mean) / scale
    truth = np.repeat(labels, lengths)
    theta = np.zeros(x.shape[1] + 3)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        node = np.zeros(mask.shape)
        node[mask] = x @ theta[:-3] + theta[-3]
        marginal, goods, bads, _ = forward_backward(node, lengths, theta[-2:])
        left = truth - marginal[mask]
        grad = np.concatenate([x.T @ left, [left.sum(), (labels * (lengths - 1) - goods).sum(), ((1 - labels) * (lengths - 1) - bads).sum()]]) - penalty * theta
        grad /= len(parts)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(mean.tolist(), scale.tolist(), theta[:-3].tolist(), float(theta[-3]), (float(theta[-2]), float(theta[-1])))


def text_score(field: Field, text: bytes) -> float:
    """Length-weighted mean marginal of good over the lines of the whole text, calibrated. Empty texts are one empty line."""
    features, size = line_features(text)
    return _calibrated(field, _mean_marginal(field, features, size))


def chain_marginals(node: list[float], stay: tuple[float, float]) -> list[float]:
    """Marginals of good of one chain of any length: forward and backward messages as log odds of good."""

    def softplus(x: float) -> float:
        return max(x, 0.0) + log1p(exp(-abs(x)))

    good, bad = stay

    def passed(x: float) -> float:  # log odds after a step from log odds x
        return softplus(x + good) - bad - softplus(x - bad)

    ahead, x = [], 0.0
    for k, own in enumerate(node):
        x = own + (passed(x) if k else 0.0)
        ahead.append(x)
    out, back = [0.0] * len(node), 0.0
    for k in range(len(node) - 1, -1, -1):
        total = ahead[k] + back
        out[k] = 1 / (1 + exp(-total)) if total > -700 else 0.0
        back = passed(back + node[k])
    return out


def _mean_marginal(field: Field, features, size) -> float:
    import numpy as np

    marginal = np.array(chain_marginals(field.node(features).tolist(), field.stay))
    return float((marginal * (size + 1)).sum() / (size + 1).sum())


def _calibrated(field: Field, mean: float) -> float:
    import numpy as np

    p = min(max(mean, 1e-6), 1 - 1e-6)
    return float(1 / (1 + np.exp(-(field.slope * np.log(p / (1 - p)) + field.offset))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text is 1 modulo 3; a null doc_id is not held out (it has no label either)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _spread(lines: int, stretches: int, length: int, seed: int):
    """Places of the lines looked at: all, or one stretch at a place drawn by ``seed`` in each of as many equal parts."""
    import numpy as np

    if lines <= stretches * length:
        return np.arange(lines)
    edges = np.linspace(0, lines, stretches + 1).astype(int)
    room = np.diff(edges) - length + 1
    starts = edges[:-1] + np.random.default_rng(seed).integers(0, room)
    return (starts[:, None] + np.arange(length)).ravel()


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, stretches: int = 8, stretch_lines: int = 32, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """A field from at most ``sample_docs`` labelled documents that are not held out.

    The sample is that of the smallest hashes of doc_id, one text of each; of a text with more lines it has ``stretches``
    stretches of ``stretch_lines``, spread over the whole text. That bounds what the driver gets (features, no texts). A
    doc_id with several labels takes the smallest; null labels are passed over.
    """
    import numpy as np

    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_y", "_text")  # however often a doc_id stands

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], []
            for text in batch.column(1).to_pylist():
                lines = line_features(text)[0]
                found.append(lines[_spread(len(lines), stretches, stretch_lines, crc32(text))].astype("<f4").tobytes())
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(size, pa.int64())], names=["y", "x", "n"])

    got = rows.mapInArrow(features, "y int, x binary, n long").orderBy("y", "n", F.xxhash64("x")).collect()
    sample = [(np.frombuffer(r["x"], dtype="<f4").reshape(-1, 3 * OWN).astype(float), r["y"]) for r in got]
    field = fit_field(sample)
    if sample:
        means = np.array([_mean_marginal(field, f, f[:, OWN - 2] * 2000) for f, _ in sample])
        odds = np.log(np.clip(means, 1e-6, 1 - 1e-6) / np.clip(1 - means, 1e-6, 1 - 1e-6))
        truth = np.array([y for _, y in sample], dtype=float)
        slope, offset = 1.0, 0.0
        for _ in range(500):
            left = truth - 1 / (1 + np.exp(-(slope * odds + offset)))
            slope, offset = slope + 0.02 * ((left * odds).mean() - 0.01 * (slope - 1)), offset + 0.1 * left.mean()
        field.slope, field.offset = float(max(slope, 0.05)), float(offset)
    return field


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ``held_out``, ``score``, ``predicted``. Null texts are empty; repeated rows come back as often as given."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = narrow.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [text_score(field, x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=schema.names)

    return narrow.mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores one half or more."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([text_score(field, x.as_py()) >= 0.5 for x in batch.column(1)], pa.bool_())
            yield batch.filter(good).select([0])

    return rows.mapInArrow(run, rows.select("_row").schema).select("_row.*")
