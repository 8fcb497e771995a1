"""Document quality from a linear-chain CRF over lines (operator 8).

Every line is good (1) or bad (0). Node scores come from features of the line
and of its neighbours, edge scores from a 2 x 2 matrix; the forward-backward
marginals of all lines, weighted by line length, give the document's score.

Lines inherit their document's label in training, on a bounded sample of the
labelled rows (``SAMPLE`` documents, those of lowest hash), which is the only
thing that is ever collected. Scoring is a map over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import append_columns, quoted, text_slices

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 4_000
#: Bytes of text that the sample holds, at most: documents of higher hash go first.
SAMPLE_BYTES = 64 << 20
#: Lines from which on a text is scored by windows of so many.
LONG = 1 << 14
#: Scores from here on are predicted 1.
THRESHOLD = 0.3

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _BANG, _PIPE, _END = b"#*$%&<>@^~_=+\\/{}[]", b"!?", b"|", b".!?:;\""
OWN = 16


def line_features(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    """``OWN`` figures of one line; ``seen`` has the lines before it."""
    size = len(line)
    words = line.split()
    n = len(words)
    if not n:
        return (1.0,) + (0.0,) * (OWN - 2) + (1.0,)
    upper, digit, symbol, bang, pipe = ((size - len(line.translate(None, c))) for c in (_UPPER, _DIGIT, _SYMBOL, _BANG, _PIPE))
    solid = sum(map(len, words))
    distinct = len(set(words)) / n
    again = line in seen
    seen.add(line)
    return (
        1.0, min(n, 60) / 60, min(solid / n, 20) / 10, upper / solid, min(1.0, 4 * upper / solid), digit / solid, symbol / solid, min(1.0, 5 * symbol / solid),
        min(1.0, bang / n), min(1.0, 3 * pipe / n), distinct, float(n > 4 and distinct < 0.5), float(again), float(line.rstrip()[-1] in _END), float(n < 4), 0.0,
    )


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x 3 * OWN) features of each line beside those of its neighbours, and line lengths; a null text is one empty line."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    seen: set[bytes] = set()
    own = np.array([line_features(x, seen) for x in lines], np.float32)
    edge = np.zeros((1, OWN), np.float32)
    wide = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])])
    return wide, np.array([len(x) + 1 for x in lines], np.float64)


@dataclass
class LineCRF:
    node: np.ndarray  # 3 * OWN
    edge: np.ndarray  # 2 x 2

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """P(good) of each line, pair marginals (for training) and log Z by document.

        scores: documents x longest; the first ``lengths`` of a row count.
        """
        d, longest = scores.shape
        node = np.stack([np.zeros_like(scores), scores], -1)
        alpha, beta = np.empty((d, longest, 2)), np.zeros((d, longest, 2))
        alpha[:, 0] = node[:, 0]
        for t in range(1, longest):
            step = alpha[:, t - 1, :, None] + self.edge
            alpha[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + node[:, t]
        for t in range(longest - 2, -1, -1):
            step = self.edge + (node[:, t + 1] + beta[:, t + 1])[:, None, :]
            inside = (t + 1 < lengths)[:, None]
            beta[:, t] = np.where(inside, np.logaddexp(step[:, :, 0], step[:, :, 1]), 0.0)
        last = alpha[np.arange(d), lengths - 1]
        log_z = np.logaddexp(last[:, 0], last[:, 1])
        good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None])
        if not with_pairs:
            return good, None, log_z
        pair = alpha[:, :-1, :, None] + self.edge + (node[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        valid = np.arange(1, longest)[None] < lengths[:, None]
        pairs = np.where(valid[:, :, None, None], np.exp(np.minimum(pair, 0)), 0.0)
        return good, pairs, log_z

    def scores(self, texts: list[str | None]) -> list[float]:
        """Length-weighted mean of the lines' P(good), by document."""
        out = np.empty(len(texts))
        short = [i for i, t in enumerate(texts) if (t or "").count("\n") < LONG]
        parts = [document_features(texts[i]) for i in short]
        for rows, padded, sizes in batches([w for w, _ in parts]):
            good, _, _ = self.marginals(padded @ self.node, sizes, with_pairs=False)
            for i, k, row in zip(rows, sizes, good):
                out[short[i]] = mean_weighted(row[:k], parts[i][1])
        for i in sorted({*range(len(texts))} - {*short}):
            out[i] = self.long_score(texts[i])
        return [float(x) for x in np.round(out, 9)]

    def long_score(self, text: str) -> float:
        """The score of a text of many lines: features by windows of lines, of which only what they add to a line's score and its neighbours' stays, then messages by blocks."""
        data = text.encode("utf-8", "replace")
        ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), len(data))
        starts = np.concatenate([[0], ends[:-1] + 1])
        adds, seen, again = np.empty((len(ends), 3)), set(), {}
        parts = self.node.reshape(3, OWN).T
        for low in range(0, len(ends), LONG):
            rows = []
            for a, z in zip(starts[low : low + LONG].tolist(), ends[low : low + LONG].tolist()):
                line = data[a:z]
                if line in again:  # a line that comes for the third time has the features of the second
                    rows.append(again[line])
                    continue
                known = line in seen
                rows.append(line_features(line, seen))
                if known and len(again) < LONG:
                    again[line] = rows[-1]
            adds[low : low + LONG] = np.array(rows, np.float32) @ parts
        score = adds[:, 0].copy()
        score[1:] += adds[:-1, 1]
        score[:-1] += adds[1:, 2]
        return mean_weighted(chain_marginals(score, self.edge), (ends - starts + 1).astype(np.float64))


def mean_weighted(good: np.ndarray, weight: np.ndarray) -> float:
    return float(np.clip(good @ weight / weight.sum(), 0, 1))


def chain_marginals(scores: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """P(good) of each line of one chain. Lines are dealt into as many blocks as a block has lines; all blocks step together, once for their products and once, from what reaches each, for their messages."""
    n = len(scores)
    size = math.isqrt(n - 1) + 1
    blocks = -(-n // size)
    odds = np.zeros(blocks * size)
    odds[:n] = np.clip(scores, -300, 300)
    node = np.stack([np.exp(np.minimum(-odds, 0)), np.exp(np.minimum(odds, 0))], -1).reshape(blocks, size, 1, 2)
    beyond = (np.arange(blocks * size) >= n).reshape(blocks, size, 1, 1)  # places after the last line pass messages on
    step = np.exp(edge)
    first = np.tile(step, (blocks, 1, 1))
    first[0] = 1  # no line comes before the first

    def ahead(x: np.ndarray, t: int) -> np.ndarray:
        y = np.where(beyond[:, t], x, (x @ (first if t == 0 else step)) * node[:, t])
        return y / y.max((1, 2), keepdims=True)

    def back(x: np.ndarray, t: int) -> np.ndarray:
        y = np.where(beyond[:, t], x, (x * node[:, t]) @ step.T)
        return y / y.max((1, 2), keepdims=True)

    forth = hence = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(size):
        forth = ahead(forth, t)
    for t in range(size - 1, -1, -1):
        hence = back(hence, t)
    reach, come = np.ones((blocks, 1, 2)), np.ones((blocks, 1, 2))
    for b in range(1, blocks):
        reach[b] = reach[b - 1] @ forth[b - 1]
        reach[b] /= reach[b].max()
    for b in range(blocks - 2, -1, -1):
        come[b] = come[b + 1] @ hence[b + 1]
        come[b] /= come[b].max()
    both = np.empty((blocks, size, 2))
    for t in range(size):
        reach = ahead(reach, t)
        both[:, t] = reach[:, 0]
    for t in range(size - 1, -1, -1):
        both[:, t] *= come[:, 0]
        come = back(come, t)
    both = both.reshape(-1, 2)[:n]
    return both[:, 1] / both.sum(1)


def batches(features: list[np.ndarray], cells: int = 50_000):
    """(documents, padded features, line counts) of documents alike in length, so that padding stays small."""
    order = sorted(range(len(features)), key=lambda i: len(features[i]))
    at = 0
    while at < len(order):
        end, longest = at, 0
        while end < len(order) and (longest == 0 or (max(longest, len(features[order[end]])) * (end - at + 1) <= cells and len(features[order[end]]) <= 2 * len(features[order[at]]) + 4)):
            longest = max(longest, len(features[order[end]]))
            end += 1
        rows = order[at:end]
        padded = np.zeros((len(rows), longest, features[rows[0]].shape[1]), np.float32)
        for k, i in enumerate(rows):
            padded[k, : len(features[i])] = features[i]
        yield rows, padded, np.array([len(features[i]) for i in rows])
        at = end


def train(texts: list[str | None], labels: list[int], steps: int = 150, rate: float = 0.15, l2: float = 1e-3) -> LineCRF:
    """Maximum conditional likelihood by Adam; each document weighs the same, whatever its number of lines."""
    features = [document_features(t)[0] for t in texts]
    y = np.array(labels, np.float64)
    prepared = list(batches(features))
    crf = LineCRF(np.zeros(3 * OWN), np.zeros((2, 2)))
    if not texts:
        return crf
    m, v = np.zeros(3 * OWN + 4), np.zeros(3 * OWN + 4)
    for step in range(1, steps + 1):
        grad = np.zeros(3 * OWN + 4)
        for rows, padded, sizes in prepared:
            good, pairs, _ = crf.marginals(padded @ crf.node, sizes)
            inside = np.arange(padded.shape[1])[None] < sizes[:, None]
            share = 1 / sizes
            error = np.where(inside, y[rows][:, None] - good, 0.0) * share[:, None]
            grad[: 3 * OWN] += np.einsum("dt,dtf->f", error, padded)
            seen = np.zeros((len(rows), 2, 2))
            seen[np.arange(len(rows)), y[rows].astype(int), y[rows].astype(int)] = sizes - 1
            grad[3 * OWN :] += ((seen - pairs.sum(1)) * share[:, None, None]).sum(0).ravel()
        theta = np.concatenate([crf.node, crf.edge.ravel()])
        grad = grad / len(y) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        crf = LineCRF(theta[: 3 * OWN], np.clip(theta[3 * OWN :].reshape(2, 2), -2.0, 2.0))
    return crf


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> LineCRF:
    """Fit on at most ``sample`` labelled documents that are not held out, those of lowest hash of id.

    Ids with several labels count by their lowest, ids with several texts by the
    smallest; null labels and ids do not count. Without any labelled document, as
    in an empty table, every score is one half.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Where an id repeats, the smallest of its texts counts.
    rows = docs.select("doc_id", F.col(quoted(text)).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    texts, marks, size = [], [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        size += len(r.text or "")
        if size > SAMPLE_BYTES and texts:
            break
        texts.append(r.text)
        marks.append(int(r.quality))
    return train(texts, marks)


def score(docs: DataFrame, model: LineCRF, text: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """``_row`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), of which only_kept leaves those predicted 1.

    Nothing but the text enters a score, and all of it, however long. Null and
    empty texts are one empty line. Repeated rows give repeated rows, an empty
    table an empty result. Columns named like the results stay apart, in ``_row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches):
        import pyarrow as pa

        crf = shared.value
        for (texts,) in batches:
            # Slices bound what is held in features at once.
            scores = [x for part in text_slices(texts, 1 << 20) for x in crf.scores(part.to_pylist())]
            kept = [s >= threshold for s in scores]
            yield [scores, [int(k) for k in kept]], pa.array(kept, pa.bool_()) if only_kept else None

    return append_columns(docs, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute, carry, "crf")
