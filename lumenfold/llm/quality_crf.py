"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are what it looks like and what the lines beside it look like;
the chain's transitions say how lines of a kind follow each other. Labels exist for documents only, so
lines of good documents are good, and those of bad documents are at first all bad; then the fitted field
says which of them are (one at least) and is fitted again. The forward-backward marginals, weighted by
the lines' lengths, give a document's bad share, and a logistic curve turns that into a score.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import crc_fold, map_texts, release_worker
from lumenfold.llm.samples import labelled_texts

#: Labelled texts of either class that the field is fitted on.
PER_LABEL = 1500
THRESHOLD = 0.3
ROUNDS, STEPS = 3, 120
SYMBOLS, UPPER, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
OTHER = bytes(c for c in range(128) if not chr(c).isalpha())
OWN = 11
FEATURES = 1 + 3 * OWN


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths in bytes with the line end) of a text's lines: a constant, the line's own, and both neighbours'."""
    lines = text.encode("utf-8").split(b"\n")
    own = np.zeros((len(lines), OWN))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        n = len(line)
        words = line.split()
        if not words:
            own[i, 0] = 1
            continue
        letters = len(line.translate(None, OTHER))
        own[i, 1:] = (
            (n - len(line.translate(None, SYMBOLS))) / n,
            line.count(b"!") / n,
            (n - len(line.translate(None, UPPER))) / max(letters, 1),
            (n - len(line.translate(None, DIGITS))) / n,
            sum(map(eq, words, words[1:])) / len(words),
            1 - len(set(words)) / len(words),
            line in seen,
            len(words) < 4,
            min(len(words), 200) / 200,
            min(n / len(words), 40) / 40,
        )
        seen.add(line)
    beside = np.zeros((len(lines), 2 * OWN))
    beside[1:, :OWN], beside[:-1, OWN:] = own[:-1], own[1:]
    return np.hstack([np.ones((len(lines), 1)), own, beside]), np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines))


#: Steps of so many texts and fewer, the ends of very long ones, are walked line by line.
FEW = 3


class Chains:
    """Texts' lines side by side: step t holds the t-th lines of the texts that have one, longest texts first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)
        self.first, self.sizes = (ends - sizes)[self.order], sizes[self.order]
        longest = int(sizes.max()) if len(sizes) else 0
        self.active = np.searchsorted(-sizes[self.order], -np.arange(longest), side="left")

    def marginals(self, scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of each line, and the summed expected counts of the four transitions."""
        step = np.exp(transitions - transitions.max())
        scores = np.clip(scores, -40, 40)
        emit = np.stack([np.exp(-np.maximum(scores, 0)), np.exp(np.minimum(scores, 0))], axis=1)
        ahead = np.zeros_like(emit)
        few = np.flatnonzero(self.active <= FEW)
        cut = int(few[0]) if len(few) else len(self.active)
        for t, n in enumerate(self.active[:cut]):
            at = self.first[:n] + t
            now = emit[at] if t == 0 else (ahead[at - 1] @ step) * emit[at]
            ahead[at] = now / now.sum(axis=1, keepdims=True)
        bad = np.zeros(len(scores))
        expected = np.zeros((2, 2))
        back = np.ones((len(self.first), 2))
        for j in range(int(self.active[cut]) if cut < len(self.active) else 0):
            back[j] = self._alone(j, cut, emit, ahead, step, bad, expected)
        for t in range(cut - 1, -1, -1):
            n = self.active[t]
            at = self.first[:n] + t
            both = ahead[at] * back[:n]
            bad[at] = both[:, 1] / both.sum(axis=1)
            if t:
                later = emit[at] * back[:n]
                pair = ahead[at - 1][:, :, None] * step[None] * later[:, None, :]
                expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back[:n] = later @ step.T
                back[:n] /= back[:n].sum(axis=1, keepdims=True)
        return bad, expected


    def _alone(self, j: int, cut: int, emit: np.ndarray, ahead: np.ndarray, step: np.ndarray, bad: np.ndarray, expected: np.ndarray) -> tuple[float, float]:
        """marginals() of the lines of text j from step `cut` on, one by one; what it passes back to the line before."""
        (s00, s01), (s10, s11) = step.tolist()
        begin, end = int(self.first[j]) + cut, int(self.first[j] + self.sizes[j])
        emits = emit[begin:end].tolist()
        a, b = ahead[begin - 1].tolist() if cut else (1.0, 1.0)
        before, states = (a, b), []
        for k, (x, y) in enumerate(emits):
            a, b = (x, y) if not cut and not k else ((a * s00 + b * s10) * x, (a * s01 + b * s11) * y)
            total = a + b
            a, b = a / total, b / total
            states.append((a, b))
        marks, counts = [0.0] * len(states), [0.0, 0.0, 0.0, 0.0]
        u, v = 1.0, 1.0
        for k in range(len(states) - 1, -1, -1):
            a, b = states[k]
            marks[k] = b * v / (a * u + b * v)
            if k or cut:
                a, b = states[k - 1] if k else before
                x, y = emits[k][0] * u, emits[k][1] * v
                pairs = a * s00 * x, a * s01 * y, b * s10 * x, b * s11 * y
                total = sum(pairs)
                counts = [c + p / total for c, p in zip(counts, pairs)]
                u, v = x * s00 + y * s01, x * s10 + y * s11
                total = u + v
                u, v = u / total, v / total
        bad[begin:end] = marks
        expected += np.array(counts).reshape(2, 2)
        return u, v


class LineField:
    """Weights of the scaled features for bad lines, transitions, and the curve from bad share to score."""

    def __init__(self):
        self.centre, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights, self.transitions = np.zeros(FEATURES), np.zeros((2, 2))
        self.level, self.slope = 0.0, 0.0

    def _scores(self, features: np.ndarray) -> np.ndarray:
        return (features - self.centre) / self.scale @ self.weights

    def fit(self, texts: list[tuple[str, int]]) -> LineField:
        marks = np.array([m for _, m in texts])
        if not len(texts) or (marks == marks[0]).all():
            self.level = 0.0 if not len(texts) else 4.0 if marks[0] == 1 else -4.0
            return self
        parts = [line_features(t) for t, _ in texts]
        features = np.vstack([f for f, _ in parts])
        sizes = np.array([len(f) for f, _ in parts])
        lengths = np.concatenate([n for _, n in parts])
        text = np.repeat(np.arange(len(texts)), sizes)
        self.centre, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        self.centre[0], self.scale[0] = 0, 1
        x = (features - self.centre) / self.scale
        chains = Chains(sizes)
        follows = np.concatenate(([False], text[1:] == text[:-1]))
        at = np.nonzero(follows)[0]
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bad = (marks == 0)[text].astype(float)
        for _ in range(ROUNDS):
            counts = np.zeros((2, 2))
            np.add.at(counts, (bad[at - 1].astype(int), bad[at].astype(int)), 1)
            self._climb(x, chains, bad, counts)
            p, _ = chains.marginals(x @ self.weights, self.transitions)
            top = np.maximum.reduceat(p, start)[text]
            bad = ((marks == 0)[text] & ((p > 0.5) | (p == top))).astype(float)
        self._calibrate(self.bad_shares(p, lengths, sizes), marks)
        return self

    def _climb(self, x: np.ndarray, chains: Chains, bad: np.ndarray, counts: np.ndarray) -> None:
        """Adam ascent of the mean log-likelihood with a small square penalty."""
        n = len(x)
        params = np.concatenate([self.weights, self.transitions.ravel()])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for k in range(1, STEPS + 1):
            self.weights, self.transitions = params[:FEATURES], params[FEATURES:].reshape(2, 2)
            p, expected = chains.marginals(x @ self.weights, self.transitions)
            slope = np.concatenate([x.T @ (bad - p), (counts - expected).ravel()]) / n - 1e-4 * params
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            params = params + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights, self.transitions = params[:FEATURES], params[FEATURES:].reshape(2, 2)

    @staticmethod
    def bad_shares(p: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        start = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        return np.add.reduceat(p * lengths, start) / np.add.reduceat(lengths, start)

    def _calibrate(self, share: np.ndarray, good: np.ndarray) -> None:
        """A logistic curve by damped Newton steps with a penalty that keeps it finite."""
        x = np.stack([np.ones(len(share)), share], axis=1)
        b = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (good - p) - 0.05 * b)
        self.level, self.slope = b

    def score(self, texts: list[str | None]) -> list[float]:
        """P(good) of each text; an empty one has one empty line."""
        parts = [line_features(t or "") for t in texts]
        sizes = np.array([len(f) for f, _ in parts])
        p, _ = Chains(sizes).marginals(self._scores(np.vstack([f for f, _ in parts])), self.transitions)
        share = self.bad_shares(p, np.concatenate([n for _, n in parts]), sizes)
        return (1 / (1 + np.exp(-np.clip(self.level + self.slope * share, -500, 500)))).tolist()


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. Learns from labelled rows with crc32(id) mod 5 other than 0.

    Null and empty texts are one empty line. Rows with a null id are not held out. Without labels of
    both classes every score is the same. Ids may repeat; other columns are ignored, whatever their names.
    """
    fold = crc_fold(F.col(id_col), 5)
    field = fit_quality(docs, labels, fold != 0, PER_LABEL, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen weights

    def make():
        release_worker()

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            score = shared.value.score(piece.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([piece.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_texts(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, score double", text_col)
    held = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return scored.select(id_col, held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, per_label: int, id_col: str, text_col: str, label_col: str) -> LineField:
    return LineField().fit(labelled_texts(docs, labels, label_col, train, per_label, id_col, text_col))
