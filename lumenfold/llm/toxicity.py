"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary texts, one on what is particular to toxic texts. A window is a word
in a frame of fixed bytes that both dictionaries hold: the frame pays the fixed costs of a block, so the
compressed length shows what the word itself costs. A word's first letter is marked, so that a match of a
word's beginning is not one inside another word. A window's gain is its length under the ordinary dictionary
less its length with the toxic one added; a window that repeats in a text counts once. Gains become
log-likelihood ratios by what they are in held-out parts of the sample; their sum over the whole text is
set against a calibrated threshold.

A toxic dictionary trained on all windows of toxic texts was tried first and does not work: toxic texts are
ordinary but for a few words, and fill it with ordinary words (the README has the figures). Its training
texts are therefore cut down to the words, or beginnings of words, that toxic texts hold more often.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import crc_fold, fresh, kept_in_worker, map_texts, release_worker
from lumenfold.llm.samples import labelled_texts

#: Letters in lower case, bytes of non-ASCII letters as they are, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
FRAME = b"<@[0123456789]=", b"=[9876543210]@>"
#: Labelled texts of either class that the dictionaries are trained on.
PER_LABEL = 1500
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2_048
FOLDS = 4
#: Bytes of the beginnings of words that count beside whole words.
PREFIXES = (5, 6, 7, 8)
#: A part of a word is toxic text's own if it is so many times as frequent there, and the G statistic of its counts so
#: large that about CHANCE of all parts would reach it by chance.
ODDS, CHANCE = 4, 30
#: Gains in bytes that have a weight of their own; others count as the nearest.
GAINS = range(0, 13)
#: Texts that hold a word whose toxic share is used.
USUAL = 20
#: Toxic texts that hold a part, and different words before it, at least.
FEWEST = 3
THRESHOLD = 0.3
#: What a wrongly rejected share of ordinary texts weighs beside an equal missed share of toxic ones.
CLEAN_WEIGHT = 2.5
#: Bytes that a match in a dictionary has at least.
MIN_MATCH = 5
REMEMBERED = 400_000


def windows(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(LETTERS).split()


def _marked(word: bytes) -> bytes:
    """A word with its first byte changed to one that stands in no word: a capital for a letter."""
    return bytes([word[0] ^ 32]) + word[1:]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, all of the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from the words of texts.

    The toxic one sees, of each toxic text, the words that are wholly or by their first bytes more frequent in
    toxic texts by ODDS and beyond chance, cut to the longest such beginning, and that follow several different
    words, which words of copied passages do not.
    """
    parts = {w: _parts(w) for words in (*toxic, *ordinary) for w in words}
    plain, texts, expected = Counter(), Counter(), Counter()
    different = [[set(words) for words in side] for side in (toxic, ordinary)]
    shares = _toxic_shares(*different)
    overall = len(toxic) / max(len(toxic) + len(ordinary), 1)
    for side, count in zip(different, (texts, plain)):
        for words in side:
            known = [shares[w] for w in words if w in shares]
            usual = float(np.median(known)) if known else overall
            found = {p for w in words for p in parts[w]}
            count.update(found)
            for p in found:
                expected[p] += usual

    evidence = 2 * math.log(max(len(expected), 1) / CHANCE)

    def particular(part: bytes, n: int) -> bool:
        m = plain[part]
        hope = min(max(expected[part], 1e-3), n + m - 1e-3)
        rest = n + m - hope
        if n < FEWEST or n * rest < ODDS * (m + 0.5) * hope:  # half a text is added to the ordinary ones, none being no proof
            return False
        return 2 * (n * math.log(n / hope) + (m * math.log(m / rest) if m else 0)) >= evidence

    own = {p for p, n in texts.items() if particular(p, n)}
    marked = {w: hits for w, of in parts.items() if (hits := own.intersection(of))}
    before = defaultdict(set)
    for words in toxic:
        for a, b in zip([b"", *words], words):
            for part in marked.get(b, ()):
                before[part].add(a)
    own = {p for p in own if len(before[p]) >= FEWEST}
    # A beginning stands before a whole word, as it also is that of other words.
    best = {w: max(left, key=lambda p: (p[-1] != 32, len(p))) for w, hits in marked.items() if (left := hits & own)}
    samples = [b"".join(b" " + _marked(best[w]) + b" " for w in words if w in best) for words in toxic]
    return _trained(ORDINARY_BYTES, [b" ".join(map(_marked, w)) for w in ordinary]), _trained(TOXIC_BYTES, [s for s in samples if s])


def _toxic_shares(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> dict[bytes, float]:
    """Of the texts that hold a word, for words of USUAL texts and more, the share that is toxic."""
    yes, no = (Counter(w for words in side for w in words) for side in (toxic, ordinary))
    return {w: yes[w] / n for w in yes | no if (n := yes[w] + no[w]) >= USUAL}


def _parts(word: bytes) -> tuple[bytes, ...]:
    return (word + b" ", *(word[:n] for n in PREFIXES if len(word) > n))


class Gains:
    """What a word's window gains by the toxic dictionary, in bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        frame = b"".join(FRAME)
        self.plain, self.both = (self._compressor(d + frame).compress for d in (ordinary, ordinary + toxic))
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=MIN_MATCH, target_length=0,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False,
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many different windows have each of GAINS."""
        return np.bincount(self.of(list(set(words))), minlength=len(GAINS)).astype(float)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Gains of words, within GAINS and counted from its start."""
        known = self.known
        for w in [w for w in set(words) if w not in known]:
            window = FRAME[0] + b" " + _marked(w) + b" " + FRAME[1]
            gain = len(self.plain(window)) - len(self.both(window))
            if len(known) > REMEMBERED:
                known.clear()
            known[w] = min(max(gain, GAINS[0]), GAINS[-1]) - GAINS[0]
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:  # the memory was emptied on the way, or one text has more words than it
            return np.fromiter((known[w] if w in known else int(self.of([w])[0]) for w in words), np.int64, len(words))


def _trained_fold(texts: list[tuple[str, int]], fold: int) -> object:
    """The counts of gains of a fold's texts by dictionaries that have not seen them; for the fold FOLDS, which has no
    texts, the dictionaries themselves."""
    words = [windows(t) for t, _ in texts]
    sides = [[words[i] for i, (_, mark) in enumerate(texts) if mark == side and (i % FOLDS != fold or fold == FOLDS)] for side in (1, 0)]
    dictionaries = train_dictionaries(*sides)
    if fold == FOLDS:
        return dictionaries
    gains = Gains(*dictionaries)
    return np.array([gains.counts(w) for w in words[fold::FOLDS]]).reshape(-1, len(GAINS))


def _trained_folds(texts: list[tuple[str, int]], spark: SparkSession | None) -> list:
    if spark is None:
        return [_trained_fold(texts, k) for k in range(FOLDS + 1)]
    shared = spark.sparkContext.broadcast(texts)  # a bounded sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            for fold in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([pickle.dumps(_trained_fold(shared.value, fold))], pa.binary())], names=["fold", "found"])

    found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "fold long, found binary").collect()
    shared.destroy()
    return [pickle.loads(r["found"]) for r in sorted(found, key=lambda r: r["fold"])]


class ToxicityModel:
    """Dictionaries, the weight of each gain, and the sum that stands for a score of THRESHOLD."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, threshold: float):
        self.ordinary, self.toxic, self.weights, self.threshold = ordinary, toxic, weights, threshold

    @classmethod
    def fit(cls, texts: list[tuple[str, int]], spark: SparkSession | None = None) -> ToxicityModel:
        """Weights and threshold come from texts that the dictionaries used for them did not see. The folds, and the
        dictionaries of all texts, are a task each of a session, or are trained one after the other without one."""
        marks = [label for _, label in texts]
        counts = np.zeros((len(texts), len(GAINS)))
        *folds, (ordinary, toxic_part) = _trained_folds(texts, spark)
        for fold, found in enumerate(folds):
            counts[fold::FOLDS] = found
        toxic = np.array(marks) == 1
        rates = [counts[side].sum(axis=0) + 0.5 for side in (toxic, ~toxic)] if len(texts) else [np.ones(len(GAINS))] * 2
        weights = np.log(rates[0] / rates[0].sum()) - np.log(rates[1] / rates[1].sum())
        sums = counts @ weights
        threshold = np.inf
        if toxic.any() and not toxic.all():
            cuts = np.unique(sums)
            cuts = np.concatenate(((cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]))
            right = CLEAN_WEIGHT * np.searchsorted(np.sort(sums[~toxic]), cuts) / (~toxic).sum() - np.searchsorted(np.sort(sums[toxic]), cuts) / toxic.sum()
            best = np.nonzero(right >= right.max() - 1e-12)[0]
            threshold = float(cuts[best[len(best) // 2]])
        elif toxic.any():
            threshold = -np.inf
        return cls(ordinary, toxic_part, weights, threshold)

    def score(self, gains: Gains, text: str | None) -> float:
        """1 / (1 + e^-x), x the sum less the threshold, shifted so that the threshold scores THRESHOLD."""
        if not np.isfinite(self.threshold):
            return 0.0 if self.threshold > 0 else 1.0
        words = windows(text)
        total = float(gains.counts(words) @ self.weights)
        x = total - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text", into: str = "score") -> DataFrame:
    """Columns `keep` of docs with column `into`, the score (0 to 1), over whole texts. Null and wordless texts score as no evidence does."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries and a table of fixed size
    names = [*keep, *([] if text_col in keep else [text_col])]

    def make():
        m = shared.value
        gains = kept_in_worker(("gains", m.ordinary, m.toxic), lambda: Gains(m.ordinary, m.toxic))

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = piece.column(piece.schema.get_field_index(text_col)).to_pylist()
            columns = [piece.column(piece.schema.get_field_index(c)) for c in keep]
            return pa.RecordBatch.from_arrays([*columns, pa.array([m.score(gains, t) for t in texts], pa.float64())], names=[*keep, into])

        return work

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(docs.select(*[F.col(f"`{c}`") for c in names]), make, f"{schema}, `{into}` double", text_col)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    return ToxicityModel.fit(labelled_texts(docs, labels, label_col, train, per_label, id_col, text_col), docs.sparkSession)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. Learns from labelled rows with crc32(id) mod 4 other than 2.

    Null and empty texts are scored as texts without evidence. Rows with a null id are not held out.
    Without labels of both classes every score is 0 (or 1, if all labels are toxic). Ids may repeat.
    """
    fold = crc_fold(F.col(id_col), 4)
    model = fit_toxicity(docs, labels, fold != 2, id_col=id_col, text_col=text_col)
    scored = score_toxicity(docs.select(id_col, text_col), model, [id_col], text_col, "score" if id_col != "score" else "score_")
    held = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    score = F.col(scored.columns[-1])
    return scored.select(id_col, held, score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below THRESHOLD; columns and names stay, whatever they are."""
    model = fit_toxicity(docs, labels, crc_fold(F.col(id_col), 4) != 2, id_col=id_col, text_col=text_col)
    score = fresh(docs.columns, "__score")
    return score_toxicity(docs, model, docs.columns, text_col, score).filter(F.col(score) < THRESHOLD).drop(score)
