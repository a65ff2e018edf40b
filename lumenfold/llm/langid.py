"""Language identification: averaged hashed subword embeddings under a linear softmax, fitted by stochastic gradient descent.

A text is the average of the embeddings of its subwords (runs of three and four bytes, which may begin
or end with the space around a word but not run over it), each found by a hash. As the softmax is linear,
embeddings times weights is one table of a row per bucket, and a text's logits are the average of its
subwords' rows. A temperature and a rejection threshold are calibrated on sampled texts that the fit
does not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import crc_fold, map_texts, release_worker
from lumenfold.llm.samples import bounded_sample, different_texts

#: Labelled texts of each language that the model is fitted on.
PER_LANGUAGE = 600
BUCKET_BITS, DIMENSIONS = 15, 16
EPOCHS, RATE = 1, 0.5
#: Characters of the pieces that texts are cut into for the fit, which sees all of every text.
SHORTEST, LONGEST = 12, 160
#: Share of the calibration texts' accepted predictions that may be wrong.
ERRORS = 0.01
UNDETERMINED = "und"
#: ASCII letters and bytes of non-ASCII letters as they are, else a space.
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}").search
#: Subwords that are summed at a time.
BLOCK = 1 << 18


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a text, whole words of any length included in parts."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8").translate(FOLD) + b" ", np.uint8)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    x = raw.astype(np.uint32)
    gap = raw == 32
    three = x[:-2] | x[1:-1] << 8 | x[2:] << 16
    found = [((three * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS))[~gap[1:-1]]]
    if len(raw) > 3:
        four = three[:-1] | x[3:] << 24
        found.append(((four * np.uint32(2246822519)) >> np.uint32(32 - BUCKET_BITS))[~(gap[1:-2] | gap[2:-1])])
    return np.concatenate(found).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """languages, the table of logits by bucket, bias, temperature, and the score below which a guess is rejected."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.table = np.zeros((1 << BUCKET_BITS, max(1, len(languages))), np.float32)
        self.bias = np.zeros(max(1, len(languages)))
        self.temperature, self.reject_below = 1.0, 0.0

    @classmethod
    def fit(cls, texts: list[tuple[str, str]], seed: int = 17) -> LanguageModel:
        model = cls(sorted({lang for _, lang in texts}))
        if len(model.languages) < 2:
            return model
        rng = np.random.default_rng(seed)
        number = {lang: i for i, lang in enumerate(model.languages)}
        order = rng.permutation(len(texts))
        cut = max(1, len(texts) // 5)
        examples = []
        for i in order[cut:].tolist():
            text, lang = texts[i]
            ends = np.cumsum(rng.integers(SHORTEST, LONGEST + 1, len(text) // SHORTEST + 1))
            cuts = [0, *ends[ends < len(text)].tolist(), len(text)]
            examples += [(b, number[lang]) for a, z in zip(cuts, cuts[1:]) if len(b := subwords(text[a:z]))]
        n, width = len(model.languages), DIMENSIONS
        embed = rng.normal(0, 1 / width, (1 << BUCKET_BITS, width))
        weights, bias = rng.normal(0, 0.1, (width, n)), np.zeros(n)
        total, step = EPOCHS * len(examples), 0
        for _ in range(EPOCHS):
            for k in rng.permutation(len(examples)).tolist():
                buckets, right = examples[k]
                mean = embed[buckets].mean(axis=0)
                slope = _softmax(mean @ weights + bias)
                slope[right] -= 1
                rate = RATE * (1 - step / total)
                back = weights @ slope
                weights -= rate * np.outer(mean, slope)
                bias -= 0.1 * rate * slope
                np.subtract.at(embed, buckets, rate * back / len(buckets) * 4)
                step += 1
        model.table, model.bias = (embed @ weights).astype(np.float32), bias
        model._calibrate([(texts[i][0], number[texts[i][1]]) for i in order[:cut].tolist()])
        return model

    def _calibrate(self, held: list[tuple[str, int]]) -> None:
        """The temperature of the least loss, then the lowest score above which at most ERRORS of the guesses are wrong."""
        known = [(self.logits(t), right) for t, right in held if LETTER(t)]
        if not known:
            return
        z, right = np.stack([a for a, _ in known]), np.array([b for _, b in known])
        grid = np.geomspace(0.05, 20, 60)
        losses = [-np.log(_softmax(z / t)[np.arange(len(z)), right] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])
        p = _softmax(z / self.temperature)
        top, wrong = p.max(axis=1), p.argmax(axis=1) != right
        order = np.argsort(-top)
        share = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
        fine = np.nonzero(share <= ERRORS)[0]
        self.reject_below = float(top[order[fine[-1]]]) if len(fine) else 1.0
        if len(fine) == len(order):
            self.reject_below = min(self.reject_below, 0.5)

    def logits(self, text: str) -> np.ndarray:
        found = subwords(text)
        if not len(found):
            return self.bias
        total = np.zeros(self.table.shape[1])
        for at in range(0, len(found), BLOCK):
            total += self.table[found[at : at + BLOCK]].sum(axis=0, dtype=np.float64)
        return total / len(found) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if text is None or not self.languages or not LETTER(text):
            return UNDETERMINED, 0.0, True
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score, rejected. Learns from rows with crc32(id) mod 3 other than 1.

    lang_pred is a learned language, or 'und' (score 0, rejected) where the text is null or has no letter,
    or nothing could be learned. rejected marks guesses under the calibrated score. Rows with a null id
    are neither learned from nor held out. Ids may repeat; other columns are ignored, whatever their names.
    """
    fold = crc_fold(F.col(id_col), 3)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).filter((fold != 1) & F.col(text_col).isNotNull())
    texts = different_texts(bounded_sample(rows, "id", "lang", per_language), "t", "lang", per_language)
    shared = docs.sparkSession.sparkContext.broadcast(LanguageModel.fit(texts))  # a table of fixed size

    def make():
        release_worker()

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, rejected = zip(*map(shared.value.predict, piece.column(1).to_pylist()))
            return pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_texts(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean", text_col)
    return scored.select(id_col, F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
