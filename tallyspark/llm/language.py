"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Byte 2-, 3- and 4-grams of the text (A-Z lower-cased, spaces around it) are hashed into buckets. A document is the
average of its grams' embeddings; a linear layer and a softmax give the language. The classifier is fitted on a
sample of at most TRAIN_DOCUMENTS labelled rows with about TRAIN_BYTES of text at most, spread over the table by a
hash (texts of more than LONGEST bytes are predicted, but not learned from); a fifth of them is held back to
fit a temperature, so that scores are probabilities, and the score below which a prediction is rejected: the one
that REJECT of the right predictions held back stay under, and never more than MOST_REJECTING. Embedding and linear
layer are multiplied out before prediction, so every gram costs one row of a small table. All rows are predicted.

Defined results: null text, or text without a letter, is `und` with score 0 and rejected; with nothing to learn
from, so is everything; texts are read whole; repeated rows are predicted alike; rows with a null id aren't learned
from and aren't held out; an empty table gives an empty result. Columns other than id, text and language aren't
read, and of these only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import text_chunks
from .shared import table, tidy

TRAIN_DOCUMENTS = 4000
TRAIN_BYTES = 1 << 25  # of text that the sample has (about)
LONGEST = 1 << 20  # longer texts aren't learned from
BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 15, 16, 4, 0.6
LEAST_STEPS = 12_000  # small samples are gone through more often
REJECT, MOST_REJECTING = 0.002, 0.5
SIZES = (2, 3, 4)
PAD = b" " * 4
UNKNOWN = "und"

_CODE = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32)
_CODE[65:91] = _CODE[97:123]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def gram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each gram size, the bucket of the gram at each position that has four bytes left."""
    codes = _CODE[data]
    n = len(codes) - 3
    rolled, out = codes[:n].copy(), []
    for k in range(1, 4):
        rolled = rolled * np.uint32(0x01000193) + codes[k : n + k]
        if k + 1 in SIZES:
            x = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(x >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with spaces between them; where each one's grams begin and end."""
    data = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + len(PAD)) - sizes
    return data, starts - 1, starts + sizes


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # of each bucket, for each language
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        data, starts, ends = laid_out(texts)
        total = np.zeros((len(texts), len(self.languages)))
        bounds = np.stack([starts, ends], axis=1).reshape(-1)
        for spots in gram_buckets(data):
            total += np.add.reduceat(np.take(self.weights, spots, axis=0), bounds, axis=0, dtype=np.float64)[::2]
        return total / (len(SIZES) * (ends - starts))[:, None] + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        p = self.probabilities(texts)
        best, score = p.argmax(axis=1), p.max(axis=1)
        names, scores, out = [], [], []
        for text, b, s in zip(texts, best.tolist(), score.tolist(), strict=True):
            known = has_letter(text)
            names.append(self.languages[b] if known else UNKNOWN)
            scores.append(s if known else 0.0)
            out.append(not known or s < self.least)
        return names, scores, out


def has_letter(text: bytes) -> bool:
    head = text[:64]
    if _LETTER[np.frombuffer(head, np.uint8)].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 5) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    truth = np.array([languages.index(x) for x in labels])
    bags = []
    for text in texts:
        data, starts, ends = laid_out([text])
        spots = np.concatenate([s[starts[0] : ends[0]] for s in gram_buckets(data)])
        own, counts = np.unique(spots, return_counts=True)
        bags.append((own, (counts / len(spots)).astype(np.float32)))
    order = rng.permutation(len(texts))
    fit, back = (order[len(order) // 5 :], order[: len(order) // 5]) if len(order) >= 50 else (order, order)
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(fit)))
    steps, at = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            own, share = bags[i]
            rate = RATE * (1 - at / steps)
            at += 1
            hidden = share @ embed[own]
            slope = softmax(hidden @ layer + bias)
            slope[truth[i]] -= 1
            back_to = layer @ slope
            layer -= rate * np.outer(hidden, slope)
            bias -= 0.1 * rate * slope
            # The gradient of an average is small for each gram; the factor keeps embeddings and layer in step.
            embed[own] -= (rate * 20 * share)[:, None] * back_to[None, :]
    model = Model(languages, (embed @ layer).astype(np.float32), bias.astype(np.float64))
    raw, right = np.concatenate([model.logits([texts[i]]) for i in back]), truth[back]
    loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(right)), right], 1e-300)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = softmax(raw / model.temperature)
    sure = p.max(axis=1)[p.argmax(axis=1) == right]
    model.least = float(min(np.quantile(sure, REJECT), MOST_REJECTING)) if len(sure) else 0.0
    return model


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on at most `most` rows that have a text, a language and an id that isn't held out."""
    size = F.octet_length(text_col)
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(id_col) & (size <= LONGEST))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    share = int(min(1.0, most / max(n, 1), TRAIN_BYTES / max(total, 1)) * (1 << 30))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("language"), id_col), F.lit(1 << 30)) < share).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sample = sorted((r["i"], r["t"], r["l"]) for r in chosen.limit(most).collect())
    return train([t.encode() for _, t, _ in sample], [x for _, _, x in sample])


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (id_col, kept columns, lang_pred, score, rejected). Only the text goes through Python."""

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores, rejected = [], [], []
        for _, own in text_chunks(pa.record_batch([texts], ["text"]), 0):
            for out, more in zip((names, scores, rejected), model.predict(own), strict=True):
                out += more
        tidy()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    found = docs.select(F.col(id_col), *(keep or []), predicted(F.col(text_col)).alias("_found"))
    return found.select(id_col, *(keep or []), "_found.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_languages(docs))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_language": op4_language}
SQL: dict[str, str] = {}
