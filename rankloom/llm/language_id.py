"""Operator 7: language identification.

A document is the average of the embeddings of its hashed subwords (character
n-grams of its words, with word borders), followed by a linear softmax. Embeddings
and weights are trained together by stochastic gradient descent in numpy, on
about SAMPLE_A_LANG labelled rows of each language, SAMPLE_ROWS in all, chosen by a hash of
the id; every language is learned. Of these rows the whole texts are counted on the
executors, so that the driver gets at most BUCKETS numbers a row. A part of the sample is
kept out of the training to fit a temperature and what is rejected: the rows kept out, and
a part of each for every shorter band of lengths, are scored, and the least score is the one
that all but REJECT_CORRECT of the rightly labelled ones reach. For each band there is also
a largest share of subwords that no learned text has, as far beyond what all but
REJECT_CORRECT keep to as that is from the median, so that texts of a known language stay.

As the model is linear, embedding and weights of a subword are multiplied once. The
subwords of a text are hashed in numpy, all at once, and nothing is kept between texts.

Cases: null texts and texts without a letter are `und` with score 0 and are
rejected; rows without a label are not learned from; without any label everything
is `und`; with one language every text gets it; repeated rows are predicted row by row;
of equal scores the language first in the alphabet is taken; an empty table gives an empty table; other columns pass through, and those named
lang_pred, score or rejected are replaced.
"""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, slices, table
from .shingles import mix

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
FACTORS = mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)
SAMPLE_A_LANG = 600
SAMPLE_ROWS = 48_000
DIMENSION = 16
STEPS = 1200
RATE = 4.0
BATCH = 32
REJECT_CORRECT = 0.001
BAND_WORDS = (1, 2, 4, 8, 16, 32, 64)  # the least words of each band
WORD = re.compile(r"[^\W\d_]+")


def subwords(words: list[str]) -> np.ndarray:
    """The hashed n-grams of one to three characters of words between borders."""
    marked = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = marked == ord(">")  # no n-gram goes on behind the end of a word
    first, second, third = (marked * x for x in FACTORS)
    grams = [first, (first[:-1] + second[1:] + np.uint64(1))[~ends[:-1]], (first[:-2] + second[1:-1] + third[2:] + np.uint64(2))[~(ends[:-2] | ends[1:-1])]]
    return (mix(np.concatenate(grams)) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


def text_words(text: str | None) -> list[str]:
    """The lower-case words of a text; none if it has no letter."""
    words = WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _parts(words: list[str]) -> list[bytes]:
    """The subwords of a part of each band's length from the middle of a text; none for
    the band of the text and those above, which the whole text stands for."""
    own = _band(len(words))
    return [subwords(words[len(words) // 2 :][:n]).tobytes() for n in BAND_WORDS[:own]]


def _band(words: int) -> int:
    return max(0, bisect.bisect_right(BAND_WORDS, words) - 1)


def _counts(batches):
    """The subword counts of whole texts, and the subwords of their parts."""
    for batch in slices(batches):
        rows, sizes, parts = [], [], []
        for text in batch.column("text").to_pylist():
            words = text_words(text)
            sizes.append(len(words))
            parts.append(_parts(words))
            rows.append(np.bincount(subwords(words), minlength=BUCKETS) if words else np.zeros(BUCKETS, np.int64))
        found = [np.flatnonzero(c) for c in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([f.astype(np.uint16).tobytes() for f in found]), pa.array([(c[f] / max(1, c.sum())).astype(np.float32).tobytes() for c, f in zip(rows, found, strict=True)]), pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.binary()))],
            names=["lang", "feature", "share", "words", "parts"],
        )


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[dict]:
    """About SAMPLE_A_LANG rows of each language, and SAMPLE_ROWS of all, by a hash of the id,
    as subword shares in a fixed order."""
    labelled = df.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang")).distinct()
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = min(SAMPLE_A_LANG, SAMPLE_ROWS / max(1, sizes.count()))
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    ids = labelled.join(F.broadcast(sizes), "lang").where(draw * F.col("n") < share).select("key", "lang")  # one row a language
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(ids), ["key", "lang"])  # about SAMPLE_ROWS ids at most
    out = own.select("key", "lang", "text").mapInArrow(lambda batches: _counts(batches), "lang string, feature binary, share binary, words int, parts array<binary>")
    rows = [{"lang": r["lang"], "feature": np.frombuffer(r["feature"], np.uint16), "share": np.frombuffer(r["share"], np.float32), "words": r["words"], "parts": r["parts"]} for r in out.toLocalIterator() if r["feature"]]
    return sorted(rows, key=lambda r: (zlib.crc32(r["feature"].tobytes()), zlib.crc32(r["share"].tobytes()), r["lang"]))


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # of each subword, BUCKETS x langs
    bias: np.ndarray
    temperature: float
    least: float  # score
    seen: np.ndarray  # whether a learned text has the subword
    most: np.ndarray  # share of subwords that are not seen, by band

    def rejects(self, words: int, score: float, unseen: float) -> bool:
        band = _band(words)
        return bool(words == 0 or score < self.least or unseen > self.most[band])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for n, r in enumerate(rows):
        out[n, r["feature"]] = r["share"]
    return out


def train(rows: list, seed: int = 5) -> Model | None:
    """The averaged-embedding softmax, its temperature and what it rejects."""
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    draw, number = np.random.default_rng(seed), {x: n for n, x in enumerate(langs)}
    held = rows[::5] if len(rows) >= 50 else rows
    fit = [r for n, r in enumerate(rows) if n % 5] if len(rows) >= 50 else rows
    embedding = draw.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    weights, bias = draw.normal(0, 0.1, (DIMENSION, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    labels = np.array([number[r["lang"]] for r in fit])
    share = np.bincount(labels, minlength=len(langs)) / len(labels)
    order = np.concatenate([draw.permutation(len(fit)) for _ in range(-(-STEPS * BATCH // len(fit)))])
    for step in range(STEPS):
        rate, part = RATE * (1 - step / STEPS), order[step * BATCH : (step + 1) * BATCH]
        x, y = _dense([fit[i] for i in part]), labels[part]
        hidden = x @ embedding
        error = _softmax(hidden @ weights + bias)
        error[np.arange(len(y)), y] -= 1
        error /= (share[y] * len(langs) * len(y))[:, None]  # each language weighs the same
        back = error @ weights.T
        weights -= rate * hidden.T @ error
        bias -= rate * error.sum(axis=0)
        embedding -= rate * x.T @ back
    logits = (embedding @ weights).astype(np.float32)
    z = np.concatenate([_dense(held[i : i + 256]) @ logits + bias for i in range(0, len(held), 256)])
    y = np.array([number[r["lang"]] for r in held])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.2, 20, 60), key=loss))
    seen = np.zeros(BUCKETS, bool)
    for r in fit:
        seen[r["feature"]] = True
    tests = [(_band(r["words"]), z[n], y[n], float(r["share"][~seen[r["feature"]]].sum())) for n, r in enumerate(held)]
    for n, r in enumerate(held):
        for band, part in enumerate(r["parts"]):
            found = np.frombuffer(part, np.uint16)
            tests.append((band, logits[found].mean(axis=0) + bias, y[n], float((~seen[found]).mean())))
    right = [t[1] for t in tests if t[1].argmax() == t[2]]
    least = float(np.quantile(_softmax(np.array(right) / temperature).max(axis=1), REJECT_CORRECT)) if right else 0.0
    most = np.ones(len(BAND_WORDS))
    for band in range(len(BAND_WORDS)):
        own = [t for t in tests if t[0] == band and t[1].argmax() == t[2]]
        if own:
            unseen = np.array([t[3] for t in own])
            most[band] = 2 * np.quantile(unseen, 1 - REJECT_CORRECT) - np.median(unseen)
    for r in held:
        seen[r["feature"]] = True
    return Model(langs, logits, bias, temperature, least, seen, most)


class Predictor:
    """Predicts whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.concatenate([model.logits, ~model.seen[:, None]], axis=1).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for text in texts:
            words = text_words(text)
            if not words:
                langs.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            found = subwords(words)
            mean = (np.bincount(found, minlength=BUCKETS) @ self.table.astype(np.float64) if len(found) > BUCKETS else self.table[found].sum(axis=0, dtype=np.float64)) / len(found)
            p = _softmax(((mean[:-1] + self.model.bias) / self.model.temperature)[None])[0]
            best = int(p.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(p[best]))
            rejected.append(self.model.rejects(len(words), scores[-1], mean[-1]))
        return langs, scores, rejected


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected. All other columns pass through."""
    kept = df.drop("lang_pred", "score", "rejected")
    if model is None:
        return kept.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    name = f"{zlib.crc32(model.logits.tobytes()):x}-{len(model.langs)}"
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches):
        predictor = hold("language_id", name, lambda: Predictor(shared.value))
        for batch in slices(batches):
            langs, scores, rejected = predictor.predict(batch.column(text).to_pylist())
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string", "score double", "rejected boolean"])
    return kept.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> Model | None:
    return train(sample(docs.where(~held_out())))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
