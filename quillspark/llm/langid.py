"""Language identification with a string kernel.

The kernel of two texts counts the n-grams (1 to 3 bytes of lower-cased text, runs of non-letters as
one blank) that are present in both, over the geometric mean of how many each has: the normalised
blended-spectrum presence kernel.  N-grams are hashed to DIM cells, so a text's feature vector is a
bitmap of fixed size whatever its length.  Nystroem landmarks are training texts; with K the kernel
among them, K^(-1/2) maps a text's kernels with the landmarks to features of few dimensions, on which
one ridge regression per language is solved against +1/-1 targets.  Scoring multiplies batches of
bitmaps by the landmarks' matrix and by the weights.

The fit takes about PER_LANG training texts of each language, chosen by a hash of id and text (documented
bound; it grows with the number of languages), as bitmaps of DIM / 8 bytes; scoring covers whole texts of all documents.

Rows: texts that are null or have no letter get ``und`` and score 0; repeated rows get equal results;
without any training row every text gets ``und`` and score 0; a null id is neither held out nor learned
from; an empty
table gives an empty table; further columns pass through ``predict``, but those with the name of an
output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_size, uniform, without
from .toxicity import held_out

BITS = 15
DIM = 1 << BITS
PER_LANG = 400
LANDMARKS = 96
RIDGE = 1e-2


def _table() -> np.ndarray:
    """Byte classes: lower-cased letters and all bytes of multi-byte characters as they are, others a blank."""
    t = np.full(256, 32, np.uint32)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


TABLE = _table()
MAX_BYTES = 1 << 22


def bitmaps(texts: list[str]) -> np.ndarray:
    """Presence of hashed n-grams, one row of DIM cells per text."""
    out = np.zeros((len(texts), DIM), np.uint8)
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush():
        if not group:
            return
        raw = np.frombuffer(b" ".join([b"", *(x for _, x in group), b""]), np.uint8)
        sizes = np.array([len(x) + 1 for _, x in group])
        row = np.repeat(np.array([k for k, _ in group], np.int64), sizes)
        c = TABLE[raw]
        own = c[1:]  # the bytes of each text and the blank after it; a blank stands before each text
        before = c[:-1]
        keep = ~((own == 32) & (before == 32))  # one blank for a run
        own, row = own[keep], row[keep]
        first = np.ones(len(own), bool)
        first[1:] = row[1:] != row[:-1]
        p1 = np.where(first, 32, np.concatenate(([32], own[:-1])))
        start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        p2 = np.where(np.arange(len(own)) - start >= 2, np.concatenate(([32, 32], own[:-2]))[: len(own)], 32)
        for gram in (own, own + (p1 + 1 << 8), own + (p1 << 8) + (p2 + 1 << 16)):
            cell = (gram.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            out[row, cell] = 1
        group.clear()

    for k, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "replace") if not text.isascii() else text.encode()
        for a in range(0, len(raw), MAX_BYTES):  # parts of long texts overlap by two bytes
            group.append((k, raw[max(0, a - 2) : a + MAX_BYTES]))
            held += len(group[-1][1])
            if held >= MAX_BYTES:
                flush()
                held = 0
    flush()
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray | None = None  # DIM x m, columns scaled to length 1
    weights: np.ndarray | None = None  # m + 1 x languages

    def values(self, bits: np.ndarray) -> np.ndarray:
        x = bits.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        kernel = (x @ self.landmarks) / norm
        return kernel @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for a in range(0, len(texts), 256):
            own = texts[a : a + 256]
            values = self.values(bitmaps([x or "" for x in own]))
            best = values.argmax(axis=1)
            chance = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
            chance = 1 / chance.sum(axis=1)
            out += [(self.langs[k], float(p)) if has_letter(x) else ("und", 0.0) for x, k, p in zip(own, best.tolist(), chance.tolist(), strict=True)]
        return out


def solve(bits: np.ndarray, langs: list[str]) -> Model:
    """Landmarks in turn from the languages, K^(-1/2), and ridge regression of one against the rest."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    order = [np.flatnonzero(y == k) for k in range(len(names))]
    marks = [int(own[i]) for i in range(max(map(len, order))) for own in order if i < len(own)][: max(LANDMARKS, 8 * len(names))]
    size = np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1))
    z = (bits[marks] / size[marks][:, None]).astype(np.float32)
    # a few rows at a time, as bitmaps are wide
    kernel = np.vstack([bits[a : a + 128].astype(np.float32) @ z.T for a in range(0, len(bits), 128)]).astype(np.float64) / size[:, None]
    values, vectors = np.linalg.eigh((kernel[marks] + kernel[marks].T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    features = np.hstack((features, np.ones((len(features), 1))))
    share = np.bincount(y, minlength=len(names))
    w = (1 / share)[y] * len(y) / len(names)  # languages weigh the same
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    penalty = RIDGE * len(y) * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(features.T @ (features * w[:, None]) / 1 + penalty * 1e-2, features.T @ (target * w[:, None]))
    weights = np.vstack((root @ beta[:-1], beta[-1:]))
    return Model(names, np.ascontiguousarray(z.T), weights.astype(np.float32))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learns from texts with a letter and a language outside the held-out quarter."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(of=4, rest=2))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model([])
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))]), F.col("lang"))

    def run(batches):
        for batch in by_size(batches, "text"):
            texts = batch.column("text").to_pylist()
            keep = [i for i, x in enumerate(texts) if has_letter(x)]
            bits = np.packbits(bitmaps([texts[i] for i in keep]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(keep, pa.int64())), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lang", "bits"])

    # about per_lang rows of DIM / 8 bytes for each language
    # repeated rows count once here, so that their number is no part of the bound
    rows = usable.filter(uniform("doc_id", "text") < chance).select("text", "lang").distinct().mapInArrow(run, "lang string, bits binary").collect()
    if not rows:
        return Model([])
    rows.sort(key=lambda r: (r.lang, bytes(r.bits)))
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    shuffle = np.random.default_rng(7).permutation(len(rows))
    return solve(bits[shuffle], [rows[i].lang for i in shuffle])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns plus ``lang_pred`` and ``lang_score`` (0 to 1)."""
    docs = without(docs, "lang_pred", "lang_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x landmarks

    def run(batches):
        own = sent.value
        for batch in by_size(batches, text):
            found = own.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(of=4, rest=2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
