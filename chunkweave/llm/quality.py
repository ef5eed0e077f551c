"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, helps a text more."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.llm.frames import REST, batches_by_weight, with_rest

LEVEL, PART_BYTES, SLICE_BYTES = 3, 512, 4_000_000
ADDED = ("score", "predicted")


@dataclass(frozen=True)
class FitBounds:
    """Bounds of the sample that a classifier is fitted on: rows a class for a dictionary and for calibration."""

    dictionary_rows: int = 1_500
    good_rows: int = 3_500
    bad_rows: int = 700
    #: Labelled rows with longer texts are not fitted on.
    most_chars: int = 65_536
    #: Bytes of the fitted texts of a class; rows that come later by the hash are left out.
    most_bytes: int = 24_000_000
    dictionary_bytes: int = 60_000


@dataclass(frozen=True)
class Model:
    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=list)
    #: The score of every text if there was nothing to fit.
    share: float = 0.5


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that nothing is learnt from: the crc32 of doc_id as text is a multiple of `folds`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; for samples too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


class Sizes:
    """Compressed sizes of texts, part by part so that the dictionaries count throughout long texts."""

    def __init__(self, good: bytes, bad: bytes):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.good, self.bad = (self._compressor(x) for x in (good, bad))

    def _compressor(self, raw: bytes) -> zstandard.ZstdCompressor:
        if not raw:
            return self.plain
        dictionary = zstandard.ZstdCompressionDict(raw)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)

    def of(self, texts: list[bytes]) -> np.ndarray:
        """Rows of what a score is made of: means over a text's parts, weighted by their bytes.

        d is the difference of both sizes over their sum, e over the part's bytes; r says how far the part compresses by
        itself. The means of what lies below 0, and of the parts that the bad dictionary helps more, show bad passages.
        """
        rows = np.empty((len(texts), 10))
        for k, text in enumerate(texts):
            parts = [text[i : i + PART_BYTES] for i in range(0, len(text), PART_BYTES)] or [b""]
            good, bad, plain = (np.array([len(c.compress(p)) for p in parts], float) for c in (self.good, self.bad, self.plain))
            length = np.array([len(p) for p in parts], float)
            share = length / max(length.sum(), 1)
            d = 10 * np.clip((bad - good) / (bad + good), -0.3, 0.3)
            e = 10 * np.clip((bad - good) / (length + 20), -0.2, 0.2)
            r = np.log((plain + 1) / (length + 20)) + 0.7
            below = [np.minimum(x, 0) @ share for x in (d, e, r)]
            rows[k] = 1, d @ share, e @ share, r @ share, *below, r * r @ share, d * r @ share, (d < 0) @ share
        return rows


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method; a step is halved until it lowers the loss, as classes may be separable."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + ridge / 2 * w @ w

    for _ in range(200):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, bounds: FitBounds = FitBounds(), folds: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A classifier from labelled rows that are not held out, on a sample of bounded size.

    The sample of a class: its first rows by a hash of doc_id, so it is the same at each run. Part of it makes the
    dictionary, the rest calibrates. Null labels and null texts are not learnt from, nor are doc_ids with both labels. Of
    rows that repeat a doc_id those count that come within the bounds. With one class only, or none,
    the model scores every text by the share of good labels, one half without any.
    """
    usable = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`"), folds))
    usable = usable.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.min(f"`{label}`").cast("int").alias("label"), F.max(f"`{label}`").cast("int").alias("other")).where("label = other").drop("other")
    most = {0: bounds.dictionary_rows + bounds.bad_rows, 1: bounds.dictionary_rows + bounds.good_rows}
    picked = [usable.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in most.items()]
    sample = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull() & (F.char_length("text") <= bounds.most_chars))
    found = texts.join(F.broadcast(sample), "id").select("label", F.xxhash64("id").alias("place"), "id", "text")
    found = found.orderBy("place", "id", "text").limit(sum(most.values()))  # for repeated doc_ids; no more than the bounds say
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("place", "id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("upto", upto).where(F.col("upto") <= bounds.most_bytes).drop("upto").collect()
    by_class: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r["place"], r["id"], r["text"])):
        by_class[r["label"]].append(r["text"].encode())
    bad, good = by_class[0], by_class[1]
    if not bad or not good:
        return Model(share=len(good) / (len(good) + len(bad)) if good or bad else 0.5)
    cut = {id(x): min(bounds.dictionary_rows, (len(x) + 1) * 2 // 3) for x in (good, bad)}
    dictionaries = [_dictionary(x[: cut[id(x)]], bounds.dictionary_bytes) for x in (good, bad)]
    rest = [x[cut[id(x)] :] or x for x in (good, bad)]
    sizes = Sizes(*dictionaries).of([*rest[0], *rest[1]])
    return Model(*dictionaries, _logistic(sizes, np.repeat([1.0, 0.0], [len(x) for x in rest])).tolist())


def _scored(model: Model) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.weights else None
        for whole in batches:
            for batch in batches_by_weight(whole, "text", SLICE_BYTES):
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                scores = _sigmoid(sizes.of(texts) @ np.array(model.weights)) if sizes else np.full(len(texts), model.share)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "__score"])

    return task


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents with score, from 0 to 1, and predicted, 1 from the threshold on.

    A text's score depends on the text alone, all of it. A null text is scored as an empty one. Rows are scored one by one,
    whatever doc_id they have. Columns of the input stay; score and predicted are replaced.
    """
    packed = with_rest(docs, text).select(F.col(f"`{text}`").alias("text"), REST)
    out = packed.mapInArrow(_scored(model), T.StructType([*packed.schema.fields, T.StructField("__score", T.DoubleType())]))
    columns = [F.col(f"{REST}.`{c}`").alias(c) if c != text else F.col("text").alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*columns, F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
