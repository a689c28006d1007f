"""Quality classifier by compression: text that good examples help to compress more than bad ones do is good."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import small_batches

#: Bounds of the training sample: labelled texts per class, and characters of the one window taken from each.
EXAMPLES = 3000
WINDOW = 1500
#: Bytes of a dictionary; bytes that are compressed at a time, so that what a long text repeats does not replace the
#: dictionary as the source of matches; compression level.
DICTIONARY = 65536
BLOCK = 2048
LEVEL = 3
#: A stated share of the examples fits the calibration and is kept out of the dictionaries.
CALIBRATION_SHARE = 0.4


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    found = zstandard.ZstdCompressionDict(dictionary)
    found.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        dict_data=found, level=level, write_content_size=False, write_checksum=False, write_dict_id=False
    )


@dataclass(frozen=True)
class CompressionClassifier:
    """Two dictionaries and the coefficients (constant, size difference, compressed size) of the calibration."""

    good: bytes
    bad: bytes
    coefficients: tuple[float, float, float]
    block: int = BLOCK
    level: int = LEVEL

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text the compressed sizes' difference and mean, each divided by the text's own size."""
        good, bad = _compressor(self.good, self.level), _compressor(self.bad, self.level)
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            with_good = with_bad = 0
            for at in range(0, len(text), self.block):
                piece = text[at : at + self.block]
                with_good += len(good.compress(piece))
                with_bad += len(bad.compress(piece))
            size = max(len(text), 1)
            out[i] = (with_bad - with_good) / size, (with_bad + with_good) / (2 * size)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        a, b, c = self.coefficients
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Logistic regression with three coefficients, by Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(3), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    b = w[1:] / scale
    return float(w[0] - b @ mean), float(b[0]), float(b[1])


def fit_classifier(
    labelled: DataFrame,
    text: str = "text",
    label: str = "quality",
    examples: int = EXAMPLES,
    window: int = WINDOW,
    dictionary: int = DICTIONARY,
    block: int = BLOCK,
    level: int = LEVEL,
) -> CompressionClassifier:
    """Fit on a bounded sample of ``labelled`` (label 1 good, 0 bad; other labels and null or empty texts are left out).

    At most ``examples`` texts of each class are used, those with the smallest hash of their text, and of each one
    window of ``window`` characters at a place given by the hash: this much comes to the driver. Equal texts count
    once. Where a class has too few examples for a dictionary, its raw text serves as one; without examples of a class
    every score is that of the other class.
    """
    mixed = F.xxhash64(F.col(text), F.lit(17))
    room = F.greatest(F.length(text) - window, F.lit(0)) + 1
    place = F.pmod(mixed, room).cast("int") + 1
    windows = written(
        labelled.filter(F.col(label).isin(0, 1) & (F.length(text) > 0)).select(
            F.substring(text, place, F.lit(window)).alias("t"), mixed.alias("h"), F.col(label).alias("label")
        ),
        "windows",
    )
    picked = []
    for value in (1, 0):
        rows = windows.filter(F.col("label") == value).orderBy("h", "t").limit(examples).collect()
        picked.append(list(dict.fromkeys(r["t"].encode() for r in rows)))
    cut = [max(1, int(len(p) * (1 - CALIBRATION_SHARE))) for p in picked]

    def dictionary_of(samples: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(dictionary, samples).as_bytes()
        except zstandard.ZstdError:
            return b"\n".join(samples)[-dictionary:]

    dicts = [dictionary_of(p[:c]) if p else b"" for p, c in zip(picked, cut, strict=True)]
    if not all(picked):
        sure = 20.0 if picked[0] else -20.0 if picked[1] else 0.0
        return CompressionClassifier(dicts[0], dicts[1], (sure, 0.0, 0.0), block, level)
    model = CompressionClassifier(dicts[0], dicts[1], (0.0, 0.0, 0.0), block, level)
    rest = [p[c:] or p for p, c in zip(picked, cut, strict=True)]
    x = np.vstack([model.features(r) for r in rest])
    y = np.repeat([1.0, 0.0], [len(r) for r in rest])
    return CompressionClassifier(dicts[0], dicts[1], _logistic(x, y), block, level)


def score_quality(docs: DataFrame, model: CompressionClassifier, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1, higher is better) of every whole text; null counts as empty text.

    Rows are scored where they are read, one Arrow batch at a time; the model has a fixed size. A column ``out`` that
    ``docs`` may have is replaced.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores([(t or "").encode() for t in batch]))

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Texts and labels of rows that are not held out, for at most ``examples`` ids of each label: those with the
    smallest hash of the id. A document with several labels counts as each of them.

    The ids are chosen before any text is read, so this list of at most two times ``examples`` numbers is all that is
    sent to the tasks that read the texts.
    """
    marks = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    first = [marks.filter(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for v in (1, 0)]
    chosen = written(first[0].union(first[1]), "label-sample")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``held_out``; trained on the labelled rows that are not held out."""
    scored = score_quality(docs, fit_classifier(labelled_texts(docs, labels)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn(
        "held_out", held_out(F.col("doc_id"))
    )
