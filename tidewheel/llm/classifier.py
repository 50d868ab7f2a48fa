"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.blocks import Words
from tidewheel.llm.common import fresh, map_texts, prepare, stored, tidy
from tidewheel.llm.quality import letters, lines_of, repeat_words, sums


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_SETS = {
    "upper": _mask((65, 90)),
    "lower": _mask((97, 122)),
    "digit": _mask((48, 57)),
    "exclaim": _mask((33, 33), (63, 63)),
    "symbol": _mask((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)),
    "stop": _mask((44, 44), (46, 46), (58, 59)),
    "wide": _mask((0xC0, 0xFF)),
    "newline": _mask((10, 10)),
}
FEATURES = ["log_words", "word_length", *_SETS, "distinct", "repeated", "pairs", "lines_repeated", "log_line", "ends"]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of transformed statistics per text: logs of counts, square roots of shares. A text without words is all zero but for its shares."""
    words = Words(texts, lower=True)
    n = words.counts.astype(float)
    some = np.maximum(n, 1)
    raw = np.frombuffer(b" ".join([*((x or "").encode() for x in texts), b""]), np.uint8)
    size = np.maximum(np.diff(words.begin) - 1, 1).astype(float)
    share = lambda x, of: np.sqrt(np.clip(x / of, 0, 4))
    own = words.doc.astype(np.uint64) << np.uint64(44) | words.hash >> np.uint64(20)  # a batch has far fewer texts than 2**20
    own.sort()
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    distinct = np.bincount((own[fresh] >> np.uint64(44)).astype(np.int64), minlength=len(texts))
    same = np.zeros(len(words.doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    pairs = np.bincount(words.doc[same], minlength=len(texts))
    lines, dup = lines_of(texts)
    last = np.zeros(256, bool)
    last[[33, 46, 58, 59, 63]] = True
    ends = np.bincount(words.doc[last[words.bytes[words.end - 1]]], minlength=len(texts)) if len(words.doc) else np.zeros(len(texts))
    columns = [np.log1p(n), np.log1p(letters(words) / some)]
    columns += [share(sums(words, m[raw]), size) for m in _SETS.values()]
    columns += [share(distinct, some), share(repeat_words(words), some), share(pairs, some), share(dup, np.maximum(lines, 1)), np.log1p(n / np.maximum(lines, 1)), share(ends, some)]
    return np.stack(columns, axis=1)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors of shrunk covariances, kept with the logs of their determinants, and priors; of one class alone, the score is that class."""

    centre: np.ndarray
    scale: np.ndarray
    prior: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    spread: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the logistic of the difference of log densities, with temperature for long tails."""
        if min(self.prior) == 0:
            return np.full(len(x), float(self.prior[1] > 0) if max(self.prior) else 0.5)
        z = (x - self.centre) / self.scale
        log = []
        for p, m, c, d in zip(self.prior, self.mean, self.factor, self.spread, strict=True):
            y = (z - m) @ c.T
            log.append(np.log(p) - 0.5 * (y * y).sum(axis=1) - d)
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / len(self.centre) ** 0.5, -40, 40)))


def fit(labelled: DataFrame, features: str = "features", label: str = "label", shrink: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """Fit from all labelled rows: partial sums per task, added up by Spark; only d*d numbers a class reach the driver.

    Each class covariance is shrunk towards the pooled one by `shrink` and towards the
    unit matrix by `ridge`, after scaling. Rows with a null label or other labels than 0 and 1 don't count.
    """
    d = len(FEATURES)

    def partial(batches):
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        n = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(total.ravel(), pa.float64())], ["c", "k", "v"])

    rows = labelled.select(features, F.col(label).cast("int")).where(F.col(label).isin(0, 1)).mapInArrow(tidy(partial), "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r.c, r.k] = r.v
    n = total[:, 0]
    if min(n) < 1:
        return Discriminant(np.zeros(d), np.ones(d), (n / max(n.sum(), 1)).tolist(), [], [], [])
    both = total.sum(axis=0)
    centre = both[1 : d + 1] / both[0]
    scale = np.sqrt(np.maximum(both[d + 1 :].reshape(d, d).diagonal() / both[0] - centre**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    mean, scatter = [], []
    for c in (0, 1):
        m = total[c, 1 : d + 1] / n[c]
        s = total[c, d + 1 :].reshape(d, d) / n[c] - np.outer(m, m)
        mean.append((m - centre) / scale)
        scatter.append(s / np.outer(scale, scale))
    pooled = (scatter[0] * n[0] + scatter[1] * n[1]) / n.sum()
    factor = [np.linalg.cholesky((1 - ridge) * ((1 - shrink) * s + shrink * pooled) + ridge * np.eye(d)) for s in scatter]
    return Discriminant(centre, scale, (n / n.sum()).tolist(), mean, [np.linalg.inv(c) for c in factor], [float(np.log(np.diag(c)).sum()) for c in factor])


def with_statistics(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """Add the statistics of each whole text as an array; a column named as `out` is replaced."""
    prepare(docs.sparkSession)
    return map_texts(docs, text, [T.StructField(out, T.ArrayType(T.DoubleType()))], lambda texts: [statistics(texts).tolist()])


def score(rows: DataFrame, model: Discriminant, features: str = "features", out: str = "score") -> DataFrame:
    """Replace `features` by `out`, the model's probability of label 1."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name.lower() not in (features.lower(), out.lower())), T.StructField(out, T.DoubleType())])
    kept = schema.names[:-1]

    def run(batches):
        for b in batches:
            x = np.array(b.column(features).to_pylist(), float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model.score(x) if len(x) else [], pa.float64())], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def statistics_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, features and held_out of each row, written and read again."""
    test = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return stored(with_statistics(docs.select("doc_id", F.col(text).alias("text"))).drop("text").withColumn("held_out", test), "statistics")


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("label"))


def learnt(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of the labelled rows that aren't held out."""
    return fit(rows.where(~F.col("held_out")).join(known_labels(labels), F.col("doc_id") == F.col("__id")))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out and score of each row of `docs`, from `labels` (doc_id, quality).

    Rows with crc32(doc_id) mod 3 = 1 are held out and never learnt from. A doc_id labelled
    more than once takes its largest label; a null doc_id isn't learnt from (held_out is
    false for it). Null and empty texts get the score of a text without words; texts of any
    length count whole. Repeated rows each count. Without labels of both classes, the score is the share of label 1, or 0.5 without any.
    """
    rows = statistics_of(docs, text)
    return score(rows, learnt(rows, labels))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of at least `least`, all columns as they are; the model is as in `classify`, from the statistics of the rows it learns from alone."""
    prepare(docs.sparkSession)
    own = docs.select("doc_id", text).where(remainder(F.col("doc_id"), 3) != 1).join(known_labels(labels).select(F.col("__id").alias("doc_id")), "doc_id", "left_semi")
    model = learnt(statistics_of(own, text), labels)
    (own,) = fresh(docs, "__score")
    scored = map_texts(docs, text, [T.StructField(own, T.DoubleType())], lambda texts: [model.score(statistics(texts))])
    return scored.where(F.col(own) >= least).select(*docs.columns)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return classify(docs, labels).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
