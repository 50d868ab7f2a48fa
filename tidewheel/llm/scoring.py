"""LM scoring by context-tree weighting over bytes, beside a smoothed word unigram.

A byte is eight binary decisions; each decision, in each context of 0 to DEPTH bytes, has
a Krichevsky-Trofimov estimate from the training counts, and the weights of a context tree
mix the depths. Byte grams (context and byte) are counted by Spark; shards of grams that
share their two nearest context bytes, or more where these are frequent, hold whole subtrees,
and the top of the tree is a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.blocks import Words
from tidewheel.llm.classifier import remainder
from tidewheel.llm.common import groups, prepare, stored, tidy

#: Bytes of the longest context. Its grams have 48 bits, which leaves 16 for a text's place in its batch: the nearest context byte in the highest, the byte itself in the lowest.
DEPTH = 5
#: Most entries of what is sent to all tasks; words and grams beyond are joined instead, with the same result.
HEAD_WORDS, HEAD_GRAMS = 1 << 20, 1 << 21
#: Counts are weighed in 2**-BINS parts of an octave when the most frequent are chosen.
BINS = 6
#: Grams beyond which a context is split by one more byte, at least, and the most contexts of a depth that are; grams that a task handles at a time.
LEAST_SHARD, SPLIT, TOGETHER = 1 << 13, 1 << 13, 1 << 18
U = np.uint64


def byte_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Index of text and gram of every byte of the texts; before a text stand zero bytes."""
    parts = [(x or "").encode() for x in texts]
    pad = bytes(DEPTH)
    b = np.frombuffer(b"".join(y for x in parts for y in (pad, x)), np.uint8).astype(U)
    sizes = np.array([len(x) for x in parts])
    doc = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(doc)) + (doc + 1) * DEPTH
    gram = b[at]
    for d in range(1, DEPTH + 1):
        gram |= b[at - d] << U(8 * (DEPTH + 1 - d))
    return doc, gram


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for x > 0, by Stirling's series after shifting x beyond 8."""
    shift = np.zeros_like(x)
    y = x.astype(float).copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1)), shift)
        y = np.where(low, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Decision nodes of one depth: `key` is context << 8 | node, sorted; counts; logs of the estimate and of the weighted probability."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    kt: np.ndarray
    weighted: np.ndarray

    def at(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, key)


def nodes(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of the decision nodes of all grams at one depth."""
    context = gram >> U(8 * (DEPTH + 1 - depth)) if depth else np.zeros_like(gram)
    x = gram & U(255)
    keys, zeros, ones = [], [], []
    for i in range(8):
        keys.append(context << U(8) | U(1 << i) | x >> U(8 - i) if i else context << U(8) | U(1))
        bit = (x >> U(7 - i)) & U(1)
        zeros.append(np.where(bit == 0, n, 0))
        ones.append(np.where(bit == 1, n, 0))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(zeros), len(key)), np.bincount(inverse, np.concatenate(ones), len(key))


def parent(key: np.ndarray, depth: int) -> np.ndarray:
    """Key of the same decision one depth nearer to the root; contexts of depth d have 8d bits, nearest byte first."""
    return ((key >> U(16)) << U(8) | (key & U(255))) if depth > 1 else key & U(255)


def levels(gram: np.ndarray, n: np.ndarray, top: int) -> dict[int, Level]:
    """Levels DEPTH to `top` of the tree over these grams, bottom up."""
    out: dict[int, Level] = {}
    for depth in range(DEPTH, top - 1, -1):
        key, a, b = nodes(gram, n, depth)
        kt = log_kt(a, b)
        weighted = kt
        if depth < DEPTH:
            below = out[depth + 1]
            children = np.bincount(np.searchsorted(key, parent(below.key, depth + 1)), below.weighted, len(key))
            weighted = np.logaddexp(kt, children) - np.log(2)
        out[depth] = Level(key, a, b, kt, weighted)
    return out


def log10_grams(gram: np.ndarray, tree: dict[int, Level]) -> np.ndarray:
    """log10 probability of each gram's byte in its context: mixed from the deepest context that occurred up to the root."""
    total = np.zeros(len(gram))
    x = gram & U(255)
    for i in range(8):
        node = U(1 << i) | x >> U(8 - i) if i else np.full(len(gram), U(1))
        bit = (x >> U(7 - i)) & U(1) == 1
        p = np.full(len(gram), 0.5)
        below = np.zeros(len(gram), bool)
        for depth in range(DEPTH, -1, -1):
            level = tree[depth]
            context = gram >> U(8 * (DEPTH + 1 - depth)) if depth else np.zeros_like(gram)
            j = level.at(context << U(8) | node)
            a, b = level.zeros[j], level.ones[j]
            own = (np.where(bit, b, a) + 0.5) / (a + b + 1)
            stop = np.where(below, np.exp(np.minimum(level.kt[j] - np.log(2) - level.weighted[j], 0)), 1.0)
            seen = a + b > 0
            p = np.where(seen, stop * own + (1 - stop) * p, p)
            below |= seen
        total += np.log10(p)
    return total


def dealt(grams: DataFrame) -> DataFrame:
    """`grams` with the `shard` that holds a whole subtree: depth << 48 | context, of the two nearest bytes, or of more where so many grams share them.

    A context of more than `most` grams is split by its next byte; at most 1 / SPLIT of all
    contexts of a depth can be, which bounds what is sent to all tasks.
    """
    most = max(LEAST_SHARD, grams.count() // SPLIT)
    out, shard = grams, None
    for depth in range(2, DEPTH):
        context = F.shiftright("gram", 8 * (DEPTH + 1 - depth))
        hot = out.where(F.col(f"hot{depth - 1}")) if depth > 2 else out
        hot = stored(hot.groupBy(context.alias(f"c{depth}")).count().where(F.col("count") > most).select(f"c{depth}", F.lit(True).alias(f"hot{depth}")), "hot")
        out = out.join(F.broadcast(hot), context == F.col(f"c{depth}"), "left")  # at most SPLIT rows
    for depth in range(DEPTH, 1, -1):
        own = F.shiftright("gram", 8 * (DEPTH + 1 - depth)) + F.lit(depth << 48)
        shard = own if shard is None else F.when(F.col(f"hot{depth}"), shard).otherwise(own)
    return out.select("gram", "n", shard.alias("shard"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth, grams and counts of some whole shards of one depth at a time; rows come by shard."""

    def out(parts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        shard, gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        for depth in np.unique(shard >> 48).tolist():
            own = shard >> 48 == depth
            by = np.argsort(gram[own])
            yield depth, gram[own][by].astype(U), n[own][by]

    parts, size = [], 0
    for b in batches:
        part = [b.column(c).to_numpy() for c in ("shard", "gram", "n")]
        if size > TOGETHER and b.num_rows:
            end = int(np.searchsorted(part[0], parts[-1][0][-1], "right"))
            if end < b.num_rows:
                yield from out([*parts, [x[:end] for x in part]])
                parts, size, part = [], 0, [x[end:] for x in part]
        if len(part[0]):
            parts.append(part)
            size += len(part[0])
    if parts:
        yield from out(parts)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    key, inverse = np.unique(key, return_inverse=True)
    return key, *(np.bincount(inverse, v, len(key)) for v in values)


def tree_scores(grams: DataFrame) -> DataFrame:
    """(gram, log10p) from (gram, n), n the training count, 0 where a gram stands in other texts alone."""
    grams = stored(dealt(grams), "dealt")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for depth, gram, n in _shards(batches):
            level = levels(gram, n, depth)[depth]
            key, *sums = _summed(parent(level.key, depth), level.zeros, level.ones, level.weighted)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), depth - 1)), pa.array(key.astype(np.int64)), *map(pa.array, sums)], ["depth", "key", "a", "b", "w"])

    spread = grams.repartition("shard").sortWithinPartitions("shard")
    rows = spread.mapInArrow(tidy(below), "depth long, key long, a double, b double, w double").groupBy("depth", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w")).toArrow()  # 255 nodes of 2**8 contexts, and of those that were split
    found = [rows.column(c).to_numpy() for c in ("depth", "key", "a", "b", "w")]
    top: dict[int, Level] = {}
    up = (np.zeros(0, U), *(np.zeros(0),) * 3)
    for depth in range(DEPTH - 1, -1, -1):
        own = found[0] == depth
        key, a, b, w = _summed(np.concatenate([found[1][own].astype(U), up[0]]), *(np.concatenate([f[own], u]) for f, u in zip(found[2:], up[1:], strict=True)))
        kt = log_kt(a, b)
        top[depth] = Level(key, a, b, kt, np.logaddexp(kt, w) - np.log(2))
        up = (parent(key, depth), a, b, top[depth].weighted) if depth else up
    sent = grams.sparkSession.sparkContext.broadcast(top)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for depth, gram, n in _shards(batches):
            upper = {d: level for d, level in sent.value.items() if d < depth}
            p = log10_grams(gram, levels(gram, n, depth) | upper)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(p)], ["gram", "n", "log10p"])

    return spread.mapInArrow(tidy(score), "gram long, n long, log10p double")


def _counted(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(n), len(key)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all whole texts: kind 0 grams (n from training texts), kind 1 hashes of training words. Added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}

        def out(kind: int) -> pa.RecordBatch:
            key, n = _counted(*kept[kind])
            kept[kind] = ([], [])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        def add(kind: int, values: np.ndarray, weight: int) -> None:
            values.sort()
            edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
            kept[kind][0].append(values[edge[:-1]])
            kept[kind][1].append(np.diff(edge) * weight)
            if len(kept[kind][0]) % 16 == 0:
                key, n = _counted(*kept[kind])
                kept[kind] = ([key], [n])

        for batch in batches:
            texts, held = batch.column("text").to_pylist(), np.array(batch.column("held_out").to_pylist(), bool)
            for a, b in groups(texts):
                doc, gram = byte_grams(texts[a:b])
                test = held[a:b][doc]
                add(0, gram[~test], 1)
                add(0, gram[test], 0)
                words = Words(texts[a:b], lower=True)
                add(1, words.hash[~held[a:b][words.doc]], 1)
            for kind in (0, 1):
                if sum(map(len, kept[kind][0])) > 3_000_000:
                    yield out(kind)
        for kind in (0, 1):
            yield out(kind)

    return docs.mapInArrow(tidy(run), "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def head(table: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, at most `most`, down to some count; the histogram that finds it has a bounded number of bins."""
    bin_ = F.floor(F.log2(F.col("n") + 1) * (1 << BINS)).cast("int")
    room, least = most, None
    for r in sorted(table.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r.bin):
        room -= r["count"]
        if room < 0:
            break
        least = r.bin
    return table.where(bin_ >= least) if least is not None else table.limit(0)


def _arrays(table: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    found = head(table, most).select("key", value).toArrow()
    key, v = found.column(0).to_numpy().view(U), found.column(1).to_numpy()
    by = np.argsort(key)
    return key[by], v[by].astype(float), len(key) < table.count()


@dataclass
class Heads:
    """What every task gets: the most frequent words' counts and grams' scores; whether there is more of either."""

    words: np.ndarray
    counts: np.ndarray
    more_words: bool
    grams: np.ndarray
    scores: np.ndarray
    more_grams: bool


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    j = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return j, keys[j] == wanted


def score_texts(texts: list[str | None], heads: Heads) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list, list]:
    """Per text: tokens' words, known words, sum of log10(count + 0.1), log10 probability, and what the heads lack: keys (kind 0 grams, 1 words) with counts."""
    m = len(texts)
    rest: list[list] = [[] for _ in range(m)]
    doc, gram = byte_grams(texts)
    key = gram << U(16) | doc.astype(U)  # a batch has at most BATCH_ROWS texts
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    gram, doc, n = key[edge[:-1]] >> U(16), (key[edge[:-1]] & U(0xFFFF)).astype(np.int64), np.diff(edge)
    j, ok = _find(heads.grams, gram)
    score = np.bincount(doc[ok], n[ok] * heads.scores[j[ok]], m)
    for d, g, c in zip(doc[~ok].tolist(), gram[~ok].view(np.int64).tolist(), n[~ok].tolist(), strict=True):
        rest[d].append((0, g, c))
    words = Words(texts, lower=True)
    unique, inverse = np.unique(words.hash, return_inverse=True)
    j, ok = _find(heads.words, unique)
    count = np.zeros(len(unique))
    count[ok] = heads.counts[j[ok]]
    known = ok[inverse]
    n_known = np.bincount(words.doc[known], minlength=m)
    base = np.bincount(words.doc[known], np.log10(count + 0.1)[inverse][known], m)
    if heads.more_words:
        for d, h in zip(words.doc[~known].tolist(), words.hash[~known].view(np.int64).tolist(), strict=True):
            rest[d].append((1, h, 1))
    else:
        base -= np.bincount(words.doc[~known], minlength=m)
    return words.counts, n_known, base, score, rest


def score_documents(docs: DataFrame, held_out: Column | None = None, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """Per row of `docs` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and code_length (bits per byte).

    The model learns from all whole texts that aren't held out (by default crc32 of doc_id
    modulo 10 is 0; a null doc_id isn't held out). Null and empty texts have one token, the
    end, and score 0. Without training texts every bit has probability 1/2. Repeated rows
    each count. Texts of any length are scored whole. The base score tells words apart by
    64-bit hashes.
    """
    spark = prepare(docs.sparkSession)
    test = F.coalesce(remainder(F.col("doc_id"), 10) == 0 if held_out is None else held_out, F.lit(False))
    docs = docs.select("doc_id", "text", test.alias("held_out"))
    counted = stored(counts(docs.select("text", "held_out")), "counts")
    words = counted.where("kind = 1").select("key", "n")
    grams = stored(tree_scores(counted.where("kind = 0").select(F.col("key").alias("gram"), "n")), "grams").withColumnRenamed("gram", "key")
    ends = docs.where(~F.col("held_out")).count()
    r = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train, distinct = r.n + ends, r.v + (ends > 0)
    heads = spark.sparkContext.broadcast(Heads(*_arrays(words, "n", head_words), *_arrays(grams, "log10p", head_grams)))
    rest_type = "array<struct<kind:int,key:long,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts):
                n, known, base, score, rest = score_texts(texts[a:b], heads.value)
                part = batch.slice(a, b - a)
                size = [len((x or "").encode()) for x in texts[a:b]]
                flat = [t for own in rest for t in own]
                cut = np.concatenate([[0], np.cumsum([len(x) for x in rest])]).astype(np.int32)
                left = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array([t[i] for t in flat], kind.value_type.field(i).type) for i in range(3)], names=["kind", "key", "n"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), pa.array(size, pa.int64()), left], ["doc_id", "held_out", "words", "known", "base", "score", "n_bytes", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, words long, known long, base double, score double, n_bytes long, rest {rest_type}").withColumn("rid", F.monotonically_increasing_id())
    rows = stored(rows, "scored")
    table = words.select(F.lit(1).alias("kind"), "key", F.col("n").cast("double").alias("value")).unionByName(grams.select(F.lit(0).alias("kind"), "key", F.col("log10p").alias("value")))
    left = rows.select("rid", F.inline("rest")).groupBy("rid", "kind", "key").agg(F.sum("n").alias("n")).join(table, ["kind", "key"], "left")
    word, known = F.col("kind") == 1, F.col("value").isNotNull()
    more = left.groupBy("rid").agg(
        F.sum(F.when(word & known, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.when(word, F.col("n") * F.when(known, F.log10(F.col("value") + 0.1)).otherwise(-1.0)).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(~word, F.col("n") * F.col("value")).otherwise(0.0)).alias("more_score"),
    )
    end = F.log10(F.lit(ends + 0.1))
    unit = float(np.log10(train + 0.1 * (distinct + 1)))
    full = rows.drop("rest").join(more, "rid", "left").fillna(0, ["more_known", "more_base", "more_score"])
    n = F.col("words") + 1
    score = F.col("score") + F.col("more_score")
    return full.select(
        "doc_id", "held_out", n.alias("n_tokens"), (F.col("known") + F.col("more_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") + end - n * unit).alias("base_score"), score.alias("score"), "n_bytes",
        F.when(F.col("n_bytes") > 0, -score / F.col("n_bytes") * float(np.log2(10))).alias("code_length"),
    )


def op5(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length."""
    return score_documents(docs).drop("n_bytes")
