"""Suffix-array dedup: byte strings that repeat anywhere, from merged shard Burrows-Wheeler orders.

A window of LENGTH bytes owns one anchor, the GRAM-byte string of least hash in it, so equal
windows have equal anchors at equal offsets. Anchors that two places hold (`incidence`) are
suspected. A shard, here a batch of texts, sorts the suffixes at its suspected anchors and
keeps the bytes before them: a Burrows-Wheeler transform sampled at the anchors. Shards meet
by anchor; their orders are interleaved by refining intervals byte by byte, where a stable
sort merges runs that are in order already and settled suffixes are left alone. The depth at
which neighbours part is their common prefix; a window repeats where an interval as deep as
its right part holds two suffixes with the same bytes on the left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.blocks import _upto, mix
from tidewheel.llm.common import dealt, fresh, groups, prepare, stored, tidy
from tidewheel.llm.incidence import often, shared_columns, token_bits, tokens_of

LENGTH, GRAM = 200, 64
#: Grams in a window: the windows that one anchor can own.
SPAN = LENGTH - GRAM + 1
#: Low bits of a packed value that hold a place in a piece of text, and windows of a piece: a longer text is cut into pieces that overlap by a window.
PLACE, PIECE = np.uint64(24), 4 << 20
#: Contexts of one anchor up to which one task interleaves them; windows of more frequent anchors are counted by hash, as no task may hold them all.
TOGETHER = 20_000
U = np.uint64


def anchors(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all windows of all texts: buffer, start of each text in it, and per anchor its text, place, first and last window start, hash. A window's anchor depends on its bytes alone, so long texts go piece by piece."""
    parts = [(x or "").encode() for x in texts]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    found = [_piece(raw[a : a + PIECE + LENGTH - 1], begin - a) for a in range(0, max(1, len(raw) - LENGTH + 1), PIECE)]
    shift = np.repeat(np.arange(len(found)) * PIECE, [len(x[0]) for x in found])
    doc, at, first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return raw, begin, doc, at + shift, first + shift, last + shift, h


def _piece(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, place, first and last window start and hash of the anchors of a stretch of the buffer; `begin` as seen from its start."""
    n = len(raw) - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none.astype(U)
    up, down = _upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[:-1], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[:n])
    low = (U(1) << PLACE) - U(1)
    v = (h & ~low) | np.arange(n, dtype=U)
    size = 1
    while 2 * size <= SPAN:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    v = np.minimum(v[: len(raw) - LENGTH + 1], v[SPAN - size : SPAN - size + len(raw) - LENGTH + 1])
    start = np.arange(len(v))
    doc = np.searchsorted(begin, start, "right") - 1
    inside = start + LENGTH <= begin[doc + 1]
    start, doc = start[inside], doc[inside]
    at = (v[inside] & low).astype(np.int64)
    if not len(at):
        return none, none, none, none, none.astype(U)
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]), [True]]))
    return doc[edge[:-1]], at[edge[:-1]], start[edge[:-1]], start[edge[1:] - 1], h[at[edge[:-1]]]


UID = "u1 long, u2 long"
CONTEXT = f"{UID}, key long, shard long, rank long, place long, low int, high int, bytes binary"


def _suspected(docs: DataFrame, bits: int, wanted: Callable[[np.ndarray], np.ndarray], make: Callable, schema: str) -> DataFrame:
    """`make` of the suspected anchors of each batch of `docs` (u1, u2, text, tokens, often): uids, hash, place, least and largest distance of a window start before it, bytes of all its windows, number of the batch. `wanted` picks by how often anchors occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            uid = [batch.column(c).to_numpy() for c in ("u1", "u2")]
            tokens, told = batch.column("tokens").to_pylist(), batch.column("often").to_pylist()
            for a, b in groups(texts):
                shard += 1
                raw, begin, doc, at, first, last, h = anchors(texts[a:b])
                token = tokens_of(mix(h), bits).view(np.int64)
                keep = np.zeros(len(h), bool)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                    own = np.array(tokens[a + i], np.int64)
                    keep[x:y] = np.isin(token[x:y], own[wanted(np.array(told[a + i]))])
                doc, at, first, last, h = (x[keep] for x in (doc, at, first, last, h))
                whole = raw.tobytes()
                own = [whole[x : y + LENGTH] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                yield make([u[a:b][doc] for u in uid], h, at - begin[doc], at - last, at - first, own, shard)

    return docs.mapInArrow(tidy(run), schema)


def _transform(uid: list[np.ndarray], h: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, own: list[bytes], shard: int) -> pa.RecordBatch:
    """A shard's sampled transform: by anchor, suffixes in order, with the bytes before them."""
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1], [False]])
    met = np.flatnonzero(same[1:] | same[:-1])  # the others are alone with their anchor here
    if len(met):
        suffix = np.array([own[i][int(high[i]) :] for i in order[met]], f"S{LENGTH}")
        inner = np.argsort(suffix, kind="stable")
        order[met] = order[met][inner][np.argsort(h[order[met]][inner], kind="stable")]
    columns = [uid[0][order], uid[1][order], h[order].view(np.int64), np.full(len(h), shard), np.arange(len(h)), place[order], low[order].astype(np.int32), high[order].astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([own[i] for i in order], pa.binary())], ["u1", "u2", "key", "shard", "rank", "place", "low", "high", "bytes"])


def _window_hashes(uid: list[np.ndarray], h: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, own: list[bytes], shard: int) -> pa.RecordBatch:
    """Every window of very frequent anchors as a 128-bit hash."""
    import xxhash

    size = high - low + 1
    found = [xxhash.xxh3_128_digest(x[i : i + LENGTH]) for x, n in zip(own, size.tolist(), strict=True) for i in range(n)]
    row = np.repeat(np.arange(len(h)), size)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(place - high, size)
    return pa.RecordBatch.from_arrays([pa.array(uid[0][row]), pa.array(uid[1][row]), pa.array(begin), pa.array(found, pa.binary())], ["u1", "u2", "begin", "hash"])


def interleave(key: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Interval of every suffix at depths GRAM to LENGTH, one column each: the shards' orders, one after another by anchor, are interleaved byte by byte.

    Within an interval each shard's suffixes are in order already, so the stable sort of a
    step merges runs. A suffix that is alone in its interval, or shorter than the depth, is
    settled and gets an interval of its own (a negative number).
    """
    n = len(key)
    out = np.empty((n, LENGTH - GRAM + 1), np.int64)
    alone = -np.arange(1, n + 1)
    _, interval = np.unique(key, return_inverse=True)
    open_ = np.arange(n)
    for d in range(LENGTH + 1):
        if d:
            own = interval[open_] << 8 | right[open_, d - 1]
            own[depth[open_] < d] = -1
            open_, own = open_[own >= 0], own[own >= 0]
            order = np.argsort(own, kind="stable")
            open_, own = open_[order], own[order]
            fresh = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
            number = np.cumsum(fresh) - 1
            size = np.bincount(number) if len(own) else np.zeros(0, int)
            interval[open_] = number
            open_ = open_[size[number] > 1]
        if d >= GRAM:
            column = alone.copy()
            column[open_] = interval[open_]
            out[:, d - GRAM] = column
    return out


def repeated(key: np.ndarray, low: np.ndarray, high: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """For each anchor and distance 0 to SPAN - 1: whether the window that starts so far before it repeats."""
    n = len(key)
    flags = np.zeros((n, SPAN), bool)
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, SPAN), np.uint8)
    for i, x in enumerate(whole):
        h = int(high[i])
        r = x[h:]
        right[i, : len(r)] = np.frombuffer(r, np.uint8)
        left[i, :h] = np.frombuffer(x[:h], np.uint8)[::-1]
    interval = interleave(key, right, LENGTH - low.astype(np.int64))
    past = np.zeros(n, U)
    for d in range(SPAN):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows):
            own = interval[rows, LENGTH - d - GRAM]
            rows, own = rows[own >= 0], own[own >= 0]
            pair = mix(past[rows] ^ mix(own.astype(U) + U(1)))
            s = np.sort(pair)
            twice = s[1:][s[1:] == s[:-1]]
            if len(twice):
                j = np.minimum(np.searchsorted(twice, pair), len(twice) - 1)
                flags[rows[twice[j] == pair], d] = True
        past = mix(past * U(0x9E3779B97F4A7C15) + left[:, d].astype(U) + U(1))
    return flags


SPAN_SCHEMA = f"{UID}, begin long, end long"


def _spans(u1: np.ndarray, u2: np.ndarray, place: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """Covered stretches (uid, begin, end) of runs of repeated windows."""
    padded = np.zeros((len(flags), SPAN + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, near = np.nonzero(step == 1)
    _, far = np.nonzero(step == -1)  # runs near..far-1 of distances, in the same order
    return pa.RecordBatch.from_arrays([pa.array(u1[row]), pa.array(u2[row]), pa.array(place[row] - (far - 1)), pa.array(place[row] - near + LENGTH)], ["u1", "u2", "begin", "end"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Interleave the shards that met in this task, some whole anchors at a time; rows come by key, shard and rank."""
    rest: list[tuple] = []

    def run(rows: list[tuple]) -> pa.RecordBatch:
        u1, u2, key, place, low, high = (np.array([r[i] for r in rows], np.int64) for i in range(6))
        return _spans(u1, u2, place, repeated(key, low, high, [r[6] for r in rows]))

    for batch in batches:
        rest += zip(*(batch.column(c).to_pylist() for c in ("u1", "u2", "key", "place", "low", "high", "bytes")), strict=True)
        if len(rest) > TOGETHER:
            last = rest[-1][2]
            done = next((i for i in range(len(rest) - 1, -1, -1) if rest[i][2] != last), -1) + 1
            if done:
                yield run(rest[:done])
                rest = rest[done:]
    if rest:
        yield run(rest)


def suspected(docs: DataFrame) -> tuple[DataFrame, int]:
    """(u1, u2, tokens, often) of the texts with anchors that two places hold, and the bits of these; `docs` has u1, u2 and text."""
    expected = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 64

    def columns(texts: list[str | None]) -> tuple[np.ndarray, ...]:
        _, _, doc, *_, h = anchors(texts)
        return doc, mix(h)  # anchors have small hashes, which would crowd few shards

    known = shared_columns(docs.select(F.struct("u1", "u2").alias("id"), "text"), columns, [], expected).where(F.col("tokens").isNotNull())
    return known.select("id.u1", "id.u2", "tokens", "often").dropDuplicates(["u1", "u2"]), token_bits(expected)


def repeat_spans(docs: DataFrame, bits: int, together: int = TOGETHER) -> DataFrame:
    """(u1, u2, begin, end): stretches of bytes under windows that repeat; they may overlap. `docs` has u1, u2, text, tokens and often (null where nothing is suspected)."""
    hot = often(together)
    some = docs.where(F.col("tokens").isNotNull())
    near = _suspected(some, bits, lambda n: n <= hot, _transform, CONTEXT)
    spans = near.repartition("key").sortWithinPartitions("key", "shard", "rank").mapInArrow(tidy(_together), SPAN_SCHEMA)
    frequent = some.where(F.exists("often", lambda n: n > hot))
    if frequent.limit(1).count():
        windows = stored(_suspected(frequent, bits, lambda n: n > hot, _window_hashes, f"{UID}, begin long, hash binary"), "windows")
        twice = stored(windows.groupBy("hash").count().where(F.col("count") > 1).select("hash"), "twice")
        spans = spans.unionByName(windows.join(twice, "hash", "left_semi").select("u1", "u2", "begin", (F.col("begin") + LENGTH).alias("end")))
    return spans


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType)) and (not isinstance(kind, T.ArrayType) or _hashable(kind.elementType))


def remove_repeats(docs: DataFrame, text: str = "text", together: int = TOGETHER) -> DataFrame:
    """Replace `text` by `kept` (the bytes that no repeated window of LENGTH bytes covers) and add n_bytes, n_removed and spans (begin, end in bytes).

    Every copy goes, the first too; windows are judged on the input and never cross texts.
    Null and empty texts keep nothing and lose nothing; texts of any length are judged whole.
    Repeated rows repeat each other's bytes. Columns named as an added one are replaced, all
    others stay, whatever their type. A row is known again by 128 bits of its columns.
    """
    prepare(docs.sparkSession)
    added = [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))]
    clash = {f.name for f in added}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in clash and c != text))
    u1, u2, tokens, told, cut_ = fresh(docs, "__u1", "__u2", "__tokens", "__often", "__cut")
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)]
    rows = docs.withColumns({u1: F.xxhash64(*own), u2: F.xxhash64(F.lit("second"), *own)})
    known, bits = suspected(rows.select(F.col(u1).alias("u1"), F.col(u2).alias("u2"), F.col(text).alias("text")))
    # texts are dealt out once, beside what is suspected of them; both later steps read them as they lie
    lying = dealt(rows.join(known.select(F.col("u1").alias(u1), F.col("u2").alias(u2), F.col("tokens").alias(tokens), F.col("often").alias(told)), [u1, u2], "left"), "texts", u1, u2)
    spans = repeat_spans(lying.select(F.col(u1).alias("u1"), F.col(u2).alias("u2"), F.col(text).alias("text"), F.col(tokens).alias("tokens"), F.col(told).alias("often")), bits, together)
    cuts = spans.groupBy(F.col("u1").alias(u1), F.col("u2").alias(u2)).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias(cut_))
    both = lying.drop(tokens, told).join(cuts, [u1, u2], "left").drop(u1, u2)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text), *added])
    kept = schema.names[: -len(added)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for x, cuts_ in zip(batch.column(text).to_pylist(), batch.column(cut_).to_pylist(), strict=True):
                raw = (x or "").encode()
                merged: list[list[int]] = []
                for c in cuts_ or ():
                    if merged and c["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c["end"])
                    else:
                        merged.append([c["begin"], c["end"]])
                edges = [0, *(e for m in merged for e in m), len(raw)]
                out[0].append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                out[1].append(len(raw))
                out[2].append(len(raw) - len(out[0][-1]))
                out[3].append([{"begin": a, "end": b} for a, b in merged])
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), span), strict=True))], schema.names)

    return both.mapInArrow(tidy(cut), schema)


def op2(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = remove_repeats(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are cut out of hexadecimal text in two steps, as cutting from a long string reads all of it.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), k AS (
  SELECT r, c, substr(h, c * 512 + 1, 910) AS s FROM (SELECT r, h, unnest(range(0, (length(h) // 2 - 200) // 256 + 1)) AS c FROM d WHERE length(h) >= 400)
), w AS (
  SELECT r, c * 256 + i AS b, md5(substr(s, 2 * i + 1, 400)) AS m FROM (SELECT r, c, s, unnest(range(0, least(256, length(s) // 2 - 199))) AS i FROM k)
), g AS (
  SELECT r, b FROM (SELECT r, b, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1
), f AS (
  SELECT r, b, CASE WHEN b > lag(b) OVER (PARTITION BY r ORDER BY b) + 200 THEN 1 ELSE 0 END AS f FROM g
), s AS (
  SELECT r, min(b) AS a, max(b) + 200 AS z FROM (SELECT r, b, sum(f) OVER (PARTITION BY r ORDER BY b) AS i FROM f) GROUP BY r, i
), p AS (
  SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS y FROM s
), t AS (
  SELECT d.r, sum(z - a) AS n, count(*) AS spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM p JOIN d ON d.r = p.r GROUP BY d.r
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON t.r = d.r
"""
