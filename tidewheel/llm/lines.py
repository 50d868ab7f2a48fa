"""Line deduplication with two Bloom filters.

Hashes of line keys go to shards; each shard keeps a filter of keys seen once and one of
keys seen twice, sized by the keys it got. Occurrences whose key is in the second filter
are suspected repeats, and only those shuffle by key, to be counted exactly and to find the
copy that stays. A key that a task has met twice is suspected there and then, and told to
its shard once, so that a hot line sends one row per task to its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.blocks import mix
from tidewheel.llm.common import UPPER, fresh, groups, prepare, stored, tidy

#: Keys a shard should see, least number of shards, keys that a task's filters take at a time.
SHARD, LEAST_SHARDS, TOGETHER = 1 << 17, 1 << 10, 1 << 19
#: Probes and least bits per key of a filter; what collides is merely suspected.
PROBES, BITS = 4, 16
#: Keys that a task gathers before it tells its shards.
GATHERED = 1 << 18
STRIP = b" \t\n\v\f\r"
U = np.uint64


def key_of(line: bytes) -> bytes:
    """A line's key: stripped of \\x20 and \\x09-\\x0D at both ends, A-Z lower-cased."""
    return line.strip(STRIP).lower()


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)


def text_keys(text: str | None, chars: int) -> set[bytes]:
    return {k for k in map(key_of, (text or "").encode().split(b"\n")) if long_enough(k, chars)}


def digests(keys: list[bytes]) -> np.ndarray:
    """128 bits of each key as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").astype(U).reshape(-1, 2)


class TwoFilters:
    """A filter of keys seen once and one of keys seen twice, for about `n` keys."""

    def __init__(self, n: int):
        self.bits = max(1 << 10, 1 << (BITS * n - 1).bit_length()) if n else 1 << 10
        self.once, self.twice = np.zeros(self.bits, bool), np.zeros(self.bits, bool)

    def _probes(self, h: np.ndarray) -> np.ndarray:
        h = mix(h + U(1))
        step = mix(h) | U(1)
        return np.stack([((h + U(j) * step) >> U(17)) % U(self.bits) for j in range(PROBES)]).astype(np.int64)

    def add(self, h: np.ndarray, again: np.ndarray) -> None:
        """Hashes of one more batch; `again` marks those that stand for two occurrences."""
        h, at, n = np.unique(h, return_inverse=True, return_counts=True)
        probes = self._probes(h)
        seen = self.once[probes].all(axis=0) | (n > 1) | (np.bincount(at, again, len(h)) > 0)
        self.twice[probes[:, seen].ravel()] = True
        self.once[probes.ravel()] = True

    def repeated(self, h: np.ndarray) -> np.ndarray:
        return self.twice[self._probes(h)].all(axis=0)


def suspects(docs: DataFrame, chars: int, size: int) -> DataFrame:
    """(doc_id, k1, k2) of lines of `docs` (doc_id, text) whose key may occur twice, each key once per text; `size`, the characters in all, sets the number of shards."""
    shards = max(LEAST_SHARDS, 1 << (size // 64 // SHARD).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["place", "doc_id", "k1", "k2", "told"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list[pa.Array], keys: list[bytes]) -> pa.RecordBatch:
            k = digests(keys)
            _, first, at, n = np.unique(k[:, 0], return_index=True, return_inverse=True, return_counts=True)
            place = (k[:, 0] % U(shards)).astype(np.int64)
            often = np.flatnonzero(n > 1)
            place[n[at] > 1] = -1 - np.arange(np.count_nonzero(n[at] > 1)) % shards  # known here; its shard is told once
            rows = np.concatenate([np.arange(len(k)), first[often]])
            place = np.concatenate([place, (k[first[often], 0] % U(shards)).astype(np.int64)])
            told = np.arange(len(rows)) >= len(k)
            id_ = pa.concat_arrays(ids).take(pa.array(rows, mask=told))
            k = k[rows].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(place), id_, pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(told)], names)

        ids: list[pa.Array] = []
        keys: list[bytes] = []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in groups(texts):
                own = [text_keys(x, chars) for x in texts[a:z]]
                ids.append(batch.column("doc_id").slice(a, z - a).take(pa.array(np.repeat(np.arange(z - a), [len(x) for x in own]))))
                keys += [k for x in own for k in x]
                if len(keys) > GATHERED:
                    yield out(ids, keys)
                    ids, keys = [], []
        if keys:
            yield out(ids, keys)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by place, so all of a shard's stand together; some whole shards are filtered at a time."""

        def out(rows: pa.Table) -> pa.Table:
            k, told = rows["k1"].to_numpy().view(U), rows["told"].to_numpy()
            pair = TwoFilters(len(k))
            for i in range(0, len(k), 1 << 16):
                pair.add(k[i : i + (1 << 16)], told[i : i + (1 << 16)])
            return rows.filter(pa.array(pair.repeated(k) & ~told)).select(["doc_id", "k1", "k2"])

        parts: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            place = batch["place"].to_numpy()
            past = int(np.searchsorted(place, 0))
            if past:
                yield batch.slice(0, past).select(["doc_id", "k1", "k2"])
            batch, place = batch.slice(past), place[past:]
            if not len(place):
                continue
            if n > TOGETHER:  # up to the end of a shard
                last = parts[-1]["place"][-1].as_py()
                end = int(np.searchsorted(place, last, "right"))
                if end < len(place):
                    yield from out(pa.Table.from_batches([*parts, batch.slice(0, end)])).to_batches()
                    parts, n, batch = [], 0, batch.slice(end)
            parts.append(batch)
            n += len(batch)
        if parts:
            yield from out(pa.Table.from_batches(parts)).to_batches()

    sent = docs.mapInArrow(tidy(emit), f"place long, doc_id {kind}, k1 long, k2 long, told boolean")
    return sent.repartition("place").sortWithinPartitions("place").mapInArrow(tidy(judge), f"doc_id {kind}, k1 long, k2 long")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chars: int = 20, least: int = 3) -> DataFrame:
    """Keys of at least `chars` code points held by at least `least` documents: (doc_id, k1, k2) of the documents that lose them; k1 and k2 are 128 bits of the key.

    A document is a doc_id (repeated rows are one); the largest doc_id keeps its lines.
    A null doc_id counts for no key, and loses lines that enough others hold.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = stored(suspects(docs, chars, docs.agg(F.sum(F.length("text"))).first()[0] or 0), "suspects")
    repeated = held.groupBy("k1", "k2").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= least).select("k1", "k2", "last")
    repeated = stored(repeated, "repeated")  # so that both sides of the join are dealt out anew, and a hot line can be split
    return held.join(repeated, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "k1", "k2")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chars: int = 20, least: int = 3, added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Rewrite `text` without repeated lines and add the numbers of lines before and of dropped ones, named as in `added`.

    All rows and columns stay (columns named as an added one are replaced). A null or
    empty text is one empty line and becomes an empty text. Lines with short keys stay. A long
    text is one row like any other, and is split into lines whole. Of equal doc_ids all rows
    keep the lines or none.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {x.lower() for x in added}))
    own, drop_ = fresh(docs, "__own", "__drop")
    lost = repeated_lines(docs, text, doc_id, chars, least).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("k1", "k2")).alias(drop_))
    both = docs.join(lost, docs[doc_id].eqNullSafe(lost[own]), "left").drop(own)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    names = schema.names

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for x, drop in zip(batch.column(text).to_pylist(), batch.column(drop_).to_pylist(), strict=True):
                lines = (x or "").encode().split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = {d["k1"].to_bytes(8, "little", signed=True) + d["k2"].to_bytes(8, "little", signed=True) for d in drop}
                    lines = [y for y in lines if not (long_enough(k := key_of(y), chars) and xxhash.xxh3_128_digest(k) in gone)]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(b"\n".join(lines).decode() if drop else x or "")
            columns = {text: pa.array(texts, pa.string()), added[0]: pa.array(n_lines, pa.int64()), added[1]: pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(c) if c in columns else batch.column(c) for c in names], names)

    return both.mapInArrow(tidy(rewrite), schema)


def op4(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
