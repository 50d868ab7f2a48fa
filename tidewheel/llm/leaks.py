"""Benchmark decontamination by greedy string tiling.

Windows of MATCH words shared by a document and a test item are seeds. From their running
Karp-Rabin hashes, maximal matches are marked longest first without overlap, and the share
of the item's words that tiles cover decides, so passages in another order count too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewheel.llm.blocks import Words
from tidewheel.llm.common import groups, prepare, stored, tidy

#: Words of the shortest tile, and the share of an item's words that tiles must cover.
MATCH, COVERAGE = 5, 0.6
#: Characters of all items together up to which they are sent to every task; beyond it seeds are joined.
BROADCAST_CHARS = 32 << 20
#: Bits of the filter of item windows, and those that one task sets.
FILTER_BITS, STRETCH = 1 << 26, 1 << 17


def maximal(hits: Iterable[tuple[int, np.ndarray]], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal windows: words, document start, item start. `hits` has document starts, ascending, each with its ascending item starts.

    One document start is looked at at a time, so memory grows with the item and the runs, not with the pairs of equal windows.
    """
    none = np.zeros(0, np.int64)
    out, last, before, begun = [], -2, none, none

    def close(which: np.ndarray) -> None:
        more = before[which] - begun[which]
        out.append((more + match, last - more, begun[which]))

    for j, now in hits:
        start = now.copy()
        if j == last + 1 and len(before):
            k = np.minimum(np.searchsorted(before, now - 1), len(before) - 1)
            on = before[k] == now - 1
            start[on] = begun[k[on]]
            ended = np.ones(len(before), bool)
            ended[k[on]] = False
            close(ended)
        elif len(before):
            close(np.ones(len(before), bool))
        last, before, begun = j, now, start
    if len(before):
        close(np.ones(len(before), bool))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def greedy(item: int, doc: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray], match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of sequences of so many words from their maximal runs: (item start, document start, words), longest first.

    Ties go to the smaller document start, then the smaller item start.
    """
    heap = list(zip((-runs[0]).tolist(), runs[1].tolist(), runs[2].tolist(), strict=True))
    heapq.heapify(heap)
    used_item, used_doc = np.zeros(item, bool), np.zeros(doc, bool)
    out = []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = ~(used_item[i : i + n] | used_doc[j : j + n])
        if free.all():
            used_item[i : i + n] = used_doc[j : j + n] = True
            out.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= match:
                heapq.heappush(heap, (-(b - a), j + a, i + a))
    return out


def tiles(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], match: int = MATCH) -> list[tuple[int, int, int]]:
    """`greedy` from the (item, document) starts of all equal windows of `match` words."""
    by_doc: dict[int, list[int]] = {}
    for i, j in sorted(seeds):
        by_doc.setdefault(j, []).append(i)
    return greedy(len(item), len(doc), maximal(((j, np.array(by_doc[j])) for j in sorted(by_doc)), match), match)


class Items:
    """Test items as word hashes, with the windows of all of them in one sorted array."""

    def __init__(self, ids: list, texts: list[str | None], match: int):
        words = Words(texts, lower=True)
        self.ids, self.match = ids, match
        self.words = [words.hash[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
        at, h = words.windows(match)
        by = np.argsort(h, kind="stable")
        self.hash, self.item, self.start = h[by], words.doc[at][by], (at - words.first[words.doc[at]])[by]

    def leaks(self, texts: list[str | None], coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text index, item index, covered share, tiles) of every pair with enough coverage."""
        words = Words(texts, lower=True)
        at, h = words.windows(self.match)
        if not len(at) or not len(self.hash):
            return
        lo = np.searchsorted(self.hash, h)
        hit = np.flatnonzero(self.hash[np.minimum(lo, len(self.hash) - 1)] == h)
        hi = np.searchsorted(self.hash, h[hit], "right")
        seeds: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for w, a, b in zip(at[hit].tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
            d, items = int(words.doc[w]), self.item[a:b]
            cut = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1], [True]])).tolist()
            for x, y in zip(cut, cut[1:], strict=False):
                seeds.setdefault((d, int(items[x])), []).append((w - int(words.first[d]), self.start[a + x : a + y]))
        for (d, i), own in sorted(seeds.items(), key=lambda s: s[0]):
            size = len(self.words[i])
            covered = np.zeros(size + 1, np.int64)
            begin = np.unique(np.concatenate([s for _, s in own]))
            covered[begin] += 1
            np.add.at(covered, begin + self.match, -1)
            if np.count_nonzero(np.cumsum(covered)) < coverage * size:
                continue  # tiles can't cover more than the seeds
            found = greedy(size, int(words.counts[d]), maximal(own, self.match), self.match)
            share = sum(n for *_, n in found) / size
            if share >= coverage:
                yield d, i, share, found


def _schema(doc: str, item: str) -> str:
    return f"doc_id {doc}, item_id {item}, coverage double, tiles array<struct<item_start:long,doc_start:long,words:long>>"


def _rows(found: list, doc_ids: pa.Array, item_ids: list, kind: pa.DataType) -> pa.RecordBatch:
    tile = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())]))
    own = [[{"item_start": i, "doc_start": j, "words": n} for i, j, n in x[3]] for x in found]
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array([x[0] for x in found], pa.int64())), pa.array([item_ids[x[1]] for x in found], kind), pa.array([x[2] for x in found], pa.float64()), pa.array(own, tile)], ["doc_id", "item_id", "coverage", "tiles"])


def find_leaks(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per document and item with at least `coverage` of the item's words under tiles: doc_id, item_id, coverage, tiles (in words).

    `docs` (doc_id, text), `items` (item_id, text). Items of fewer than `match` words can't be
    told from chance and match nothing; so do null and empty texts. Repeated rows of either
    give repeated result rows. Texts of any length are tiled whole. Items of up to
    `broadcast_chars` characters in all are sent to the tasks; more are joined by the hashes
    of their windows. Both ways give the same rows.
    """
    spark = prepare(docs.sparkSession)
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").where(F.col("text").isNotNull())
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    arrow = to_arrow_type(items.schema["item_id"].dataType)
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= broadcast_chars:
        rows = items.collect()
        sent = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], match))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in batches:
                texts = b.column("text").to_pylist()
                for x, y in groups(texts):
                    found = list(known.leaks(texts[x:y], coverage))
                    yield _rows(found, b.column("doc_id").slice(x, y - x), known.ids, arrow)

        return docs.mapInArrow(tidy(scan), _schema(*kinds))
    return _joined(docs, items, match, coverage, kinds, arrow)


def _joined(docs: DataFrame, items: DataFrame, match: int, coverage: float, kinds: tuple, arrow: pa.DataType) -> DataFrame:
    """As `find_leaks`, for any number of items: a fixed-size filter of item windows picks candidate texts, window hashes pair them."""
    spark = docs.sparkSession
    items = stored(items.withColumn("iid", F.monotonically_increasing_id()), "items")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("iid")
            for x, y in groups(texts):
                words = Words(texts[x:y], lower=True)
                at, h = words.windows(match)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(words.doc[at] + x)), pa.array(h.view(np.int64))], ["iid", "hash"])

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed bits of each stretch of the filter."""
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            part, place = b.column("part").to_numpy(), b.column("place").to_numpy()
            for p in np.unique(part).tolist():
                bits.setdefault(p, np.zeros(STRETCH, bool))[place[part == p] % STRETCH] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([np.packbits(x).tobytes() for x in bits.values()], pa.binary())], ["part", "bits"])

    seeds = stored(items.mapInArrow(tidy(windows), "iid long, hash long").groupBy("hash", "iid").agg(F.count("*").alias("places")), "seeds")
    place = F.pmod("hash", F.lit(FILTER_BITS))
    places = seeds.select(place.alias("place"), F.call_function("div", place, F.lit(STRETCH)).alias("part")).distinct().repartition("part")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in places.mapInArrow(tidy(stretch), "part long, bits binary").collect():  # FILTER_BITS in all
        bits[r.part * STRETCH // 8 : (r.part + 1) * STRETCH // 8] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).view(bool)
        for b in batches:
            texts = b.column("text").to_pylist()
            for x, y in groups(texts):
                words = Words(texts[x:y], lower=True)
                at, h = words.windows(match)
                hit = known[h.view(np.int64) % FILTER_BITS]
                own = np.unique(np.stack([words.doc[at][hit], h[hit].view(np.int64)]), axis=1) if hit.any() else np.zeros((2, 0), np.int64)
                rows = np.unique(own[0])
                cut = np.searchsorted(own[0], rows)
                lists = [part.tolist() for part in np.split(own[1], cut[1:])] if len(rows) else []
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows + x)), pa.array([texts[x + i] for i in rows.tolist()], pa.string()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "text", "hashes"])

    near = stored(docs.mapInArrow(tidy(candidates), f"doc_id {kinds[0]}, text string, hashes array<long>").withColumn("rid", F.monotonically_increasing_id()), "candidates")
    pairs = near.select("rid", F.explode("hashes").alias("hash")).join(seeds, "hash").groupBy("rid", "iid").agg(F.sum("places").alias("places"))
    whole = seeds.groupBy("iid").agg((F.sum("places") + match - 1).alias("words"))
    pairs = pairs.join(whole, "iid").where(match * F.col("places") >= coverage * F.col("words")).select("rid", "iid")  # tiles can't cover more than the seeds
    full = pairs.join(items.select("iid", "item_id", F.col("text").alias("item")), "iid").join(near.select("rid", "doc_id", "text"), "rid").select("doc_id", "text", "item_id", "item")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, (text, item) in enumerate(zip(b.column("text").to_pylist(), b.column("item").to_pylist(), strict=True)):
                found += [(k, k, share, own) for _, _, share, own in Items([0], [item], match).leaks([text], coverage)]
            yield _rows(found, b.column("doc_id"), b.column("item_id").to_pylist(), arrow)

    return full.mapInArrow(tidy(check), _schema(*kinds))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that leak no item; all columns stay. Rows with a leaking row's doc_id go with it."""
    leaked = find_leaks(docs, items, **options).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["__id"]), "left_anti")


def op9(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaking pair: doc_id, item_id, coverage, n_tiles, matched_words."""
    found = find_leaks(docs, items)
    words = F.aggregate(F.transform("tiles", lambda t: t["words"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").cast("long").alias("n_tiles"), words.alias("matched_words"))
