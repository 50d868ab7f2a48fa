"""Which hashed columns of a corpus more than one place holds, and about how often.

A batch of texts and the hashes of its columns are one sparse block. Distinct hashes go to
shards by their leading bits, a batch's hashes of a shard as one row, so that a hot column
is one entry per batch. A shard counts, and answers each batch with the hashes that occur
twice or more; the batch's row, which holds who has what, meets the answers again. Shards
grow in number with the corpus, nothing is broadcast and nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import BATCH_ROWS, groups, tidy

#: Hashes a shard should see, up to MANY shards, and beyond these, so that a batch's rows for its shards don't get too small.
SHARD, MANY, LARGE = 1 << 20, 1 << 12, 1 << 22
#: Bits that tell columns apart, at least; bits of a text's place in its batch.
TOKEN, PLACE = 44, (BATCH_ROWS - 1).bit_length()
#: Characters of a batch, and hashes that a shard's task handles at a time.
BATCH, TOGETHER = 2 << 20, 1 << 19
#: Steps of an octave in which counts are told.
STEPS = 8
U = np.uint64


def shard_bits(columns: float) -> int:
    return max(8, min((int(columns) // SHARD).bit_length(), MANY.bit_length() - 1), min(30, (int(columns) // LARGE).bit_length()))


def token_bits(columns: float) -> int:
    """Bits of a column's hash that are kept, for about so many columns: more of them need more bits."""
    return min(64 - PLACE, max(TOKEN, shard_bits(columns) + 32))


def tokens_of(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> U(64 - bits)


def often(n: int) -> int:
    """A count as it is told: STEPS times its binary logarithm."""
    return int(STEPS * np.log2(n))


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of ascending numbers, byte by byte, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _numbers(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that are sorted by a column, by its values."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[column] != now:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


def shared_columns(docs: DataFrame, columns: Callable[[list], tuple], facts: list[str], expected: float, percent: int = 0) -> DataFrame:
    """Per row of `docs` (id, text): id, the facts, and `tokens` and `often` of the columns that two places or more hold.

    `columns(texts)` gives text index and hash of every column (repeats count) and one
    number per text and fact; the first fact is the number of a text's columns, of which
    `percent` must be shared, else its tokens are null. `expected` is about the number of
    columns of the corpus and sets the number of shards, no result. Tokens come rarest first
    (by `often`, see above, then by value): one order for the whole corpus.
    """
    bits, kept = shard_bits(expected), token_bits(expected)
    low = U(kept - bits)
    size = -(-(kept - bits) // 8)
    kind = docs.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in groups(texts, BATCH):
                m, own = z - a, own + 1
                doc, h, *known = columns(texts[a:z])
                v = tokens_of(h, kept) << U(PLACE) | doc.astype(U)
                v.sort()
                token = v >> U(PLACE)
                edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(v) else np.zeros(1, np.int64)
                begin, weight = edge[:-1], np.diff(edge)
                fresh = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
                holders = np.add.reduceat(fresh.astype(np.int64), begin) if len(v) else np.zeros(0, np.int64)
                token = token[begin]
                shard = (token >> low).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
                inner = token & ((U(1) << low) - U(1))
                place = [-own, *shard[cut[:-1]].tolist()]
                who = (v[fresh] & U((1 << PLACE) - 1)).astype(np.int64)
                one = _planes(who, 2), _planes(holders, 2)
                hashes = [one[0], *(_planes(inner[x:y], size) for x, y in zip(cut, cut[1:], strict=False))]
                weights = [one[1], *(_planes(weight[x:y], 4) if (weight[x:y] > 1).any() else None for x, y in zip(cut, cut[1:], strict=False))]
                n = len(place)
                only = pa.array(np.arange(n) > 0)
                ids = pa.ListArray.from_arrays(pa.array([0] + [m] * n, pa.int32()), pa.concat_arrays([batch.column("id").slice(a, m)]), mask=only)
                numbers = pa.ListArray.from_arrays(pa.array([0] + [m * len(known)] * n, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *known])), mask=only)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([own] * n, pa.int64()), ids, numbers, pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())], ["place", "batch", "ids", "facts", "a", "b"])

    asked = f"place long, batch long, ids array<{kind}>, facts array<long>, a binary, b binary"

    def answer(rows: list[dict]) -> pa.RecordBatch:
        token, weight = [], []
        for r in rows:
            token.append(_numbers(r["a"], size) | U(r["place"]) << low)
            weight.append(np.ones(len(token[-1]), np.int64) if r["b"] is None else _numbers(r["b"], 4).astype(np.int64))
        cut = np.cumsum([0, *map(len, token)])
        token, weight = np.concatenate(token), np.concatenate(weight)
        by = np.argsort(token)
        edge = np.flatnonzero(np.concatenate([[True], token[by][1:] != token[by][:-1]]))
        total = np.add.reduceat(weight[by], edge)
        count = np.empty(len(token), np.int64)
        count[by] = np.repeat(total, np.diff(np.append(edge, len(token))))
        hit = np.flatnonzero(count > 1)
        told = np.minimum(STEPS * np.log2(count[hit]), 255).astype(np.uint8)
        of = np.searchsorted(hit, cut)
        parts = [(hit[x:y], told[x:y], c) for x, y, c in zip(of, of[1:], cut, strict=False)]
        binary = lambda x: pa.array(x, pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([r["place"] for r in rows], pa.int64()), pa.array([r["batch"] for r in rows], pa.int64()), pa.nulls(len(rows), pa.list_(id_type[0])), pa.nulls(len(rows), pa.list_(pa.int64())), binary([_planes(p - c, 4) for p, _, c in parts]), binary([_planes(token[p], 8) for p, *_ in parts]), binary([t.tobytes() for _, t, _ in parts]), pa.array(np.diff(cut))],
            ["place", "batch", "ids", "facts", "a", "b", "c", "n"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = [to_arrow_type(docs.schema["id"].dataType)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for place, found in _chunks(batches, "place"):
            if place < 0:  # who holds what passes by
                r = found[0]
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([r["batch"]], pa.int64()), pa.array([r["ids"]], pa.list_(id_type[0])), pa.array([r["facts"]], pa.list_(pa.int64())), pa.array([r["a"]], pa.binary()), pa.array([r["b"]], pa.binary()), pa.nulls(1, pa.binary()), pa.array([0], pa.int64())], ["place", "batch", "ids", "facts", "a", "b", "c", "n"])
                continue
            rows += found
            n += sum(len(r["a"]) for r in found) // size
            if n > TOGETHER:
                yield answer(rows)
                rows, n = [], 0
        if rows:
            yield answer(rows)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (head, *answers) in _chunks(batches, "batch"):
            m = len(head["ids"])
            known = np.array(head["facts"], np.int64).reshape(len(facts), m) if facts else np.zeros((0, m), np.int64)
            who, holders = _numbers(head["a"], 2).astype(np.int64), _numbers(head["b"], 2).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(holders)])
            offset = np.concatenate([[0], np.cumsum([r["n"] for r in answers])]).astype(np.int64)
            if head["place"] != -1 or offset[-1] != len(holders):
                raise RuntimeError("answers of another attempt: the rows of `docs` changed between attempts of a task")
            at = np.concatenate([np.zeros(0, np.int64), *(_numbers(r["a"], 4).astype(np.int64) + o for r, o in zip(answers, offset, strict=False))])
            token = np.concatenate([np.zeros(0, U), *(_numbers(r["b"], 8) for r in answers)])
            told = np.frombuffer(b"".join(r["c"] for r in answers), np.uint8)
            each = holders[at]
            entry = np.repeat(begin[at] - np.cumsum(each) + each, each) + np.arange(each.sum())
            doc, token, told = who[entry], np.repeat(token, each), np.repeat(told, each)
            by = np.lexsort((token, told, doc))
            doc, token, told = doc[by], token[by], told[by]
            n = np.bincount(doc, minlength=m)
            enough = n > 0
            if percent:
                enough &= 100 * n >= percent * known[0]
            keep = enough[doc]
            cut = pa.array(np.concatenate([[0], np.cumsum(np.where(enough, n, 0))]).astype(np.int32))
            none = pa.array(~enough)
            lists = [pa.ListArray.from_arrays(cut, x, mask=none) for x in (pa.array(token[keep].view(np.int64)), pa.array(told[keep].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(head["ids"], id_type[0]), *(pa.array(x) for x in known), *lists], ["id", *facts, "tokens", "often"])

    sent = docs.select("id", "text").mapInArrow(tidy(emit), asked).repartition("place").sortWithinPartitions("place")
    back = sent.mapInArrow(tidy(judge), f"{asked}, c binary, n long").repartition("batch").sortWithinPartitions("batch", "place")
    return back.mapInArrow(tidy(assemble), ", ".join([f"id {kind}", *(f"{f} long" for f in facts), "tokens array<long>, often array<int>"]))
