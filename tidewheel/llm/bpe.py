"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

The words that are frequent in the corpus are counted by Spark, encoded once on the
driver and compiled into a minimal acyclic automaton: words share prefixes and suffixes,
the outputs on its arcs add up to the word's number, and that number leads to its ids.
Tasks memory-map the automaton; words that it lacks are merged exactly, by rank.
"""

from __future__ import annotations

import gc
import heapq
import json
import tempfile
from collections.abc import Iterator
from itertools import chain, islice, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import map_texts, prepare, stored, tidy

#: The byte-level pre-tokeniser's published pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A letter run, alone or before one of these, splits without the pattern.
STOPS = frozenset(".,;:!?")
#: Where a space inside white space stands, the pieces between spaces can't be taken one by one.
INNER_SPACE = regex.compile(r"\s \s")
#: Frequent words in the lexicon, at most; and the longest piece (code points) counted for it.
LEXICON_WORDS, LEXICON_LENGTH = 65_536, 64
#: Entries of a memo of pieces within a task, and of what a worker keeps of it for the next one.
MEMO, KEPT = 200_000, 50_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _cuts(sizes: np.ndarray) -> np.ndarray:
    """Where pieces of these sizes begin in a row, and the end."""
    cut = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=cut[1:])
    return cut


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of `flat` that begin at `start`, one after another."""
    cut = _cuts(size)
    return flat[np.repeat(start - cut[:-1], size) + np.arange(cut[-1])]


class Merges:
    """Vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        assert model["type"] == "BPE" and not model.get("byte_fallback") and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "only byte-level BPE files are supported"
        chars = byte_alphabet()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda token: bytes(chars[c] for c in token)
        self.bytes = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id = {chars[t]: i for t, i in vocab.items() if len(t) == 1}
        self.pair = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pair[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.of_byte = np.array([self.byte_id[b] for b in range(256)], np.int32)
        self.none, self.merged = len(model["merges"]), np.array([new for _, new in self.pair.values()], np.int32)
        keys = np.array([a << 20 | b for a, b in self.pair], np.int64)
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        self.rank_of = self.rank_of.astype(np.int32)
        self.of_bytes = np.array([[self.pair.get((self.byte_id[a], self.byte_id[b]), (self.none,))[0] for b in range(256)] for a in range(256)], np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode(self, word: bytes) -> tuple[int, ...]:
        return self.encode_many([word])[0]

    def encode_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        flat, cut = self.encode_flat(words)
        flat = flat.tolist()
        return [tuple(flat[a:b]) for a, b in pairwise(cut.tolist())]

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of pre-tokens: in each word always the pair of lowest rank, leftmost first. All words' ids and where each word's begin and end.

        Short words advance together, one merge of each word in a round.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(size > 48).tolist()
        raw = np.frombuffer(b"".join(x for x in words if len(x) <= 48) if long else b"".join(words), np.uint8)
        ids = self.of_byte[raw]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.where(size > 48, 0, size))
        rank = np.full(len(ids), self.none, np.int32)
        if len(ids) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.of_bytes[raw[:-1], raw[1:]], self.none)
        done_ids, done_words = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i in long:
            done_ids.append(np.array(self._long([self.byte_id[b] for b in words[i]]), np.int32))
            done_words.append(np.full(len(done_ids[-1]), i, np.int32))
        while len(ids):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, start)
            least = np.repeat(best, np.diff(start, append=len(word)))
            if (best == self.none).any():
                over = least == self.none
                done_ids.append(ids[over])
                done_words.append(word[over])
                ids, word, rank, least = (x[~over] for x in (ids, word, rank, least))
            at = np.flatnonzero(rank == least)
            at = at[np.diff(word[at], prepend=-1) > 0]
            ids[at] = self.merged[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            ids, word, rank = ids[stay], word[stay], rank[stay]
            for x in (at, at[at > 0] - 1):
                rank[x] = self._ranks(ids, word, x)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], _cuts(np.bincount(word, minlength=len(words)))

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each of some places, `none` where no merge exists or the word ends."""
        rank = np.full(len(at), self.none, np.int32)
        after = np.minimum(at + 1, len(ids) - 1)
        inside = np.flatnonzero((word[at] == word[after]) & (after > at))
        key = ids[at[inside]].astype(np.int64) << 20 | ids[after[inside]]
        j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[j] == key
        rank[inside[hit]] = self.rank_of[j[hit]]
        return rank

    def _long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap and a linked list, in n log n for words of any length."""
        n, pair = len(ids), self.pair
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*pair[p], i, *p) for i, p in enumerate(pairwise(ids)) if p in pair]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if p := pair.get((new, ids[k])):
                    heapq.heappush(heap, (p[0], i, p[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (p := pair.get((ids[h], new))):
                heapq.heappush(heap, (p[0], h, p[1], ids[h], new))
        return tuple(x for x in ids if x >= 0)


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """A minimal acyclic transducer as one file: words in byte order are added to a trie whose finished branches are merged with equal ones."""
    order = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final, arcs (label, target)
    path: list[list] = [[False, []]]  # unfinished states along the last word
    last = b""

    def close(upto: int) -> None:
        while len(path) > upto + 1:
            final, arcs = path.pop()
            key = (final, tuple(map(tuple, arcs)))
            if (at := register.get(key)) is None:
                at = register[key] = len(states)
                states.append(key)
            path[-1][1][-1][1] = at

    for w in order:
        common = next((i for i, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
        close(common)
        for b in w[common:]:
            path[-1][1].append([b, -1])
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], tuple(map(tuple, path[0][1]))))
    count = np.zeros(len(states), np.int64)  # words that end at or below a state; targets come first
    keys, targets, outs = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for label, t in arcs:
            keys.append(s << 8 | label)
            targets.append(t)
            outs.append(n)
            n += count[t]
        count[s] = n
    by = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [words[w] for w in order]
    arrays = [
        np.array([len(states) - 1, len(by), len(states), len(order), sum(map(len, ids)), max(map(len, order), default=0)], np.int32),
        np.array(keys, np.int32)[by],
        np.array(targets, np.int32)[by],
        np.array(outs, np.int32)[by],
        np.array([f for f, _ in states], np.int32),
        np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32),
        np.fromiter(chain.from_iterable(ids), np.int32),
    ]
    return b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled transducer, memory-mapped from a file."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, np.int32, "r"))
        self.root, arcs, states, words, ids, self.longest = map(int, data[:6])
        cuts = np.cumsum([6, arcs, arcs, arcs, states, words + 1, ids])
        self.keys, self.targets, self.outs, self.final, self.offset, self.ids = (data[a:b] for a, b in pairwise(cuts))

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Ids of each word, None where the automaton doesn't accept it."""
        return [tuple(self.ids[self.offset[n] : self.offset[n + 1]].tolist()) if n >= 0 else None for n in self.numbers(words).tolist()]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the automaton doesn't accept it; all words step together."""
        if not words or not len(self.keys):
            return np.full(len(words), -1)
        size = np.fromiter(map(len, words), np.int64, len(words))
        state, total = np.full(len(words), self.root, np.int32), np.zeros(len(words), np.int32)
        alive = np.flatnonzero((size > 0) & (size <= self.longest))
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        raw = np.frombuffer(b"".join(words), np.uint8)
        found = np.full(len(words), -1)
        at = 0
        while len(alive):
            key = state[alive] << 8 | raw[begin[alive] + at].astype(np.int32)
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[j] == key
            alive, j = alive[ok], j[ok]
            state[alive] = self.targets[j]
            total[alive] += self.outs[j]
            at += 1
            ended = size[alive] == at
            done = alive[ended]
            done = done[self.final[state[done]] == 1]
            found[done] = total[done]
            alive = alive[~ended]
        return found


_local: dict[str, object] = {}


def _mapped(lexicon: bytes) -> Lexicon:
    """The lexicon mapped from a file of this machine, whose name goes at once, so that nothing stays behind."""
    with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:
        f.write(lexicon)
        f.flush()
        return Lexicon(f.name)


class Memo:
    """Pieces that a task has met, by number, and their ids one after another."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0  # of `ids`

    def add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, end = len(self.number), self.used + len(ids)
        if n + len(pieces) > len(self.start):
            self.start, self.size = (np.concatenate([x[:n], np.zeros(n + 2 * len(pieces), np.int64)]) for x in (self.start, self.size))
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(end + len(ids), np.int32)])
        self.number.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.start[n : n + len(pieces)], self.size[n : n + len(pieces)] = self.used + _cuts(size)[:-1], size
        self.ids[self.used : end] = ids
        self.used = end

    def keep(self, most: int) -> None:
        """Keep the pieces met first, which are frequent ones."""
        if len(self.number) > most:
            self.number = dict(islice(self.number.items(), most))
            self.used = int(self.start[most])
            self.ids, self.start, self.size = self.ids[: self.used].copy(), self.start[:most].copy(), self.size[:most].copy()


class Codec:
    """Encodes and decodes texts in one Python worker."""

    def __init__(self, source: bytes, lexicon: bytes | None):
        self.merges = Merges(source)
        self.lexicon = _mapped(lexicon) if lexicon else None
        self.bare, self.led = Memo(), Memo()  # pieces as they stand; pieces with a space before them
        gc.set_threshold(200_000, 50, 1000)
        self.bytes = pa.array([self.merges.bytes.get(i, b"") for i in range(max(self.merges.bytes) + 1)], pa.large_binary())

    @classmethod
    def local(cls, source: bytes, lexicon: bytes | None) -> Codec:
        key = f"{hash(source)}:{hash(lexicon)}"
        if _local.get("key") != key:
            _local.update(key=key, codec=cls(source, lexicon))
        return _local["codec"]

    def _learn(self, memo: Memo, pieces: list[str], lead: str) -> None:
        """Put the ids of `lead` + piece into a memo; their pre-tokens don't depend on what stands around."""
        tokens: list[str] = []
        count = []
        for p in pieces:
            if p.isalpha():
                tokens.append(lead + p)
                count.append(1)
            elif p[-1:] in STOPS and p[:-1].isalpha():
                tokens += lead + p[:-1], p[-1]
                count.append(2)
            else:
                own = PATTERN.findall(lead + p)
                tokens += own
                count.append(len(own))
        words = list(map(str.encode, tokens))
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        number = self.lexicon.numbers(words) if self.lexicon else np.full(len(words), -1)
        lost = np.flatnonzero(number < 0)
        distinct = {w: i for i, w in enumerate(dict.fromkeys(map(words.__getitem__, lost.tolist())))}
        flat, cut = self.merges.encode_flat(list(distinct))
        at = np.fromiter((distinct[words[i]] for i in lost.tolist()), np.int64, len(lost))
        start[lost], size[lost] = cut[at], cut[at + 1] - cut[at]
        if self.lexicon:
            known = np.flatnonzero(number >= 0)
            first = self.lexicon.offset[number[known]].astype(np.int64)
            start[known], size[known] = len(flat) + first, self.lexicon.offset[number[known] + 1] - first
            flat = np.concatenate([flat, self.lexicon.ids])
        sizes = np.diff(_cuts(size)[_cuts(np.array(count, np.int64))])
        memo.add(pieces, _gathered(flat, start, size), sizes)

    def _numbers(self, memo: Memo, pieces: list[str], lead: str) -> np.ndarray:
        """Each piece's number in a memo."""
        if len(memo.number) > MEMO:  # the newest go; what is frequent was learnt early
            memo.keep(MEMO // 2)
        found = np.fromiter(map(memo.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        lost = np.flatnonzero(found < 0).tolist()
        if lost:
            missing = list(map(pieces.__getitem__, lost))
            self._learn(memo, list(dict.fromkeys(missing)), lead)
            found[lost] = np.fromiter(map(memo.number.__getitem__, missing), np.int64, len(missing))
        return found

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids and where each text's begin and end: special strings first, then pieces between spaces, then their pre-tokens."""
        split, special = self.merges.split, self.merges.special
        bare, led = [], []
        kinds, runs, steps = [], [], []  # runs of special ids (0), bare (1) and led (2) pieces; and how many runs each text has
        specials = []
        for x in texts:
            before = len(runs)
            for i, part in enumerate(split.split(x) if x and any(t in x for t in special) else [x or ""]):
                if i % 2:
                    specials.append(special[part])
                    kinds.append(0)
                    runs.append(1)
                    continue
                first, rest = (PATTERN.findall(part), []) if INNER_SPACE.search(part) else ((q := part.split(" "))[:1], q[1:])
                kinds += 1, 2
                runs += len(first), len(rest)
                bare += first
                led += rest
            steps.append(len(runs) - before)
        # pieces of each kind lie in a row; a run takes the next of its kind
        numbers = [np.arange(len(specials)), self._numbers(self.bare, bare, ""), self._numbers(self.led, led, " ")]
        tables = [(np.array(specials, np.int32), np.arange(len(specials)), np.ones(len(specials), np.int64)), *((m.ids[: m.used], m.start, m.size) for m in (self.bare, self.led))]
        bases = _cuts(np.array([len(t[0]) for t in tables]))
        start = np.concatenate([t[1][n] + base for t, n, base in zip(tables, numbers, bases[:-1], strict=True)])
        size = np.concatenate([t[2][n] for t, n in zip(tables, numbers, strict=True)])
        kind, run = np.array(kinds, np.int8), np.array(runs, np.int64)
        begin, offset = np.zeros(len(run), np.int64), 0
        for k in range(3):
            own = kind == k
            cut = _cuts(run[own])
            begin[own] = offset + cut[:-1]
            offset += int(cut[-1])
        order = _gathered(np.arange(len(start)), begin, run)
        start, size = start[order], size[order]
        ends = _cuts(size)[_cuts(run)[_cuts(np.array(steps, np.int64))]]
        return _gathered(np.concatenate([t[0] for t in tables]), start, size), ends

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        flat, cut = self.encode_flat(texts)
        flat = flat.tolist()
        return [flat[a:b] for a, b in pairwise(cut.tolist())]

    def trim(self) -> None:
        """Keep the pieces learnt first and forget the rest."""
        self.bare.keep(KEPT)
        self.led.keep(KEPT)

    def decode_flat(self, ids: np.ndarray, cut: np.ndarray) -> pa.Array:
        """The text of each range of ids; broken UTF-8 is U+FFFD."""
        taken = self.bytes.take(pa.array(ids, pa.int32()))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1][cut]
        data = taken.buffers()[2]
        if offsets[-1] - offsets[0] < 1 << 31:
            whole = pa.py_buffer(b"") if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            texts = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), whole)
            try:
                texts.validate(full=True)
                return texts
            except pa.ArrowInvalid:
                pass
        return pa.array([data[a:b].to_pybytes().decode("utf-8", "replace") if b > a else "" for a, b in pairwise(offsets.tolist())], pa.string())

    def decode_batch(self, ids: list[list[int] | None]) -> list[str]:
        cut = _cuts(np.array([len(x or ()) for x in ids], np.int64))
        return self.decode_flat(np.fromiter(chain.from_iterable(x or () for x in ids), np.int32, int(cut[-1])), cut).to_pylist()


def frequent_pieces(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """The pieces between spaces that make up over 2**-20 of all whole texts' pieces, with counts: the `most` most frequent, ties by byte order.

    At most 2**20 pieces can have that share, which bounds what is sorted.
    """

    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(n: pa.Table) -> pa.Table:
            return n.group_by("piece").aggregate([("n", "sum")]).rename_columns(["piece", "n"])

        n, most_rows = schema.empty_table(), 250_000
        for batch in batches:
            texts = batch.column(0)
            found = pc.list_flatten(pc.split_pattern(texts, " ")).value_counts()
            size = pc.utf8_length(found.field(0))
            found = found.filter(pc.and_(pc.greater(size, 0), pc.less_equal(size, LEXICON_LENGTH)))
            n = pa.concat_tables([n, pa.Table.from_arrays([found.field(0).cast(pa.string()), found.field(1)], schema=schema)])
            if len(n) > most_rows:
                n = out(n)
                if len(n) > 500_000:
                    yield from n.to_batches()
                    n, most_rows = schema.empty_table(), 250_000
                else:
                    most_rows = 2 * len(n) + 250_000
        yield from out(n).to_batches()

    counted = stored(docs.select(text).mapInArrow(tidy(count), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where(F.col("n") > total >> 20).orderBy(F.desc("n"), "piece").limit(most)


def _lists(ids: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids, pa.int32()))


class BytePairCoder:
    """Encoder and decoder for one byte-level BPE file.

    `fit` counts the words of `docs` and compiles the lexicon, at most `LEXICON_WORDS`
    pieces of at most `LEXICON_LENGTH` code points, so that what is broadcast is bounded
    (about 10 MB). Without `fit` every word is merged; the ids are the same.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.source = f.read()
        self.lexicon: bytes | None = None
        self._sent = None

    def fit(self, docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> BytePairCoder:
        prepare(docs.sparkSession)
        pieces = [r.piece for r in frequent_pieces(docs, text, words).collect()]
        merges = Merges(self.source)
        tokens = {t.encode() for p in pieces for t in PATTERN.findall(" " + p)}
        order = list(tokens)
        self.lexicon, self._sent = compile_lexicon(dict(zip(order, merges.encode_many(order), strict=True))), None
        return self

    def _broadcast(self, df: DataFrame):
        if self._sent is None:
            self._sent = df.sparkSession.sparkContext.broadcast((self.source, self.lexicon))
        return self._sent

    def encode(self, docs: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """Add `out`, the ids of each whole text; nulls and empty texts give an empty array.

        All other columns and repeated rows stay; a column named as `out` is replaced.
        """
        sent = self._broadcast(docs)
        return map_texts(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], lambda texts: [_lists(*Codec.local(*sent.value).encode_flat(texts))], finish=lambda: Codec.local(*sent.value).trim())

    def round_trip(self, docs: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
        """`encode`, then `decode`, in one Python worker per task instead of two."""
        sent = self._broadcast(docs)

        def both(texts: list) -> list:
            codec = Codec.local(*sent.value)
            found = codec.encode_flat(texts)
            return [_lists(*found), codec.decode_flat(*found)]

        added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())]
        return map_texts(docs, text, added, both, finish=lambda: Codec.local(*sent.value).trim())

    def decode(self, docs: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """Add `out`, the text that the ids stand for; null gives an empty text, broken UTF-8 U+FFFD."""
        sent = self._broadcast(docs)
        schema = T.StructType([*(f for f in docs.schema.fields if f.name.lower() != out.lower()), T.StructField(out, T.StringType())])
        kept = [f.name for f in schema.fields[:-1]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column(ids)
                if column.null_count:
                    rows = column.to_pylist()
                else:
                    flat = column.values.to_numpy().tolist()
                    rows = [flat[a:z] for a, z in pairwise(column.offsets.to_pylist())]
                texts = Codec.local(*sent.value).decode_batch(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

        return docs.mapInArrow(tidy(run), schema)


def op3(docs: DataFrame, path: str) -> DataFrame:
    """Digest of a round trip per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coder = BytePairCoder(path).fit(docs)
    both = coder.round_trip(docs.select("doc_id", "text")).drop("text")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
