"""The numbered operators against brute force, on small texts with the odd ones among them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import bpe, classifier, components, jaccard, leaks, licences, lines, private, quality, repeats, scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "é😀 ñ", "x" * 30_000, "w " * 9000, "Same line of twenty characters\n" * 3, "\x00 \xa0 z", "tab\tnew\nline\r\n", "A b C d E f G"]


def prose(seed, n, syllables="the an er in on at re th ou ha".split()):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    line = "A line that several documents repeat word for word.\n"
    base = [prose(i, 80) for i in range(25)]
    near = [" ".join(w if (i * 31 + j * 7) % 97 else "changed" for j, w in enumerate(prose(100, 200).split())) for i in range(12)]
    return ODD + base + near + [line + prose(200 + i, 30) + "\n" + line for i in range(4)] + [base[0], base[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[15])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).persist()


def collected(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(got, want):
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=order) == sorted(want, key=order)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# --- 1


def brute_counts(t):
    words, ls = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_quality_counts(docs):
    got = collected(quality.op1(docs), "doc_id", *quality.COUNTS, "base_failed")
    want = []
    for d, t in pairs(docs):
        c = brute_counts(t)
        want.append((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    same(got, want)


def test_cascade_is_order_free_and_short():
    seen = []

    def rule(name, bad):
        return quality.Rule(name, lambda x: (seen.append((name, len(x))), [t == bad for t in x])[1])

    a, b = rule("a", "x"), rule("b", "y")
    assert quality.cascade(["x", "y", "z"], [a, b]) == ["a", "b", None]
    assert seen == [("a", 3), ("b", 2)]
    assert quality.cascade(["x", "y", "z"], [b, a]) == ["a", "b", None]


def test_rules_order_by_rejection_per_cost(spark):
    import time

    slow = quality.Rule("slow", lambda x: (sum(range(3_000_000)), [True] * len(x))[1])
    fast = quality.Rule("fast", lambda x: [True] * len(x))
    df = spark.createDataFrame([(i, prose(i, 20)) for i in range(20)], "doc_id long, text string")
    assert [r.name for r in quality.order_rules(df, [slow, fast])] == ["fast", "slow"]
    assert time.thread_time() > 0


# --- 2


def brute_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if n[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((len(r), sum(gone), sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1])), sha(bytes(b for b, g in zip(r, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("together", [repeats.TOGETHER, 3])
def test_repeated_bytes(spark, together):
    rnd = random.Random(5)
    shared = "".join(rnd.choice("abcdé ") for _ in range(420))
    texts = [*ODD[:6], "ab" * 400, "x" * 199, "x" * 200, "q" * 900, *(shared[rnd.randint(0, 150) : rnd.randint(260, 420)] + prose(i, 20) for i in range(25)), prose(1, 90), prose(1, 90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    done = repeats.remove_repeats(df, together=together).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    same([tuple(r) for r in done.collect()], [(i, *x) for i, x in enumerate(brute_repeats(texts))])


# --- 3


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_library(docs):
    path, library = tokenizer()
    want = []
    for d, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    same(collected(bpe.op3(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


@pytest.mark.parametrize("text", ["<|endoftext|>a<|endoftext|><|endoftext|> b", "a   b \n c \n\n  d", "it's 'll we've　\xa0 x ", "aaaa" * 3000, "日本語 ½ ²³ 12345", "   \x1c x"])
def test_bpe_of_odd_texts(text):
    path, library = tokenizer()
    with open(path, "rb") as f:
        source = f.read()
    merges = bpe.Merges(source)
    words = [t.encode() for t in bpe.PATTERN.findall(text) if len(t) < 40]
    lexicon = bpe.compile_lexicon(dict(zip(words, merges.encode_many(words), strict=True)))
    for codec in (bpe.Codec(source, None), bpe.Codec(source, lexicon)):
        ids = codec.encode_batch([text])[0]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode_batch([ids]) == [text]


def test_bpe_works_on_arrays(spark, monkeypatch):
    """Ids and texts leave the codec as arrays, without an object for each token; a memo that overflows between batches changes nothing."""
    path, library = tokenizer()
    with open(path, "rb") as f:
        source = f.read()
    rnd = random.Random(3)
    words = ["tap", "taps,", "x" * 60, "<|endoftext|>", "", "½²", "\n\n", "日本語.", "it's"]
    texts = [None, "", *("".join(rnd.choice([" ", "  ", ""]) + rnd.choice([*words, f"w{rnd.randint(0, 99)}"]) for _ in range(40)) for _ in range(60))]
    merges = bpe.Merges(source)
    lexicon = bpe.compile_lexicon({w: merges.encode(w) for w in (b" tap", b" taps", b" w")})
    monkeypatch.setattr(bpe, "MEMO", 50)
    codec = bpe.Codec(source, lexicon)
    for a in range(0, len(texts), 8):
        part = texts[a : a + 8]
        ids, cut = codec.encode_flat(part)
        want = [library.encode(x or "", add_special_tokens=False).ids for x in part]
        assert ids.dtype == "int32" and [ids[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)] == want
        assert codec.decode_flat(ids, cut).to_pylist() == [x or "" for x in part]
        codec.trim()
    assert codec.decode_batch([[merges.byte_id[0xE6]], None, want[-1]]) == ["\ufffd", "", texts[-1]]
    n = Counter(w for x in texts for w in (x or "").split(" ") if 0 < len(w) <= bpe.LEXICON_LENGTH)
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    assert [tuple(r) for r in bpe.frequent_pieces(df, most=10).collect()] == sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:10]


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["tap", "taps", "top", "tops", "stop", ""])}
    x = bpe._mapped(bpe.compile_lexicon(words))
    asked = [*words, b"to", b"tapss", b"z"]
    assert x.find(asked) == [*(v for w, v in words.items() if w), *[None] * 4] or [v for w, v in zip(asked, x.find(asked), strict=True) if w in words and w] == [v for w, v in words.items() if w]
    assert x.find([b"to", b"tapss", b"z"]) == [None] * 3
    assert len(x.final) <= 10  # shared suffixes: p and ps are one path


# --- 4


def brute_lines(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and d is not None:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != d)]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def test_repeated_lines(docs):
    same(collected(lines.op4(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256"), brute_lines(pairs(docs)))


def test_filters_suspect_no_larger_share_of_a_larger_corpus(spark):
    """Lines that occur once stay unsuspected, ten times as many as well."""
    for n in (300, 3000):
        df = spark.createDataFrame([(i, "\n".join(f"line {i} {j} of its own, long enough" for j in range(10))) for i in range(n)], "doc_id long, text string").repartition(3)
        assert lines.suspects(df, 20, n * 300).count() < 0.01 * 10 * n


@pytest.mark.parametrize("expected", [0, 1e9])
def test_shared_columns_equal_counts(spark, expected):
    """Words as columns, whatever the number of shards; a word that a text repeats counts each time, and is told once."""
    import numpy as np
    import xxhash

    from tidewheel.llm import incidence

    texts = [*ODD, *(prose(i, 40) for i in range(30)), *(f"only{i} own{i}" for i in range(5))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None)], "id long, text string").repartition(3)

    def columns(batch):
        words = [(t or "").split() for t in batch]
        h = [xxhash.xxh3_64_intdigest(w) for x in words for w in x]
        return np.repeat(np.arange(len(batch)), [len(x) for x in words]), np.array(h, np.uint64), np.array([len(set(x)) for x in words], np.int64)

    bits = incidence.token_bits(expected)
    name = lambda w: int(incidence.tokens_of(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64), bits)[0])
    count = Counter(w for t in texts for w in (t or "").split())
    for percent in (0, 60):
        rows = incidence.shared_columns(df, columns, ["n"], expected, percent).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            words = set((texts[r.id] or "").split()) if r.id or r.n else set()
            own = sorted((incidence.often(count[w]), name(w)) for w in words if count[w] > 1)
            told = list(zip(r.often or (), r.tokens or (), strict=True))
            assert r.n == len(words) and told == (own if own and 100 * len(own) >= percent * r.n else [])


# --- 5


@pytest.mark.parametrize("heads", [{}, {"head_words": 5, "head_grams": 40}])
def test_unigram_scores(docs, heads):
    rows = pairs(docs)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            c.update(tokens(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    unit = math.log10(n + 0.1 * (v + 1))
    got = defaultdict(list)
    for r in scoring.score_documents(docs, **heads).collect():
        got[r.doc_id].append(r)
    for d, t in rows:
        r = next(x for x in got[d] if x.n_tokens == len(tokens(t)) + 1)
        base = sum(math.log10(c[w] + 0.1) - unit for w in tokens(t)) + math.log10(ends + 0.1) - unit
        assert r.train_tokens == n and r.held_out == held(d) and r.n_known == sum(c[w] > 0 for w in tokens(t)) + 1
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))


def brute_tree(train, test):
    """Context-tree weighting with dictionaries: bits of bytes, contexts of 0 to DEPTH bytes."""
    n = defaultdict(lambda: [0, 0])
    for s in train:
        s = bytes(scoring.DEPTH) + s
        for i in range(scoring.DEPTH, len(s)):
            for d in range(scoring.DEPTH + 1):
                for k in range(8):
                    n[s[i - d : i], (1 << k) | (s[i] >> (8 - k))][s[i] >> (7 - k) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, children = {}, defaultdict(float)
    for (c, node), (a, b) in sorted(n.items(), key=lambda x: -len(x[0][0])):
        w = kt(a, b) if len(c) == scoring.DEPTH else math.log(0.5) + math.log(math.exp(kt(a, b) - children[c, node]) + 1) + children[c, node]
        weighted[c, node] = w
        children[c[1:], node] += w
    total = 0.0
    s = bytes(scoring.DEPTH) + test
    for i in range(scoring.DEPTH, len(s)):
        for k in range(8):
            node, bit, p = (1 << k) | (s[i] >> (8 - k)), s[i] >> (7 - k) & 1, None
            for d in range(scoring.DEPTH, -1, -1):
                if (key := (s[i - d : i], node)) in n:
                    own = (n[key][bit] + 0.5) / (sum(n[key]) + 1)
                    stop = 1.0 if p is None else math.exp(min(0, math.log(0.5) + kt(*n[key]) - weighted[key]))
                    p = stop * own + (1 - stop) * (p or 0)
            total += math.log10(0.5 if p is None else p)
    return total


@pytest.mark.parametrize("least", [scoring.LEAST_SHARD, 3])
def test_context_tree(spark, least, monkeypatch):
    monkeypatch.setattr(scoring, "LEAST_SHARD", least)  # 3: nearly all contexts are split
    texts = [prose(i, 12) for i in range(6)] + ["", None, "ünïcode"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in scoring.score_documents(df, held_out=F.col("doc_id") % 3 == 2).collect()}
    train = [(t or "").encode() for i, t in enumerate(texts) if i % 3 != 2]
    for i in (0, 2, 5, 6, 7, 8):
        assert abs(got[i] - brute_tree(train, (texts[i] or "").encode())) < 1e-6


def test_context_tree_shortens_held_out_text(spark):
    df = spark.createDataFrame([(i, prose(i, 300)) for i in range(120)], "doc_id long, text string")
    rows = scoring.score_documents(df).where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.n_bytes for r in rows) * -0.9


# --- 6


def test_classifier_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = classifier.op6(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_discriminant_equals_densities_written_out(docs, spark):
    """Scores from covariances shrunk, inverted and put into log densities one text at a time."""
    import numpy as np

    labels = spark.createDataFrame([(i, i % 2) for i in range(45)], "doc_id long, quality int")
    rows = pairs(docs)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    x = np.array([classifier.statistics([t])[0] for _, t in rows])
    own = {c: x[[i for i, (d, _) in enumerate(rows) if d is not None and d < 45 and not held(d) and d % 2 == c]] for c in (0, 1)}
    both = np.concatenate([own[0], own[1]])
    centre, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-5] = 1
    z = {c: (own[c] - centre) / scale for c in own}
    cov = {c: np.cov(z[c].T, bias=True) for c in z}
    pooled = sum(len(z[c]) * cov[c] for c in z) / len(both)
    want = []
    for (d, _), v in zip(rows, (x - centre) / scale, strict=True):
        log = []
        for c in (0, 1):
            s = 0.95 * (0.9 * cov[c] + 0.1 * pooled) + 0.05 * np.eye(len(v))
            e = v - z[c].mean(axis=0)
            log.append(math.log(len(z[c]) / len(both)) - 0.5 * e @ np.linalg.inv(s) @ e - 0.5 * np.linalg.slogdet(s)[1])
        want.append((d, held(d), 1 / (1 + math.exp(-max(-40, min(40, (log[1] - log[0]) / len(v) ** 0.5))))))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in classifier.op6(docs, labels).select("doc_id", "held_out", "score").collect()), key=order)
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6


def test_kept_documents_are_those_with_a_good_score(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(45)], "doc_id long, quality int")
    good = [r.doc_id for r in classifier.classify(docs, labels).where("score >= 0.5").collect()]
    same([(r.doc_id,) for r in classifier.keep_good(docs, labels).collect()], [(d,) for d in good])


def test_classifier_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.op6(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.op6(docs, one).collect()} == {1.0}


def test_held_out_labels_are_not_learnt(docs, spark):
    rows = [(i, i % 2) for i in range(45)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in rows], "doc_id long, quality int")
    a, b = ({r.doc_id: round(r.score, 9) for r in classifier.op6(docs, x).collect()} for x in (labels, flipped))
    assert a == b


# --- 7


def brute_components(rows, percent=80):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(s), low.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_components_of_links(docs):
    same(collected(jaccard.op7(docs), "doc_id", "n_shingles", "component_id"), brute_components(pairs(docs)))


@pytest.mark.parametrize("block", [64, 3])
def test_chains_and_families(spark, block, monkeypatch):
    """Chains whose ends aren't similar, families around a base, and an unrelated text in each that shares a passage."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    words, rnd = prose(9, 400).split(), random.Random(9)
    texts = [" ".join(words[i : i + 150]) for i in range(0, 200, 12)]
    for f in range(3):
        base = prose(50 + f, 120).split()
        texts += [" ".join(w if rnd.random() > 0.02 * k else "odd" + str(rnd.random()) for w in base) for k in range(9)]
        texts.append(" ".join(base[:40]) + " " + prose(80 + f, 100))
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    same(collected(jaccard.op7(df), "doc_id", "n_shingles", "component_id"), brute_components(pairs(df)))


def test_component_roots(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(55)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    twice = lambda n: n * 2 - 9 * (n > 4)
    return sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_private(t):
    out = []
    for rank, (kind, r) in enumerate(BASE):
        for m in r.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_private_data(spark):
    odd = ["a@b.c_d@e.f. x@y.z.. @ a@", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4", "4111 1111 1111 1111  4111-1111-1111-1111 4111--1111111111111111 9 4111111111111111 -4111111111111111- 0", "+1 (771) 555-1655. +1-2 é😀 a.b@c.de 😀 4390698575873170", "5" * 9000, "a" * 20000 + "@", "1 " * 9000, " ".join(f"u{i}@m.org" for i in range(300))]
    texts = ODD + odd
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in private.op8(df).collect():
        want = brute_private(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in want))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == i for x in want) for i in range(4))
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(r.spans.split(",")) | {""}


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"{prose(i, 6)} my badge number is user{i}@corp.example and {prose(i + 50, 5)}") for i in range(6)]
    rows += [(10 + i, f"{prose(i + 90, 6)} my badge number is ZX-77{i}91 and {prose(i, 4)}") for i in range(3)]
    rows += [(20 + i, f"{prose(i + 300, 9)} lot 88{i}123 stays {prose(i, 4)}") for i in range(5)]
    got = {r.doc_id: r.spans for r in private.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(3):
        text = dict(rows)[10 + i]
        at = text.index("ZX-")
        assert got[10 + i] == f"id:{at}:{at + 8}"
    assert all(got[20 + i] == "" for i in range(5))


def found_ids(spark, seeds, unseen):
    """The text of each found span, for the texts of `unseen`."""
    rows = list(enumerate(seeds + unseen))
    got = {r.doc_id: r.spans for r in private.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = lambda t, s: t[int(s.split(":")[1]) : int(s.split(":")[2])]
    return [[cut(t, s) for s in got[i].split(",") if s.startswith("id:")] for i, t in rows if t in unseen]


def test_keys_are_seeds_and_teach_patterns(spark):
    key = lambda i: sha(str(i))[:40]
    seeds = [f"{prose(i, 6)} token = \"{key(i)}\" {prose(i + 50, 5)}" for i in range(6)]
    unseen = [f"{prose(90, 6)} token = \"QX-44192-zz\" {prose(4, 4)}", key(77), f"{prose(91, 4)} " + "long" * 30 + f" {key(78)} ends"]
    assert found_ids(spark, seeds, unseen) == [["QX-44192-zz"], [key(77)], [key(78)]]


def test_spans_of_several_words_seed_the_bootstrap(spark):
    phones = [f"{prose(i, 6)} reach me at +1 (771) 555-16{i}5 any time {prose(i + 50, 5)}" for i in range(6)]
    assert found_ids(spark, phones, [f"{prose(90, 6)} reach me at QX-44192 any time {prose(4, 4)}"]) == [["QX-44192"]]
    cards = [f"{prose(i, 6)} charge it to {c} please {prose(i + 50, 5)}" for i, c in enumerate(("4111 1111 1111 1111", "5555 5555 5555 4444", "5105 1051 0510 5100", "4012 8888 8888 1881"))]
    assert found_ids(spark, cards, [f"{prose(90, 6)} charge it to QX-44192 please {prose(4, 4)}"]) == [["QX-44192"]]


def test_grouped_long_and_numbered_identifiers_are_found(spark):
    seeds = [f"{prose(i, 6)} my badge number is user{i}@corp.example and {prose(i + 50, 5)}" for i in range(9)]
    wanted = ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "K9" + "a1b2c3d4" * 12, "123 45 6789"]
    assert found_ids(spark, seeds, [f"{prose(i + 90, 6)} my badge number is {w} and {prose(i, 4)}" for i, w in enumerate(wanted)]) == [[w] for w in wanted]
    seeds = [f"{prose(i, 6)} in room 12 user{i}@corp.example sits {prose(i + 50, 5)}" for i in range(6)]
    assert found_ids(spark, seeds, [f"{prose(90, 6)} in room 12 QX-44192 sits {prose(4, 4)}"]) == [["QX-44192"]]


# --- 9


def test_leaks_in_any_order(spark):
    item = prose(7, 40).split()
    rows = [(1, prose(1, 60) + " " + " ".join(item) + " " + prose(2, 30)), (2, " ".join(item[20:]) + " x y z " + " ".join(item[:20]).upper()), (3, " ".join(item[:12]) + " " + prose(3, 90)), (4, prose(4, 100)), (5, None), (6, ""), (None, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None)], "item_id long, text string")
    for most in (leaks.BROADCAST_CHARS, 0):
        found = leaks.find_leaks(docs, items, broadcast_chars=most)
        same([(r.doc_id, r.item_id) for r in found.collect()], [(1, 0), (2, 0), (None, 0)])
        assert sorted(r.doc_id for r in leaks.decontaminate(docs, items, broadcast_chars=most).collect()) == [3, 4, 5, 6]
    assert leaks.find_leaks(docs, items.where("false")).count() == 0


def brute_tiles(item, doc, match):
    """Greedy string tiling as first published: scan for the longest unmarked matches, mark, repeat."""
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = 0
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not mi[i + k] and not md[j + k]:
                    k += 1
                best = max(best, k)
        if best < match:
            return sum(out)
        for j in range(len(doc)):
            for i in range(len(item)):
                if i + best <= len(item) and j + best <= len(doc) and item[i : i + best] == doc[j : j + best] and not any(mi[i : i + best]) and not any(md[j : j + best]):
                    mi[i : i + best] = md[j : j + best] = [True] * best
                    out.append(best)


def test_tiles_equal_the_greedy_definition():
    import numpy as np

    rnd = random.Random(4)
    for _ in range(60):
        item, doc = [rnd.randint(0, 3) for _ in range(rnd.randint(3, 25))], [rnd.randint(0, 3) for _ in range(rnd.randint(3, 40))]
        seeds = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if item[i : i + 3] == doc[j : j + 3]]
        got = leaks.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), seeds, 3)
        assert sum(n for *_, n in got) == brute_tiles(item, doc, 3)


def test_tiles_of_equal_words_stay_small():
    import numpy as np

    words = np.zeros(20_000, np.uint64)
    own = [(j, np.arange(196)) for j in range(19_996)]
    runs = leaks.maximal(own, 5)
    assert len(runs[0]) < 20_300
    assert leaks.greedy(200, len(words), runs, 5) == [(0, 0, 200)]


def test_broadcast_and_joined_items_find_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    a, b = (collected(leaks.find_leaks(docs, items, broadcast_chars=most), "doc_id", "item_id", "coverage", "tiles") for most in (leaks.BROADCAST_CHARS, 0))
    assert a and a == b


# --- 10


def test_licences(spark):
    texts = [*ODD, "Released under the MIT License.", "the mit-license; MIT\nLicense and Apache License", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licence of émit license", "Copyright 2020 Foo Bar. All rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = {r.doc_id: r for r in licences.op10(df).collect()}
    for i, t in enumerate(texts):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    n = len(ODD)
    assert [rows[n + i].labels for i in (0, 2, 3, 4, 5, 6)] == ["mit", "apache", "gpl", "cc-by-nc", "", "proprietary"]


def filled(markup):
    """A text that a markup accepts: optional regions left out at first, words put in for {n}."""
    while "[[" in markup:
        markup = re.sub(r"\[\[[^\[\]]*\]\]", "", markup)
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["anyone"] * int(m[1])), markup)


def test_whole_licences_notices_and_denials():
    for label, ts in licences.TEMPLATES.items():
        for kind, markup in ts:
            text = "Some words first. " + filled(markup).upper() + " and more."
            labels, score = (licences.scan([text])[k][0] for k in (5, 6))
            assert label in labels.split(",") and score >= licences.SCORES[kind]
    mit = filled(licences.TEMPLATES["mit"][0][1])
    altered = mit.replace("without warranty of any kind", "with every warranty")
    assert [licences.scan([t])[6][0] for t in (mit, altered, "This is not licensed under the MIT License.")] == [1.0, 0.7, 0.5]
    assert licences.scan(["No longer released under the MIT license; all rights reserved"])[5] == ["mit,proprietary"]


def test_template_markup():
    m = licences.Matcher({"x": ["a [[b [[c]]]] d {2} e"]})
    for text, good in (("a d e", True), ("a b d e", True), ("a b c d q r e", True), ("a c d e", False), ("a d q r s e", False), ("a b c", False)):
        assert bool(m.spans(text.split())) == good


# --- all


@pytest.mark.parametrize("clash", [False, True])
def test_empty_tables_and_extra_columns(spark, clash):
    names = ["n_words", "kept", "ids", "decoded", "n_lines", "N_DROPPED", "score", "spans", "features", "labels", "rid", "uid", "c", "n", "tokens"] if clash else ["lang"]
    empty = spark.createDataFrame([], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    full = spark.createDataFrame([(1, "some text of a few words here", *["v"] * len(names))] * 2, empty.schema)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    path, _ = tokenizer()
    for docs, n in ((empty, 0), (full, 2)):
        coder = bpe.BytePairCoder(path).fit(docs)
        results = [quality.judge(docs), quality.op1(docs), repeats.remove_repeats(docs), repeats.op2(docs), coder.decode(coder.encode(docs)), bpe.op3(docs, path), lines.dedup_lines(docs), lines.op4(docs), scoring.op5(docs), classifier.op6(docs, labels), classifier.keep_good(docs, labels), jaccard.op7(docs), jaccard.keep_one(docs), private.op8(docs), leaks.decontaminate(docs, items), licences.scan_licences(docs), licences.op10(docs)]
        for df in results:
            assert len(df.collect()) == n, df.columns
        assert leaks.op9(docs, items).count() == 0
