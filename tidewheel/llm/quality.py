"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.blocks import Words, mix
from tidewheel.llm.common import map_texts, prepare

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: Texts of the sample from which costs and selectivities are estimated, and code points that the sampled texts have at most.
SAMPLE, SAMPLED = 400, 1 << 14


def sums(words: Words, mask: np.ndarray) -> np.ndarray:
    """Bytes per text for which the mask is true."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[words.begin[1:]] - total[words.begin[:-1]]


def letters(words: Words) -> np.ndarray:
    """Code points in words, per text."""
    inword = np.zeros(len(words.bytes) + 1, np.int8)
    inword[words.start] += 1
    inword[words.end] -= 1
    return sums(words, (np.cumsum(inword[:-1], dtype=np.int8) > 0) & (words.bytes & 0xC0 != 0x80))


def repeat_words(words: Words, k: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of k words found twice or more in it."""
    at, h = words.windows(k)
    h = mix(h ^ (words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(words.counts), np.int64)
    j = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    hit = at[twice[j] == h]
    step = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier one, per text."""
    all_, dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        lines = [y for y in (x or "").encode().split(b"\n") if y.strip()]
        all_[i] = len(lines)
        dup[i] = len(lines) - len(set(lines))
    return all_, dup


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    words = Words(texts, lower=False)
    n, repeated = words.counts, repeat_words(words)
    return {
        "n_words": n,
        "word_chars": letters(words),
        "n_symbols": sums(words, _SYMBOL[words.bytes]),
        "n_dup_lines": lines_of(texts)[1],
        "n_repeat_words": repeated,
        "base_failed": (n < 10) | (100 * repeated > 20 * n),
    }


@dataclass(frozen=True)
class Rule:
    """`rejects(texts)` gives a boolean per text; it must depend on that text alone."""

    name: str
    rejects: Callable[[list[str | None]], np.ndarray]


def _count(texts: list[str | None], chars: str) -> np.ndarray:
    return np.array([sum(x.count(c) for c in chars) if x else 0 for x in texts], np.int64)


def _words(texts: list[str | None]) -> np.ndarray:
    return np.array([len(x.encode().split()) if x else 0 for x in texts], np.int64)


def _upper(texts: list[str | None]) -> np.ndarray:
    out = b"".join(bytes([i]) for i in range(256) if not 65 <= i <= 90)
    return np.array([len(x.encode().translate(None, out)) if x else 0 for x in texts], np.int64)


def _length(texts: list[str | None]) -> np.ndarray:
    words = Words(texts, lower=False)
    return (letters(words) < 2 * words.counts) | (letters(words) > 20 * words.counts)


def _dup(texts: list[str | None]) -> np.ndarray:
    n, dup = lines_of(texts)
    return 2 * dup > n


def _upper_heavy(texts: list[str | None]) -> np.ndarray:
    return 10 * _upper(texts) > 4 * letters(Words(texts, lower=False))


#: Rules after published web-text heuristics, with thresholds that ordinary prose keeps clear of.
RULES = [
    Rule("symbols", lambda x: 10 * _count(x, SYMBOLS) > _words(x)),
    Rule("exclaiming", lambda x: 2 * _count(x, "!") > _words(x)),
    Rule("shouting", _upper_heavy),
    Rule("word_length", _length),
    Rule("repeated_lines", _dup),
]


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Time each rule on a bounded sample (at most twice `sample` texts of at most SAMPLED code points) and order by rejections per second.

    The order changes the work alone, never the verdict. Of an empty table, the order stays;
    of equal gains, too.
    """
    n = docs.count()
    if not n:
        return list(rules)
    share = min(1 << 30, -(-(sample << 30) // n))
    texts = [r[0] for r in docs.select(text).where((F.pmod(F.xxhash64(text), F.lit(1 << 30)) < share) & (F.length(text) <= SAMPLED)).limit(2 * sample).toLocalIterator()]
    if not texts:
        return list(rules)

    def gain(rule: Rule) -> float:
        t = time.thread_time()
        rejected = int(np.count_nonzero(rule.rejects(texts)))
        return (rejected + 0.5) / max(time.thread_time() - t, 1e-6)

    return sorted(rules, key=gain, reverse=True)


def cascade(texts: list[str | None], rules: list[Rule]) -> list[str | None]:
    """Name of the first rule that rejects each text, None if all let it pass; a rule sees only what is left."""
    out: list[str | None] = [None] * len(texts)
    left = list(range(len(texts)))
    for rule in rules:
        if not left:
            break
        rejected = rule.rejects([texts[i] for i in left])
        for i, r in zip(left, rejected, strict=True):
            if r:
                out[i] = rule.name
        left = [i for i, r in zip(left, rejected, strict=True) if not r]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """Add the base counts, base_failed, failed_rule (of the cascade) and kept to each row.

    A null or empty text has no words and fails the base; texts of any length are judged
    whole. Other columns and repeated rows stay; columns named as an added one are replaced. `rules` None: ordered on a sample.
    """
    prepare(docs.sparkSession)
    rules = order_rules(docs, RULES, text) if rules is None else rules

    def columns(texts: list[str | None]) -> list:
        base = base_counts(texts)
        failed: list[str | None] = [None] * len(texts)
        left = np.flatnonzero(~base["base_failed"]).tolist()
        for i, name in zip(left, cascade([texts[i] for i in left], rules), strict=True):
            failed[i] = name
        kept = [not b and f is None for b, f in zip(base["base_failed"].tolist(), failed, strict=True)]
        return [*(base[c] for c in COUNTS), base["base_failed"], failed, kept]

    added = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("failed_rule", T.StringType()), T.StructField("kept", T.BooleanType())]
    return map_texts(docs, text, added, columns)


def op1(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the five counts, base_failed, kept."""
    return judge(docs.select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines
  FROM documents
), p AS (
  SELECT r, i, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), g AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM p) WHERE c > 1
), c AS (
  SELECT r, count(DISTINCT i + j) AS n FROM g, (SELECT unnest(range(0, 5)) AS j) GROUP BY r
), s AS (
  SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim
  FROM d LEFT JOIN c ON d.r = c.r
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_exclaim <= n_words AND 10 * n_upper <= 4 * word_chars
    AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 2 * n_dup_lines <= n_lines AS kept
FROM b
"""
