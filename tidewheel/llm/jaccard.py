"""N-gram Jaccard join: a blocked sparse matrix product of documents by word shingles.

Columns that only one document has can't add to an overlap, and a document needs at least
the threshold's share of its shingles in shared columns; both bounds leave a small matrix,
whose columns were counted shard by shard (`incidence`).
Its rare columns propose pairs, whose overlap counts are accumulated block of columns by
block, and a pair goes as soon as what is left can't reach the bound its sizes set. Equal
sets are one row. Links to the most central rows come first; only rows that these don't
join are compared with whole components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.blocks import Words, mix
from tidewheel.llm.common import prepare, stored, tidy
from tidewheel.llm.components import components
from tidewheel.llm.incidence import shared_columns

#: Words of a shingle and least similarity in percent; blocks of columns of one product.
WORDS, PERCENT, BLOCKS = 5, 80, 4
#: Rows of a block where components are compared.
BLOCK = 64


def shingle_sets(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every distinct shingle, sorted by both. Fewer than k words: the whole sequence; none: nothing."""
    words = Words(texts, lower=True)
    at, h = words.windows(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    own = [mix(np.array([hash_of(words.hash[words.first[i] : words.first[i + 1]])], np.uint64))[0] for i in short]
    doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(own, np.uint64)])
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def hash_of(words: np.ndarray) -> int:
    x = len(words)
    for w in words.tolist():
        x = (x * 0xD6E8FEB86659FD93 + w + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF
    return x


def sets(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """rid, doc_id, n (shingles), s1, s2 (sums that tell sets apart), and, where enough of them occur elsewhere too, those shingles as `tokens`, rarest first, and how `often`."""

    def columns(texts: list[str | None]) -> tuple[np.ndarray, ...]:
        doc, h = shingle_sets(texts, k)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        total, mixed = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (h, mix(h)))
        return doc, h, np.diff(cut), *((x[cut[1:]] - x[cut[:-1]]).view(np.int64) for x in (total, mixed))

    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    found = shared_columns(docs.select(F.col("doc_id").alias("id"), "text"), columns, ["n", "s1", "s2"], size / 6, percent)
    return stored(found.withColumnRenamed("id", "doc_id").withColumn("rid", F.monotonically_increasing_id()), "sets")


def products(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: overlaps accumulate over blocks of columns, hopeless pairs go after each."""
    side = lambda x: rows.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            need = -(-percent * (na + nb) // (100 + percent))
            left = []
            for c in ("ta", "tb"):
                column = batch.column(c)
                sizes = np.diff(column.offsets.to_numpy())
                left.append((np.repeat(np.arange(len(na)), sizes), column.flatten().to_numpy().view(np.uint64)))
            rest = np.minimum(*(np.bincount(p, minlength=len(na)) for p, _ in left))
            block = [t % np.uint64(BLOCKS) for _, t in left]
            overlap, alive = np.zeros(len(na), np.int64), rest >= need
            seen = [np.zeros(len(na), np.int64) for _ in left]
            sizes = [np.bincount(p, minlength=len(na)) for p, _ in left]
            for k in range(BLOCKS):
                parts = []
                for s, ((p, t), own) in enumerate(zip(left, block, strict=True)):
                    take = (own == k) & alive[p]
                    seen[s] += np.bincount(p[take], minlength=len(na))
                    parts.append((p[take], t[take]))
                p, t = (np.concatenate([parts[0][i], parts[1][i]]) for i in (0, 1))
                by = np.lexsort((t, p))
                p, t = p[by], t[by]
                both = (p[1:] == p[:-1]) & (t[1:] == t[:-1])
                overlap += np.bincount(p[1:][both], minlength=len(na))
                alive &= overlap + np.minimum(sizes[0] - seen[0], sizes[1] - seen[1]) >= need
            good = np.flatnonzero(alive & (100 * overlap >= percent * (na + nb - overlap)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    return full.mapInArrow(tidy(run), "a long, b long")


def block_products(couples: DataFrame, member: DataFrame, sizes: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows of each component `root` to the component `other` it is coupled with, one at most per row and block.

    Sizes bound which rows can link at all; those that meet one component stand in blocks of about BLOCK rows, and so do its own
    rows; a task multiplies two blocks. So no pair of rows is ever a row of a table.
    """
    cells = F.struct("c", "n", "tokens")
    rows = matrix.select("c", "n", "tokens")
    fits = (F.col("n") <= F.col("o_most")) & (F.col("o_least") <= F.col("most")) & (percent * F.col("n") <= 100 * F.col("o_largest")) & (percent * F.col("o_least") <= 100 * F.col("n"))
    asking = couples.join(member.select("root", "c", "n", "most"), "root").where(fits).select(F.col("other").alias("root"), "c").distinct()
    counts = stored(asking.groupBy("root").agg(F.count("*").alias("asks")), "asks")
    parts = lambda n: F.call_function("div", n + BLOCK - 1, F.lit(BLOCK))
    place = lambda n: F.pmod(F.xxhash64("c"), parts(F.col(n)))
    left = asking.join(counts, "root").withColumn("lb", place("asks")).join(rows, "c").groupBy("root", "lb").agg(F.collect_list(cells).alias("left"))
    right = member.select("root", "c").join(counts, "root", "left_semi").join(sizes.select("root", "size"), "root").withColumn("rb", place("size")).join(rows, "c").groupBy("root", "rb").agg(F.collect_list(cells).alias("right"))
    both = stored(left, "left").join(stored(right, "right"), "root").select("left", "right")

    def side(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for block in column:
            own = block.values
            tokens = own.field("tokens")
            out.append((own.field("c").to_numpy(), own.field("n").to_numpy(), np.repeat(np.arange(len(own)), np.diff(tokens.offsets.to_numpy())), tokens.flatten().to_numpy()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for (ca, na, pa_, ta), (cb, nb, pb, tb) in zip(side(batch.column("left")), side(batch.column("right")), strict=True):
                fits = percent * np.maximum.outer(na, nb) <= 100 * np.minimum.outer(na, nb)
                overlap = np.zeros((len(na), len(nb)), np.float32)
                shared = np.intersect1d(ta, tb)
                for columns in np.array_split(shared, -(-len(shared) // 4096)) if len(shared) else ():
                    dense = []
                    for p, t, n in ((pa_, ta, len(na)), (pb, tb, len(nb))):
                        j = np.minimum(np.searchsorted(columns, t), len(columns) - 1)
                        hit = columns[j] == t
                        x = np.zeros((n, len(columns)), np.float32)
                        x[p[hit], j[hit]] = 1
                        dense.append(x)
                    overlap += dense[0] @ dense[1].T
                o = overlap.astype(np.int64)
                good = fits & (100 * o >= percent * (np.add.outer(na, nb) - o))
                found = np.flatnonzero(good.any(axis=1))
                a += ca[found].tolist()
                b += cb[good[found].argmax(axis=1)].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long")


def similar_classes(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, roots): rows of `sets`; classes of equal sets (s1, s2, n, c, low); (node, root) for classes that links join."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = sets(docs, percent, k)
    near = rows.where(F.col("tokens").isNotNull())
    classes = stored(near.groupBy("s1", "s2", "n").agg(F.min("rid").alias("c"), F.min("doc_id").alias("low")), "classes")
    reps = near.select(F.col("rid").alias("c"), "n", "tokens", "often").join(classes.select("c"), "c", "left_semi")
    m = F.size("tokens")
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - (F.col("n") - m)
    centre = F.aggregate("often", F.lit(0).cast("long"), lambda s, x: s + x) / F.col("n")
    matrix = stored(reps.select("c", "n", "tokens", F.slice("tokens", F.lit(1), length.cast("int")).alias("prefix"), centre.alias("centre")), "matrix")
    rare = stored(matrix.select("c", "n", "centre", F.size("tokens").alias("m"), F.posexplode("prefix").alias("place", "token")), "prefixes")
    leaders = stored(rare.groupBy("token").agg(F.max_by("c", F.struct("centre", -F.col("c"))).alias("l1"), F.min("c").alias("l2"), F.count("*").alias("k")).where("k > 1"), "leaders")
    first = rare.select("token", "c").join(leaders, "token").select(F.col("c"), F.explode(F.array_distinct(F.array("l1", "l2"))).alias("l")).where("c != l")
    pairs = stored(first.select(F.least("c", "l").alias("a"), F.greatest("c", "l").alias("b")).distinct(), "pairs")
    links = stored(products(pairs, matrix, percent), "links")
    joined = components(links)
    # what the leaders left apart: rows of the smaller component against the whole of the other, where both share a rare column
    most = F.floor((100 + percent) * F.size("tokens") / percent).cast("long") - F.col("n")  # shingles of the largest partner that a row's shared columns allow
    member = stored(matrix.select("c", "n", most.alias("most")).join(joined.withColumnRenamed("node", "c"), "c", "left").select("c", "n", "most", F.coalesce("root", "c").alias("root")), "members")
    # of the first rare column that two rows share, neither shares one before it, which bounds the overlap there
    beyond = F.floor((100 + percent) * (F.col("m") - F.col("place")) / percent).cast("long") - F.col("n")
    bounds = (F.min("n").alias("least"), F.max("n").alias("largest"), F.max("beyond").alias("most"))
    bins = stored(rare.select("token", "c", "n", beyond.alias("beyond")).join(member.select("c", "root"), "c").groupBy("token", "root").agg(*bounds), "bins")
    apart = bins.groupBy("token").agg(F.count("*").alias("roots")).where("roots > 1").select("token")
    sizes = stored(member.groupBy("root").agg(F.count("*").alias("size"), F.min("n").alias("r_least"), F.max("n").alias("r_largest"), F.max("most").alias("r_most")), "sizes")
    some = stored(bins.join(apart, "token", "left_semi").join(sizes, "root"), "apart")
    other = some.select("token", *(F.col(c).alias(f"o_{c}") for c in ("root", "size", "least", "largest", "most", "r_least", "r_largest", "r_most")))
    order = F.struct("size", "root") < F.struct("o_size", "o_root")
    fits = (F.col("least") <= F.col("o_most")) & (F.col("o_least") <= F.col("most")) & (percent * F.col("least") <= 100 * F.col("o_largest")) & (percent * F.col("o_least") <= 100 * F.col("largest"))
    couples = some.join(other, "token").where(order & fits).select("root", F.col("o_root").alias("other"), *(F.col(f"o_r_{c}").alias(f"o_{c}") for c in ("least", "largest", "most"))).distinct()
    more = stored(block_products(stored(couples, "couples"), member, sizes, matrix, percent), "links")
    if more.isEmpty():
        roots = joined
    else:  # only roots are linked anew
        top = member.select("c", "root")
        ends = more.join(top.withColumnRenamed("c", "a"), "a").select("b", F.col("root").alias("ra")).join(top.withColumnRenamed("c", "b"), "b").select(F.col("ra").alias("a"), F.col("root").alias("b"))
        upper = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = top.join(upper, "root", "left").select(F.col("c").alias("node"), F.coalesce("top", "root").alias("root"))
    return rows, classes, roots


def components_of(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, the least doc_id reachable by links.

    Rows link when percent * union <= 100 * intersection of their shingle sets; rows with
    equal sets do too. A text without words (null, empty) links with nothing and has its own
    doc_id. Repeated rows stay. Null doc_ids are passed over for the least one, unless a
    component has no other.
    """
    rows, classes, roots = similar_classes(docs, percent, k)
    low = classes.select("c", "low").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "low", F.coalesce("root", "c").alias("root"))
    least = stored(low.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    named = stored(classes.select("s1", "s2", "n", "c").join(low.select("c", "root"), "c").join(least, "root").select("s1", "s2", "n", "component_id"), "named")
    return rows.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its component; all columns stay. Of repeated rows with one doc_id all stay; a row with a null doc_id stays if it stands alone."""
    named = components_of(docs, percent, k)
    gone = named.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti")


def op7(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return components_of(docs)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.node = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
