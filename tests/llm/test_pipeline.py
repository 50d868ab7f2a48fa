"""Every stage of the pipeline, and the whole of it, against brute force on a small fixture with odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import ODD, brute_components, brute_lines, brute_tiles, prose, same, tokenizer
from tidewheel.llm import classifier

LINE = "A line that several documents repeat word for word."
ITEM = prose(70, 40)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = [prose(i, 60) for i in range(12)]
    near = [" ".join([*base[0].split()[:-1], f"other{i}"]) for i in range(3)]
    leaking = [prose(30, 20) + " " + " ".join(ITEM.split()[20:] + ["x"] + ITEM.split()[:20])]
    junk = [" ".join(f"{w}#{i}" for w in prose(40 + i, 20).split()) for i in range(6)]
    texts = [*ODD, *base, *near, *(f"{LINE}\n{prose(50 + i, 25)}\n{LINE.upper()}" for i in range(4)), *leaking, *junk, prose(60, 500_000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, None), (None, base[5], "de", "s", 1, 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid long").drop("rid").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(len(t or "") > 40 and "#" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, "short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "bpe_codec"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_classifier"](spark, docs, sf_dir)
    good = classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("score >= 0.5")
    same([(r.doc_id,) for r in kept.collect()], [(r.doc_id,) for r in good.collect()])
    assert kept.columns == docs.columns

    lined = stages["line_dedup"](spark, docs, sf_dir)  # all rows, odd ones among them
    want = {d: h for d, _, _, h in brute_lines(rows_of(docs))}
    same([tuple(r) for r in lined.select("doc_id", F.sha2(F.col("text").cast("binary"), 256)).distinct().collect()], list(want.items()))
    assert lined.columns == docs.columns and all(r.n_chars == len(r.text) for r in lined.collect())

    alone = stages["jaccard_join"](spark, docs, sf_dir)
    want = [(d,) for d, _, c in brute_components([(d, t) for d, t in rows_of(docs) if len(t or "") < 1 << 20]) if d == c]
    same([(r.doc_id,) for r in alone.where("text is null or length(text) < 1048576").collect()], want)
    assert alone.where("length(text) >= 1048576").count() == 1 and alone.columns == docs.columns

    clean = stages["decontamination"](spark, docs, sf_dir)
    item = ITEM.split()
    leaks = {d for d, t in rows_of(docs) if len(t or "") < 3000 and brute_tiles(item, (t or "").lower().split(), 5) >= 0.6 * len(item)}
    assert len(leaks) == 1
    same([(r.doc_id,) for r in clean.collect()], [(d,) for d, _ in rows_of(docs) if d not in leaks])
    assert clean.columns == docs.columns

    coded = stages["bpe_codec"](spark, docs, sf_dir)
    _, library = tokenizer()
    want = []
    for d, t in rows_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), str(ids), library.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, r.n_tokens, str(r.ids), r.text) for r in coded.collect()], want)


def test_run_is_all_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    same([tuple(map(str, r)) for r in corpus_pipeline.run(spark, sf_dir).collect()], [tuple(map(str, r)) for r in docs.collect()])


def test_stages_of_empty_tables_and_clashing_columns(spark, sf_dir):
    odd = "doc_id long, text string, lang string, source string, n_chars long, score string, `__score` string, tokens string, n_lines long, `__id` string, c long"
    empty = spark.createDataFrame([], odd)
    one = spark.createDataFrame([(1, prose(1, 30), "en", "s", 1, "v", "v", "v", 7, "v", 3)] * 2, odd)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        found = stage(spark, one, sf_dir).collect()
        assert len(found) in ((0, 2) if name == "quality_classifier" else (2,)), name
