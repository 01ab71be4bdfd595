"""Each stage of the pipeline against a plain version, on odd rows and on a very long text, and nothing at all."""

import collections
import random

import corpus_pipeline
import numpy as np
import pytest
from conftest import SCHEMA, edge_rows, sentence
from netweave.llm import packing, quality
from netweave.llm.mixing import WORD
from netweave.llm.tokens import default_path, encoder
from pyspark.sql import functions as F
from test_documents import classes, deduped, mixed

CLASHES = {"source_size": "x", "n_removed": "y", "PREDICTED": "p", "taken": "k", "__part": "o", "__h1": "h", "__gone": "g", "__words": "w"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and its rows: odd ones, plain ones with labels, and one of more than ten million characters."""
    rng = random.Random(77)
    rows = edge_rows()
    for i in range(200):
        words = [f"{'fine' if i % 2 else 'junk'}{rng.randrange(300)}" for _ in range(60)]
        rows.append((1000 + i, " ".join(words), f"s{i % 3}", "en", 1, 1, "q", 2, 3, "z", "k", "s"))
    vocabulary = [sentence(rng, 1) for _ in range(5000)]
    long = "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(130_000))
    assert len(long) > 10_000_000 / 2
    rows.append((2000, long + "\n" + "fine1 fine2 " * 500_000, "s1", "en", 5, 1, "q", 2, 3, "z", "k", "s"))
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHES.items()})
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (8, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def through(spark, corpus, name, rows):
    """The rows that a stage gives, without the columns that clash, whose values must have stayed."""
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHES.items()})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.repartition(2), corpus[0])
    assert out.columns == docs.columns
    made = out.collect()
    assert all(r[c] == v for r in made for c, v in CLASHES.items())
    return [tuple(r)[: len(rows[0])] for r in made]


def test_quality_keeps_rows_that_score_one_half(spark, corpus):
    path, rows = corpus
    got = collections.Counter(through(spark, corpus, "quality", rows))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = quality.fit_quality(docs, spark.read.parquet(f"{path}/labels.parquet"))
    weights, bias = model.weights.astype(float), model.bias

    def score(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        bag = quality.features(data, np.array([0, len(data)]))[0]
        return bias + sum(weights[b] for b in bag.tolist()) / (len(bag) + quality.PADDING)

    sure = [r for r in rows if len(r[1] or "") < 100_000 and abs(score(r[1])) > 1e-4]
    assert all((got[r] > 0) == (score(r[1]) > 0) for r in sure)
    assert sum(got[r] for r in rows[-201:-1] if r[0] % 2) > 95 and sum(got[r] for r in rows[-201:-1] if r[0] % 2 == 0) < 5
    assert not got - collections.Counter(rows) and any(r[0] == 2000 for r in got)


def test_line_dedup_is_the_plain_one(spark, corpus):
    rows = corpus[1][:-1]
    want = collections.Counter()
    for r, (_, left, n_lines, n_removed) in zip(rows, deduped(rows), strict=True):
        if not n_removed:
            want[r] += 1
        elif n_removed < n_lines:
            want[(r[0], left, *r[2:4], len(left), *r[5:])] += 1
    assert collections.Counter(through(spark, corpus, "line_dedup", rows)) == want
    long = corpus[1][-1]
    assert [r for r in through(spark, corpus, "line_dedup", [long, rows[0]]) if r[0] == 2000] == [long]


def test_near_dedup_keeps_one_of_each_class(spark, corpus):
    rows = corpus[1][:-1]
    got = collections.Counter(through(spark, corpus, "near_dedup", rows))
    for members in classes(rows).values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        best = {rows[i] for i in members if rows[i][0] == (min(ids) if ids else None)}
        assert sum(got[r] > 0 for r in {rows[i] for i in members}) == 1 and any(got[r] for r in best)
    assert sum(got.values()) == len(classes(rows))


def test_mix_takes_each_source_s_words(spark, corpus):
    rows = corpus[1]
    _, _, target = mixed(rows, None)
    import re

    out = through(spark, corpus, "mix", rows)
    taken = collections.Counter()
    for r in out:
        taken[r[2]] += len(re.findall(WORD, r[1]))
    assert all(taken[s] == int(t + 1e-9) for s, t in target.items())
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    assert all(r[0] is None or texts[r[0]].startswith(r[1]) for r in out)
    assert all(r[4] == len(r[1]) for r in out if r[0] is not None and r[1] != texts[r[0]])


def test_pack_lays_each_id_once(spark, corpus):
    rows = corpus[1]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").withColumn("offset", F.lit("clash"))
    packed = corpus_pipeline.pack(spark, docs, corpus[0])
    got = collections.Counter()
    for r in packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["n"]
    enc = encoder(default_path())
    want = collections.Counter()
    for r in rows:
        n = len(enc.encode(r[1] or "")) + 1
        want[r[0], n] += n
    assert got == want
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.WINDOW}").isEmpty()


def test_nothing_goes_through_all_stages(spark, corpus, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus[0])
        assert out.count() == 0
        docs = docs if name == "pack" else out.select(*docs.columns)


def test_run_is_the_stages_in_turn(spark, corpus):
    packed = corpus_pipeline.run(spark, corpus[0])
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert rows and all(r["first"] == 0 and r["end"] == r["n"] <= packing.WINDOW for r in rows)
    assert packed.where("doc_id = 2000").select(F.sum("length")).first()[0] > 1_000_000
