"""The operators on embeddings and pages, and the pipeline, against brute force."""

import collections
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.llm import ann, embedding_dedup, warc
from netweave.plans.session import scratch_path

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, v string, rep int"


def vectors(seed, n, dim, groups=()):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    at = 0
    for size, noise in groups:
        x[at : at + size] = x[at] + noise * rng.standard_normal((size, dim)).astype(np.float32)
        at += size
    return x


def table(spark, x, extra=(), ids=None):
    rows = [(int(i), [float(c) for c in v], 0, 1, "v", 2) for i, v in zip(ids or range(len(x)), x, strict=True)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)


def odd(dim):
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0] * dim, [None] + [1.0] * (dim - 1), [nan] + [1.0] * (dim - 1), [inf] + [1.0] * (dim - 1), [], [1.0] * (dim + 1)]
    return [(1000 + 20 * i, v, None, None, None, None) for i, v in enumerate(bad)] + [(None, [1.0] * dim, None, None, None, None)]


@pytest.mark.parametrize("dim, rows", [(64, 16_384), (7, 100), (1100, 64)])
def test_nearest_neighbours(spark, monkeypatch, dim, rows):
    monkeypatch.setattr(ann, "block_rows", lambda dim: rows)
    x = vectors(1, 260, dim)
    x[100:140] = x[100]  # ties
    x[200:205] *= 1e-20
    # repeated rows, and another vector under an id that is taken
    ids = [*range(260), 3, 20, 20, 40]
    x = np.concatenate([x, x[[3, 20, 20]], x[41:42]])
    df = table(spark, x, odd(dim), ids)
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y, want = x.astype(np.float64), collections.defaultdict(list)
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            score = np.zeros(len(ids))
            for j in range(dim):
                score += y[q, j] * y[:, j]
            best = [c for c in np.lexsort((ids, -score)) if c != q][:20]
            want[ids[q]] += [(n, ids[c], score[c]) for n, c in enumerate(best, 1)]
    assert {q: sorted(found) for q, found in got.items()} == {q: sorted(found) for q, found in want.items()}
    assert len(want[20]) == 60 and len(want[40]) == 40


def test_few_candidates_and_none(spark):
    df = table(spark, vectors(2, 3, 8))
    got = ann.nearest_neighbours(df, df.where("vec_id = 0")).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest_neighbours(none, none).count() == 0 and ann.nearest_neighbours(df, none).count() == 0


@pytest.mark.parametrize("cell", [4096, 40])
def test_near_duplicate_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "GUESTS", 64 if cell < 4096 else 1024)
    dim = 48
    x = vectors(3, 400, dim, [(60, 0.2), (60, 0.45), (20, 0.0)])
    x[300:310] = 2.5 * x[299]
    # a repeated row, and ids that stand for several vectors
    ids = [*range(400), 5, 310, 7]
    x = np.concatenate([x, x[[5, 0]], x[399:400]])
    df = table(spark, x, odd(dim), ids)
    got = collections.Counter(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(ids)).min(1))
        if (new == label).all():
            break
        label = new
    least = {c: min(i for i, d in zip(ids, label) if d == c) for c in set(label.tolist())}
    want = collections.Counter((i, int(near[n].sum()), least[c], i == least[c]) for n, (i, c) in enumerate(zip(ids, label.tolist())))
    want += collections.Counter((i, 0, i, True) for i, *_ in odd(dim))
    assert got == want


@pytest.mark.parametrize("heavy", [4096, 1])
def test_a_third_of_all_vectors_alike(spark, monkeypatch, heavy):
    from netweave.operators import skew

    monkeypatch.setattr(skew, "HEAVY", heavy)
    x = vectors(7, 90, 16)
    x[30:60] = x[30]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(table(spark, x)).collect()}
    assert [got[i] for i in range(90)] == [0] * 30 + [29] * 30 + [0] * 30


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = spark.createDataFrame([(4, None, 0, 1, "v", 2)], SCHEMA)
    assert [tuple(r) for r in embedding_dedup.near_duplicate_vectors(lone).collect()] == [(4, 0, 4, True)]


def test_estimates_are_unbiased_and_within_their_intervals():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    errors = []
    for seed in range(20):
        turn = embedding_dedup.rotation(64, seed)
        codes = embedding_dedup.Codes(x, turn)
        estimate, half = codes.estimate(x.astype(np.float32) @ turn)
        off = (estimate - x @ x.T)[~np.eye(300, dtype=bool)].reshape(300, 299)
        assert (np.abs(estimate - x @ x.T) <= half).mean() > 0.9999
        errors.append(off.mean())
    assert abs(np.mean(errors)) < 0.002


PAGES = "page_id bigint, url string, html string, n int, payload string, copy string"


def pages(spark):
    big, other, small = "<p>ünïcode</p>" * 40, "z" * 100, "y" * 99
    html = [big, None, "", small, big, other, small, big, "w" * 3_000_000, other, "\x00\x01" * 80]
    rows = [(i * 3 % 11, f"http://a/{i} b\n" if i % 4 else None, h, 1, "p", "c") for i, h in enumerate(html)]
    rows += [rows[0], rows[0], (None, "u", big, None, None, None), (None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(3)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    path = warc.write_warc(warc.plan_records(df), scratch_path(spark, "warc"))
    got = warc.read_warc(spark, path, split_bytes=5000).collect()
    assert len(got) == len(rows)
    by_payload = collections.defaultdict(list)
    for r in rows:
        by_payload[(r[2] or "").encode()].append(r[0])
    want = collections.Counter()
    for payload, ids in by_payload.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            again = n > 0 and len(payload) >= 100
            want[i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None] += 1
    number = lambda h, k: int(h[k]) if k in h else None
    have = collections.Counter()
    for r in got:
        h = r["headers"]
        have[number(h, "x-page"), int(h["x-payload-bytes"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], number(h, "x-refers-to-page")] += 1
        if h["warc-type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == h["warc-payload-digest"][7:]
    assert have == want


def test_long_urls_and_large_pages_come_back(spark):
    rng = np.random.default_rng(9)
    url = "http://a/" + "".join(map(chr, rng.integers(97, 123, 1_500_000)))
    large = "".join(map(chr, rng.integers(32, 0x2000, 9_000_000)))  # the member ends beyond 16 MiB
    rows = [(1, url, "x" * 200), (2, "u", "x" * 200), (3, "v", large), (4, url + "z", "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = warc.write_warc(warc.plan_records(df), scratch_path(spark, "warc"))
    got = {r["headers"]["x-page"]: r for r in warc.read_warc(spark, path, split_bytes=1 << 20).collect()}
    assert sorted(got) == ["1", "2", "3", "4"] and got["2"]["headers"]["warc-type"] == "revisit"
    assert got["1"]["headers"]["warc-target-uri"] == url and bytes(got["3"]["payload"]).decode() == large


def test_archives_are_plain_gzip_members(spark):
    _, df = pages(spark)
    path = warc.write_warc(warc.plan_records(df), scratch_path(spark, "warc"))
    raw = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect())
    assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1\r\n") == 15


def member(payload, level=6):
    return gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n", level, mtime=0)


class File(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_ranges_own_what_starts_in_them_whatever_looks_like_a_member():
    rng = np.random.default_rng(6)
    inner = member(b"inner" * 10)
    records = [member(x, level) for x, level in ((b"", 6), (inner, 0), (rng.bytes(3000) + warc.MAGIC + rng.bytes(50), 0), (b"a" * 5000, 9), (inner + warc.MAGIC, 0))]
    raw = b"".join([*records[:2], warc._EMPTY_MEMBER, *records[2:]])
    whole = [(at, block) for at, _, _, block in warc.read_range(File(raw), len(raw), 0, len(raw))]
    assert len(whole) == 5
    for cut in [*range(1, len(raw), 37), len(raw) - 1]:
        parts = [r for a, b in ((0, cut), (cut, len(raw))) for r in warc.read_range(File(raw), len(raw), a, b)]
        assert [(at, block) for at, _, _, block in parts] == whole


def test_damaged_members_are_passed_over():
    records = [member(b"x" * 50), member(b"y" * 50), member(b"z" * 50)]
    raw = bytearray(b"".join(records))
    raw[len(records[0]) + 30] ^= 0xFF
    got = [block for _, _, _, block in warc.read_range(File(bytes(raw)), len(raw), 0, len(raw))]
    assert got in ([b"z" * 50], [b"x" * 50, b"z" * 50]) and b"y" * 50 not in got


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    path = warc.write_warc(warc.plan_records(none), scratch_path(spark, "warc"))
    assert warc.read_warc(spark, path).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert 200 >= sizes[0] >= sizes[1] >= sizes[2] > 0
    packed = corpus_pipeline.run(spark, sf_dir)
    ids = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert ids.agg(F.max("n")).first()[0] <= 2048 and packed.count() > 0


def test_dealt_queries_equal_sql(spark, sf_dir):
    import os

    import duckdb
    import pandas as pd

    from netweave.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        sort = lambda df: df[columns].sort_values(columns).reset_index(drop=True)  # noqa: B023, E731
        pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)
