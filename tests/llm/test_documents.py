"""The operators on documents against brute force, on texts with every oddity at once."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from netweave.llm import line_dedup, minhash, mixing, packing, pii, quality, repeats
from netweave.llm.tokens import default_path, encoder


def key(r):
    return (r[0] is None, r[0] or 0)


# 1: near duplicates


def bag(text):
    words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def classes(rows):
    bags = [bag(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b:
                low = sum((a & b).values())
                if low / (sum(a.values()) + sum(b.values()) - low) >= 0.8:
                    root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups


def test_near_duplicates(docs, rows):
    want = collections.Counter()
    for members in classes(rows).values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            want[rows[i][0], min(ids) if ids else None, len(members)] += 1
    got = minhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(classes(rows))
    assert all(r["doc_id"] == r["class_id"] for r in got if r["kept"])


def test_drop_near_duplicates_keeps_columns_and_one_row_a_class(docs, rows):
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(classes(rows)) and set(kept) <= set(rows)


def test_near_duplicates_of_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_a_chain_of_copies_is_one_class_though_its_ends_differ(spark):
    rng = random.Random(1)
    text = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    chain = []
    for i in range(40):
        chain.append((i, " ".join(text)))
        text[(i * 7) % 300] = f"w{rng.randrange(10**6)}"
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_links_at_a_low_threshold_are_whole(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:151] + [f"v{rng.randrange(10**6)}" for _ in range(53)]))]
    low = [sum((bag(a[1]) & bag(b[1])).values()) / sum((bag(a[1]) | bag(b[1])).values()) for a, b in zip(rows[::2], rows[1::2])]
    assert all(0.57 < x < 0.62 for x in low)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=0.5, bands=70, rows=2).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(i, i - i % 2) for i in range(80)]


def test_buckets_of_several_components_in_many_blocks(spark, monkeypatch):
    from netweave.operators import skew

    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP", 2)
    rng = random.Random(15)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(1 + i % 6):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = sorted(sorted(rows[i][0] for i in g) for g in classes(rows).values())
    for heavy in (4096, 1):
        monkeypatch.setattr(skew, "HEAVY", heavy)
        got = collections.defaultdict(list)
        for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
            got[r["class_id"]].append(r["doc_id"])
        assert sorted(map(sorted, got.values())) == want


def test_near_copies_of_many_buckets_are_compared_once(spark, monkeypatch):
    rng = random.Random(21)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(60):
        words = list(base)
        for at in range(10 + i % 10, 150, 50):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    made, write = {}, minhash.materialise

    def kept(df, name="t"):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(minhash, "materialise", kept)
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(rows[i][0] for i in g) for g in classes(rows).values())
    asked = [r["node"] for r in made["open"].collect()]
    assert len(asked) == len(set(asked)) > 40


def test_buckets_are_put_together_where_that_saves_pairs_and_no_pair_is_lost(spark, monkeypatch):
    from netweave.operators import skew

    alike = [(k, n) for k in range(6) for n in range(100, 109) if (n + k) % 9]
    chain = [(10 + k, n) for k in range(12) for n in range(2 * k, 2 * k + 3)]
    stray = [(30 + k, n) for k in range(4) for n in (*range(200 + 50 * k, 250 + 50 * k), 500 + k, 501 + k)]
    comps = {n: 200 + (n - 200) // 50 * 50 for n in range(200, 400)}
    members = spark.createDataFrame([(k, n, comps.get(n, n)) for k, n in alike + chain + stray], "key bigint, node bigint, comp bigint")
    for heavy in (4096, 1):
        monkeypatch.setattr(skew, "HEAVY", heavy)
        got = [tuple(r) for r in minhash._merged(members).select("key", "node", "comp").collect()]
        assert all(c == comps.get(n, n) for _, n, c in got)
        assert sorted((k, n) for k, n, _ in got) == sorted([(100, n) for n in range(100, 109)] + chain + stray)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 400, np.uint64), rng.integers(0, 2**63, 400, np.uint64)
    b[:300] = a[:300]
    a[390:], b[390:] = a[0], a[0]  # weight 11 on both sides
    shingle, owner = np.concatenate([a, b]), np.repeat([0, 1], 400)
    low = 300 + 10
    sig = minhash.dart_signatures(minhash.columns_of(shingle, owner), owner, 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - low / (800 - low)) < 0.05


# 2: packing


def test_packing_places_every_id_once(docs, rows):
    got = [r.asDict() for r in packing.pack_documents(docs, window=64, shard_pieces=8).collect()]
    by_doc = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4
            at += r["length"]
        assert at <= 64
    slow = encoder(default_path()).slow
    want = collections.Counter()
    for r in rows:
        ids = [*slow.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0]] += 1
        parts = by_doc[r[0], len(ids)]
        cover = collections.Counter()
        for p in parts:
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids[p["start"] : p["start"] + p["length"]] or r[0] is None
            cover.update(range(p["start"], p["start"] + p["length"]))
        assert set(cover) == set(range(len(ids)))
    assert sum(r["length"] for r in got) == sum(len(slow.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in got) / (64 * len(by_sequence)) > 0.9


def test_shards_are_cut_from_a_sorted_stream():
    sizes = [7, 1, 30, 0, 4, 64, 3]
    batches = [pa.record_batch([pa.array(range(sum(sizes[:i]), sum(sizes[: i + 1])), pa.int64())], ["n"]) for i in range(len(sizes))]
    cut = [t.column("n").to_pylist() for t in packing.cut_shards(iter(batches), 10)]
    assert sum(cut, []) == list(range(sum(sizes))) and all(8 <= len(c) <= 15 for c in cut)
    assert [len(t) for t in packing.cut_shards(iter(batches[:2]), 10)] == [8] and not list(packing.cut_shards(iter([]), 10))


def test_a_shard_s_index_is_small():
    rng = np.random.default_rng(3)
    ids, bounds, starts = rng.integers(0, 20_000, 600_000).astype(np.uint16), np.arange(601) * 1000, np.ones(20_000, bool)
    tracemalloc.start()
    next(packing.fill_windows(ids, bounds, starts, np.ones(packing.DF_CLASSES), 1000.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / len(ids) < 64


def test_words_are_the_same_by_parts(monkeypatch):
    rng = np.random.default_rng(4)
    ids, starts = rng.integers(0, 100, 1000).astype(np.uint16), rng.random(100) < 0.4
    bounds = np.concatenate([[0, 0], np.sort(rng.integers(0, 1001, 60)), [1000, 1000]])
    whole = packing.words_of(ids, bounds, starts)
    monkeypatch.setattr(packing, "PART_IDS", 16)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(whole, packing.words_of(ids, bounds, starts), strict=True))


def test_what_was_cut_off_is_let_go():
    before = pa.total_allocated_bytes()
    batches = (pa.record_batch([pa.array([bytes(1000)] * 100)], ["ids"]) for _ in range(40))
    # a shard of 1,000 rows, and as many that wait, is all there is
    assert all(pa.total_allocated_bytes() - before < 2.4e6 for _ in packing.cut_shards(batches, 1000))


def test_a_forgetful_encoder_gives_the_same_ids():
    enc, texts = encoder(default_path()), pa.array(["some words of a text", None, "and more of them"])
    want = [x.tolist() for x in enc.encode_texts(texts)]
    enc.forget()
    assert not enc.known and not enc.before and [x.tolist() for x in enc.encode_texts(texts)] == want


def test_packing_in_few_partitions_and_with_all_words(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "MAX_PARTITIONS", 2)
    got = packing.pack_documents(docs, window=64, shard_pieces=8, query_words=None).collect()
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(x)] == np.cumsum([0, *[n for _, n in sorted(x)]])[:-1].tolist() for x in by_sequence.values())
    want = sum(len(encoder(default_path()).slow.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in got) == want and want / (64 * len(by_sequence)) > 0.9


def test_a_long_document_fills_windows_of_its_own(spark):
    text = "seven words of text stand here again " * 400_000
    got = packing.pack_documents(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id bigint, text string")).select("doc_id", "start", "length", "doc_tokens", "offset").collect()
    parts = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 1)
    n = next(r["doc_tokens"] for r in got if r["doc_id"] == 1)
    assert len(text) > 10_000_000 and n > packing.ROW_WINDOWS * 2048 * 3
    assert [s for s, _ in parts] == np.cumsum([0, *[c for _, c in parts]])[:-1].tolist() and sum(c for _, c in parts) == n
    assert sorted(r["doc_tokens"] for r in got if r["doc_id"] != 1) == [1, len(encoder(default_path()).encode("short")) + 1]


def test_packing_nothing(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


def test_neighbours_share_rare_words():
    rng = np.random.default_rng(2)
    starts = np.ones(1000, bool)
    groups = [rng.integers(g * 100, g * 100 + 100, 30) for g in range(8) for _ in range(4)]
    order = rng.permutation(32)
    ids = np.concatenate([groups[i] for i in order]).astype(np.uint16)
    bounds = np.arange(33) * 30
    laid = list(packing.fill_windows(ids, bounds, starts, np.ones(packing.DF_CLASSES), 30.0, 120))
    together = collections.defaultdict(set)
    for p, _, _, sequence, _ in laid:
        together[sequence].add(order[p] // 4)
    assert sum(len(g) == 1 for g in together.values()) >= 7


def test_less_rare_words_are_looked_up_where_the_rarest_find_nothing():
    starts, idf = np.ones(1000, bool), np.full(packing.DF_CLASSES, 5.0)
    common = 50
    word = packing.words_of(np.array([common], np.uint16), np.array([0, 1]), starts)[0][0]
    idf[word & (packing.DF_CLASSES - 1)] = 0.5
    pieces = [[*range(16), common], [*range(16), common], range(100, 117), [common, *range(200, 216)]]
    laid = list(packing.fill_windows(np.concatenate(pieces).astype(np.uint16), np.arange(5) * 17, starts, idf, 17.0, 100))
    assert [p for p, *_ in laid] == [0, 1, 3, 2]


def test_frequencies_count_each_piece_once(spark, docs, rows):
    path = default_path()
    made = packing.tokenize(docs, path, 64)
    n, mean, df = packing.document_frequencies(made)
    starts, want, words, count = encoder(path).word_starts(), np.zeros(packing.DF_CLASSES), 0, 0
    for r in rows:
        ids = np.append(encoder(path).encode(r[1] or ""), 1)
        rest = ids[len(ids) // 64 * 64 :].astype(np.uint16)
        if len(rest):
            held = packing.words_of(rest, np.array([0, len(rest)]), starts)[0]
            want[np.unique(held & np.uint32(packing.DF_CLASSES - 1))] += 1
            words, count = words + len(held), count + 1
    assert n == count and mean == words / count and (df == want).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z9\n\t .,!é×÷ñ'|<>s \r_-ßÿ²½ 中я\x1c\x85")), max_size=30), min_size=1, max_size=6))
def test_fast_ids_are_the_library_s(texts):
    enc = encoder(default_path())
    for text, ids in zip(texts, enc.encode_texts(pa.array(texts)), strict=True):
        assert ids.tolist() == enc.slow.encode(text, add_special_tokens=False).ids


# 3: personal data


def reference_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@.-+ 0123456789()%é_")), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == reference_spans(text)


def test_an_assigned_value_is_proposed_whole():
    value = hashlib.sha512(b"1").hexdigest() * 3
    assert (4, 6, 6 + len(value)) in pii.candidate_spans(f"token={value} and more")


def test_spans_added_and_clean_texts_left_alone(spark):
    clean = "the quick brown fox, version 12 of 2024: it costs 5.50 and order = 77 is late."
    texts = [None, "", clean] * 20 + [f"mail bob{i}@example.org now, token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" call +1 (212) 555-{1000 + i}" for i in range(30)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in got:
        kinds = [s["kind"] for s in r["spans"]]
        assert kinds == ([] if r["doc_id"] < 60 else ["email", "phone", "secret"])
        for s in r["spans"]:
            if s["kind"] == "secret":
                assert len(texts[r["doc_id"]][s["start"] : s["end"]]) == 40


def planted(rng, n):
    """Texts with right and wrong candidates: text, and the values that are personal data."""
    hexa = lambda m: "".join(rng.choice("0123456789abcdef") for _ in range(m))

    def card(ok):
        while True:
            d = "4" + "".join(str(rng.randrange(10)) for _ in range(15))
            if pii.luhn(d) == ok:
                return d

    out = []
    for i in range(n):
        secret, account = hexa(40), "".join(str(rng.randrange(10)) for _ in range(18))
        check = 98 - int(account + "131400") % 97
        good, bad = f"DE{check:02d}{account}", f"DE{(check + 1 + rng.randrange(90)) % 98:02d}{account}"
        ssn = f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        lines = [
            (f'token = "{secret}"', secret), (f"api_key: {secret[:32]}x9", f"{secret[:32]}x9"), (f"commit = {hexa(40)}", None), (f"sha256: {hexa(64)}", None),
            (f"version=release-candidate-{i}-of-many", None), (f"account IBAN {good}", good), (f"serial {bad}", None), (f"order {card(False)} shipped", None),
            (f"pay by card {card(True)}", None), (f"ssn {ssn}", ssn), ("part 000-12-3456", None), (f"mail joe{i} at example dot org", f"joe{i} at example dot org"), (f"call (212) 555-{1000 + i % 9000}", f"(212) 555-{1000 + i % 9000}"),
        ]
        kept = rng.sample(lines, 5)
        out.append(("some words here. " + " and then ".join(t for t, _ in kept) + " the end", {v for _, v in kept if v}))
    return out


def test_candidates_are_rejected_and_accepted_as_planted(spark):
    texts = planted(random.Random(21), 400)
    got = pii.find_pii(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")).collect()
    hit = wrong = missed = refused = 0
    for r in got:
        text, want = texts[r["doc_id"]]
        added = {text[s["start"] : s["end"]] for s in r["spans"] if not s["base"]}
        hit, wrong, missed = hit + len(added & want), wrong + len(added - want), missed + len(want - added)
        refused += sum(not b for _, _, _, b, _, _ in pii.spans_with_votes(text)) - len(added)
        assert [(s["start"], s["end"]) for s in r["spans"] if s["base"]] == [(s, e) for _, s, e in pii.base_spans(text)]
    assert refused > 500 and hit / (hit + missed) > 0.95 and hit / (hit + wrong) > 0.95, (hit, wrong, missed, refused)


def test_labelers_are_found_to_differ():
    rng = random.Random(22)
    rows = collections.Counter((r[0], r[4]) for t, _ in planted(rng, 600) for r in pii.spans_with_votes(t))
    model = pii.LabelModel([(k, v, n) for (k, v), n in rows.items()])
    secret = dict(zip(pii.LABELERS, model.reliability[4], strict=True))
    right = {name: (t[1, 1] + t[0, 0]) / 2 for name, t in secret.items()}
    assert right["word before"] > 0.85 > right["pattern"] and max(right.values()) - min(right.values()) > 0.25
    assert all(abs(t.sum(1) - 1).max() < 1e-9 for t in secret.values())


def test_spans_of_a_long_text_with_many_spans():
    text = " ".join(f"a{i}@b{i}.com {i % 250}.2.3.4 token = {'ab12' * 5}{i}" for i in range(20_000))
    found = pii.spans_with_votes(text)
    assert sum(b for *_, b, _, _ in found) == 40_000 and sum(not b for *_, b, _, _ in found) >= 20_000


def test_personal_data_of_odd_rows(docs, no_docs, rows):
    assert pii.find_pii(docs).count() == len(rows) and pii.find_pii(no_docs).count() == 0


# 5: quality


def test_quality_separates_held_out_rows(spark):
    rng = random.Random(3)
    words = [[f"{p}{i}" for i in range(200)] for p in ("good", "spam")]
    texts = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame([*texts, (None, "good1 good2"), (1000, None), (1001, ""), (1002, "good5 " * 20000)], "doc_id bigint, text string").withColumn("score", docs_lit())
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)] + [(None, 1), (5, None), (7, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, quality.fit_quality(docs, labels, sample_rows=200)).collect()}
    assert len(got) == 404 and not got[None]["held_out"]
    held = [r for i, r in got.items() if i is not None and i < 400 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert sum(r["predicted"] == 1 - r["doc_id"] % 2 for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values()) and got[1002]["predicted"] == 1


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("an input column of this name")


def test_long_labelled_texts_teach_as_well(spark):
    rng = random.Random(4)
    words = [[f"{p}{i}" for i in range(300)] for p in ("good", "spam")]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 2]) for _ in range(3000))) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, quality int")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert min(len(r["text"]) for r in got) > 8000 and all(r["predicted"] == 1 - r["doc_id"] % 2 for r in got)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, quality.BUCKETS - 1), max_size=50))
def test_bags_are_what_was_counted(buckets):
    held, share = quality.open_bag(quality.pack_bag(np.array(buckets, np.int32)))
    want = collections.Counter(buckets)
    assert held.tolist() == sorted(want)
    assert np.allclose(share, [want[b] / (len(buckets) + quality.PADDING) for b in sorted(want)])


def test_scores_don_t_depend_on_the_texts_beside(spark):
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.standard_normal(quality.BUCKETS).astype(np.float32), 0.1)
    texts = ["", "a", "ab", "abc def", None, "é中", "word word word", "x" * 700_000, "tail"]
    alone = [model.score(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(model.score(pa.array(texts, pa.string())), alone)


def test_quality_of_odd_rows_without_labels(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, none)
    assert quality.score_quality(docs, model).count() == len(rows) and quality.score_quality(no_docs, model).count() == 0


# 6: mixing


def mixed(rows, interval):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(rows)}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        rest, w = sum(total.values()) - sum(target.values()), sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / w > 3 * total[s]}
        if not above:
            return size, total, target | {s: rest * weight[s] / w for s in open_}
        target |= {s: 3.0 * total[s] for s in above}
        open_ -= above


@pytest.mark.parametrize("interval", [3, 20_000])
def test_mixing(docs, rows, interval):
    size, total, target = mixed(rows, interval)
    got = mixing.mix_sources(docs, interval_rows=interval).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in target)
    again = mixing.mix_sources(docs.repartition(5), interval_rows=interval).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_many_sources_without_a_broadcast_of_all(docs, rows, monkeypatch):
    from netweave.operators import skew

    want = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    for heavy in (4096, 4):  # all sources are large, or some
        monkeypatch.setattr(skew, "HEAVY", heavy)
        assert sorted(map(str, mixing.mix_sources(docs.repartition(4)).collect())) == want


def test_rows_of_one_id_and_size_are_taken_in_the_same_order(spark):
    rows = [(1, f"{a} {b}", "s") for a in "abcdefgh" for b in "xyz"] + [(2, "one two three", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    runs = [sorted((r["text"], r["taken"]) for r in mixing.mix_sources(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_mixture_of_nothing(no_docs):
    assert mixing.mix_sources(no_docs).count() == 0


def test_the_mix_written_out_has_the_words_taken(docs):
    from pyspark.sql import functions as F

    mix = mixing.mix_sources(docs)
    out = mixing.expand_mix(mix)
    taken = {r[0]: r[1] for r in mix.groupBy("source").agg(F.sum("taken")).collect()}
    words = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    assert {s: n for s, n in taken.items() if n} == words
    originals = {r["text"] for r in docs.collect()}
    assert all(any(o and o.startswith(r["text"]) for o in originals) for r in out.collect())


# 8: line dedup


def test_patience_matches_are_common_and_in_order():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(2))
        got = line_dedup.patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert line_dedup.patience_matches(a, a) == [(i, i) for i in range(len(a))]


BLANKS = " \t\x0b\f\r"


def compared(text):
    """Lines as dedup_lines compares them, and their words, written without its code."""
    lines = [re.sub(f"[{BLANKS}]+", " ", s).strip(" ") for s in text.split("\n")] if text else []
    return lines, [len(s.split(" ")) if s else 0 for s in lines]


def held_lines(own, words, earlier, block):
    """Lines of ``own`` in a run of ``block`` words that stands in one of the ``earlier`` lists of lines, all pairs tried."""
    gone = set()
    for other in earlier:
        for i in range(len(own)):
            for j in range(len(other)):
                n = 0
                while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                    n += 1
                if sum(words[i : i + n]) >= block:
                    gone |= set(range(i, i + n))
    return gone


def deduped(rows, block=10):
    """What dedup_lines defines, row by row: text left, lines, lines removed."""
    order = sorted(range(len(rows)), key=lambda i: (*key(rows[i]), hashlib.md5(f"{'null' if rows[i][0] is None else rows[i][0]}|{rows[i][1] or ''}".encode()).hexdigest()))
    out, earlier = {}, {}
    for i in order:
        t = rows[i][1]
        own, words = compared(t)
        if t in earlier:
            gone = set(range(len(own))) if sum(words) >= block else set()
        else:
            gone = held_lines(own, words, earlier.values(), block)
            if t:
                earlier[t] = own
        left = "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone) if t is not None else None
        out[i] = (rows[i][0], left, len(own), len(gone))
    return [out[i] for i in range(len(rows))]


def test_line_dedup(docs, rows):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == collections.Counter(deduped(rows))
    assert sum(r[3] for r in deduped(rows)) > 10


def removed_by_diff(later, first, words, block=10):
    """Positions in ``later`` of blocks, adjacent on both sides, of one patience diff of all lines of two texts."""
    out, run, last = set(), [], (-2, -2)
    for i, j in [*line_dedup.patience_matches(later, first), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in run) >= block:
                out |= set(run)
            run = []
        run.append(i)
        last = (i, j)
    return out


def blocks_of_earlier_texts(texts, block=10):
    """Lines of each of different texts, in order, that lie in a run of ``block`` words that any earlier text holds."""
    words = lambda s: len(s.split())
    lines = [[s.strip() for s in t.split("\n")] for t in texts]
    out = []
    for k, own in enumerate(lines):
        gone = set()
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(map(words, own[i:j])) >= block and any(own[i:j] == e[x : x + j - i] for e in lines[:k] for x in range(len(e))):
                    gone |= set(range(i, j))
        out.append(sorted(gone))
    return out


def removed_counts(spark, texts):
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).collect()
    for r in got:
        assert r["n_lines"] == len(texts[r["doc_id"]].split("\n"))
    return [r["n_removed"] for r in sorted(got, key=key)], [r["text"] for r in sorted(got, key=key)]


def test_a_block_of_short_lines_goes_however_many_texts_hold_it(spark):
    texts = [f"only here {n}\nfive words stand right here\nand here five more words\nend of {n}" for n in range(130)]
    removed, left = removed_counts(spark, texts)
    assert removed == [0] + [2] * 129 and left[129] == "only here 129\nend of 129"


def test_a_block_goes_if_its_lines_first_occur_apart(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    texts = [f"x1\n{a}\nx2", f"y1\n{b}\ny2", f"z1\n{a}\n{b}\nz2", f"q1\n{a}\n{b}\nq2", f"r1\n{b}\n{a}\nr2"]
    removed, left = removed_counts(spark, texts)
    assert removed == [0, 0, 0, 2, 0] and left[3] == "q1\nq2"


def test_lines_go_exactly_if_an_earlier_text_holds_their_block(spark):
    rng = random.Random(12)
    pool = ["", *(" ".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 4, 5, 9, 11)))) for _ in range(9))]
    texts = list(dict.fromkeys("\n".join([f"t{n}", *(rng.choice(pool) for _ in range(rng.randrange(1, 14)))]) for n in range(150)))
    want = blocks_of_earlier_texts(texts)
    removed, left = removed_counts(spark, texts)
    assert removed == [len(gone) for gone in want] and sum(removed) > 300
    assert left == ["\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone) for t, gone in zip(texts, want, strict=True)]
    words = [[len(s.split()) for s in t.split("\n")] for t in texts]
    for k in range(len(texts)):
        for f in range(k):
            assert set(removed_by_diff(texts[k].split("\n"), texts[f].split("\n"), words[k])) <= set(want[k])


def test_copies_with_other_blanks_are_copies(spark):
    body = "one two three four five\nsix seven eight nine ten eleven"
    texts = [body, "a\r\n" + body.replace("\n", "\r\n") + "\r\nb", "\t" + body.replace(" ", " \t") + "\nc", "中文 " + body]
    removed, left = removed_counts(spark, texts)
    assert removed == [0, 2, 2, 0] and left[1:3] == ["a\r\nb", "c"]


def test_a_very_long_text_is_taken_whole(spark):
    lines = [f"line {n} of a text beyond ten million characters {'x' * 80}" for n in range(90_000)]
    texts = ["\n".join(lines[40_000:40_002]), "\n".join(lines), "\n".join([*lines[89_998:], "only here"])]
    removed, left = removed_counts(spark, texts)
    assert removed == [0, 2, 2] and len(left[1]) > 10_000_000 and left[2] == "only here"


def test_moved_blocks_go_or_stay(spark):
    a, b = (" ".join(f"{c}{n}" for n in range(12)) for c in "ab")
    docs = spark.createDataFrame([(0, f"{a}\n{b}"), (1, f"{b}\nx\n{a}"), (2, f"{a}\ny\n{a}\n{b}")], "doc_id bigint, text string")
    for moved, want in ((True, [0, 2, 3]), (False, [0, 1, 2])):
        got = line_dedup.dedup_lines(docs, moved=moved).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in got] == want


def test_line_dedup_takes_all_that_patience_diff_with_any_earlier_text_removes(docs, rows):
    numbered = {r[0]: r[1] for r in rows if r[0] is not None and r[1]}
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    for k, text in numbered.items():
        if k != 8 and text not in [numbered[f] for f in numbered if f < k]:  # 8 is given three times
            own, words = compared(text)
            assert got[k] == len(set().union(*(removed_by_diff(own, compared(numbered[f])[0], words) for f in numbered if f < k)))


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


# 9: repeats


def without_repeats(rows, n=50):
    data = [(*key(r), (r[1] or "").encode(), r) for r in rows]
    out = []
    for null, ident, b, r in data:
        earlier = {x[j : j + n] for a, i, x, _ in data if (a, i) < (null, ident) for j in range(len(x) - n + 1)}
        mark = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if b[j : j + n] in earlier:
                mark[j : j + n] = True
        spans = int((mark & ~np.append(False, mark[:-1])).sum()) if len(b) else 0
        out.append((r[0], len(b), spans, np.frombuffer(b, np.uint8)[~mark].tobytes()))
    return out


@pytest.mark.parametrize("tasks", [{}, {"share_bytes": 2000, "index_bytes": 700}])
def test_repeats(docs, rows, tasks):
    got = [(r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in repeats.remove_repeats(docs, **tasks).collect()]
    assert collections.Counter(got) == collections.Counter(without_repeats(rows))
    assert any(s for _, _, s, _ in got)


def test_repeats_of_nothing(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=10))
def test_run_length_index(texts):
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    index = repeats.RunLengthIndex(np.frombuffer(b"".join(texts), np.uint8), bounds)
    suffixes = sorted((tuple(c + 1000 for c in t[j:]) + (i,), i, j) for i, t in enumerate(texts) for j in range(len(t) + 1))
    assert index.rows == len(suffixes) and sorted(np.repeat(index.run_letter > 0, np.diff(index.run_begin))) == [False] * len(texts) + [True] * (len(suffixes) - len(texts))
    want = {}
    for n, (a, i, j) in enumerate(suffixes):
        before = suffixes[n - 1][0] if n else ()
        want[i, j] = n, next((m for m, (x, y) in enumerate(zip(before, a, strict=False)) if x != y), min(len(before), len(a)))
    for window in (1, 3):
        got = {(i, j): (row, match) for part in index.stream(np.diff(bounds), window) for i, j, row, match in zip(*(x.tolist() for x in part), strict=True)}
        assert got == {(i, j): v for (i, j), v in want.items() if j + window <= len(texts[i])}


def test_repeated_windows_in_many_chunks(monkeypatch):
    monkeypatch.setattr(repeats.RunLengthIndex, "TOGETHER", 7)
    rng = np.random.default_rng(31)
    base = rng.integers(97, 101, 300, np.uint8)
    texts = [base[a : a + n].copy() for a, n in zip(rng.integers(0, 230, 200), rng.integers(1, 70, 200), strict=True)]
    for t in texts[::3]:
        t[rng.integers(0, len(t))] = 120
    document = rng.integers(0, 50, 200)
    document.sort()
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = repeats.repeated_windows(np.concatenate(texts), bounds, document, 12)
    raw = [t.tobytes() for t in texts]
    want = [any(document[o] < document[i] and t[j : j + 12] in raw[o] for o in range(200)) if j + 12 <= len(t) else False for i, t in enumerate(raw) for j in range(len(t))]
    assert got.tolist() == want and 100 < sum(want) < len(want)


def test_the_index_grows_with_the_runs_and_not_with_the_text():
    rng = np.random.default_rng(33)
    base = rng.integers(97, 117, 80, np.uint8)

    def held(copies):
        texts = [np.append(base, rng.integers(97, 117, 3, np.uint8)) for _ in range(copies)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        index = repeats.RunLengthIndex(np.concatenate(texts), bounds)
        size = sum(v.nbytes for v in vars(index).values() if isinstance(v, np.ndarray))
        return size, len(index.run_letter), index.rows

    (few, few_runs, few_rows), (many, many_runs, many_rows) = held(100), held(4000)
    assert many_rows == 40 * few_rows
    assert many / many_runs <= 40 and few / few_runs <= 40 and many_runs < 0.12 * many_rows


def test_a_text_of_several_parts(spark):
    long = np.random.default_rng(34).integers(97, 123, 9_000_000, np.uint8).tobytes().decode()
    cut = repeats._PART
    texts = ["before", long, long[cut - 100 : cut + 100] + "own words", long[: cut + 60] + "X" + long[cut + 61 :]]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got if r["doc_id"] != 1} == {
        0: (6, [], b"before"), 2: (209, [(0, 200)], b"own words"), 3: (9_000_000, [(0, cut + 60), (cut + 61, 9_000_000)], b"X"),
    }
    assert next(r["spans"] == [] for r in got if r["doc_id"] == 1)


def test_common_words_bring_no_stretches_together():
    rng = np.random.default_rng(35)
    words = ["".join(map(chr, rng.integers(97, 123, 30))) for _ in range(1500)]
    passage = " ".join(words[i] for i in rng.integers(0, 1500, 7))
    texts = [" ".join(words[i] for i in rng.integers(0, 1500, 40)) for _ in range(200)]
    texts[7] += passage + "!"
    texts[150] = passage + texts[150]
    base = {"id": pa.array(range(200), pa.int64()), "b": pa.array([t.encode() for t in texts])}
    n_p, groups = 3, {}
    for batch in repeats._share(n_p)(iter([pa.record_batch({"t": pa.array(range(1000, 1200), pa.int64()), **base})])):
        for row in batch.to_pylist():
            groups.setdefault(row["p"], []).append(row)
    flags = repeats._flags(pa.concat_tables([repeats._shared(1)(pa.Table.from_pylist(rows, pa.schema([(c, batch.schema.field(c).type) for c in batch.schema.names]))) for rows in groups.values()]))
    of = dict(zip(flags["id"].to_pylist(), flags["flags"].to_pylist(), strict=True))
    kind = flags["flags"].type
    sent = pa.record_batch({"s": pa.array(range(1000, 1200), pa.int64()), **base, "flags": pa.array([of.get(i, []) for i in range(200)], kind)})
    held, windows = 0, collections.defaultdict(set)
    for batch in repeats._emit(n_p, 1)(iter([sent])):
        for row in batch.to_pylist():
            raw, at = repeats._unsqueeze(row["data"]), 0
            held += len(raw)
            for i, a, n in zip(np.frombuffer(row["ids"], "<i8").tolist(), np.frombuffer(row["starts"], "<u4").tolist(), np.frombuffer(row["lengths"], "<u1").tolist(), strict=True):
                assert texts[i][a : a + n].encode() == raw[at : at + n]
                windows[i] |= {texts[i][x : x + 50] for x in range(a, a + n - 49)}
                at += n
    every = [{t[x : x + 50] for x in range(len(t) - 49)} for t in texts]
    for i, own in enumerate(every):
        assert windows[i] >= own & set().union(*every[:i], *every[i + 1 :])
    assert len(every[7] & every[150]) >= 150
    # 16 bytes within a word are common here, 33 are more than a word
    assert held < 0.1 * sum(map(len, texts))
