"""Near-duplicate documents by DartMinHash.

A document is the multiset of its five-word shingles. A shingle that occurs c times owns c unit columns of the plane
weight x rank. Into each column hashed darts are thrown: a Poisson process along the rank axis whose arrivals follow
from hashes of column and arrival number alone, so equal columns of two documents are hit by the same darts. A dart
is hashed to one of ``k`` coordinates, and a coordinate keeps its earliest dart. Two documents keep the same dart at a
coordinate with a probability equal to their weighted Jaccard similarity, sum of minima over sum of maxima.

Rank is cut off where a document expects some ``k (ln k + 3)`` darts, so a long document throws as few as a short
one: most of its columns get none. Where a coordinate stays empty the cut is doubled.

Bands of the signature make buckets. Every member of a bucket is compared with the bucket's smallest one, so
candidates grow with the members and not with their pairs; where that leaves a bucket in several components, the
members of different components are compared with each other by signature, in blocks, and likely pairs exactly.
Near copies share many such buckets; these are put together first, so a pair is compared once and not in each of them.
Only exact similarities, over whole texts, make links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netweave.operators.skew import join_counted
from netweave.llm.names import own_names
from netweave.llm.words import mix, shingles, text_chunks, tidied, word_hashes
from netweave.operators.components import connected_components
from netweave.plans.session import materialise

WIDTH = 5
THRESHOLD = 0.8
#: 28 bands of 5 miss a pair of similarity 0.8 with probability 2e-5.
BANDS, ROWS = 28, 5
#: A pair is passed over by signature only if it has fewer equal coordinates than one of the threshold's similarity
#: would have at so many standard deviations below its mean; one in some 10**9 does.
DEVIATIONS = 6.0
#: Members of one bucket that a task compares with each other, and members of one centre that a task verifies. Up to
#: ``SPREAD`` blocks are smaller, of some ``FINE`` members, so that more tasks share a bucket.
BLOCK = 2048
FINE, SPREAD = 128, 16
BLOCK_CHARS = 32 << 20
GROUP = 256

_U = np.uint64


def columns_of(shingle: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The unit columns of all shingles: equal shingles of a text are told apart by a running number."""
    tag = mix(shingle + owner.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(tag)
    ranked = tag[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    at = np.flatnonzero(new)
    number = np.arange(len(ranked)) - np.repeat(at, np.diff(np.append(at, len(ranked))))
    out = np.empty_like(shingle)
    out[order] = mix(shingle[order] + number.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    return out


def dart_signatures(columns: np.ndarray, owner: np.ndarray, texts: int, k: int) -> np.ndarray:
    """``texts`` x ``k`` 32-bit names of the earliest darts; rows of texts without columns are zero."""
    weight = np.bincount(owner, minlength=texts)
    signature = np.zeros((texts, k), np.uint32)
    todo = weight > 0
    cut = k * (np.log(k) + 3) / np.maximum(weight, 1)
    while todo.any():
        take = todo[owner]
        column, text = columns[take], owner[take]
        limit = cut[text]
        best = np.full(texts * k, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.zeros(len(column))
        arrival = 0
        while len(column):
            arrival += 1
            h = mix(column + _U(arrival * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            rank = rank - np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = rank < limit
            column, text, limit, rank, h = column[hit], text[hit], limit[hit], rank[hit], h[hit]
            h = mix(h ^ _U(0xA24BAED4963EE407))
            slot = text * k + (h >> _U(32)).astype(np.int64) % k
            darts.append((slot, rank, h.astype(np.uint32)))
        slot, rank, name = (np.concatenate(x) for x in zip(*darts, strict=True))
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        full = np.isfinite(best).reshape(texts, k).all(1) & todo
        won &= full[slot // k]
        signature.reshape(-1)[slot[won]] = name[won]
        todo &= ~full
        cut = cut * 2
    return signature


def likely_coordinates(threshold: float, k: int) -> float:
    """How many of ``k`` coordinates a pair must share to be compared exactly."""
    return k * threshold - DEVIATIONS * (k * threshold * (1 - threshold)) ** 0.5


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    parts = signature[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _U(0x8CB92BA72F3D8DD7)
    for r in range(rows):
        key = mix(key + parts[:, :, r] * _U(0x9E3779B97F4A7C15) + _U(r + 1))
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as distinct values and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / max(1, int(a[1].sum()) + int(b[1].sum()) - low)


def _multisets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, data, offsets in text_chunks(texts):
        found, owner = shingles(*word_hashes(data, offsets), WIDTH)
        at = np.searchsorted(owner, np.arange(len(offsets)))
        out += [np.unique(found[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def sketch(docs: DataFrame, text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` without its text, with ``__node`` (of the sequence of words; null without words), ``__bands``, ``__sig``."""
    kept = [c for c in docs.columns if c != text_col]
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(text_col)):
                n = len(offsets) - 1
                words, bounds = word_hashes(data, offsets)
                found, owner = shingles(words, bounds, WIDTH)
                signature = dart_signatures(columns_of(found, owner), owner, n, k)
                keys = band_keys(signature, bands, rows)
                node = [int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(first, n)
                made = [pa.array(node, pa.int64()), pa.array([x.tolist() for x in keys], pa.list_(pa.int64())), pa.array([x.tobytes() for x in signature.astype(np.uint8)], pa.binary())]
                yield pa.record_batch([*(part.column(c) for c in kept), *made], [*kept, "__node", "__bands", "__sig"])

    from pyspark.sql import types as T

    made = [T.StructField("__node", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType())), T.StructField("__sig", T.BinaryType())]
    return docs.mapInArrow(tidied(run), T.StructType([*(docs.schema[c] for c in kept), *made]))


def _likely(pairs: DataFrame, sigs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose signatures agree in enough coordinates; ``b`` may be one node in any share of the pairs."""
    centres = pairs.groupBy("b").agg(F.count("*").alias("n")).join(sigs.select(F.col("__node").alias("b"), F.col("__sig").alias("sb")), "b")
    both = join_counted(pairs.join(sigs.select(F.col("__node").alias("a"), F.col("__sig").alias("sa")), "a"), centres, "b", "n", pairs.count())
    enough = likely_coordinates(threshold, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= enough))

    return both.select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose exact similarity reaches the threshold; ``texts``: ``__node, __text``.

    The members of a centre ``b`` are dealt to groups of some ``GROUP``; the centre's text goes to each group once.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("n"), F.count("*").alias("held"))
    placed = join_counted(pairs, groups, "b", "held", pairs.count()).withColumn("g", F.pmod(F.xxhash64("a"), "n").cast("int"))
    asked = placed.select(F.col("a").alias("__node"), "b", "g", F.lit(1).alias("role")).unionByName(
        placed.select(F.col("b").alias("__node"), "b", "g").distinct().withColumn("role", F.lit(0))
    )
    rows = asked.join(texts, "__node").repartition("b", "g").sortWithinPartitions("b", "g", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = _multisets(part.column("__text"))
                out = []
                for node, b, role, bag in zip(*(part.column(c).to_pylist() for c in ("__node", "b", "role")), sets, strict=True):
                    if role == 0:
                        centre, held = b, bag
                    elif centre == b and similarity(bag, held) >= threshold:
                        out.append((node, b))
                yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.select("__node", "b", "g", "role", "__text").mapInArrow(tidied(run), "a long, b long")


def _sizes(members: DataFrame, key: str, *more) -> DataFrame:
    """A row a ``key``: ``held`` members, ``most`` of them in one component, the ``pairs`` that must meet, and ``more``."""
    parts = members.groupBy(key, "comp").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    sizes = parts.groupBy(key).agg(F.sum("n").alias("held"), F.max("n").alias("most"), *more)
    return sizes.withColumn("pairs", (F.col("held") - F.col("most")) * F.col("held").cast("double"))


def _merged(members: DataFrame) -> DataFrame:
    """``members`` (``key, node, comp``) with buckets that share members put together where that saves pairs.

    What buckets connect becomes one bucket, named by its smallest node and with a row a node, if no more pairs must
    meet in it than in its buckets one by one; else these stay as they are. Members that shared a bucket still do.
    """
    total = members.count()
    buckets = materialise(_sizes(members, "key", F.min("node").alias("low")), "buckets")
    # a node is in one bucket a band at most, so it is the smallest of few
    groups = connected_components(join_counted(members, buckets.select("key", "low", "held"), "key", "held", total), "node", "low")
    inside = materialise(members.select("node", "comp").distinct().join(groups, "node"), "inside")
    grouped = materialise(buckets.join(groups.withColumnRenamed("node", "low"), "low").select("key", "held", "pairs", "component"), "grouped")
    single = grouped.groupBy("component").agg(F.count("*").alias("buckets"), F.sum("pairs").alias("single"))
    chosen = materialise(_sizes(inside, "component").join(single, "component").withColumn("whole", F.col("pairs") <= F.col("single")).select("component", "held", "buckets", "whole"), "chosen")
    whole = join_counted(inside, chosen.where("whole").select("component", "held"), "component", "held", inside.count())
    apart = join_counted(grouped.select("key", "held", "component"), chosen.where("not whole").select("component", "buckets"), "component", "buckets", grouped.count(), "left_semi")
    kept = join_counted(members, materialise(apart.select("key", "held"), "apart"), "key", "held", total, "left_semi")
    return whole.select(F.col("component").alias("key"), "node", "comp").unionByName(kept.select("key", "node", "comp"))


def _placed(members: DataFrame) -> DataFrame:
    """``members`` (``key, node, comp, chars``) with their block ``mine`` and in how many ``blocks``, from the first, it must meet others.

    Two members must meet if they are of different components, so one at least is outside the bucket's largest. Those
    outside come in blocks that meet each other and the blocks of the largest component, whose own blocks don't meet:
    a bucket of many with a few strays costs each member a row for every block of strays.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    blocks = lambda n, chars: F.greatest(F.lit(1), F.least(F.lit(SPREAD), F.ceil(n / FINE)), F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS)).cast("int")
    main = F.max_by(F.struct("comp", "n", "chars"), F.struct("n", "comp"))
    buckets = parts.groupBy("key").agg(main.alias("main"), F.sum("n").alias("held"), F.sum("chars").alias("all"))
    buckets = buckets.select("key", "held", F.col("main.comp").alias("main"), blocks(F.col("held") - F.col("main.n"), F.col("all") - F.col("main.chars")).alias("outer"), blocks(F.col("main.n"), F.col("main.chars")).alias("inner"))
    dealt = join_counted(members, buckets, "key", "held", members.count())
    stray, spot = F.col("comp") != F.col("main"), F.xxhash64("node")
    dealt = dealt.withColumn("mine", F.when(stray, F.pmod(spot, "outer")).otherwise(F.col("outer") + F.pmod(spot, "inner")).cast("int"))
    dealt = dealt.withColumn("blocks", F.when(stray, F.col("outer") + F.col("inner")).otherwise(F.col("outer")))
    return dealt.select("key", "node", "comp", "mine", "blocks")


def _paired(rows: DataFrame) -> DataFrame:
    """Rows of ``_placed``, once for each pair ``i <= j`` of blocks that their block is one of, pair by pair."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "blocks")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[list[tuple]]:
    """Rows of batches sorted by ``keys``, group by group, as tuples of ``names``."""
    group, last = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *names)), strict=True):
            if row[: len(keys)] != last:
                if len(group) > 1:
                    yield group
                group, last = [], row[: len(keys)]
            group.append(row[len(keys) :])
    if len(group) > 1:
        yield group


def _open_members(members: DataFrame, sigs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The members of buckets (``key, node, comp``) that may be linked with a member of another component.

    A row a member, ``key, node, comp``, however many partners it may have.
    """
    enough = likely_coordinates(threshold, k)
    rows = _paired(_placed(members.withColumn("chars", F.lit(0))).join(sigs.select(F.col("__node").alias("node"), F.col("__sig").alias("sig")), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"], ["key", "node", "comp", "mine", "i", "j", "sig"]):
            key, node, comp, mine, i, j = (np.array(x) for x in list(zip(*group, strict=True))[:6])
            sig = np.frombuffer(b"".join(x[6] for x in group), np.uint8).reshape(-1, k)
            left, right, found = np.flatnonzero(mine == i), np.flatnonzero(mine == j), np.zeros(len(node), bool)
            for at in range(0, len(left), 64):
                x = left[at : at + 64]
                same = (sig[x][:, None, :] == sig[right][None, :, :]).sum(2) >= enough
                same &= comp[x][:, None] != comp[right][None, :]
                found[x] |= same.any(1)
                found[right] |= same.any(0)
            yield pa.record_batch([pa.array(c[found]) for c in (key, node, comp)], ["key", "node", "comp"])

    return rows.select("key", "i", "j", "node", "comp", "mine", "sig").mapInArrow(tidied(run), "key long, node long, comp long").distinct()


def linked_forest(columns: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between members ``left`` and ``right`` of different components, only as many as connect what they connect.

    ``columns`` are the unit columns of all members, so the overlap of two is the number of columns they share: the
    product of their 0/1 rows, which is taken over the columns that more than one has.
    """
    n = len(comp)
    size = np.bincount(owner, minlength=n)
    _, which, count = np.unique(columns, return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    take = several[which]
    column, member = number[which[take]], owner[take]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    shared = np.zeros((len(left), len(right)))
    width = 4096
    for at in range(0, int(several.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        rows = np.zeros((n, width), np.float32)
        rows[member[lo:hi], column[lo:hi] - at] = 1
        shared += rows[left] @ rows[right].T
    union = size[left][:, None] + size[right][None, :] - shared
    linked = (shared / np.maximum(union, 1) >= threshold) & (comp[left][:, None] != comp[right][None, :])
    root, out = np.unique(comp, return_inverse=True)[1], []
    for i in np.flatnonzero(linked.any(1)):
        with_it = right[linked[i]]
        roots, first = np.unique(root[with_it], return_index=True)
        for r, f in zip(roots, first, strict=True):
            if r != root[left[i]]:
                out.append((int(left[i]), int(with_it[f])))
                root[root == r] = root[left[i]]
    return out


def _linked_members(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b``, exact, that connect the components (``key, node, comp``) of each bucket as all its links do."""
    size = texts.select(F.col("__node").alias("node"), F.length("__text").alias("chars"))
    rows = _paired(_placed(materialise(members.join(size, "node"), "sized")).join(texts.withColumnRenamed("__node", "node"), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"], ["node", "comp", "mine", "i", "j", "__text"]):
            node, comp, mine, i, j = (np.array(x) for x in list(zip(*group, strict=True))[:5])
            columns, owners = [], []
            for first, data, offsets in text_chunks(pa.array([x[5] for x in group], pa.large_string())):
                found, owner = shingles(*word_hashes(data, offsets), WIDTH)
                columns.append(columns_of(found, owner))
                owners.append(owner + first)
            links = linked_forest(np.concatenate(columns), np.concatenate(owners), np.flatnonzero(mine == i), np.flatnonzero(mine == j), comp, threshold)
            yield pa.record_batch([pa.array([int(node[x[y]]) for x in links], pa.int64()) for y in (0, 1)], ["a", "b"])

    return rows.select("key", "i", "j", "node", "comp", "mine", "__text").mapInArrow(tidied(run), "a long, b long")


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> dict:
    """Two hashes of id and text, 96 bits, by which a row is found again; rows that agree in both are alike."""
    return {"__h1": F.xxhash64(id_col, text_col), "__h2": F.hash(text_col, id_col)}


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``__id, __h1, __h2, class_id, class_size, kept`` of every row of ``docs``."""
    k = bands * rows
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[c.alias(n) for n, c in _row_keys(docs, id_col, text_col).items()])
    seen = materialise(sketch(plain.withColumn("__row", F.monotonically_increasing_id()), "__text", bands, rows), "sketch")
    worded = seen.where("__node is not null")
    nodes = materialise(worded.groupBy("__node").agg(F.any_value("__bands").alias("__bands"), F.any_value("__sig").alias("__sig"), F.min(F.struct("__h1", "__h2")).alias("h")), "nodes")
    keyed = nodes.select(F.col("__node").alias("node"), F.explode(F.array_distinct("__bands")).alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialise(join_counted(keyed, shared, "key", "n", nodes.count() * bands), "members")
    wanted = members.select(F.col("node").alias("__node")).distinct().join(nodes.select("__node", "__sig", "h.__h1", "h.__h2"), "__node")
    sigs = materialise(wanted, "signatures")
    stars = materialise(members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    likely = materialise(_likely(stars, sigs, k, threshold), "likely")
    # the text of one document for each node that shares a bucket
    texts = materialise(plain.drop("__id").join(sigs.select("__node", "__h1", "__h2").hint("merge"), ["__h1", "__h2"]).dropDuplicates(["__node"]).select("__node", "__text"), "texts")
    links = materialise(_verified(likely, texts, threshold), "links")
    parts = connected_components(links, "a", "b")
    # buckets of more than a centre and one other that are still in several components; of those with the same members, one
    placed = materialise(members.where("n > 2").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.bit_xor("node").alias("t"), F.count("*").alias("held")).where("x <> y")
    mixed = mixed.groupBy("s", "t").agg(F.min(F.struct("key", "held")).alias("m")).select("m.key", "m.held")
    open_ = join_counted(placed, materialise(mixed, "mixed"), "key", "held", placed.count(), "left_semi")
    merged = materialise(_merged(materialise(open_.select("key", "node", "comp"), "unsure")), "merged")
    unsure = materialise(_open_members(merged, sigs, k, threshold), "open")
    if not unsure.isEmpty():
        links = links.unionByName(materialise(_linked_members(unsure, texts, threshold), "links"))
        parts = connected_components(links, "a", "b")
    first = F.min(F.struct(F.col("__id").isNull().alias("a"), "__id", "__row")).alias("first")
    by_node = worded.groupBy("__node").agg(first, F.count("*").alias("n")).join(parts.withColumnRenamed("node", "__node"), "__node", "left")
    by_node = by_node.withColumn("comp", F.coalesce("component", "__node"))
    by_class = by_node.groupBy("comp").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    found = by_node.select("__node", "comp").join(by_class, "comp").select("__node", "best", "class_size")
    single = F.col("best").isNull()
    return seen.select("__id", "__row", "__h1", "__h2", "__node").join(found, "__node", "left").select(
        "__id", "__h1", "__h2",
        F.when(single, F.col("__id")).otherwise(F.col("best.__id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (single | (F.col("__row") == F.col("best.__row"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near duplicates: ``id_col, class_id, class_size, kept`` for every row of ``docs``.

    Two documents are linked if the weighted Jaccard similarity of their five-word shingles reaches ``threshold``;
    words are runs of letters and digits without regard to case, and a text of one to four words is one shingle. A
    class is what links connect, ``class_id`` its smallest id (null if all its ids are null), ``class_size`` its rows.
    In each class one row is kept, one of those with the smallest id (null last). A text without words, null or
    empty, is in no class with others: ``class_id`` is its own id, and it is kept. Texts of any length count whole; a
    task holds the shingles of some megabyte of texts, or of one longer text. Columns other than id and text are
    ignored; an empty table gives an empty result.
    """
    return _classes(docs, threshold, bands, rows, id_col, text_col).select(F.col("__id").alias(id_col), "class_id", "class_size", "kept")


@own_names
def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    kept = _classes(docs, threshold, bands, rows, id_col, text_col).where("kept")
    # rows without words are kept each for itself, also where they are alike, so they don't go through the join
    worded = F.coalesce(F.col(text_col).rlike(r"[A-Za-z0-9]|[^\x00-\x7F]"), F.lit(False))
    keyed = docs.where(worded).withColumns(_row_keys(docs, id_col, text_col))
    one = keyed.join(kept.select("__h1", "__h2").distinct(), ["__h1", "__h2"], "left_semi").dropDuplicates(["__h1", "__h2"])
    return one.select(*docs.columns).unionByName(docs.where(~worded))
