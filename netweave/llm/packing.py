"""Lexical retrieval packing.

Documents are tokenized once. Whole windows of a long document stand by themselves; what is left of each document, a
piece shorter than a window, is packed with pieces like it. The pieces are range-partitioned by a one-value MinHash
of their words and sorted, and shards are cut from each sorted stream as it passes, so that like pieces share a shard. A
shard, bounded in rows whatever the corpus or the key, holds a BM25 inverted index over its pieces; neighbours are sought
within the shard. A seed's rarest words are looked up, the unused neighbours fill the seed's
window in the order of their scores, and the one that overflows it is cut: its rest is the next seed. So no window
but the last of a shard is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from netweave.llm.tokens import default_path, encoder
from netweave.llm.words import mix, tidied
from netweave.plans.session import materialise

WINDOW = 2048
END_ID = 1
#: Pieces in a shard, about. Its ids take 2 bytes each, or 4, and its index some 20 a different word of a piece.
SHARD_PIECES = 4096
#: Ids whose words are hashed together, and words that are weighed together: what that makes on the way is many times as large.
PART_IDS = 1 << 17
#: Partitions that shards are cut from, at most: how many there are follows the cluster and not the corpus.
MAX_PARTITIONS = 20_000
#: Words of a seed that are looked up, those of the highest weight.
QUERY_WORDS = 16
#: Document frequencies are counted by hash of the word, in so many classes.
DF_CLASSES = 1 << 16
K1, B = 1.2, 0.75
#: Whole windows of a very long document go in rows of so many windows.
ROW_WINDOWS = 256

_POSITION = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def words_of(ids: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of pieces, ``ids[bounds[i]:bounds[i + 1]]`` each, and the piece of each.

    Whole pieces go together up to ``PART_IDS`` ids; a longer one goes alone.
    """
    found, low = [], 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + PART_IDS, "right")) - 1)
        words, piece = _words_of_part(ids[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], starts)
        found.append((words, piece + np.int32(low)))
        low = high
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])


def _words_of_part(ids: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    first = starts[ids]
    first[bounds[:-1][bounds[:-1] < len(ids)]] = True
    at = np.flatnonzero(first)
    position = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    value = mix(ids.astype(np.uint64) + np.uint64(0x51ED2701)) * _POSITION[np.minimum(position, 63)]
    words = mix(np.add.reduceat(value, at)) >> np.uint64(32)
    return words.astype(np.uint32), (np.searchsorted(bounds, at, "right") - 1).astype(np.int32)


def tokenize(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Rows ``doc_id, doc_tokens, start, sequence, ids, key, slot, counts``: whole windows, and the rest with its key.

    A task's last row has only ``counts``: how many rests and words it made, and by class of word how many rests hold it.
    """
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        starts = enc.word_starts()
        partition, made = TaskContext.get().partitionId(), 0
        sequence = (1 << 62) + (partition << 36)
        kind = np.uint16 if enc.size <= 1 << 16 else np.uint32
        end = np.array([END_ID], kind)
        df, total = np.zeros(DF_CLASSES, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[list] = []
                source, rests = [], []
                for i, ids in enumerate(enc.encode_texts(part.column("text"))):
                    ids = np.concatenate([ids, end])
                    whole = len(ids) // window
                    for w in range(0, whole, ROW_WINDOWS):
                        n = min(ROW_WINDOWS, whole - w)
                        source.append(i)
                        rows.append([len(ids), w * window, sequence, ids[w * window : (w + n) * window].tobytes(), None, None])
                        sequence += n
                    rest = ids[whole * window :]
                    if len(rest):
                        made += 1
                        source.append(i)
                        rows.append([len(ids), whole * window, None, rest.tobytes(), None, (partition << 36) + made])
                        rests.append((rows[-1], rest))
                if rests:
                    bounds = np.concatenate([[0], np.cumsum([len(r) for _, r in rests])])
                    words, piece = words_of(np.concatenate([r for _, r in rests]), bounds, starts)
                    held = np.sort((piece.astype(np.uint32) << np.uint32(16)) | (words & np.uint32(DF_CLASSES - 1)))
                    df += np.bincount(held[np.append(True, held[1:] != held[:-1])] & np.uint32(DF_CLASSES - 1), minlength=DF_CLASSES)
                    total += len(words)
                    keys = np.minimum.reduceat(mix(words.astype(np.uint64)) >> np.uint64(1), np.searchsorted(piece, np.arange(len(rests))))
                    for (row, _), key in zip(rests, keys.tolist(), strict=True):
                        row[4] = key
                columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
                yield pa.record_batch([part.column("doc_id").take(pa.array(source, pa.int64())), *columns, pa.nulls(len(rows), pa.binary())], names)
                id_kind = part.column("doc_id").type
            batch = part = None  # else they stay while the next one is read
        if made:
            counts = np.concatenate([[made, total], df]).tobytes()
            yield pa.record_batch([pa.nulls(1, id_kind), *(pa.nulls(1, k) for k in kinds), pa.array([counts], pa.binary())], names)

    names = ["doc_id", "doc_tokens", "start", "sequence", "ids", "key", "slot", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    schema = f"doc_id {kind_of}, doc_tokens long, start long, sequence long, ids binary, key long, slot long, counts binary"
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def _unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(b, kind) for b in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def document_frequencies(rows: DataFrame) -> tuple[int, float, np.ndarray]:
    """Number of pieces, mean number of words, and by class of word how many pieces hold it; over all pieces of ``tokenize``.

    What reaches the driver is ``DF_CLASSES + 1`` rows at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(DF_CLASSES + 2, np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                sums += np.frombuffer(counts, np.int64)
        (n, total), df = sums[:2], sums[2:]
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(held, -1)), pa.array(np.append(df[held], n)), pa.array(np.append(np.zeros(len(held), np.int64), total))], ["word", "n", "total"])

    found = rows.where("counts is not null").select("counts").mapInArrow(tidied(run), "word long, n long, total long").groupBy("word").agg(F.sum("n"), F.sum("total")).collect()
    df, n, total = np.zeros(DF_CLASSES), 0, 0
    for word, count, words in found:
        if word < 0:
            n, total = count, words
        else:
            df[word] = count
    return n, total / max(1, n), df


def fill_windows(ids: np.ndarray, bounds: np.ndarray, starts: np.ndarray, idf: np.ndarray, mean_words: float, window: int = WINDOW, query_words: int | None = QUERY_WORDS) -> Iterator[tuple[int, int, int, int, int]]:
    """Pack the pieces of a shard: ``piece, start, length, sequence, offset`` with starts within the piece.

    A window opens with the rest of the piece that was cut last, or the first unused piece; the unused neighbours of
    the piece laid last by BM25 score, ties in order, fill it; where none is left, the next unused piece does. A seed's
    ``query_words`` rarest words are looked up, all if None; where no unused piece has any of them the next rarest are, and
    so on, so none is passed over that shares a word with the seed.
    """
    m = len(bounds) - 1
    lengths = np.diff(bounds)
    words, piece = words_of(ids, bounds, starts)
    size = np.bincount(piece, minlength=m)
    held = piece.astype(np.int64) << 32
    held |= words
    del words, piece
    held.sort()
    at = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
    tf = np.diff(np.append(at, len(held))).astype(np.int32)
    held = held[at]
    owner, word = (held >> 32).astype(np.int32), held.astype(np.uint32)
    of_piece = np.searchsorted(owner, np.arange(m + 1))
    weight = np.empty(len(held))
    for a in range(0, len(held), PART_IDS):
        c, n = slice(a, a + PART_IDS), tf[a : a + PART_IDS]
        weight[c] = idf[word[c] & (DF_CLASSES - 1)] * n * (K1 + 1) / (n + K1 * (1 - B + B * size[owner[c]] / max(mean_words, 1e-9)))
    # the words again, each with its pieces in order: a sort of word and place keeps equal words in place
    held &= 0xFFFFFFFF
    held <<= 32
    held |= np.arange(len(held))
    # unsigned, as words are
    held = held.view(np.uint64)
    held.sort()
    by_word = held.astype(np.uint32)
    held >>= np.uint64(32)
    new = np.append(True, held[1:] != held[:-1])[: len(held)]
    del held, at, tf
    edge = np.append(np.flatnonzero(new), len(new))
    run = np.empty(len(new), np.int32)
    run[by_word] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    post_piece, post_weight = owner[by_word], weight[by_word]
    del owner, weight, by_word, new
    used = np.zeros(m, bool)

    def neighbours(seed: int) -> np.ndarray:
        mine = np.arange(of_piece[seed], of_piece[seed + 1])
        mine = mine[edge[run[mine] + 1] - edge[run[mine]] > 1]
        if query_words is None or len(mine) <= query_words:
            return scored(mine)
        rarity = -idf[word[mine] & (DF_CLASSES - 1)]
        found = scored(mine[np.argpartition(rarity, query_words)[:query_words]])
        if not len(found):
            mine = mine[np.argsort(rarity, kind="stable")]
            for at in range(0, len(mine), query_words):
                found = scored(mine[at : at + query_words])
                if len(found):
                    break
        return found

    def scored(mine: np.ndarray) -> np.ndarray:
        """Unused pieces that have some of these words, in the order of their scores."""
        if not len(mine):
            return mine
        slots = np.concatenate([np.arange(a, b) for a, b in zip(edge[run[mine]], edge[run[mine] + 1], strict=True)])
        slots = slots[~used[post_piece[slots]]]
        found, at = np.unique(post_piece[slots], return_inverse=True)
        score = np.bincount(at, post_weight[slots])
        return found[np.lexsort((found, -score))]

    sequence, offset, following = 0, 0, 0
    queue: list[int] = []
    while True:
        if queue:
            p = queue.pop(0)
            if used[p]:
                continue
        else:
            while following < m and used[following]:
                following += 1
            if following == m:
                return
            p = following
        used[p] = True
        done, fresh = 0, offset == 0
        while done < lengths[p]:
            n = min(int(lengths[p]) - done, window - offset)
            yield p, done, n, sequence, offset
            done, offset = done + n, offset + n
            if offset == window:
                sequence, offset, queue, fresh = sequence + 1, 0, [], True
        if offset and (fresh or not queue):
            queue = list(neighbours(p))


def cut_shards(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.Table]:
    """A stream of rows in parts of ``pieces`` rows, about; what is left over at the end makes no small part of its own."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= 2 * pieces:
            table = pa.Table.from_batches(held)
            part, held, n = table.slice(0, pieces).combine_chunks(), table.slice(pieces).to_batches(), n - pieces
            table = batch = None  # else what was cut off stays too
            yield part
            part = None
    if n:
        table = pa.Table.from_batches(held)
        first = n if 2 * n <= 3 * pieces else n // 2
        yield table.slice(0, first).combine_chunks()
        if first < n:
            yield table.slice(first).combine_chunks()


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_pieces: int = SHARD_PIECES, query_words: int | None = QUERY_WORDS) -> DataFrame:
    """Pack ``docs`` (``doc_id, text``; other columns are ignored) into sequences of at most ``window`` ids.

    A document is its ids and then ``END_ID``; a null text is empty. Returns a row a piece: ``doc_id, start, length,
    doc_tokens, sequence_id, offset, ids`` with ``ids`` as little-endian unsigned 32-bit numbers. Each id of each
    row of ``docs`` lies in exactly one piece; offsets in a sequence run gapless from 0. Repeated rows and null ids
    are documents of their own. A text of any length is packed whole; a task holds one text, or two shards. An empty
    table gives an empty result.
    """
    path = path or default_path()
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind_of}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = materialise(tokenize(docs, path, window), "tokens")
    pieces = rows.where("sequence is null and counts is null")
    n, mean_words, df = document_frequencies(rows)
    shared = docs.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if encoder(path).size <= 1 << 16 else np.uint32
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), kind).astype("<u4")
                k = np.arange(len(ids) // window)
                start, sequence = batch.column("start")[i].as_py() + k * window, batch.column("sequence")[i].as_py() + k
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(np.full(len(k), i))), pa.array(start), pa.array(np.full(len(k), window)), pa.array(np.full(len(k), batch.column("doc_tokens")[i].as_py())),
                     pa.array(sequence), pa.array(np.zeros(len(k), np.int64)), pa.array([ids[a * window : (a + 1) * window].tobytes() for a in k], pa.binary())], names)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.forget()
        number = TaskContext.get().partitionId() << 36
        for table in cut_shards(batches, shard_pieces):
            ids, bounds = _unpack(table.column("ids").combine_chunks(), np.uint16 if enc.size <= 1 << 16 else np.uint32)
            base, tokens, docs_of = table.column("start").to_numpy(), table.column("doc_tokens").to_numpy(), table.column("doc_id").combine_chunks()
            del table
            out = np.array(list(fill_windows(ids, bounds, enc.word_starts(), shared.value, mean_words, window, query_words)), np.int64)
            for at in range(0, len(out), 512):
                p, start, length, sequence, offset = out[at : at + 512].T
                content = [ids[a : a + n].astype("<u4").tobytes() for a, n in zip(bounds[p] + start, length, strict=True)]
                yield pa.record_batch(
                    [docs_of.take(pa.array(p)), pa.array(base[p] + start), pa.array(length), pa.array(tokens[p]), pa.array(number + sequence), pa.array(offset), pa.array(content, pa.binary())], names)
            number += int(out[:, 3].max()) + 1

    shards = max(1, -(-n // shard_pieces))
    dealt = pieces.select("doc_id", "doc_tokens", "start", "ids", "key", "slot").repartitionByRange(min(shards, MAX_PARTITIONS), "key", "slot")
    packed = dealt.sortWithinPartitions("key", "slot").mapInArrow(tidied(shard), schema)
    return rows.where(F.col("sequence").isNotNull()).mapInArrow(tidied(whole), schema).unionByName(packed)
