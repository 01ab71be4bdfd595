"""Line dedup: blocks of lines that an earlier document holds go from the later one.

Lines become 64-bit hashes. From each line on, and back from each line, the shortest run of lines that is as long as a
block is hashed too. Runs are what documents are found by, as rare as a block and not as common as a line, so there is
no limit to how many may hold one: a document is paired with the first holder of each of its runs. A block of any length
is covered by such runs, each of which lies inside it, so for every block that an earlier text holds there is a pair
that holds it. Runs, and pairs, grow with the lines, two a line at most.

A pair is aligned by patience diff over the runs that brought it together: runs that stand once on both sides, in a
longest increasing order, are anchors; between anchors the search recurs. Only those runs travel, not the texts, so a
first holder of any length that many others are paired with costs them no more than what they share. Blocks that stand
in another order than in the first holder, or a second time, don't fit one alignment; they are aligned each for itself,
as blocks that moved. Exact copies don't enter the runs at all: all of their lines are their first copy's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from netweave.operators.skew import join_counted
from netweave.llm.names import own_names
from netweave.llm.words import mix, running_hash, tidied
from netweave.plans.session import materialise

#: A block goes if it has so many words in all.
BLOCK_WORDS = 10


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given in order of the first, in which the second increases too."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            ends.append(n)
        else:
            tails[at], ends[at] = b, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, increasing in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place])
        if anchors:
            for i, j in anchors:
                matched.append((i, j))
                todo.append((a0, i, b0, j))
                a0, b0 = i + 1, j + 1
            todo.append((a0, a1, b0, b1))
            continue
        if not in_a.keys() & in_b.keys():
            continue
        spots: dict[int, list[int]] = {}
        for j in range(b0, b1):
            spots.setdefault(b[j], []).append(j)
        reach = b0
        for i in range(a0, a1):
            js = spots.get(a[i])
            if js:
                at = bisect_left(js, reach)
                if at < len(js):
                    matched.append((i, js[at]))
                    reach = js[at] + 1
    return sorted(matched)


def aligned_lines(runs: np.ndarray, moved: bool = True) -> np.ndarray:
    """Lines of a later text that its alignment with one first holder takes out, in order.

    ``runs``: rows ``begin, end, other`` of the runs that both hold, ``other`` being where the run begins in the holder.
    With ``moved``, the runs that the alignment leaves over, as they stand in another order or a second time, count too.
    """
    mine = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    # a run is named by where it stands in the holder; both sides are sequences of such names
    name = mine[:, 2] * (1 << 32) + (mine[:, 1] - mine[:, 0])
    held, where = np.unique(name, return_inverse=True)
    fit = patience_matches(where.tolist(), list(range(len(held))))
    if not moved:
        mine = mine[[i for i, _ in fit]]
    gone = np.zeros(int(mine[:, 1].max()) + 1, np.int64)
    np.add.at(gone, mine[:, 0], 1)
    np.add.at(gone, mine[:, 1], -1)
    return np.flatnonzero(np.cumsum(gone) > 0)


def shortest_runs(lines: np.ndarray, words: np.ndarray, bounds: np.ndarray, block_words: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, begin, end`` of the shortest runs of ``block_words`` or more from each line on and back from each line.

    ``bounds`` says where each text's lines begin (one more than texts); no run leaves its text, and none comes twice.
    A block is covered by those inside it: a line from which the run would leave the block has fewer than
    ``block_words`` to the block's end, so the run back from that end takes it in.
    """
    n, count = len(lines), np.diff(bounds)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + block_words, "left")
    begin = np.searchsorted(total, total[1:] - block_words, "right") - 1
    on, back = end <= np.repeat(bounds[1:], count), begin >= np.repeat(bounds[:-1], count)
    runs = np.unique(np.concatenate([at[on] * (n + 1) + end[on], begin[back] * (n + 1) + at[back] + 1]))
    begin, end = runs // (n + 1), runs % (n + 1)
    sums, scale = running_hash(lines)
    return mix((sums[end] - sums[begin]) * scale[begin] + (end - begin).astype(np.uint64)), begin, end


def _tidy_lines(text: Column) -> Column:
    """The lines of a text as they are compared: blanks at their ends don't count, nor how many stand in a row."""
    return F.transform(F.split(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), "\n"), lambda s: F.trim(s))


@own_names
def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, moved: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cut and ``n_lines, n_removed`` (columns of these names are replaced).

    Lines end at ``\\n``. They are compared without the blanks (space, tab, ``\\r``, form feed, vertical tab) at their
    ends, and blanks in a row count as one, so copies with other line ends are copies; a word is a run of other
    characters. Lines that stay are given as they came in. Documents are in the order of their id, null last; rows with
    the same id are ordered by a hash of id and text, and of rows that agree in both one counts as the first. Whether a
    block goes is judged on the texts as they came in. A null text has no lines and stays null; a text of which nothing
    is left is empty. With ``moved``, a line goes exactly if it is part of a block that some earlier text holds; without,
    a block must also fit the alignment with the first holder. Ids may be null or repeat. A text of any length is taken whole: its lines' hashes, 12 bytes a line, are a
    row. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    text = F.col(text_col)
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    lines = F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    order = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), "__k")
    words = lambda s: F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)
    rows = (
        docs.where(text.isNotNull() & (text != "")).select(F.col(id_col), _tidy_lines(text).alias("__l"), F.md5(text).alias("tk"), key.alias("__k"))
        .select("__k", "tk", order.alias("ord"), F.transform("__l", lambda s: F.xxhash64(s)).alias("h"), F.transform("__l", words).alias("w"))
    )
    rows = materialise(rows, "lines")
    # one row for each text, its first copy; and how often each row repeats
    texts = rows.groupBy("tk").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.any_value("h").alias("h"), F.any_value("w").alias("w"))
    run = T.StructType().add("h", T.LongType()).add("begin", T.IntegerType()).add("end", T.IntegerType())
    with_runs = T.StructType([texts.schema[c] for c in ("tk", "ord", "n")]).add("runs", T.ArrayType(run))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lines, words = (part.column(c) for c in ("h", "w"))
                bounds = lines.offsets.to_numpy().astype(np.int64)
                bounds -= bounds[0]
                hashes, begin, end = shortest_runs(lines.flatten().to_numpy().view(np.uint64), words.flatten().to_numpy(), bounds, block_words)
                of_text = np.searchsorted(begin, bounds)
                shift = np.repeat(bounds[:-1], np.diff(of_text))
                found = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array((begin - shift).astype(np.int32)), pa.array((end - shift).astype(np.int32))], ["h", "begin", "end"])
                yield pa.record_batch([*(part.column(c) for c in ("tk", "ord", "n")), pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), found)], ["tk", "ord", "n", "runs"])

    texts = materialise(texts.mapInArrow(tidied(find), with_runs), "texts").withColumn("k", F.col("ord.__k"))
    size = texts.agg(F.sum(F.size("runs")).alias("runs"), F.sum("n").alias("rows")).first()
    held = texts.select("k", "ord", F.explode("runs").alias("r")).select("k", "ord", "r.*")
    # the first holder of each run, and where it holds it
    shared = held.groupBy("h").agg(F.min(F.struct("ord", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared.select("h", F.col("first.ord.__k").alias("f"), F.col("first.begin").alias("other"), "n"), "shared")
    pairs = join_counted(held.select("h", "k", "begin", "end"), shared, "h", "n", size["runs"] or 0).where("k <> f")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for runs in batch.column("runs"):
                place = np.stack([runs.values.field(c).to_numpy() for c in ("begin", "end", "other")], 1).astype(np.int64)
                holder = np.unique(runs.values.field("f").to_numpy(zero_copy_only=False), return_inverse=True)[1]
                order = np.argsort(holder, kind="stable")
                edge = np.flatnonzero(np.diff(holder[order])) + 1
                gone.append(np.unique(np.concatenate([aligned_lines(place[x], moved) for x in np.split(order, edge)])).astype(np.int32))
            yield pa.record_batch([batch.column("k"), pa.array(gone, pa.list_(pa.int32()))], ["k", "gone"])

    cut = pairs.groupBy("k").agg(F.collect_list(F.struct("f", "begin", "end", "other")).alias("runs"))
    cut = cut.mapInArrow(tidied(align), "k string, gone array<int>")
    # copies lose all lines if the text is as long as a block; of rows that are one and the same, the first doesn't
    total = F.aggregate("w", F.lit(0), lambda s, x: s + x)
    again = texts.where("n > 1").select("tk", F.col("k").alias("first_k"), "n")
    long_rows = rows.where(total >= block_words).select("tk", "__k")
    copies = (
        join_counted(long_rows, again, "tk", "n", size["rows"] or 0)
        .groupBy(F.col("__k").alias("k")).agg((F.max("__k") == F.max("first_k")).alias("is_first"), F.count("*").alias("n"))
        .where("not is_first or n > 1")
    )
    decided = cut.join(copies, "k", "full_outer")
    decided = decided.select(F.col("k").alias("__k"), F.col("gone").alias("__held"), F.col("is_first").alias("__first"), F.col("n").alias("__n"))
    marked = docs.select(*kept, key.alias("__k")).join(decided, "__k", "left")
    # rows of one key: the first of them is what the runs speak of, the others are copies of it; the join has
    # brought them together already, so counting them costs no further exchange
    again = F.row_number().over(W.partitionBy("__k").orderBy("__k")) > 1
    both = marked.withColumn("__copy", F.coalesce(~F.col("__first") | ((F.col("__n") > 1) & again), F.lit(False)))
    mask = F.when(F.col("__copy"), F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.coalesce("__held", F.array().cast("array<int>")))
    gone_map = F.map_from_entries(F.transform(F.col("__gone"), lambda i: F.struct(i, F.lit(True))))
    left = F.filter(lines, lambda s, i: ~F.map_contains_key(F.col("__map"), i))
    both = both.withColumn("__gone", mask).withColumn("__map", F.when(F.size("__gone") > 0, gone_map))
    n_lines, n_removed = F.size(lines).cast("long"), F.size("__gone").cast("long")
    new = F.when(F.size("__gone") == 0, text).when(F.size("__gone") == F.size(lines), F.lit("")).otherwise(F.array_join(left, "\n"))
    return both.select(*[new.alias(c) if c == text_col else c for c in kept], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
