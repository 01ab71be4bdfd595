"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys. Each source's key range is cut into equal intervals (the keys are uniform, so
the intervals are balanced without sampling); an interval is sorted by itself, the totals of the intervals give
each one its offset, and the two sums together are the distributed prefix sum of the source. A source of any
share of all rows is thereby spread over as many tasks as its rows ask for: large sources find their target by a
broadcast of few rows, and are exchanged by interval alone. Texts are read twice, once for a slim table of sizes from
which sources and intervals are summed, and once to give the rows what is taken of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netweave.llm.names import own_names
from netweave.operators.skew import join_counted
from netweave.plans.session import materialise

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Splits behind a word, so that the pieces joined again are the text itself.
_AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
#: Rows that one interval of a source is meant to hold.
INTERVAL_ROWS = 2_000
#: The table of targets is broadcast up to this size; of a larger one only the sources of many rows are.
BROADCAST_BYTES = 16 << 20
DEFAULT_WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A name that is never null and sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = DEFAULT_WEIGHTS, max_epochs: float = 3.0) -> DataFrame:
    """``sizes`` (``__src, __size``, one row a source) with ``__target``.

    Sources in code-point order, null last, take the weights in turn. They share the sum of all sizes in
    proportion to their weights, but no source gets more than ``max_epochs`` times its size; what that leaves is
    shared again among the others. That fixed point has a closed form: order the sources by cap over weight; a
    source is capped if its cap lies below the share it would get once all sources before it have had theirs.
    """
    ranked = sizes.withColumn("__i", F.row_number().over(W.orderBy("__src")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", weight).withColumn("__cap", F.col("__size") * F.lit(float(max_epochs)))
    order = W.orderBy(F.col("__cap") / F.col("__w"), "__i")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    shares = (
        ranked.withColumn("__total", F.sum("__size").over(everything).cast("double"))
        .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__open", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
        .withColumn("__capped", F.col("__cap") * F.col("__open") < F.col("__left") * F.col("__w"))
    )
    # the capped sources are a prefix of that order; what follows shares what they leave
    taken = F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__w"))).over(everything)
    share = F.when(F.col("__capped"), F.col("__cap")).otherwise((F.col("__total") - taken) * F.col("__w") / open_weight)
    return shares.select("__src", "__size", share.alias("__target"))


@own_names
def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = DEFAULT_WEIGHTS,
    max_epochs: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    interval_rows: int = INTERVAL_ROWS,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` (columns of these names are replaced).

    ``size`` is the number of words of the text (null: 0), ``source_size`` and ``target`` belong to the row's
    source, ``taken`` is how many words of the row the mix takes, whole repeats counted. In the order of a hash of
    id and seed, a source is run through as often as its target holds it; the last, partial run stops at the exact
    word, so a source's ``taken`` sum to its target rounded down. Null ids and null sources are values like others;
    rows that share an id are ordered by hashes of text and row, so reruns agree and the rows that may still change places
    are the same. A text of any length counts whole. An empty table gives an empty result.
    """
    made = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c.lower() not in made]
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    ranked = {"size": word_count(F.col(text_col)), "__src": _source_key(F.col(source_col)), "__key": key}
    # 52 leading bits of the key as a number in [0, 1), which a double holds exactly
    place = F.conv(F.substring("__key", 1, 13), 16, 10).cast("double") / float(1 << 52)
    slim = materialise(docs.select(*[c.alias(n) for n, c in ranked.items()]), "sizes")
    sizes = slim.groupBy("__src").agg(F.sum("size").alias("__size"), F.count("*").alias("__rows"))
    plan = source_targets(sizes.select("__src", "__size"), weights, max_epochs)
    plan = plan.withColumnsRenamed({"__size": "source_size", "__target": "target"}).join(sizes.select("__src", "__rows"), "__src")
    plan = materialise(plan.withColumn("__parts", F.ceil(F.col("__rows") / interval_rows)), "targets")
    held = plan.agg(F.sum("__rows").alias("rows"), F.sum(F.octet_length("__src") + 64).alias("bytes")).first()

    def planned(rows: DataFrame) -> DataFrame:
        """Rows with what their source gets, and the interval they fall into; no source's rows are brought together."""
        if (held["bytes"] or 0) <= BROADCAST_BYTES:
            found = rows.join(F.broadcast(plan), "__src")
        else:
            found = join_counted(rows, plan, "__src", "__rows", held["rows"], narrow=F.octet_length("__src") < 1024)
        return found.withColumn("__part", F.floor(place * F.col("__parts")).cast("long"))

    totals = planned(slim).groupBy("__src", "__part").agg(F.sum("size").alias("__sum"))
    offsets = totals.select(
        "__src",
        "__part",
        (F.sum("__sum").over(W.partitionBy("__src").orderBy("__part")) - F.col("__sum")).alias("__offset"),
    )
    inside = W.partitionBy("__src", "__part").orderBy("__key", "size", "__tie1", "__tie2").rowsBetween(W.unboundedPreceding, -1)
    ties = {"__tie1": F.xxhash64(text_col), "__tie2": F.xxhash64(*kept)}
    cut = planned(docs.select(*kept, *[c.alias(n) for n, c in (ranked | ties).items()]))
    placed = cut.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, ["__src", "__part"]
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("__offset") - F.col("__in")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))


@own_names
def expand_mix(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the mix stands for: a row for each whole repeat, and one cut behind its last word.

    Rows of which nothing is taken go; ``n_chars`` follows a cut text where the table has it.
    """
    names = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    pieces = F.when(whole > 0, F.array_repeat(F.lit(0), whole)).otherwise(F.array().cast("array<int>"))
    pieces = F.concat(pieces, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = mixed.where("taken > 0").withColumn("__words", F.explode(pieces))
    cut = F.concat_ws("", F.slice(F.split(F.col(text_col), _AFTER_WORD), F.lit(1), F.col("__words")))
    text = F.when(F.col("__words") > 0, cut).otherwise(F.col(text_col))
    out = out.withColumn(text_col, text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__words") > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(mixed.schema["n_chars"].dataType))
    return out.select(*names)
