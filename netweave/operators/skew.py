"""Joins on keys of any frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is heavy if more than one row in so many has it; so there are fewer heavy keys than that.
HEAVY = 4096


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner", narrow: Column | None = None) -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row a key and, as ``count``, how many of ``total`` rows have that key.

    The heavy keys, fewer than ``HEAVY`` by their counts, are told apart by a hash, of which the driver gets that many
    numbers; their rows stay where they are and meet a broadcast. No key that is left has more than one row in
    ``HEAVY``, and these are exchanged by key. ``narrow``, a condition on ``keyed``, keeps wide rows out of the
    broadcast. ``how`` is ``inner`` or ``left_semi``; the result is the same as that of a plain join.
    """
    heavy = F.col(count) > total // HEAVY
    if narrow is not None:
        heavy = heavy & narrow
    spot = F.xxhash64(key)
    spots = sorted(r[0] for r in keyed.where(heavy).select(spot).distinct().collect())
    if not spots:
        return rows.join(keyed, key, how)
    # keys that share a hash with a heavy one go with it; they are light, so the broadcast stays small
    few = rows.where(spot.isin(spots)).join(F.broadcast(keyed.where(spot.isin(spots))), key, how)
    return few.unionByName(rows.where(~spot.isin(spots)).join(keyed.where(~spot.isin(spots)), key, how))
