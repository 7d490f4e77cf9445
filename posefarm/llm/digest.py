"""SHA-256 of text that comes in ordered runs, however long a group's text is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posefarm.llm.store import stored


def run_digests(runs: DataFrame, keys: Sequence[str], texts: Sequence[str], between: str = "") -> DataFrame:
    """The lowercase digest, under the name of each column in ``texts``, of a group's
    runs joined by ``between`` in order of the column ``run``.

    Keys are longs and may be null.  A group of one run is digested where it stands.  The
    runs of a longer group are sorted and streamed through the hash, so a task holds one
    run at a time.  The runs are read several times, so pass a stored table or a plain
    projection of one.
    """
    long = stored(runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys), "long")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    one = runs.alias("r").join(long.alias("m"), same, "left_anti").select(*keys, *[F.sha2(t, 256).alias(t) for t in texts])
    return one.unionByName(streamed_digests(runs.alias("r").join(long.alias("m"), same, "left_semi"), keys, texts, between))


def streamed_digests(many: DataFrame, keys: Sequence[str], texts: Sequence[str], between: str = "") -> DataFrame:
    """:func:`run_digests` by sorting all runs of a group into one stream."""
    schema = ", ".join([f"`{k}` long" for k in keys] + [f"`{t}` string" for t in texts])

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def closed() -> pd.DataFrame:
            row = {k: pd.array([v], "Int64") for k, v in zip(keys, now)} | {t: [h.hexdigest()] for t, h in zip(texts, held)}
            return pd.DataFrame(row)

        for frame in frames:
            ids = [frame[k].astype("Int64").tolist() for k in keys]
            for *key, values in zip(*ids, zip(*[frame[t] for t in texts])):
                key = [None if k is pd.NA else k for k in key]
                if now != key:
                    if now is not None:
                        yield closed()
                    now, held = key, [hashlib.sha256() for _ in texts]
                elif between:
                    for h in held:
                        h.update(between.encode())
                for h, v in zip(held, values):
                    h.update(v.encode())
        if now is not None:
            yield closed()

    dealt = many.select(*keys, "run", *texts).repartition(*keys).sortWithinPartitions(*keys, "run")
    return dealt.mapInPandas(stream, schema)
