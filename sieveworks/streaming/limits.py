"""Token buckets and topic routing."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admitted(requests: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """Requests (key, at seconds, cost) with admitted, by a bucket that refills steadily.

    The rule is sequential in a key, so a key's requests are one task; keys must be of bounded size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        level, last, out = burst, None, []
        for at, cost in zip(pdf["at"], pdf["cost"], strict=True):
            level = min(burst, level + (at - last) * rate) if last is not None else level
            last = at
            out.append(cost <= level)
            level -= cost if out[-1] else 0
        return pdf.assign(admitted=out)[[key, "at", "cost", "admitted"]]

    return requests.select(key, F.col("at").cast("double").alias("at"), F.col("cost").cast("double").alias("cost")).groupBy(key).applyInPandas(run, f"{key} string, at double, cost double, admitted boolean")


def pattern(topic: str) -> str:
    """The regular expression of a dotted topic, in which * stands for one part and # for the rest."""
    return "^" + re.escape(topic).replace(r"\*", "[^.]+").replace(r"\#", ".*") + "$"


def routed(messages: DataFrame, topics: dict[str, str]) -> DataFrame:
    """Messages (key, ...) once for each subscriber whose topic matches their key."""
    hits = F.array_compact(F.array(*(F.when(F.rlike("key", F.lit(pattern(t))), F.lit(s)) for s, t in topics.items())))
    return messages.withColumn("subscriber", F.explode(hits))


def subscribed(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Runs every handler on every batch of a stream: fan-out with one read of the source."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        for handle in handlers.values():
            handle(batch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


