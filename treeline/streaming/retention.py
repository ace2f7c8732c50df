"""Exact retention lists: a sample moves on to the next list when its span has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..constants import RETENTION


def cascade(samples, levels=RETENTION) -> list[list[tuple[int, int]]]:
    """The lists of (seconds, value), oldest first, after all samples in order.

    A list that is full hands its oldest sample on; the next list takes it if it is
    at least its own span later than the last one it took.
    """
    lists: list[list[tuple[int, int]]] = [[] for _ in levels]
    for s in samples:
        for keep, (slots, span) in zip(lists, levels, strict=True):
            if keep and s[0] - keep[-1][0] < span:
                break
            keep.append(s)
            if len(keep) <= slots:
                break
            s = keep.pop(0)
    return lists


def exact(samples: DataFrame) -> DataFrame:
    """(server, level, us, value) of samples (server, us, event_id, value): a server's lists hold 114 samples at most."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            pdf = pdf.sort_values(["us", "event_id"])
            lists = cascade(list(zip((pdf.us // 1_000_000).tolist(), pdf.value.tolist(), strict=True)))
            rows = [(int(pdf.server.iloc[0]), i, t * 1_000_000, v) for i, keep in enumerate(lists) for t, v in keep]
            yield pd.DataFrame(rows, columns=["server", "level", "us", "value"])

    return samples.groupBy("server").applyInPandas(lambda pdf: next(run(iter([pdf]))), "server long, level int, us long, value long")
