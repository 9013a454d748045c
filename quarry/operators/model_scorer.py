"""A reranking model as a column: loaded once a worker, fed in batches of pairs of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Models of this Python worker, by name.
_LOADED: dict[str, object] = {}


class PairTooLong(ValueError):
    """A question and a passage do not fit the model together; cutting one would lose content."""


def loaded(name: str, load: Callable[[], object]):
    """The worker's model of this name, loaded when it is first asked for."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def batches(lengths: list[int], size: int) -> Iterator[list[int]]:
    """Places of the pairs, the longest first, in batches of at most size."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for i in range(0, len(order), size):
        yield order[i : i + size]


def model_scorer(name: str, load: Callable[[], object], query: Column, passage: Column, batch: int = 16, limit: int = 512) -> Column:
    """The model's score of each (query, passage) as a double.

    load() gives an object with count(queries, passages), the tokens of each pair, and score(queries, passages), a
    number for each; it is called once in each Python worker, which keeps the model under `name` for later tasks.
    Pairs are counted first and sorted by their counts, so that a batch of at most `batch` is padded little. A pair of
    over `limit` tokens, a null in it, and a score that is missing or no finite number fail the job.
    """

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in parts:
            model = loaded(name, load)
            q, p = queries.tolist(), passages.tolist()
            if any(x is None for x in (*q, *p)):
                raise ValueError("a question or a passage is null")
            counts = list(model.count(q, p)) if q else []
            if counts and max(counts) > limit:
                raise PairTooLong(f"a question and a passage have {max(counts)} tokens together, over {limit}")
            out = [float("nan")] * len(q)
            for at in batches(counts, batch):
                found = list(model.score([q[i] for i in at], [p[i] for i in at]))
                if len(found) != len(at):
                    raise ValueError(f"the model gave {len(found)} scores for {len(at)} pairs")
                for i, s in zip(at, found):
                    out[i] = float(s)
            if any(s != s or abs(s) == float("inf") for s in out):
                raise ValueError("the model gave a score that is no finite number")
            yield pd.Series(out, dtype="float64")

    return scored(query, passage)
