"""Plug points for batch models: an analyzer, a span finder, an embedding model. One bad text costs its own row only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.runtime import arrow_batches


def isolated(model: Callable[[list], list], batch: list) -> list[tuple[object, str | None]]:
    """``(result, None)`` a text, or ``(None, error's name)`` for those that fail.

    A batch that fails, or gives too few or too many results, is halved, down to the text. Halves that work are done in
    one call each, so a bad text costs as many more calls as the batch can be halved, twice.
    """
    if not batch:
        return []
    try:
        out = list(model(batch))
        if len(out) != len(batch):
            raise ValueError("a model gives one result a text")
        return [(x, None) for x in out]
    except Exception as e:  # noqa: BLE001  a model's failure is data here
        if len(batch) == 1:
            return [(None, type(e).__name__)]
    half = len(batch) // 2
    return isolated(model, batch[:half]) + isolated(model, batch[half:])


def analyze(df: DataFrame, analyzer: Callable[[list[str | None]], list[dict | None]], schema: str, key: str = "report_id", text: str = "text") -> DataFrame:
    """``(key, analysis, analysis_error)`` by a batch analyzer that gives a dict of ``schema``'s fields a text, or None.

    A text that it fails on has a null analysis and the error's name. Results that don't fit the schema fail likewise.
    """
    arrow_batches(df.sparkSession)
    from pyspark.sql.types import StructType

    fields = [f.name for f in StructType.fromDDL(schema)]

    def checked(batch: list[str | None]) -> list[dict | None]:
        out = analyzer(batch)
        for r in out:
            if r is not None and not set(r) <= set(fields):
                raise KeyError("a field that the schema lacks")
        return out

    @F.pandas_udf(f"analysis struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in StructType.fromDDL(schema))}>, analysis_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = isolated(checked, [None if t is None or t != t else t for t in texts])
            rows = [(None if r is None else {f: r.get(f) for f in fields}, error) for r, error in found]
            yield pd.DataFrame({"analysis": pd.Series([r for r, _ in rows], dtype=object), "analysis_error": pd.Series([e for _, e in rows], dtype=object)})

    return df.select(key, run(text).alias("a")).select(key, "a.*")
