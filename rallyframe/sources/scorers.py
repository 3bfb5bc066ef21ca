"""Hooks for models that this library does not ship: a scorer is loaded once in each task and given batches.

`loader()` returns a function from a pandas frame to a pandas frame of the declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
_registry: dict[str, Callable[[], Scorer]] = {}


def register(name: str, loader: Callable[[], Scorer]) -> None:
    _registry[name] = loader


def stub() -> Scorer:
    """Without weights: no ball anywhere."""
    return lambda pdf: pd.DataFrame({"clip": pdf["clip"], "frame": pdf["frame"], "found": False, "u": None, "v": None, "confidence": 0.0, "reason": "stub-no-weights"})


register("stub", stub)
DETECTED = "clip string, frame int, found boolean, u double, v double, confidence double, reason string"


def score_frames(frames: DataFrame, method: str = "stub", schema: str = DETECTED) -> DataFrame:
    loader = _registry.get(method, stub)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = loader()
        for pdf in batches:
            yield scorer(pdf)

    return frames.mapInPandas(run, schema)


def score_clips(frames: DataFrame, method: str, in_frames: int = 3, schema: str = DETECTED, chunk: int = 1000) -> DataFrame:
    """A model of several frames on clips cut in chunks: the scorer is given a chunk's rows in order, before them the in_frames - 1
    rows of the clip that it needs for the first, and gives a row for each (`clip` and `frame` among its columns); those of
    the rows before are dropped. So a clip of any length is scored by many tasks as it would be in one."""
    before = in_frames - 1
    if chunk < max(1, before):
        raise ValueError("a chunk must hold as many frames as a score looks back")
    loader = _registry.get(method, stub)
    place = F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1
    own = F.floor(F.col("_place") / chunk)
    also = F.when(F.col("_place") % chunk >= chunk - before, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = frames.withColumn("_place", place).withColumn("_chunk", F.explode(also)).withColumn("_before", F.col("_chunk") != own)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable", ignore_index=True)
        if pdf["_before"].all():  # the clip ended with the chunk before
            return loader()(pdf.drop(columns=["_place", "_chunk", "_before"])).iloc[:0]
        rows = loader()(pdf.drop(columns=["_place", "_chunk", "_before"]))
        return rows[~rows["frame"].isin(set(pdf.loc[pdf["_before"], "frame"]))]

    return dealt.groupBy("clip", "_chunk").applyInPandas(run, schema)


def mark_warmup(detected: DataFrame, in_frames: int = 3) -> DataFrame:
    """A model of several frames says nothing until it has them all."""
    n = F.row_number().over(Window.partitionBy("clip").orderBy("frame"))
    early = F.col("_n") < in_frames
    return detected.withColumn("_n", n).withColumns({"found": F.col("found") & ~early, "reason": F.when(early, "warmup").otherwise(F.col("reason"))}).drop("_n")
