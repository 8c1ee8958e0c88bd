"""Batched scoring by a model that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32
_SCHEMA = "image_id long, outcome string, detections array<struct<class_id:int,confidence:double,bbox:array<double>>>"


def scored(images: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], list[list[dict]]]], batch: int = BATCH) -> DataFrame:
    """image_id, outcome (reviewed or failed) and detections of each image. make_scorer runs once a task;
    its scorer gets batch rows and returns a list of detections for each. A batch that fails is scored
    row by row, so that only images that fail themselves are failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    out = [("reviewed", d) for d in scorer(part)]
                except Exception:  # noqa: BLE001  a user's model may raise anything
                    out = []
                    for k in range(len(part)):
                        try:
                            out.append(("reviewed", scorer(part.iloc[k : k + 1])[0]))
                        except Exception:  # noqa: BLE001
                            out.append(("failed", []))
                yield pd.DataFrame({"image_id": part["image_id"].to_numpy(), "outcome": [o for o, _ in out], "detections": [d for _, d in out]})

    return images.mapInPandas(run, _SCHEMA)


def detection_rows(found: DataFrame) -> DataFrame:
    """Detections of scored images as rows of the detections table, with reproducible ids."""
    from kerbgrid.functions.lookups import class_name

    rows = found.filter("outcome = 'reviewed'").select("image_id", F.posexplode("detections").alias("place", "d"))
    return rows.select(F.sha2(F.concat_ws("-", "image_id", "place"), 256).alias("detection_id"), "image_id", class_name(F.col("d.class_id")).alias("label"), F.col("d.confidence").alias("confidence"), F.to_json("d.bbox").alias("bbox"), F.lit(0).alias("manual_reviewed")).filter("label is not null")
