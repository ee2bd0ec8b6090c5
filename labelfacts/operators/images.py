"""Images through numpy in Arrow batches. Tables have image_id, width, height, channels, data; the pixel functions run once a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import pixels as px


def apply(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each image replaced by f of it; an image without pixels afterwards has no data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            made = [f(px.decode(r.data, r.width, r.height, r.channels)) for r in t.itertuples()]
            yield t.assign(height=[m.shape[0] for m in made], width=[m.shape[1] for m in made], channels=[1 if m.ndim == 2 else m.shape[2] for m in made], data=[np.ascontiguousarray(m).tobytes() for m in made])

    return images.mapInPandas(run, images.schema)


def processed(images: DataFrame, width: int = 1000, mode: str = "binary", cutoff: float | None = 150, kernel: int = 1) -> DataFrame:
    return apply(images, lambda m: px.process(m, width, mode, cutoff, kernel))


def enlarged(images: DataFrame, least: int = 1000, factor: int = 2) -> DataFrame:
    """Images narrower than ``least`` enlarged; others don't go to Python."""
    return images.where(images["width"] >= least).unionByName(apply(images.where(images["width"] < least), lambda m: px.resize(m, m.shape[1] * factor)))


def lines(images: DataFrame, votes: int = 175) -> DataFrame:
    """(image_id, line_id, x1, y1, x2, y2): rules of a table, horizontal ones first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for r in t.itertuples():
                m = px.decode(r.data, r.width, r.height, r.channels)
                found = px.table_lines(m) + px.table_lines(m, True)
                if found:
                    yield pd.DataFrame(found, columns=["x1", "y1", "x2", "y2"]).assign(image_id=r.image_id, line_id=range(len(found)))[["image_id", "line_id", "x1", "y1", "x2", "y2"]]

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(run, "image_id string, line_id int, x1 int, y1 int, x2 int, y2 int")


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, crop, width, height, channels, data): parts of images by (image_id, crop, x0, y0, x1, y1); each image is moved once."""

    def cut(t: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in t.itertuples():
            m = px.decode(r.data, r.width, r.height, r.channels)
            for q in b.itertuples():
                part = np.ascontiguousarray(px.crop(m, q.x0, q.y0, q.x1, q.y1))
                if part.size:
                    rows.append((r.image_id, q.crop, part.shape[1], part.shape[0], r.channels if m.ndim == 2 else 3, part.tobytes()))
        return pd.DataFrame(rows, columns=["image_id", "crop", "width", "height", "channels", "data"])

    return images.groupBy("image_id").cogroup(boxes.groupBy("image_id")).applyInPandas(cut, "image_id string, crop int, width int, height int, channels int, data binary")
