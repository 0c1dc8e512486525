"""Functions for SQL users: lesions of a point set, its hull, and classifiers of one's own.

    register(spark)
    SELECT * FROM lesions(TABLE(SELECT case_id, tooth_id, x, y FROM decay) PARTITION BY (case_id, tooth_id))
    SELECT case_id, hull(x, y) FROM pixels GROUP BY case_id

A call of a table function holds one partition of its table, as the hull holds one group: the pixels of a mask, which an image bounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import PandasUDFType, pandas_udf, udtf

from ..operators import pixels

LESIONS = "case_id int, tooth_id string, lesion_idx int, size int, x int, y int"
SURFACE = "case_id int, tooth_id string, surface string, angle double, details map<string,string>"
#: A classifier takes a tooth, its pixels and its decay, and gives a surface, an angle, and details.
Classifier = Callable[[str, list[tuple[int, int]], list[tuple[int, int]]], tuple[str, float, dict]]


def lesions_of(radius2: int = 4, least: int = 1) -> type:
    """A table function: pixels (case_id, tooth_id, x, y) of one tooth with the number and size of their cluster. Clusters are
    numbered from 0 in the order of their first pixels; those of fewer than `least` pixels are left out. Pixels with a null coordinate are
    skipped, repeated ones count once."""
    near = pixels.offsets(radius2)

    class Lesions:
        def __init__(self) -> None:
            self.points: dict[tuple[int, int], None] = {}
            self.key: tuple | None = None

        def eval(self, row: Row) -> None:
            self.key = row["case_id"], row["tooth_id"]
            if row["x"] is not None and row["y"] is not None:
                self.points[row["y"], row["x"]] = None

        def terminate(self) -> Iterator[tuple]:
            first = pixels.first_pixels(self.points, near)
            sizes = Counter(first.values())
            number = {p: i for i, p in enumerate(sorted(p for p, n in sizes.items() if n >= least))}
            for (y, x), p in first.items():
                if p in number:
                    yield (*self.key, number[p], sizes[p], x, y)

    return udtf(Lesions, returnType=LESIONS)


def classifier(f: Classifier) -> type:
    """A table function: the surface that f gives one tooth, from rows (case_id, tooth_id, x, y, decay). f runs once for each
    tooth; where it fails, the surface is Other and details hold the error. Teeth without decay give no row."""

    class Classified:
        def __init__(self) -> None:
            self.key: tuple | None = None
            self.tooth: list[tuple[int, int]] = []
            self.ill: list[tuple[int, int]] = []

        def eval(self, row: Row) -> None:
            self.key = row["case_id"], row["tooth_id"]
            self.tooth.append((row["x"], row["y"]))
            if row["decay"]:
                self.ill.append((row["x"], row["y"]))

        def terminate(self) -> Iterator[tuple]:
            if not self.ill:
                return
            try:
                surface, angle, details = f(self.key[1], self.tooth, self.ill)
                yield (*self.key, surface, float(angle), {str(k): str(v) for k, v in details.items()})
            except Exception as failed:  # whatever a user's function may raise
                yield (*self.key, "Other", 0.0, {"error": repr(failed)})

    return udtf(Classified, returnType=SURFACE)


def hull_of(x: pd.Series, y: pd.Series) -> list[dict]:
    known = x.notna() & y.notna()
    return [{"x": a, "y": b} for a, b in pixels.hull_corners(zip(x[known].astype(int).tolist(), y[known].astype(int).tolist(), strict=True))]


def register(spark: SparkSession, classifiers: dict[str, Classifier] | None = None, radius2: int = 4, least: int = 1) -> None:
    """Makes lesions, hull and the given classifiers known to the session's SQL."""
    spark.udtf.register("lesions", lesions_of(radius2, least))
    spark.udf.register("hull", pandas_udf(hull_of, "array<struct<x: int, y: int>>", PandasUDFType.GROUPED_AGG))
    for name, f in (classifiers or {}).items():
        spark.udtf.register(name, classifier(f))
