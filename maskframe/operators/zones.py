"""Zone votes: rules from relative lesion pixels (pixels.relative) to a surface for each lesion.

Every rule is one aggregation of conditional counts. On ties the first of Mesial, Occlusal, Distal wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import settled
from .pixels import KEYS

#: Bounds of the side zones.
LEFT, RIGHT = 0.40, 0.60


def winner(m: Column, o: Column, d: Column) -> Column:
    return F.when((m >= o) & (m >= d), "Mesial").when(o >= d, "Occlusal").otherwise("Distal")


def _sides(right_is_mesial: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """(mesial, distal) from what the left and right sides have."""
    return F.when(right_is_mesial, right).otherwise(left), F.when(right_is_mesial, left).otherwise(right)


def _votes(rel: DataFrame, left: Column, centre: Column, right: Column, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    g = rel.groupBy(*keys).agg(F.max(F.col("quadrant").isin(1, 4)).alias("r"), F.count(F.lit(1)).alias("n"), F.sum(left).alias("l_"), F.sum(centre).alias("occlusal"), F.sum(right).alias("r_"), *(v.alias(k) for k, v in (more or {}).items()))
    m, d = _sides(F.col("r"), F.col("l_"), F.col("r_"))
    return g.withColumn("mesial", m).withColumn("distal", d).drop("r", "l_", "r_")


def _named(votes: DataFrame, keys: list[str]) -> DataFrame:
    return votes.withColumn("surface", winner(F.col("mesial"), F.col("occlusal"), F.col("distal"))).select(*keys, "n", "mesial", "occlusal", "distal", "surface")


def _is(c: Column) -> Column:
    return c.cast("int")


def x_thirds(rel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    x = F.col("rel_x")
    return _named(_votes(rel, _is(x < LEFT), _is(x.between(LEFT, RIGHT)), _is(x > RIGHT), keys), keys)


def diagonal(rel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The box's diagonals split it into two sides and top and bottom."""
    dx, dy = F.col("ux") - 0.5, F.col("uy") - 0.5
    side = F.abs(dx) > F.abs(dy)
    return _named(_votes(rel, _is(side & (dx <= 0)), _is(~side), _is(side & (dx > 0)), keys), keys)


def biaxial(rel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """x_thirds; if more than half of the pixels are in the crown band, they count for Occlusal once more."""
    x, y = F.col("rel_x"), F.col("rel_y")
    crown = F.when(F.col("quadrant").isin(1, 2), y >= 0.70).otherwise(y <= 0.30)
    v = _votes(rel, _is(x < LEFT), _is(x.between(LEFT, RIGHT)), _is(x > RIGHT), keys, {"crown": F.count_if(crown)})
    return _named(v.withColumn("occlusal", F.col("occlusal") + F.when(F.col("crown") > F.col("n") * 0.5, F.col("crown")).otherwise(0)), keys)


def fuzzy(rel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each pixel votes for three focal points by inverse squared distance."""
    x, y = F.col("rel_x"), F.col("rel_y")
    crown = F.when(F.col("quadrant").isin(1, 2), 0.85).otherwise(0.15)
    near = lambda fx, fy: 1.0 / ((x - fx) ** 2 + (y - fy) ** 2 + 0.05)
    return _named(_votes(rel, near(F.lit(0.0), F.lit(0.5)), near(F.lit(0.5), crown), near(F.lit(1.0), F.lit(0.5)), keys), keys)


def lesion_zone(rel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The mean place of the whole lesion decides; places outside the box are not clipped."""
    g = rel.groupBy(*keys).agg(F.avg("ux").alias("x"), F.max(F.col("quadrant").isin(1, 4)).alias("r"))
    left, right = F.when(F.col("r"), "Distal").otherwise("Mesial"), F.when(F.col("r"), "Mesial").otherwise("Distal")
    return g.select(*keys, F.when(F.col("x") < LEFT, left).when(F.col("x") > RIGHT, right).otherwise("Occlusal").alias("surface"))


def multi_zone(rel: DataFrame, keys: list[str] = KEYS, presence: float = 0.05, band: float = 0.20) -> DataFrame:
    """An occlusal band in thirds (M, C, D), proximal sides, the rest; primary surface, zone label, fractions."""
    x, y = F.col("rel_x"), F.col("rel_y")
    inside = F.when(F.col("quadrant").isin(1, 2), y >= 1 - band).otherwise(y <= band)
    third = F.when(x < 1 / 3, "l").when(x > 2 / 3, "r").otherwise("c")
    g = rel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("quadrant").isin(1, 4)).alias("r"),
        *(F.count_if(inside & (third == t)).alias(f"o_{t}") for t in "lcr"), *(F.count_if(third == t).alias(f"a_{t}") for t in "lcr"),
        F.count_if(~inside & (x <= band)).alias("p_l"), F.count_if(~inside & (x >= 1 - band)).alias("p_r"),
    )
    n_m, n_d = _sides(F.col("r"), F.col("o_l"), F.col("o_r"))
    a_m, a_d = _sides(F.col("r"), F.col("a_l"), F.col("a_r"))
    g = g.withColumn("n_m", n_m).withColumn("n_c", F.col("o_c")).withColumn("n_d", n_d).withColumn("all_m", a_m).withColumn("all_d", a_d)
    occ, prox = F.col("n_m") + F.col("n_c") + F.col("n_d"), F.col("p_l") + F.col("p_r")
    g = g.withColumn("occ", occ).withColumn("prox", prox).withColumn("other", F.col("n") - occ - prox)
    primary = F.when((F.col("occ") >= F.col("prox")) & (F.col("occ") >= F.col("other")), "Occlusal").when(F.col("prox") >= F.col("other"), "Proximal").otherwise("Other")
    here = [S.ratio(F.col(c), F.col("occ")) >= presence for c in ("n_m", "n_c", "n_d")]
    fine = F.when((F.col("all_m") >= F.col("a_c")) & (F.col("all_m") >= F.col("all_d")), "Mesial").when(F.col("a_c") >= F.col("all_d"), "Occlusal").otherwise("Distal")
    return g.select(*keys, "n", "n_m", "n_c", "n_d", "p_l", "p_r", "other", primary.alias("primary_surface"), S.combined_zone(*here).alias("zone_label"), fine.alias("fine_surface"))


def centroid_rule(tooth: DataFrame, lesion: DataFrame, occlusal: float = 0.30, side: float = 0.25) -> DataFrame:
    """The lesion's centre in its rotated tooth's box: occlusal band by jaw first, then the sides, else Other."""
    from .pixels import relative

    g = relative(tooth, lesion).groupBy(*KEYS).agg(F.avg("ux").alias("x"), F.avg("uy").alias("y"), F.max("quadrant").alias("quadrant"))
    band = F.when(F.col("quadrant").isin(1, 2), F.col("y") >= 1 - occlusal).otherwise(F.col("y") <= occlusal)
    right = F.col("quadrant").isin(1, 4)
    return g.select(*KEYS, F.when(band, "Occlusal").when(F.col("x") <= side, F.when(right, "Distal").otherwise("Mesial")).when(F.col("x") >= 1 - side, F.when(right, "Mesial").otherwise("Distal")).otherwise("Other").alias("surface"))


VERSIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"x_thirds": x_thirds, "diagonal": diagonal, "biaxial": biaxial, "fuzzy": fuzzy, "lesion_zone": lesion_zone}


def sweep(rel: DataFrame, versions: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(keys, version, surface) of all versions, callables from relative pixels to surfaces. The pixels are made once, and read
    by each version."""
    rel = settled(rel)
    parts = [f(rel).select(*KEYS, F.lit(name).alias("version"), "surface") for name, f in (versions or VERSIONS).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def long_votes(votes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row for each zone with its share."""
    cols = ("mesial", "occlusal", "distal")
    cells = F.explode(F.array(*(F.struct(F.lit(c.title()).alias("zone"), F.col(c).alias("votes")) for c in cols))).alias("z")
    return votes.select(*keys, "n", cells).select(*keys, "n", "z.zone", "z.votes", S.half_up(F.col("z.votes") / F.col("n"), 4).alias("share"))
