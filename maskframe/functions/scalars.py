"""Column functions: tooth ids, surfaces, boxes, angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def quadrant(tooth_id: Column) -> Column:
    """First digit of a two-digit id; 1 if it is none of 1 to 4."""
    q = F.substring(tooth_id.cast("string"), 1, 1).try_cast("int")
    return F.when(q.between(1, 4), q).otherwise(1)


def is_upper(tooth_id: Column) -> Column:
    return quadrant(tooth_id).isin(1, 2)


def mesial_right(tooth_id: Column) -> Column:
    """If larger x is mesial (quadrants 1 and 4)."""
    return quadrant(tooth_id).isin(1, 4)


def coarse_surface(label: Column) -> Column:
    """Occlusal, Proximal or Other, by keyword."""
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(s.contains("occlusal"), "Occlusal").when(s.contains("mesial") | s.contains("distal") | s.contains("proximal"), "Proximal").otherwise("Other")


def clamp_label(label: Column, valid: tuple[str, ...]) -> Column:
    return F.when(label.isin(*valid), label).otherwise("Other")


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of boxes (x1, y1, x2, y2) over their union; 0 without a union."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def in_box(x: Column, y: Column, b: tuple[Column, ...]) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


@F.udf(DoubleType(), useArrow=False)
def atan2(y: float | None, x: float | None) -> float | None:
    """The nearest double to the angle. F.atan2 may be off by the last bit, which decides pixels that lie on a zone's border. For
    one row a mask."""
    return None if y is None or x is None else math.atan2(y, x)


def half_up(value: Column, digits: int) -> Column:
    """value to so many digits, halves away from 0, by scaling as in SQL engines: 0.8606374999999999 to 6 is 0.860638. F.round goes by
    the decimal text."""
    return F.round(value * 10.0**digits) / 10.0**digits


def wrap_angle(a: Column) -> Column:
    return F.when(a > math.pi, a - 2 * math.pi).when(a < -math.pi, a + 2 * math.pi).otherwise(a)


def combined_zone(m: Column, c: Column, d: Column) -> Column:
    """MOD, MO, DO, M, D or O of the zones that are present; mesial and distal without the centre count as MOD."""
    return F.when(m & d, "MOD").when(m & c, "MO").when(d & c, "DO").when(m, "M").when(d, "D").when(c, "O").otherwise("Unknown")


def jaw(tooth_id: Column) -> Column:
    return F.when(is_upper(tooth_id), "upper").otherwise("lower")


#: Words of descriptive tooth names and the digits of two-digit ids. Of positions, the first hit counts.
QUADRANTS = {("upper", "right"): "1", ("upper", "left"): "2", ("lower", "left"): "3", ("lower", "right"): "4"}
POSITIONS = {"central incisor": "1", "lateral incisor": "2", "canine": "3", "first premolar": "4", "second premolar": "5", "third molar": "8", "second molar": "7", "first molar": "6"}
#: Surfaces by keyword; the first hit counts.
FINE = ("Occlusal", "Mesial", "Distal", "Proximal", "Buccal", "Lingual")


def first_hit(text: Column, values: dict[str, str | int]) -> Column:
    """The value of the first keyword in text, null without one."""
    out = F.lit(None)
    for word, value in reversed(values.items()):
        out = F.when(text.contains(word), F.lit(value)).otherwise(out)
    return out


def tooth_of_name(name: Column) -> Column:
    """Two-digit id of a name such as "Permanent lower right second premolar tooth"; empty if it names none."""
    n = F.lower(F.coalesce(name, F.lit("")))
    q = F.lit(None).cast("string")
    for (jaw_, side), digit in QUADRANTS.items():
        q = F.when(n.contains(jaw_) & n.contains(side) & q.isNull(), digit).otherwise(q)
    return F.coalesce(F.concat(q, first_hit(n, POSITIONS)), F.lit(""))


def fine_surface(label: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.coalesce(first_hit(s, {x.lower(): x for x in FINE}), F.lit("Other"))


def matched_either_way(text: Column, values: dict[str, int]) -> Column:
    """The value of the key that equals text, else of the first key that holds text or is in it; null without one."""
    t = F.lower(F.trim(text))
    out = F.lit(None).cast("int")
    for key, value in reversed(values.items()):
        out = F.when(t.contains(key) | ((t != "") & F.lit(key).contains(t)), F.lit(value)).otherwise(out)
    exact = F.lit(None).cast("int")
    for key, value in values.items():
        exact = F.when(t == key, F.lit(value)).otherwise(exact)
    return F.coalesce(exact, out)


def normalised(v: Column, size: Column | float) -> Column:
    """v / size, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))


def polygon_box(polygon: Column) -> Column:
    """(cx, cy, w, h) of an array of (x, y)."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    lo, hi = (F.array_min(xs), F.array_min(ys)), (F.array_max(xs), F.array_max(ys))
    return F.struct(((lo[0] + hi[0]) / 2).alias("cx"), ((lo[1] + hi[1]) / 2).alias("cy"), (hi[0] - lo[0]).alias("w"), (hi[1] - lo[1]).alias("h"))


def corners_box(a: tuple[Column, Column], b: tuple[Column, Column], width: Column | float, height: Column | float) -> Column:
    """Normalised (cx, cy, w, h) of two opposite corners, in any order."""
    return F.struct(((a[0] + b[0]) / 2 / width).alias("cx"), ((a[1] + b[1]) / 2 / height).alias("cy"), (F.abs(b[0] - a[0]) / width).alias("w"), (F.abs(b[1] - a[1]) / height).alias("h"))


def centre(b: tuple[Column, ...]) -> tuple[Column, Column]:
    """The box's centre in whole pixels, rounded down."""
    return F.floor((b[0] + b[2]) / 2), F.floor((b[1] + b[3]) / 2)


def key_points(b: tuple[Column, ...]) -> Column:
    """Four corners and the centre."""
    cx, cy = centre(b)
    points = ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (cx, cy))
    return F.array(*(F.array(x.cast("long"), y.cast("long")) for x, y in points))


def lesion_area(b: tuple[Column, ...], confidence: Column) -> Column:
    """Estimated pixels of a detection: 60 to 80 per cent of its box, by confidence; cut, not rounded."""
    return ((b[2] - b[0]) * (b[3] - b[1]) * (0.6 + 0.2 * confidence)).cast("long")


def tooth_area(b: tuple[Column, ...]) -> Column:
    return ((b[2] - b[0]) * (b[3] - b[1]) * 0.7).cast("long")


def class_name(class_id: Column, name: Column, names: dict[int, str]) -> Column:
    """The id's name, else a name that is no placeholder, else Unknown."""
    known = F.lit(None).cast("string")
    for k, v in names.items():
        known = F.when(class_id == k, v).otherwise(known)
    return F.coalesce(known, F.when(~name.startswith("Class_"), name), F.lit("Unknown"))


def case_of_file(path: Column) -> Column:
    """The number behind "case", with blanks, underscores or %20 between; null without one."""
    return F.regexp_extract(path, r"case(?:%20|[ _])*(\d+)", 1).try_cast("int")


def position_detail(tooth_id: Column, rel_x: Column) -> Column:
    """Mesial, Distal or Center by side of the mouth."""
    right = mesial_right(tooth_id)
    return F.when(rel_x == 0.5, "Center").when((rel_x > 0.5) == right, "Mesial").otherwise("Distal")


def extension_text(m: Column, c: Column, d: Column, presence: float = 0.05) -> Column:
    """"Mesial (Dominant) + Occlusal (Extension) -> MO": the largest fraction, then the others of at least `presence`."""
    top = F.when((m >= c) & (m >= d), "Mesial").when(c >= d, "Occlusal").otherwise("Distal")
    named = [(m, "Mesial"), (c, "Occlusal"), (d, "Distal")]
    more = F.filter(F.array(*(F.when((v >= presence) & (top != n), F.lit(f"{n} (Extension)")) for v, n in named)), lambda x: x.isNotNull())
    label = combined_zone(m >= presence, c >= presence, d >= presence)
    return F.concat(F.array_join(F.concat(F.array(F.concat(top, F.lit(" (Dominant)"))), more), " + "), F.lit(" -> "), label)


def soft_match(truth: Column, predicted: Column, m: Column, c: Column, d: Column, threshold: float = 0.30) -> Column:
    """True (equal, fine or coarse), Partial (the true surface has its share), True_with_warning (a neighbour has), else
    False. Null fractions are unknown: then only equality counts."""
    fine, coarse = fine_surface(truth), coarse_surface(truth)
    given = F.coalesce(predicted, F.lit("")) != ""
    equal = given & ((fine == fine_surface(predicted)) | (coarse == coarse_surface(predicted)))
    own = F.when(fine == "Mesial", m).when(fine == "Distal", d).when(fine == "Occlusal", c).when(fine == "Proximal", F.greatest(m, d)).otherwise(0.0)
    beside = F.when(fine == "Occlusal", F.greatest(m, d)).when(fine.isin("Mesial", "Distal"), c).when(fine == "Proximal", F.greatest(m, c, d)).otherwise(0.0)
    known = m.isNotNull() & c.isNotNull() & d.isNotNull()
    return F.when(equal, "True").when(known & (own >= threshold), "Partial").when(known & (beside >= threshold), "True_with_warning").otherwise("False")


def best_label(*labels: Column) -> Column:
    """The first that is neither null, blank nor "nan"."""
    return F.coalesce(*(F.when(~F.lower(F.trim(x)).isin("", "nan"), x) for x in labels), F.lit("Unknown"))


def complexity(label: Column) -> Column:
    return F.when(label.contains("MOD"), 3).when(label.contains("MO") | label.contains("DO"), 2).otherwise(1)


def rounded(v: Column, digits: int = 4) -> Column:
    """Half to even."""
    return F.bround(v, digits)


def turned(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> tuple[Column, Column]:
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(angle) - dy * F.sin(angle), cy + dx * F.sin(angle) + dy * F.cos(angle)


def clamp_angle(a: Column, most_degrees: float = 45.0) -> tuple[Column, Column]:
    """(angle, clamped): angles beyond the bound become 0."""
    w = wrap_angle(a)
    far = F.abs(F.degrees(w)) > most_degrees
    return F.when(far, 0.0).otherwise(w), far


def predicted_surface(document: Column) -> Column:
    """Of a JSON prediction the fine surface, else the position detail, else Other."""
    return F.coalesce(F.get_json_object(document, "$.predicted_surface_fine"), F.get_json_object(document, "$.caries_position_detail"), F.lit("Other"))


def tooth_in_text(text: Column) -> Column:
    """The first word whose digits are a two-digit tooth id."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"\D", ""))
    return F.get(F.filter(words, lambda w: w.rlike("^[1-4][1-8]$")), F.lit(0))
