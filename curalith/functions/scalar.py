"""Scalar functions: text, numbers, paths and hashes, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalith.schema import CLASS_FOLDERS, TRUTHY


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (trim() knows spaces only)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def text(c: Column | str) -> Column:
    """Missing values of every kind as the empty text, others stripped."""
    return F.coalesce(strip(_col(c).cast("string")), F.lit(""))


def blank(c: Column | str) -> Column:
    return text(c) == ""


def truthy(c: Column | str) -> Column:
    """Booleans and their texts; missing is false."""
    return F.coalesce(F.lower(strip(_col(c).cast("string"))).isin(TRUTHY), F.lit(False))


def strict_label(c: Column | str) -> Column:
    """0 or 1 from a text or number; null for anything else, fractions and booleans included."""
    value = strip(_col(c).cast("string")).try_cast("double")
    return F.when(value.isin(0.0, 1.0), value.cast("int"))


def outcome(y_true: Column | str, y_pred: Column | str) -> Column:
    t, p = _col(y_true), _col(y_pred)
    return F.when((t == 1) & (p == 1), "TP").when((t == 0) & (p == 0), "TN").when((t == 0) & (p == 1), "FP").when((t == 1) & (p == 0), "FN")


def at_threshold(score: Column | str, threshold: float | Column) -> Column:
    """1 from the threshold on, the threshold included."""
    return (_col(score) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))).cast("int")


def finite(c: Column | str) -> Column:
    return ~F.isnan(_col(c)) & (F.abs(_col(c)) < F.lit(float("inf")))


def close(a: Column | str, b: Column | str, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    a, b = _col(a), _col(b)
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def ratio(numerator: Column, denominator: Column) -> Column:
    """One division of two counts; zero where the denominator is."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator.cast("double") / F.when(denominator == 0, F.lit(1.0)).otherwise(denominator.cast("double")))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def portable_path(c: Column | str) -> Column:
    """Forward slashes, no leading ``./``, no white space at the ends."""
    return F.regexp_replace(F.replace(text(c), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def safe_path(c: Column | str, windows: bool = True) -> Column:
    """True for a relative path without parent steps, root, or (with ``windows``) drive."""
    p = portable_path(c)
    bad = (p == "") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)")
    return ~(bad | p.rlike("^[A-Za-z]:")) if windows else ~bad


def class_of_path(c: Column | str) -> Column:
    """struct<surface, label> if exactly one part names a class folder, else null."""
    parts = F.filter(F.split(portable_path(c), "/"), lambda x: x.isin(*CLASS_FOLDERS))
    known = F.create_map(*[x for k, (s, label) in CLASS_FOLDERS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("surface"), F.lit(label).alias("label")))])
    return F.when(F.size(parts) == 1, F.try_element_at(known, F.get(parts, 0)))


def group_of_path(c: Column | str, pattern: str, group: int = 1) -> Column:
    """What a group of a regular expression matches in the path; empty where it doesn't."""
    return F.regexp_extract(portable_path(c), pattern, group)


def safe_component(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")


def hex64(c: Column | str) -> Column:
    """A 64-bit number as 16 hex digits."""
    return F.lpad(F.lower(F.hex(_col(c))), 16, "0")


def experiment_rank(c: Column | str) -> Column:
    """The number in an experiment's id E<n>; 999 for other names."""
    digits = F.regexp_extract(_col(c), r"^[Ee](\d+)$", 1)
    return F.when(digits == "", F.lit(999)).otherwise(F.when(digits == "", F.lit("0")).otherwise(digits).cast("int"))


def difference_hash(rows: Column | str) -> Column:
    """dHash of an 8 x 9 grid of gray values (array of 8 arrays): a bit for each pixel that is darker than its right neighbour."""
    bits = F.flatten(F.transform(_col(rows), lambda row: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.get(row, i + 1) > F.get(row, i)).cast("bigint"))))
    return hex64(F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x)))


def member(c: Column | str, values: Sequence[str]) -> Column:
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def prefix(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def basename(c: Column | str) -> Column:
    return F.substring_index(portable_path(c), "/", -1)


def suffix(c: Column | str) -> Column:
    """The last dot and what follows it, in lower case; empty for a name without one or that only begins with one."""
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1))


def stem(c: Column | str) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def fixed(c: Column | str, places: int = 6, signed: bool = False) -> Column:
    return F.format_string(f"%{'+' if signed else ''}.{places}f", _col(c))


def half_even(c: Column | str) -> Column:
    return F.bround(_col(c), 0)


def scaled_pixel(c: Column | str) -> Column:
    """A channel from 0..255 to -1..1."""
    return _col(c) / F.lit(127.5) - F.lit(1.0)


def scaled_image(pixels: Column | str) -> Column:
    """All channels of an image (array of numbers from 0 to 255) to -1..1."""
    return F.transform(_col(pixels), scaled_pixel)


def rotated(x: Column | str, y: Column | str, degrees: Column | float) -> Column:
    """struct<x, y>: a point turned about the origin."""
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    return F.struct((_col(x) * F.cos(a) - _col(y) * F.sin(a)).alias("x"), (_col(x) * F.sin(a) + _col(y) * F.cos(a)).alias("y"))


def utc_iso(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_compact(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyyMMdd'T'HHmmss'Z'")


def packed_bits(flags: Column | str) -> Column:
    """Booleans as one number, the first in the highest place."""
    return F.aggregate(_col(flags), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x.cast("bigint")))


def one_hot(c: Column | str, categories: Sequence) -> Column:
    """A vector with a one at the place of the value's category; all zero for other values."""
    return F.array(*[F.coalesce((_col(c) == v).cast("int"), F.lit(0)) for v in categories])


def without_keys(c: Column | str, known: Sequence[str]) -> Column:
    """What an open map holds beside the known keys."""
    return F.map_filter(_col(c), lambda k, _: ~k.isin(list(known)))


def under(c: Column | str, first: str, second: str) -> Column:
    """Whether two successive parts of a path are these, in any case."""
    return F.concat(F.lit("/"), F.lower(portable_path(c)), F.lit("/")).contains(f"/{first}/{second}/")


def smoke_path(c: Column | str) -> Column:
    return under(c, "artifacts", "smoke")


def report_path(c: Column | str) -> Column:
    return under(c, "artifacts", "report")


def contained(c: Column | str) -> Column:
    """Whether a relative path, its ``..`` steps resolved from the left, never leaves its root."""
    steps = F.transform(F.split(portable_path(c), "/"), lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    end = F.aggregate(steps, start, lambda a, s: F.struct((a["depth"] + s).alias("depth"), F.least(a["least"], a["depth"] + s).alias("least")))
    return ~portable_path(c).startswith("/") & (end["least"] >= 0)
