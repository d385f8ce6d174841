"""Array, map and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.text import literal_map

DETECTION_TYPE = (
    "array<struct<bbox:array<double>,confidence:double,class:string,size:array<int>,"
    "orientation:string,orientation_score:double>>"
)

# Words of a list of dicts and their JSON spelling.
BARE_WORDS = {"None": "null", "True": "true", "False": "false", "nan": "NaN"}

# Orientation words of the detector and their codes.
ORIENTATION_CODES = {"back": "B", "front": "F", "left": "L", "right": "R", "unknown": "U"}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body`` (higher-order functions would repeat it)."""
    return F.transform(F.array(value), body)[0]


def parse_detections(text: Column) -> Column:
    """Detections from the text of a list of dicts (single or double quotes).

    The words for missing and truth values are replaced outside of quoted strings only.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^'"]++|['"]"""), F.lit(0))

    def as_json(piece: Column) -> Column:
        bare = piece
        for word, value in BARE_WORDS.items():
            bare = F.regexp_replace(bare, rf"\b{word}\b", value)
        return F.when(F.substring(piece, 1, 1).isin("'", '"'), piece).otherwise(bare)

    return F.from_json(F.array_join(F.transform(pieces, as_json), ""), DETECTION_TYPE, {"allowBackslashEscapingAnyCharacter": "true"})


def unparsed(text: Column, parsed: Column) -> Column:
    """The text of a list that could not be read; null for what was."""
    return F.when(parsed.isNull(), text)


def first_or_null(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def best_by_confidence(detections: Column) -> Column:
    """The detection of highest confidence; the earliest one on ties."""
    better = lambda best, d: F.when(d["confidence"] > best["confidence"], d).otherwise(best)
    return F.aggregate(detections, F.try_element_at(detections, F.lit(1)), better)


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Softmax of ``logits / temperature``, shifted by the maximum so that it cannot overflow."""
    grown = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / F.lit(temperature))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return let(grown, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def count_above(scores: Column, threshold: float) -> Column:
    return F.size(F.filter(scores, lambda s: s > F.lit(threshold)))


def matched_keypoints(points: Column, threshold: float = 0.9, fewest: int = 10, most: int = 10) -> Column:
    """Best ``most`` point pairs by score; empty if fewer than ``fewest`` reach the threshold.

    ``points`` is an array of structs whose first field is ``score``.
    """
    good = F.filter(points, lambda p: p["score"] >= F.lit(threshold))
    ranked = F.slice(F.sort_array(good, asc=False), 1, most)
    return F.when(F.size(good) < fewest, F.slice(good, 1, 0)).otherwise(ranked)


def mask_confidence(points: Column, visible_cells: Column, ratio: float = 8.0) -> Column:
    """Zero the confidence of keypoints whose mask cell (``"x,y"``) is not visible."""
    cell = lambda p: F.concat_ws(",", F.bround(p["x"] / ratio).cast("int"), F.bround(p["y"] / ratio).cast("int"))
    return F.transform(
        points, lambda p: F.when(F.array_contains(visible_cells, cell(p)), p["confidence"]).otherwise(F.lit(0.0))
    )


def pad_with_last(items: Column, size: int) -> Column:
    """Repeat the last element until the array has ``size`` elements."""
    missing = F.greatest(F.lit(size) - F.size(items), F.lit(0))
    return F.concat(items, F.array_repeat(F.element_at(items, -1), missing))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def orientation_code(word: Column, score: Column, threshold: float = 0.5, left_as_front: bool = False) -> Column:
    """Code of an orientation word; weak scores are unknown, unknown words give null."""
    codes = dict(ORIENTATION_CODES, left="F") if left_as_front else ORIENTATION_CODES
    code = F.try_element_at(literal_map(codes), word)
    return F.when(code.isNull(), None).when(score < threshold, "U").otherwise(code)


def compact_json(rows: DataFrame, columns: list[str]) -> Column:
    """JSON record of columns of ``rows`` without null and NaN fields."""
    floats = {c for c, kind in rows.dtypes if kind in ("float", "double")}
    return F.to_json(F.struct(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in columns]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """Vector of length one (a zero vector stays zero)."""
    return let(F.greatest(norm(a), F.lit(eps)), lambda n: F.transform(a, lambda v: v / n))
