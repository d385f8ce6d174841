"""String and path expressions: Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.functions import dictionaries as D


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _accent_table() -> tuple[str, str]:
    """All characters whose canonical decomposition is one character plus marks, and the marks, of every script."""
    accented, bases, marks = [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1:
            accented.append(char)
            bases.append(base)
    # characters without a counterpart are deleted by translate()
    return "".join(accented + marks), "".join(bases)


ACCENTED, BASES = _accent_table()


def strip_accents(text: Column) -> Column:
    """Drop every nonspacing mark, also of composed letters, inside the JVM."""
    return F.translate(text, ACCENTED, BASES)


@F.pandas_udf(T.StringType())
def strip_accents_any(text: pd.Series) -> pd.Series:
    """As ``strip_accents``, in Arrow batches."""

    def bare(value):
        if value is None or value.isascii():
            return value
        letters = [c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn"]
        return unicodedata.normalize("NFC", "".join(letters))

    return text.map(bare)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last dot and what follows it; empty for names without one or starting with it."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def hashed_name(path: Column, prefix: str | None = "media_data") -> Column:
    """SHA-256 of the path plus its lower-case suffix, below ``prefix``."""
    name = F.concat(F.sha2(path, 256), F.lower(suffix(path)))
    return F.concat(F.lit(prefix + "/"), name) if prefix else name


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes; empty for what has no content (folders)."""
    return F.when(content.isNull(), "").otherwise(F.sha2(content, 256))


def media_type(path: Column) -> Column:
    ending = F.lower(suffix(path))
    return (
        F.when(ending.isin(*D.SCAN_VIDEO_SUFFIXES), "video")
        .when(ending.isin(*D.SCAN_IMAGE_SUFFIXES), "image")
        .otherwise("unknown")
    )


def clean_location(text: Column) -> Column:
    """Comparable spelling of a location folder; the removals run in this order."""
    cleaned = F.lower(strip_accents(text))
    for piece in (" ", "druhy_", "_", "3l-", "-"):
        cleaned = F.replace(cleaned, F.lit(piece))
    return cleaned


def correct_label(label: Column) -> Column:
    """Hand-written label to the spelling of the species table (unknown spellings stay)."""
    bare = F.lower(strip_accents(label))
    known = {k: v for k, v in D.LABEL_CORRECTIONS.items() if k is not None}
    return F.coalesce(F.try_element_at(literal_map(known), bare), bare, F.lit(D.LABEL_CORRECTIONS[None]))


def known_label(label: Column) -> Column:
    """The label if the species table has it, else the "unknown" label."""
    table = [row[0].strip() for row in D.species_rows()]
    return F.when(label.isin(*table), label).otherwise(D.UNKNOWN_LABEL)


def date_in_path(path: Column) -> Column:
    """First ``/YYYY-MM-DD/`` of the path, else the name of the folder above the file's folder."""
    dated = F.regexp_extract(path, r"[/\\]([0-9]{4}-[0-9]{2}-[0-9]{2})[/\\]", 1)
    return F.when(dated != "", dated).otherwise(F.coalesce(F.try_element_at(parts(path), F.lit(-3)), F.lit("")))


def identity_of_parent_folder(path: Column) -> Column:
    return F.when(F.size(parts(path)) > 1, F.element_at(parts(path), -2))


def identity_of_third_part(path: Column) -> Column:
    """Third path part, unless the tree is one of the two sorted or unsorted archives."""
    p = parts(path)
    sorted_tree = F.element_at(p, 1).isin("TRIDENA", "NETRIDENA")
    return F.when(~sorted_tree & (F.size(p) > 2), F.try_element_at(p, F.lit(3)))


# year 1900-2100, month, day; a day may carry leading zeros
DATE_DIGITS = r"^(19\d\d|20\d\d|2100)(0[1-9]|1[0-2])0*([1-9]|[12]\d|3[01])$"


def is_date_text(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD`` with year 1900-2100, month 1-12 and day 1-31 (any month)."""
    digits = F.when(F.length(text) == 10, F.replace(text, F.lit("-"))).when(F.length(text) == 8, text)
    return F.coalesce(digits.rlike(DATE_DIGITS), F.lit(False))


def split_date_and_locality(df: DataFrame, name: str, date: str = "date", locality: str = "locality") -> DataFrame:
    """Add date and locality of ``{date}_{locality}`` or ``{locality}_{date}``, both null if neither.

    The parts are columns of their own first, so that each test is evaluated once.
    """
    pieces = df.withColumn("_pieces", F.split(F.col(name), "_"))
    pieces = pieces.withColumns({"_n": F.size("_pieces"), "_head": F.element_at("_pieces", 1), "_tail": F.element_at("_pieces", -1)})
    tested = pieces.withColumns({"_at_head": (F.col("_n") >= 2) & is_date_text(F.col("_head")), "_at_tail": (F.col("_n") >= 2) & is_date_text(F.col("_tail"))})
    rest = lambda start: F.array_join(F.slice("_pieces", F.lit(start), F.col("_n") - 1), "_")
    return tested.withColumns(
        {
            date: F.when(F.col("_at_head"), F.col("_head")).when(F.col("_at_tail"), F.col("_tail")),
            locality: F.when(F.col("_at_head"), rest(2)).when(F.col("_at_tail"), rest(1)),
        }
    ).drop("_pieces", "_n", "_head", "_tail", "_at_head", "_at_tail")


def dashed_date(text: Column) -> Column:
    return F.when(
        F.length(text) == 8,
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
    ).otherwise(text)


def code_in_name(name: Column) -> Column:
    found = F.regexp_extract(name, r"B\d+", 0)
    return F.when(found != "", found)


def name_without_code(name: Column) -> Column:
    """Name without the code found in it; null where there is no code."""
    code = code_in_name(name)
    return F.when(code.isNotNull(), F.replace(name, code))


def date_in_name(name: Column) -> Column:
    """First ``YYYY-MM-DD`` of a name as a date; null if there is none or it is no date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def export_name(locality: Column, captured_at: Column, original: Column, taxon: Column, identity: Column, file: Column) -> Column:
    """``{locality}_{date}_{stem}_{taxon}_{identity}{suffix}`` with a ``no_*`` word for what is missing."""
    return F.concat(
        F.coalesce(locality, F.lit("no_locality")),
        F.lit("_"),
        F.coalesce(F.date_format(captured_at, "yyyy-MM-dd"), F.lit("no_date")),
        F.lit("_"),
        stem(F.coalesce(F.nullif(original, F.lit("")), F.lit("no_original_name"))),
        F.lit("_"),
        F.coalesce(taxon, F.lit("no_taxon")),
        F.lit("_"),
        F.coalesce(identity, F.lit("no_identity")),
        suffix(file),
    )


def contains_ignoring_case(column: Column, value: str) -> Column:
    return F.lower(column).contains(value.lower())


def search_text(*columns: Column) -> Column:
    """Free-text field over several columns, a null counting as empty text."""
    pieces = [F.coalesce(c, F.lit("")) for c in columns]
    spaced = [x for c in pieces for x in (F.lit(" "), c)][1:]
    return F.concat(*spaced)


def first_letter_code(text: Column, allowed: tuple[str, ...]) -> Column:
    """Upper-case first letter if it is an allowed code, else null."""
    letter = F.upper(F.substring(F.trim(text), 1, 1))
    return F.when(letter.isin(*allowed), letter)


def coat_code(text: Column) -> Column:
    """Coat type code of a spreadsheet spelling; unknown spellings go by their first letter."""
    code = F.coalesce(F.try_element_at(literal_map(D.COAT_SPELLINGS), text), F.substring(text, 1, 1))
    return F.when(code.isin("S", "M", "N", "U"), code)


def swap_variant(path: Column, source: str = "/masked_images/", target: str = "/images/") -> Column:
    return F.replace(path, F.lit(source), F.lit(target))


def token_overlap(text: Column, wanted: str) -> Column:
    """Number of distinct words of ``wanted`` that occur in ``text``."""
    words = sorted(set(wanted.lower().split()))
    return F.size(F.array_intersect(F.split(F.lower(text), r"\W+"), F.array(*[F.lit(w) for w in words])))
