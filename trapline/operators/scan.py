"""Columns that come out of a file listing alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions import dictionaries as D
from trapline.functions import text as X


def path_columns(files: DataFrame, path: str = "original_path") -> DataFrame:
    """Add what the folder layout says about each file.

    Paths of fewer than three parts say nothing; below an ``image`` folder only the location is
    known; otherwise the root folder tells sorted, unsorted and per-identity trees apart.
    """
    p = X.parts(F.col(path))
    n = F.size(p)
    shallow = n < 3
    image_folder = ~shallow & (F.try_element_at(p, F.lit(-3)) == "image")
    structured = ~shallow & ~image_folder
    root, third = F.element_at(p, 1), F.try_element_at(p, F.lit(3))
    folder = F.try_element_at(p, F.lit(-2))
    archive_tree = root.isin("TRIDENA", "NETRIDENA")
    annotated = root == "TRIDENA"
    named = annotated & (n != 4)
    label = (
        F.when(~archive_tree, D.IDENTITY_FOLDER_LABEL)
        .when(named, X.known_label(X.correct_label(folder)))
        .otherwise(D.UNKNOWN_LABEL)
    )
    return files.withColumns(
        {
            "filename": X.basename(F.col(path)),
            "suffix": X.suffix(F.col(path)),
            "media_type": X.media_type(F.col(path)),
            "annotated": F.when(structured, annotated),
            "vanilla_location": F.when(structured & archive_tree, third),
            "location": F.when(image_folder, folder).when(structured & archive_tree, X.clean_location(third)),
            "date": F.when(structured & archive_tree, X.date_in_path(F.col(path))),
            "path_len": F.when(structured, n),
            "czech_label": F.when(structured, label),
            "vanilla_species": F.when(structured & named, folder),
        }
    )


def classify_upload_folders(listing: DataFrame, path: str = "path") -> DataFrame:
    """Date and locality of the folders and zip files of an upload share.

    Known layouts, in this order: ``{date}_{locality}`` or ``{locality}_{date}`` at the top,
    ``{date}/{locality}``, ``{locality}/{date}``. Folders above a recognised one are marked for
    removal, folders of the share itself are marked as skipped, the rest carries an error.
    """
    p = X.parts(F.col(path))
    dated = r"^([0-9]{4}-?[0-9]{2}-?[0-9]{2})"
    leaf = F.regexp_replace(F.element_at(p, -1), r"^(.+)\.[^.]+$", "$1")
    rows = listing.withColumns({"_leaf": leaf, "_parent": F.coalesce(F.try_element_at(p, F.lit(-2)), F.lit("")), "_top": F.size(p) == 1})
    rows = X.split_date_and_locality(rows, "_leaf", "_date", "_locality")
    rows = rows.withColumn(
        "_layout",
        F.when(F.col("_top") & F.col("_locality").isNotNull(), "flat")
        .when(F.col("_parent").rlike(dated), "date/locality")
        .when(~F.col("_top") & F.col("_leaf").rlike(dated), "locality/date"),
    )
    layout = F.col("_layout")
    given = (
        F.when(layout == "flat", F.col("_date"))
        .when(layout == "date/locality", F.col("_parent"))
        .when(layout == "locality/date", F.regexp_extract("_leaf", dated, 1))
        .otherwise("")
    )
    locality = F.when(layout == "flat", F.col("_locality")).when(layout == "date/locality", F.col("_leaf")).when(layout == "locality/date", F.col("_parent")).otherwise("")
    rows = rows.withColumns({"_given": given, "locality": locality}).withColumn("date", X.dashed_date(F.col("_given")))
    rows = rows.withColumns({"_known": layout.isNotNull(), "_nested": layout.isin("date/locality", "locality/date")})
    checked = rows.filter("_nested").select(F.col("_parent").alias("_checked")).distinct()
    marked = rows.join(checked, F.col("_leaf") == F.col("_checked"), "left")
    parent_done = ~F.col("_known") & F.col("_checked").isNotNull()
    name = F.concat(F.col("locality"), F.lit("_"), F.col("date"), F.lit(".zip"))
    return marked.withColumns(
        {
            "zip_name": F.replace(X.strip_accents(name), F.lit(" "), F.lit("_")),
            "skipped": F.element_at(X.parts(F.col(path)), 1).isin(*D.SKIPPED_FOLDERS),
            "parent_dir_to_be_deleted": parent_done,
            "error": F.when(~F.col("_known") & ~parent_done, "Name of the directory or file is not in correct format. Skipping."),
        }
    ).drop("_known", "_nested", "_leaf", "_parent", "_checked", "_top", "_date", "_locality", "_layout", "_given")


def mark_known(folders: DataFrame, known: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """Flag the rows whose value exists in another table."""
    have = known.select(F.col(name).alias("_have")).distinct()
    return folders.join(have, F.col(column) == F.col("_have"), "left").withColumn(out, F.col("_have").isNotNull()).drop("_have")
