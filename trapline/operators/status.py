"""Status codes and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import dictionaries as D
from trapline.functions.text import literal_map


def updated_status(status: Column, missing_taxa: Column, unverified: Column) -> Column:
    """Status after annotation work; codes outside the list become U."""
    worked = F.when(missing_taxa > 0, "TAID").when(unverified > 0, "TKN").otherwise("TV")
    new = F.when(status.isin("TV", "TKN", "TAID"), worked).otherwise(status)
    return F.when(new.isin(*D.STATUS_LABELS), new).otherwise("U")


def status_label(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(D.STATUS_LABELS), code), F.lit("Unknown"))


def taxon_status_view(status: Column, message: Column) -> dict[str, Column]:
    """Label, message and style of the taxon status."""
    return {
        "status": status_label(status),
        "status_message": F.when(status == "TKN", "All media files have taxon.")
        .when(status == "TV", "All taxons are verified.")
        .otherwise(message),
        "status_style": F.when(status == "TAID", "secondary")
        .when(status == "F", "danger")
        .when(status == "TKN", "primary")
        .when(status == "TV", "success")
        .when(status == "U", "warning")
        .otherwise("dark"),
    }


def identification_status_view(taxon_status: Column, status: Column, message: Column) -> dict[str, Column]:
    """Label, message and style of the identification status; its own code outranks the taxon status."""
    return {
        "identification_label": status_label(status),
        "identification_message": F.when(taxon_status == "TKN", "All media files have taxon.")
        .when(taxon_status == "TV", "All taxons are verified.")
        .otherwise(message),
        "identification_style": F.when(status == "F", "danger")
        .when(status == "U", "warning")
        .when(status == "IAIP", "secondary")
        .when(status == "IAID", "primary")
        .when(taxon_status == "F", "danger")
        .when(taxon_status.isin("TKN", "TV"), "secondary")
        .otherwise("dark"),
    }


def next_step(status: Column, owner_workgroup: Column) -> Column:
    return (
        F.when(status == "TAID", "Annotate taxa")
        .when(status == "TKN", "Verify taxa")
        .when((status == "TV") & owner_workgroup.isNotNull(), "Go to identification")
    )


def finished_workgroups(owned_archives: DataFrame) -> DataFrame:
    """Workgroups with no archive still in identification."""
    counts = owned_archives.filter("owner_workgroup_id is not null").groupBy("owner_workgroup_id").agg(
        F.count_if(F.col("identification_status") == "IAIP").alias("running")
    )
    return counts.withColumn("finished", F.col("running") == 0)


def recommended_action(missing_taxa: Column, unverified: Column) -> Column:
    return F.when(missing_taxa > 0, "annotate_missing_taxa").when(unverified > 0, "verify_taxa").otherwise("upload_species")


def identification_actions(initiated: Column, representative: Column, unidentified: Column, to_confirm: Column) -> dict[str, Column]:
    """Which of the five identification steps is highlighted."""
    style = lambda on: F.when(on, "primary").otherwise("secondary")
    has_rep, has_new, has_open = representative > 0, unidentified > 0, to_confirm > 0
    return {
        "upload_identified": style(~initiated & ~has_rep),
        "init_identification": style(~initiated & has_rep),
        "upload_unidentified": style(initiated & ~has_new & ~has_open),
        "run_identification": style(initiated & has_new & ~has_open),
        "confirm_identification": style(has_open),
    }


def migrated_status(status: Column) -> Column:
    """Status texts of earlier releases to codes; anything else stays."""
    return F.coalesce(F.try_element_at(literal_map(D.LEGACY_STATUS), status), status)
