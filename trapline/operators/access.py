"""Who may see and change what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.operators.media import lookup
from trapline.operators.skew import keys_of


@dataclass(frozen=True)
class Viewer:
    id: int
    workgroup_id: int | None


def viewer(users: DataFrame, user_id: int) -> Viewer:
    """The one user a request is made for (a single-row lookup)."""
    row = users.filter(F.col("id") == user_id).select("id", "workgroup_id").first()
    if row is None:
        raise ValueError(f"no user {user_id}")
    return Viewer(row["id"], row["workgroup_id"])


def with_owner(archives: DataFrame, users: DataFrame) -> DataFrame:
    """Archives (or localities) with the workgroup of their owner."""
    return lookup(archives, users, "owner_id", "owner", ["workgroup_id"])


ARCHIVE_COLUMNS = [
    "contains_single_taxon", "contains_identities", "taxon_for_identification_id", "taxon_status", "identification_status",
]


def media_with_archive(media: DataFrame, archives: DataFrame, users: DataFrame) -> DataFrame:
    """Media with the owner, tenant and upload state of their archive."""
    owned = with_owner(archives, users)
    picked = owned.select(F.col("id").alias("_archive_id"), "owner_id", "owner_workgroup_id", *ARCHIVE_COLUMNS)
    return media.join(picked, F.col("parent_id") == F.col("_archive_id"), "left").drop("_archive_id")


def tenant_predicate(who: Viewer) -> Column:
    """Rows of the viewer's workgroup, or the viewer's own rows if there is no workgroup."""
    if who.workgroup_id is not None:
        return F.col("owner_workgroup_id") == who.workgroup_id
    return F.col("owner_id") == who.id


def may_write(who: Viewer, accept_none: bool = False, strict: bool = False) -> Column:
    """Read and write access to a row with ``owner_id`` and ``owner_workgroup_id``.

    Two missing workgroups count as the same one unless ``strict``. A row without owner is
    accessible only with ``accept_none``.
    """
    workgroup = F.lit(who.workgroup_id).cast("long")
    same = F.col("owner_workgroup_id").eqNullSafe(workgroup)
    if strict:
        same = F.coalesce(F.col("owner_workgroup_id") == workgroup, F.lit(False))
    return F.when(F.col("owner_id").isNull(), accept_none).otherwise((F.col("owner_id") == who.id) | same)


def visible_counts(owned: DataFrame, users: DataFrame, out: str) -> DataFrame:
    """For every user the number of rows of their tenant.

    Rows are counted per owner first; what is summed per workgroup is one row per owner.
    """
    per_owner = owned.groupBy("owner_id", "owner_workgroup_id").agg(F.count(F.lit(1)).alias("_n"))
    return tenant_totals(per_owner, users, {out: "_n"})


def tenant_totals(per_owner: DataFrame, users: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Per user the tenant-wide sums of per-owner counts."""
    own = per_owner.groupBy("owner_id").agg(*[F.sum(c).alias(f"_own_{o}") for o, c in sums.items()])
    group = (
        per_owner.filter("owner_workgroup_id is not null")
        .groupBy("owner_workgroup_id")
        .agg(*[F.sum(c).alias(f"_group_{o}") for o, c in sums.items()])
    )
    joined = users.join(own, users["id"] == own["owner_id"], "left").join(
        group, users["workgroup_id"] == group["owner_workgroup_id"], "left"
    )
    pick = lambda o: F.when(F.col("workgroup_id").isNotNull(), F.col(f"_group_{o}")).otherwise(F.col(f"_own_{o}"))
    return joined.select("id", "workgroup_id", *[F.coalesce(pick(o), F.lit(0)).cast("long").alias(o) for o in sums])


def accessible_media(owned: DataFrame, album_media: DataFrame, album_shares: DataFrame, who: Viewer) -> DataFrame:
    """Media of the tenant or in an album shared with the viewer, each once."""
    albums = keys_of(album_shares.filter(F.col("user_id") == who.id), "album_id")
    shared = keys_of(album_media.join(albums, "album_id", "left_semi"), "mediafile_id").withColumn("_shared", F.lit(True))
    joined = owned.join(shared, F.col("id") == F.col("mediafile_id"), "left")
    return joined.filter(F.col("_shared") | tenant_predicate(who)).drop("_shared", "mediafile_id")
