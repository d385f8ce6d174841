"""Schemas of the tables, as they are declared to the readers (nothing is inferred)."""

from __future__ import annotations

_DDL = {
    "taxon": "id long, name string, parent_id long",
    "workgroup": "id long, name string, sequence_time_limit int, default_taxon_id long, identification_init_at timestamp, identification_reid_status string",
    "app_user": "id long, user_id long, workgroup_id long, workgroup_admin boolean, timezone string, default_taxon_id long",
    "locality": "id long, name string, visible_name string, location string, hash string, owner_id long, note string, area_id long",
    "area": "id long, name string, location string, note string",
    "uploaded_archive": (
        "id long, name string, uploaded_at timestamp, taxon_status string, identification_status string, status_message string, locality_id long, "
        "owner_id long, contains_identities boolean, contains_single_taxon boolean, taxon_for_identification_id long, earliest_captured_at timestamp, "
        "latest_captured_at timestamp, locality_check_at timestamp, mediafiles_at_upload int"
    ),
    "individual_identity": (
        "id long, name string, owner_workgroup_id long, sex string, coat_type string, note string, code string, juv_code string, hash string, "
        "birth_date date, death_date date"
    ),
    "sequence": "id long, uploaded_archive_id long, local_id int",
    "media_file": (
        "id long, parent_id long, taxon_id long, predicted_taxon_id long, predicted_taxon_confidence double, locality_id long, captured_at timestamp, "
        "mediafile string, image_file string, identity_id long, identity_is_representative boolean, updated_by_id long, updated_at timestamp, "
        "metadata_json string, media_type string, orientation string, original_filename string, taxon_verified boolean, sequence_id long"
    ),
    "animal_observation": (
        "id long, mediafile_id long, taxon_id long, taxon_verified boolean, predicted_taxon_id long, identity_id long, bbox_x_center double, "
        "bbox_y_center double, bbox_width double, bbox_height double, orientation string"
    ),
    "identification_suggestion": "media_id long, rank int, identity_id long, name string, path string, score double",
    "album_mediafile": "album_id long, mediafile_id long",
    "album_share_role": "album_id long, user_id long",
    "merge_suggestion": "id long, workgroup_id long, created_at timestamp, suggestions array<struct<from_id:long,to_id:long,distance:int>>",
    "reference_image": "ref_id long, organization_id int, image_path string, class_id long, label string, embedding string",
    "metadata": (
        "original_path string, filename string, suffix string, media_type string, annotated boolean, vanilla_location string, location string, date string, "
        "path_len int, czech_label string, vanilla_species string, datetime timestamp, read_error string, datetime_source string, unique_name string, "
        "content_hash string, delta_seconds double, sequence_number long, image_path string, detection_results string, predicted_category string, "
        "predicted_prob double, predicted_category_raw string, predicted_prob_raw double"
    ),
    "species": "czech_label string, Species string, Genus string, Family string, Class string, red_list string",
}


def schema(table: str) -> str:
    """Schema of a table as DDL text, as readers and streams take it."""
    return _DDL[table]


def tables() -> list[str]:
    return list(_DDL)
