"""Schemas of the library's relations and the domains of their states."""

from __future__ import annotations

ASSETS = (
    "id string, folder_id string, absolute_path string, relative_path string, filename string, extension string, mime_type string, size_bytes bigint, modified_at timestamp, "
    "sha256 string, status string, available boolean, error_message string, thumbnail_path string, indexed_at timestamp, content_id string"
)
FOLDERS = "id string, path string, created_at timestamp"
CHUNKS = "id string, asset_id string, chunk_index int, page_number int, text string, embedding array<float>, source string, embedding_profile_id string, embedding_dimensions int"
STAGE_JOBS = (
    "id string, asset_id string, stage string, model_id string, pipeline_version string, state string, attempts int, error_message string, created_at timestamp, updated_at timestamp, reindex_generation bigint"
)
PROFILES = (
    "id string, role string, model_id string, checkpoint_revision string, artifact_hashes_json string, dimensions int, preprocessing_version string, tokenizer_version string, schema_version string, "
    "space_id string, created_at timestamp"
)
IMAGE_EMBEDDINGS = "asset_id string, model_id string, region_id int, dimensions int, embedding array<float>, profile_id string"
REGIONS = "asset_id string, model_id string, region_id int, kind string, x int, y int, width int, height int, source_width int, source_height int, pipeline_version string"
VISUAL_TAGS = "asset_id string, model_id string, region_id int, normalized_label string, namespace string, label string, confidence double, rank int, model_version string"
ENTITIES = "asset_id string, entity_type string, raw_value string, normalized_value string, confidence double"
DOCUMENT_TYPES = "asset_id string, document_type string, confidence double, evidence array<string>"
PROVENANCE = "asset_id string, stage string, extractor_id string, extractor_version string, source_kind string, source_index int, confidence double, stage_job_id string, created_at timestamp"

ASSET_STATES = ("pending", "processing", "indexed", "skipped", "failed", "waiting_model")
JOB_STATES = (*ASSET_STATES, "cancelled")
CHANNELS = ("exact", "semantic", "visual", "visual_tag", "document_type", "entity", "metadata", "filename")
