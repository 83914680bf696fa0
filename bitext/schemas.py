"""Schemas of the tables the operators read and write."""

FILE_REFERENCE = "relative_path string, sha256 string, size long, modified_at long, media_type string"
FILES = "project_id string, side string, " + FILE_REFERENCE
CATALOG = (
    "project_id string, document_id string, ordinal long, "
    "original struct<relative_path:string,sha256:string,size:long,modified_at:long,media_type:string>, "
    "translation struct<relative_path:string,sha256:string,size:long,modified_at:long,media_type:string>, "
    "hidden boolean"
)
PROJECTS = "project_id string, original_dir string, translation_dir string"
TEXT_ITEMS = "doc_id long, page int, text string, x double, y double, width double, height double, source_index int"
PAGE_SPACE = "doc_id long, page int, width double, height double"
PAGES = "doc_id long, page int, method string, text string, image_count int, vector_path_count int"
SEGMENTS = (
    "doc_id long, segment_id string, ordinal int, page int, block_type string, text string, extraction_method string"
)
TRANSLATIONS = (
    "doc_id long, segment_id string, ordinal int, text string, base_text string, reviewed_text string, "
    "review_status string, review_warnings array<string>"
)
ALIGNMENTS = (
    "doc_id long, alignment_id string, ordinal int, source_segment_ids array<string>, "
    "target_segment_ids array<string>, type string, method string, confidence double"
)
BOUNDS = "doc_id long, side string, segment_id string, start double, end double"
PROGRESS = "struct<stage:string,current:long,total:long,message:string>"
JOB_EVENTS = (
    "project_id string, document_id string, seq long, ts timestamp, type string, progress " + PROGRESS + ", error string"
)
SCROLL_EVENTS = "reader_id long, seq long, at_ms long, ts timestamp, kind string, side string, behavior string"

# The JSON files of a project folder.
PROJECT_FILE = "projectId string, name string, schemaVersion int, originalDir string, translationDir string"
_REFERENCE_JSON = "struct<relativePath:string,sha256:string,size:long,modifiedAt:long,mediaType:string>"
CATALOG_FILE = (
    f"schemaVersion int, documents array<struct<documentId:string,original:{_REFERENCE_JSON},"
    f"translation:{_REFERENCE_JSON},hidden:boolean>>"
)
