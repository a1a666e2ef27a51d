"""Schemas of the index tables and of a parse result."""

from __future__ import annotations

PARAMETERS = "array<struct<name:string,type:string,default_value:string,position:int,direction:string>>"
SYMBOL = (
    "struct<kind:string,name:string,qualified_name:string,signature:string,return_type:string,visibility:string,modifiers:string,"
    "line_start:int,line_end:int,char_start:int,char_end:int,char_count:int,parent_index:int,base_types:array<string>,"
    f"parameters:{PARAMETERS}>"
)

REPOSITORIES = "id long, repo_root string, index_root string, repo_fingerprint string, schema_version int, created_at timestamp, last_indexed_at timestamp, read_only_repo boolean"
FILES = (
    "id long, repository_id long, relative_path string, absolute_path string, extension string, language string, size_bytes long, "
    "line_count long, char_count long, last_modified_time timestamp, content_hash string, structure_hash string, parse_status string, "
    "is_active boolean, first_seen_snapshot_id long, last_seen_snapshot_id long, deleted_at timestamp"
)
SYMBOLS = (
    "id long, repository_id long, file_id long, language string, kind string, name string, qualified_name string, signature string, "
    "return_type string, visibility string, modifiers string, parent_symbol_id long, line_start int, line_end int, char_start int, "
    "char_end int, char_count int, content_hash string, signature_hash string, body_hash string, stable_id string, description string, "
    "tags string, ai_description string, ai_tags string, ai_model string, ai_enriched_at timestamp, is_active boolean, "
    "first_seen_snapshot_id long, last_seen_snapshot_id long, deleted_at timestamp"
)
SYMBOL_PARAMETERS = "id long, symbol_id long, name string, type string, default_value string, position int, direction string"
SYMBOL_RELATIONS = (
    "id long, repository_id long, source_symbol_id long, target_symbol_id long, relation_type string, source_text string, target_text string, confidence double"
)
SNAPSHOTS = "id long, repository_id long, created_at timestamp, git_commit string, description string"
CHANGES = (
    "id long, repository_id long, snapshot_id long, entity_type string, entity_id long, change_type string, old_hash string, new_hash string, "
    "old_path string, new_path string, created_at timestamp"
)
TABLES = {
    "repositories": REPOSITORIES, "files": FILES, "symbols": SYMBOLS, "symbol_parameters": SYMBOL_PARAMETERS,
    "symbol_relations": SYMBOL_RELATIONS, "snapshots": SNAPSHOTS, "changes": CHANGES,
}
SCHEMA_VERSION = 1
