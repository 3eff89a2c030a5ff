"""Schemas of the registry's tables in JSON, and of the source registry that bootstrap reads."""

ENTITY = "uid string, entity_type string, lifecycle_status string, created_at string, created_by string, metadata string"
NAME = "entity_id string, display_name string, slug string, valid_from string, valid_to string, is_primary boolean, source string"
EDGE = "edge_type string, parent_id string, child_id string, source_id string, target_id string, relation_type string, valid_from string, valid_to string, metadata string"
LINEAGE = "entity_id string, related_id string, lineage_type string, recorded_at string, metadata string"
OBSERVATION = "metric_id string, entity_id string, value double, timestamp string, source string, metadata string"
EVENT = "event_type string, source string, subject_entity string, changed_property string, previous_value string, new_value string, payload string, timestamp string"
VARIABLE = "key string, value string, var_type string, mutability string, scope string, entity_id string, constraint struct<allowed_values: array<string>, min_value: double, max_value: double, pattern: string, required: boolean>, description string, updated_at string"
METRIC = "metric_id string, name string, metric_type string, unit string, description string, aggregation string, entity_type_scope string, metadata string"
VERSION = "version_id string, timestamp string, change_type string, change_reason string, affected_entities array<string>, details string"
CLAIM = "action string, agent string, handle string, organ string, repo string, scope string, timestamp string"
REPOSITORY = "struct<name string, org string, status string, public boolean, tier string, promotion_status string, implementation_status string, ci_workflow string>"
REGISTRY = f"version string, schema_version string, organs map<string, struct<name string, description string, repositories array<{REPOSITORY}>>>"

#: Members of enumerations, checked on load.
LINEAGE_TYPES = ("derived_from", "supersedes", "merged_into", "split_from")
LIFECYCLE = ("active", "deprecated", "merged", "split", "archived")
ENTITY_TYPES = ("organ", "repo", "module", "document", "session", "variable", "metric")

#: File names of a store, by table.
FILES = {
    "entities": "entities.json", "names": "names.jsonl", "edges": "edges.jsonl", "lineage": "lineage.jsonl", "variables": "variables.json",
    "metrics": "metrics.json", "observations": "observations.jsonl", "events": "events.jsonl", "versions": "versions.jsonl",
}
