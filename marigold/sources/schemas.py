"""Schemas of the stored tables, and what their constraints mean as checks."""

from __future__ import annotations

# Columns of the runtime tables.
RELATIONAL = {
    "users": "id string, username string, display_name string, role string, experience_level string, created_at timestamp",
    "entities": "id string, name string, description string, entity_type string, category string, source string, external_id string, external_source string, metadata string, created_at timestamp, updated_at timestamp, last_edited_by string, personality_notes string, source_material string",
    "personality_types": "id string, system string, code string, name string, description string",
    "entity_personality_types": "id string, entity_id string, personality_type_id string, confidence double, assigned_by string, assigned_at timestamp",
    "ratings": "id string, entity_id string, user_id string, personality_system string, personality_type string, confidence double, reasoning string, created_at timestamp",
    "comments": "id string, entity_id string, user_id string, content string, created_at timestamp",
    "edit_history": "id string, entity_id string, user_id string, field_name string, old_value string, new_value string, change_type string, created_at timestamp",
}

STORE = {
    "raw": "cid string, payload_bytes binary",
    "vectors": "cid string, vector array<double>",
    "edges": "from_pid long, to_pid long, relation string, source string",
    "messages": "channel_id long, message_id long, author_hash string, created_ts double, vector array<double>",
    "token_hashes": "message_id long, token_hashes array<string>",
    "responses": "subject_id string, type_label string, question_id string, answer_value int",
    "questions": "question_id string, axis string, text string, axis_label string, positive_pole string, negative_pole string, template string, variables map<string,string>, embedding array<double>, embedding_dim int",
}

#: (table, column) to the table it refers to by id.
REFERENCES = {
    ("entity_personality_types", "entity_id"): "entities",
    ("entity_personality_types", "personality_type_id"): "personality_types",
    ("entity_personality_types", "assigned_by"): "users",
    **{(t, c): r for t in ("ratings", "comments", "edit_history") for c, r in (("entity_id", "entities"), ("user_id", "users"))},
}
UNIQUE = {"users": ["username"], "personality_types": ["system", "code"]}
