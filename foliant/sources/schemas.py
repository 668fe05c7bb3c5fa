"""Schemas of the usage tables; timestamps are UTC without zone."""

from __future__ import annotations

CHATS = "user_id BIGINT, user_name STRING, type INT, usage_times INT"
ANALYTICS = "format STRING, input_times INT, output_times INT"
CONVERSION_EVENTS = (
    "user_id BIGINT, input_format STRING, output_format STRING, success BOOLEAN, error_message STRING, duration_ms INT, "
    "input_size_bytes BIGINT, output_size_bytes BIGINT, backend STRING, created_at TIMESTAMP_NTZ"
)
PREFERENCES = "user_id BIGINT, language STRING"
USER_OPTION_DEFAULTS = "user_id BIGINT, options_json STRING, updated_at TIMESTAMP_NTZ"
