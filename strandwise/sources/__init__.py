"""Readers and writers. Schemas are always given, never inferred."""

from .files import (
    bind_by_key,
    flatten_frames,
    numbered_rows,
    read_csv,
    read_json,
    read_records_xml,
    stack_frames,
    write_csv,
)

__all__ = [
    "bind_by_key", "flatten_frames", "numbered_rows", "read_csv", "read_json", "read_records_xml", "stack_frames",
    "write_csv",
]
