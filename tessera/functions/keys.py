"""Composite string keys name_project_access_agent, split from the right."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PARTS = ("name", "project", "access", "agent")


def split_right(key: Column, parts: int) -> list[Column]:
    """`parts` columns; only the first may hold underscores."""
    pattern = "^(.*)" + "_([^_]*)" * (parts - 1) + "$"
    return [F.regexp_extract(key, pattern, k + 1) for k in range(parts)]
