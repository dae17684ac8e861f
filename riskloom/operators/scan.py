"""Shared parts of the regex scan."""

from __future__ import annotations

KEYS = ["repo_id", "commit_sha", "file_path"]


def check_pattern(pattern: str) -> str:
    """Reject patterns that can match the empty string (the offset fold needs width)."""
    import re

    probe = pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("(?<", "(?P<")
    if re.compile(probe).fullmatch(""):
        raise ValueError(f"pattern matches the empty string: {pattern}")
    return pattern
