"""Property test: the Catalyst offset fold agrees with Python's re on random text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scan_probe import pattern_hits

ALPHABET = st.sampled_from(list("ab =:\nTtruedebugDEBUG\r\t\"'*[]xhttp://1.2.3.4/"))
PATTERNS = [
    (r"(?i)\bdebug\s*(?:=|:)\s*true\b", "(?iU)\\bdebug\\s*(?:=|:)\\s*true\\b", {}),
    (r"(?i)https?://((?:\d{1,3}\.){3}\d{1,3}|(?:[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?))(?::\d+)?",
     "(?iU)https?://((?:\\d{1,3}\\.){3}\\d{1,3}|(?:[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?))(?::\\d+)?", {"g": 1}),
    (r"a+b", "a+b", {}),
]


def py_line_at(contents, n):
    lines = contents.splitlines()
    return lines[n - 1].strip()[:500] if 1 <= n <= len(lines) else ""


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=6))
def test_fold_matches_python(spark, make_files, texts):
    files = make_files({"r": {f"f{i}.py": t for i, t in enumerate(texts)}})
    for py_pat, java_pat, groups in PATTERNS:
        got = sorted((r.file_path, r.pos, r.line, r.m, r.snippet) for r in pattern_hits(files, java_pat, groups).collect())
        want = []
        for i, t in enumerate(texts):
            for m in re.finditer(py_pat, t):
                line = t.count("\n", 0, m.start()) + 1
                want.append((f"f{i}.py", m.start(), line, m.group(0), py_line_at(t, line)))
        assert got == sorted(want), (py_pat, texts)
