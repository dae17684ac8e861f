"""One pattern through the scan's own expressions, for tests of offsets and snippets."""

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.scan import check_pattern


def pattern_hits(files, pattern, groups=None, first_per_line=False):
    """Every match of one pattern with line and snippet."""
    groups = groups or {}
    found = tx.regex_hits_sql("content", check_pattern(pattern), tuple(groups.values()), first_per_line)
    rows = files.select("file_path", F.explode(F.expr(tx.line_hits_sql("content", found))).alias("h"))
    return rows.select("file_path", "h.pos", "h.line", "h.m", "h.snippet", *[F.col(f"h.g{i + 1}").alias(g) for i, g in enumerate(groups)])
