"""JS/TS prompt-injection heuristic.

For every LLM-call match, a 1,500-character window from the call start is
tested: it uses an unsafe prompt variable assigned at most 2,000 characters
earlier (a band lookup against the file's assignment list, evaluated as an
array predicate on the same row - no join), or it builds an unsafe prompt
inline. One finding per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.catalog import emit

# Patterns (Java spelling), markers and distances.
JS_ASSIGN = "(?iU)\\b(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)\\s*=\\s*([^;\\n]+)"
JS_LLM_CALL = (
    "(?iU)(?:"
    "\\b[\\w$.]*chat\\.completions\\.create\\s*\\("
    "|\\b[\\w$.]*messages\\.create\\s*\\("
    "|\\b[\\w$.]*generateContent\\s*\\("
    "|\\b(?:llm|model|openai|anthropic|genai|client)[\\w$.]*\\.(?:generate|complete|chat)\\s*\\("
    "|\\b(?:fetch|axios(?:\\.(?:post|request))?)\\s*\\(\\s*['\"][^'\"]*"
    "(?:openai|anthropic|generativelanguage|/v1/(?:chat|messages|completions))"
    ")")
JS_SOURCE = "(?U)\\b(?:request|req|form|body|query|params|user|input)[a-z0-9_$]*\\b"
PROMPT_NAME_MARKERS = ["prompt", "message", "instruction", "completion", "query"]
SANITIZER_MARKERS = ["sanitize", "escape", "validate", "allowlist", "whitelist", "normalize"]
WINDOW_CHARS = 1_500
NEAR_CHARS = 2_000

DESCRIPTION = (
    "JavaScript/TypeScript code appears to pass request, user, or environment-derived data into an LLM prompt "
    "without a statically visible instruction/data boundary. Review recommended: verify that user input is "
    "bounded, validated, and separated from trusted instructions.")


def unsanitized_source(expr: Column) -> Column:
    """No sanitizer marker, and a request-like word or process.env."""
    low = F.lower(expr)
    return ~tx.contains_any(low, SANITIZER_MARKERS) & (low.rlike(JS_SOURCE) | (F.instr(low, "process.env") > 0))


def prompt_construction(expr: Column) -> Column:
    low = F.lower(expr)
    return ((F.instr(expr, "$" + "{") > 0) | (F.instr(expr, "+") > 0)
            | (F.instr(low, "messages") > 0) | (F.instr(low, "prompt") > 0))


def _word_in(text: Column, word: Column) -> Column:
    pattern = F.concat(F.lit("(?U)\\b\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b"))
    return (F.instr(text, word) > 0) & F.call_function("rlike", text, pattern)


def js_prompt_injection(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["js_llm"]) if hits is None else hits
    calls = hits.where(F.col("rule") == "js_llm")
    pos, window = F.col("pos"), F.col("window")
    unsafe = F.coalesce(F.col("js_unsafe"), F.array().cast("array<struct<name:string,pos:int>>"))
    near = F.exists(unsafe, lambda a: (a["pos"] < pos) & (pos - a["pos"] <= NEAR_CHARS)
                    & _word_in(window, a["name"]))
    inline = unsanitized_source(window) & prompt_construction(window)
    flagged = calls.where(near | inline)
    # one finding per line: the first flagged call (aggregation by line key)
    per_line = (flagged.groupBy("repo_id", "commit_sha", "file_path", "line")
                .agg(F.min_by("snippet", "pos").alias("snippet")))
    return emit(per_line, "js_prompt_injection", line_start=F.col("line"), snippet=F.col("snippet"),
                description=F.lit(DESCRIPTION))
