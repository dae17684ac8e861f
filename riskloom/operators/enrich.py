"""External review verdicts joined onto findings.

The reference asks an LLM about each finding; here the verdicts are a table
``(finding_id, output_text)`` produced by any batch scorer. Requests are
built as rows (E1, E2), responses are validated with VARIANT parsing (E3) and
applied with a left outer join that never adds or drops findings (E4).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.catalog import CONFIDENCE

# Fixed values.
AI_SEVERITIES = ["critical", "high", "medium", "low"]
REQUIRED_KEYS = sorted(["severity", "confidence", "explanation", "fix_suggestion", "exploitability_notes"])
TEXT_FIELDS = ["explanation", "fix_suggestion", "exploitability_notes"]
CONFIDENCE_UPDATE_DELTA = Decimal("0.15")
DEFAULT_CONTEXT_LINES = 12
MAX_CONTEXT_LINES = 15
MAX_CONTEXT_CHARS = 12_000
NUMBER_TYPES = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def reasoning_valid(responses: DataFrame) -> DataFrame:
    """Validate each response; output the parsed verdict or a reason.

    The text is parsed to VARIANT once; field values and their variant types
    are extracted in a second projection (each referenced several times, so
    Catalyst keeps the parse in its own projection instead of repeating it).
    """
    parsed = responses.select(
        "finding_id", "output_text", F.try_parse_json(F.col("output_text")).alias("v"),
        F.array_sort(F.array_distinct(F.json_object_keys(F.col("output_text")))).alias("keys"))
    fields = ["severity", "confidence", *TEXT_FIELDS]
    typed = parsed.select(
        "finding_id", "output_text", "keys", F.schema_of_variant(F.col("v")).alias("vt"),
        (F.col("v").isNull()).alias("bad_json"),
        *[F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{f}", "variant")).alias(f"{f}_t") for f in fields],
        F.try_variant_get(F.col("v"), "$.severity", "string").alias("sev"),
        F.try_variant_get(F.col("v"), "$.confidence", "decimal(38,18)").alias("conf"),
        *[tx.py_strip(F.try_variant_get(F.col("v"), f"$.{f}", "string")).alias(f"{f}_s") for f in TEXT_FIELDS])
    texts_ok = F.lit(True)
    for f in TEXT_FIELDS:
        texts_ok = texts_ok & (F.col(f"{f}_t") == "STRING") & (F.col(f"{f}_s") != "")
    reason = (F.when(F.col("output_text").isNull() | (F.col("output_text") == ""), F.lit("missing_output"))
               .when(F.col("bad_json"), F.lit("not_json"))
               .when(~F.col("vt").startswith("OBJECT") | F.col("keys").isNull()
                     | (F.col("keys") != F.array(*[F.lit(k) for k in REQUIRED_KEYS])), F.lit("bad_keys"))
               .when((F.col("severity_t") != "STRING") | ~F.col("sev").isin(AI_SEVERITIES), F.lit("bad_severity"))
               .when(~F.col("confidence_t").rlike(NUMBER_TYPES), F.lit("confidence_not_number"))
               .when(~texts_ok, F.lit("empty_text"))
               .when(F.col("conf").isNull() | (F.col("conf") < 0) | (F.col("conf") > 1),
                     F.lit("confidence_out_of_range")))
    valid = reason.isNull()
    return typed.select(
        "finding_id", valid.alias("valid"), reason.alias("reason"),
        F.when(valid, F.col("sev")).alias("ai_severity"),
        F.when(valid, F.round(F.col("conf"), 2).cast(CONFIDENCE)).alias("ai_confidence"),
        F.when(valid, F.col("explanation_s")).alias("explanation"),
        F.when(valid, F.col("fix_suggestion_s")).alias("ai_fix"),
        F.when(valid, F.col("exploitability_notes_s")).alias("notes"))


# order in which several valid verdicts of one finding are preferred
VERDICT_COLUMNS = ["ai_severity", "ai_confidence", "explanation", "ai_fix", "notes"]


def best_verdicts(responses: DataFrame) -> DataFrame:
    """One valid verdict per finding, whatever other responses it has.

    Responses are validated first. Among several valid ones the most severe
    wins, then the most confident, then the texts (a total order).
    """
    valid = reasoning_valid(responses).where("valid")
    rank = F.array_position(F.array(*[F.lit(s) for s in AI_SEVERITIES]), F.col("ai_severity"))
    order = F.struct(rank.alias("r"), (-F.col("ai_confidence")).alias("c"), "explanation", "ai_fix", "notes")
    return (valid.groupBy("finding_id").agg(F.min_by(F.struct(*VERDICT_COLUMNS), order).alias("v"))
                 .select("finding_id", "v.*"))


def enrich_findings(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """Apply valid verdicts; invalid or missing ones leave the row as is.

    Severity is replaced; confidence only when it moves by at least 0.15;
    explanation and notes are joined; the fix text is replaced. A left outer
    join on the finding key: the row count is unchanged by construction.
    """
    j = findings.join(best_verdicts(responses), "finding_id", "left")
    hit = F.col("ai_severity").isNotNull()
    move = F.abs(F.col("ai_confidence") - F.col("confidence")) >= F.lit(CONFIDENCE_UPDATE_DELTA)
    out = (j.withColumn("severity", F.when(hit, F.col("ai_severity")).otherwise(F.col("severity")))
            .withColumn("confidence", F.when(hit & move, F.col("ai_confidence")).otherwise(F.col("confidence")))
            .withColumn("ai_explanation", F.when(hit, F.concat(F.col("explanation"),
                                                                F.lit("\n\nExploitability notes: "), F.col("notes"))))
            .withColumn("fix_suggestion", F.when(hit, F.col("ai_fix")).otherwise(F.col("fix_suggestion"))))
    return out.drop("ai_severity", "ai_confidence", "explanation", "notes", "ai_fix")


def code_context(findings: DataFrame, files: DataFrame, context_lines: int = DEFAULT_CONTEXT_LINES) -> DataFrame:
    """Numbered source lines around each finding (null when the anchor is invalid).

    The join brings each finding to its file; files without findings are
    dropped by the join (a semi-join filter on the file key first keeps the
    shuffled side to files that matter).
    """
    window = min(max(context_lines, 0), MAX_CONTEXT_LINES)
    keys = ["repo_id", "commit_sha", "file_path"]
    wanted = findings.select(*keys).distinct()
    f = files.join(wanted, keys, "left_semi").select(*keys, tx.splitlines(F.col("content")).alias("lines"),
                                                      tx.line_count(F.col("content")).alias("n"))
    j = findings.join(f, keys, "left")
    a0 = F.coalesce(F.col("line_start"), F.lit(1))
    ok = F.col("n").isNotNull() & (F.col("n") > 0) & (a0 >= 1) & (a0 <= F.col("n"))
    a1 = F.least(F.greatest(F.coalesce(F.col("line_end"), a0), a0), F.col("n"))
    start = F.greatest(F.lit(1), a0 - window)
    end = F.least(F.col("n"), a1 + window)
    numbered = F.transform(F.slice(F.col("lines"), start, end - start + 1),
                           lambda ln, i: F.format_string("%5d: %s", start + i, ln))
    excerpt = F.substring(F.array_join(numbered, "\n"), 1, MAX_CONTEXT_CHARS)
    return j.select(*[c for c in findings.columns],
                    F.when(ok, start).alias("context_start"), F.when(ok, end).alias("context_end"),
                    F.when(ok, excerpt).alias("context"))


def reasoning_requests(contexts: DataFrame) -> DataFrame:
    """The request payload per finding: ten finding fields as JSON plus context."""
    payload = F.to_json(F.struct(
        "detector", "category", "severity", F.col("confidence").cast("string").alias("confidence"), "file_path",
        "line_start", "line_end", "code_snippet", "title", "description"))
    return contexts.where(F.col("context").isNotNull()).select(
        "repo_id", "commit_sha", "file_path", "line_start", "title", payload.alias("finding_json"),
        "context_start", "context_end", "context")
