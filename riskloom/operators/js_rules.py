"""JavaScript/TypeScript pattern rules: dynamic execution and auth bypass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.catalog import emit

# Patterns (Java spelling) and markers.
JS_EXEC = "(?U)\\b(eval|new\\s+Function)\\s*\\("
JS_DECODE = ("(?iU)\\b(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)\\s*=\\s*"
             "(?:atob\\s*\\(|Buffer\\.from\\s*\\([^;\\n]*?base64[^;\\n]*?\\)\\s*\\.toString)")
JS_AUTH = ("(?iU)\\b(?:if|else\\s+if)\\s*\\(\\s*([^()\\n]+?)\\s*"
           "(?:===|==|!==|!=)\\s*([^)\\n]+?)\\s*\\)")
STRING_LITERAL = "^\\s*(['\"])(?:\\\\.|(?!\\1).)*\\1\\s*$"
AUTH_MARKERS = ["auth", "token", "password", "secret", "api_key", "apikey", "key", "admin", "username"]

EXEC_DESCRIPTION_TAIL = " JavaScript content. This regex-based detection should be reviewed with source context."
AUTH_DESCRIPTION = ("An auth/token/admin-like value is compared to a hardcoded string. "
                    "This may create a static credential or hidden bypass.")


def decoded_variables(content: Column) -> Column:
    """Names assigned from atob(...) or Buffer.from(..base64..).toString."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(JS_DECODE), F.lit(1)))


def _word_in(text: Column, word: Column) -> Column:
    # \b<word>\b with the name quoted literally; guarded by a cheap substring test
    pattern = F.concat(F.lit("(?U)\\b\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b"))
    return (F.instr(text, word) > 0) & F.call_function("rlike", text, pattern)


def execution_kind(snippet: Column, variables: Column) -> Column:
    """Decoded / concatenated / dynamic, judged on the snippet line."""
    low = F.lower(snippet)
    decoded_call = (F.instr(low, "atob(") > 0) | ((F.instr(low, "buffer.from(") > 0) & (F.instr(low, "base64") > 0))
    uses_var = F.exists(F.coalesce(variables, F.array().cast("array<string>")), lambda v: _word_in(snippet, v))
    return (F.when(decoded_call | uses_var, F.lit("decoded"))
             .when(F.instr(snippet, "+") > 0, F.lit("concatenated"))
             .otherwise(F.lit("dynamic")))


def js_dynamic_exec(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """eval(/new Function( - one finding per line (the first call on it;
    the offset fold drops later calls of a line, no shuffle)."""
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["js_exec"]) if hits is None else hits
    h = hits.where(F.col("rule") == "js_exec").withColumnRenamed("g1", "call")
    per_line = h.withColumn("kind", execution_kind(F.col("snippet"), F.col("js_vars")))
    rule = F.when(F.col("kind") == "decoded", F.lit("js_exec_decoded")).otherwise(F.lit("js_exec_other"))
    desc = F.concat(F.col("call"), F.lit("() executes "), F.col("kind"), F.lit(EXEC_DESCRIPTION_TAIL))
    return emit(per_line, rule, line_start=F.col("line"), snippet=F.col("snippet"), description=desc)


def is_string_literal(value: Column) -> Column:
    return value.rlike(STRING_LITERAL)


def mentions_auth_marker(value: Column) -> Column:
    return tx.contains_any(F.replace(F.lower(value), F.lit("-"), F.lit("_")), AUTH_MARKERS)


def js_auth_bypass(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """If (<literal> ==/=== <auth-ish name>) in either order."""
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["js_auth"]) if hits is None else hits
    hits = hits.where(F.col("rule") == "js_auth")
    left, right = tx.py_strip(F.col("g1")), tx.py_strip(F.col("g2"))
    left_lit, right_lit = is_string_literal(left), is_string_literal(right)
    variable_side = F.when(left_lit, right).otherwise(left)
    flagged = hits.where((left_lit | right_lit) & mentions_auth_marker(variable_side))
    return emit(flagged, "js_auth_bypass", line_start=F.col("line"), snippet=F.col("snippet"),
                description=F.lit(AUTH_DESCRIPTION))
