"""Single-pass text scan: every regex rule over the corpus in one projection.

Each eligible file is read once; for every rule that applies to the file
(by suffix/name class) and whose pattern occurs in it, the offset fold
produces that rule's matches, all tagged with the rule id and flattened into
one array. Lines are cut out of the file's line array before the array is
exploded, so an exploded row carries its line and never the content. The
result - the *hit table* - is tiny compared with the corpus, so a
multi-detector query checkpoints it (shared checkpoint folder) and every
detector reads the hits instead of the content.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import config_rules as cr
from riskloom.operators import js_rules as js
from riskloom.operators import network_rules as net
from riskloom.operators import prompt_rules as pr
from riskloom.operators import secret_rules as sec
from riskloom.operators.scan import KEYS, check_pattern
from riskloom.sources import files as src


_CONFIG = ("(lower(name) IN ({names}) OR name = '.env' OR startswith(name, '.env.') OR suffix_l IN ({src}))"
           .format(names=", ".join(tx.sql_str(n) for n in src.CONFIG_FILENAMES),
                   src=", ".join(tx.sql_str(n) for n in src.SOURCE_SUFFIXES)))
_JS = "(suffix_l IN ({}))".format(", ".join(tx.sql_str(n) for n in src.JS_SUFFIXES))
_SOURCE = "is_source"
_ALL = "TRUE"

# rule -> (pattern, capture groups -> g1/g2, applies-to (SQL), first match per line only)
TEXT_RULES: dict[str, tuple[str, tuple[int, ...], str, bool]] = {
    "config_debug": (cr.DEBUG_PATTERN, (), _CONFIG, False),
    "config_cors": (cr.CORS_PATTERN, (), _CONFIG, False),
    "js_exec": (js.JS_EXEC, (1,), _JS, True),
    "js_auth": (js.JS_AUTH, (1, 2), _JS, False),
    "js_llm": (pr.JS_LLM_CALL, (), _JS, False),
    "url": (net.URL_PATTERN, (1,), _ALL, False),
    "socket": (net.SOCKET_PATTERN, (1,), _SOURCE, False),
    **{rid: (pat, (), _ALL, False) for rid, pat in sec.SIGNATURES.items()},
    "secret_generic": (sec.GENERIC, (1,), _ALL, False),
}


def _any_of(*texts: str) -> str:
    return "(" + " OR ".join(f"contains(content, {tx.sql_str(t)})" for t in texts) + ")"


def _like(pattern: str) -> str:
    return f"content RLIKE {tx.sql_str(pattern)}"


# What every match of a rule holds, looked for before its pattern: a text without it is not read by the slower one.
# Letters that are looked for without case have no relatives outside ASCII (i, k and s do: they are left out).
NEEDED: dict[str, str] = {
    "config_debug": _like("(?i)debug"),
    "config_cors": _any_of('*"', "*'"),
    "js_exec": _any_of("eval", "Function"),
    "js_auth": _any_of("==", "!="),
    "url": _any_of("://"),
    "socket": _like("(?i)connect"),
    "secret_aws": _any_of("AKIA"),
    "secret_jwt": _any_of("eyJ"),
    "secret_private_key": _any_of("PRIVATE KEY-----"),
    "secret_stripe": _any_of("sk_"),
    "secret_generic": _any_of('"', "'") + " AND " + _like(sec.GENERIC_NEEDED),
}


def _occurs(rule: str) -> str:
    pattern, _, applies, _ = TEXT_RULES[rule]
    return " AND ".join([applies, *([NEEDED[rule]] if rule in NEEDED else []), _like(pattern)])


def _rule_hits_sql(rule: str) -> str:
    pattern, groups, _, first = TEXT_RULES[rule]
    check_pattern(pattern)
    hits = tx.regex_hits_sql("content", pattern, groups, first_per_line=first, rule=rule)
    return (f"CASE WHEN {_occurs(rule)} THEN {hits} "
            f"ELSE CAST(array() AS ARRAY<{tx.HIT_DDL}>) END")


def _unsafe_assignments_sql() -> str:
    """Prompt-named JS assignments whose expression has an unsanitised source."""
    assigns = tx.regex_hits_sql("content", pr.JS_ASSIGN, (1, 2))
    named = " OR ".join(f"instr(lower(a.g1), {tx.sql_str(m)}) > 0" for m in pr.PROMPT_NAME_MARKERS)
    sanit = " OR ".join(f"instr(lower(a.g2), {tx.sql_str(m)}) > 0" for m in pr.SANITIZER_MARKERS)
    source = f"(lower(a.g2) RLIKE {tx.sql_str(pr.JS_SOURCE)} OR instr(lower(a.g2), 'process.env') > 0)"
    return (f"transform(filter({assigns}, a -> ({named}) AND NOT ({sanit}) AND {source}), "
            f"a -> named_struct('name', a.g1, 'pos', a.pos))")


def text_hits(eligible: DataFrame, rules: Iterable[str] | None = None) -> DataFrame:
    """One row per match of any selected rule: KEYS, name, suffix_l, is_source,
    rule, pos, line, m, g1, g2, snippet, whole (uncut line of secret rows),
    window (LLM-call rows), js_vars / js_unsafe (per-file JS facts, on JS rows only)."""
    rules = list(rules or TEXT_RULES)
    content = F.col("content")
    is_js = F.col("suffix_l").isin(src.JS_SUFFIXES)
    per_file = [F.when(is_js, js.decoded_variables(content)).alias("js_vars")] if "js_exec" in rules else \
        [F.lit(None).cast("array<string>").alias("js_vars")]
    if "js_llm" in rules:
        per_file.append(F.expr(f"CASE WHEN {_JS} AND content RLIKE {tx.sql_str(pr.JS_LLM_CALL)} "
                               f"THEN {_unsafe_assignments_sql()} END").alias("js_unsafe"))
    else:
        per_file.append(F.lit(None).cast("array<struct<name:string,pos:int>>").alias("js_unsafe"))
    hits = "flatten(array(" + ", ".join(_rule_hits_sql(r) for r in rules) + "))"
    secrets = [r for r in rules if r in sec.SIGNATURES or r == "secret_generic"]
    lined = tx.line_hits_sql("content", hits, secrets, "js_llm" if "js_llm" in rules else None, pr.WINDOW_CHARS)
    exploded = eligible.select(*KEYS, "name", "suffix_l", "is_source", *per_file, F.explode(F.expr(lined)).alias("h"))
    return exploded.select(*KEYS, "name", "suffix_l", "is_source", "h.rule", "h.pos", "h.line", "h.m", "h.g1", "h.g2",
                           "h.snippet", "h.whole", "h.window", "js_vars", "js_unsafe")
