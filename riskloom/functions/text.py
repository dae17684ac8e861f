"""Scalar text helpers as Catalyst expressions (no Python in the row path).

Regex dialect: detectors are written for Python's ``re`` (Unicode ``\\w``,
``\\b``, ``\\s``); Java needs ``(?U)`` for the same behaviour, which the rule
catalogue adds to every pattern.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks recognised by Python's str.splitlines() ("\r\n" first).
SPLITLINES_PATTERN = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
# Characters removed by Python's str.strip(): Unicode White_Space plus the
# four ASCII separators 0x1C-0x1F that Python also treats as whitespace.
_WS = "[\\s\\x1C-\\x1F]"
STRIP_PATTERN = f"(?U)^{_WS}+|{_WS}+$"

SNIPPET_CHARS = 500

def py_strip(col: Column) -> Column:
    return F.regexp_replace(col, STRIP_PATTERN, "")


def splitlines(content: Column) -> Column:
    """Python ``str.splitlines()`` as an array (may hold one extra trailing '')."""
    return F.split(content, SPLITLINES_PATTERN, -1)


def line_count(content: Column) -> Column:
    """``len(content.splitlines())``: drop the empty piece after a final break."""
    parts = splitlines(content)
    n = F.size(parts)
    return (F.when(F.length(content) == 0, F.lit(0))
            .when(F.element_at(parts, -1) == "", n - 1)
            .otherwise(n))


def line_at(lines: Column, line_no: Column) -> Column:
    """Stripped line ``line_no`` (1-based) cut to 500 chars; '' when out of range."""
    raw = F.when((line_no >= 1) & (line_no <= F.size(lines)), F.element_at(lines, line_no.cast("int")))
    return F.coalesce(F.substring(py_strip(raw), 1, SNIPPET_CHARS), F.lit(""))


def newline_count(s: Column) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, "\n", ""))


def sql_str(s: str) -> str:
    """A Spark SQL string literal for ``s`` (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


HIT_DDL = "STRUCT<rule:STRING,pos:INT,line:INT,m:STRING,g1:STRING,g2:STRING>"
LINE_HIT_DDL = HIT_DDL[:-1] + ",snippet:STRING,whole:STRING,window:STRING>"
# matches folded at once: the running state copies at most this many, then one append per chunk
FOLD_CHUNK = 128


def regex_hits_sql(content: str, pattern: str, groups: tuple[int, ...] = (), first_per_line: bool = False,
                   rule: str = "") -> str:
    """SQL text of an ARRAY<HIT_DDL> with every match of ``pattern`` in column ``content``.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the k-th
    match starts after parts[0..k] and matches[0..k-1]. The arrays are zipped
    once (the part after the last match is cut off) and a left fold carries the running offset and newline count. The
    fold goes in chunks: within a chunk the hits gathered so far are copied at
    every step, across chunks once per chunk. Needs a pattern without
    zero-width matches (asserted by the rule catalogue). Each hit: pos
    (0-based), line (1 + "\\n" before it), m (match), g1/g2 (capture groups).
    Built as one SQL expression so the driver parses it once on the JVM side.
    """
    p = sql_str(pattern)
    args = [f"split({content}, {p}, -1)", f"regexp_extract_all({content}, {p}, 0)"]
    args += [f"regexp_extract_all({content}, {p}, {g})" for g in groups[:2]]
    g1 = "x.`2`" if len(groups) > 0 else "CAST(NULL AS STRING)"
    g2 = "x.`3`" if len(groups) > 1 else "CAST(NULL AS STRING)"

    def nlc(e):
        return f"(length({e}) - length(replace({e}, '\\n', '')))"

    start = "(acc.off + length(x.`0`))"
    line = f"(acc.line + {nlc('x.`0`')})"
    hit = f"named_struct('rule', {sql_str(rule)}, 'pos', {start}, 'line', {line}, 'm', x.`1`, 'g1', {g1}, 'g2', {g2})"
    out = f"concat(acc.out, array({hit}))"
    if first_per_line:
        out = f"(CASE WHEN {line} = acc.lh THEN acc.out ELSE {out} END)"
    step = (f"named_struct('off', {start} + length(x.`1`), 'line', {line} + {nlc('x.`1`')}, 'lh', {line}, 'out', {out})")
    empty = f"CAST(array() AS ARRAY<{HIT_DDL}>)"
    init = f"named_struct('off', 0, 'line', 1, 'lh', 0, 'out', {empty})"
    inner = (f"aggregate(chunk, named_struct('off', whole.off, 'line', whole.line, 'lh', whole.lh, 'out', {empty}), "
             f"(acc, x) -> {step})")
    joined = "named_struct('off', r.off, 'line', r.line, 'lh', r.lh, 'out', concat(w.out, r.out))"
    # array(...) binds the chunk's result once
    outer = f"aggregate(array({inner}), whole, (w, r) -> {joined})"
    chunks = (f"transform(sequence(0, CAST((size(z) - 1) DIV {FOLD_CHUNK} AS INT)), i -> slice(z, i * {FOLD_CHUNK} + 1, {FOLD_CHUNK}))")
    zipped = f"transform(array(arrays_zip({', '.join(args)})), y -> slice(y, 1, size(y) - 1))"
    return (f"flatten(transform({zipped}, z -> CASE WHEN size(z) = 0 THEN {empty} ELSE "
            f"aggregate({chunks}, {init}, (whole, chunk) -> {outer}, whole -> whole.out) END))")


def line_hits_sql(content: str, hits: str, whole_rules: Iterable[str] = (), window_rule: str | None = None,
                  window_chars: int = 0) -> str:
    """SQL text of an ARRAY<LINE_HIT_DDL>: each hit with its line, cut out of the file's line array.

    The file is split into lines once (only if it has a hit) and a hit's line
    is an array element. ``snippet`` is the stripped line cut to 500
    characters; ``whole`` is the uncut line for ``whole_rules``; ``window`` is
    the text from the match on for ``window_rule``.
    """
    line = f"regexp_replace(CASE WHEN h.line <= size(ls) THEN element_at(ls, h.line) ELSE '' END, {sql_str(STRIP_PATTERN)}, '')"
    whole = [sql_str(r) for r in whole_rules]
    keep = f"CASE WHEN h.rule IN ({', '.join(whole)}) THEN t END" if whole else "CAST(NULL AS STRING)"
    window = (f"CASE WHEN h.rule = {sql_str(window_rule)} THEN substring({content}, h.pos + 1, {window_chars}) END"
              if window_rule else "CAST(NULL AS STRING)")
    one = (f"transform(array({line}), t -> named_struct('rule', h.rule, 'pos', h.pos, 'line', h.line, 'm', h.m, 'g1', h.g1, "
           f"'g2', h.g2, 'snippet', substring(t, 1, {SNIPPET_CHARS}), 'whole', {keep}, 'window', {window}))[0]")
    lines = f"split({content}, {sql_str(SPLITLINES_PATTERN)}, -1)"
    return (f"flatten(transform(array({hits}), hs -> CASE WHEN size(hs) = 0 THEN CAST(array() AS ARRAY<{LINE_HIT_DDL}>) "
            f"ELSE flatten(transform(array({lines}), ls -> transform(hs, h -> {one}))) END))")


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_suffix(path: Column) -> Column:
    """``Path(path).suffix``: last dot not at the start of the name ('' if none)."""
    return F.regexp_extract(path_name(path), "^.+(\\.[^.]*)$", 1)


def canonicalize(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


# Valid dotted-quad IPv4 (octets 0-255, no leading zeros), as ipaddress accepts.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"


def is_ipv4(host: Column) -> Column:
    return host.rlike(IPV4_PATTERN)


def shannon_entropy(value: Column) -> Column:
    """Bits per character of ``value`` (0.0 for empty)."""
    # one element per character (a zero-width split also yields a trailing '')
    chars = F.filter(F.split(value, "(?!^)"), lambda x: x != "")
    n = F.size(chars).cast("double")
    distinct = F.array_distinct(chars)
    counts = F.transform(distinct, lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(
        F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - (c / n) * F.log2(c / n)))


def contains_any(col: Column, markers: list[str]) -> Column:
    """Substring test for any of ``markers`` (literal)."""
    cond = F.lit(False)
    for m in markers:
        cond = cond | F.instr(col, m).__gt__(0)
    return cond


def redact(line: Column, patterns: Iterable[tuple[str, str]]) -> Column:
    """the whole line with every secret in it replaced, then cut to 500 characters."""
    for pattern, replacement in patterns:
        line = F.regexp_replace(line, pattern, replacement)
    return F.substring(line, 1, SNIPPET_CHARS)


def duration_ms(started: Column, completed: Column) -> Column:
    """max(0, whole milliseconds between two timestamps), NULL when the start is unknown."""
    between = F.unix_micros(completed) - F.unix_micros(started)
    return F.when(started.isNotNull(), F.floor(F.greatest(F.lit(0), between) / 1000))


def error_text(kind: Column, message: Column) -> Column:
    """``Type: message`` cut at 1,000 characters."""
    return F.substring(F.concat(kind, F.lit(": "), message), 1, 1000)


def warnings_text(warnings: Column) -> Column:
    """detector warnings joined with '; ' and cut at 900 characters."""
    return F.substring(F.array_join(warnings, "; "), 1, 900)
