"""Network-shaped backdoor heuristics: raw IPs, isolated domains, install scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.catalog import CONFIDENCE, emit

# Patterns (Java spelling), install script names, safe hosts.
URL_PATTERN = "(?iU)https?://((?:\\d{1,3}\\.){3}\\d{1,3}|(?:[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?))(?::\\d+)?"
SOCKET_PATTERN = ("(?iU)\\b(?:[A-Za-z_][\\w]*\\.connect|socket\\.create_connection)\\s*\\(\\s*\\(\\s*[\"']"
                  "((?:\\d{1,3}\\.){3}\\d{1,3})[\"']\\s*,")
INSTALL_SCRIPT_NAMES = ["preinstall", "install", "postinstall"]
REMOTE_DOWNLOAD = "(?iU)\\b(?:curl|wget)\\b[^\\n]*(?:https?://)|\\bfetch\\s*\\("
INLINE_NODE = "(?iU)\\bnode\\s+(?:-e|--eval)\\b"
SHELL_COMMAND = "(?iU)\\b(?:sh|bash|zsh|cmd(?:\\.exe)?|powershell)\\b"
# socket rows come after all URL rows of a file
AFTER_URLS = 1 << 40
SAFE_DESTINATIONS = ["localhost", "127.0.0.1", "0.0.0.0"]

RAW_IP_TAIL = (" Raw destinations can indicate exfiltration or command-and-control, but require "
               "contextual review.")
DOMAIN_TAIL = (" appears only once in the repository and is not referenced by other source or configuration "
               "files. This is a noisy heuristic, not a reputation verdict.")
INSTALL_TAIL = (". Install lifecycle scripts run automatically and can execute a dependency-level backdoor.")


def url_refs(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Every http(s) URL host in every eligible text file (fact table)."""
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["url"]) if hits is None else hits
    hits = hits.where(F.col("rule") == "url")
    host = F.lower(F.col("g1"))
    return hits.select("repo_id", "commit_sha", "file_path", "is_source", "pos", "line", "snippet",
                       host.alias("host"), tx.is_ipv4(host).alias("is_ip"))


def _raw_ip_description(transport: str, host: Column) -> Column:
    return F.concat(F.lit(f"A {transport} targets raw IP address "), host, F.lit("." + RAW_IP_TAIL))


def raw_ip_url(eligible: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """URL host is an IP address, in a source file."""
    refs = url_refs(eligible) if refs is None else refs
    hits = refs.where(F.col("is_ip") & F.col("is_source"))
    return emit(hits, "raw_ip", line_start=F.col("line"), snippet=F.col("snippet"),
                description=_raw_ip_description("HTTP client URL", F.col("host")), order=F.col("pos"))


def raw_ip_socket(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """X.connect(("ip", ...) / socket.create_connection(("ip", ...) in source."""
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["socket"]) if hits is None else hits
    hits = hits.where((F.col("rule") == "socket") & tx.is_ipv4(F.col("g1"))).withColumnRenamed("g1", "ip")
    return emit(hits, "raw_ip", line_start=F.col("line"), snippet=F.col("snippet"),
                description=_raw_ip_description("raw socket connection", F.col("ip")), order=F.col("pos") + AFTER_URLS)


def isolated_domain(eligible: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """A non-IP host referenced exactly once in the repository, in source.

    References are counted per (repo, host) with an aggregation, which
    combines map-side, so a host referenced millions of times costs one
    partial count per task, not one task holding all its rows; only hosts
    seen once are joined back to their single reference.
    """
    refs = url_refs(eligible) if refs is None else refs
    key = ["repo_id", "commit_sha", "host"]
    domains = refs.where(~F.col("is_ip") & ~F.col("host").isin(SAFE_DESTINATIONS))
    once = domains.groupBy(*key).agg(F.count(F.lit(1)).alias("refs")).where(F.col("refs") == 1).select(*key)
    hits = domains.where(F.col("is_source")).join(once, key, "left_semi")
    return emit(hits, "isolated_domain", line_start=F.col("line"), snippet=F.col("snippet"),
                description=F.concat(F.col("host"), F.lit(DOMAIN_TAIL)), order=F.col("pos"))


def install_script(eligible: DataFrame) -> DataFrame:
    """Suspicious preinstall/install/postinstall commands in package.json.

    JSON is parsed to VARIANT (invalid JSON -> NULL -> no rows); a command must
    be a JSON string. The first rule that matches decides the confidence.
    """
    pkgs = eligible.where(F.col("name") == "package.json").withColumn("v", F.try_parse_json(F.col("content")))
    pkgs = pkgs.where(F.col("v").isNotNull() & F.schema_of_variant(F.col("v")).startswith("OBJECT"))
    rows = pkgs.select(
        "repo_id", "commit_sha", "file_path", "content",
        F.explode(F.array(*[F.struct(F.lit(n).alias("script"),
                                     F.try_variant_get(F.col("v"), f"$.scripts.{n}", "variant").alias("cmdv"))
                            for n in INSTALL_SCRIPT_NAMES])).alias("s"))
    rows = rows.select("repo_id", "commit_sha", "file_path", "content", "s.script", "s.cmdv")
    rows = rows.where(F.col("cmdv").isNotNull() & (F.schema_of_variant(F.col("cmdv")) == "STRING"))
    cmd = F.try_variant_get(F.col("cmdv"), "$", "string")
    reason = (F.when(cmd.rlike(INLINE_NODE), F.lit("invokes node with inline code"))
               .when(cmd.rlike(REMOTE_DOWNLOAD), F.lit("downloads or fetches remote content"))
               .when(cmd.rlike(SHELL_COMMAND), F.lit("invokes a shell command")))
    conf = (F.when(cmd.rlike(INLINE_NODE), F.lit("0.90"))
             .when(cmd.rlike(REMOTE_DOWNLOAD), F.lit("0.86"))
             .when(cmd.rlike(SHELL_COMMAND), F.lit("0.62")))
    rows = rows.withColumn("reason", reason).withColumn("conf", conf.cast(CONFIDENCE)).where(F.col("reason").isNotNull())
    # line of the first `"<script>"\s*:` in the raw text, else 1
    key_pat = F.concat(F.lit('(?U)"\\Q'), F.col("script"), F.lit('\\E"\\s*:'))
    at = F.call_function("regexp_instr", F.col("content"), key_pat)
    line = F.when(at > 0, tx.newline_count(F.substring(F.col("content"), 1, at - 1)) + 1).otherwise(F.lit(1))
    rows = rows.withColumn("line", line)
    rows = rows.withColumn("snippet", tx.line_at(tx.splitlines(F.col("content")), F.col("line")))
    desc = F.concat(F.lit("The "), F.col("script"), F.lit(" script "), F.col("reason"), F.lit(INSTALL_TAIL))
    return emit(rows, "install_script", line_start=F.col("line"), snippet=F.col("snippet"), description=desc,
                confidence=F.col("conf"), order=F.array_position(F.array(*[F.lit(n) for n in INSTALL_SCRIPT_NAMES]), F.col("script")))


def backdoor_dedupe(findings: DataFrame) -> DataFrame:
    """Detector-local merge on (category, path, line, title): the last
    match stays (URLs in text order, then sockets; ``_order``). The final
    merge (R1) repeats it across detectors."""
    keys = ["repo_id", "commit_sha", "category", "file_path", "line_start", "title"]
    cols = [c for c in findings.columns if c != "_order"]
    return (findings.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("_order", "description")).alias("f"))
                    .select("f.*"))
