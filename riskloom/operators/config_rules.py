"""Configuration audit: debug flags, wildcard CORS, committed env files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.catalog import emit
from riskloom.sources import files as src

# Patterns (Java spelling of the reference's Python regexes).
DEBUG_PATTERN = "(?iU)\\bdebug\\s*(?:=|:)\\s*true\\b"
CORS_PATTERN = ("(?iU)(?:allow_origins|cors[_-]?origins?|origins|alloworigin|allowedorigins|origin)"
                "\\s*[:=]\\s*\\[?\\s*[\"']\\*[\"']")

DEBUG_DESCRIPTION = ("DEBUG=True in a deployment-oriented configuration can expose stack traces and "
                     "sensitive details.")
CORS_DESCRIPTION = ("Allowing every origin can expose authenticated browser-accessible endpoints to "
                    "untrusted sites.")
ENV_DESCRIPTION = "A committed environment file can expose credentials or production settings."
ENV_SNIPPET = ".env file is present and not ignored"


def is_env_file(name: Column) -> Column:
    return (name == ".env") | name.startswith(".env.")


def config_debug(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Every ``debug = true`` / ``debug: true`` match in config-class files."""
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["config_debug"]) if hits is None else hits
    h = hits.where(F.col("rule") == "config_debug")
    return emit(h, "config_debug", line_start=F.col("line"), snippet=F.col("snippet"),
                description=F.lit(DEBUG_DESCRIPTION))


def config_cors(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Wildcard origin assignments in config-class files."""
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["config_cors"]) if hits is None else hits
    h = hits.where(F.col("rule") == "config_cors")
    return emit(h, "config_cors", line_start=F.col("line"), snippet=F.col("snippet"),
                description=F.lit(CORS_DESCRIPTION))


def env_committed(eligible: DataFrame, files: DataFrame) -> DataFrame:
    """Env files not covered by the root .gitignore.

    Patterns are scanned in order; the first *decisive* one settles the file:
    ``.env`` ignores only files named .env, ``.env*``/``.env.*`` ignore every
    env file, an exact path ignores that path. A generic pattern is decisive
    for every env file of the repository, an exact path only for its own file,
    so the earliest decisive pattern is the earlier of
    - the first generic pattern of the repository (an aggregation), and
    - the first pattern equal to the file's path (an equi-join + aggregation).
    No pattern list is gathered and no (file, pattern) pairs are formed.
    """
    keys = ["repo_id", "commit_sha"]
    env = (eligible.where(is_env_file(F.col("name"))).select(*keys, "file_path", "name")
                   .withColumn("normalized", F.regexp_replace("file_path", "^/+", "")))
    pats = src.gitignore_patterns(files).withColumn("cleaned", F.regexp_replace("pattern", "^/+", ""))
    generic = (pats.where(F.col("cleaned").isin(".env", ".env*", ".env.*"))
               .groupBy(*keys).agg(F.min_by("cleaned", "pos").alias("g_pat"), F.min("pos").alias("g_pos")))
    exact = (env.select(*keys, "file_path", "normalized")
             .join(pats.select(*keys, F.col("cleaned").alias("normalized"), "pos"), [*keys, "normalized"])
             .groupBy(*keys, "file_path").agg(F.min("pos").alias("e_pos")))
    j = env.join(generic, keys, "left").join(exact, [*keys, "file_path"], "left")
    generic_first = F.col("g_pos").isNotNull() & (F.col("e_pos").isNull() | (F.col("g_pos") < F.col("e_pos")))
    ignored = (F.when(generic_first & (F.col("g_pat") == ".env"), F.col("name") == ".env")
                .when(generic_first, F.col("name").startswith(".env"))
                .when(F.col("e_pos").isNotNull(), F.lit(True))
                .otherwise(F.lit(False)))
    flagged = j.where(~ignored)
    return emit(flagged, "env_committed", line_start=F.lit(1), snippet=F.lit(ENV_SNIPPET),
                description=F.lit(ENV_DESCRIPTION))
