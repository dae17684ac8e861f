"""Dependency audit: manifest parsing, typosquats, obscure names.

Every step is row-local or a window over one manifest's lines: the distance
to the 33 popular names is an array expression evaluated per dependency, so
there is no join (and no cross product) at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.catalog import emit

# Popular package names (33) and npm dependency sections.
POPULAR_PACKAGES = [
    "react", "reactdom", "next", "express", "lodash", "axios", "typescript", "vite", "vue", "angular",
    "mongoose", "jsonwebtoken", "bcrypt", "dotenv", "prisma", "tailwindcss", "django", "flask", "fastapi",
    "requests", "numpy", "pandas", "sqlalchemy", "pydantic", "pytest", "celery", "redis", "cryptography",
    "httpx", "uvicorn", "gin", "mux", "cobra",
]
DEPENDENCY_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
PIP_SKIP_PREFIXES = ["#", "-", "git+", "http://", "https://"]
MAX_TYPO_DISTANCE = 2


def _first_line_of(content: Column, name: Column) -> Column:
    """Line of the first `"<name>"\\s*:` in the raw JSON text, else 1."""
    quoted = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit('(?U)"\\Q'), quoted, F.lit('\\E"\\s*:'))
    at = F.call_function("regexp_instr", content, pattern)
    return F.when(at > 0, tx.newline_count(F.substring(content, 1, at - 1)) + 1).otherwise(F.lit(1))


def deps_npm(manifests: DataFrame) -> DataFrame:
    """Keys of the four dependency sections of package.json (valid JSON objects only)."""
    pkgs = (manifests.where(F.col("name") == "package.json")
            .withColumn("v", F.try_parse_json(F.col("content")))
            .where(F.col("v").isNotNull() & F.schema_of_variant(F.col("v")).startswith("OBJECT")))
    keys = [F.json_object_keys(F.to_json(F.try_variant_get(F.col("v"), f"$.{s}", "variant")))
            for s in DEPENDENCY_SECTIONS]
    names = F.flatten(F.array(*[F.coalesce(k, F.array().cast("array<string>")) for k in keys]))
    rows = pkgs.select("repo_id", "commit_sha", "file_path", "content", F.explode(names).alias("dep_name"))
    rows = rows.withColumn("line", _first_line_of(F.col("content"), F.col("dep_name")))
    return rows.select("repo_id", "commit_sha", "file_path", "dep_name", "line",
                       tx.line_at(tx.splitlines(F.col("content")), F.col("line")).alias("snippet"))


def _manifest_lines(manifests: DataFrame, name: str) -> DataFrame:
    files = manifests.where(F.col("name") == name)
    lines = files.select("repo_id", "commit_sha", "file_path",
                         F.posexplode(tx.splitlines(F.col("content"))).alias("idx", "raw"))
    return lines.select("repo_id", "commit_sha", "file_path", (F.col("idx") + 1).alias("line"), "raw",
                        tx.py_strip(F.col("raw")).alias("stripped"))


def deps_pip(manifests: DataFrame) -> DataFrame:
    """Requirement lines; the name is the text before the first specifier char."""
    lines = _manifest_lines(manifests, "requirements.txt")
    skip = F.lit(False)
    for p in PIP_SKIP_PREFIXES:
        skip = skip | F.col("stripped").startswith(p)
    name = F.get(F.split(F.col("stripped"), "(?U)[<>=!~;\\s\\[]", 2), 0)
    rows = lines.where((F.col("stripped") != "") & ~skip).withColumn("dep_name", name).where(F.col("dep_name") != "")
    return rows.select("repo_id", "commit_sha", "file_path", "dep_name", "line",
                       F.substring(F.col("stripped"), 1, tx.SNIPPET_CHARS).alias("snippet"))


def deps_go(manifests: DataFrame) -> DataFrame:
    """``require x`` lines and the lines of ``require ( ... )`` blocks.

    Block state is a running window: the last open/close marker before the
    line, over the lines of one go.mod ordered by line number.
    """
    lines = _manifest_lines(manifests, "go.mod")
    s = F.col("stripped")
    marker = F.when(s.startswith("require ("), F.lit(True)).when(s == ")", F.lit(False))
    w = (Window.partitionBy("repo_id", "commit_sha", "file_path").orderBy("line")
         .rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("marker", marker).withColumn(
        "in_block", F.coalesce(F.last("marker", ignorenulls=True).over(w), F.lit(False)))
    first_word = lambda c: F.get(F.split(F.regexp_replace(c, "(?U)^\\s+", ""), "(?U)\\s+"), 0)
    candidate = (F.when(s.startswith("require ("), F.lit(None))
                  .when(F.col("in_block") & (s == ")"), F.lit(None))
                  .when(s.startswith("require "), first_word(F.substring(s, 9, 1 << 30)))
                  .when(F.col("in_block") & (s != "") & ~s.startswith("//"), first_word(s)))
    rows = lines.withColumn("dep_name", candidate).where(F.col("dep_name").isNotNull() & (F.col("dep_name") != ""))
    return rows.select("repo_id", "commit_sha", "file_path", "dep_name", "line",
                       F.substring(s, 1, tx.SNIPPET_CHARS).alias("snippet"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """All parsed dependencies."""
    return deps_npm(manifests).unionByName(deps_pip(manifests)).unionByName(deps_go(manifests))


def _closest_popular_sql(candidate: str) -> str:
    """SQL: struct(dist, name) of the nearest popular package within distance 2, else NULL.

    The 33 names are an array literal; each candidate is compared inside an
    array expression (length band first), so there is no join. Ties go to the
    alphabetically first name.
    """
    popular = "array(" + ", ".join(f"'{p}'" for p in sorted(POPULAR_PACKAGES)) + ")"
    scored = (f"filter(transform({popular}, p -> named_struct('dist', CASE WHEN abs(length(p) - length({candidate}))"
              f" <= {MAX_TYPO_DISTANCE} THEN levenshtein({candidate}, p, {MAX_TYPO_DISTANCE}) ELSE -1 END, "
              f"'name', p)), x -> x.dist >= 0)")
    return (f"CASE WHEN {candidate} <> '' AND NOT array_contains({popular}, {candidate}) AND size({scored}) > 0 "
            f"THEN array_min({scored}) END")


def _deletions(text: Column, most: int) -> Column:
    """The text and all texts with up to ``most`` of its characters deleted, each once."""
    out = last = F.array(text)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))))
        out = F.array_union(out, last)
    return out


def close_names(names: DataFrame, catalogue: DataFrame, most: int = MAX_TYPO_DISTANCE) -> DataFrame:
    """(name, popular, dist): for every name that is not in the catalogue the closest catalogue name within ``most``
    edits (ties: the alphabetically first); ``names`` and ``catalogue`` have one column of texts.

    Two texts within k edits share a text that both become by at most k deletions. Distinct names and catalogue
    names meet on a hash of those signatures in an equi-join, whatever the size of either; distances are taken of
    what meets. Names longer than the longest catalogue name by more than ``most`` have no signatures.
    """
    known = catalogue.select(F.col(catalogue.columns[0]).alias("popular")).where("popular IS NOT NULL AND popular <> ''").distinct()
    longest = known.agg(F.max(F.length("popular"))).collect()[0][0] or 0
    asked = names.select(F.col(names.columns[0]).alias("name")).where("name IS NOT NULL AND name <> ''").distinct().where(
        F.length("name") <= longest + most)

    def signed(df: DataFrame, column: str) -> DataFrame:
        return df.select(column, F.explode(_deletions(F.col(column), most)).alias("s")).select(column, F.xxhash64("s").alias("s"))

    met = signed(asked, "name").join(signed(known, "popular"), "s").select("name", "popular")
    near = met.withColumn("dist", F.levenshtein("name", "popular", most)).where("dist >= 0")
    best = near.groupBy("name").agg(F.min(F.struct("dist", "popular")).alias("b"))
    return best.where("b.dist > 0").select("name", "b.popular", "b.dist")


def typosquat_match(dep_name: Column) -> Column:
    """First segment (full name, then last path part) with a close popular name."""
    full = "regexp_replace(lower(dep_name), '[^a-z0-9]', '')"
    last = "regexp_replace(lower(element_at(split(dep_name, '/'), -1)), '[^a-z0-9]', '')"
    return F.expr(f"coalesce({_closest_popular_sql(full)}, {_closest_popular_sql(last)})")


def looks_obscure(dep_name: Column) -> Column:
    """Canonical last segment >= 7 chars, not popular, digits >= 30% or no vowel."""
    c = tx.canonicalize(F.element_at(F.split(dep_name, "/"), -1))
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return ((F.length(c) >= 7) & ~c.isin(POPULAR_PACKAGES)
            & ((digits / F.length(c) >= 0.30) | ~c.rlike("[aeiou]")))


def dependency_findings(manifests: DataFrame) -> DataFrame:
    deps = dependencies(manifests).withColumn("typo", typosquat_match(F.col("dep_name")))  # reads dep_name
    typo = deps.where(F.col("typo").isNotNull())
    typo_desc = F.concat(F.lit("'"), F.col("dep_name"), F.lit("' is a close edit-distance match to '"),
                         F.col("typo.name"), F.lit("', which can indicate typosquatting."))
    obscure = deps.where(F.col("typo").isNull() & looks_obscure(F.col("dep_name")))
    obscure_desc = F.concat(F.lit("'"), F.col("dep_name"),
                            F.lit("' has an unusually random-looking name. This is a local heuristic, "
                                  "not a registry reputation check."))
    return (emit(typo, "typosquat", line_start=F.col("line"), snippet=F.col("snippet"), description=typo_desc)
            .unionByName(emit(obscure, "obscure_dependency", line_start=F.col("line"), snippet=F.col("snippet"),
                              description=obscure_desc)))


def catalogue_typosquats(manifests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """J5 against a catalogue of any size (one column, canonical names): (repo_id, commit_sha, file_path, line,
    dep_name, popular, dist); the whole name is looked up first, then its last path segment."""
    deps = dependencies(manifests).withColumn("whole", tx.canonicalize(F.col("dep_name"))).withColumn(
        "last", tx.canonicalize(F.element_at(F.split("dep_name", "/"), -1)))
    found = close_names(deps.select(F.explode(F.array("whole", "last")).alias("name")), catalogue)
    for side in ("whole", "last"):
        deps = deps.join(found.select(F.col("name").alias(side), F.struct("dist", "popular").alias(f"{side}_hit")), side, "left")
    hit = F.coalesce("whole_hit", "last_hit")
    return deps.withColumn("hit", hit).where("hit IS NOT NULL").select(
        "repo_id", "commit_sha", "file_path", "line", "dep_name", "hit.popular", "hit.dist")


def typosquat(manifests: DataFrame) -> DataFrame:
    return dependency_findings(manifests).where(F.col("category") == "typosquatted_dependency")


def obscure_dependency(manifests: DataFrame) -> DataFrame:
    return dependency_findings(manifests).where(F.col("category") == "unrecognized_dependency")
