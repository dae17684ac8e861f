"""Corpus sources: the ``code_files`` table, eligibility filters, inventory.

``code_files(repo_id, commit_sha, file_path, content, size_bytes)`` holds many
repositories at once. ``content`` may be STRING or BINARY (raw bytes from a
``binaryFile`` scan); eligibility keeps path/size predicates separate from the
content predicates so the former reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text as tx

# Scan-noise directories, size caps.
NOISE_DIRECTORIES = [".git", "node_modules", "venv", ".venv", "__pycache__"]
MAX_TEXT_FILE_BYTES = 1_000_000
BINARY_SNIFF_BYTES = 8192
MAX_REPOSITORY_BYTES = 500 * 1024 * 1024

# Suffix classes used by the detectors.
SOURCE_SUFFIXES = [".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
JS_SUFFIXES = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
CONFIG_FILENAMES = ["settings.py", "next.config.js", "next.config.mjs", "dockerfile", "dockerfile.dev"]
MANIFEST_NAMES = ["package.json", "requirements.txt", "go.mod"]

# Suffix -> language (19 suffixes).
LANGUAGES = [
    (".py", "Python"), (".js", "JavaScript"), (".jsx", "JavaScript"), (".mjs", "JavaScript"),
    (".cjs", "JavaScript"), (".ts", "TypeScript"), (".tsx", "TypeScript"), (".go", "Go"),
    (".java", "Java"), (".rb", "Ruby"), (".php", "PHP"), (".rs", "Rust"), (".cs", "C#"),
    (".json", "JSON"), (".yml", "YAML"), (".yaml", "YAML"), (".toml", "TOML"), (".tf", "Terraform"),
    (".dockerfile", "Dockerfile"),
]

CODE_FILES_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
])


def read_code_files(spark: SparkSession, path: str) -> DataFrame:
    """A stored corpus table (parquet) with the ``code_files`` columns."""
    return spark.read.parquet(path)


CORPUS_KEY = ["repo_id", "commit_sha", "file_path"]


def write_corpus(files: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``files`` as a table bucketed and sorted by file key, and return it.

    Contents move once, here. Joins of the stored table on the file key (code context, fix proposals) leave them
    where they are: the other side, which has no contents, is dealt to the buckets. A repository's files spread
    over all buckets. ``path`` is the table's folder (default: the warehouse).
    """
    rows = files.repartition(buckets, *CORPUS_KEY)
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *CORPUS_KEY).sortBy(*CORPUS_KEY)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return files.sparkSession.table(table)


def relative_path(path: Column, root: str) -> Column:
    """A file's path below ``root``, with or without the scheme of a local file."""
    return F.regexp_replace(F.regexp_replace(path, "^file:", ""), "^" + _re_escape(root.rstrip("/")) + "/", "")


def read_repository_tree(spark: SparkSession, root: str, repo_id: str, commit_sha: str = "") -> DataFrame:
    """Walk a checked-out tree with the ``binaryFile`` source (bytes stay bytes)."""
    root = root.rstrip("/")
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
           .select("path", "length", "content"))
    return raw.select(F.lit(repo_id).alias("repo_id"), F.lit(commit_sha).alias("commit_sha"),
                      relative_path(F.col("path"), root).alias("file_path"), F.col("content"), F.col("length").alias("size_bytes"))


def _re_escape(s: str) -> str:
    return "".join("\\" + c if c in ".^$*+?{}[]\\|()" else c for c in s)


def not_noise(path: Column) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in NOISE_DIRECTORIES]))


def _binary_has_nul(content: Column) -> Column:
    # one character per byte
    return F.instr(F.decode(F.substring(content, 1, BINARY_SNIFF_BYTES), "ISO-8859-1"), "\u0000") > 0


def _decoded(content: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return F.call_function("make_valid_utf8", content.cast("string"))
    return content


def eligible_files(files: DataFrame) -> DataFrame:
    """Drop noise directories, files over 1 MB and binaries; decode text.

    Adds ``name``, ``suffix`` (case kept), ``suffix_l`` (lower) and ``is_source``.
    """
    dtype = files.schema["content"].dataType
    nul = _binary_has_nul(F.col("content")) if isinstance(dtype, T.BinaryType) else \
        (F.instr(F.substring("content", 1, BINARY_SNIFF_BYTES), "\u0000") > 0)
    out = (files
           .where(not_noise(F.col("file_path")) & (F.col("size_bytes") <= MAX_TEXT_FILE_BYTES))
           .where(~nul)
           .withColumn("content", _decoded(F.col("content"), dtype)))
    return with_path_columns(out)


def skipped_files(files: DataFrame) -> DataFrame:
    """Files that the reference's limits keep from the detectors, with the first reason that holds."""
    dtype = files.schema["content"].dataType
    nul = _binary_has_nul(F.col("content")) if isinstance(dtype, T.BinaryType) else \
        (F.instr(F.substring("content", 1, BINARY_SNIFF_BYTES), "\u0000") > 0)
    reason = (F.when(~not_noise(F.col("file_path")), F.lit("noise_directory"))
               .when(F.col("size_bytes") > MAX_TEXT_FILE_BYTES, F.lit("too_large"))
               .when(nul, F.lit("binary")))
    return files.select("repo_id", "commit_sha", "file_path", reason.alias("reason")).where(F.col("reason").isNotNull())


def file_index(files: DataFrame) -> DataFrame:
    """One row per file with what is read of it besides its rules' matches: size, an ``eligible`` flag for what
    respects the text-file filters, and the content of the few files that are read whole (``special``; else null).
    """
    dtype = files.schema["content"].dataType
    name = tx.path_name(F.col("file_path"))
    is_env = (name == ".env") | name.startswith(".env.")
    nul = _binary_has_nul(F.col("content")) if isinstance(dtype, T.BinaryType) else \
        (F.instr(F.substring("content", 1, BINARY_SNIFF_BYTES), "\u0000") > 0)
    special = F.coalesce(name.isin(MANIFEST_NAMES) | is_env | (F.col("file_path") == ".gitignore"), F.lit(False))
    eligible = not_noise(F.col("file_path")) & (F.col("size_bytes") <= MAX_TEXT_FILE_BYTES) & ~nul
    whole = F.when(special, _decoded(F.col("content"), dtype)).alias("content")
    return files.select(*[whole if c == "content" else c for c in files.columns], eligible.alias("eligible"), special.alias("special"))


def special_of(index: DataFrame) -> DataFrame:
    """The few files of a ``file_index`` whose whole content the cross-file and JSON rules read:
    manifests, root .gitignore and env files (any size)."""
    return with_path_columns(index.where("special").drop("special"))


def special_files(files: DataFrame) -> DataFrame:
    return special_of(file_index(files))


def with_path_columns(df: DataFrame) -> DataFrame:
    name = tx.path_name(F.col("file_path"))
    suffix = tx.path_suffix(F.col("file_path"))
    return (df.withColumn("name", name)
              .withColumn("suffix", suffix)
              .withColumn("suffix_l", F.lower(suffix))
              .withColumn("is_source", F.lower(suffix).isin(SOURCE_SUFFIXES)))


def manifest_files(files: DataFrame) -> DataFrame:
    """Package.json / requirements.txt / go.mod at any depth; noise pruned,
    no size or binary filter, empty content skipped."""
    dtype = files.schema["content"].dataType
    name = tx.path_name(F.col("file_path"))
    return (files.where(name.isin(MANIFEST_NAMES) & not_noise(F.col("file_path")))
                 .withColumn("content", _decoded(F.col("content"), dtype))
                 .where(F.length("content") > 0)
                 .withColumn("name", name))


def gitignore_patterns(files: DataFrame) -> DataFrame:
    """Root ``.gitignore`` lines, stripped, non-blank, non-comment, in order.

    Output: repo_id, commit_sha, pos (0-based order), pattern.
    """
    dtype = files.schema["content"].dataType
    gi = files.where(F.col("file_path") == ".gitignore").withColumn("content", _decoded(F.col("content"), dtype))
    lines = gi.select("repo_id", "commit_sha", F.posexplode(tx.splitlines(F.col("content"))).alias("pos", "raw"))
    stripped = tx.py_strip(F.col("raw"))
    return (lines.where((stripped != "") & ~F.col("raw").rlike("(?U)^[\\s\\x1C-\\x1F]*#"))
                 .select("repo_id", "commit_sha", "pos", stripped.alias("pattern")))


def repo_size(files: DataFrame) -> DataFrame:
    """Bytes of every non-noise file (binaries and big files included)."""
    return (files.where(not_noise(F.col("file_path")))
                 .groupBy("repo_id", "commit_sha")
                 .agg(F.sum("size_bytes").cast("bigint").alias("total_bytes")))


def repo_over_limit(files: DataFrame, limit: int = MAX_REPOSITORY_BYTES) -> DataFrame:
    sizes = repo_size(files)
    return sizes.select("repo_id", "commit_sha", "total_bytes",
                        (F.col("total_bytes") > F.lit(limit)).alias("over_limit"))


def repo_inventory(eligible: DataFrame) -> DataFrame:
    """Eligible file count and their bytes per repository."""
    return (eligible.groupBy("repo_id", "commit_sha")
                    .agg(F.count(F.lit(1)).alias("files_scanned"),
                         F.sum("size_bytes").cast("bigint").alias("total_bytes")))


def languages_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "suffix_l string, language string")


def language_counts(eligible: DataFrame) -> DataFrame:
    """Files per language (mapped suffixes only), one row per (repo, language)."""
    spark = eligible.sparkSession
    return (eligible.select("repo_id", "commit_sha", "suffix_l")
                    .join(F.broadcast(languages_frame(spark)), "suffix_l")
                    .groupBy("repo_id", "commit_sha", "language")
                    .agg(F.count(F.lit(1)).alias("files")))


def language_histogram(eligible: DataFrame) -> DataFrame:
    """Per repository ``MAP<language, files>`` (the snapshot's ``languages``)."""
    counts = language_counts(eligible)
    return (counts.groupBy("repo_id", "commit_sha")
                  .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "files"))))
                       .alias("languages")))


# Fixed value: accepted repository URL shape.
GH_URL = "^https://github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\\.git)?/?\\z"


def project_import(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Parse repository URLs; ``valid`` false rows form the quarantine."""
    u = F.col(url_col)
    ok = u.rlike(GH_URL)
    owner = F.regexp_extract(u, GH_URL, 1)
    name = F.regexp_extract(u, GH_URL, 2)
    valid = ok & ~owner.isin(".", "..") & ~name.isin(".", "..")
    return urls.select(
        "*",
        F.when(valid, owner).alias("owner"),
        F.when(valid, name).alias("name"),
        F.when(valid, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)).alias("canonical_url"),
        valid.alias("valid"),
    )
