"""Python rules over the fact tables.

- dynamic exec, pickle, torch: filters on call facts;
- external input (P9) and taint leaves (P8): array predicates over the
  ``mentions`` and ``reads`` of an expression;
- shell exec and joblib string values: as-of lookups (assignments and uses of
  a name in one ordered window, last assignment seen so far);
- joblib parameters: a left-semi join against the scope's parameters;
- prompt injection: parameters, assignments and LLM calls of a scope pass through
  one task in order (a scope lives in one file of at most 1 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.catalog import emit
from riskloom.session import ship_package_code

# Fixed values (rule constants).
DYNAMIC_FUNCTIONS = ["eval", "exec"]
DECODE_MARKERS = ["decode", "b64decode", "unhexlify", "fromhex", "atob"]
SHELL_FUNCTIONS = ["subprocess.run", "subprocess.call", "subprocess.popen", "os.system"]
AUTH_MARKERS = ["auth", "token", "password", "secret", "apikey", "api_key", "key", "admin", "username"]
MODEL_EXTENSIONS = [".pkl", ".pt", ".pth", ".joblib", ".h5"]
PROMPT_KEYWORDS = ["prompt", "messages", "message", "content", "input", "query", "instructions"]
LLM_SUFFIXES = ["chat.completions.create", "messages.create", "generate_content"]
LLM_MARKERS = ["llm.", "model.", "openai.", "anthropic.", "genai."]
LLM_METHOD_SUFFIXES = [".generate", ".complete", ".chat"]
EXTERNAL_NAMES = ["request", "input", "argv", "args", "query", "params", "form", "user"]
EXTERNAL_CALLS = ["input", "request.args.get", "request.form.get"]
SANITIZERS = ["sanitize", "escape", "validate", "allowlist", "whitelist", "normalize"]
TAINT_CALLS = ["input", "os.getenv", "os.environ.get"]
REQUEST_ROOTS = ["request", "req"]
REQUEST_PARTS = ["body", "form", "json", "data", "args", "query", "params"]
SHELL_KEYWORDS = ["args", "command", "cmd"]
JOBLIB_KEYWORDS = ["file", "filename", "path"]

FILE = ["repo_id", "commit_sha", "file_path"]

DESC_PROMPT = (
    "Python code appears to pass request, user, or environment-derived data into an LLM prompt without a "
    "statically visible instruction/data boundary. Review recommended: verify that user input is bounded, "
    "validated, and separated from trusted instructions.")


def _ast_scope(facts: DataFrame) -> DataFrame:
    """Facts seen by the generic-walk rules (suffix compared case-sensitively)."""
    return facts.where(F.col("suffix") == ".py")


def _body_scope(facts: DataFrame) -> DataFrame:
    """Facts seen by the function-body-only rules (model, prompt)."""
    return facts.where(F.col("body_visible"))


def is_decode_call(call_name: Column) -> Column:
    return tx.contains_any(F.lower(call_name), DECODE_MARKERS)


def first_argument(keywords: list[str] | None = None) -> Column:
    """The call's first positional argument, else its first keyword argument among ``keywords``."""
    first = F.get(F.filter("args", lambda a: a["positional"]), 0)["value"]
    if not keywords:
        return first
    return F.coalesce(first, F.get(F.filter("args", lambda a: a["kw"].isin(keywords)), 0)["value"])


def external(e: Column) -> Column:
    """The expression mentions outside input anywhere."""
    return F.exists(e["mentions"], lambda m: F.when(m["kind"] == "call", F.lower(m["text"]).isin(EXTERNAL_CALLS)).otherwise(
        F.lower(m["text"]).isin(EXTERNAL_NAMES)))


def _clean(read: Column) -> Column:
    """No sanitising call encloses the read."""
    return ~F.exists(read["via"], lambda c: tx.contains_any(F.lower(c), SANITIZERS))


def taint_names(e: Column) -> Column:
    """Names whose taint the value takes over."""
    return F.array_distinct(F.transform(F.filter(e["reads"], lambda r: (r["kind"] == "name") & _clean(r)), lambda r: r["text"]))


def taint_source(e: Column) -> Column:
    """The value holds a source of its own: request data, user input, the environment."""
    def source(r: Column) -> Column:
        low = F.lower(r["text"])
        parts = F.split(low, "\\.")
        request = F.get(parts, 0).isin(REQUEST_ROOTS) & F.exists(F.slice(parts, 2, 1_000_000), lambda p: p.isin(REQUEST_PARTS))
        call = ~tx.contains_any(low, SANITIZERS) & (low.isin(TAINT_CALLS) | (F.instr(low, "request") > 0))
        return F.when(r["kind"] == "attr", request).when(r["kind"] == "call", call).otherwise(F.lit(False))

    return F.exists(e["reads"], lambda r: source(r) & _clean(r))


def value_kind(e: Column) -> Column:
    """Command value: decoded call, or '+' concatenation with external input."""
    return (F.when((e["kind"] == "call") & is_decode_call(e["text"]), F.lit("decoded"))
             .when((e["kind"] == "add") & external(e), F.lit("concatenated external")))


def latest_before(uses: DataFrame, assigns: DataFrame, value: str) -> DataFrame:
    """``uses`` with the ``value`` of the latest earlier assignment of ``arg_name`` in the file (null if none).

    One ordered window over both: a row per assignment and per use, no pairs.
    """
    w = Window.partitionBy(*FILE, "arg_name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = assigns.select(*FILE, "arg_name", "seq", value).withColumn("use", F.lit(None).cast(uses.schema.simpleString()))
    both = uses.select(*FILE, "arg_name", "seq", F.lit(None).cast("string").alias(value), F.struct(*uses.columns).alias("use")).unionByName(rows)
    seen = both.withColumn("found", F.last(value, ignorenulls=True).over(w)).where(F.col("use").isNotNull())
    return seen.select("use.*", F.col("found").alias(value))


def py_dynamic_exec(facts: DataFrame) -> DataFrame:
    """Bare eval/exec whose first argument is a decode call or a '+'."""
    calls = _ast_scope(facts).where((F.col("kind") == "call") & F.col("func_is_name")
                                    & F.col("name").isin(DYNAMIC_FUNCTIONS))
    a = first_argument()
    kind = (F.when(a["kind"] == "add", F.lit("concatenated"))
             .when((a["kind"] == "call") & is_decode_call(a["text"]), F.lit("decoded")))
    hits = calls.withColumn("exec_kind", kind).where(F.col("exec_kind").isNotNull())
    rule = F.when(F.col("exec_kind") == "decoded", "py_exec_decoded").otherwise("py_exec_concat")
    desc = F.concat(F.col("name"), F.lit("() executes "), F.col("exec_kind"),
                    F.lit(" content, a common obfuscation and backdoor pattern."))
    return emit(hits, rule, line_start=F.col("line"), line_end=F.col("end_line"), snippet=F.col("snippet"),
                description=desc)


def py_shell_exec(facts: DataFrame) -> DataFrame:
    """Shell calls fed by decoded or external data; a Name argument takes
    the kind of its latest earlier tracked assignment (as-of join)."""
    f = _ast_scope(facts)
    calls = (f.where((F.col("kind") == "call") & F.lower(F.col("name")).isin(SHELL_FUNCTIONS))
              .withColumn("arg", first_argument(SHELL_KEYWORDS)).where(F.col("arg").isNotNull()))
    tracked = (f.where(F.col("kind") == "assign")
               .select(*FILE, F.col("name").alias("arg_name"), "seq", value_kind(F.col("value")).alias("cmd_kind"))
               .where(F.col("cmd_kind").isNotNull()))
    cols = [*FILE, "seq", "name", "line", "end_line", "snippet"]
    named = latest_before(calls.where(F.col("arg.kind") == "name").select(*cols, F.col("arg.text").alias("arg_name")), tracked, "cmd_kind")
    direct = calls.where(F.col("arg.kind") != "name").withColumn("cmd_kind", value_kind(F.col("arg")))
    hits = named.select(*cols, "cmd_kind").unionByName(direct.select(*cols, "cmd_kind")).where(F.col("cmd_kind").isNotNull())
    rule = F.when(F.col("cmd_kind") == "decoded", "py_shell_decoded").otherwise("py_shell_external")
    desc = F.concat(F.lower(F.col("name")), F.lit("() executes "), F.col("cmd_kind"),
                    F.lit(" command content, a common obfuscated backdoor pattern."))
    return emit(hits, rule, line_start=F.col("line"), line_end=F.col("end_line"), snippet=F.col("snippet"),
                description=desc)


def mentions_auth(operands: Column) -> Column:
    return F.exists(operands, lambda o: F.exists(o["mentions"], lambda m: (m["kind"] != "call") & tx.contains_any(
        F.replace(F.lower(m["text"]), F.lit("-"), F.lit("_")), AUTH_MARKERS)))


def py_auth_bypass(facts: DataFrame) -> DataFrame:
    """A comparison in an ``if`` test against a string constant that
    mentions an auth-like identifier; one finding per if-line."""
    cmp = _ast_scope(facts).where((F.col("kind") == "if_compare") & F.exists("operands", lambda o: o["kind"] == "str")
                                  & mentions_auth(F.col("operands")))
    first = (cmp.groupBy(*FILE, "line")
             .agg(F.min_by(F.struct("end_line", "snippet"), F.col("seq")).alias("f"))
             .select(*FILE, "line", "f.*"))
    desc = F.lit("An authentication-related conditional compares against a hardcoded string, which may "
                 "create a hidden bypass or static credential.")
    return emit(first, "py_auth_bypass", line_start=F.col("line"), line_end=F.col("end_line"),
                snippet=F.col("snippet"), description=desc)


def _model_calls(facts: DataFrame) -> DataFrame:
    return _body_scope(facts).where(F.col("kind") == "call")


def model_pickle(facts: DataFrame) -> DataFrame:
    """Pickle.load / pickle.loads."""
    hits = _model_calls(facts).where(F.col("name").isin("pickle.load", "pickle.loads"))
    desc = F.concat(F.col("name"), F.lit(
        "() can execute attacker-controlled code while deserializing data. Treat model or artifact input as "
        "untrusted unless its source and integrity are verified."))
    return emit(hits, "model_pickle", line_start=F.col("line"), snippet=F.col("snippet"), description=desc)


def model_torch(facts: DataFrame) -> DataFrame:
    """P5: torch.load without a literal weights_only=True."""
    safe = F.exists("args", lambda a: (a["kw"].eqNullSafe(F.lit("weights_only"))) & (a["value"]["kind"] == "const") & (a["value"]["text"] == "True"))
    hits = _model_calls(facts).where((F.col("name") == "torch.load") & ~safe)
    desc = F.lit("torch.load() is called without weights_only=True, which can permit unsafe pickle-based "
                 "deserialization when a model artifact is not fully trusted.")
    return emit(hits, "model_torch", line_start=F.col("line"), snippet=F.col("snippet"), description=desc)


def _model_suffix(path: Column) -> Column:
    return F.lower(tx.path_suffix(path)).isin(MODEL_EXTENSIONS)


def model_joblib(facts: DataFrame) -> DataFrame:
    """Joblib.load of a model-like literal, a parameter, a name bound to a
    model-like string (latest earlier assignment), an unknown name, or any
    other expression."""
    f = _body_scope(facts)
    calls = (_model_calls(facts).where(F.col("name") == "joblib.load")
             .withColumn("arg", first_argument(JOBLIB_KEYWORDS)).where(F.col("arg").isNotNull()))
    arg = F.col("arg")
    params = f.where(F.col("kind") == "param").select(*FILE, "scope", F.col("name").alias("arg_name")).distinct()
    strings = (f.where((F.col("kind") == "assign") & ~F.col("annotated") & (F.col("value.kind") == "str"))
               .select(*FILE, F.col("name").alias("arg_name"), "seq", F.col("value.text").alias("bound_text")))
    uses = calls.where(arg["kind"] == "name").select(*FILE, "seq", "scope", "line", "snippet", arg["text"].alias("arg_name"))
    named = latest_before(uses, strings, "bound_text").join(
        params.withColumn("is_param", F.lit(True)), [*FILE, "scope", "arg_name"], "left")
    named_flag = (F.when(F.col("is_param"), F.lit(True))
                   .when(F.col("bound_text").isNotNull(), _model_suffix(F.col("bound_text")))
                   .otherwise(F.lit(True)))
    cols = [*FILE, "line", "snippet", "flag"]
    named = named.withColumn("flag", named_flag).select(*cols)
    others = calls.where(arg["kind"] != "name").withColumn(
        "flag", F.when(arg["kind"] == "str", _model_suffix(arg["text"])).otherwise(F.lit(True))).select(*cols)
    hits = named.unionByName(others).where("flag")
    desc = F.lit("joblib.load() is used with a model-like or dynamically selected artifact. Joblib can deserialize "
                 "pickle payloads, so an untrusted artifact may execute code during loading.")
    return emit(hits, "model_joblib", line_start=F.col("line"), snippet=F.col("snippet"), description=desc)


def is_llm_call(call_name: Column) -> Column:
    low = F.lower(call_name)
    ends = F.lit(False)
    for s in LLM_SUFFIXES:
        ends = ends | low.endswith(s)
    method = F.lit(False)
    for s in LLM_METHOD_SUFFIXES:
        method = method | low.endswith(s)
    return ends | (tx.contains_any(low, LLM_MARKERS) & method)


TAINT_ROW = "repo_id string, commit_sha string, file_path string, line int, snippet string"


def carry_taint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls with a tainted argument, from events in order of (file, scope, seq).

    One pass with the names that are tainted now: a parameter starts tainted, an assignment sets or clears its
    name, a call looks. An event costs its own names only, whatever has gone before it in the scope.
    """
    scope, tainted = None, set()
    for batch in batches:
        hits: list[tuple] = []
        for e in batch.to_pylist():
            here = (e["repo_id"], e["commit_sha"], e["file_path"], e["scope"])
            if here != scope:
                scope, tainted = here, set()
            now = e["source"] or not tainted.isdisjoint(e["deps"])
            if e["is_call"]:
                if now:
                    hits.append((*here[:3], e["line"], e["snippet"]))
            elif now:
                tainted.add(e["name"])
            else:
                tainted.discard(e["name"])
        cols = list(zip(*hits)) if hits else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.string()) for i, c in enumerate(cols)],
                                         ["repo_id", "commit_sha", "file_path", "line", "snippet"])


def taint_events(facts: DataFrame) -> DataFrame:
    """Parameters, assignments and LLM calls of the scopes that hold an LLM call."""
    f = _body_scope(facts)
    none, nothing = F.lit(False), F.lit(None)
    prompt_args = F.filter("args", lambda a: a["kw"].isNull() | a["kw"].isin(PROMPT_KEYWORDS))
    cols = [*FILE, "scope", "seq", "is_call", "name", "deps", "source", "line", "snippet"]
    calls = f.where((F.col("kind") == "call") & is_llm_call(F.col("name"))).withColumn("is_call", F.lit(True)).withColumn(
        "deps", F.array_distinct(F.flatten(F.transform(prompt_args, lambda a: taint_names(a["value"]))))).withColumn(
        "source", F.exists(prompt_args, lambda a: taint_source(a["value"]))).select(*cols)
    assigns = f.where(F.col("kind") == "assign").withColumn("is_call", none).withColumn("deps", taint_names(F.col("value"))).withColumn(
        "source", taint_source(F.col("value"))).select(*cols)
    params = f.where(F.col("kind") == "param").select(
        *FILE, "scope", F.lit(-1).alias("seq"), none.alias("is_call"), "name", F.array().cast("array<string>").alias("deps"),
        F.lit(True).alias("source"), nothing.cast("int").alias("line"), nothing.cast("string").alias("snippet"))
    # only scopes that contain an LLM call are followed
    scopes = calls.select(*FILE, "scope").distinct()
    return calls.unionByName(assigns).unionByName(params).join(scopes, [*FILE, "scope"], "left_semi").withColumn(
        "source", F.coalesce("source", none)).withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def py_prompt_injection(facts: DataFrame) -> DataFrame:
    """LLM calls whose prompt arguments are tainted. The events of a scope pass through its task once, in
    order; a scope lies in one file, so in one task."""
    # dealt out by a hash of the scope: an exchange by the columns themselves is dropped where the joins above have
    # one already, and adaptive execution may then read their output in other pieces
    dealt = taint_events(facts).withColumn("dealt", F.xxhash64(*FILE, "scope")).repartition("dealt").drop("dealt")
    ordered = dealt.sortWithinPartitions(*FILE, "scope", "seq", "is_call", "name")
    ship_package_code()
    flagged = ordered.mapInArrow(carry_taint, TAINT_ROW)
    per_line = flagged.groupBy(*FILE, "line").agg(F.min("snippet").alias("snippet"))
    return emit(per_line, "py_prompt_injection", line_start=F.col("line"), snippet=F.col("snippet"),
                description=F.lit(DESC_PROMPT))


def parse_errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "parse_error").select(*FILE, "error")


def detector_warnings(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Per repository and detector, the files a detector had to skip
    (Python syntax errors; package.json that is not a JSON object). Other
    detectors are unaffected: a bad file only drops itself."""
    from riskloom.sources import files as src

    errs = parse_errors(facts).select("repo_id", "commit_sha", "file_path", F.lit("python_ast").alias("detector"))
    pkg = src.manifest_files(files).where(F.col("name") == "package.json")
    v = F.try_parse_json(F.col("content"))
    bad = (pkg.where(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"))
              .select("repo_id", "commit_sha", "file_path",
                      F.explode(F.array(F.lit("dependency_audit"), F.lit("backdoor_heuristics"))).alias("detector")))
    return (errs.unionByName(bad).groupBy("repo_id", "commit_sha", "detector")
                .agg(F.count(F.lit(1)).alias("files"), F.min("file_path").alias("first_file")))


def python_findings(facts: DataFrame) -> DataFrame:
    parts = [py_dynamic_exec(facts), py_shell_exec(facts), py_auth_bypass(facts), model_pickle(facts),
             model_torch(facts), model_joblib(facts), py_prompt_injection(facts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
