"""Query keys of the llm operators: thin queries that derive the digest columns from each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn
    return deco


@query("op1_best_fit_packing")
def _op1(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def _op3(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.token_counts import histogram, lengths
    return histogram(lengths(table(spark, sf_dir, "documents")))


# word rules of the contract as DuckDB text: A-Z lower-cased, words by a character class
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP5_SQL = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
bs AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM ds),
hit AS (SELECT doc_id, s, k, item FROM dw JOIN bw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op5_benchmark_decontamination", _OP5_SQL)
def _op5(spark, sf_dir):
    from pyspark.sql import functions as F

    from riskloom.llm.common import table
    from riskloom.llm.decontaminate import hits
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_license_scan")
def _op10(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.licenses import scan
    return scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op4_toxicity")
def _op4(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.toxicity import score
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def _op6(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.language import identify
    return identify(table(spark, sf_dir, "documents")).drop("spans")


_OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS answer FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, payload_digest, CASE WHEN answer <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN answer <> page_id THEN answer END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


@query("op9_warc", _OP9_SQL)
def _op9(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.warc import archive, lookup, read
    pages = table(spark, sf_dir, "pages")
    _, top, folder = archive(pages)
    return read(lookup(pages, top, folder), folder).drop("url", "payload")


@query("op2_nearest_neighbours")
def _op2(spark, sf_dir):
    from riskloom.llm.ann import search
    from riskloom.llm.common import table
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


_SPACE = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

_OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACE} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS cnt FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * cnt >= 90 * (nx.n + ny.n - cnt)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""


@query("op7_ngram_jaccard_join", _OP7_SQL)
def _op7(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.ngram_join import join
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_substring_dedup")
def _op8(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.substrings import remove
    # the columns of the contract, and passages of over 50 words beside them
    return remove(table(spark, sf_dir, "documents"), words=51)


@query("op11_sentencepiece")
def _op11(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.pieces import decode, digests, encode
    return digests(decode(encode(table(spark, sf_dir, "documents"))))


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text; ``tab`` is the list of 256 table values."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


_CRC_TABLE = """rounds(n, c, k) AS (SELECT n, n, 0 FROM (SELECT unnest(range(256)) AS n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS tab FROM rounds WHERE k = 8)"""

_OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_ALNUM}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hashed AS (SELECT word, {_crc_sql('word')} % 10000 AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000))::DOUBLE
  / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bw) + 10000))::DOUBLE))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


@query("op12_importance_resampling", _OP12_SQL)
def _op12(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.importance import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE len(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM per, crc_table),
spelt AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, len(word) + 1))::INT AS i FROM w)),
pairs AS (SELECT DISTINCT x, y FROM (
  SELECT p.word AS x, q.word AS y FROM cuts p JOIN cuts q USING (i, a, b) WHERE p.word <> q.word
  UNION ALL SELECT c.word, w.word FROM cuts c JOIN w ON w.word = c.a || c.b
  UNION ALL SELECT w.word, c.word FROM cuts c JOIN w ON w.word = c.a || c.b)),
best AS (SELECT x, count(*) AS n_near, first(struct_pack(y, n) ORDER BY n DESC, encode(y)) AS top FROM pairs JOIN w ON w.word = y GROUP BY x),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 5 * w.n THEN top.y END AS form,
  CASE WHEN top.n >= 5 * w.n THEN top.n END AS form_n FROM w LEFT JOIN best ON x = w.word),
follow(word, dest) AS (SELECT word, word FROM formed UNION ALL SELECT follow.word, formed.form FROM follow JOIN formed ON formed.word = dest WHERE form IS NOT NULL)
SELECT formed.word, formed.form, dest AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN follow ON follow.word = formed.word JOIN formed e ON e.word = dest WHERE e.form IS NULL
"""


@query("op13_spelling_variants", _OP13_SQL)
def _op13(spark, sf_dir):
    from riskloom.llm.common import table
    from riskloom.llm.spelling import variants
    return variants(table(spark, sf_dir, "documents"))
