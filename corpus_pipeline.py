"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, passages that
repeat are cut out, documents with benchmark passages go, the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared folder and rereads it as the next stage's docs. All stages but the last return the columns of
documents. Null and empty texts are clean: they have no score of their own, no shingles, no passages and no
benchmark words, so they stay and are packed as an end id. Rows that repeat in full are one group of
copies; documents with equal ids and different texts are judged each on its own text. Empty tables give
empty results; columns beyond those of documents are left out, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import cut, prepare, split_by_text, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_SHINGLE = 5
NEAR_PERCENT = 80
PASSAGE_WORDS = 51


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    from riskloom.llm.toxicity import score
    docs = _columns(docs)
    scored = score(docs, table(spark, sf_dir, "labels"), more=[c for c in docs.columns if c != "doc_id"])
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingle similarity from 0.8 the row with the smallest doc_id stays."""
    from riskloom.llm.ngram_join import join
    docs = _columns(docs)
    rows = cut(join(docs, k=NEAR_SHINGLE, percent=NEAR_PERCENT).filter("component IS NOT NULL").select("doc_id", "text_key", "component"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    groups = rows.groupBy("component").agg(F.count("*").alias("n"), F.min(first).alias("stays")).filter("n > 1")
    fate = cut(rows.join(groups, "component").groupBy("doc_id", "text_key").agg(F.first("stays").alias("stays")).select(
        F.col("doc_id").alias("fate_id"), "text_key", (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (
            F.col("text_key") == F.col("stays.text_key"))).alias("stay")))
    plain, hit = split_by_text(docs, fate)
    judged = hit.alias("d").join(fate.alias("f"), (F.col("d.text_key") == F.col("f.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("f.fate_id")), "left")
    judged = judged.select("d.*", "f.stay")
    # the row that stays may itself be repeated
    kept = judged.filter("stay").dropDuplicates(["doc_id", "text_key"]).union(judged.filter("stay IS NULL"))
    return plain.union(kept.select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of over 50 words, or of 400 bytes or more, that occurs elsewhere is cut out of the text, wherever
    it stands (characters wholly inside it); n_chars follows the new text. No row goes, also when nothing is left of it."""
    from riskloom.llm.substrings import remove
    docs = _columns(docs)
    changed = cut(remove(docs, with_text=True, words=PASSAGE_WORDS, cut_passages=True).filter("kept_text IS NOT NULL").select("text_key", "kept_text").dropDuplicates(["text_key"]))
    plain, hit = split_by_text(docs, changed)
    new = hit.join(changed, "text_key", "left")
    text = F.coalesce("kept_text", "text")
    values = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long")
              } if "n_chars" in docs.columns else {"text": text}
    return plain.union(new.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    from riskloom.llm.decontaminate import hits
    docs = _columns(docs)
    bad = cut(hits(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("text_key").distinct())
    plain, hit = split_by_text(docs, bad)
    return plain.union(hit.join(bad, "text_key", "left_anti").select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and offset."""
    from riskloom.llm.packing import pack
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

# the factorization machine and the tokenizer have no SQL form; tests hold the stages to brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.session import ensure_checkpoint_dir
    prepare(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
