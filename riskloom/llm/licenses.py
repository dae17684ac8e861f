"""License scans by diagonal voting (operator 10).

Rolling word 3-gram hashes of every whole text are joined to the positions where license templates
have them. Each match votes for the diagonal (document word - template word); votes are aggregated per
diagonal, diagonals at most ``NEAR`` apart are merged (a word more or less inside a notice moves it by
one), and a merged span is verified by the share of the template's words that its matches cover.

Base phrases are searched as whole word sequences; they and the templates are parameters. The pass over
the text keeps only 3-grams that some template has (the templates are a fixed, small parameter), so
documents without license wording move one narrow row.

Null text is empty and has no words; rows that repeat (doc_id, text) each get the same result; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import cut, id_text, prepare

GRAM = 3
NEAR = 2
COVERAGE = 0.6

# fixed values: phrases and labels of the contract
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: opening sentences of public licenses and usual one-line notices
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def template_grams(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int]]:
    """(hash, template number, word position) of each template k-gram."""
    rows = []
    for i, (_, text) in enumerate(templates):
        h, _, _ = tv.word_hashes(text.encode(), tv.ALNUM_SEP)
        rows += [(int(v), i, p) for p, v in enumerate(tv.signed(tv.grams(h, k)))]
    return rows


def first_pass(docs: DataFrame, base: dict[str, str], wanted: np.ndarray, k: int) -> DataFrame:
    """Per row: words, base phrase places and the k-grams that some template has."""
    phrases = [(tv.word_hashes(p.encode(), tv.ALNUM_SEP)[0], label) for p, label in sorted(base.items())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [tv.to_bytes(t) for t in pdf["text"].tolist()]
            rows = []
            for d, t, (h, _, _) in zip(pdf["doc_id"].tolist(), texts, tv.batch_words(texts, tv.ALNUM_SEP)):
                places, labels = [], set()
                for ph, label in phrases:
                    m = len(h) - len(ph) + 1
                    if m <= 0:
                        continue
                    at = np.flatnonzero(h[:m] == ph[0])
                    for j in range(1, len(ph)):
                        at = at[h[at + j] == ph[j]]
                    if len(at):
                        places.append(at)
                        labels.add(label)
                v = tv.grams(h, k)
                pos = np.flatnonzero(np.isin(v, wanted, kind="sort")) if len(v) else np.zeros(0, np.int64)
                rows.append((d, tv.row_key(d, t), len(h), sum(map(len, places)),
                             min((int(a[0]) for a in places), default=None), max((int(a[-1]) for a in places), default=None),
                             sorted(labels), tv.signed(v[pos]).tolist(), pos.tolist()))
            out = pd.DataFrame(rows, columns=["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base", "fp", "pos"])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return id_text(docs).mapInPandas(run, "doc_id long, row binary, n_words long, n_base long, first_word long, "
                                          "last_word long, base array<string>, fp array<long>, pos array<int>")


def spans(seen: DataFrame, templates: list[tuple[str, str]], k: int = GRAM, near: int = NEAR) -> DataFrame:
    """Merged diagonals per document row: label, word range in the document, covered share of the template."""
    spark = seen.sparkSession
    places = spark.createDataFrame(template_grams(templates, k), "fp long, template int, t int")
    names = spark.createDataFrame([(i, label, len(text.split())) for i, (label, text) in enumerate(templates)],
                                  "template int, label string, n int")
    grams = seen.filter(F.size("fp") > 0).dropDuplicates(["row"]).select(
        "row", F.explode(F.arrays_zip("fp", "pos")).alias("x")).select("row", "x.fp", "x.pos")
    votes = grams.join(F.broadcast(places), "fp").groupBy("row", "template", (F.col("pos") - F.col("t")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("t").alias("ts"))
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    parted = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(w) > near).cast("int")).withColumn(
        "part", F.sum(F.coalesce("new", F.lit(0))).over(w))
    merged = parted.groupBy("row", "template", "part").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("first"), (F.max("hi") + k).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (k - 1))))))
    return merged.join(F.broadcast(names), "template").select(
        "row", "label", "template", "votes", "first", "end", (covered / F.col("n")).alias("coverage"))


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None,
         k: int = GRAM, near: int = NEAR, coverage: float = COVERAGE) -> DataFrame:
    """Per document row: base places and labels, all labels, accepted spans and the best coverage (score)."""
    prepare(docs.sparkSession)
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    wanted = np.unique(np.array([g[0] for g in template_grams(templates, k)], np.int64).view(np.uint64))
    seen = cut(first_pass(docs, base, wanted, k))
    good = spans(seen, templates, k, near)
    ok = F.col("coverage") >= coverage
    per_row = good.groupBy("row").agg(
        F.collect_set(F.when(ok, F.col("label"))).alias("found"), F.max("coverage").alias("best"),
        F.array_sort(F.collect_set(F.when(ok, F.struct("first", "end", "label", "coverage")))).alias("spans"))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return seen.drop("fp", "pos").join(per_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int,label:string,coverage:double>>")).alias("spans"))
