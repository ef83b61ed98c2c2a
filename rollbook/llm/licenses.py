"""License scans by diagonal voting.

1. Rolling word k-gram hashes of all documents; those no template holds are left out before they leave the task.
2. A Spark join with the template positions. Templates are a small table; its size is checked before it is broadcast.
3. Votes are counted by (document, template, diagonal), a diagonal being document position minus template position. Of the
   diagonals of one place in a notice only the strongest counts, so that grams which a notice repeats leave no stray diagonals.
4. Diagonals that lie near each other are merged: they are one copy with words put in or left out.
5. Spans are verified: a phrase must have all its grams on one diagonal, a notice the wanted share of its grams.

All steps after the first use one exchange by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.kernels import text_buffers, text_chunks, window_hashes, words
from rollbook.llm.shared import texts

K = 2
MAX_TEMPLATE_WORDS = 1_000_000

# Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices as they are commonly printed: label, text.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
)
MIN_SHARE = 0.85
MAX_DRIFT = 4


def template_grams(templates, k):
    """(hash, template, position) of all grams, and (template, label, is phrase, words, grams) of templates with k words at least."""
    grams, about = [], []
    for t, (label, text, phrase) in enumerate(templates):
        _, _, hashes, first = words(*text_buffers(pa.array([text or ""])))
        if len(hashes) < k:
            if phrase:
                raise ValueError(f"A phrase needs {k} words at least: {text!r}")
            continue
        out, where, _ = window_hashes(hashes, first, k)
        grams += [(int(h), t, int(w)) for h, w in zip(out.view(np.int64), where)]
        about.append((t, label, bool(phrase), len(hashes), len(out)))
    return grams, about


def scan_licenses(docs, id_col="doc_id", text_col="text", phrases=PHRASES, notices=NOTICES, k=K, min_share=MIN_SHARE, max_drift=MAX_DRIFT):
    """One row per input row: doc_id, n_words, spans (label, is phrase, first word, end word, share), ordered by place and label.

    A phrase is found wherever its words stand consecutively. A notice is found where at least min_share of its grams vote for
    one place; weaker places are in `best` only, the largest share of any place. Null and empty texts have no words; repeated
    rows give repeated rows; an empty table gives no rows. Other columns are not read. Words are hashed with 64 bits.
    """
    spark = docs.sparkSession
    templates = [(label, text, True) for text, label in phrases] + [(label, text, False) for label, text in notices]
    grams, about = template_grams(templates, k)
    if len(grams) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"The templates have {len(grams)} grams; at most {MAX_TEMPLATE_WORDS} are sent to all tasks.")
    wanted = np.unique(np.array([g[0] for g in grams], np.int64).view(np.uint64))

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                _, _, hashes, first = words(data, offsets)
                out, where, row = window_hashes(hashes, first, k)
                at = np.minimum(np.searchsorted(wanted, out), max(0, len(wanted) - 1))
                hit = wanted[at] == out if len(wanted) else np.zeros(len(out), bool)
                out, where, row = out[hit], where[hit], row[hit]
                ends = np.searchsorted(row, np.arange(j - i + 1))
                pairs = pa.StructArray.from_arrays([pa.array(out.view(np.int64)), pa.array(where - first[row])], names=["hash", "pos"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                    ],
                    names=["doc_id", "n_words", "grams"],
                )

    source = texts(docs, id_col, text_col)
    gram = T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.LongType())])
    rows = source.mapInArrow(run, T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("grams", T.ArrayType(gram)),
    ])).withColumn("row", F.monotonically_increasing_id()).repartition("row")

    table = spark.createDataFrame(grams, "hash long, template int, tpos long")
    info = spark.createDataFrame(about, "template int, label string, phrase boolean, t_words long, t_grams long")
    table = F.broadcast(table.join(F.broadcast(info), "template"))

    hits = (
        rows.select("row", "doc_id", "n_words", F.explode_outer("grams").alias("g")).select("row", "doc_id", "n_words", "g.hash", "g.pos")
        .join(table, "hash", "left").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    )
    # A gram that a notice repeats votes for several diagonals; only the one with most votes on it and its neighbours counts.
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    of_place = Window.partitionBy("row", "template", "pos").orderBy(F.desc("near"), F.desc("own"), "diagonal")
    votes = (
        hits.withColumn("near", F.count("tpos").over(by.rangeBetween(-max_drift, max_drift)))
        .withColumn("own", F.count("tpos").over(by.rangeBetween(0, 0)))
        .withColumn("_rank", F.row_number().over(of_place))
        .where(F.col("phrase") | (F.col("_rank") == 1))
    )
    # A phrase keeps its diagonals apart; those of a notice merge while they drift little. Their places are near each other then.
    drift = F.col("diagonal") - F.lag("diagonal").over(by)
    new = drift.isNull() | (drift > F.when(F.col("phrase"), 0).otherwise(max_drift))
    regions = (
        votes.withColumn("_new", F.when(new, 1).otherwise(0))
        .withColumn("region", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "t_words", "t_grams", "region")
        .agg(F.size(F.collect_set("tpos")).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
        .withColumn("share", F.col("votes") / F.col("t_grams"))
    )
    verified = F.when(F.col("phrase"), F.col("votes") == F.col("t_grams")).otherwise(F.col("share") >= min_share)
    span = F.when(verified, F.struct(F.col("low").alias("first_word"), (F.col("high") + k).alias("end_word"), "label", "phrase", "share"))
    return regions.groupBy("row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_list(span)).alias("spans"), F.coalesce(F.max("share"), F.lit(0.0)).alias("best")
    ).drop("row")


def digest(found):
    """Counts and first and last word of the phrases, the labels of phrases and of all spans, and the best share as score."""
    base = F.filter("spans", lambda s: s["phrase"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.col("best").alias("score"),
    )
