"""Operator 9: licence scan with a positional rare-token index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence notice: its label, its words in order, and phrases that must all stand in the file, consecutively."""
    label: str
    words: str
    phrases: tuple[str, ...]


# The base phrases and the notices that people put at the head of files.
BASE = (Template("cc-by", "cc by", ("cc by",)), Template("gpl", "general public license", ("general public license",)), Template("reserved", "all rights reserved", ("all rights reserved",)))
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3.0", "gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def document_words(text: Column) -> Column:
    """Words in order, upper case kept; the empty pieces that separators at either end leave are taken off."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda w: w != "")


def licence_word_idf(docs: DataFrame, vocabulary: set[str]) -> dict[str, float]:
    """Inverse document frequency of the library's own words over all documents. Bounded by the library, not by the corpus."""
    import math
    present = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), SEPARATOR), lambda w: F.lower(w).isin(*sorted(vocabulary))))
    words = docs.select(F.explode(present).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    counts, total = dict(map(tuple, words.collect())), docs.count()
    return {w: math.log((total + 1) / (min(counts.get(w, 0), total) + 0.5)) for w in vocabulary}


def _rarest(words: list[str], idf: dict[str, float]) -> int:
    return max(range(len(words)), key=lambda k: (idf[words[k]], -k))


def scan_licenses(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, min_share: float = 0.6) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The library is an index from each template's rarest word (highest idf over all documents) to its position in the
    template. A word of the file found there proposes a start, and the template's other words are looked up by relative
    position; places proposed by the rarest word are all places, since any full match contains it. A base phrase counts
    where all its words match. A notice is reported where the matched words weigh ``min_share`` of the template's idf and
    each of its mandatory phrases stands in the file; ``score`` is the best matched share of any reported label, 1 for base
    phrases, 0 without labels.

    Words are compared after lower-casing A-Z. NULL or empty text has 0 words and no labels. All rows are kept, also
    repeated ones and those with a NULL id. An empty table gives no rows.
    """
    library = [(t, t.words.split()) for t in (*base, *notices)]
    phrases = sorted({p for t, _ in library for p in t.phrases})
    idf = licence_word_idf(docs, {w for _, ws in library for w in ws} | {w for p in phrases for w in p.split()})
    anchors = sorted({ws[_rarest(ws, idf)] for _, ws in library} | {p.split()[_rarest(p.split(), idf)] for p in phrases})

    # every file is reduced to the positions of anchor words; all else is looked up around those
    words = docs.select("doc_id", document_words(F.col("text")).alias("w"))
    hits = words.select("doc_id", "w", F.filter(F.transform("w", lambda w, i: F.when(F.lower(w).isin(*anchors), i)), lambda i: i.isNotNull()).alias("hits"))

    def at(position: Column) -> Column:
        return F.lower(F.get("w", position))

    def starts(text: list[str]) -> Column:
        k = _rarest(text, idf)
        proposed = F.filter("hits", lambda i: (at(i) == text[k]) & (i >= k))
        full = F.filter(proposed, lambda i: _all(at(i + (j - k)) == w for j, w in enumerate(text) if j != k))
        return F.transform(full, lambda i: i - k)

    def best_share(text: list[str]) -> Column:
        k, weight = _rarest(text, idf), sum(idf[w] for w in text)
        proposed = F.filter("hits", lambda i: at(i) == text[k])
        shares = F.transform(proposed, lambda i: sum((F.when((i + (j - k) >= 0) & (at(i + (j - k)) == w), idf[w]).otherwise(0.0) for j, w in enumerate(text)), F.lit(0.0)) / weight)
        return F.coalesce(F.array_max(shares), F.lit(0.0))

    none = F.array().cast("array<int>")
    places = hits.where(F.size("hits") > 0).select("doc_id", F.size("w").alias("n"), *(starts(t.words.split()).alias(f"b{k}") for k, t in enumerate(base)),
                         *(best_share(ws).alias(f"s{k}") for k, (_, ws) in enumerate(library[len(base):])), *(starts(p.split()).alias(f"p{k}") for k, p in enumerate(phrases)))
    blank = hits.where(F.size("hits") == 0).select("doc_id", F.size("w").alias("n"), *(none.alias(f"b{k}") for k in range(len(base))), *(F.lit(0.0).alias(f"s{k}") for k in range(len(notices))), *(none.alias(f"p{k}") for k in range(len(phrases))))
    places = places.unionAll(blank)
    every = F.concat(*(F.col(f"b{k}") for k in range(len(base))))
    number = {p: k for k, p in enumerate(phrases)}
    verified = [F.when((F.col(f"s{k}") >= min_share) & _all(F.size(f"p{number[p]}") > 0 for p in t.phrases), F.col(f"s{k}")) for k, t in enumerate(notices)]
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"b{k}") > 0, F.lit(t.label)) for k, t in enumerate(base))))
    more = F.array_compact(F.array(*(F.when(v.isNotNull(), F.lit(t.label)) for v, t in zip(verified, notices))))
    return places.select("doc_id", F.col("n").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                         F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, more))), ",").alias("labels"),
                         F.greatest(F.when(F.size(every) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.array_compact(F.array(*verified))), F.lit(0.0))).alias("score"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
