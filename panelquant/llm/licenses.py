"""License scan with a positional index of rare template words.

Templates are word sequences with mandatory key phrases.  One pass over the texts notes where words of any template stand (positions and word
numbers, a small part of a text); from these the number of documents per word is counted over the whole corpus.  The index files every
template under its mandatory words of highest IDF.  A file's occurrences of these words are looked up, their postings intersected by
relative position (occurrence minus place in the template), and every start that is left is verified: all key phrase words in place, and at
least a given share of all template words.  A start that passes has all rare mandatory words in place, so the look-up loses none.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelquant.llm.common import only, small_batches, typed, written
from panelquant.llm.decontaminate import FOLD, words_of

RARE = 3  # mandatory words per template that are looked up
PIECE = 1 << 20  # bytes of one text that are cut into words at once


@dataclass(frozen=True)
class Template:
    """text: the words; keys: phrases of the text whose words must all be in place (the whole text if there are none); least: share in place."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    least: tuple[int, int] = (7, 10)
    base: bool = False

    @functools.cached_property
    def words(self) -> tuple[bytes, ...]:
        return tuple(words_of(self.text))

    @functools.cached_property
    def must(self) -> tuple[int, ...]:
        """Mandatory places: the first occurrence of each key phrase."""
        out: set[int] = set()
        for k in self.keys or (self.text,):
            w = tuple(words_of(k))
            at = next((i for i in range(len(self.words) - len(w) + 1) if self.words[i:i + len(w)] == w), None)
            if not w or at is None:
                raise ValueError(f"{self.label}: no words, or the key phrase is not in the text: {k!r}")
            out.update(range(at, at + len(w)))
        return tuple(sorted(out))


#: Fixed values of the query's contract.
BASE = [Template("cc-by", "cc by", base=True), Template("gpl", "general public license", base=True), Template("reserved", "all rights reserved", base=True)]

#: Opening words of public licenses, and the short notices that refer to them.
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2.0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("use in source and binary forms", "conditions are met")),
    Template("bsd", "Released under the BSD License", ("BSD License",), (1, 2)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    Template("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ("CC BY-NC-ND 4.0",)),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("CC BY-NC-SA 4.0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("GNU General Public License, version 2",), (1, 2)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License, version 3",), (1, 2)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl", "This work is licensed under the GNU Lesser General Public License", ("GNU Lesser General Public License",), (1, 2)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("hereby granted, free of charge", "obtaining a copy of this software")),
    Template("mit", "Released under the MIT License", ("MIT License",), (1, 2)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License, v. 2.0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
]


def pieces(folded: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A folded text in pieces of about `size` bytes that end between words; a longer word stays whole."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def vocabulary(templates: list[Template]) -> list[bytes]:
    return sorted({w for t in templates for w in t.words})


def occurrences(docs: DataFrame, words: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, pos, word: where the given words stand in each row; texts are cut into words piece by piece.  Null has no words."""
    d = small_batches(only(docs, doc_id=doc_id, text=text))
    kind, arrow = typed(d, "doc_id")
    number = {w: k for k, w in enumerate(words)}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            counts, places, found, at = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int16)], [0]
            for t in b.column("text"):
                n, hits = 0, 0
                for p in pieces(t.as_py().encode().translate(FOLD) if t.is_valid else b""):
                    w = p.split()
                    code = np.fromiter(map(number.get, w, [-1] * len(w)), np.int16, len(w))
                    own = np.flatnonzero(code >= 0)
                    places.append((own + n).astype(np.int32))
                    found.append(code[own])
                    n, hits = n + len(w), hits + len(own)
                counts.append(n)
                at.append(at[-1] + hits)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(arrow), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(at, pa.array(np.concatenate(found)))],
                                             names=["doc_id", "n_words", "pos", "word"])

    return d.mapInArrow(run, f"doc_id {kind}, n_words bigint, pos array<int>, word array<smallint>")


def rare_words(templates: list[Template], words: list[bytes], df: dict[int, int], rare: int = RARE) -> list[list[tuple[int, int]]]:
    """Per template its (word number, place) of highest IDF among the mandatory ones: fewest documents first, then by word and place."""
    number = {w: k for k, w in enumerate(words)}
    return [sorted(((number[t.words[p]], p) for p in t.must), key=lambda x: (df.get(x[0], 0), x))[:rare] for t in templates]


def places_of(templates: list[Template], words: list[bytes], index: list[list[tuple[int, int]]], at: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(template number, starts, words in place) over ascending positions `at` with their word numbers.

    Positions of different documents lie further apart than the longest template, so no start sees two of them.
    """
    number = {w: k for k, w in enumerate(words)}
    order = np.argsort(word, kind="stable")
    cut = np.searchsorted(word[order], np.arange(len(words) + 1))
    of = lambda w: at[order[cut[w]:cut[w + 1]]]
    for k, (t, own) in enumerate(zip(templates, index)):
        starts = of(own[0][0]) - own[0][1]
        for w, p in own[1:]:
            if not len(starts):
                break
            starts = np.intersect1d(starts, of(w) - p, assume_unique=True)
        if not len(starts):
            continue
        here = np.zeros((len(t.words), len(starts)), bool)
        for p, w in enumerate(t.words):
            z = of(number[w])
            if len(z):
                i = np.minimum(np.searchsorted(z, starts + p), len(z) - 1)
                here[p] = z[i] == starts + p
        n = here.sum(0)
        ok = here[list(t.must)].all(0) & (n * t.least[1] >= len(t.words) * t.least[0])
        if ok.any():
            yield k, starts[ok], n[ok]


def scan(docs: DataFrame, templates: list[Template] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, places for every row; places: (label, start, words, share, base) in order of start.

    start is the word at which the template begins, which may lie before the text (below 0) where opening words are missing.  Null and empty
    texts have no words and no places; repeated rows, and rows that share an id, are scanned one by one; null ids stay.  An empty table
    gives no rows.  Long texts are read whole, piece by piece; what is held of a text are the places of template words.
    """
    templates = list(BASE + NOTICES if templates is None else templates)
    words = vocabulary(templates)
    d = written(occurrences(docs, words, doc_id, text), "occurrences")
    # one row per template word: bounded by the templates
    df = {r["w"]: r["n"] for r in d.select(F.explode(F.array_distinct("word")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    index, gap = rare_words(templates, words, df), max(len(t.words) for t in templates)
    labels, bases = [t.label for t in templates], [t.base for t in templates]

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("share", pa.float64()), ("base", pa.bool_())])
        for b in batches:
            n = b.column("n_words").to_numpy(zero_copy_only=False)
            base = np.concatenate([[0], np.cumsum(n + 2 * gap)])
            per = b.column("pos").value_lengths().to_numpy(zero_copy_only=False)
            at = b.column("pos").flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(base[:-1], per)
            word = b.column("word").flatten().to_numpy(zero_copy_only=False)
            found = list(places_of(templates, words, index, at, word))
            starts = np.concatenate([np.zeros(0, np.int64), *[s for _, s, _ in found]])
            which = np.concatenate([np.zeros(0, np.int64), *[np.full(len(s), k) for k, s, _ in found]]).astype(np.int64)
            size = np.concatenate([np.zeros(0, np.int64), *[c for _, _, c in found]])
            order = np.lexsort((which, starts))
            starts, which, size = starts[order], which[order], size[order]
            doc = np.searchsorted(base, starts + gap, side="right") - 1  # a start lies less than a template before its document
            length = np.array([len(t.words) for t in templates])
            rows = pa.StructArray.from_arrays([pa.array([labels[k] for k in which], pa.string()), pa.array(starts - base[doc]), pa.array(size, pa.int32()), pa.array(size / length[which], pa.float64()),
                                               pa.array([bases[k] for k in which], pa.bool_())], fields=list(kind))
            cut = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.ListArray.from_arrays(pa.array(cut), rows)], names=["doc_id", "n_words", "places"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words bigint, places array<struct<label:string,start:bigint,words:int,share:double,base:boolean>>")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share in place, 0 without a place)."""
    base = F.filter("places", lambda p: p["base"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    start = F.transform(base, lambda p: p["start"])
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
                          F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
