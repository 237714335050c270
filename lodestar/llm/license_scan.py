"""Licence scans with a positional rare-token index.

The index holds postings: for each word of the licence templates' key phrases, in which templates and
where in the phrase it stands. A first pass counts in how many documents each licence word occurs (all
documents; the words are the templates', so the table is small). A second pass looks up the licence
words of each text from the highest IDF down. A posting turns every occurrence into a place ``position -
offset`` of its template; the places of several (``LOOKUPS``) postings of a template are intersected, and the
mandatory key phrase is verified at those that are left. A template is only looked up where the text
has all words of its phrase, and a phrase's place is a place of each of its postings, so none is missed.

Words are runs of digits, letters and all characters outside ASCII, with A-Z lower-cased.

Score of a document: the best template's share of IDF weight found at its place, 0 without a match.
For a template whose full wording is longer than its key phrase the rest of the wording adds
to the score but is not needed for the label.

Defined cases: null and empty texts have no words and no match; long texts are read whole (work is linear in the
words); documents that repeat get the same result, as do words of equal IDF (ties are looked up by word);
an empty table gives an empty result; only ``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Base phrases, which alone count as places, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed values: (label, mandatory key phrase, full wording that contains it).
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("gpl", "general public license", "licensed under the gnu general public license version 3"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("agpl", "affero general public license", "gnu affero general public license"),
    ("cc-by", "licensed under cc by", "licensed under cc by"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("bsd", "bsd license", "redistributed under the bsd license"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", "made available under the eclipse public license"),
    ("isc", "isc license", "released under the isc license"),
    ("unlicense", "released into the public domain", "free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
)

#: Postings of a template whose places are intersected before its phrase is verified.
LOOKUPS = 3
#: Bytes that are not part of words become blanks, A-Z become a-z; all of UTF-8's other bytes stay.
_TABLE = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of_text(text: str) -> list[bytes]:
    """The words of a text, as UTF-8. Whole characters outside ASCII stay, so no word is cut in one."""
    return text.encode().translate(_TABLE).split()


def _vocabulary() -> list[bytes]:
    return sorted({w for _, key, full in TEMPLATES for w in (key + " " + full).encode().split()})


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents) of one task: the vocabulary's words only."""
    vocabulary = frozenset(_vocabulary())
    counts = dict.fromkeys(vocabulary, 0)
    rows = 0
    for batch in small_batches(batches, "text"):
        for text in batch.column("text").to_pylist():
            rows += 1
            for w in vocabulary.intersection(words_of_text(text)):
                counts[w] += 1
    found = [(w.decode(), n) for w, n in counts.items() if n] + [("", rows)]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])


def word_idf(docs: DataFrame) -> dict[bytes, float]:
    """IDF of each licence word over all documents (a fixed, small vocabulary)."""
    thin = docs.select(text_of(docs).alias("text"))
    got = {r["word"]: r["n"] for r in thin.mapInArrow(_seen, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.pop("", 0)
    return {w: math.log((1 + total) / (1 + got.get(w.decode(), 0))) + 1 for w in _vocabulary()}


class RareTokenIndex:
    """Postings of the templates' key phrases: word -> (template, its place in the phrase)."""

    def __init__(self, idf: dict[bytes, float], lookups: int = LOOKUPS):
        self.idf, self.lookups = idf, lookups
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.templates = []
        rarest = set()
        for t, (label, key, full) in enumerate(TEMPLATES):
            key_words, full_words = key.encode().split(), full.encode().split()
            at = next(i for i in range(len(full_words)) if full_words[i:i + len(key_words)] == key_words)
            for place, w in enumerate(key_words):
                self.postings.setdefault(w, []).append((t, place))
            rarest.add(max(key_words, key=lambda w: (idf[w], w)))
            self.templates.append((label, key_words, frozenset(key_words), full_words, at, (key, label) in BASE, sum(idf[w] for w in full_words)))
        self.rarest = frozenset(rarest)
        self.words = frozenset(self.postings)

    def places(self, words: list[bytes]) -> dict[int, set[int]]:
        """Candidate places of each template's key phrase: a text's licence words are looked up from the highest IDF
        down, until each template that the text can hold has ``lookups`` postings; places are intersected."""
        if self.rarest.isdisjoint(words):
            return {}
        here = self.words.intersection(words)
        open_lookups = {t: min(self.lookups, len(x[1])) for t, x in enumerate(self.templates) if x[2] <= here}
        if not open_lookups:
            return {}
        at: dict[bytes, list[int]] = {w: [] for w in here}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        found: dict[int, set[int]] = {}
        for w in sorted(here, key=lambda w: (-self.idf[w], w)):
            for t, offset in self.postings[w]:
                if open_lookups.get(t, 0) > 0:
                    starts = {i - offset for i in at[w] if i >= offset}
                    found[t] = found[t] & starts if t in found else starts
                    open_lookups[t] -= 1
        return found

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Places of base phrases, base labels, all labels, and the score."""
        places, base_labels, labels, score = [], set(), set(), 0.0
        n = len(words)
        for t, starts in self.places(words).items():
            label, key, _, full, at, base, weight = self.templates[t]
            for start in starts:
                if words[start:start + len(key)] != key:
                    continue
                labels.add(label)
                if base:
                    places.append(start)
                    base_labels.add(label)
                first = start - at
                got = sum(self.idf[w] for j, w in enumerate(full) if 0 <= first + j < n and words[first + j] == w)
                score = max(score, got / weight)
        return places, base_labels, labels, min(1.0, score)


_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double")


def scan_documents(docs: DataFrame, idf: dict[bytes, float] | None = None) -> DataFrame:
    """One row per document: words, places of base phrases, labels and score."""
    idf = word_idf(docs) if idf is None else idf

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(idf)
        for batch in small_batches(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of_text(text)
                places, base, labels, score = index.scan(words)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None),
                             ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return thin.mapInArrow(scan, _SCHEMA)
