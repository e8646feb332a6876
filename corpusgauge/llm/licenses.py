"""License notices by diagonal voting.

Every three words of a text are named by a hash, and a join with the named three words of all notices gives their offsets
(place in the text less place in the notice): a copy of a notice votes for one offset, and a word put in or left out moves the
rest to an offset beside it. Votes are added up per offset, offsets that are neighbours are taken together, and where enough
agree, the words themselves are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.mph import mix
from corpusgauge.llm.shared import stored

U = np.uint64
#: Phrases whose words, standing together, give a label at once.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public notices by label; another table may be passed.
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "All rights reserved"),
)
#: Words of a vote, and how many offsets above another count as its neighbours.
GRAM, SLACK = 3, 2
#: Shares of a notice's votes that have to agree, and of its words that have to stand in the text.
VOTES, WORDS = 0.6, 0.8
#: Names in one row on the way to the join, and bytes of text worked on at once.
NAMES_PER_ROW, CHUNK_BYTES = 4096, 1 << 20
#: Rows of candidates that are sent to all tasks; more are joined by a shuffle.
SENT_ROWS = 100_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEYS = ["key", "h1", "h2"]


def words_of(text: bytes) -> list[bytes]:
    """Words of a text after lower-casing A-Z: runs of digits, letters and everything beyond ASCII."""
    return _WORD.findall(text.lower())


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, row after the last, different words, number of each word, where each text's words begin) of slices of batches."""
    for b in batches:
        texts, a = b.column(column), 0
        while a < len(b):
            words, starts, size, z = [], [0], 0, a
            while z < len(b) and (z == a or size < CHUNK_BYTES):
                text = texts[z].as_buffer().to_pybytes()
                words += words_of(text)
                starts.append(len(words))
                size += len(text)
                z += 1
            coded = pa.array(words, pa.large_binary()).dictionary_encode()
            yield b.slice(a, z - a), coded.dictionary, coded.indices.to_numpy(), np.array(starts)
            a = z


def _hashed(words: pa.Array) -> np.ndarray:
    """64-bit names of words."""
    return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words.to_pylist()], U)


def _grams(names: np.ndarray) -> np.ndarray:
    """Names of each GRAM neighbouring words."""
    if len(names) < GRAM:
        return np.zeros(0, U)
    out = names[: len(names) - GRAM + 1]
    with np.errstate(over="ignore"):
        for k in range(1, GRAM):
            out = mix(out * U(0x9E3779B97F4A7C15) + names[k : len(names) - GRAM + 1 + k], k)
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2"), whole.alias("text"))


def _profile(keyed: DataFrame) -> DataFrame:
    """(key, h1, h2, n_words, n_base, first_word, last_word, base) of each row; base has the labels of the phrases found."""
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    kind = keyed.schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, different, codes, starts in _texts(batches, 3):
            number = {w: i for i, w in enumerate(different.to_pylist())}
            at, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, (phrase, _) in enumerate(phrases):
                if all(w in number for w in phrase):
                    hit = np.ones(max(0, len(codes) - len(phrase) + 1), bool)
                    for k, w in enumerate(phrase):
                        hit &= codes[k : k + len(hit)] == number[w]
                    found = np.flatnonzero(hit)
                    of = np.searchsorted(starts, found, "right")
                    at.append(found[found + len(phrase) <= starts[of]])
                    label.append(np.full(len(at[-1]), n))
            at, label = np.concatenate(at), np.concatenate(label)
            order = np.argsort(at, kind="stable")
            at, label = at[order], label[order]
            lo, hi = np.searchsorted(at, starts[:-1]), np.searchsorted(at, starts[1:])
            first = [int(at[a] - s) if a < z else None for a, z, s in zip(lo, hi, starts, strict=False)]
            last = [int(at[z - 1] - s) if a < z else None for a, z, s in zip(lo, hi, starts, strict=False)]
            labels = [[phrases[n][1] for n in set(label[a:z].tolist())] for a, z in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(np.diff(starts)), pa.array(hi - lo), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(labels, pa.list_(pa.string()))],
                [*_KEYS, "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return keyed.mapInArrow(measure, f"key {kind}, h1 long, h2 long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def _votes(keyed: DataFrame, notices: list[list[bytes]]) -> DataFrame:
    """(key, h1, h2, notice, offset, votes): how many places of a notice agree on each offset; equal rows count once."""
    spark, kind = keyed.sparkSession, keyed.schema["key"].dataType.simpleString()
    rows = [(int(g), n, j) for n, words in enumerate(notices) for j, g in enumerate(_grams(_hashed(pa.array(words, pa.large_binary()))).view(np.int64).tolist())]
    places = spark.createDataFrame(rows, "gram long, notice int, place long")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, different, codes, starts in _texts(batches, 3):
            grams = _grams(_hashed(different)[codes]).view(np.int64)
            rows, at, lists = [], [], []
            for i, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                for first in range(a, z - GRAM + 1, NAMES_PER_ROW):
                    rows.append(i)
                    at.append(first - a)
                    lists.append(grams[first : min(first + NAMES_PER_ROW, z - GRAM + 1)])
            if rows:
                keys = [c.take(pa.array(rows)) for c in part.columns[:3]]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists)))], [*_KEYS, "at", "grams"])

    named = keyed.mapInArrow(name, f"key {kind}, h1 long, h2 long, at long, grams array<long>")
    each = named.select(*_KEYS, "at", F.posexplode("grams").alias("i", "gram"))
    # the notices are a parameter of a few hundred words: they are sent to every task
    hits = each.join(F.broadcast(places), "gram").select(*_KEYS, "notice", (F.col("at") + F.col("i") - F.col("place")).alias("offset"), "place")
    return hits.distinct().groupBy(*_KEYS, "notice", "offset").agg(F.count("*").alias("votes"))


def _verified(keyed: DataFrame, asked: DataFrame, notices: list[list[bytes]]) -> DataFrame:
    """(key, h1, h2, notice, share): the largest share of a notice's words that stand in the text at one of the neighbouring offsets asked for."""
    kind = keyed.schema["key"].dataType.simpleString()
    wanted = asked.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("notice", "offset"))).alias("asked"))
    right = wanted.select(*(F.col(c).alias(f"_{c}") for c in _KEYS), "asked")
    if wanted.count() <= SENT_ROWS:
        right = F.broadcast(right)
    both = keyed.join(right, F.expr("key <=> _key and h1 = _h1 and h2 = _h2")).select(*_KEYS, "text", "asked")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, different, codes, starts in _texts(batches, 3):
            number = {w: i for i, w in enumerate(different.to_pylist())}
            coded = [np.array([number.get(w, -1) for w in words]) for words in notices]
            rows, found, shares = [], [], []
            for i, spans in enumerate(part.column(4).to_pylist()):
                own, best = codes[starts[i] : starts[i + 1]], {}
                for s in spans:
                    notice = coded[s["notice"]]
                    there = np.zeros(len(notice), bool)
                    for offset in range(s["offset"], s["offset"] + SLACK + 1):
                        lo, hi = max(0, -offset), min(len(notice), len(own) - offset)
                        if lo < hi:
                            there[lo:hi] |= own[lo + offset : hi + offset] == notice[lo:hi]
                    best[s["notice"]] = max(best.get(s["notice"], 0.0), int(there.sum()) / len(notice))
                rows += [i] * len(best)
                found += best
                shares += best.values()
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in part.columns[:3]), pa.array(found, pa.int32()), pa.array(shares, pa.float64())], [*_KEYS, "notice", "share"])

    return both.mapInArrow(compare, f"key {kind}, h1 long, h2 long, notice int, share double")


def scan_licenses(docs: DataFrame, key: str, text: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """License labels of every row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, counted from 0. n_base counts the places of the
    PHRASES, first_word and last_word are the smallest and largest (null without any), base_labels their labels. labels adds
    those of `notices` (label, text) of which, at some offset and those up to SLACK above it, a share of VOTES of the three-word
    places agrees and a share of WORDS of the words stands in the text; both are distinct, sorted and joined by commas. score is the
    largest share of words so found, 0 without any.

    Null and empty texts have no words and no labels. Rows are told apart by key and text: equal rows have equal answers, null and
    repeated keys do no harm; other columns are not looked at, whatever their names. Notices of fewer than three words never match.
    Only votes are shuffled, never texts, while the texts with candidates are at most SENT_ROWS; beyond that Spark joins by a shuffle.
    """
    split = [words_of(t.encode()) for _, t in notices]
    keyed = _keyed(docs, key, text)
    votes = _votes(keyed, split)
    beside = Window.partitionBy(*_KEYS, "notice").orderBy("offset").rangeBetween(0, SLACK)
    least = F.element_at(F.create_map(*(F.lit(x) for n, w in enumerate(split) for x in (n, VOTES * max(1, len(w) - GRAM + 1)))), F.col("notice"))
    asked = stored(votes.withColumn("agree", F.sum("votes").over(beside)).where(F.col("agree") >= least).select(*_KEYS, "notice", "offset"), "license-offsets")
    shares = _verified(keyed, asked, split).where(F.col("share") >= WORDS)
    label = F.element_at(F.array(*(F.lit(x) for x, _ in notices)), F.col("notice") + 1)
    found = shares.groupBy(*(F.col(c).alias(f"_{c}") for c in _KEYS)).agg(F.collect_set(label).alias("more"), F.max("share").alias("share"))
    rows = _profile(keyed).join(found, F.expr("key <=> _key and h1 = _h1 and h2 = _h2"), "left")
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"),
    )
