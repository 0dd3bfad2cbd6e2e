"""Collocations against a count of all phrases in plain Python."""

import re
from collections import Counter

import pytest

from storystream.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, support, top):
    """Every phrase of one to five words is counted by itself."""
    counts: dict[str, Counter] = {}
    for lang, text in docs:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 6):
                f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        inside = set()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if a >= f[p[i : i + size]]:
                        inside.add(p[i : i + size])
        rows = []
        for p, a in found.items():
            if p not in inside:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()
    rows = [(r.lang, r.text) for r in rows]
    rows += [
        (None, "A b. a B, a b; c a b"), ("en", None), ("en", ""), (None, None), ("und", "a b a b a b a b"),
        ("zz", "x " * 3000), ("en", "\x0b one\x0ctwo\x85three \x1c four\r"), ("de", "\xa0 a   b \xa0 a   b"),
        ("zz", "ein Wort\tund noch ein Wort\tund noch ein Wort"), ("", "x y x y"),
    ]
    return rows


@pytest.mark.parametrize(("support", "group", "lot"), [(2, 40, 1 << 20), (3, 1 << 20, 5000), (20, 200, 1 << 20)])
def test_against_all_phrases(spark, docs, monkeypatch, support, group, lot):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", lot)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    found = collocations.collocations(table, support=support, group_suffixes=group, top=300)
    assert {tuple(r) for r in found.collect()} == brute(docs, support, 300)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "lang string, text string, f bigint, key binary, words string")
    assert collocations.collocations(empty).collect() == []
    one = spark.createDataFrame([("en", "a b a b", 7, "k")], "lang string, text string, f bigint, key string")
    assert [(r.phrase, r.a) for r in collocations.collocations(one, support=2).collect()] == [("a b", 2)]


def test_blocks_keep_suffixes():
    import numpy as np

    codebook = np.array([0, 5, 9], np.uint64)
    columns = [np.array(c, np.uint64) for c in ([5, 7], [9, 2**63], [0, 5], [0, 0], [0, 0])]
    words, counts = collocations.unpack(codebook, collocations.pack(codebook, columns, np.array([3, 1000])))
    assert (words == np.stack(columns)).all() and counts.tolist() == [3, 1000]
