"""Encoding, counting, toxicity and licences: whole texts in, one row out."""

import math
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, licenses, toxicity
from skein.llm.blocks import SpanHasher, text_blocks, words
from skein.llm.token_counts import block_counts, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "  ", "\n\n a", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "it's 'sup 's ''s don't'", "x" * 500, "é中文 😀́", "a\u0085b\x1cc", "12½ 3", "#" * 300, "word " * 40_000]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def by_block(texts):
    import pyarrow as pa

    out = []
    for block in text_blocks(pa.array(texts, pa.string()), 64):
        ids, begins = bpe.encode_block(bpe.load_bpe(PATH), block)
        out += [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)]
    return out


def test_encoding_is_the_librarys():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'s", "'ll", "'", "!", "1", "中", "<|endoftext|>", "re", "́", "😀", "ſ"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert by_block(texts) == [expected(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_any_text(text):
    assert by_block([text]) == [expected(text)]


def test_pretokens_are_told_apart_by_their_bytes(monkeypatch):
    morse = ["".join("ab"[k.bit_count() % 2 ^ flip] for k in range(1024)) for flip in (0, 1)]  # equal power sums modulo 2^64
    texts = [" ".join(morse), f"a {morse[0]} b {morse[1]}", "one two one"]
    block = next(text_blocks(pa.array(texts)))
    model = bpe.load_bpe(PATH)
    assert [ids for ids in by_block(texts)] == [expected(t) for t in texts]
    assert block_counts(model, block).tolist() == [len(expected(t)) for t in texts]
    monkeypatch.setattr(SpanHasher, "__call__", lambda self, starts, ends: (starts % 3).astype(np.uint64))  # most words collide
    assert by_block(texts) == [expected(t) for t in texts] and block_counts(model, block).tolist() == [len(expected(t)) for t in texts]


def test_words_of_blocks():
    import pyarrow as pa

    texts = ["a b", "b", "", None, " c\td ", "e\x0bf g"]
    out = []
    for block in text_blocks(pa.array(texts), 4):
        starts, ends, first = words(block)
        raw = block.data.tobytes()
        out += [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert out == [["a", "b"], ["b"], [], [], ["c", "d"], ["e", "f g"]]
    block = next(text_blocks(pa.array(["Ab aB ab"])))
    starts, ends, _ = words(block)
    assert len(np.unique(SpanHasher(block.data, fold=True)(starts, ends))) == 1
    assert len(np.unique(SpanHasher(block.data)(starts, ends))) == 3


def table(spark, texts):
    rows = [(k, t, "own", 7, [1], "x", True) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, ids array<int>, decoded string, over_limit boolean")


def test_encode_and_decode_rows(spark):
    texts = [*ODD, None, "copy", "copy"]
    df = table(spark, texts)
    rows = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == [expected(t) for t in texts]
    assert [r["decoded"] for r in rows] == [LIBRARY.decode(expected(t), skip_special_tokens=False) for t in texts]
    both = bpe.encode_and_decode(df, PATH).orderBy("doc_id")
    assert both.columns == ["doc_id", "source", "n_tokens", "over_limit", "ids", "decoded"] and [(r["ids"], r["decoded"]) for r in both.collect()] == [(r["ids"], r["decoded"]) for r in rows]
    assert {r["source"] for r in rows} == {"own"} and {r["n_tokens"] for r in rows} == {7}
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -5, 10**6, 64])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == ["", "", LIBRARY.decode([64])]


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text union all select 2L, 'caf\u00e9' union all select 3L, cast(x'c3' as string)")
    want = {1: expected("a\ufffdb"), 2: expected("caf\u00e9"), 3: expected("\ufffd")}
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(df, PATH).collect()} == want
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, PATH).collect()} == {1: (3, len(want[1])), 2: (5, len(want[2])), 3: (1, len(want[3]))}


def test_token_counts(spark):
    texts = [*ODD, None, "copy", "copy"]
    rows = count_tokens(table(spark, texts), PATH, limit=3).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [len(expected(t)) for t in texts]
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in rows] == [len(expected(t)) > 3 for t in texts]
    assert count_tokens(table(spark, texts).limit(0), PATH).count() == 0
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = count_tokens(table(spark, texts[:6]), model).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [len(library.encode(t)) for t in texts[:6]]


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 6)) < 0.3
    score = x @ np.array([3.0, 2.0, 0, 0, -1.0, 0]) + rng.logistic(size=3000) * 0.3
    grades = np.digitize(score, [1.0, 3.5])
    rows, columns = np.nonzero(x)
    weights, cuts = toxicity.fit_cumulative(rows, columns, grades, 6, 3)
    assert weights[0] > weights[1] > 1 and weights[4] < 0 and abs(weights[2]) < 1 and cuts[0] < cuts[1]
    severity = toxicity.OrdinalModel(np.arange(6), weights, cuts).severity(x @ weights)
    assert (np.round(severity) == grades).mean() > 0.85


def test_likelihood_by_brute_force():
    rng = np.random.default_rng(3)
    x, grades = rng.random((40, 5)) < 0.4, rng.integers(0, 4, 40)
    rows, columns = np.nonzero(x)
    value = rng.normal(size=8) * 0.7
    loss, gradient = toxicity.likelihood(value, rows, columns, grades, 5)
    cuts = [value[5], value[5] + math.exp(value[6]), value[5] + math.exp(value[6]) + math.exp(value[7])]
    total, logistic = 0.0, lambda z: 1 / (1 + math.exp(-z))
    for k in range(40):
        score = sum(value[j] for j in range(5) if x[k, j])
        up = logistic(cuts[grades[k]] - score) if grades[k] < 3 else 1.0
        total -= math.log(up - (logistic(cuts[grades[k] - 1] - score) if grades[k] else 0.0)) / 40
    assert abs(loss - total - toxicity.PENALTY / 2 * sum(v * v for v in value[:5])) < 1e-9
    for j in range(8):
        step = np.eye(8)[j] * 1e-6
        slope = (toxicity.likelihood(value + step, rows, columns, grades, 5)[0] - toxicity.likelihood(value - step, rows, columns, grades, 5)[0]) / 2e-6
        assert abs(slope - gradient[j]) < 1e-6
    model = toxicity.OrdinalModel(np.arange(5), value[:5], np.array(cuts))
    chances = [[logistic(c - s) for c in cuts] for s in (-1.0, 0.3)]
    expected_grade = [sum(k * (b - a) for k, (a, b) in enumerate(zip([0, *p], [*p, 1], strict=True))) for p in chances]
    assert np.allclose(model.severity(np.array([-1.0, 0.3])), expected_grade)


def test_grades_of_toxic_texts(spark):
    toxic, half = np.array([1, 1, 1, 1, 0, 1]), np.array([0, 0, 1, 1, 0, 1])
    marks = np.array([[3, 1, 9, 9, 5, 9], [9, 9, 0, 2, 9, 4]])
    assert toxicity.graded(toxic, half, marks).tolist() == [2, 1, 1, 2, 0, 2]
    assert toxicity.graded(toxic, half, np.zeros((2, 6), int)).tolist() == [1, 1, 1, 1, 0, 1]
    docs = spark.createDataFrame([(k, ("vile word", "fine word", "vile grim slur", "vile grim slur")[k % 4]) for k in range(400)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 4 != 1)) for k in range(400)], "doc_id long, toxic int"))
    severity = {r["text"]: r["severity"] for r in toxicity.score(docs, model).collect()}
    assert severity["vile grim slur"] > 1.5 > severity["vile word"] > toxicity.REJECT > severity["fine word"] and len(model.thresholds) == 2


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.score(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).toPandas()
    toxic, found = held["toxic"] == 1, held["severity"] >= toxicity.REJECT
    # Some labels have no mark in the text; those that have must be found.
    marked = toxic & held["text"].str.contains(r"\b(?:idiot|moron|scum|loser|clown|trash|stupid)\b", case=False)
    assert found[toxic].mean() > 0.8 and found[marked].mean() > 0.95 and found[~toxic].mean() < 0.01


def test_toxicity_edges(spark):
    texts = [None, "", "!!", "vile vile stuff", "fine words", "x" * 100_000, "vile vile stuff"]
    docs = spark.createDataFrame([(k, t, 9.0) for k, t in enumerate(texts)], "doc_id long, text string, severity double")
    none = spark.createDataFrame([(3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert not len(model.features)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 7 and all(r["severity"] < 1e-6 for r in rows)
    many = spark.createDataFrame([(k, "vile word" if k % 2 else "fine word") for k in range(40)], "doc_id long, text string")
    model = toxicity.fit(many, spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0)], "doc_id long, toxic int"))
    rows = {r["doc_id"]: r["severity"] for r in toxicity.score(docs, model).collect()}
    assert rows[3] == rows[6] > toxicity.REJECT > rows[4]
    assert toxicity.score(docs.limit(0), model).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."


@pytest.mark.parametrize(
    ("text", "found", "left"),
    [
        ("", [], []),
        ("No licence here, only permission.", [], []),
        ("Words. Released under the MIT License.", ["MIT"], []),
        (f"Intro words\n\n{MIT}\nMore.", ["MIT"], []),
        ("| a |\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"], []),
        ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"], []),
        ("You may not use this file except in compliance with the License.", [], ["apache-comply"]),
        ("RELEASED   UNDER the mit License!", ["MIT"], []),
        ("Foo is released under the MIT License.", ["MIT"], []),
        ("This project is licensed under the MIT License - see LICENSE.md", ["MIT"], []),
        ("Mozilla Public License Version 2.0\n\n1. Definitions", ["MPL-2.0"], []),
        ("# SPDX-License-Identifier: LGPL-2.1-only\ncode", ["LGPL-2.1-only"], []),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"], []),
        ("Neither the name of ACME Inc. (\"ACME\") nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission.", [], []),  # the name ends a sentence
        ("Neither the name of ACME Ltd nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission.", [], ["bsd-endorse"]),
        ("Released under the Foo License. Licensed under one two three four five six seven eight nine the MIT License.", [], []),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"], []),
        ("One two three four five six seven eight nine is licensed under the MIT License.", [], []),
    ],
)
def test_licence_rules(text, found, left):
    assert licenses.licences_of(licenses.known_sentences(text)) == (found, left)


def test_every_sentence_has_a_trigger_and_a_rule():
    assert all(any(t in s for t in licenses.TRIGGERS) for s in licenses.sentences())
    used = {n for _, rule in licenses.RULES for n in rule}
    assert used <= {*licenses.sentences().values()}


def test_licences_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    for r in licenses.scan(docs).collect():
        assert {*r["licenses"]} == {k for k, v in planted.items() if v in r["text"]}
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "word " * 50_000 + ". Released under the MIT License.", "x"), (4, "word " * 50_000 + "Released under the MIT License.", "x")], "doc_id long, text string, licenses string")
    # A known sentence begins a fragment: in 3 a sentence mark stands before it, in 4 nothing does.
    assert [r["licenses"] for r in licenses.scan(odd).orderBy("doc_id").collect()] == [[], [], [], ["MIT"], []]
    assert licenses.scan(odd.limit(0)).count() == 0


def test_licence_sql_says_the_same():
    import duckdb

    from skein.llm.queries import oracle_sql

    rng = random.Random(5)
    lines = [*licenses.TEXTS, "released under the MIT License", "This software is licensed under the terms of the GNU Affero General Public License version 3 see COPYING", "Foo Bar is available under the ISC License", "SPDX-License-Identifier: CC0-1.0", "the Unlicense", "no licence", "plain words", ""]
    ends = [". ", ".\n", "\n", "\n\n", ": ", "; ", " ", "? "]
    texts = ["".join((line.replace("*", "ACME Labs").replace(" ", rng.choice((" ", " ", "\n"))) if rng.random() < 0.3 else line.replace("*", "x y")) + rng.choice(ends) for line in rng.choices(lines, k=rng.randint(1, 9))) for _ in range(300)]
    for _, rule in licenses.RULES:
        own = {i: s for s, i in licenses.sentences().items() if s.count("*") < 2}
        texts.append(". ".join(own[i].replace("*", "some holder") for i in rule) + ".")
    documents = pd.DataFrame({"doc_id": range(len(texts) + 2), "text": [*texts, None, ""]})  # noqa: F841
    rows = duckdb.sql(oracle_sql()["op3_licenses"]).fetchall()
    want = []
    for k, t in enumerate([*texts, "", ""]):
        names = licenses.known_sentences(t)
        found, free = licenses.licences_of(names)
        want.append((k, len(names), ",".join(dict.fromkeys(found)), ",".join(free)))
    assert sorted(rows) == want


def test_queries_keep_every_row(spark):
    from skein.llm.queries import queries

    for name in ("op2_toxicity", "op3_licenses"):
        assert queries()[name](spark, "/root/testdata/sf0.001").agg(F.count_distinct("doc_id")).first()[0] == 200
