import random
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat_format as C
from rankloom.llm import language_id as L
from rankloom.llm import license_scan as I
from rankloom.llm import sharding as H

TRICKY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>", "<\\s>", "<<s>", "<|im_start|><|im_sep|>", "[[INST]", "<|im_end|", "a\nb", "é😀", "<|image|> in text"]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", C.text_part(F.col("text")))


def test_chat_round_trip(spark):
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(TRICKY)]
    out = C.format_conversations(messages(spark, rows))
    row = out.select("formatted", C.read_back(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t["role"], t["content"]) for t in row["turns"]] == [(r[2], r[3]) for r in rows]
    assert row["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert row["formatted"].count(C.END) == len(rows) and "[INST]" not in row["formatted"]


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 1, "assistant", "lost"), (2, 1, "role <|im_sep|>\n", "x"), (2, 1, "role <|im_sep|>\n", "x")]
    got = {r["conv_id"]: r["turns"] for r in C.format_conversations(messages(spark, rows)).select("conv_id", C.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [t["content"] for t in got[1]] == ["first", "", "a", "b"]
    assert [t["role"] for t in got[2]] == ["role <|im_sep|>\n"] * 2 and got[None][0]["content"] == "lost"
    assert C.format_conversations(messages(spark, []).limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=1000, height=600), part("text", " and <|image|>"), part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3)]), (1, 1, "assistant", [])]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{C.PART}>")
    row = C.format_conversations(df).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 4 * C.TILE_TOKENS), ("audio", "b.wav", 50), ("document", "c.pdf", 3 * C.TOKENS_A_PAGE)]
    assert row["attachment_tokens"] == 4 * C.TILE_TOKENS + 50 + 3 * C.TOKENS_A_PAGE
    assert row["formatted"].count("<|image|>") == 1 and row["formatted"].index("<|image|>") < row["formatted"].index("<|audio|>")


def test_licenses(spark):
    full = "\n".join([*(I.SENTENCES["mit-notice"][:1]), "Copyright (c) 2020 Somebody.", I.SENTENCES["mit-grant"][0] + ":", I.SENTENCES["mit-keep"][0] + ".", I.SENTENCES["asis"][0] + "."])
    rows = [(1, "Text. Licensed under CC BY-NC 4.0. More."), (2, full), (3, "nothing here"), (4, None), (5, ""), (6, "ALL RIGHTS RESERVED.\nall rights reserved!")]
    got = {}
    for r in I.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["first"], r["last"]))
    assert got[1] == [("CC-BY-NC-4.0", 1, 1)] and got[2] == [("MIT", 0, 4)] and len(got[6]) == 2 and set(got) == {1, 2, 6}
    assert I.scan(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0


def test_each_license_rule_on_wrapped_text(spark):
    """Every rule, its sentences wrapped into comment lines, with an unknown sentence of two lines between."""
    rows = []
    for n, (_, ids) in enumerate(I.RULES):
        for variant in range(max(len(I.SENTENCES[x]) for x in ids)):
            own = [I.SENTENCES[x][variant % len(I.SENTENCES[x])] for x in ids]
            rows.append((n * 100 + variant, "Some text.\n\n" + "\n * Another sentence that\n * nobody knows.\n".join("\n".join(" * " + x for x in textwrap.wrap(s + ".", 40)) for s in own) + "\n\nmore"))
    got = {(r["doc_id"], r["license"], tuple(r["rule"].split(" "))) for r in I.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(n, name, tuple(ids)) for n, name, ids in ((n, *I.RULES[n // 100]) for n, _ in rows)} and len(got) == len(rows)


def test_real_license_headers(spark):
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT"
    rows = [(1, gpl), (2, mpl), (3, isc), (4, "MIT\n\nLicense")]
    got = sorted((r["doc_id"], r["license"]) for r in I.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "GPL-3.0"), (2, "MPL-2.0"), (3, "ISC")]


def test_language_accuracy_and_rejection(spark):
    draw = random.Random(13)
    sounds = {"xx": ["ka", "mo", "ti"], "yy": ["schr", "ung", "ein"], "zz": ["eau", "oux", "ier"]}
    rows = [(n, " ".join("".join(draw.choice(sounds[lang]) for _ in range(3)) for _ in range(draw.choice([1, 5, 60]))), lang) for n, lang in enumerate(draw.choice(list(sounds)) for _ in range(600))]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 !? 34", "yy"), (1003, "ka mo " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = L.fitted(docs)
    got = {r["doc_id"]: r for r in L.identify(docs, model).withColumn("held", L.held_out()).collect()}
    held = [n for n, _, lang in rows if lang and got[n]["held"] and n < 1000]
    assert len(held) > 80 and sum(got[n]["lang_pred"] == rows[n][2] for n in held) >= 0.98 * len(held)
    assert all(got[n]["lang_pred"] == "und" and got[n]["rejected"] and got[n]["score"] == 0 for n in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "xx" and all(0 <= r["score"] <= 1 for r in got.values())
    assert L.identify(docs.limit(0), model).count() == 0
    none = L.fitted(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and {r["lang_pred"] for r in L.identify(docs.limit(5), none).collect()} == {"und"}


def test_gibberish_and_unlearned_languages_are_rejected(spark, sf_dir):
    draw = random.Random(18)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    junk = ["".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(400)]
    cyrillic = ["".join(draw.choice("абвгдежзиклмнопрстуфхцчшыэюя") for _ in range(6)) for _ in range(400)]
    rows = [(10**6 + n, " ".join(words[n : n + 80])) for n, words in enumerate([junk] * 300)] + [(2 * 10**6 + n, " ".join(cyrillic[n : n + 80])) for n in range(300)]
    model = L.fitted(docs)
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert got.where("NOT rejected").count() == 0
    short = docs.where("lang IS NOT NULL").select("doc_id", F.array_join(F.slice(F.split("text", r"\s+"), 20, 6), " ").alias("text")).where("text rlike '[a-z]'")
    assert L.identify(short, model).where("rejected").count() <= 0.02 * short.count()
    assert L.identify(docs, model).where("rejected AND text rlike '[a-z]'").count() == 0


def test_best_fit_decreasing_by_hand():
    draw = random.Random(14)
    for _ in range(20):
        items = [draw.randint(1, 60) for _ in range(200)]
        bins, want = [], []
        for size in sorted(items, reverse=True):
            fits = [(left, b) for b, left in enumerate(bins) if left >= size]
            b = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append(90)
            bins[b] -= size
            want.append((size, b))
        found = H.best_fit_decreasing(list(Counter(items).items()), 90)
        assert [(size, b) for size, b, n in found for _ in range(n)] == want


def test_shards(spark):
    draw = random.Random(15)
    rows = [(n, draw.choice(["hot " * 50, f"text {n} " * draw.randint(1, 30), None, ""]) if n % 3 else "hot " * 50) for n in range(2000)] + [(5000, "big " * 3000), (5000, "big " * 3000)]
    got = H.shard(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(0)), 8).collect()
    assert len(got) == len(rows)
    texts = {}
    for n, text in rows:
        texts.setdefault(text or "", set()).add(n)
    place = {}
    for r in got:
        place.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(set().union(*(place[n] for n in ids))) == 1 for ids in texts.values())
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert H.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shards", [4])
def test_even_sizes_without_hot_groups(spark, shards):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int)) || id").alias("text"))
    sums = [r["b"] for r in H.shard(df, shards).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == shards and max(sums) <= 1.02 * min(sums)
