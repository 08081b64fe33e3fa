"""Nulls, empty and very long texts, repeated rows and ids, clashing columns, empty tables; and
plans on the far side of each size check."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import llm
from rankloom.llm import chat_format as C
from rankloom.llm import decontaminate as D
from rankloom.llm import exact_dedup as E
from rankloom.llm import language_id as L
from rankloom.llm import license_scan as I
from rankloom.llm import ngram_join as N
from rankloom.llm import packing as P
from rankloom.llm import sharding as H
from rankloom.llm import substring_dedup as S
from rankloom.llm import token_counts as T
from rankloom.llm.shingles import shingle_hashes, word_hashes

DRAW = random.Random(23)
PROSE = " ".join(f"word{DRAW.randint(0, 900)}" for _ in range(120))
LONG = " ".join(f"w{DRAW.randint(0, 5000)}" for _ in range(60000))
ROWS = [(1, PROSE, "xx"), (1, PROSE, "xx"), (2, PROSE + " end", "xx"), (2, "other text", "yy"), (3, None, "xx"), (4, "", None), (None, PROSE, "yy"), (None, None, None), (5, LONG, "yy"), (6, "Licensed under the MIT License.", "xx"), (6, "Licensed under the MIT License.", "xx")]
CLASH = ["key", "row", "print", "fp", "n", "label", "words", "window", "shingle", "score", "shard", "slot", "n_tokens", "id", "at", "maybe", "hit", "sig", "bucket", "bitmap", "group", "size", "class", "cell", "fingerprint"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return df.withColumns({name: F.lit("x") for name in CLASH})


def items(spark):
    return spark.createDataFrame([("a", " ".join(PROSE.split()[20:40])), ("b", None), ("c", "")], "item_id string, text string").withColumns({name: F.lit("x") for name in ("window", "shingle", "n", "key")})


OPERATORS = {
    "tokens": lambda spark, df: T.count_tokens(df),
    "passages": lambda spark, df: S.repeated_passages(df),
    "classes": lambda spark, df: E.classes(df),
    "deduplicate": lambda spark, df: E.deduplicate(df),
    "hits": lambda spark, df: D.hits(df, items(spark)),
    "decontaminate": lambda spark, df: D.decontaminate(df, items(spark)),
    "near": lambda spark, df: N.near_duplicates(df),
    "first": lambda spark, df: N.first_of_groups(df),
    "language": lambda spark, df: L.identify(df, L.fitted(df)),
    "licences": lambda spark, df: I.scan(df),
    "shards": lambda spark, df: H.shard(df, 4),
    "packed": lambda spark, df: P.pack(df),
}
ROWS_OUT = {"tokens": 11, "classes": 11, "hits": 11, "near": 11, "language": 11, "shards": 11}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    got = out.collect()
    assert len(got) == ROWS_OUT.get(name, len(got)) and len(set(out.columns)) == len(out.columns)
    if name in ("deduplicate", "decontaminate", "first"):
        assert out.columns == docs.columns
    if name == "deduplicate":  # of equal texts one row stays
        assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in got) == sorted({(2, len(PROSE) + 4), (2, 10), (4, 0), (1, len(PROSE)), (5, len(LONG)), (6, 31)})
    if name == "decontaminate":  # each row by its own text
        assert sorted(len(r["text"] or "") for r in got) == sorted([10, 0, 0, 0, len(LONG), 31, 31])
    if name == "hits":
        assert sorted(len(r["hit_words"]) for r in got) == [0] * 7 + [20] * 4
    if name == "passages":
        assert {r["doc_id"] for r in got} == {1, 2} and all(r["similarity"] == 1 for r in got)
    if name == "licences":
        assert [(r["doc_id"], r["license"]) for r in got] == [(6, "MIT")]
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_long_and_clashing_conversations(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", "[INST] b"), (1, 1, "assistant", "\\a"), (1, 1, "assistant", "[INST] b")]
    own = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("x") for n in ("id", "m", "v", "raw", "formatted")})
    out = C.format_conversations(own.withColumn("parts", C.text_part(F.col("text"))))
    row = out.select(C.read_back(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t["content"] for t in row["turns"]] == [LONG, "[INST] b", "[INST] b", "\\a"]
    assert row["loss"] == "[INST] b[INST] b\\a"


def test_results_do_not_depend_on_size_checks(spark, sf_dir, monkeypatch):
    rows = lambda name: sorted(map(repr, llm.queries()[name](spark, sf_dir).collect()))
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = lambda: (sorted(r[0] for r in E.deduplicate(docs).select("doc_id").collect()), sorted(r[0] for r in D.decontaminate(docs, bench).select("doc_id").collect()))
    names = ("op3_exact_dedup", "op5_decontaminate", "op6_ngram_join", "op2_substring_dedup")
    before = [*map(rows, names), kept()]
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "FILTER_BITS", 1 << 15)
    for module in (E, D, N, S):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert [*map(rows, names), kept()] == before


def test_similar_passages_among_outsiders(spark):
    """A lower and a higher id hold the shingles of each passage scattered in noise."""
    draw = random.Random(3)
    say = lambda n: [f"w{draw.randint(0, 20000)}" for _ in range(n)]
    rows, want = [], {}
    for n in range(90):
        passage, noise = say(60), say(40)
        other = list(passage)
        if n % 3 == 1:
            other[draw.randint(8, 50)] = "changed"
        if n % 3 == 2:
            other.insert(draw.randint(8, 50), "inserted")
        for k in range(0, 56, 5):
            noise += passage[k : k + 5] + say(5)
        rows += [(n * 10, noise), (n * 10 + 9, noise[40:] + say(30)), (n * 10 + 4, say(25) + passage + say(25)), (n * 10 + 5, say(25) + other + say(25))]
        want |= {n * 10 + 4: n % 3, n * 10 + 5: n % 3}
    got = {r["doc_id"] for r in S.repeated_passages(spark.createDataFrame([(n, " ".join(t)) for n, t in rows], "doc_id long, text string")).collect()}
    assert all(n in got for n, kind in want.items() if kind == 0)
    assert sum(n in got for n in want) >= 0.97 * len(want)


def test_similar_passages_that_no_neighbours_show(spark):
    """Other documents hold parts of each passage, so that they stand between the two that have it."""
    draw = random.Random(5)
    say = lambda n: [f"w{draw.randint(0, 20000)}" for _ in range(n)]
    rows = []
    for n in range(0, 3000, 20):
        passage = say(56)
        other = list(passage)
        other[draw.randint(20, 36)] = "changed"
        rows += [(n + k, say(10) + passage[(at := draw.randint(0, 18)) : at + 38] + say(10)) for k in (0, 1, 2, 3, 6, 7, 8, 10, 11, 12)]
        rows += [(n + 5, say(15) + passage + say(15)), (n + 9, say(15) + other + say(15))]
    got = {r["doc_id"] for r in S.repeated_passages(spark.createDataFrame([(n, " ".join(t)) for n, t in rows], "doc_id long, text string")).collect()}
    assert got == {n + k for n in range(0, 3000, 20) for k in (5, 9)}


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words of 4,096 letters, and texts of half such words."""
    one = "a"
    for _ in range(12):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{n}" for n in range(12)]
    rows = [(1, one), (2, two), (3, " ".join([one, *rest])), (4, " ".join([two, *rest])), (5, " ".join([*rest[:6], one, *rest[6:]])), (6, " ".join([*rest[:6], two, *rest[6:]]))]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n for n in range(1, 7)}


def test_word_hashes_tell_words_apart():
    words = {f"{a}{'x' * n}{b}" for a in ("", "é", "\0", "ab") for b in ("", "\0", "z") for n in range(30)} - {""}
    own = sorted(words)
    assert len({int(h) for h in word_hashes(" ".join(own))}) == len(own) == len(word_hashes("\n " + "\t".join(own) + " "))
    assert (word_hashes("One  TWO") == word_hashes("one\ntwo")).all() and len(word_hashes(" \n")) == len(word_hashes(None)) == 0


def test_pairs_that_share_too_little_are_not_compared(spark, monkeypatch):
    """Each text is dense in lines of others, but two texts have one line of 36 shingles at most in common."""
    rng = random.Random(23)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    rows, columns, sums = ([line() for _ in range(7)] for _ in range(3))
    docs = [(7 * r + c, f"{rows[r]} {columns[c]} {sums[(r + c) % 7]}") for r in range(7) for c in range(7)]
    seen, kept = {}, S.stored

    def stored(df, name, **k):
        out = kept(df, name, **k)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(S, "stored", stored)
    assert S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0
    assert seen["still"] == 49 and seen["pairs"] == 0


def test_near_copies_do_not_become_all_their_pairs(spark, monkeypatch):
    """Sixty near copies of one text: what they share is found as by comparing all pairs, but no table has a row for each pair."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(260)]
    docs = [(n, " ".join(word() if rng.random() < 0.05 else x for x in base)) for n in range(60)]
    rows, kept = [], S.stored

    def stored(df, name, **k):
        out = kept(df, name, **k)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(S, "stored", stored)
    covered = {n: set() for n, _ in docs}
    for r in S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    count = dict(rows)  # the last of each name: of pairs, those of open documents
    assert count["still"] > 30 and count["pairs"] <= 2 * len(docs)
    own = {n: shingle_hashes(word_hashes(text) >> np.uint64(32), S.SIZE) for n, text in docs}
    found = 0
    for a, x in own.items():
        for b, y in own.items():
            if a != b:
                for first, last, _ in S.passages(x, y, S.LEAST_WORDS - S.SIZE + 1, S.PERCENT)[0]:
                    assert all(p in covered[a] for p in np.flatnonzero(np.isin(x[first : last + 1], y)) + first)
                    found += 1
    assert found > 1000


def test_passages_and_licences_of_rows_with_one_id(spark):
    say = lambda n: " ".join(f"w{DRAW.randint(0, 5000)}" for _ in range(n))
    one, two = say(70), say(60)
    rows = [(1, "aaa " + one), (1, "zzz " + two), (2, one), (3, two), (4, say(80)), (None, one)]
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["other"]) for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 61, 3), (1, 1, 71, 2), (2, 0, 70, 1), (3, 0, 60, 1)]
    ids = next(own for name, own in I.RULES if len(own) > 1)
    halves = [I.SENTENCES[ids[0]][0] + ".", "\n\n".join(I.SENTENCES[x][0] + "." for x in ids[1:])]
    whole = [(r["doc_id"], r["rule"]) for r in I.scan(spark.createDataFrame([(1, halves[0]), (1, halves[1]), (2, "\n\n".join(halves))], "doc_id long, text string")).collect()]
    assert (2, " ".join(ids)) in whole and (1, " ".join(ids)) not in whole


def test_control_strings_across_parts(spark):
    part = lambda text: ("text", text, None, None, None, None, None)
    rows, want = [], []
    for control in [*C.CONTROLS, "\\\\", "\\<s>"]:
        for a in range(1, len(control)):
            for b in (a, DRAW.randint(a, len(control))):
                texts = [control[:a], control[a:b], control[b:], "\\"]
                rows.append((1, len(rows), "user" if len(rows) % 2 else "assistant", [part(x) for x in texts]))
                want.append("".join(texts))
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{C.PART}>")
    out = C.format_conversations(df).select(C.read_back(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").first()
    assert [t["content"] for t in out["turns"]] == want and out["loss"] == "".join(want[::2])
    assert out["formatted"].count(C.END) == len(rows) and not any(c in out["formatted"] for c in C.CONTROLS if c not in (C.START, C.SEP, C.END))
    first = out["loss_spans"][1]
    assert out["formatted"][first["start"] - len(C.SEP) : first["start"]] == C.SEP and out["formatted"][first["start"] + first["length"] :].startswith(C.END)


def test_long_chats_take_linear_time(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id").alias("text"))
        began = time.time()
        out = C.format_conversations(rows.withColumn("parts", C.text_part(F.col("text"))))
        row = out.select(F.size(C.read_back(F.col("formatted"))).alias("n"), F.length(C.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("loss")).first()
        assert row["n"] == n and row["loss"] == sum(len(f"turn {x}") for x in range(1, n, 2))
        return time.time() - began

    seconds(1000)
    assert seconds(20_000) < 15


def test_token_cache_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(T, "CACHE_CHARS", 20_000)
    counts = T.WordCounts(T.default_model())
    lines = ["".join(DRAW.choice("語文字数目的是了") for _ in range(400)) for _ in range(30)]
    texts = ["\n".join(lines), *(" ".join(f"{a}{b}" for b in range(2000)) for a in "abcdef")]
    found = [counts.count(x) for x in texts]
    for own in (counts.spaced, counts.bare):
        assert sum(map(len, own)) == own.chars <= 20_000 and max(map(len, own), default=0) <= T.LONGEST_KEPT
    assert found == [T.WordCounts(T.default_model()).count(x) for x in texts]
