"""Turn repair, SimHash components and fill-in-middle against brute force."""

import itertools
import random
import re
import time
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom import llm
from rankloom.llm import fill_middle as M
from rankloom.llm import simhash as H
from rankloom.llm import turn_repair as R

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


def repaired_by_hand(rows):
    """Every sequence of edits, with up to two inserts in each gap: (cost, audit), turns."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    gaps = [()] + [(("I", 3, (r, "")),) for r in ("user", "assistant")] + [tuple(("I", 3, (r, "")) for r in rs) for rs in itertools.product(("user", "assistant"), repeat=2)]
    choices = [gaps]
    for (role, text), fault in zip(rows, faults, strict=True):
        more = 3 if fault == "truncated" else 0
        own = [(("D", 4, None),)]
        if fault not in ("blank", "duplicate"):
            own += [(("K", more, (role, text)),), *((("R", 3 + more, (r, text)),) for r in ("user", "assistant"))]
        choices += [own, gaps]
    best = None
    for picked in itertools.product(*choices):
        edits = [e for part in picked for e in part]
        left = [e[2] for e in edits if e[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left)):
            found = (sum(e[1] for e in edits), "".join(e[0] for e in edits), left)
            best = min(best or found, found, key=lambda x: x[:2])
    return best, faults


def test_cheapest_repairs(spark):
    draw = random.Random(31)
    rows, want = [], {}
    for n in range(60):
        own = [(draw.choice(["system", "user", "assistant", "assistant", "user", "tool", " "]), draw.choice(["Yes.", "No!", "cut", " ", f"own {draw.random()}?"])) for _ in range(draw.randint(1, 3))]
        rows += [(n, k, *turn) for k, turn in enumerate(own)]
        want[n] = repaired_by_hand(own)
    got = {r["conv_id"]: r for r in R.repair(spark.createDataFrame(rows, TURNS)).collect()}
    for n, ((cost, audit, left), faults) in want.items():
        assert (got[n]["cost"], got[n]["audit"], [tuple(t) for t in got[n]["turns"]]) == (cost, audit, left)
        assert [got[n][x] for x in ("blank", "duplicate", "truncated")] == [faults.count(x) for x in ("blank", "duplicate", "truncated")]


def test_odd_conversations(spark):
    rows = [(1, None, "user", "Late?"), (1, 5, "user", "Hi."), (1, 5, "assistant", "Yo."), (1, 9, None, "Odd."), (2, 0, "user", None), (None, 0, "user", "A."), (None, 1, "assistant", "B."), (3, None, "user", ""), (3, None, "user", "")]
    own = spark.createDataFrame(rows, TURNS).withColumns({x: F.lit("x") for x in ("id", "at", "fault", "ms", "best", "cost", "pair", "initial")})
    got = {r["conv_id"]: r for r in R.repair(own).collect()}
    assert (got[1]["gaps"], got[1]["illegal"], got[1]["cost"], got[1]["audit"]) == (3, 1, 3, "KKKR")
    assert (got[2]["blank"], got[2]["audit"], got[2]["turns"]) == (1, "D", [])
    assert (got[None]["cost"], got[None]["audit"]) == (0, "KK")
    assert (got[3]["gaps"], got[3]["blank"], got[3]["cost"]) == (0, 2, 8)
    assert R.repair(own.limit(0)).count() == 0


def test_long_conversation(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id", F.when(F.col("id") % 7 == 0, "").otherwise(".")).alias("text"))
        began = time.time()
        row = R.repair(rows).select("cost", "truncated", F.size("turns").alias("left")).first()
        assert (row["left"], row["cost"]) == (n, 3 * row["truncated"])
        return time.time() - began

    seconds(500)
    assert seconds(10_000) < 20


def test_everything_dropped(spark, sf_dir):
    got = llm.queries()["op11_turn_repair"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()


def simhash_by_hand(text):
    words = (text or "").encode().lower().split()
    votes = [0] * 64
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def components_by_hand(prints, radius):
    root = {n: n for n in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(prints), 2):
        if (prints[x] ^ prints[y]).bit_count() <= radius:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in prints}


def test_simhash_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {n: simhash_by_hand(t) for n, t in texts.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in llm.queries()["op12_simhash"](spark, sf_dir).collect()}
    linked = components_by_hand(prints, 4)
    assert got == {n: (f"{p:016x}", linked[n]) for n, p in prints.items()}


@pytest.mark.parametrize(("tile", "block"), [(16_384, 512), (7, 3)])
def test_components_of_fingerprints(spark, monkeypatch, tile, block):
    """Chains, dense groups and outsiders, over one tile a count or many."""
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "BLOCK", block)
    draw, prints = random.Random(5), [0, (1 << 64) - 1]
    for _ in range(12):
        own = draw.getrandbits(64)
        for _ in range(12):
            prints.append(own)
            for bit in draw.sample(range(64), draw.choice([1, 2, 4, 5, 9])):
                own ^= 1 << bit
    base = draw.getrandbits(64)
    prints += [base ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(14), 2)]
    rows = dict(enumerate(prints))
    monkeypatch.setattr(H, "fingerprints", lambda docs, key, text, size: docs.select(F.col(key).alias("key"), F.col(text).cast("long").alias("fp")))
    docs = spark.createDataFrame([(n, str(int(np.uint64(p).view(np.int64)))) for n, p in rows.items()], DOCS)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.near_duplicates(docs).collect()}
    linked = components_by_hand(rows, 4)
    assert got == {n: (f"{p:016x}", linked[n]) for n, p in rows.items()}


def test_odd_rows_of_simhash(spark):
    long = " ".join(f"w{n % 977}" for n in range(80_000))
    rows = [(5, None), (4, ""), (3, " \n"), (2, "two words"), (1, "Two  Words"), (1, "two words"), (None, "two\twords"), (9, long), (8, long + " end"), (None, "nobody else says so")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({x: F.lit("x") for x in ("key", "fp", "n", "count", "tile", "label", "first", "c", "component_id")})
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in H.near_duplicates(docs).collect())
    two, alone = f"{simhash_by_hand('two words'):016x}", f"{simhash_by_hand('nobody else says so'):016x}"
    zero = "0" * 16
    assert got == sorted([(5, zero, 3), (4, zero, 3), (3, zero, 3), (2, two, 1), (1, two, 1), (1, two, 1), (0, two, 1), (9, f"{simhash_by_hand(long):016x}", 8), (8, f"{simhash_by_hand(long + ' end'):016x}", 8), (0, alone, 0)])
    assert H.near_duplicates(docs.limit(0)).count() == 0


def test_heavy_fingerprints_are_told_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"text number {n // 9} of some length") for n in range(200)], DOCS)
    rows = lambda: sorted(map(tuple, H.near_duplicates(docs).collect()))
    before = rows()
    monkeypatch.setattr(H, "HEAVY", 10)
    assert rows() == before


def test_unit_ends():
    assert list(M.unit_ends("a\né👍\r\n")) == [1, 2, 3, 4, 5, 6]
    assert list(M.unit_ends("é\r\nx", "grapheme")) == [2, 4, 5]
    for text in ("  two words \n", "one", " \n", "", "a b"):
        assert list(M.unit_ends(text, "word"))[-1:] == ([len(text)] if text else [])


@pytest.mark.parametrize("unit", sorted(M.UNITS))
def test_texts_are_rebuilt(spark, unit):
    draw = random.Random(41)
    pieces = ["<", "P", "S", "M", ">", "<<", "a", "é", "👍", "é", " ", "\n", "\\", "\0", "<P"]
    rows = [(n, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 30)))) for n in range(400)] + [(1, None), (None, "no key"), (None, None), (7, "x" * 300_000), (8, "has <M> inside"), (8, "has <M> inside"), (1 << 62, "large id, " * 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({x: F.lit("x") for x in ("n", "form", "output", "__cut", "prefix_chars")})
    out = M.fill_in_middle(docs, unit=unit)
    got = out.withColumn("back", M.restored("output", "form")).withColumn("d", M.digests("output", "form")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["back"]) for r in got), key=key) == sorted(((n, t or "") for n, t in rows), key=key)
    for r in got:
        marked = any(x in r["back"] for x in ("<P>", "<S>", "<M>"))
        assert not (marked or not r["back"]) or r["form"] == "plain"
        assert r["d"]["restored_sha256"] == sha256(r["back"].encode()).hexdigest() and r["d"]["output_sha256"] == sha256(r["output"].encode()).hexdigest()
        if r["form"] != "plain":
            assert len(r["output"]) == len(r["back"]) + 9 and r["output"].endswith(("<M>" + r["back"][r["prefix_chars"] :][: r["middle_chars"]]))
    forms = [r["form"] for r in got]
    assert forms.count("psm") > forms.count("spm") > 20
    assert M.fill_in_middle(docs.limit(0)).count() == 0
