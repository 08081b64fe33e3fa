import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import decontaminate as D
from rankloom.llm import exact_dedup as X
from rankloom.llm import ngram_join as N
from rankloom.llm import substring_dedup as S
from rankloom.llm.components import components
from rankloom.llm.shingles import shingle_hashes, shingle_set, word_hashes

DOCS = "doc_id long, text string, lang string"


def test_exact_dedup_against_groups(spark):
    draw = random.Random(1)
    rows = [(n, draw.choice(["Same Text", "same text", "SAME TEXT", "", None, f"own {n}", "É", "é"]), "x") for n in range(300)] + [(900, "same text", "x"), (900, "same text", "x")]
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(0)).withColumn("fingerprint", F.lit(0))
    groups = {}
    for n, text, _ in rows:
        groups.setdefault((text or "").encode().lower(), []).append(n)
    got = X.classes(df).collect()
    assert len(got) == len(rows)
    want = {n: (max(ids), len(ids)) for ids in groups.values() for n in ids}
    assert all((r["keep_id"], r["group_size"]) == want[r["doc_id"]] for r in got)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = X.deduplicate(df.withColumn("maybe", F.lit("own")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(ids) for ids in groups.values())
    assert set(kept.columns) == {*df.columns, "maybe"} and {r["maybe"] for r in kept.collect()} == {"own"}
    assert X.classes(df.limit(0)).count() == 0


def test_unique_rows_do_not_reach_the_groups(spark):
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    bits = 1 << 15
    maybe = X.maybe_repeated(df, X.repeated_cells(df, bits), bits).where("maybe").count()
    assert maybe < 100


def windows_by_hand(doc, items):
    words = [w for w in D_WORDS(doc)]
    hit, found = set(), set()
    for name, text in items:
        own = D_WORDS(text)
        cuts = [own[i : i + 10] for i in range(max(1, len(own) - 9))] if own else []
        for cut in cuts:
            for i in range(len(words) - len(cut) + 1):
                if words[i : i + len(cut)] == cut:
                    hit.update(range(i, i + len(cut)))
                    found.add(name)
    return len(words), len(hit), sorted(found)


def D_WORDS(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_by_hand(spark, short):
    draw = random.Random(2)
    say = lambda n: " ".join(draw.choice(["a", "b", "é", "Cc"]) + draw.choice("xyz12") for _ in range(n))
    items = [(str(n), say(draw.choice([10, 12, 25]))) for n in range(12)] + [("same", None), ("empty", " .. ")] + ([("one", "ax b1"), ("two", "cc1")] if short else [])
    items.append(("again", items[0][1]))
    rows = [(n, f"{say(draw.choice([0, 3, 9]))}, {items[draw.randrange(12)][1]}! {say(5)}" if n % 2 else say(40), "x") for n in range(60)] + [(99, None, "x"), (98, "", "x"), (97, items[1][1] * 3, "x")]
    got = {r["doc_id"]: r for r in D.hits(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(got) == len(rows)
    for n, text, _ in rows:
        assert (got[n]["n_words"], len(got[n]["hit_words"]), got[n]["items"]) == windows_by_hand(text, items)
    clean = {r["doc_id"] for r in D.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert clean == {n for n, r in got.items() if not r["hit_words"]}


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "x")], DOCS), spark.createDataFrame([], "item_id string, text string")
    assert D.hits(docs, items).first()["n_words"] == 2
    assert D.hits(docs.limit(0), items).count() == 0


def test_components(spark):
    draw = random.Random(4)
    edges = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(1, 60)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def near_copies():
    draw, rows = random.Random(6), []
    say = lambda n: [draw.choice("abcdefghij") + str(draw.randint(0, 400)) for _ in range(n)]
    for length, copies in ((6, 15), (9, 15), (14, 20), (40, 40), (150, 40)):
        base = say(length)
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 5]) if length > 20 else draw.choice([0, 1])):
                at = draw.randrange(len(words))
                words[at : at + draw.choice([0, 1])] = say(draw.choice([0, 1]))
            rows.append((len(rows), " ".join(words), "x"))
    return [*rows, (900, None, "x"), (901, "", "x"), (902, "  \n", "x"), (903, "two words", "x"), (904, "Two Words", "x"), (905, rows[0][1], "x"), (905, rows[0][1], "x")]


@pytest.mark.parametrize("percent", [85, 60])
def test_ngram_join_is_exact(spark, percent):
    rows = near_copies()
    sets = {n: shingle_set(t, 4) for n, t, _ in rows}
    parent = {n: n for n in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            common = len(np.intersect1d(sets[x], sets[y]))
            if common and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    got = N.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("n", F.lit(1)), percent=percent).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == root(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)


def test_ngram_join_of_rows_that_share_an_id(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [(1, " ".join(base), "x"), (2, " ".join(base + ["end"]), "x"), (2, "something else that has no link at all", "x"), (None, " ".join(base), "x"), (None, "alone and without an id", "x")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 2, 0), (0, 23, 1), (1, 23, 1), (2, 5, 2), (2, 24, 1)]


def test_ngram_join_of_an_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_signatures_meet_for_every_similar_pair():
    draw, bands = np.random.default_rng(8), N.Bands(85)
    for n in [2, 5, 6, 7, 8, 9, 12, 13, 20, 47, 90, 200]:
        for _ in range(30):
            a = draw.integers(0, 1 << 63, n).astype(np.uint64)
            most = bands.differences(int(np.searchsorted(bands.tops, n))) + 2
            k = int(draw.integers(0, most + 1))
            b = np.unique(np.concatenate([a[k // 2 :], draw.integers(0, 1 << 63, k - k // 2).astype(np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= 85 * (len(a) + len(b) - common):
                assert len(np.intersect1d(N.signatures(a, bands), N.signatures(b, bands)))


def test_compact_windows_cover_every_passage():
    draw = np.random.default_rng(9)
    for n in (5, 12, 40):
        hashes = draw.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(1)
        found = list(zip(*(x.tolist() for x in S.compact_windows(hashes, 5)), strict=True))
        for low in range(n):
            for high in range(low + 4, n):
                c = low + int(np.argmin(hashes[low : high + 1] >> np.uint64(max(1, n.bit_length()))))
                assert sum(x == c and left <= low and high <= right for x, left, right in found) == 1


def test_repeated_passages(spark):
    draw = random.Random(11)
    say = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    passage, other = say(60), say(80)
    changed = list(other)
    changed[40] = "new"
    rows = [(1, say(100) + passage + say(50)), (2, passage + say(90)), (3, say(200)), (4, say(30) + other), (5, changed + say(40)), (6, say(49)), (7, None), (8, ""), (9, passage[:40] + say(60))]
    rows = [(n, " ".join(t) if t else t, "x") for n, t in rows]
    same = " ".join(say(55))
    rows += [(20, same, "x"), (21, same, "x"), (22, same.upper(), "x")]
    got = {}
    for r in S.repeated_passages(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["other"], r["similarity"]))
    assert set(got) == {1, 2, 4, 5, 20, 21, 22}
    assert got[1] == [(100, 160, 2, 1.0)] and got[2] == [(0, 60, 1, 1.0)]
    assert got[4][0][:3] == (30, 110, 5) and got[5][0][0] == 0 and 0.8 <= got[5][0][3] < 1
    assert all(got[n][0][:2] == (0, 55) for n in (20, 21, 22))
    assert S.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_passages_around_a_frequent_line(spark):
    draw = random.Random(17)
    say = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    rows, want = [], {}
    for n in range(0, 300, 10):
        line = say(40)
        passage = say(10) + line + say(10)
        rows += [(n + k, say(30) + line + say(30)) for k in (0, 1, 8, 9)] + [(n + k, say(k) + passage + say(60)) for k in (4, 5)]
        want |= {n + k: [(k, k + 60, n + 9 - k, 1.0)] for k in (4, 5)}
    got = {}
    for r in S.repeated_passages(spark.createDataFrame([(n, " ".join(t), "x") for n, t in rows], DOCS)).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["other"], r["similarity"]))
    assert got == want


def test_equal_passage_of_a_document_with_copies(spark):
    """The copies cover one another; a third document shares a passage with them, among others
    that share a line of it."""
    draw = random.Random(29)
    say = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    rows, want = [], {}
    for n in range(0, 200, 10):
        line = say(40)
        whole = say(40) + say(10) + line + say(10) + say(40)
        rows += [(n + k, whole) for k in (0, 1, 2)] + [(n + k, say(30) + line + say(30)) for k in (3, 4, 6, 7)] + [(n + 5, say(20) + whole[40:100] + say(20))]
        want[n + 5] = (20, 80)
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in S.repeated_passages(spark.createDataFrame([(n, " ".join(t), "x") for n, t in rows], DOCS)).collect()}
    assert {n: got.get(n) for n in want} == want


def test_passage_verification_is_symmetric():
    words = word_hashes(" ".join(f"w{n}" for n in range(100)))
    a, b = shingle_hashes(words, 5), shingle_hashes(words[20:90], 5)
    left, right = S.passages(a, b, 46, 80)
    assert left[0] == (20, 85, 1.0) and right[0] == (0, 65, 1.0) and S.passages(b, a, 46, 80) == (right, left)
