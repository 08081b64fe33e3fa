import re
from array import array

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from rankloom.llm.packing import default_vocabulary


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.select((F.col("doc_id") + 100000).alias("doc_id"), F.lit("12 34").alias("text"), "lang", "source", "n_chars").limit(3)
    rows, left = docs.unionByName(empty), []
    for name, stage in P.STAGES[:-1]:
        rows = P.stored(stage(spark, rows, sf_dir), name)
        assert rows.columns == P.COLUMNS
        left.append(rows.count())
    assert left[0] == docs.count() and left == sorted(left, reverse=True) and left[-1] > 0.5 * left[0]
    texts = [r["text"].encode().lower() for r in rows.select("text").collect()]
    assert len(texts) == len(set(texts))
    pieces = P.packed(spark, rows, sf_dir)
    assert pieces.select("doc_id").distinct().count() == left[-1]


def _lower(text):
    return (text or "").encode().lower()


def test_run_equals_a_plain_version(spark, sf_dir):
    """All stages but the first, whose model is taken as it is, by brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [r.asDict() for r in P.known_language(spark, docs, sf_dir).collect()]
    last = {}
    for r in sorted(left, key=lambda r: r["doc_id"]):
        last[_lower(r["text"])] = r
    left = sorted(last.values(), key=lambda r: r["doc_id"])
    sets = []
    for r in left:
        words = _lower(r["text"]).split()
        sets.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    left = [r for n, r in enumerate(left) if group[n] == n]
    cut = lambda text: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = cut(r["text"])
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}
    clean = lambda words: not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))
    left = [r for r in left if clean(cut(r["text"]))]
    library = Tokenizer.from_file(default_vocabulary())
    want = {r["doc_id"]: array("I", [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]).tobytes() for r in left}
    got, filled = {}, {}
    for r in sorted(P.run(spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] * 4 == len(got.get(r["doc_id"], b""))
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert got == want and all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


def test_rows_that_share_an_id_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 80").first()["text"]
    plain = " ".join(f"word{n}" for n in range(80))
    rows = [(7, "unlike " + plain[::-1], "en", "x", 1), (7, plain, "en", "x", 1), (3, plain + " more", "en", "x", 1), (7, leak, "en", "x", 1), (None, "a text without an id", "en", "x", 1)]
    made = spark.createDataFrame(rows, docs.schema)
    near = P.near_copies(spark, made, sf_dir)
    assert sorted(r["text"] for r in near.collect()) == sorted(rows[n][1] for n in (0, 2, 3, 4))
    assert sorted(r["text"] for r in P.without_benchmark(spark, made, sf_dir).collect()) == sorted(rows[n][1] for n in (0, 1, 2, 4))
    for name, stage in P.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == P.COLUMNS)


def test_run_leaves_the_last_documents_only(spark, sf_dir):
    """What earlier stages and their operators stored is gone; what the last stage reads is there."""
    import os

    from rankloom.sources.files import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    pieces = P.run(spark, sf_dir)
    left = [x for x in set(os.listdir(shared_dir(spark))) - before if not x.startswith("rdd")]
    assert len([x for x in left if x.startswith(P.STAGES[-2][0])]) == 1
    assert not [x for x in left if x.startswith(tuple(name for name, _ in P.STAGES[:-2]))]
    assert len(left) <= 1 and pieces.count() > 0
