"""The registered queries on the smallest tables, against SQL or brute force."""

import zlib
from array import array

import duckdb
import numpy as np
import pytest

from rankloom import llm


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted(want.fetchall())
    assert sorted(tuple(r) for r in llm.queries()[name](spark, sf_dir).select(*columns).collect()) == rows


def test_token_counts(spark, sf_dir, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in llm.queries()["op1_token_counts"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for n, text in texts.items():
        assert got[n]["n_tokens"] == len(library.encode(text or "")) and got[n]["n_bytes"] == len((text or "").encode())
        assert got[n]["over_limit"] == (got[n]["n_tokens"] > 4096)


def test_repeated_passages_cover_equal_ones(spark, sf_dir, texts):
    words, places, marked = {n: (t or "").encode().lower().split() for n, t in texts.items()}, {}, {}
    for n, own in words.items():
        for i in range(len(own) - 49):
            places.setdefault(tuple(own[i : i + 50]), set()).add(n)
    for r in llm.queries()["op2_substring_dedup"](spark, sf_dir).collect():
        marked.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["similarity"] >= 0.8 and r["other_doc_id"] != r["doc_id"]
    for n, own in words.items():
        for i in range(len(own) - 49):
            if len(places[tuple(own[i : i + 50])]) > 1:
                assert marked[n].issuperset(range(i, i + 50))


def test_ngram_join(spark, sf_dir, texts):
    sets = {}
    for n, text in texts.items():
        own = (text or "").encode().lower().split()
        sets[n] = {tuple(own[i : i + 4]) for i in range(max(1, len(own) - 3))} if own else set()
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in llm.queries()["op6_ngram_join"](spark, sf_dir).collect()}
    assert got == {n: (len(s), find(n)) for n, s in sets.items()}


def test_language_id(spark, sf_dir):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    got = llm.queries()["op7_language_id"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.95


def test_sharding(spark, sf_dir, texts):
    got = llm.queries()["op9_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    sums = np.zeros(16)
    for r in got:
        own = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(own) + 1 and r["text_crc32"] == zlib.crc32(own) and r["law"] == "bytes"
        sums[r["shard"]] += r["size"]
    assert sums.max() <= 1.1 * sums.mean()
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_packing(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in llm.queries()["op10_packing"](spark, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for n, text in texts.items():
        ids, at = array("I", [*library.encode(text or "", add_special_tokens=False).ids, 1]), 0
        for r in sorted(pieces[n], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
