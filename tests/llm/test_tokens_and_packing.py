import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from rankloom.llm import packing as P
from rankloom.llm import token_counts as T

HARD = ["", " ", "  a  b ", "a\n b", "\n", "x</s> <s> [INST]", "x" * 300, "▁▁a", "日本語 😀 é", "a \n\n  b\tc   ", "\n  in", "end ", "   ", "x <|endoftext|> y", "it's we'll  \n", "a \tb", "\n\tb", "a\n\t\tb", "<|endoftext|>"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    return HARD + ["".join(draw.choice("ab theing \n\t▁é日12</s>.,") for _ in range(draw.randint(0, 40))) for _ in range(400)]


def test_prefix_tables_equal_the_library(texts):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=T.default_model()), T.WordCounts(T.default_model())
    for text in texts:
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert own.table(text) == want and own.count(text) == want[-1]
        for budget in (0, 1, 3, 9):
            assert own.cut(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_counts_of_a_table_with_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "word " * 5000, None), (None, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = T.count_tokens(df, budget=10).collect()
    assert len(got) == 5
    by = {(r["doc_id"], len(r["text"] or "")): r for r in got}
    assert by[(1, 0)]["n_tokens"] == 0 and by[(3, 25000)]["n_tokens"] >= 5000 and 0 < by[(3, 25000)]["budget_chars"] < 60
    assert T.count_tokens(df.limit(0)).count() == 0
    table = T.prefix_tables(df.where("doc_id IS NULL")).first()["prefix_tokens"]
    assert table[0] == 0 and len(table) == 4
    asked = T.prefix_tables(df.where("doc_id IS NULL")).select(*(T.tokens_of_prefix("prefix_tokens", F.lit(n)).alias(f"at{n}") for n in (0, 2, 99))).first()
    assert list(asked) == [table[0], table[2], table[3]]


def test_ids_equal_the_library(texts):
    from tokenizers import Tokenizer

    library, own, slow = (f(P.default_vocabulary()) for f in (Tokenizer.from_file, P.TextIds, P.TextIds))
    assert own.ranked is not None
    slow.ranked = None
    odd = ["", " ", "\n\n  a\t b", "x" * 3000, " " * 3000 + "y", "<|endoftext|> a <|endoftext|>", "I'll we've \u00a0 \u2003caf\u00e9 \u65e5\u672c 12,5 \U0001f600"]
    for text in [*texts, *odd]:
        want = array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        assert own.ids(text) == want == slow.ids(text)


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    draw = random.Random(5)
    rows = [(n, " ".join(draw.choice(["alpha", "beta", "gamma."]) for _ in range(draw.choice([0, 3, 40, 300, 900, 5000])))) for n in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    pieces = P.pack(df).collect()
    library = Tokenizer.from_file(P.default_vocabulary())
    docs, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        docs.setdefault(p["doc_id"], []).append(p)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        at = sequences.get(p["sequence_id"], 0)
        assert p["offset"] == at
        sequences[p["sequence_id"]] = at + p["length"]
    for n, text in rows:
        want = array("I", [*library.encode(text or "", add_special_tokens=False).ids, 1]).tobytes()
        assert b"".join(bytes(p["ids"]) for p in docs[n]) == want and docs[n][0]["start"] == 0
    assert all(x <= 2048 and x & (x - 1) == 0 for x in sequences.values())
    groups = {}
    for p in pieces:
        groups[p["step_group"]] = groups.get(p["step_group"], 0) + p["length"]
    assert max(groups.values()) <= P.STEP_TOKENS + 2048
    assert P.pack(df.limit(0)).count() == 0


def test_window_filling_prefers_what_fits():
    packer = P.Packer((4, 8, 16))
    for n, length in enumerate([10, 5, 3, 3, 2, 2]):
        assert packer.add(n, length) == []
    first = packer.window(2)
    assert [p[2] for p in first] == [10, 5, 1] and sum(p[2] for p in first) == 16


def test_crc_of_pieces(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = P.pack(df).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(bytes(row["ids"]))
