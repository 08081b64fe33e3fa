"""Operator 10: hierarchical multi-length packing.

Each document becomes its token ids plus an end id. Whole windows of the longest
context are cut off at once; what remains is routed to the smallest tier (context
size) that holds it. The tiers are packed one after another, the longest first: a
remainder opens a window of its tier, and the gap is filled from shorter tiers, the
largest remainder that fits, again and again, and at last a cut of the smallest one
that doesn't. So windows come out full at a power of two and
need no padding; what is left at the end of a task is cut down the tiers in the
same way. The sequences of a block are then dealt into step groups, longest first,
each into the group with the fewest tokens.

A document is tokenized and packed where it is read: no text or id moves between
tasks, and a task holds one block of documents at a time, carrying less than a few
windows over to the next. A task's output depends on its rows only, so a task that
is run again gives the same sequences.

Ids are those of the tokenizers library. Where its merges are in the order of their
ids and each token is what its own characters merge to, merging by rank gives the same
ids (two neighbours that make up a token come about as in that token alone), so the
faster encoder of tiktoken is used with the same vocabulary. This is tested once a
worker; other vocabularies and texts with an added special token go to the library.
Nothing is kept from one text to the next.

Cases: null and empty texts have one id, the end; a text of any length is cut;
repeated rows are packed row by row; an empty table gives an empty table; columns
beside the id and the text do not matter.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, slices, table

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BLOCK_TOKENS = 500_000
STEP_TOKENS = 65_536
# fixed value: how a byte-level tokenizer cuts texts
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones
    themselves, the others characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class TextIds:
    """Token ids, as little-endian 32-bit bytes, of texts by a byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.ranked = self._ranked(json.load(f))

    def _ranked(self, form: dict):
        """An encoder that merges by rank, if it gives the same ids."""
        model, byte_level, of = form["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, _byte_of()
        pre, vocab = form.get("pre_tokenizer") or {}, model.get("vocab", {})
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        known = {k: pre.get(k, True) for k in byte_level} == byte_level and form.get("normalizer") is None and model.get("type") == "BPE"
        known = known and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not known or len(vocab) != 256 + len(merges) or any(vocab.get(x + y) != 256 + n for n, (x, y) in enumerate(merges)):
            return None
        if any(set(t) - set(of) for t in vocab) or any(len(self.tokenizer.model.tokenize(t)) != 1 for t in vocab):
            return None
        import tiktoken

        ranks = {bytes(of[c] for c in token): n for token, n in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if self.ranked is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.ranked(text)).tobytes()


def text_ids(path: str) -> TextIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return hold("packing", path, lambda: TextIds(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Packer:
    """Packs pieces (document number, start, length) into full windows, tier by tier."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = sorted(tiers), max(tiers)
        # of each tier the remainders (length, document, start), sorted
        self.rest: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]
        self.tokens = 0

    def _put(self, length: int, document: int, start: int) -> None:
        insort(self.rest[bisect_left(self.tiers, length)], (length, document, start))
        self.tokens += length

    def _take(self, tier: int, at: int, length: int) -> tuple[int, int, int]:
        size, document, start = self.rest[tier].pop(at)
        self.tokens -= size
        if size > length:
            self._put(size - length, document, start + length)
        return document, start, min(size, length)

    def add(self, document: int, length: int) -> list[list[tuple[int, int, int]]]:
        """Takes a document; returns the whole windows cut off it."""
        whole = length // self.longest * self.longest
        if length > whole:
            self._put(length - whole, document, whole)
        return [[(document, start, self.longest)] for start in range(0, whole, self.longest)]

    def _filling(self, gap: int) -> tuple[int, int]:
        """The tier and place of the largest remainder that fits, else of the smallest one."""
        for tier in range(bisect_left(self.tiers, gap), -1, -1):
            at = bisect_right(self.rest[tier], (gap, float("inf"), 0)) - 1
            if at >= 0:
                return tier, at
        return next(tier for tier, own in enumerate(self.rest) if own), 0

    def window(self, tier: int) -> list[tuple[int, int, int]]:
        """A window of a tier, opened by its largest remainder, its gap filled from shorter
        tiers."""
        target = self.tiers[tier]
        if self.tokens < target:  # the end: no window of this size can be filled
            target = 1 << (self.tokens.bit_length() - 1)
        out = [self._take(tier, len(self.rest[tier]) - 1, target)]
        gap = target - out[0][2]
        while gap:
            out.append(self._take(*self._filling(gap), gap))
            gap -= out[-1][2]
        return out

    def windows(self, leave: int):
        """Windows while more than `leave` tokens remain, the longest tier first."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.rest[tier] and self.tokens > leave:
                yield self.window(tier)


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence: longest first, each into the group with the fewest tokens."""
    loads = [(0, g) for g in range(max(1, -(-sum(lengths) // step_tokens)))]
    out = [0] * len(lengths)
    for n in sorted(range(len(lengths)), key=lambda n: -lengths[n]):
        load, group = heapq.heappop(loads)
        out[n] = group
        heapq.heappush(loads, (load + lengths[n], group))
    return out


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset, tier (the length of the sequence) and step_group."""
    path, kind = vocabulary or default_vocabulary(), df.schema[key].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def run(batches):
        own = TaskContext.get().partitionId() << 33
        encoder, packer = text_ids(path), Packer(tiers)
        documents: dict[int, tuple[object, bytes]] = {}
        state = {"sequences": 0, "groups": 0, "documents": 0}

        def emit(windows):
            groups = step_groups([sum(p[2] for p in w) for w in windows], step_tokens)
            columns = [[] for _ in range(9)]
            for window, group in zip(windows, groups, strict=True):
                offset, tier = 0, sum(p[2] for p in window)
                for number, start, length in window:
                    name, ids = documents[number]
                    row = (name, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, own + state["sequences"], offset, tier, own + state["groups"] + group)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                state["sequences"] += 1
            state["groups"] += max(groups, default=-1) + 1
            kinds = [names_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        names_type, full, tokens = pa.int64(), [], 0
        for batch in slices(batches):
            names_type = batch.column(0).type
            for name, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number, ids = state["documents"] + 1, encoder.ids(text_)
                state["documents"] = number
                documents[number] = (name, ids + end)
                tokens += len(ids) // 4 + 1
                full += packer.add(number, len(ids) // 4 + 1)
            if tokens > BLOCK_TOKENS:
                yield emit(full + list(packer.windows(packer.longest * 2)))
                needed = {document for own_ in packer.rest for _, document, _ in own_}
                documents = {n: d for n, d in documents.items() if n in needed}
                full, tokens = [], 0
        full += packer.windows(0)
        if full:
            yield emit(full)

    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
