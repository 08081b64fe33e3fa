"""Operator 1: exact token counts at every prefix, by prefix dynamic programming.

For a BPE vocabulary with ranked pieces, a sequence of pieces is the encoding of
its text exactly if every two neighbours are the encoding of their own joint
text. So the encoding of a prefix is the encoding of a shorter prefix plus one
last piece, and that piece is the only one that stands validly beside the last
piece of the shorter prefix. `WordCounts.prefixes` fills this table from left to
right in time linear in the text; the count at a prefix is one more than the
count at the prefix that its last piece leaves.

No piece has white space after another character, and none contains a line feed,
so a text falls into words whose tables are independent. The counts of words are
kept in a bounded cache, and the table of a whole text is the running sum of its
words, opened up to single characters only for the word that a question cuts.

Cases: null and empty texts have 0 tokens; very long words cost linear time;
repeated rows are counted row by row; an empty table gives an empty table;
columns beside the text are passed through, and clashing names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, slices, table

CACHE_WORDS = 1_000_000
CACHE_CHARS = 16_000_000  # of all words kept
LONGEST_KEPT = 64  # characters of a word
SPACE = "▁"


class WordCounts:
    """Prefix tables of one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # the spellings of pieces, with their ranks: a higher score is merged first
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.rank = {piece: -score for piece, score in pieces.items()}
        self.longest = max(map(len, self.rank), default=1)
        self.cuts_lines = not any("\n" in piece for piece in pieces)
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in pieces):
            raise ValueError("a piece holds white space after another character: words are not independent")
        self.endings: dict = {}
        for piece in self.rank:
            node = self.endings
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = piece
        self.cache_words = cache_words
        self.valid: dict[tuple[str, str], bool] = {}
        self.spaced = _Counts(self, SPACE)
        self.bare = _Counts(self, "")

    def _merged(self, text: str) -> list[str]:
        """The encoding of a short text, by its definition."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.valid.get(key)
        if found is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            found = self.valid[key] = self._merged(left + right) == [left, right]
        return found

    def prefixes(self, word: str) -> list[int]:
        """Token counts of word[:0], word[:1], ..., word."""
        counts, last, endings, fits = [0], [""], self.endings, self._fits
        for end in range(1, len(word) + 1):
            node, start, chosen, begin = endings, end, "", end - 1
            while start:
                node = node.get(word[start - 1])
                if node is None:
                    break
                start -= 1
                piece = node.get("")
                if piece is not None and (not start or fits(last[start], piece)) and (start or len(piece) == 1 or self._merged(piece) == [piece]):
                    chosen, begin = piece, start
                    break
            if chosen:
                counts.append(counts[begin] + 1)
            else:  # a character outside the vocabulary: one token for each byte
                chosen = word[end - 1]
                counts.append(counts[end - 1] + len(chosen.encode("utf-8", "replace")))
            last.append(chosen)
        return counts

    def words(self, text: str) -> Iterator[tuple[str, bool]]:
        """The independent words of a text, and if a space mark stands before each."""
        lines = text.replace(SPACE, " ").split("\n") if self.cuts_lines else [text.replace(SPACE, " ")]
        for n, line in enumerate(lines):
            if n:
                yield "\n", False
            spaced = f" {line}" if not n else line
            if not spaced:
                continue
            parts = re.findall(r" +[^ ]*|[^ ]+", spaced) if "  " in spaced else None
            if parts is None:
                first, *rest = spaced.split(" ")
                if first:
                    yield first, False
                for word in rest:
                    yield word, True
            else:
                for part in parts:
                    yield (part[1:].replace(" ", SPACE), True) if part[0] == " " else (part, False)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        total, spaced, bare = 0, self.spaced, self.bare
        if not self.cuts_lines or "  " in text or "\n " in text or text[0] == " ":
            return sum((spaced if mark else bare)[word] for word, mark in self.words(text))
        lines = text.split("\n")
        total = len(lines) - 1
        for n, line in enumerate(lines):
            words = line.split(" ")
            if not n:
                total += spaced[words[0]]
            elif words[0]:
                total += bare[words[0]]
            elif len(words) > 1:
                raise AssertionError("a line that starts with a space is read elsewhere")
            del words[0]
            total += sum(map(spaced.__getitem__, words))
        for counts in (spaced, bare):
            if len(counts) > self.cache_words:
                counts.clear()
                counts.chars = 0
        return total

    def table(self, text: str | None) -> list[int]:
        """Token counts of text[:0], text[:1], ..., text."""
        out, done = [0], 0
        for n, (word, mark) in enumerate(self.words(text or "") if text else ()):
            counts = self.prefixes(SPACE + word if mark else word)
            # the mark before the first word is not a character of the text
            out.extend(done + c for c in counts[2 if mark and not n else 1 :])
            done += counts[-1]
        return out

    def cut(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens."""
        at = done = 0
        for n, (word, mark) in enumerate(self.words(text) if text else ()):
            whole = (self.spaced if mark else self.bare)[word]
            unseen = mark and not n
            if done + whole <= budget:
                done, at = done + whole, at + len(word) + mark - unseen
                continue
            counts = self.prefixes(SPACE + word if mark else word)
            fit = max(i for i, c in enumerate(counts) if done + c <= budget)
            return at + max(0, fit - unseen)
        return at


class _Counts(dict):
    def __init__(self, owner: WordCounts, before: str):
        super().__init__()
        self.owner, self.before, self.chars = owner, before, 0

    def __missing__(self, word: str) -> int:
        found = self.owner.prefixes(self.before + word)[-1]
        if len(word) <= LONGEST_KEPT:
            if self.chars + len(word) > CACHE_CHARS:
                self.clear()
                self.chars = 0
            self[word] = found
            self.chars += len(word)
        return found


def word_counts(model_path: str) -> WordCounts:
    return hold("token_counts", model_path, lambda: WordCounts(model_path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, text: str = "text", model_path: str | None = None, budget: int = 4096, out: str = "n_tokens", cut: str = "budget_chars") -> DataFrame:
    """Adds the token count of the whole text and the characters of its longest
    prefix within `budget` tokens. All other columns pass through."""
    path, kept = model_path or default_model(), df.drop(out, cut)

    def run(batches):
        counts = word_counts(path)
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            found = [counts.count(x) for x in texts]
            cuts = [len(x or "") if n <= budget else counts.cut(x, budget) for x, n in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64()), pa.array(cuts, pa.int64())], names=[*batch.schema.names, out, cut])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` long", f"`{cut}` long"])
    return kept.mapInArrow(run, schema)


def prefix_tables(df: DataFrame, text: str = "text", model_path: str | None = None, out: str = "prefix_tokens") -> DataFrame:
    """Adds the whole table: element i is the token count of the first i characters."""
    path, kept = model_path or default_model(), df.drop(out)

    def run(batches):
        counts = word_counts(path)
        for batch in slices(batches):
            tables = pa.array([counts.table(x) for x in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, tables], names=[*batch.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` array<int>"])
    return kept.mapInArrow(run, schema)


def tokens_of_prefix(table_column: str, chars):
    """From a stored table, the token count of the first `chars` characters: a question
    about a cut that encodes nothing again."""
    return F.get(table_column, F.least(chars, F.size(table_column) - 1))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return count_tokens(docs, budget=4096).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "budget_chars")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
