"""Operator 13: fill-in-middle transformation in Arrow-batched pandas UDFs.

A text is cut at unit borders into prefix, middle and suffix. `finditer` of the regex
library walks over the units (code points, grapheme clusters or words with what follows
them) and their end offsets go into a compact array of four bytes each; two lookups in it
give both cuts. The draws are unsigned integers from the digest of the seed and the key, so
that a document is cut alike wherever and whenever it is processed. Output is the text itself
(plain), or the three parts behind markers in the order prefix, suffix, middle (psm)
or suffix, prefix, middle (spm). No marker can arise across the border of a part, as a
marker begins with the only `<` in it, so the text is rebuilt exactly from output and form.

Rows are independent: one narrow stage, no shuffle; a task holds one Arrow batch, and writes
it slice by slice.

Cases: a null text is empty; an empty text, and one that holds a marker, is plain; a null key
is the empty string in the digest; repeated rows are cut alike; an empty table gives an empty
table; other columns do not matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = {"code_point": r"(?s:.)", "grapheme": r"\X", "word": r"(?s:\s*\S+(?:\s+\Z)?|\s+\Z)"}
CHANGED, REVERSED = 90, 20  # percent of the texts, and of the changed ones
SEED = 1
ROWS = 500  # at most so many outputs are held at once
FORM = "n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "output_sha256 string, restored_sha256 string"

_end = methodcaller("end")


def unit_ends(text: str, unit: str = "code_point") -> array:
    """Where each unit of a text ends, as code point offsets."""
    return array("I", map(_end, regex.finditer(UNITS[unit], text)))


def draws(seed: int, key: str) -> list[int]:
    """Four numbers below 2 ** 32 from a seed and a key."""
    digest = sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12)]


def cut(key: str, text: str, seed: int = SEED, changed: int = CHANGED, reversed_: int = REVERSED, unit: str = "code_point") -> tuple:
    """n (units), form, code points of the prefix and of the middle, output."""
    ends = unit_ends(text, unit)
    n, (h1, h2, h3, h4) = len(ends), draws(seed, key)
    if not text or h3 % 100 >= changed or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (x and ends[x - 1] for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < reversed_:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that an output of a form was made of."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, _, rest = output[3:].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def _sliced(batches) -> Iterator[tuple]:
    for series in batches:
        for at in range(0, len(series[0]), ROWS):
            yield tuple(x.iloc[at : at + ROWS] for x in series)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, changed: int = CHANGED, reversed_: int = REVERSED, unit: str = "code_point") -> DataFrame:
    """One row per document: key, n (units), form, prefix_chars and middle_chars (code points), output."""

    @F.pandas_udf(FORM)
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in _sliced(batches):
            rows = [cut(k, t, seed, changed, reversed_, unit) for k, t in zip(keys, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    empty = F.lit("")
    own = docs.select(F.col(key).alias("__key"), cuts(F.coalesce(F.col(key).cast("string"), empty), F.coalesce(F.col(text), empty)).alias("__cut"))
    return own.select(F.col("__key").alias(key), "__cut.*")


def restored(output: str, form: str) -> Column:
    """The texts, from output and form."""

    @F.pandas_udf("string")
    def rebuild(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in _sliced(batches):
            yield pd.Series([rebuilt(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return rebuild(output, form)


def digests(output: str, form: str) -> Column:
    """The digests of an output and of the text rebuilt from it."""
    name = lambda x: sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf(DIGESTS)
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in _sliced(batches):
            yield pd.DataFrame({"output_sha256": [name(o) for o in outputs], "restored_sha256": [name(rebuilt(o, f)) for o, f in zip(outputs, forms, strict=True)]}, dtype=object)

    return digest(output, form)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.withColumn("d", digests("output", "form")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.output_sha256", "d.restored_sha256")


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {
    "op13_fill_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS h FROM h),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
}
