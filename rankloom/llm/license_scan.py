"""Operator 8: licence scans by sentence rules.

A text is cut into pieces at line ends and behind . ; : ! ? before white space.
Each piece is normalised: lower case, runs of anything but letters and digits
become one space. A known sentence is a run of pieces, within one paragraph, that together
are its words: it may be wrapped over lines, and hold marks that cut it. Known sentences map to
identifiers; what remains of a text is the
ordered sequence of its identifiers with their positions. A licence rule is an
ordered list of identifiers; it matches where these follow one another with at most
MAX_GAP unknown sentences between two; an unknown sentence ends at such a mark, at a blank
line or at a known one. Of rules that match at the same place
the longest is reported: the short notice of a licence is not reported again inside its
full text.

Texts are streamed and sentences looked up before anything shuffles, so that only known
sentences, which are few, are gathered by document. A text without any of the words of
which each known sentence has one is not cut.

Cases: null and empty texts have no licence and no row; a sentence that is
repeated starts a match of its own; repeated rows are merged with their document, other texts of one key are scanned apart;
an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import hold, slices, table

MAX_GAP = 1
# fixed values: sentences of public licences and notices, by identifier
SENTENCES = {
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "This file is licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-comply": ["You may not use this file except in compliance with the License", "you may not use this file except in compliance with the License"],
    "apache-obtain": ["You may obtain a copy of the License at"],
    "apache-asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache-define": ['"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document'],
    "apache-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"],
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License", "The MIT License (MIT)", "MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "bsd-notice": ["Licensed under the BSD License", "Released under the BSD 3-Clause License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-asis": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it"],
    "agpl3-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"],
    "lgpl3-body": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl2-notice": ["Licensed under the GNU General Public License, version 2"],
    "lgpl3-notice": ["Licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-notice": ["Licensed under the GNU Affero General Public License, version 3"],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "cc0-notice": ["Dedicated to the public domain under CC0 1.0", "Licensed under CC0 1.0"],
    "cc-by-4-notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "all-rights": ["All rights reserved"],
}
# fixed values: licences by ordered identifiers; a licence may have several rules
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-obtain", "apache-asis"]),
    ("Apache-2.0", ["apache-define"]),
    ("Apache-2.0", ["apache-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-keep", "asis"]),
    ("MIT", ["mit-notice", "mit-grant", "mit-keep", "asis"]),
    ("BSD-3-Clause", ["bsd-notice"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", ["isc-grant", "asis"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0", ["gpl-verbatim", "gpl3-preamble"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-2.0", ["gpl2-free", "gpl-warranty"]),
    ("GPL-2.0", ["gpl-verbatim", "gpl2-preamble"]),
    ("LGPL-3.0", ["gpl-verbatim", "lgpl3-body"]),
    ("AGPL-3.0", ["gpl-verbatim", "agpl3-preamble"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("AGPL-3.0", ["agpl3-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("LicenseRef-all-rights-reserved", ["all-rights"]),
]
CUT = r"\n+|(?<=[.;:!?])\s+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    return {normalised(s): name for name, sentences in SENTENCES.items() for s in sentences}


class Finder:
    """Finds the known sentences of texts."""

    def __init__(self):
        self.known = known_sentences()
        self.opens: dict[str, set[str]] = {}
        for sentence in self.known:
            self.opens.setdefault(sentence.split()[0], set()).add(sentence)
        uses: dict[str, int] = {}
        for sentence in self.known:
            for word in set(sentence.split()):
                uses[word] = uses.get(word, 0) + 1
        # each sentence has one of these words: long ones first, then those of many sentences
        words = {max(sentence.split(), key=lambda w: (min(len(w), 7), uses[w], w)) for sentence in self.known}
        self.hint = re.compile("|".join(sorted(words)))
        self.cut = re.compile(CUT, re.ASCII)

    def find(self, text: str | None) -> list[tuple[int, int, int, int, str]]:
        """(at, to, before, after, id): first and last piece of each known sentence, and the
        unknown sentences of the pieces before and behind it."""
        if not text or not self.hint.search(text.lower()):
            return []
        pieces, blank, marked, at = [], [], [], 0
        for gap in [*self.cut.finditer(text), None]:
            raw = text[at : gap.start() if gap else len(text)]
            pieces.append(normalised(raw))
            marked.append(raw[-1:] in tuple(".;:!?") and bool(raw))
            blank.append(gap is not None and gap.group().count("\n") > 1)
            at = gap.end() if gap else at
        spans: list[tuple[int, int, str]] = []
        for n, piece in enumerate(pieces):
            best = -1
            for sentence in self.opens.get(piece.split(" ", 1)[0], ()) if piece else ():
                end, own = n, piece
                while len(own) < len(sentence) and sentence.startswith(own + " ") and end + 1 < len(pieces) and pieces[end + 1] and not blank[end]:
                    end += 1
                    own += " " + pieces[end]
                if own == sentence and end > best:
                    best, name = end, self.known[sentence]
            # a known sentence inside a longer one is part of it
            if best >= n and (not spans or best > spans[-1][1]):
                spans.append((n, best, name))
        if not spans:
            return []
        units, unit = [], 0
        for n, piece in enumerate(pieces):
            units.append(unit)
            unit += marked[n] or blank[n] or not piece
        return [(n, end, units[n - 1] if n else -1, units[end + 1] if end + 1 < len(units) else unit, name) for n, end, name in spans]


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print, at, to, before, after, id): the known sentences of each document, by position;
    print tells rows of one key apart by their text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        finder = hold("license_scan", None, Finder)
        for batch in slices(batches):
            rows, found = [], []
            for n, value in enumerate(batch.column(2).to_pylist()):
                own = finder.find(value)
                rows += [n] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows, pa.int64())) for i in (0, 1)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", "print", "at", "to", "before", "after", "id"])

    return df.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(5)).alias("print"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, print long, at int, to int, before int, after int, id string")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match: key, license, rule (its identifiers), first and last (piece
    numbers from 0)."""
    spark = df.sparkSession
    found = sentences(df, key, text).dropDuplicates(["key", "print", "at", "id"])
    longest = max(len(ids) for _, ids in RULES)
    steps = spark.createDataFrame([(" ".join(ids), name, ids[0], ids[1:]) for name, ids in RULES], "rule string, license string, id string, tail array<string>")
    # each known sentence may open the rules that begin with it; their tails are the next known sentences
    order = Window.partitionBy("key", "print").orderBy("at")
    follow = [F.struct(*(F.lead(x, n).over(order).alias(x) for x in ("id", "at", "to", "before", "after"))) for n in range(1, longest)]
    opened = found.withColumn("next", F.array(*follow)).join(F.broadcast(steps), "id")
    last = lambda n, x: F.when(n == 0, F.col(x)).otherwise(F.get("next", n - 1)[x])
    gap = lambda n: F.when(F.get("next", n)["at"] > last(n, "to") + 1, F.get("next", n)["before"] - last(n, "after") + 1).otherwise(0)
    fits = F.forall(F.transform("tail", lambda t, n: (F.get("next", n)["id"] == t) & (F.get("next", n)["at"] > last(n, "to")) & (gap(n) <= MAX_GAP)), lambda x: F.coalesce(x, F.lit(False)))
    matched = opened.where(fits).select("key", "print", "license", "rule", F.col("at").alias("first"), F.when(F.size("tail") == 0, F.col("to")).otherwise(F.get("next", F.size("tail") - 1)["to"]).alias("last"))
    # a match inside a longer one that began no later is part of it
    reach = Window.partitionBy("key", "print").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    kept = matched.withColumn("reach", F.max("last").over(reach)).where("reach IS NULL OR last > reach")
    return kept.select(F.col("key").alias(key), "license", "rule", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sorted(known_sentences().items()))
    rules = ", ".join(f"({quote(' '.join(ids))}, {quote(name)}, [{', '.join(map(quote, ids))}])" for name, ids in RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(rule, license, ids) AS (VALUES {rules}),
marked AS (SELECT doc_id, string_split(regexp_replace(text, '(\\n+|([.;:!?])\\s+)', '\\2' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM marked),
found AS (SELECT DISTINCT doc_id, pos, id FROM parts JOIN known ON trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) = sentence),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM found),
steps AS (SELECT rule, license, len(ids) AS size, unnest(ids) AS id, unnest(range(len(ids))) AS k FROM rules),
placed AS (SELECT doc_id, rule, license, size, n - k AS opens, k, pos, lag(pos) OVER (PARTITION BY doc_id, rule, n - k ORDER BY k) AS before FROM numbered JOIN steps USING (id)),
matched AS (SELECT doc_id, rule, license, min(pos) AS "first", max(pos) AS "last" FROM placed GROUP BY doc_id, rule, license, size, opens HAVING count(*) = size AND count(*) FILTER (k > 0 AND pos - before > {MAX_GAP + 1}) = 0),
reached AS (SELECT *, max("last") OVER (PARTITION BY doc_id ORDER BY "first", "last" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM matched)
SELECT doc_id, license, rule, "first", "last" FROM reached WHERE reach IS NULL OR "last" > reach"""


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES = {"op8_license_scan": _oracle()}
