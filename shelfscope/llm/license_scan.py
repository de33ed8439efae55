"""Licence scan: texts against licence templates by Dice coefficient over word bigrams.

The units of a text are its lines and, where it has several, the whole text. Text is
normalised to lower-case words of ASCII letters, digits and non-ASCII characters. For a
unit with ``a`` distinct bigrams and a template with ``b``, Dice is ``2 * common / (a + b)``,
so only templates with ``t / (2 - t) <= a / b <= (2 - t) / t`` can reach the threshold ``t``:
those size bounds prune the templates before any set is compared, and a unit without
a single template bigram isn't looked at.

Every whole text is scanned in Arrow batches where it lies, without a shuffle; the
templates are a parameter (a few notices by default) and travel with the task.

Defined results: null and empty texts, and units of fewer than two words, match
nothing; ties go to the greater licence coefficient, then the smaller name; repeated rows
and ids are scanned row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm.common import WordHashes, batches_of, doc_bytes, gram_hashes, rows_of, small_batches, table
from shelfscope.llm.decontamination import words_of

THRESHOLD = 0.8
#: Short public notices by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Scanner:
    """Templates ready to be compared."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.hashes = WordHashes()
        self.templates = [(name, bigrams(words_of(text.encode()))) for name, text in templates]
        self.templates = [(name, b) for name, b in self.templates if b]
        self.grams = np.unique(np.concatenate([gram_hashes(self.hashes.of(words_of(t.encode())), 2) for _, t in templates]))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.grams & np.uint64(0xFFFF)).astype(np.int64)] = True

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        """The greatest coefficient that reaches the threshold, and its licence."""
        own, found, t = bigrams(words), None, self.threshold
        for name, b in self.templates:
            if t * len(b) <= (2 - t) * len(own) + 1e-9 and t * len(own) <= (2 - t) * len(b) + 1e-9:
                dice = 2.0 * len(own & b) / (len(own) + len(b))
                if dice >= t and (found is None or (-dice, name) < (-found[0], found[1])):
                    found = dice, name
        return found

    def scan(self, text: bytes) -> tuple[int, list[tuple[float, str]]]:
        """The number of units with a match, and each one's best licence."""
        lines = [w for x in text.split(b"\n") if len(w := words_of(x)) > 1]
        units = [*lines, words_of(text)] if len(text.split(b"\n")) > 1 else lines
        out = []
        for words in units:
            g = gram_hashes(self.hashes.of(words), 2)
            if self.bits[(g & np.uint64(0xFFFF)).astype(np.int64)].any() and (m := self.best(words)):
                out.append(m)
        return len(out), out


def licences(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches (units), best_licence, best_dice, licences (sorted, comma-joined)."""
    def scan(batches):
        scanner = Scanner(templates, threshold)

        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                n, found = scanner.scan(text)
                top = min(found, key=lambda m: (-m[0], m[1]), default=(None, None))
                yield doc_id, n, top[1], top[0], ",".join(sorted({m[1] for m in found}))

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("n_matches", pa.int64()), ("best_licence", pa.string()),
                                                 ("best_dice", pa.float64()), ("licences", pa.string())]))

    return doc_bytes(docs).mapInArrow(
        scan, "doc_id long, n_matches long, best_licence string, best_dice double, licences string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every document."""
    small_batches(spark)
    return licences(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH templates AS (
  SELECT row_number() OVER () AS t, name, {_WORDS.format("txt")} AS w
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(x)})" for n, x in TEMPLATES)}) AS v(name, txt)),
template_grams AS (
  SELECT DISTINCT t, name, w[i] || ' ' || w[i + 1] AS g FROM (SELECT t, name, w, unnest(range(1, len(w))) AS i FROM templates)),
template_sizes AS (SELECT t, name, count(*) AS b FROM template_grams GROUP BY t, name),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, u, {_WORDS.format("unit")} AS w FROM (
    SELECT r, generate_subscripts(parts, 1) AS u, unnest(parts) AS unit FROM (
      SELECT r, CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text)
                     ELSE [text] END AS parts FROM docs))),
unit_grams AS (
  SELECT DISTINCT r, u, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, u, w, unnest(range(1, len(w))) AS i FROM units WHERE len(w) > 1)),
unit_sizes AS (SELECT r, u, count(*) AS a FROM unit_grams GROUP BY r, u),
matches AS (
  SELECT r, u, name, 2.0::DOUBLE * common / (a + b) AS dice
  FROM (SELECT r, u, t, count(*) AS common FROM unit_grams JOIN template_grams USING (g) GROUP BY r, u, t)
  JOIN unit_sizes USING (r, u) JOIN template_sizes USING (t)
  WHERE 2.0::DOUBLE * common / (a + b) >= {THRESHOLD}::DOUBLE),
best AS (SELECT r, u, name, dice FROM matches QUALIFY row_number() OVER (PARTITION BY r, u ORDER BY dice DESC, name) = 1),
by_doc AS (
  SELECT r, count(*) AS n_matches, arg_min(name, {{'d': -dice, 'n': name}}) AS best_licence, max(dice) AS best_dice,
         string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM best GROUP BY r)
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, best_licence, best_dice, coalesce(licences, '') AS licences
FROM docs LEFT JOIN by_doc USING (r)
"""
