"""Licence recognition by sentences, in DataFrame functions alone.

A text is cut into sentences, which are normalised and looked up among known
licence sentences.  Each known sentence has one letter, so a text becomes a
string of letters, and the ordered licence rules (sequences of sentences) are
matched on it from left to right, the first rule that fits at a place winning.

Texts are read twice: line by line, and with lines joined, so that a notice is
found whether it was wrapped or not.

The cut also parts a notice at a colon, at a semicolon, after "v." and, with
lines joined, at the "//" of an address; sentences are stored as the cut leaves
them.  A copyright line right above a notice takes in the notice's first
sentence when lines are joined; the rules named "headless" go without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts, in their normalised form.
SENTENCES = {
    "apache-line": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-grant-use": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-copy-url": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-copy-http": "you may obtain a copy of the license at http",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-title": "mit license",
    "the-mit-title": "the mit license",
    "mit-line": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-line": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-program": "this program is free software",
    "gpl-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-merchant": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd": "licensed under cc by nc nd 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-terms-v": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-version": "2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx-tag": "spdx license identifier",
    "spdx-apache": "apache 2 0",
    "spdx-mit": "mit",
    "spdx-bsd-2": "bsd 2 clause",
    "spdx-bsd-3": "bsd 3 clause",
    "spdx-gpl-3": "gpl 3 0 or later",
    "spdx-mpl": "mpl 2 0",
}
#: Rules in the order in which they are tried: name, licence, sentences.
RULES = (
    ("apache-notice", "Apache-2.0", ("apache-grant-use", "apache-copy-url", "apache-basis", "apache-see")),
    ("apache-notice-lines", "Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-url", "apache-basis", "apache-see")),
    ("apache-notice-url-line", "Apache-2.0", ("apache-grant-use", "apache-copy", "apache-url", "apache-basis", "apache-see")),
    ("apache-notice-cut", "Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("apache-notice-cut-http", "Apache-2.0", ("apache-grant", "apache-use", "apache-copy-http", "apache-basis", "apache-see")),
    ("apache-notice-cut-line", "Apache-2.0", ("apache-grant", "apache-use", "apache-copy-url", "apache-basis", "apache-see")),
    ("apache-notice-headless", "Apache-2.0", ("apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("apache-notice-headless-http", "Apache-2.0", ("apache-use", "apache-copy-http", "apache-basis", "apache-see")),
    ("apache-notice-short", "Apache-2.0", ("apache-grant-use", "apache-copy-url")),
    ("mit-text-titled", "MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("mit-text-the-titled", "MIT", ("the-mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("mit-text-headless", "MIT", ("mit-notice", "mit-warranty", "mit-liability")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3-text-headless", "BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-text-headless", "BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("gpl-3-notice-cut", "GPL-3.0-or-later", ("gpl-program", "gpl-modify", "gpl-useful", "gpl-merchant", "gpl-details", "gpl-copy")),
    ("gpl-3-notice-cut-short", "GPL-3.0-or-later", ("gpl-program", "gpl-modify", "gpl-useful", "gpl-merchant", "gpl-details")),
    ("gpl-3-notice-headless", "GPL-3.0-or-later", ("gpl-modify", "gpl-useful", "gpl-merchant", "gpl-details", "gpl-copy")),
    ("gpl-3-notice-headless-short", "GPL-3.0-or-later", ("gpl-modify", "gpl-useful", "gpl-merchant", "gpl-details")),
    ("gpl-3-notice", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details", "gpl-copy")),
    ("gpl-3-notice-short", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("mpl-2-notice-cut", "MPL-2.0", ("mpl-terms-v", "mpl-version", "mpl-copy")),
    ("mpl-2-notice-cut-http", "MPL-2.0", ("mpl-terms-v", "mpl-version", "mpl-copy-http")),
    ("mpl-2-notice-headless", "MPL-2.0", ("mpl-version", "mpl-copy-http")),
    ("mpl-2-notice", "MPL-2.0", ("mpl-terms", "mpl-copy")),
    ("apache-line", "Apache-2.0", ("apache-line",)),
    ("apache-grant", "Apache-2.0", ("apache-grant",)),
    ("mit-line", "MIT", ("mit-line",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("gpl-3-line", "GPL-3.0-only", ("gpl-line",)),
    ("gpl-3-free", "GPL-3.0-or-later", ("gpl-free",)),
    ("gpl-3-free-cut", "GPL-3.0-or-later", ("gpl-program", "gpl-modify")),
    ("mpl-2-terms-cut", "MPL-2.0", ("mpl-terms-v", "mpl-version")),
    ("mpl-2-terms", "MPL-2.0", ("mpl-terms",)),
    ("cc-by", "CC-BY-4.0", ("cc-by",)),
    ("cc-by-long", "CC-BY-4.0", ("cc-by-long",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc",)),
    ("cc-by-nd", "CC-BY-ND-4.0", ("cc-by-nd",)),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("spdx-apache", "Apache-2.0", ("spdx-tag", "spdx-apache")),
    ("spdx-mit", "MIT", ("spdx-tag", "spdx-mit")),
    ("spdx-bsd-2", "BSD-2-Clause", ("spdx-tag", "spdx-bsd-2")),
    ("spdx-bsd-3", "BSD-3-Clause", ("spdx-tag", "spdx-bsd-3")),
    ("spdx-gpl-3", "GPL-3.0-or-later", ("spdx-tag", "spdx-gpl-3")),
    ("spdx-mpl", "MPL-2.0", ("spdx-tag", "spdx-mpl")),
)

#: Every rule has a sentence with one of these words (the last few are parts that follow one); a text without them has no licence.
GATE = "licens|copyright|redistribut|warrant|free software|unencumbered|mpl|^(2 0|mit|apache 2 0|bsd [23] clause|gpl 3 0 or later)$"
#: A sentence without bearing on the order: a copyright line, a list number, or an address cut off at its "//".
FILLER = "^(copyright .*|c [0-9]{4}.*|all rights reserved|[a-z0-9]{0,2}|http|(www )?apache org licenses license 2 0( txt| html)?|(www )?mozilla org mpl 2 0)$"
#: The sentence that names the holder reads alike whoever that is; a name with a full stop ends it early.
NAMES = "^(neither the names? of .*|the names? of (the )?(author|authors|copyright holder|copyright holders|contributors) may not be used to endorse or promote products derived from this software without (specific )?prior written permission)$"
_END = r"([.!?;:])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One letter for each sentence, from a range that Unicode leaves to private use, and the letters of each rule.
LETTERS = dict(zip(SENTENCES, map(chr, range(0xE000, 0xE000 + len(SENTENCES))), strict=True))
CODES = ["".join(LETTERS[s] for s in sentences) for _, _, sentences in RULES]


def sentences(text: Column) -> tuple[Column, Column]:
    """The sentences of a text line by line, and with lines joined that no blank line parts."""
    by_line = F.split(F.regexp_replace(text, _END + r"[ \t\r]+", "$1\n"), "\n")
    joined = F.split(F.regexp_replace(text, _END + r"[ \t\r\n#*/]+|\n[ \t\r#*/]*\n", "$1\u0001"), "\u0001")
    return by_line, joined


def normalised(sentence: Column) -> Column:
    """Lower-case ASCII words with single blanks."""
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def letters(found: Column) -> Column:
    """The letters of a text's sentences; a dot for each that is not known."""
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (s, LETTERS[name])))

    def letter(sentence: Column) -> Column:
        plain = normalised(sentence)
        return F.coalesce(F.try_element_at(known, plain), F.when(plain.rlike(NAMES), LETTERS["bsd-names"]).when(plain.rlike(FILLER), "").otherwise("."))

    return F.array_join(F.transform(found, letter), "")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and rule that it holds: id, ``rule``, ``licence``, ``n_sentences`` and ``n_found``.

    ``n_found`` counts how often the rule is met, in the reading (by lines or
    joined) that has it more often.  Null and empty texts hold nothing; a
    repeated row yields its rows again; a null id stays null; a text of any
    length is read whole; of rules that fit at one place the first counts; an
    empty table has no rows, and other columns take no part.  No row is moved.
    """
    text = F.col("text")
    # An address is read alike with https, and a tag with no blank after its colon like one with a blank.
    plain = F.regexp_replace(F.regexp_replace(text, "(?i)https://", "http://"), r"(?i)(SPDX-License-Identifier:)(\w)", "$1 $2")
    matches = [F.regexp_extract_all(letters(s), F.lit(f"({'|'.join(CODES)})"), 1) for s in sentences(plain)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(text.rlike(f"(?i){GATE}"))
    rows = rows.select("id", matches[0].alias("lines"), matches[1].alias("joined"))
    found = rows.select("id", "lines", "joined", F.explode(F.array_distinct(F.concat("lines", "joined"))).alias("code"))
    number = F.array_position(F.array(*map(F.lit, CODES)), F.col("code")).cast("int")
    times = lambda c: F.size(F.filter(c, lambda x: x == F.col("code")))
    return found.select(
        F.col("id").alias(id_col),
        F.element_at(F.array(*(F.lit(r[0]) for r in RULES)), number).alias("rule"),
        F.element_at(F.array(*(F.lit(r[1]) for r in RULES)), number).alias("licence"),
        F.length("code").alias("n_sentences"),
        F.greatest(times("lines"), times("joined")).alias("n_found"),
    )


def _sql() -> str:
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)
    code = lambda column: f"regexp_extract_all(array_to_string(list_transform({column}, lambda s: coalesce(known[s], CASE WHEN regexp_matches(s, '{NAMES}') THEN '{LETTERS["bsd-names"]}' WHEN regexp_matches(s, '{FILLER}') THEN '' ELSE '.' END)), ''), '({'|'.join(CODES)})')"
    plain = lambda cut, mark: f"list_transform(string_split({cut}, {mark}), lambda s: trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')))"
    return rf"""
WITH m AS (SELECT MAP([{", ".join(f"'{s}'" for s in SENTENCES.values())}], [{", ".join(f"'{x}'" for x in LETTERS.values())}]) AS known),
     d AS (SELECT doc_id, known, {plain(rf"regexp_replace(text, '{_END}[ \t\r]+', '\1' || chr(10), 'g')", "chr(10)")} AS by_line,
             {plain(rf"regexp_replace(text, '{_END}[ \t\r\n#*/]+|\n[ \t\r#*/]*\n', '\1' || chr(1), 'g')", "chr(1)")} AS joined
           FROM documents, m WHERE text IS NOT NULL),
     c AS (SELECT doc_id, {code("by_line")} AS lines, {code("joined")} AS joined FROM d),
     x AS (SELECT doc_id, lines, joined, unnest(list_distinct(lines || joined)) AS code FROM c),
     r(code, rule, licence) AS (VALUES {values((c, *r[:2]) for c, r in zip(CODES, RULES, strict=True))})
SELECT doc_id, rule, licence, length(code) AS n_sentences,
       greatest(len(list_filter(lines, lambda y: y = code)), len(list_filter(joined, lambda y: y = code))) AS n_found
FROM x JOIN r USING (code)
"""


SQL = _sql()
