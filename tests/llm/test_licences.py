"""Licence rules against known texts and a plain reading."""

import re


from veilcheck.llm import licences
from veilcheck.llm.licences import CODES, FILLER, GATE, LETTERS, RULES, SENTENCES, scan_licences

DOCS = "doc_id long, text string"
APACHE = """# Copyright 2020 The Authors
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2019 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def slow_scan(text):
    """Rules by name with the greater count of both readings."""
    found = {}
    for marked in (
        re.sub(r"([.!?;:])[ \t\r]+", r"\1\n", text).split("\n"),
        re.sub(r"([.!?;:])[ \t\r\n#*/]+|\n[ \t\r#*/]*\n", lambda m: (m[1] or "") + "\x01", text).split("\x01"),
    ):
        names = {s: name for name, s in SENTENCES.items()}
        row = []
        for sentence in marked:
            plain = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)).strip(" ")
            if plain in names or not re.match(FILLER, plain):
                row.append(names.get(plain))
        at, count = 0, {}
        while at < len(row):
            rule = next((r for r in RULES if tuple(row[at : at + len(r[2])]) == r[2]), None)
            at += len(rule[2]) if rule else 1
            if rule:
                count[rule[0]] = count.get(rule[0], 0) + 1
        for name, n in count.items():
            found[name] = max(n, found.get(name, 0))
    return found


CASES = [
    None, "", "\n\n", "no such thing here", APACHE, MIT, f"intro text.\n{APACHE}\nmore. {MIT}",
    "A line.\nReleased under the MIT License.\nReleased under the MIT License.", "x Released under the MIT License.",
    "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "// SPDX-License-Identifier: MIT", "spdx license identifier mit",
    "licensed under the apache license version 2 0\n" * 500, MIT.replace("\n", " "), "the word licence alone", "Copyright (c) 2020 x\nMIT License",
]


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(4, APACHE, "y"), (None, MIT, "z")], DOCS + ", rule string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.rule, r.n_found) for r in scan_licences(docs).collect())
    assert got == sorted([(i, *f) for i, t in [*enumerate(CASES), (4, APACHE), (-1, MIT)] for f in slow_scan(t or "").items()])
    names = {r.rule for r in scan_licences(docs.filter("doc_id in (4, 5)")).collect()}
    assert {"mit-text-titled", "apache-grant"} <= names


def test_whole_notices(spark):
    got = {(r.rule, r.licence) for r in scan_licences(spark.createDataFrame([(1, MIT)], DOCS)).collect()}
    assert ("mit-text-titled", "MIT") in got
    got = {r.licence for r in scan_licences(spark.createDataFrame([(1, APACHE)], DOCS)).collect()}
    assert got == {"Apache-2.0"}


def test_tables_are_sound():
    assert len(SENTENCES) <= 52 and len(set(LETTERS.values())) == len(SENTENCES) == len(set(SENTENCES.values()))
    assert len(set(CODES)) == len(CODES)
    for sentence in SENTENCES.values():
        assert re.search(GATE, sentence) and sentence == re.sub("[^a-z0-9]+", " ", sentence).strip()
        assert any(letter in code for code in CODES for letter in [LETTERS[n] for n, s in SENTENCES.items() if s == sentence])
    # A rule that comes after one it begins with would never be met.
    for i, code in enumerate(CODES):
        assert not any(code.startswith(earlier) for earlier in CODES[:i])


def test_plan_is_native_and_moves_nothing(spark):
    docs = spark.createDataFrame([(1, MIT)], DOCS)
    plan = scan_licences(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert scan_licences(spark.createDataFrame([], DOCS)).collect() == []
    assert licences.SQL.count("unnest") == 1
