"""Standard notices as they are written, in comments, wrapped and not, below a copyright line."""

import re

import pytest

from tests.llm.test_licences import APACHE, DOCS, MIT
from veilcheck.llm.licences import RULES, SENTENCES, scan_licences

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GRANT = APACHE.split("\n", 1)[1].replace("# ", "").replace("#\n", "\n")
MIT_TEXT = MIT[MIT.index("Permission") :]
TAGS = {"Apache-2.0": "apache", "MIT": "mit", "BSD-2-Clause": "bsd-2", "BSD-3-Clause": "bsd-3", "GPL-3.0-or-later": "gpl-3", "MPL-2.0": "mpl"}


def commented(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.rstrip("\n").split("\n"))


def unwrapped(text):
    return "\n\n".join(re.sub(r"\s+", " ", part).strip() for part in text.split("\n\n")) + "\n"


COPYRIGHT = "Copyright 2020 The Authors\n"
CASES = {
    **{f"tag {x}": (f"// SPDX-License-Identifier: {x}\nint x;", f"spdx-{rule}", x) for x, rule in TAGS.items()},
    **{f"tag without blank {x}": (f"/* SPDX-License-Identifier:{x} */", f"spdx-{rule}", x) for x, rule in TAGS.items()},
    "gpl": (GPL, "gpl-3-notice-cut", "GPL-3.0-or-later"),
    "gpl unwrapped": (unwrapped(GPL), "gpl-3-notice-cut", "GPL-3.0-or-later"),
    "gpl in a comment": (commented(GPL, "#"), "gpl-3-notice-cut", "GPL-3.0-or-later"),
    "gpl below a copyright line": (COPYRIGHT + GPL, "gpl-3-notice-headless", "GPL-3.0-or-later"),
    "gpl 3 free": (GPL.split("\n\n")[0], "gpl-3-free-cut", "GPL-3.0-or-later"),
    "mpl": (MPL, "mpl-2-notice-cut-http", "MPL-2.0"),
    "mpl http": (commented(MPL.replace("https", "http"), " *"), "mpl-2-notice-cut-http", "MPL-2.0"),
    "mpl unwrapped": (unwrapped(MPL), "mpl-2-notice-cut", "MPL-2.0"),
    "mpl below a copyright line": (COPYRIGHT + MPL, "mpl-2-notice-headless", "MPL-2.0"),
    "apache": (GRANT, "apache-notice-cut", "Apache-2.0"),
    "apache https": (commented(GRANT, "//").replace("http:", "https:"), "apache-notice-cut", "Apache-2.0"),
    "apache, address in the line": (GRANT.replace("at\n\n    http", "at http"), "apache-notice-cut-http", "Apache-2.0"),
    "apache unwrapped": (unwrapped(GRANT.replace("at\n\n", "at ")), "apache-notice-cut-line", "Apache-2.0"),
    "apache below a copyright line": (APACHE, "apache-notice-headless", "Apache-2.0"),
    "mit below a copyright line": (COPYRIGHT + MIT_TEXT, "mit-text-headless", "MIT"),
    "bsd 3": (BSD, "bsd-3-text", "BSD-3-Clause"),
    "bsd 2": (BSD.split("3. ")[0], "bsd-2-text", "BSD-2-Clause"),
    "bsd 3 below a copyright line": (COPYRIGHT + BSD, "bsd-3-text-headless", "BSD-3-Clause"),
    "bsd 2 below a copyright line": (COPYRIGHT + BSD.split("3. ")[0], "bsd-2-text-headless", "BSD-2-Clause"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = scan_licences(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES.values())], DOCS)).collect()
    return {name: {(r.rule, r.licence) for r in rows if r.doc_id == i} for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_standard_notice(found, name):
    _, rule, licence = CASES[name]
    assert (rule, licence) in found[name] and {x for _, x in found[name]} == {licence}


def test_each_rule_fires_on_its_sentences(spark):
    docs = [(i, "\n\n".join(SENTENCES[s] for s in rule[2])) for i, rule in enumerate(RULES)]
    got = {(r.doc_id, r.rule, r.licence) for r in scan_licences(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(i, *rule[:2]) for i, rule in enumerate(RULES)}


def test_other_versions_are_not_taken(spark):
    docs = [(1, MPL.replace("v. 2.0", "v. 1.1")), (2, "MIT\n\n2.0\n\nlicence"), (3, "SPDX-License-Identifier: GPL-2.0")]
    assert scan_licences(spark.createDataFrame(docs, DOCS)).collect() == []


@pytest.mark.parametrize("holder", [
    "Neither the name of the University of Somewhere nor the names of its contributors",
    "Neither the name of ACME, Inc. nor the names of any contributors", "Neither the names of the authors nor the names of contributors",
    "The name of the author",
])
def test_bsd_3_of_any_holder(spark, holder):
    may = "may not be" if holder.startswith("The") else "may be"
    text = BSD.split("3. ")[0] + f"3. {holder} {may} used to endorse or promote products derived from this\n   software without specific prior written permission.\n"
    docs = [(0, text), (1, unwrapped(text)), (2, commented(text, "#"))]
    got = {(r.doc_id, r.licence) for r in scan_licences(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(i, "BSD-3-Clause") for i in range(3)}


def test_very_long_text(spark):
    docs = [(0, "word " * 600_000 + "\n\n" + BSD), (1, "x" * 3_000_000)]
    assert {(r.doc_id, r.licence) for r in scan_licences(spark.createDataFrame(docs, DOCS)).collect()} == {(0, "BSD-3-Clause")}
