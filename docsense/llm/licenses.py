"""Licence scans by canonical digest lookup (operator 3), in DataFrame functions only.

A text is put into canonical form: lower case, copyright lines removed, punctuation to space, equivalent spellings to one.
Its SHA-256 is joined with the digests of known licence texts. Two units are looked up: the entire text, and each of its
lines as a text of its own (for statements such as "Released under the MIT License."). Line breaks and comment marks don't
count, so a licence is found however it is wrapped, and as the comment of a source file that holds nothing else.

Known texts are those in ``license_texts`` (as published, some in two editions), short texts and notices given here, and
statements made by rule from names. Each text is known with its title line and without it, and short ones with their
licence's names for a title and with bullets in place of numbers. The digests are a table of a few hundred rows, so Spark joins it as a broadcast (by its size, without a hint) and
the texts are never shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, from the matching guidelines of the public licence list.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "noncommercial": "non  commercial",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

COPYRIGHT_LINE = r"^[ \t*#/;-]*(copyright[^\n]*([0-9]{4}|\(c\)|©)|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"

#: Short names under which statements refer to a licence, and which stand as titles.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    "MIT": ["MIT License", "MIT", "The MIT License", "The MIT License (MIT)"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Unlicense": ["Unlicense"],
}
STATEMENTS = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "Released under {}", "This work is licensed under the {}", "This work is licensed under {}", "SPDX-License-Identifier: {}"]

#: The texts of short licences and notices.
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n"
)
#: Entire texts of short licences and notices.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD + _WARRANTY,
    "BSD-3-Clause": _BSD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n" + _WARRANTY,
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


#: A first line of at most so many characters that names a licence is a title.
TITLE = 80
#: Texts below this length are known under every name of their licence as a title; longer ones carry their own.
SHORT = 5000


def _titled(license_id: str, text: str) -> list[str]:
    """The text as it is and without its title; a short one also under each name, and with its list unnumbered."""
    lines = text.strip().split("\n")
    bare = "\n".join(lines[1:]) if len(lines) > 1 and len(lines[0]) <= TITLE and "licen" in lines[0].lower() else text
    if len(text) >= SHORT:
        return [text, bare]
    bodies = [bare, re.sub(r"(?m)^[ \t]*[0-9][.)][ \t]+", "", bare)]
    return [text, *bodies, *[f"{name}\n{body}" for name in NAMES.get(license_id, []) for body in bodies]]


@lru_cache(maxsize=1)
def published() -> tuple[tuple[str, str], ...]:
    """(licence id, text) of the files in ``license_texts``; what follows a + in a file's name numbers editions."""
    files = sorted(resources.files("docsense.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name)
    return tuple((f.name.removesuffix(".txt").split("+")[0], f.read_text(encoding="utf-8")) for f in files if f.name.endswith(".txt"))


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of every known text: entire texts, and statements by rule from names."""
    stated = [(key, pattern.format(name)) for key, names in NAMES.items() for name in [*names, key] for pattern in STATEMENTS]
    entire = [(key, form) for key, text in [*TEXTS.items(), *published()] for form in _titled(key, text)]
    return sorted({*entire, *stated})


def canonical_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and lines: the non-empty lines of ``text`` in canonical form; words are parted by two spaces.

    The steps are selects of their own, so each is evaluated once for a row; the replacements of spellings run where any
    of them occurs.
    """
    bare = rows.select(*keep, F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "(?md)" + COPYRIGHT_LINE, "").alias("t"))
    spaced = bare.select(*keep, F.concat(F.lit("  "), F.replace(F.regexp_replace("t", PUNCTUATION, "  "), F.lit("\n"), F.lit("  \n  ")), F.lit("  ")).alias("t"))
    usual = F.col("t")
    for other, common in SPELLINGS.items():
        usual = F.replace(usual, F.lit(f"  {other}  "), F.lit(f"  {common}  "))
    same = spaced.select(*keep, F.when(F.col("t").rlike("  (" + "|".join(SPELLINGS) + ")  "), usual).otherwise(F.col("t")).alias("t"))
    return same.select(*keep, F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))


def canonical(lines: Column) -> Column:
    return F.array_join(lines, "  ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def registry(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and digest of known texts; texts that are equal in canonical form keep the first id."""
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in texts or known_texts()])
    known = canonical_lines(spark.range(1).select(F.inline(rows)), "license_id").select("license_id", digest(canonical(F.col("lines"))).alias("digest"))
    return known.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a match: doc_id, unit (document or line), line (from 0 among non-empty canonical lines; -1 for the
    document), license_id and digest.

    A text of one line that is a licence matches as document and as line. Null, empty and unmatched texts give no rows,
    repeated rows give repeated matches, and columns other than doc_id and text are ignored.
    """
    lines = canonical_lines(docs.select("doc_id", "text"), "doc_id")
    digests = lines.select("doc_id", F.concat(F.array(digest(canonical(F.col("lines")))), F.transform("lines", digest)).alias("digests"))
    units = digests.select("doc_id", F.posexplode_outer("digests").alias("at", "digest"))
    found = units.join(registry(docs.sparkSession, texts), "digest")
    return found.select("doc_id", F.when(F.col("at") == 0, "document").otherwise("line").alias("unit"), (F.col("at") - 1).cast("long").alias("line"), "license_id", "digest")
