"""Licence scan by canonical digests.

A text is brought to a canonical form - lower case, one spelling of equivalent words and marks,
no copyright lines, no punctuation, single spaces - and its SHA-256 is joined with the digests of
known licences. Whole texts are looked up, and so is every line as a text of its own, which
finds the usual one-line notices. A copyright line goes only if a year, a sign or the reservation
of rights shows it to be one: wrapped sentences may begin with the word. Everything is a DataFrame expression; the table of known
digests is the only thing broadcast and has one row per known text.

Defined results: null text is the empty text; texts that are canonically empty match nothing;
rows are judged one by one, so ties, repeated rows and null ids are carried as they are.
"""

from __future__ import annotations

from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm.common import filled, fresh

# Texts of well-known licences and the one-line notices that name one.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY"
    " CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE"
    " OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    "\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    "\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission."
)
_BSD_TAIL = (
    "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED"
    " TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_TAIL = (
    "\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
    " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR"
    " IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEXTS: list[tuple[str, str]] = [
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software.\n\n" + _AS_IS,
    ),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL,
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising"
        " from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and"
        " to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you"
        " must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would"
        " be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the"
        " original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining"
        " a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute,"
        " and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do"
        " so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this"
        " restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the"
        " Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language"
        " processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
        " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING"
        " THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH"
        " THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain"
        " a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software"
        " distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See"
        " the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

#: The last line of the terms where instructions for using the licence follow, which many copies leave out.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def _full_texts() -> list[tuple[str, str]]:
    """The licences of ``licence_texts``, each named by its file, whole and up to the end of the terms."""
    out = []
    for file in sorted((resources.files("siftframe.llm") / "licence_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        out.append((name, text))
        terms, end, _ = text.partition(END_OF_TERMS)
        if end:
            out += [(name, terms + end), (name, terms)]
    return out


TEXTS += _full_texts()

# A line that states who holds the copyright: a year, a sign or the reservation goes with the word.
_MARK = r"(?:copyright|copr\.|\(c\)|©)"
_HOLDER = (
    r"(?:all rights reserved|©"
    rf"|{_MARK}[ \t:,]*(?:{_MARK}[ \t:,]*)*(?:[0-9]{{4}}|[<\[({{]+(?:year|yyyy))"
    r"|(?:copyright|copr\.)[ \t:]*(?:\(c\)|©)"
    rf"|{_MARK}[^\n]*(?:all rights reserved|[0-9]{{4}}[., \t\r]*$))"
)

# Patterns that Java's and RE2's regular expressions read alike; applied to lower-case text in this order.
STEPS: list[tuple[str, str]] = [
    (r"[\x{00A0}\x{2000}-\x{200B}\x{3000}]", " "),
    (rf"(?m)^[ \t/*#;>-]*{_HOLDER}[^\n]*$", " "),
    (r"https://", "http://"),
    (r"licence", "license"),
    (r"favour", "favor"),
    (r"organis", "organiz"),
    (r"acknowledgement", "acknowledgment"),
    (r"sub-license", "sublicense"),
    (r"non-infring", "noninfring"),
    (r"©|\(c\)", "copyright"),
    (r"&", " and "),
    (r"(^|[^\p{L}\p{N}])v(?:ersion|er)?[. \n]*([0-9])", "$1version $2"),
    (r"[^\p{L}\p{N}]+", " "),
]


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """(licence, digest, form): the canonical digests of known texts and their canonical form."""
    rows = spark.createDataFrame(texts, "licence string, text string")
    form = rows.select("licence", canonical(F.col("text")).alias("form"))
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.max("form").alias("form"))


#: Beginnings of words that a step may have made out of something else.
MADE = ("http", "favor", "organiz", "acknowledgment", "sublicense", "noninfring", "copyright", "and", "version")
FRAGMENTS = 50


def fragments(forms: list[str]) -> list[str]:
    """A few pieces of words of which every text with one of the canonical forms holds one in lower case.

    Empty if a form has none, or if more than FRAGMENTS would be needed: then every text has to be looked at.
    """

    def of(form: str) -> set[str]:
        own = {w for w in form.split() if len(w) >= 4 and w.isascii() and w.isalpha() and not any(m in w for m in MADE) and "licens" not in w}
        return own | ({"licen"} if "licens" in form else set())

    left, found = [of(f) for f in forms], []
    if not all(left):
        return []
    while left:
        counts = Counter(w for words in left for w in words)
        found.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [words for words in left if found[-1] not in words]
    return found if len(found) <= FRAGMENTS else []


def scan(docs: DataFrame, text: str = "text", texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """The rows with text_digest, licence (of the whole text, or null) and notices (licences named by lines)."""
    spark = docs.sparkSession
    table = known_licences(spark, texts).collect()  # one row per known text
    whole, licence, notices = fresh(docs, "text_digest", "licence", "notices")
    (form,) = fresh(docs, "form")
    known = F.broadcast(spark.createDataFrame([(r["digest"], r["licence"]) for r in table], f"`{whole}` string, `{licence}` string"))
    # a line without any of the fragments, or with a longer form than the longest, cannot match
    pairs = [F.lit(x) for r in table for x in (r["digest"], r["licence"])]
    names = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    longest = max((len(r["form"]) for r in table), default=0)
    lines, pieces = F.split(filled(text), "\n"), fragments([r["form"] for r in table])
    if pieces:
        lines = F.filter(lines, lambda line: F.lower(line).rlike("|".join(pieces)))
    forms = F.filter(F.transform(lines, canonical), lambda f: F.char_length(f) <= longest)
    found = F.array_compact(F.transform(forms, lambda f: names[F.sha2(f, 256)]))
    rows = docs.withColumn(notices, F.sort_array(F.array_distinct(found)))
    rows = rows.withColumn(form, canonical(filled(text)))
    rows = rows.withColumn(whole, F.sha2(form, 256)).drop(form)
    return rows.join(known, whole, "left").select(*(F.col(f"`{c}`") for c in docs.columns), whole, licence, notices)

