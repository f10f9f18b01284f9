"""Licence scans by canonical digests.

A text is brought into one canonical form, so that case, punctuation, white space, copyright lines and equivalent
spellings make no difference, and its digest is joined with the digests of known licence texts in the same form.
Both the entire text and each of its lines are looked up: a document can be a licence, or hold a notice on a line
of its own.

Everything is column expressions. Lines whose length no known text has cannot be equal to one and are not
digested; that is exact. The table of known digests has one row per known text and joins by hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Equivalent spellings of words (fixed values, after the public matching guidelines for licence texts).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment",
    "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed",
    "organisation": "organization", "organisations": "organizations", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "https": "http", "noncommercial": "non commercial", "noninfringement": "non infringement", "owner": "holder", "owners": "holders",
    "sublicence": "sub license", "sublicense": "sub license",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_END = "For more information, please refer to <{}>"

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    {}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""

_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU{0} General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU{0} General Public License for more details.

You should have received a copy of the GNU{0} General Public License along with this program. If not, see <{1}://www.gnu.org/licenses/>."""

#: Known texts by licence. Copyright lines play no part; titles do, so texts stand with and without theirs.
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, f"MIT License\n{_MIT}", f"The MIT License (MIT)\n{_MIT}", f"The MIT License\n{_MIT}", f"License\n{_MIT}", "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "ISC": (f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
            f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}", "SPDX-License-Identifier: ISC"),
    "0BSD": (f"{_ISC_GRANT}.\n{_ISC_END}", f"BSD Zero Clause License\n{_ISC_GRANT}.\n{_ISC_END}", "SPDX-License-Identifier: 0BSD"),
    "BSD-2-Clause": (f"{_BSD_START}\n{_BSD_END}", f"BSD 2-Clause License\n{_BSD_START}\n{_BSD_END}", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (f"{_BSD_START}\n{_BSD_THIRD}\n{_BSD_END}", *(f"{t}\n{_BSD_START}\n{_BSD_THIRD}\n{_BSD_END}" for t in ("BSD License", "New BSD License", "The BSD 3-Clause License")), f"BSD 3-Clause License\n{_BSD_START}\n{_BSD_THIRD}\n{_BSD_END}", "SPDX-License-Identifier: BSD-3-Clause"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE_NOTICE.format("http"), _APACHE_NOTICE.format("https"), "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-3.0-or-later": (_GPL_NOTICE.format("", "http"), _GPL_NOTICE.format("", "https"), "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-3.0-or-later": (_GPL_NOTICE.format(" Lesser", "http"), _GPL_NOTICE.format(" Lesser", "https"), "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0-or-later": (_GPL_NOTICE.format(" Affero", "http"), _GPL_NOTICE.format(" Affero", "https"), "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Unlicense": (_UNLICENSE, *(f"{_UNLICENSE}\n{_UNLICENSE_END.format(u)}" for u in ("http://unlicense.org", "http://unlicense.org/", "https://unlicense.org")),
                  "SPDX-License-Identifier: Unlicense"),
    "Zlib": (_ZLIB, f"zlib License\n{_ZLIB}", "SPDX-License-Identifier: Zlib"),
    "BSL-1.0": (_BSL, f"Boost Software License - Version 1.0 - August 17th, 2003\n{_BSL}", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
}

#: Canonical digests of entire texts that are too long to stand here, with their titles; the second of a licence is the text
#: up to "end of terms and conditions".
LONG_DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("b48f7d0924339f16fabf50e39ee91a358c55e641b2736af871e7b2f94c399f87", "fbd703b5d5a1d4f583abfb290515afb9ddd801c6861302196c26a53d2922bcf7",),
    "Artistic-1.0": ("b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",),
    "CC0-1.0": ("f3cde3e32dc7fe4173bcc75ba6b6192de0de3ab30f40209aadda37dc268c0076",),
    "GFDL-1.3": ("0070809ddb5f6716c91f6e6ec90b037f758049348a024dfeee61294c5deab56b",),
    "GPL-2.0": ("189aa3326bb1b845d7572ed61bf7ce662343a3686239b63356196a994184b25b", "b7cfa8113d3347077a003344c00a186d9bdf639d727ef0cc82502613a7e77034",),
    "GPL-3.0": ("3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64", "8c24ccf35998bd73317aa0801f6e6cbd865514baf55f246a48a8e890d1abc3d1",),
    "LGPL-2.1": ("408a350cee100cd0e7c5c8bee91d17964ce206f818a4402c114ac7b35dc99413", "01b7561b9cd58ef186118e6b83d6a71a6a6803380573ff8513e4431a887e1bf9",),
    "LGPL-3.0": ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",),
    "MPL-1.1": ("c95b1aa6e598a85fb1deb9f55cc2b2e83c30ba8b696e507ab70b8dee64ceca4b",),
    "MPL-2.0": ("4074582e336aeac91d2b04e03a142feabd6443bbdcea95252932ec1a657ebc4e",),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after which a line that begins with "copyright" goes on with a licence's own text, as wrapped lines may. Other lines
#: that begin so name someone.
GOES_ON = "and|as|disclaimers?|holders?|in|infringement|interests?|is|laws?|licen[cs]es?|notices?|of|on|or|owners?|permission|protection|" \
    "rights?|statements?|status|that|to|treat(?:y|ies)|under|works?"
#: A sign that is a letter but in no word of these texts; it keeps such lines from the next pattern, which has no look-ahead so
#: that other engines know it too.
_HELD = "\ua66e"
HELD_LINE = rf"^([^\p{{L}}\p{{N}}\n©]*)(copyright[ \t]+(?:{GOES_ON})(?:[^\p{{L}}\p{{N}}]|$))"
#: Lines that state a copyright, in lower case: with a year or sign, a colon, or a name.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n©]*(?:copyright(?:[ \t]*:|[ \t:]*(?:\(c\)|©|[0-9<\[{])|[ \t]+\p{L})|©|\(c\)[ \t]*[0-9]|all rights reserved\.?[ \t\r]*$)[^\n]*"
#: Numbers and letters of list items: at the start of a line, numbers also after a mark. Bullets are punctuation anyway.
LIST_MARK = r"(?:(^[^\p{L}\p{N}\n]*)(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})|([.:;,]['\"”’)]*[ \t]+\(?)[0-9]{1,2})[.)]([ \t\r\n])"


def canonical_lines(text: Column) -> Column:
    """Text in canonical form with its lines kept. Words stand between two blanks each, of which every spelling can
    be replaced by itself."""
    out = F.translate(text, _UPPER, _LOWER)
    # Only \n ends a line in these patterns, as in other engines.
    held = F.regexp_replace(out, "(?dm)" + HELD_LINE, f"$1{_HELD}$2")
    out = F.when(F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("all rights reserved")),
                 F.replace(F.regexp_replace(held, "(?dm)" + COPYRIGHT_LINE, ""), F.lit(_HELD), F.lit(""))).otherwise(out)
    out = F.regexp_replace(out, "(?dm)" + LIST_MARK, "$1$2 $3")
    out = F.concat(F.lit("  "), F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", "  "), F.lit("  "))
    out = F.replace(out, F.lit("\n"), F.lit("  \n  "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


#: Whose name must not be used is filled in by each author.
NAME_SLOT, NAME_FREE = "neither the names? of [^\n]{1,80}? nor the names of (?:its|his|her|their|the) contributors", "neither the name of nor the names of its contributors"


def _joined(canonical: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(canonical, r"[ \n]+", " ")), NAME_SLOT, NAME_FREE)


def digest_of(canonical: Column) -> Column:
    """SHA-256 of an entire canonical text, null for null and for texts without letters and digits."""
    joined = _joined(canonical)
    return F.when(joined != "", F.sha2(joined.cast("binary"), 256))


def known_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]] = KNOWN, further: DataFrame | None = None,
                  digests: Mapping[str, tuple[str, ...]] = LONG_DIGESTS) -> DataFrame:
    """``(license, digest, size)`` of known texts, of those in the table ``further`` (license, text), and of ``digests``, which
    have no size. Texts that are equal in canonical form have their licences' smallest name."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, texts in known.items() for text in texts]
    texts = spark.range(1).select(F.inline(F.array(*rows)))
    if further is not None:
        texts = texts.unionByName(further.select("license", "text").where("license IS NOT NULL"))
    lines = texts.withColumn("text", canonical_lines(F.col("text")))
    found = lines.select("license", digest_of(F.col("text")).alias("digest"), F.length(_joined(F.col("text"))).alias("size")).where("digest IS NOT NULL")
    rows = [F.struct(F.lit(name).alias("license"), F.lit(d).alias("digest"), F.lit(None).cast("int").alias("size")) for name, ds in digests.items() for d in ds]
    if rows:
        found = found.unionByName(spark.range(1).select(F.inline(F.array(*rows))))
    return found.groupBy("digest").agg(F.max("size").alias("size"), F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text_digest`` of the entire canonical text, ``license``, the known licence
    that it equals, and ``line_licenses``, the sorted names of those that single lines equal.

    ``known`` is :func:`known_digests`' result. Null texts, and those without letters and digits, have no digest and
    no licence; ``line_licenses`` is empty where no line is known. Repeated rows and null ids are kept, each with its
    own text's answer. Empty tables give no rows.
    """
    known = cut_lineage(known)
    sizes = [r["size"] for r in known.where("size IS NOT NULL").select("size").distinct().collect()]  # one number per known text at most
    canonical = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    lines = F.filter(F.transform(F.split("lines", "\n"), _joined), lambda line: F.length(line).isin(sizes or [-1]))
    digests = F.coalesce(F.transform(F.array_distinct(lines), lambda line: F.sha2(line.cast("binary"), 256)), F.array().cast("array<string>"))
    marked = cut_lineage(canonical.select("doc_id", digest_of(F.col("lines")).alias("text_digest"), F.array_sort(digests).alias("digests")))
    # What a line tells depends on its digest only, so equal sets of digests are looked up together.
    sets = marked.where(F.size("digests") > 0).select("digests").distinct()
    named = sets.select("digests", F.explode("digests").alias("digest")).join(known.select("digest", "license"), "digest")
    named = named.groupBy("digests").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"))
    whole = known.select(F.col("digest").alias("text_digest"), "license")
    return marked.join(whole, "text_digest", "left").join(cut_lineage(named), "digests", "left").select(
        "doc_id", "text_digest", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
