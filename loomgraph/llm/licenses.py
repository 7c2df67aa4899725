"""Licence scans by canonical digest lookup, in built-in functions only.

Texts are normalised once (case, punctuation, copyright lines, equivalent spellings) and hashed; the digests
of entire texts are hash-joined to those of known licences, and those of entire lines are looked up among the digests
of short notices. Every row is judged by its own text, so ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published licence texts and notices, by SPDX id.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_CLAUSE_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_0 = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
#: Entire texts; a title line before the text is allowed for.
TEXTS = {
    "MIT": [MIT, f"MIT License\n\n{MIT}", f"The MIT License (MIT)\n\n{MIT}", f"The MIT License\n\n{MIT}"],
    "ISC": [ISC, f"ISC License\n\n{ISC}", f"The ISC License\n\n{ISC}"],
    "BSD-2-Clause": [BSD_2 + BSD_WARRANTY, f"BSD 2-Clause License\n\n{BSD_2}{BSD_WARRANTY}"],
    "BSD-3-Clause": [BSD_2 + BSD_CLAUSE_3 + BSD_WARRANTY, f"BSD 3-Clause License\n\n{BSD_2}{BSD_CLAUSE_3}{BSD_WARRANTY}"],
    "0BSD": [BSD_0, f"BSD Zero Clause License\n\n{BSD_0}", f"Zero-Clause BSD\n\n{BSD_0}"],
    "Zlib": [ZLIB, f"zlib License\n\n{ZLIB}"],
    "Unlicense": [UNLICENSE],
}
#: Digests of the normalised published texts that are too long to be spelled out here, by SPDX id. Texts with a closing
#: part on how to apply them stand with that part and without it.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5",
        "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809",
        "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93",
    ],
    "Artistic-1.0-Perl": [
        "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    ],
    "GFDL-1.3": [
        "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    ],
    "GPL-1.0": [
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    ],
    "GPL-2.0": [
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    ],
    "GPL-3.0": [
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    ],
    "LGPL-2.0": [
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    ],
    "LGPL-2.1": [
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    ],
    "MPL-2.0": [
        "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6",
    ],
}
#: Identifiers in SPDX lines that mean a licence, where they are others than its own id.
SPDX = {
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
}
#: What a notice calls a licence.
NAMES = {
    "0BSD": [],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0"],
    "EPL-2.0": ["the Eclipse Public License, Version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
}
#: How a notice says it.
PHRASES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.")
#: Entire lines.
NOTICES = {
    i: [f"SPDX-License-Identifier: {x}" for x in SPDX.get(i, (i,))] + [p.format(n) for n in names for p in PHRASES]
    for i, names in NAMES.items()
}
#: Normalising steps (pattern, replacement) on lower-cased text, the same in Java's and RE2's dialect but for the
#: sign of a group in the replacement.
STEPS = (
    (r"\r\n?", "\n"),
    (r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright|©|\(c\))[^\n]*(?:\(c\)|©|[0-9]{4}|\[yyyy\])[^\n]*$", ""),
    (r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", ""),
    (r"licence", "license"),
    (r"(sub|non)-(license|infringement|commercial)", "$1$2"),
    (r"copyright owner", "copyright holder"),
    (r"(acknowledg|judg)ement", "$1ment"),
    (r"(author|organ|recogn|util|real|normal|optim|categor|emphas|initial)is(e|ation)", "$1iz$2"),
    (r"http://", "https://"),
    (r"&", " and "),
    (r"[^\p{L}\p{N}\n]+", " "),
)
#: Known digests of texts that may be broadcast, and of notices that may be a literal of the plan.
MAX_BROADCAST, MAX_LITERAL = 100_000, 1_000


def normalised(text: Column) -> Column:
    """Lower-cased text in which lines survive and every other run of punctuation is a space."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    return out


def _digest(c: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")), 256)


def known_digests(spark, texts=TEXTS, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """``digest, license_id, kind, size``: of entire texts and of entire lines, and the length of a normalised line."""
    rows = [(t, i, "text") for i, ts in texts.items() for t in ts] + [(t, i, "line") for i, ts in notices.items() for t in ts]
    norm = normalised(F.col("text"))
    spelled = spark.createDataFrame(rows, "text string, license_id string, kind string").select(
        _digest(norm).alias("digest"), "license_id", "kind", F.length(F.trim(norm)).alias("size")
    )
    hashed = [(d, i, "text", None) for i, ds in digests.items() for d in ds]
    return spelled.unionByName(spark.createDataFrame(hashed, "digest string, license_id string, kind string, size int")).distinct()


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license_id, n_notices, notices`` for each row of ``docs`` (doc_id, text, ...).

    ``license_id``: the licence that the entire text is (of several the first by name), else null.
    ``notices``: ids of the licences whose notice is an entire line of this row's text, comma-joined by name. A
    null text is an empty one; null and repeated ids change nothing. An empty table gives no rows.
    Other columns are ignored. ``known`` of the caller's (digest, license_id, kind) may be of any size: a long list is
    joined by the digests of lines instead of becoming part of the plan.
    """
    mine = known is None
    known = known_digests(docs.sparkSession) if mine else known
    lines = known.where("kind = 'line'")
    few = lines.limit(MAX_LITERAL + 1).collect()  # bounded by the limit
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    split = F.transform(F.split("norm", "\n"), lambda x: F.trim(x))
    texts = known.where("kind = 'text'").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if mine or texts.count() <= MAX_BROADCAST:
        texts = F.broadcast(texts)
    if len(few) <= MAX_LITERAL:
        by_digest: dict[str, list[str]] = {}
        for r in few:
            by_digest.setdefault(r["digest"], []).append(r["license_id"])
        sizes = [r["size"] for r in few] if "size" in known.columns else []
        fits = F.array_distinct(F.filter(split, lambda x: F.length(x).between(min(sizes), max(sizes)) if sizes else F.length(x) > 0))
        entries = [c for d, ids in by_digest.items() for c in (F.lit(d), F.array(*map(F.lit, ids)))]
        table = F.create_map(*entries) if entries else F.expr("cast(map() as map<string, array<string>>)")
        hits = F.transform(fits, lambda x: F.try_element_at(table, F.sha2(x, 256)))
        found = F.array_sort(F.array_distinct(F.flatten(F.filter(hits, lambda x: x.isNotNull()))))
        rows = norm.select("doc_id", _digest(F.col("norm")).alias("digest"), found.alias("found"))
    else:
        # rows of one normalised text have the same notices, so the text's own digest is the key
        keyed = norm.select("doc_id", "norm", _digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("_key"))
        said = keyed.select("_key", F.explode(F.array_distinct(split)).alias("line")).where("line <> ''")
        found = (
            said.select("_key", F.sha2("line", 256).alias("digest"))
            .join(lines, "digest")
            .groupBy("_key")
            .agg(F.array_sort(F.collect_set("license_id")).alias("found"))
        )
        rows = keyed.select("doc_id", "digest", "_key").join(found, "_key", "left").select("doc_id", "digest", "found")
    return rows.join(texts, "digest", "left").select(
        "doc_id",
        "digest",
        "license_id",
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("notices"),
    )
