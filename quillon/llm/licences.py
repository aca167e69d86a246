"""Licence texts found by canonical digests: entire texts, and lines that are entire notices, hash-joined to known ones."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS

#: Equivalent spellings, applied after lower-casing; fixed values.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("honour", "honor"), ("merchantibility", "merchantability"), ("while", "whilst"))
#: Lines that state a copyright: with a year or a mark, so that a wrapped line which only begins with the word stays.
COPYRIGHT_LINE = r"(?im)^[ \t]*(copyright\b[^\n]*([12][0-9]{3}|\(c\)|©)|\(c\)|©)[^\n]*$"

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Known texts by licence identifier; fixed values.
KNOWN: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("proprietary", "All rights reserved."),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
)


#: Digests, in canonical form, of the texts that Debian keeps in /usr/share/common-licenses; fixed values.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "da3b88f491418d7980f5179aaac56faf3b81500a392963e87f27ff241f6a2a70"),
    ("Artistic-1.0", "3009c128edc3dee8ec27bd1403e34a6ccd067bdef8ddf616d4000c6a9866cb8b"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "29c28288274dd76ef554797c7f537bf13aea3fd3c9771a084296f0fba15c8896"),
    ("GFDL-1.3", "3049129e0035e4e39ecc049acd9ed11c35e888dd3a23252a0ca3cc3a0ca9fe14"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "77a17c8586ad4a15f4c4a26f2d3ce87ea2e9ddfba1f8d2b714dd33eb7a1f65f6"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)


def canonical_lines(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, in one spelling; lines stay apart."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical_text(text: str) -> str:
    """A known text in the same form, as one line, on the driver."""
    out = re.sub(COPYRIGHT_LINE, "", text).lower()
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return re.sub(r"[\W_]+", " ", out).strip()


def digests(known: tuple[tuple[str, str], ...], more: tuple[tuple[str, str], ...] = ()) -> dict[str, str]:
    """Licence by digest of the known texts and of ``more``, given as digests; of equal digests the least identifier."""
    out: dict[str, str] = {}
    for licence, digest in (*[(i, hashlib.sha256(canonical_text(t).encode()).hexdigest()) for i, t in known], *more):
        out[digest] = min(licence, out.get(digest, licence))
    return out


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, more: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """One row per document: its digest, the licence its entire text is, and those of lines that are entire notices.

    Entire texts are hash-joined to the known digests; lines are looked up in a map of them within the row, so nothing is
    shuffled but for a table of known digests too large to broadcast. ``notices`` holds distinct identifiers in order, joined by commas;
    ``n_notices`` counts the lines. Nulls, empty texts and texts of punctuation have the digest of an empty text and no licence.
    Repeated rows and null doc_ids give a row each, with the notices of their own text; other columns are left out; no rows give none.
    """
    named = digests(known, more)
    table = docs.sparkSession.createDataFrame(list(named.items()), "text_digest string, text_licence string")
    table = F.broadcast(table) if len(named) <= BROADCAST_ROWS else table
    lengths = sorted({len(canonical_text(t)) for _, t in known})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_lines"))
    known_lines = F.create_map(*[F.lit(x) for pair in named.items() for x in pair]) if named else F.create_map().cast("map<string,string>")
    # no known text has another length, so other lines need no digest
    lines = F.filter(F.transform(F.split("_lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(*lengths) & (x != ""))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(known_lines, F.sha2(x, 256))), lambda x: x.isNotNull())
    whole = F.sha2(F.trim(F.regexp_replace("_lines", "[ \n]+", " ")), 256)
    made = rows.select("doc_id", whole.alias("text_digest"), found.alias("_found"))
    return made.join(table, "text_digest", "left").select(
        "doc_id", "text_digest", "text_licence", F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"), F.size("_found").cast("long").alias("n_notices")
    )
