"""License scan by canonical digest lookup.

A text is brought to a canonical form (lower case, equivalent spellings united,
copyright lines removed, punctuation and white space reduced to single spaces), hashed
whole, and joined with the digests of known licence texts. The same is done for every
line as a text of its own, which finds one-line notices in longer documents.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import FULL_TEXTS

MIT = """MIT License
Copyright (c) year holder
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License
Copyright (c) year holder
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence, known text); several texts of one licence are fine.
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT), ("MIT", "The " + MIT), ("MIT", "The MIT License (MIT)\n" + MIT.split("\n", 1)[1]), ("MIT", MIT.split("\n", 1)[1]), ("ISC", ISC), ("ISC", "The " + ISC), ("ISC", ISC.split("\n", 1)[1]), ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("Zlib", ZLIB), ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern, replacement) in order, on lower-cased text; understood alike by Java, RE2 and
#: Python. Lines that state a copyright go first, then spellings, then punctuation.
STEPS = [
    (r"(^|\n)[ \t#*/;!%-]*(portions[ \t]+)?(copyright[ \t]*:?[ \t]*(\(c\)|©|[0-9]|year|by|[<\[{])|copyright[ \t][^\n]*[0-9][0-9][0-9][0-9]|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("https://", "http://"), ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("favour", "favor"), ("colour", "color"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"), ("per cent", "percent"), ("programme", "program"), ("wilful", "willful"), ("fulfill", "fulfil"),
    (r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{2013}\x{2014}\x{2018}\x{2019}\x{201c}\x{201d}\x{a0}]+", " "), ("^ | $", ""),
]
#: Every canonical known text has one of these words, so texts without them can be left
#: out before the canonical form is made. Spellings before and after STEPS count.
ANCHORS = "(?i)licen[cs]e|permission|redistribution"


def canonical_text(text: str) -> str:
    """The canonical form in Python, for the known texts."""
    t = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, new in STEPS:
        t = re.sub(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), pattern), new, t)
    return t


def known_digests() -> dict[str, str]:
    found = {digest: licence for licence, digest in FULL_TEXTS}
    for licence, text in KNOWN:
        c = canonical_text(text)
        if not re.search(ANCHORS, c):
            raise ValueError(f"a text of {licence} has no anchor")
        found[hashlib.sha256(c.encode()).hexdigest()] = licence
    return found


def canonical(text: F.Column) -> F.Column:
    t = F.translate(text, UPPER, LOWER)
    for pattern, new in STEPS:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(new))
    return t


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, license`` (of the whole text, or null),
    ``n_notices`` (lines that are a known text), ``licenses`` (all found, sorted, joined
    by commas; empty if none).

    A null or empty text has no licence. Repeated rows give repeated results; an empty
    table gives an empty result; other columns aren't read. The known texts are a fixed
    table of about a hundred rows, so their side of the hash join is broadcast.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(known_digests().items()), "digest string, known string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.select("doc_id", F.when(F.col("text").rlike(ANCHORS), F.col("text")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(ANCHORS))
    digest = lambda c: F.sha2(canonical(c), 256)
    hashed = rows.select("doc_id", F.when(F.col("text").isNotNull(), digest(F.col("text"))).alias("whole"), F.transform(lines, digest).alias("lines"))
    whole = hashed.join(F.broadcast(known.withColumnRenamed("known", "license")), F.col("whole") == F.col("digest"), "left")
    # lines stay in their row: their few digests are looked up in the same table as a map
    table = F.create_map(*[F.lit(x) for pair in sorted(known_digests().items()) for x in pair])
    found = F.filter(F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())
    both = whole.select("doc_id", "license", found.alias("notices"))
    names = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("license"), F.col("notices")), lambda x: x.isNotNull())))
    return both.select("doc_id", "license", F.size("notices").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licenses"))


def oracle_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canon(column: str) -> str:
        t = f"translate({column}, '{UPPER}', '{LOWER}')"
        for pattern, new in STEPS:
            new = "chr(10)" if new == "\n" else quote(new)
            t = f"regexp_replace({t}, {quote(pattern)}, {new}, 'g')"
        return t

    values = ", ".join(f"('{d}', '{k}')" for d, k in sorted(known_digests().items()))
    return f"""
WITH known(digest, known) AS (VALUES {values}),
rows_ AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN regexp_matches(text, '{ANCHORS}') THEN text END AS text FROM documents),
whole AS (SELECT r.rid, k.known FROM rows_ r JOIN known k ON sha256({canon("r.text")}) = k.digest),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rows_),
hits AS (SELECT l.rid, k.known FROM lines l JOIN known k ON regexp_matches(l.line, '{ANCHORS}') AND sha256({canon("l.line")}) = k.digest)
SELECT r.doc_id, (SELECT known FROM whole w WHERE w.rid = r.rid) AS license,
  (SELECT COUNT(*) FROM hits h WHERE h.rid = r.rid) AS n_notices,
  COALESCE((SELECT string_agg(known, ',' ORDER BY known) FROM (SELECT DISTINCT known FROM (SELECT rid, known FROM hits UNION ALL SELECT rid, known FROM whole) x WHERE x.rid = r.rid)), '') AS licenses
FROM rows_ r"""
