"""License scans: canonical digests of entire texts, joined to those of known licences.

A text is brought to a canonical form: A to Z lower-cased, copyright lines, title lines and list marks dropped,
equivalent spellings made one, everything but letters, digits and non-ASCII characters turned into single spaces. The
SHA-256 of that form is looked up in the table of known licences: short texts, which go through the same expression,
and the digests of long ones.

Defined results: a null or empty text, and one whose canonical form is empty, has the empty form's digest and
matches nothing; licences with equal digests are one match, the first by id; a null id is kept; repeated rows each
give a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_ids, table

#: Spellings that count as equal; fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("whilst", "while"),
    ("noninfringement", "non infringement"),
    ("copyright owner", "copyright holder"),
    ("http", "https"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|all rights reserved)[^\n]*$"
#: A line that only names a licence: "The MIT License (MIT)", "BSD 3-Clause License", "Apache License, Version 2.0".
TITLE_LINE = r"(?m)^[^a-z0-9\n]*(the )?([a-z0-9./-]+ ){1,4}(public )?licen[cs]e[^a-z0-9\n]*(mit|isc|v[0-9.]+|version [0-9.]+)?[^a-z0-9\n]*$"
LIST_MARK = r"(?m)^[ \t]*([0-9]{1,2}[.)]|[*-])[ \t]+"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Known licence texts and notices, by SPDX id; fixed values.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction
and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""),
    ("GPL-3.0-or-later-notice", """This program is free software: you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<http://www.gnu.org/licenses/>."""),
    ("MPL-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("MIT-line", "Released under the MIT License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
)

#: Digests of the canonical forms of longer licences, by SPDX id, as common distributions install their texts; fixed
#: values. They hold for the form as defined here; a test takes them anew from installed texts.
DIGESTS = (
    ("Apache-2.0", "c38546510d0ae836588aaafa4c88e273e6350e787a3492dc9a2678f4497f91aa"),
    ("Artistic-1.0-Perl", "5722e1b63156f48f0ac3e2562b963c676b831f1e389c11c8a23919d2786f237c"),
    ("CC0-1.0", "2106cd4f7c9f6d4a9e5f54c911e4ff372736db5467794e4b89bcea996afde21c"),
    ("GFDL-1.2", "800f324489fe7d17e8624dc7f9a018736312a8b2a43757339bc2642d64484365"),
    ("GFDL-1.3", "0a81db74699110ae6579ccf13bfd8d0777dd38fcb4dc523c4fb7d1f1de4e2abf"),
    ("GPL-1.0", "c3434328eecf0283175ce9cd0d8b7db38b21366c49c2cbee4711bdbc6cab8965"),
    ("GPL-2.0", "096aa55d08df651106503acec568430a8c45597b18b835e967fa4b22fbd537e9"),
    ("GPL-3.0", "4e3f32d5b2aa0a52b1694af5ec25d811cc38014c5db67d037a9fa9efa23584e2"),
    ("LGPL-2.0", "168366497dacf62d46d6aeacd13b2078109cfa3386db15a9c9afe0b36b8cec27"),
    ("LGPL-2.1", "516ac7ef67530b10e9cd463201b0ead0d49716084816311d0a57380c818d73f8"),
    ("LGPL-3.0", "46e8f5e2630160e274d98394410a40733c85d1769555299d1f5972d832873e0b"),
    ("MPL-1.1", "6fa7eea92dbd93243d62fffc96ed6499071e3a1210c26e053fd4e30d908b3e90"),
    ("MPL-2.0", "87e5fa1c1bf58cb97de6ab0b17a7664bc04d491d28f3cf38c5cdec2652453018"),
)


def spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    out = ascii_lower(F.coalesce(text, F.lit("")))
    for line in (COPYRIGHT_LINE, TITLE_LINE, LIST_MARK):
        out = F.regexp_replace(out, line, "")
    # each word has a space of its own on both sides, so that a spelling is replaced as a whole word, neighbours too
    out = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(out, PUNCTUATION, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(spaced(old)), F.lit(spaced(new)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIGESTS, "license_id string, digest string")


def scan(docs: DataFrame, licenses: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Per row: ``doc_id``, the ``digest`` of its canonical text and the ``license_id`` that it is, else null. Known
    are the ``licenses`` by their ``text`` and, where given, those by their ``digest``."""
    forms = licenses.select("license_id", canonical(F.col("text")).alias("form")).filter("form <> ''")
    known = forms.select("license_id", F.sha2("form", 256).alias("digest"))
    if digests is not None:
        known = known.union(digests.select("license_id", "digest"))
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return join_ids(docs.select("doc_id", digest(F.col("text")).alias("digest")), known, "digest", "left").select(
        "doc_id", "digest", "license_id"
    )


def op3_license_scans(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark), known_digests(spark))


def sql() -> str:
    """The scan in DuckDB's SQL."""

    def form(text: str) -> str:
        out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for pattern, to in ((COPYRIGHT_LINE, ""), (TITLE_LINE, ""), (LIST_MARK, ""), (PUNCTUATION, " ")):
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        out = f"' ' || replace(trim({out}), ' ', '  ') || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{spaced(old)}', '{spaced(new)}')"
        return f"trim(replace({out}, '  ', ' '))"

    rows = ", ".join("('{}', '{}')".format(k, text.replace("'", "''")) for k, text in KNOWN)
    more = ", ".join(map(repr, DIGESTS))
    return f"""
        WITH known AS (
            SELECT digest, min(k) AS license_id FROM (
                SELECT k, sha256({form('t')}) AS digest FROM (VALUES {rows}) v(k, t)
                UNION ALL SELECT k, digest FROM (VALUES {more}) v(k, digest)) GROUP BY 1),
        d AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents)
        SELECT doc_id, digest, license_id FROM d LEFT JOIN known USING (digest)"""
