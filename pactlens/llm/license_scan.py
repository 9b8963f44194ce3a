"""Licence scan by canonical digests, in DataFrame functions alone.

A text is normalised (lower case; lines of copyright notices dropped; equivalent
spellings unified; everything but letters and digits to one blank) and its SHA-256 is
hash-joined to the digests of known licences, which are normalised by the same
expressions. The known table is part of this module, so its size is fixed and it is
broadcast. Whole texts are joined; besides, single lines with a licence word are looked
up as notices of their own, since a document may carry a one-line notice.

Edges: a null text has a null digest and no licence; a text that is empty after
normalisation matches nothing; texts of any length are read whole; all rows stay, each
once. Output columns are named anew, so clashing input columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, after lower-casing; fixed values of the licence matching rules.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("http:", "https:"),
]
#: A line that names a holder: the word or sign, then a sign, a year or a place for one.
COPYRIGHT = "(^|\n)[ \t*#/;-]*((copyright|\\(c\\)|©)[ \t]*(\\(c\\)|©|[0-9]{4}|[<\\[{])|all rights reserved)[^\n]*"
NOTICE = "licen[sc]e|public domain|spdx"

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."

_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")

#: (licence, text): known texts and one-line notices; fixed values.
KNOWN = [
    ("MIT", _MIT + _AS_IS),
    ("MIT", "MIT License\n\n" + _MIT + _AS_IS),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT + _AS_IS),
    ("ISC", _ISC + "\n\n" + _AUTHOR),
    ("ISC", "ISC License\n\n" + _ISC + "\n\n" + _AUTHOR),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + "\n\n" + _AUTHOR),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]


#: (licence, digest of its canonical form) of long licences as they are published, whole
#: and without the appendix on how to apply them; fixed values.
DIGESTS = [
    ("Apache-2.0", "7dc0ccfedfe9cf9e59c97a3e43eea7b035a0e7a7be84d714acef36eb5c9fb4bc"),
    ("Apache-2.0", "4f14b6cbdd362d5a6d1023eaee7538d57a6c9271c5e1de4bdc60e02a182c0730"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.2", "925dba96dda1b00cd8ff146661df40b6b2a302af5bf2f1243976eddb6d5a8450"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GFDL-1.3", "0cb0736777286efc71748df95c0748e42cbf34246d31f42e488fded6114061ce"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
]


def normalise(text: F.Column) -> F.Column:
    """The canonical form of a text."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    for spelling, unified in SPELLINGS:
        x = F.replace(x, F.lit(spelling), F.lit(unified))
    return F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " "))


def digest(text: F.Column) -> F.Column:
    return F.sha2(normalise(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(known_digest, license_id), one row for each digest."""
    rows = spark.createDataFrame(KNOWN, "license_id string, text string").select("license_id", digest(F.col("text")).alias("known_digest"))
    rows = rows.unionByName(spark.createDataFrame(DIGESTS, "license_id string, known_digest string"))
    return rows.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_digest, license_id, notices): ``license_id`` if the whole text is a
    known licence, ``notices`` the sorted ids of notice lines joined by commas."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(NOTICE))
    of_line = F.transform(lines, digest)
    wide = src.select("doc_id", digest(F.col("text")).alias("text_digest"), of_line.alias("line_digests"))
    known = F.broadcast(known_licenses(spark))
    joined = wide.join(known.withColumnRenamed("known_digest", "text_digest"), "text_digest", "left")
    # for the few lines with a licence word: the same table as one map
    all_known = known_licenses(spark).agg(F.map_from_entries(F.collect_list(F.struct("known_digest", "license_id"))).alias("by_digest"))
    found = F.filter(F.transform("line_digests", lambda d: F.try_element_at("by_digest", d)), lambda x: x.isNotNull())
    return joined.join(F.broadcast(all_known), F.lit(True)).select("doc_id", "text_digest", "license_id", F.coalesce(F.array_join(F.array_sort(F.array_distinct(found)), ","), F.lit("")).alias("notices"))


# --- the same in SQL -----------------------------------------------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql(text: str) -> str:
    x = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT)}, '\\1', 'g')"
    for spelling, unified in SPELLINGS:
        x = f"replace({x}, {_quoted(spelling)}, {_quoted(unified)})"
    return f"sha256(trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


def oracle() -> str:
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)
    digests = ", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in DIGESTS)
    return f"""
WITH known AS (SELECT d, min(l) AS license_id FROM (SELECT l, {_sql("t")} AS d FROM (VALUES {values}) AS v(l, t) UNION ALL FROM (VALUES {digests}) AS w(l, d)) GROUP BY d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notices AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM lines JOIN known ON {_sql("line")} = known.d
  WHERE regexp_matches(lower(line), {_quoted(NOTICE)}) GROUP BY doc_id)
SELECT x.doc_id, x.text_digest, known.license_id, coalesce(notices.notices, '') AS notices
FROM (SELECT doc_id, {_sql("text")} AS text_digest FROM documents) AS x
LEFT JOIN known ON known.d = x.text_digest LEFT JOIN notices ON notices.doc_id = x.doc_id"""
