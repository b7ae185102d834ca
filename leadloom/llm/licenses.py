"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is put in canonical form (lower case, copyright lines cut, punctuation and white space as
single spaces, equivalent spellings made one) and its SHA-256 is joined with the digests of
known licence texts, in the same form. Whole texts must agree; a mention is no match.

Defined results: a null or empty text, and one of copyright lines and punctuation alone, has no
licence; repeated rows and null ids get their own row; two known texts of one canonical form count
as the one whose name is least; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

# Spellings that count as one, after punctuation has gone. Parts of words are replaced too, on both sides.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"),
    ("behaviour", "behavior"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"), ("catalogue", "catalog"),
    ("categoris", "categoriz"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasis", "emphasiz"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("fulfil ", "fulfill "), ("https ", "http "), ("initialis", "initializ"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"), ("optimis", "optimiz"),
    ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
]
COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright[ \t:,]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*[0-9]|©)[^\n]*"
RESERVED = r"(^|\n)[ \t*#/;-]*all rights reserved"
#: ASCII punctuation, white space, and the quotes, dashes, bullets and spaces of typesetting.
PUNCTUATION = r"[!-/:-@\[-`{-~ \t\n\x0b\f\r" + " «·»‐-―‘-‟•…]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _bsd(clauses: list[str], numbered: bool) -> str:
    return _BSD_HEAD + "".join(f"{i}. {c}" if numbered else f"* {c}" for i, c in enumerate(clauses, 1)) + _BSD_REST


_GRANTS = ", provided that the above copyright notice and this permission notice appear in all copies.\n"
# Short public licences, each with its usual titles. A user's own catalogue is a table of (name, text).
_TITLED = [
    ("MIT", _MIT, ["MIT License", "The MIT License (MIT)", "The MIT License"]),
    ("ISC", _ISC_GRANT + _GRANTS + _ISC_REST, ["ISC License", "The ISC License"]),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_REST, ["BSD Zero Clause License", "Zero-Clause BSD"]),
    ("BSL-1.0", _BSL, ["Boost Software License - Version 1.0 - August 17th, 2003"]),
    ("Unlicense", _UNLICENSE, ["The Unlicense"]),
    ("Zlib", _ZLIB, ["zlib License", "The zlib License"]),
    ("Apache-2.0-header", _APACHE_HEADER, []),
    ("MPL-2.0-header", _MPL_HEADER, []),
    *(("BSD-2-Clause", _bsd([_BSD_SOURCE, _BSD_BINARY], n), ["BSD 2-Clause License", "The 2-Clause BSD License"]) for n in (True, False)),
    *(("BSD-3-Clause", _bsd([_BSD_SOURCE, _BSD_BINARY, _BSD_NAMES], n), ["BSD 3-Clause License", "The 3-Clause BSD License"]) for n in (True, False)),
]
KNOWN = [(name, text) for name, plain, titles in _TITLED for text in (plain, *(f"{t}\n{plain}" for t in titles))]
# Digests of the canonical forms of long public licences, as published: whole, and where a second one
# stands the terms alone, without what follows them on how to apply them.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("BSD-3-Clause-UC", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
]


def canonical(text: Column) -> Column:
    form = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    form = F.trim(F.regexp_replace(F.regexp_replace(form, RESERVED, "\n"), PUNCTUATION, " "))
    for other, one in SPELLINGS:
        form = F.replace(form, F.lit(other), F.lit(one))
    return form


def digest(text: Column) -> Column:
    """The SHA-256 of the canonical form, null if that is empty."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def digests(known: DataFrame) -> DataFrame:
    """license, _digest of a catalogue (name, text)."""
    return known.where("name IS NOT NULL").select(F.col("name").alias("license"), digest(F.col("text")).alias("_digest"))


def catalogue(spark: SparkSession) -> DataFrame:
    """license, _digest of the licences that are known by default."""
    return digests(spark.createDataFrame(KNOWN, "name string, text string")).union(spark.createDataFrame(DIGESTS, "license string, _digest string"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license (null if none is known) of every row. known: name, text; by default catalogue()."""
    found = catalogue(docs.sparkSession) if known is None else digests(known)
    names = found.where("_digest IS NOT NULL").groupBy("_digest").agg(F.min("license").alias("license"))
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), digest(whole_text(text_col)).alias("digest"))
    return own.join(names, F.col("digest") == F.col("_digest"), "left").select("doc_id", "digest", "license")


def scan_sql() -> str:
    """The same as DuckDB SQL over documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(t), {quoted(COPYRIGHT)}, chr(10), 'g'), {quoted(RESERVED)}, chr(10), 'g'), {quoted(PUNCTUATION)}, ' ', 'g'))"
    for other, one in SPELLINGS:
        form = f"replace({form}, '{other}', '{one}')"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    more = ", ".join(f"({quoted(n)}, {quoted(d)})" for n, d in DIGESTS)
    return f"WITH known AS (SELECT digest, min(name) AS license FROM (SELECT name, sha256(nullif({form}, '')) AS digest FROM (VALUES {values}) v(name, t) UNION ALL SELECT * FROM (VALUES {more}) w(name, digest)) GROUP BY 1), own AS (SELECT doc_id, sha256(nullif({form}, '')) AS digest FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) SELECT doc_id, own.digest AS digest, license FROM own LEFT JOIN known ON own.digest = known.digest"
