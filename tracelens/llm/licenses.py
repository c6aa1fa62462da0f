"""License scans by canonical digests: a text is a licence if its canonical form is that of a known one.

The canonical form is lower case, without copyright statements, with equivalent spellings made one and
anything but letters and digits as one space.  Whole texts, each line of them as a text of its own (a
notice), and the passages that begin as a known licence does and have its length are hashed and joined to the
digests of the known licences.  Everything is a DataFrame expression.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices, and the texts of licences that are short enough to be given here.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _ISC + ". " + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.replace("OR COPYRIGHT HOLDERS ", "") + " For more information, please refer to <http://unlicense.org/>"),
]

#: Identifiers that lines with the SPDX tag name.
IDENTIFIERS = (
    "0BSD AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 "
    "BlueOak-1.0.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.1 EUPL-1.2 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC JSON LGPL-2.0-only "
    "LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OLDAP-2.8 OSL-3.0 "
    "OpenSSL PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
TAG = "SPDX-License-Identifier:"
#: A licence alone has the id of its text; "or later" is one of its own.
KNOWN += [(i.removesuffix("-only"), f"{TAG} {i}") for i in IDENTIFIERS if (i.removesuffix("-only"), f"{TAG} {i}") not in KNOWN]
TAG_FORM = "spdx license identifier "

#: How whole texts are headed, by id; and the address line that the GNU texts have had.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "UNLICENSE"],
}
TEXTS = Path(__file__).parent / "license_texts"
ADDRESS = r"(?m)^ *51 Franklin Street, Fifth Floor, Boston, MA  ?02110-1301,? +USA *$"
ADDRESSES = ["", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA"]
#: What follows the terms in some copies only: how to apply them.
APPENDIX = r"(?m)^ *(END OF TERMS AND CONDITIONS|ADDENDUM: How to use this License|EXHIBIT A -Mozilla|Exhibit A - Source Code Form) ?.*$"


@cache
def catalogue() -> list[tuple[str, str]]:
    """KNOWN, and (license_id, text) of the usual forms of whole texts: titles, list markers, with and without an appendix."""
    out = list(KNOWN)
    for name, text in KNOWN:
        if len(text) < 200:
            continue
        marked = [text]
        if "1. " in text:  # numbered, lettered, or with bullets
            marked += [re.sub(r"\b([123])\. (?=[RN])", lambda m: f"{'abc'[int(m[1]) - 1]}. ", text), re.sub(r"\b[123]\. (?=[RN])", "* ", text)]
        out += [(name, f"{title}\n{t}") for t in marked for title in ["", *TITLES[name]]]
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text()
        heads = [text] + [re.sub(ADDRESS, a, text, count=1) for a in ADDRESSES if re.search(ADDRESS, text)]
        for t in heads:
            m = re.search(APPENDIX, t)
            out += [(path.stem, x) for x in ([t, t[: m.start()], t[: m.start()] + m[1]] if m else [t])]
        if path.stem in TITLES:
            out += [(path.stem, f"{title}\n{text}") for title in TITLES[path.stem]]
    return out


#: A line that only says whose the copyright is (as the query's SQL has it), and spellings that count as one.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("https", "http"), ("copyright owner", "copyright holder")]
#: Such a statement alone: it ends before a licence notice on its line, and a line of running text that begins with the word is none.
STATEMENT = (
    r"(?m)^[^a-z0-9\n]*(?:copyright(?![a-z])(?![^a-z0-9\n]*(?:holders?|owners?|notices?|laws?|licen[cs]es?|statements?|disclaimers?|line|also|on|in|is|and|or|to|as)\b)"
    r"|\(c\)(?!\s+(?:you|if|under|representations|the licen[cs]es?)\b)|©|all rights reserved)[^\n]*?"
    r"(?=$|[^\p{L}\p{N}\n]+(?:licen[cs]ed under|released under|distributed under|this work is|this software is|this program is|permission is|permission to|redistribution and|spdx-license-identifier))"
)


def _plain(text: Column) -> Column:
    """Lower case, without copyright statements, and anything but letters, digits and line feeds as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), STATEMENT, " "), r"[^\p{L}\p{N}\n]+", " ")


def _spelled(plain: Column) -> Column:
    for have, want in SPELLINGS:
        plain = F.replace(plain, F.lit(have), F.lit(want))
    return plain


def _joined(plain: Column) -> Column:
    return F.trim(_spelled(F.regexp_replace(plain, r"[ \n]+", " ")))


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    return _joined(_plain(text))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, digest of known, or of the catalogue: one row a digest (of ids that share one, the first by code point)."""
    known = catalogue() if known is None else known
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known])).alias("k")).select("k.*")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


#: Characters of a form from which on a licence is looked for inside texts too, and of its opening.
LONG, OPENING = 200, 40


def known_spots(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> list[tuple[str, int]]:
    """(opening, length) of the long canonical forms of known, or of the catalogue (a fixed table of some hundred rows).

    A form that ends in another one (it has a title in front) is left out: whoever holds it holds the other.
    An opening is as long as it must be to occur in the forms at their beginnings only.
    """
    known = catalogue() if known is None else known
    rows = spark.createDataFrame([(t,) for _, t in known], "text string").select(canonical(F.col("text")).alias("form")).distinct()
    forms = sorted(r.form for r in rows.filter(F.length("form") >= LONG).collect())
    forms = [f for f in forms if not any(f != g and f.endswith(" " + g) for g in forms)]
    spots = set()
    for f in forms:
        size = next((n for n in range(OPENING, len(f)) if not any(" " + f[:n] in g for g in forms)), len(f))
        spots.add((f[:size], len(f)))
    return sorted(spots)


def _passages(form: Column, spots: list[tuple[str, int]]) -> Column:
    """Digests of the passages of a form that begin as a known one and have its length; the form is cut at each opening, so its work is linear."""
    if not spots:
        return F.array().cast("array<string>")
    parts = F.split(form, "(?<![^ ])(?=(?:" + "|".join(sorted({o for o, _ in spots})) + "))")
    at = F.array(*[F.struct(F.lit(o).alias("opening"), F.lit(n).alias("n")) for o, n in spots])
    fits = lambda p, s: F.startswith(p, s["opening"]) & F.substring(F.concat(p, F.lit(" ")), s["n"] + 1, F.lit(1)).eqNullSafe(" ")
    each = F.transform(F.filter(parts, lambda p: F.length(p) >= LONG), lambda p: F.transform(F.filter(at, lambda s: fits(p, s)), lambda s: F.sha2(F.substring(p, F.lit(1), s["n"]), 256)))
    return F.array_distinct(F.flatten(each))


def _tagged(line: Column) -> Column:
    """The forms that a line's form stands for: itself, or, of an SPDX expression, each licence alone with the tag, without exceptions."""
    expression = F.replace(F.substring(line, F.lit(len(TAG_FORM) + 1), F.length(line)), F.lit(" or later"), F.lit("\1"))  # the "or" of a name is none
    alone = F.transform(F.split(expression, " (?:or|and) ", -1), lambda x: F.concat(F.lit(TAG_FORM), F.replace(F.regexp_replace(x, " with .*$", ""), F.lit("\1"), F.lit(" or later"))))
    return F.when(F.startswith(line, F.lit(TAG_FORM)), alone).otherwise(F.array(line))


def scan(docs: DataFrame, known: DataFrame | None = None, spots: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, digest, license_id, notices for each row of docs(doc_id, text).

    digest: of the whole canonical text (null if the text is null or its form is empty); license_id: the
    known licence with that digest, or null; notices: ids of the licences that single lines are and that the
    text holds whole (spots says where such may begin and end; by default those of the catalogue), in order, with
    commas, or empty.  Rows with equal ids are documents each.  A text is brought to its form once; Spark
    joins by hash and broadcasts the known digests only while they are small.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    spots = spots if spots is not None else known_spots(docs.sparkSession)
    plain = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _plain(F.col("text").cast("string")).alias("plain"))
    forms = plain.select("doc_id", "row", _joined(F.col("plain")).alias("form"), F.transform(F.split(_spelled(F.col("plain")), "\n"), lambda x: F.trim(x)).alias("lines"))
    single = F.flatten(F.transform(F.filter("lines", lambda x: x != ""), _tagged))
    lines = F.array_distinct(F.transform(single, lambda x: F.sha2(x, 256)))
    whole = F.struct(F.when(F.col("form") != "", F.sha2("form", 256)).alias("d"), F.lit(True).alias("whole"))
    parts = F.array_union(F.coalesce(lines, F.array().cast("array<string>")), F.coalesce(_passages(F.col("form"), spots), F.array().cast("array<string>")))
    each = F.concat(F.array(whole), F.coalesce(F.transform(parts, lambda d: F.struct(d.alias("d"), F.lit(False).alias("whole"))), F.array().cast("array<struct<d: string, whole: boolean>>")))
    found = forms.select("doc_id", "row", F.explode(each).alias("e")).select("doc_id", "row", "e.*").join(known, F.col("d") == F.col("digest"), "left")
    found = found.filter(F.col("whole") | F.col("license_id").isNotNull()).groupBy("row", "doc_id")
    return found.agg(
        F.max(F.when(F.col("whole"), F.col("d"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
    ).drop("row")


def oracle() -> str:
    """The query's rows over `documents` as DuckDB SQL: the whole catalogue, looked for in all texts, and whole copyright lines cut."""

    def form(x: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        for have, want in SPELLINGS:
            out = f"replace({out}, '{have}', '{want}')"
        return f"trim({out})"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in catalogue())
    return f"""
WITH forms AS MATERIALIZED (SELECT license_id, {form('text')} AS form FROM (VALUES {rows}) AS v(license_id, text)),
known AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM forms GROUP BY 1),
whole AS (SELECT doc_id, CASE WHEN {form('text')} <> '' THEN sha256({form('text')}) END AS digest FROM documents),
whole_lines AS (SELECT doc_id, {form('line')} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
lines AS (SELECT doc_id, CASE WHEN starts_with(form, '{TAG_FORM}') THEN '{TAG_FORM}' || replace(regexp_replace(part, ' with .*$', ''), chr(1), ' or later') ELSE form END AS form
          FROM (SELECT doc_id, form, unnest(CASE WHEN starts_with(form, '{TAG_FORM}') THEN regexp_split_to_array(replace(substr(form, {len(TAG_FORM) + 1}), ' or later', chr(1)), ' (or|and) ') ELSE [form] END) AS part FROM whole_lines)),
held AS (SELECT DISTINCT license_id, ' ' || form || ' ' AS form FROM forms WHERE length(form) >= {LONG}),
texts AS (SELECT doc_id, ' ' || {form('text')} || ' ' AS form FROM documents),
hits AS (SELECT doc_id, k.license_id FROM lines JOIN known k ON sha256(form) = k.digest WHERE form <> ''
         UNION SELECT doc_id, h.license_id FROM texts t JOIN held h ON contains(t.form, h.form)),
notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM hits GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
"""
