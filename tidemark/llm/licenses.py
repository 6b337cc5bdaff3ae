"""License scans by canonical digests, in DataFrame expressions only.

A text is brought to a canonical form (case, copyright lines, punctuation and white space, equivalent spellings) and the
digest of the whole form is looked up among the digests of known license texts, brought to the same form by the same
expression. Known one-line notices are found the same way, line by line inside the row.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.license_digests import DIGESTS

# --- fixed values: public license texts and notices, and equivalent spellings ---

_PERMIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated \
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the \
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit \
persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED \
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS \
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR \
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby \
granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE \
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, \
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER \
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE \
OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the \
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following \
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following \
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products \
derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, \
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE \
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, \
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; \
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN \
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS \
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: (license id, whole text).
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", _PERMIT + """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the \
Software.

""" + _AS_IS),
    ("MIT", """MIT License

""" + _PERMIT + """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the \
Software.

""" + _AS_IS),
    ("MIT-0", """MIT No Attribution

""" + _PERMIT + ".\n\n" + _AS_IS),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all "
     "copies.\n\n" + _ISC_END),
    ("0BSD", _ISC + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _BSD_NAME + _BSD_END),
)

#: (license id, one line).
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
)

_REGENTS = (_BSD + _BSD_NAME + _BSD_END).replace("copyright holder nor", "University nor").replace(
    "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held \
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it \
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you \
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Whole texts besides TEXTS, which the DuckDB twin holds alone.
MORE_TEXTS: tuple[tuple[str, str], ...] = (
    ("BSD-3-Clause", _REGENTS), ("Zlib", _ZLIB),
    ("ISC", _ISC.replace("and/or", "and") + ", provided that the above copyright notice and this permission notice appear in all "
     "copies.\n\n" + _ISC_END),
)

#: License id -> names it goes by. A text may stand under each of them, and notices may give each.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT License (MIT)", "MIT/Expat License", "MIT", "Expat License", "X11 License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"),
    "ISC": ("ISC License", "ISC License (ISC)", "ISC License (ISCL)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "Zero-Clause BSD", "0BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License', "Simplified BSD License",
                     "2-Clause BSD License", "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
                     "Modified BSD License", "Revised BSD License", "3-Clause BSD License", "BSD License"),
    "Zlib": ("zlib License", "zlib/libpng License", "zlib"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "Artistic-1.0-Perl": ("Artistic License 1.0 (Perl)",),
    "CC0-1.0": ("Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal", "CC0 1.0", "CC0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "GFDL-1.2": ("GNU Free Documentation License, version 1.2", "GFDL 1.2"),
    "GFDL-1.3": ("GNU Free Documentation License, version 1.3", "GFDL 1.3"),
    **{f"{short}-{v}": (f"GNU {long}, version {v}", f"GNU {long} v{v}", f"GNU {short} v{v}", f"{short} v{v}", f"{short}-{v}",
                        *((f"GNU {long}, version {v[0]}", f"GNU {long} v{v[0]}", f"GNU {short} v{v[0]}", f"{short} v{v[0]}",
                           f"{short}v{v[0]}") if v.endswith(".0") else ()))
       for short, long, versions in (("GPL", "General Public License", ("1.0", "2.0", "3.0")),
                                     ("LGPL", "Library General Public License", ("2.0",)),
                                     ("LGPL", "Lesser General Public License", ("2.1", "3.0")),
                                     ("AGPL", "Affero General Public License", ("3.0",))) for v in versions},
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1", "MPL-1.1"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0",
                "MPL-2.0"),
}
_SAID = ("Released under the {}", "Licensed under the {}", "Distributed under the {}", "This work is licensed under the {}",
         "This project is licensed under the {}", "This software is licensed under the {}", "Released under {}", "Licensed under {}")

#: (spelling, its equivalent), applied in this order to text in lower case whose words are parted by one space.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("whilst", "while"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
)

#: The copyright line of the DuckDB twin: the sign or word, then a sign, year or placeholder; or a reservation of rights.
COPYRIGHT_LINE = (r"(^|\n)[ \t*#/;-]*((copyright|\(c\)|©)[ \t]*(\(c\)|©)?[ \t]*[0-9<{\[][^\n]*|all rights reserved[^\n]*)")
#: Words after "copyright" in the licenses' own sentences, and words that begin a list's item (c).
_OWN = (r"(?:notices?|holders?|owners?|ownership|licen[sc]e[sd]?|laws?|statements?|interests?|status|treat(?:y|ies)|disclaimers?|"
        r"permissions?|protections?|infringements?|claims?|requirements?|conditions?|lines?|works?|attributions?|information|years?|"
        r"rights?|policy|doctrines?|terms?|acts?|materials?|resulting|and|or|in|of|is|are|on|to|as|for|that|this|which|under|with|has|have|if|it|"
        r"its|may|must|shall|will|can|does|not|at|from|the[ \t]+(?:software|library|program|work|document|covered))\b")
_ITEM = (r"(?:you|your|the|any|if|in|under|a|an|to|for|of|on|by|as|at|or|and|that|this|these|those|such|each|every|no|not|all|it|its|"
         r"is|are|be|may|must|shall|will|when|where|with|without|within|notwithstanding|permits?|prohibits?|affirmer|representations?)\b")
_BODY = r"\b(?:(?:19|20)[0-9]{2}|inc|corp|corporation|company|ltd|llc|gmbh|foundation|authors|contributors)\b"
#: A copyright line: an optional comment leader and "portions", then the word or sign and a holder or year; or one that
#: begins with a reservation of rights.
HOLDER_LINE = (
    r"(^|\n)[ \t*#/;%!<>|.\"'-]*(?:(?:dnl|rem)[ \t]+)?(?:(?:some[ \t]+)?portions[ \t]+(?:are[ \t]+)?)?"
    r"(?:copyright[ \t]*(?:\(c\)|©|:|[0-9<{\[])[^\n]*|copyright[ \t]+(?!" + _OWN + r")[\p{L}\"'][^\n]*|©[^\n]*"
    r"|\(c\)[ \t]*(?:\(c\)|©|copyright|[0-9<{\[])[^\n]*|\(c\)[ \t]+(?!" + _ITEM + r")(?:[^\n]*" + _BODY +
    r"[^\n]*|[^ \t\n]+(?:[ \t]+[^ \t\n]+){0,3}[ \t\r]*(?=\n|$))|all rights reserved[^\n]*)")
#: A line that ends with a reservation of rights, as the second line of a long holder.
RESERVED = "all rights reserved"
RESERVED_LINE = r"(^|\n)[^\n]*" + RESERVED + r"[ \t\r.!*#/;-]*(?=\n|$)"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
LINE_ENDS = r" ?\n ?"

# --- end of fixed values ---


def _titled(texts: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """The texts as they are, and without a title and under each name of their license."""
    out = dict.fromkeys(texts)
    for k, text in texts:
        bare = next((text.removeprefix(n + "\n\n") for n in NAMES.get(k, ()) if text.startswith(n + "\n\n")), text)
        out |= dict.fromkeys([(k, bare), *((k, f"{the}{n}\n\n{bare}") for n in NAMES.get(k, ()) for the in ("", "The "))])
    return tuple(out)


def _said() -> tuple[tuple[str, str], ...]:
    """Notice lines with the names of licenses; of a name that several have, the first's."""
    lines = {say.format(n): k for k, names in reversed(NAMES.items()) for n in names if n != "BSD License" for say in _SAID}
    gnu = {f"SPDX-License-Identifier: {k}{end}": k for k in NAMES for end in ("", "-only", "-or-later", "+") if not end or "GPL-" in k or "GFDL-" in k}
    return tuple((k, line) for line, k in (lines | gnu).items())


#: What ``scan`` knows.
KNOWN_TEXTS = _titled(TEXTS + MORE_TEXTS)
KNOWN_NOTICES = tuple(dict.fromkeys(NOTICES + _said()))


def canonical_lines(text: Column) -> Column:
    """Canonical form of ``text`` with its lines kept apart."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, HOLDER_LINE, "\n")
    x = F.when(F.contains(x, F.lit(RESERVED)), F.regexp_replace(x, RESERVED_LINE, "\n")).otherwise(x)
    x = F.regexp_replace(x, PUNCTUATION, " ")
    return F.regexp_replace(x, LINE_ENDS, "\n")


def one_spelling(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical(text: Column) -> Column:
    """Canonical form of a whole text: its words in one spelling, parted by one space."""
    return _whole(canonical_lines(text))


def _whole(lines: Column) -> Column:
    return one_spelling(F.trim(F.regexp_replace(lines, r"\n+", " ")))


def _table(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """(license, text) of the pairs, in one literal: thousands of them are slow to plan."""
    rows = json.dumps([{"license": k, "text": t} for k, t in pairs])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<license: string, text: string>>")))


def _known(spark: SparkSession, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(license, form) of the given texts, made by the engine's own expressions."""
    return _table(spark, pairs).select("license", canonical(F.col("text")).alias("form")).distinct()


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = KNOWN_TEXTS, notices: tuple[tuple[str, str], ...] = KNOWN_NOTICES,
         digests: dict[str, tuple[str, ...]] = DIGESTS) -> DataFrame:
    """One row per document: doc_id, canonical_sha256, license (whole text; null: unknown), notices (sorted license ids
    of its notice lines, joined by commas; empty: none). ``digests`` are of canonical forms, beside those of ``texts``.

    Null texts count as empty and match nothing; repeated rows get a row each; extra columns are left behind. The known
    digests are a parameter, so their table is small whatever the corpus; it is the broadcast side.
    """
    spark = docs.sparkSession
    known = _known(spark, texts).where("form <> ''").select("license", F.sha2("form", 256).alias("canonical_sha256"))
    known = known.union(_table(spark, ((k, x) for k, d in digests.items() for x in d)))
    known = known.groupBy("canonical_sha256").agg(F.min("license").alias("license"))
    # The notices are a parameter too: their few canonical forms become a literal map.
    forms = {r["form"]: r["license"] for r in _known(spark, notices).orderBy("license").collect()}
    by_form = F.str_to_map(F.lit("\x01".join(f"{f}\x02{k}" for f, k in forms.items())), F.lit("\x01"), F.lit("\x02"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text").cast("string")).alias("x"))
    lines = F.transform(F.split("x", "\n"), lambda s: one_spelling(F.trim(s)))
    named = F.transform(F.array_intersect(lines, F.map_keys(by_form)), lambda s: by_form[s])
    return (rows
            .select("doc_id", F.sha2(_whole(F.col("x")), 256).alias("canonical_sha256"),
                    F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notices"))
            .join(F.broadcast(known), "canonical_sha256", "left")
            .select("doc_id", "canonical_sha256", "license", "notices"))


def sql() -> str:
    """The DuckDB twin of ``scan`` with TEXTS and NOTICES alone; of the copyright lines it drops only those of COPYRIGHT_LINE."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), {q(COPYRIGHT_LINE)}, chr(10), 'g')"
        x = f"regexp_replace({x}, {q(PUNCTUATION)}, ' ', 'g')"
        return f"regexp_replace({x}, {q(LINE_ENDS)}, chr(10), 'g')"

    def spelling(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, {q(a)}, {q(b)})"
        return x
    whole = lambda x: spelling(f"trim(regexp_replace({x}, '\\n+', ' ', 'g'), ' ')")
    values = lambda pairs: ", ".join(f"({q(k)}, {q(t)})" for k, t in pairs)
    return f"""
WITH known AS (SELECT sha256({whole(lines('t'))}) AS d, min(l) AS license
               FROM (VALUES {values(TEXTS)}) v(l, t) GROUP BY 1),
     notice AS (SELECT DISTINCT l, {whole(lines('t'))} AS form FROM (VALUES {values(NOTICES)}) v(l, t)),
     x AS (SELECT row_number() OVER () AS k, doc_id, {lines('text')} AS x FROM documents),
     line AS (SELECT k, unnest(string_split(x, chr(10))) AS s FROM x),
     hit AS (SELECT k, array_to_string(list_sort(list_distinct(list(l))), ',') AS notices
             FROM line JOIN notice ON {spelling("trim(s, ' ')")} = form GROUP BY k),
     w AS (SELECT k, doc_id, sha256({whole('x')}) AS canonical_sha256 FROM x)
SELECT doc_id, canonical_sha256, license, coalesce(notices, '') AS notices
FROM w LEFT JOIN known ON known.d = w.canonical_sha256 LEFT JOIN hit USING (k)"""
