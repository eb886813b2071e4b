"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences at full stops and line ends, and each is normalised
(lower case, every run of other characters than a-z and 0-9 one space).  Known
licence sentences become identifiers: a sentence is found whole, or cut by line
breaks (with comment marks, blank lines or a list mark before it) or by full stops
inside it; a copyright line is one with a year or "(c)", whatever its holder, and
sentences that name a holder are known with any.  The identifiers form a string
such as ``;apache-ref;~;all-rights;`` in which ``~`` marks other text between two
of them.  Rules are tried in order; each replaces its sequence of identifiers,
with titles, copyright lines and disclaimers beside it, by its licence, so a rule
listed later only sees what earlier rules left.

Texts without any of the words in ``KEY_WORDS`` hold no known sentence and are not cut.

Defined cases: a null or empty text has no sentences and gives empty results;
one row comes back per input row, repeated rows included; a licence found twice
is listed once; very long texts are cut and matched whole, without backtracking
over more than one sentence; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_or_empty

#: what stands for the name of a holder in a known sentence: up to twelve words
HOLDER = "holder"
#: identifier -> normalised sentences (public licence texts and notices)
SENTENCES: dict[str, list[str]] = {
    "copyright": ["copyright c 2020 holder"],
    "all-rights": ["all rights reserved"],
    "apache-title": ["apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004"],
    "apache-terms": ["terms and conditions for use reproduction and distribution"],
    "apache-you": ["licensed under the apache license version 2 0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache-law": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "mit-notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    ],
    "as-is": [
        "the software is provided as is without warranty of any kind",
        "this software is provided as is",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "no-claim": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-event": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "bsd-style": ["use of this source code is governed by a bsd style license that can be found in the license file"],
    "bsd-title": ["bsd 2 clause license", "bsd 3 clause license", "the 2 clause bsd license", "the 3 clause bsd license", "new bsd license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-advert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by holder"],
    "bsd-endorse": [
        "neither the name of holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the names of holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of holder may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-as-is": ["this software is provided by holder as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-event": ["in no event shall holder be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-event": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib-origin": ["the origin of this software must not be misrepresented you must not claim that you wrote the original software"],
    "zlib-credit": ["if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"],
    "zlib-altered": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "zlib-notice": ["this notice may not be removed or altered from any source distribution"],
    "boost-title": ["boost software license version 1 0 august 17th 2003", "boost software license version 1 0"],
    "boost-ref": ["distributed under the boost software license version 1 0"],
    "gpl3-title": ["gnu general public license version 3 29 june 2007"],
    "gpl2-title": ["gnu general public license version 2 june 1991"],
    "lgpl3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "agpl-title": ["gnu affero general public license version 3 19 november 2007"],
    "fsf-verbatim": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"],
    "gpl-more": ["see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"],
    "gpl-received": [
        "you should have received a copy of the gnu general public license along with this program",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "you should have received a copy of the gnu lesser general public license along with this program",
        "you should have received a copy of the gnu affero general public license along with this program",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
        "you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses",
        "you should have received a copy of the gnu lesser general public license along with this program if not see https www gnu org licenses",
    ],
    "gpl-not": ["if not see http www gnu org licenses", "if not see https www gnu org licenses"],
    "gpl-warranty": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "mpl-ref": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "mpl-copy": [
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ],
    "epl-ref": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "cc0-waived": ["to the extent possible under law the author has waived all copyright and related rights", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "public-domain": ["this work is in the public domain", "this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "wtfpl-title": ["do what the fuck you want to public license"],
}
_FREE = "this {work} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"
for _ident, _name, _version in (
    ("gpl-free", "general public license", "3"), ("gpl2-free", "general public license", "2"),
    ("lgpl3-free", "lesser general public license", "3"), ("lgpl21-free", "lesser general public license", "2 1"),
    ("agpl-free", "affero general public license", "3"),
):
    SENTENCES[_ident] = [_FREE.format(work=w, name=_name, version=_version) for w in ("program", "library", "software", "file")]
#: how a short notice refers to a licence, and the names of licences it refers to
_VERBS = (
    "licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this project is licensed under",
    "this software is licensed under", "this file is licensed under", "this code is licensed under", "this software is released under",
    "this project is released under", "licensed under the terms of", "distributed under the terms of",
)
_NAMES: dict[str, tuple[str, ...]] = {
    "apache-ref": ("the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license"),
    "mit-ref": ("the mit license",),
    "isc-ref": ("the isc license",),
    "bsd3-ref": ("the bsd 3 clause license", "the 3 clause bsd license"),
    "bsd2-ref": ("the bsd 2 clause license", "the 2 clause bsd license"),
    "bsd-ref": ("the bsd license",),
    "gpl3-ref": ("the gnu general public license version 3", "the gnu general public license v3", "the gnu gpl v3", "gpl 3 0"),
    "gpl2-ref": ("the gnu general public license version 2", "the gnu general public license v2", "the gnu gpl v2", "gpl 2 0"),
    "lgpl-ref": ("the gnu lesser general public license version 3", "the gnu lesser general public license v3"),
    "lgpl21-ref": ("the gnu lesser general public license version 2 1",),
    "agpl-ref": ("the gnu affero general public license version 3", "the gnu affero general public license v3"),
    "mpl-name": ("the mozilla public license 2 0",),
    "epl-name": ("the eclipse public license 2 0", "the eclipse public license version 2 0"),
    "cc0-ref": ("cc0 1 0", "cc0 1 0 universal"),
    "ccbysa-ref": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"),
    "ccbyncsa-ref": ("cc by nc sa 4 0", "a creative commons attribution noncommercial sharealike 4 0 international license"),
    "ccbyncnd-ref": ("cc by nc nd 4 0", "a creative commons attribution noncommercial noderivatives 4 0 international license"),
    "ccbync-ref": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"),
    "ccbynd-ref": ("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"),
    "ccby-ref": ("cc by 4 0", "a creative commons attribution 4 0 international license"),
}
for _ident, _names in _NAMES.items():
    SENTENCES[_ident] = [f"{v} {n}" for n in _names for v in _VERBS]
#: licences that a line "SPDX-License-Identifier: ..." may name
SPDX = (
    "MIT", "Apache-2.0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0",
    "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0",
)
for _name in SPDX:
    SENTENCES[f"spdx-{_name}"] = ["spdx license identifier " + re.sub("[^a-z0-9]+", " ", _name.lower())]
#: tried in this order: identifiers that must follow each other -> licence
RULES: list[tuple[tuple[str, ...], str]] = [
    (("apache-you", "apache-comply", "apache-copy"), "Apache-2.0"),
    (("mit-grant", "mit-notice", "as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant", "isc-as-is"), "0BSD"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source"), "BSD-1-Clause"),
    (("zlib-as-is", "zlib-event", "zlib-grant"), "Zlib"),
    (("zlib-grant", "zlib-origin"), "Zlib"),
    (("gpl-free", "gpl-warranty"), "GPL-3.0-or-later"),
    (("gpl2-free", "gpl-warranty"), "GPL-2.0-or-later"),
    (("lgpl3-free", "gpl-warranty"), "LGPL-3.0-or-later"),
    (("lgpl21-free", "gpl-warranty"), "LGPL-2.1-or-later"),
    (("agpl-free", "gpl-warranty"), "AGPL-3.0-or-later"),
    (("mpl-ref", "mpl-copy"), "MPL-2.0"),
    (("public-domain", "unlicense-anyone"), "Unlicense"),
    *(((f"spdx-{name}",), name) for name in SPDX),
    (("apache-title", "apache-terms"), "Apache-2.0"),
    (("apache-title",), "Apache-2.0"),
    (("apache-ref",), "Apache-2.0"),
    (("apache-you",), "Apache-2.0"),
    (("mit-ref",), "MIT"),
    (("isc-ref",), "ISC"),
    (("bsd3-ref",), "BSD-3-Clause"),
    (("bsd2-ref",), "BSD-2-Clause"),
    (("bsd-ref",), "BSD"),
    (("bsd-style",), "BSD"),
    (("boost-ref",), "BSL-1.0"),
    (("boost-title",), "BSL-1.0"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("gpl2-free",), "GPL-2.0-or-later"),
    (("lgpl3-free",), "LGPL-3.0-or-later"),
    (("lgpl21-free",), "LGPL-2.1-or-later"),
    (("agpl-free",), "AGPL-3.0-or-later"),
    (("gpl3-title",), "GPL-3.0"),
    (("gpl2-title",), "GPL-2.0"),
    (("lgpl3-title",), "LGPL-3.0"),
    (("lgpl21-title",), "LGPL-2.1"),
    (("agpl-title",), "AGPL-3.0"),
    (("gpl3-ref",), "GPL-3.0"),
    (("gpl2-ref",), "GPL-2.0"),
    (("lgpl-ref",), "LGPL-3.0"),
    (("lgpl21-ref",), "LGPL-2.1"),
    (("agpl-ref",), "AGPL-3.0"),
    (("mpl-ref",), "MPL-2.0"),
    (("mpl-name",), "MPL-2.0"),
    (("epl-ref",), "EPL-2.0"),
    (("epl-name",), "EPL-2.0"),
    (("cc0-ref",), "CC0-1.0"),
    (("cc0-waived",), "CC0-1.0"),
    (("ccbysa-ref",), "CC-BY-SA-4.0"),
    (("ccbyncsa-ref",), "CC-BY-NC-SA-4.0"),
    (("ccbyncnd-ref",), "CC-BY-NC-ND-4.0"),
    (("ccbync-ref",), "CC-BY-NC-4.0"),
    (("ccbynd-ref",), "CC-BY-ND-4.0"),
    (("ccby-ref",), "CC-BY-4.0"),
    (("public-domain",), "Public-Domain"),
    (("wtfpl-title",), "WTFPL"),
    # what no open licence stands beside
    (("copyright", "all-rights"), "Proprietary"),
    (("all-rights",), "Proprietary"),
]
#: identifiers that say nothing of their own next to a licence: before it, after it
BEFORE = ("copyright", "all-rights", "mit-title", "bsd-title")
AFTER = (
    "apache-terms", "apache-law", "apache-see", "as-is", "no-claim", "isc-as-is", "isc-event", "bsd-as-is", "bsd-event", "zlib-origin", "zlib-credit",
    "zlib-altered", "zlib-notice", "fsf-verbatim", "gpl-warranty", "gpl-more", "gpl-received", "gpl-not", "copyright", "unlicense-anyone",
)
#: licences that a training corpus may not take without asking
RESTRICTED = ("Proprietary", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
#: every known sentence has one of these in a word of it
KEY_WORDS = (
    "licen", "copyright", "rights", "software", "redistribut", "domain", "conditions", "warranty", "permi", "author", "notice", "gpl", "mozilla", "commons",
    "(?:^|[^a-z0-9])cc(?:0|[^a-z0-9])",
)

_SPLIT = r"[.!?]+[\x20\x09-\x0D]+|\n+"
#: before a piece: comment marks in letters, then the mark of a list; pieces stand between two bars each
_REMARK = r"(?:(?:rem|dnl)(?: |\|\|)){0,2}"
_GAP = rf"(?: |\|\|{_REMARK})"
_LIST_MARK = rf"{_REMARK}(?:(?:[0-9]{{1,2}}|[a-d]){_GAP})?"
_COPYRIGHT = r"(?:portions )?copyright (?:c(?: [^|]*)?|(?:by )?(?:19|20)[0-9][0-9][^|]*)"


def _in_pieces(sentence: str) -> str:
    words = sentence.split(" ")
    out = ""
    for k, word in enumerate(words):
        out += rf"(?:[a-z0-9]+{_GAP}){{0,11}}[a-z0-9]+" if word == HOLDER else word
        out += _GAP if k + 1 < len(words) else ""
    return out


def _known() -> dict[str, str]:
    """Sentence -> identifiers, several joined by ``;;``."""
    known = {text: name for name, texts in SENTENCES.items() if name != "copyright" for text in texts}
    # "(the License); you may not use" goes on in one sentence, wherever its line ends
    you, comply = "apache-you", "apache-comply"
    known[f"{SENTENCES[you][0]} {SENTENCES[comply][0]}"] = f"{you};;{comply}"
    return known


KNOWN = _known()
#: a piece or several that hold a known sentence; longer sentences are tried first
def _pattern() -> str:
    verbs, names = ("|".join(map(_in_pieces, sorted(x, key=len, reverse=True))) for x in (_VERBS, {n for x in _NAMES.values() for n in x}))
    others = sorted((s for s, name in KNOWN.items() if name not in _NAMES), key=lambda s: (-len(s), s))
    each = [*map(_in_pieces, others), f"(?:{verbs}){_GAP}(?:{names})", _COPYRIGHT]
    return rf"\|{_LIST_MARK}({'|'.join(each)})\|"


_PATTERN = _pattern()
_KEY_PATTERN = "|".join(KEY_WORDS)
_NAMED = sorted(s for s in KNOWN if f" {HOLDER}" in s)


def _rule_pattern(names: tuple[str, ...], licence: str) -> str:
    core = "".join(f";{n};" for n in names)
    if licence == "Proprietary":
        return f"(?:;copyright;)*{core}"
    before, after = ("|".join(x) for x in (BEFORE, AFTER))
    return f"(?:;(?:{before});)*{core}(?:;(?:{after});)*"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id, sentence_ids, licenses, n_sentences, n_unmatched, restricted)`` per document.

    ``sentence_ids`` and ``licenses`` are arrays in text order (licences without
    repeats); ``n_unmatched`` counts licence sentences that no rule took.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_or_empty(text_col)).alias("t"))
    pieces = F.array_remove(F.transform(F.split("t", _SPLIT), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), "")
    barred = F.concat(F.lit("|"), F.array_join(pieces, "||"), F.lit("|"))
    rows = rows.select("id", F.when(F.col("t").rlike(_KEY_PATTERN), barred).otherwise("").alias("t"))
    hit = F.col("t").rlike(_PATTERN)
    rows = rows.select(
        "id",
        F.when(hit, F.regexp_extract_all("t", F.lit(_PATTERN), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("hits"),
        F.when(hit, F.split("t", _PATTERN)).otherwise(F.array().cast("array<string>")).alias("others"),
    )
    ident = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def identifier(found: Column) -> Column:
        text = F.regexp_replace(found, rf"\|\|{_REMARK}", " ")
        for sentence in _NAMED:
            first, last = sentence.split(HOLDER)
            text = F.regexp_replace(text, f"^{first}.+{last}$", sentence)
        return F.coalesce(F.element_at(ident, text), F.lit("copyright"))

    steps = F.transform(
        "hits",
        lambda s, k: F.concat(F.when((k > 0) & (F.col("others")[k] != ""), F.lit(";~;")).otherwise(F.lit(";")), identifier(s), F.lit(";")),
    )
    rows = rows.select("id", F.array_join(steps, "").alias("found"))
    taken = F.col("found")
    for names, licence in RULES:
        taken = F.regexp_replace(taken, _rule_pattern(names, licence), f"<{licence}>")
    rows = rows.select("id", "found", F.when(F.col("found") != "", taken).otherwise("").alias("taken"))
    sentence_ids = F.regexp_extract_all("found", F.lit(";([^;~]+);"), F.lit(1))
    licenses = F.array_distinct(F.regexp_extract_all("taken", F.lit("<([^>]*)>"), F.lit(1)))
    rows = rows.select("id", sentence_ids.alias("sentence_ids"), licenses.alias("licenses"), "taken")
    return rows.select(
        "id",
        "sentence_ids",
        "licenses",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.regexp_count("taken", F.lit(";[^;~]+;")).cast("long").alias("n_unmatched"),
        F.arrays_overlap("licenses", F.array(*map(F.lit, RESTRICTED))).alias("restricted"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return license_scan(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
        "n_sentences",
        "n_unmatched",
        "restricted",
    )


def _sql() -> str:
    known = ", ".join(f"('{text}', '{name}')" for text, name in KNOWN.items())
    words = rf"regexp_replace(hit, '\|\|{_REMARK}', ' ', 'g')"
    for sentence in _NAMED:
        first, last = sentence.split(HOLDER)
        words = f"regexp_replace({words}, '^{first}.+{last}$', '{sentence}')"
    taken = "coalesce(seq, '')"
    for names, licence in RULES:
        taken = f"regexp_replace({taken}, '{_rule_pattern(names, licence)}', '<{licence}>', 'g')"
    gone = " OR ".join(f"list_contains(l, '{x}')" for x in RESTRICTED)
    return rf"""
WITH known(s, name) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS t FROM documents),
n AS (SELECT rid, doc_id, list_filter(list_transform(regexp_split_to_array(t, '[.!?]+[\x20\x09-\x0D]+|\n+'),
        lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s
      FROM d WHERE regexp_matches(t, '{_KEY_PATTERN}')),
b AS (SELECT rid, '|' || array_to_string(s, '||') || '|' AS t FROM n),
f AS (SELECT rid, regexp_extract_all(t, '{_PATTERN}', 1) AS hits, regexp_split_to_array(t, '{_PATTERN}') AS others FROM b),
p AS (SELECT rid, unnest(hits) AS hit, unnest(others[1:len(hits)]) AS other, unnest(range(len(hits))) AS i FROM f),
h AS (SELECT rid, i, other, {words} AS w FROM p),
g AS (SELECT rid, i, coalesce(name, 'copyright') AS name, CASE WHEN i > 0 AND other <> '' THEN ';~;' ELSE ';' END || coalesce(name, 'copyright') || ';' AS step
      FROM h LEFT JOIN known ON known.s = w),
q AS (SELECT rid, string_agg(replace(name, ';;', ','), ',' ORDER BY i) AS sentence_ids, string_agg(step, '' ORDER BY i) AS seq,
             sum(len(string_split(name, ';;'))) AS k FROM g GROUP BY rid),
t AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(k, 0) AS k, {taken} AS taken FROM d LEFT JOIN q USING (rid)),
a AS (SELECT *, regexp_extract_all(taken, '<([^>]*)>', 1) AS a FROM t),
l AS (SELECT *, list_filter(a, lambda x, i: list_position(a, x) = i) AS l FROM a)
SELECT doc_id, sentence_ids, array_to_string(l, ',') AS licenses, CAST(len(l) AS BIGINT) AS n_licenses,
       CAST(k AS BIGINT) AS n_sentences, CAST(len(regexp_extract_all(taken, ';[^;~]+;')) AS BIGINT) AS n_unmatched,
       ({gone}) AS restricted
FROM l"""


OP2_SQL = _sql()
