"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, runs of other than letters and digits become a space) and
looked up among known licence sentences. A known sentence may run over single line ends, behind comment marks (signs,
dnl, rem) and a list label of one letter or digit; blank lines and sentence ends always cut, and a line end cuts where
no known sentence goes on. The identifiers found, with a mark for each unknown sentence, form a sequence,
and ordered rules over identifiers recognise licences in it: at each place the first rule that fits wins, longer rules
stand before their own beginnings, and up to GAP unknown sentences may lie between two identifiers of a rule.

Every known sentence has a word that contains one of ANCHORS. Words are the same before and after normalisation, so a
text without any anchor cannot hold a known sentence and is not cut.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of

GAP = 3
ANCHORS = ("licen", "copyright", "redistribut", "warrant", "permission", "domain", "reserved", "cc0", "liable", "liability")


def _gnu(kind: str, tail: str, terms: str = "") -> tuple[str, ...]:
    """The sentence of a GNU header, whole or from the semicolon on, and with the end that follows a comma."""
    body = f"you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License{terms} as published by the Free Software Foundation{tail}"
    return (body, *(f"This {what} is free software: {body}" for what in ("program", "library", "file", "software")))


def _later(version: int) -> str:
    return f"either version {version} of the License, or (at your option) any later version"


#: Identifier: wordings.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-title": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit-notice": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "SPDX-License-Identifier: MIT"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-include": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    "apache-title": ("Apache License", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "apache-notice": ("Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")'),
    "apache-terms": ("you may not use this file except in compliance with the License",),
    "gpl2-notice": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Licensed under the GPLv2 license", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "GNU General Public License Version 2, June 1991", *_gnu("", "", " version 2"), *_gnu("", "", ", version 2,")),
    "gpl3-notice": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007", *_gnu("", "", " version 3"), *_gnu("", "", ", version 3,")),
    "gpl-terms": _gnu("", ""),
    "lgpl-terms": _gnu("Lesser ", ""),
    "agpl-terms": _gnu("Affero ", ""),
    "gpl-later": ("or any later version of the License",),
    "gpl2-later": (_later(2),),
    "gpl3-later": (_later(3),),
    "gpl2-later-notice": ("SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the GNU General Public License, version 2 or later", *_gnu("", ", " + _later(2))),
    "gpl3-later-notice": ("SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License, version 3 or later", *_gnu("", ", " + _later(3))),
    "lgpl3-later-notice": ("SPDX-License-Identifier: LGPL-3.0-or-later", *_gnu("Lesser ", ", " + _later(3))),
    "agpl3-later-notice": ("SPDX-License-Identifier: AGPL-3.0-or-later", *_gnu("Affero ", ", " + _later(3))),
    "lgpl3-notice": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "agpl3-notice": ("Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "GNU Affero General Public License Version 3, 19 November 2007"),
    "mpl2-notice": ("Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    "bsd-redistribution": ("Redistribution and use in source and binary forms are permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    "bsd-endorse": ("The names of contributors may not be used without prior written permission", *(f"{who} may be used to endorse or promote products derived from this software without specific prior written permission" for who in ("Neither the name of the copyright holder nor the names of its contributors", "Neither the names of the copyright holders nor the names of their contributors", "Neither the name of the University nor the names of its contributors", "Neither the name of the organization nor the names of its contributors", "Neither the name of the author nor the names of its contributors"))),
    "bsd2-title": ("BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "bsd3-title": ("BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "bsd2-notice": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "bsd3-notice": ("Licensed under the BSD 3-Clause License", "Released under the BSD License", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by-notice": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This work is licensed under the Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa-notice": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc-notice": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0-notice": ("Dedicated to the public domain under CC0 1.0", "This work is in the public domain", "CC0 1.0 Universal", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "SPDX-License-Identifier: CC0-1.0"),
    "isc-title": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "isc-notice": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "isc-grant": tuple(f"Permission to use, copy, modify, {both} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for both in ("and/or", "and")),
    "no-warranty": ("The software is provided as is, without warranty of any kind", "This program comes with absolutely no warranty", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement', *(f'This software is provided by the {who} "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed' for who in ("copyright holders and contributors", "author and contributors", "regents and contributors")), "This program is distributed in the hope that it will be useful, but without any warranty", 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'),
    "mit-liability": ("In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",),
    "bsd-liability": (
        *(f"In no event shall the {who} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services" for who in ("copyright holder or contributors", "copyright holders or contributors", "copyright owner or contributors", "author or contributors", "regents or contributors")),
        "or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage",
    ),
    "isc-liability": ("In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",),
    "apache-rest": (
        "You may obtain a copy of the License at",
        *(f"{p}://www.apache.org/licenses/LICENSE-2.0" for p in ("http", "https")),
        *(f"You may obtain a copy of the License at {p}://www.apache.org/licenses/LICENSE-2.0" for p in ("http", "https")),
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
        "See the License for the specific language governing permissions and limitations under the License",
    ),
    "apache-body": (
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
        '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License',
        '"You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this License',
        "Grant of Copyright License",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        "Grant of Patent License",
        "Redistribution",
        "You must give any other recipients of the Work or Derivative Works a copy of this License",
        "Disclaimer of Warranty",
        "Accepting Warranty or Additional Liability",
    ),
    "gpl-rest": (
        "without even the implied warranty of merchantability or fitness for a particular purpose",
        *(f"See the GNU {kind}General Public License for more details" for kind in ("", "Lesser ", "Affero ")),
        *(f"You should have received a copy of the GNU {kind}General Public License along with this {what}" for kind in ("", "Lesser ", "Affero ") for what in ("program", "library", "software")),
        *(f"If not, see {p}://www.gnu.org/licenses/" for p in ("http", "https")),
    ),
    "all-rights": ("All rights reserved", "Copyright, all rights reserved", "All rights reserved under copyright"),
}

#: Licence and its identifiers, in the order in which they are tried. One with a star and a number may follow any number
#: of times, each after up to so many unknown sentences: the rest of a text that has been recognised already. One with a
#: plus follows once, after up to so many.
_BASE: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd3-title", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd2-title", "bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-notice", "gpl-later")),
    ("GPL-2.0-or-later", ("gpl2-notice", "gpl-later")),
    ("GPL-3.0-or-later", ("gpl3-notice", "gpl3-later")),
    ("GPL-2.0-or-later", ("gpl2-notice", "gpl2-later")),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl3-later")),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl2-later")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "gpl3-later")),
    ("AGPL-3.0-or-later", ("agpl-terms", "gpl3-later")),
    ("GPL-3.0-or-later", ("gpl3-later-notice",)),
    ("GPL-2.0-or-later", ("gpl2-later-notice",)),
    ("LGPL-3.0-or-later", ("lgpl3-later-notice",)),
    ("AGPL-3.0-or-later", ("agpl3-later-notice",)),
    ("MIT", ("mit-title", "mit-grant", "mit-include*3", "no-warranty*3", "mit-liability*3")),
    ("MIT", ("mit-title", "no-warranty")),
    ("MIT", ("mit-grant", "mit-include*3", "no-warranty*3", "mit-liability*3")),
    ("MIT", ("mit-include", "no-warranty", "mit-liability")),
    ("Apache-2.0", ("apache-title", "apache-body+80", "apache-body*80", "apache-notice*80", "apache-terms*3", "apache-rest*3")),
    ("Apache-2.0", ("apache-body", "apache-body", "apache-body*80", "apache-notice*80", "apache-terms*3", "apache-rest*3")),
    ("Apache-2.0", ("apache-title", "apache-notice", "apache-terms*3", "apache-rest*3")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("ISC", ("isc-notice",)),
    ("ISC", ("isc-title", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-title",)),
)


def _rights(ids: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """ids, before them those with all-rights in front or behind a title: it is then part of the licence's notice."""
    titled = ((ids[0], "all-rights", *ids[1:]),) if ids[0].endswith("-title") and len(ids) > 1 else ()
    return (*titled, ("all-rights", *ids), ids)


RULES: tuple[tuple[str, tuple[str, ...]], ...] = (*((name, v) for name, ids in _BASE for v in _rights(ids)), ("proprietary", ("all-rights",)))

_CUT = "[.;!?]+(?:[\\x20\\x09-\\x0D]+|$)|[\\x0A\\x0D]+"
_OTHER = "[^a-z0-9]+"
#: One character for each identifier: letters of a script that has enough of them.
_FIRST_CODE = 0x4E00
_CODES = {i: chr(_FIRST_CODE + k) for k, i in enumerate(SENTENCES)}
_ANY_CODE = f"[{chr(_FIRST_CODE)}-{chr(_FIRST_CODE + len(_CODES) - 1)}]"
_UNKNOWN = "0"


def normalised(sentence: str) -> str:
    return re.sub(_OTHER, " ", sentence.lower().replace("licence", "license")).strip()


_KNOWN = {normalised(w): _CODES[i] for i, wordings in SENTENCES.items() for w in wordings}
assert all(any(a in w for w in s.split() for a in ANCHORS) for s in _KNOWN)


def _rule(ids: tuple[str, ...]) -> str:
    out = _CODES[ids[0]]
    for i in ids[1:]:
        name, sign, gap = re.fullmatch(r"([a-z0-9-]+)([*+]?)(\d*)", i).groups()
        step = f"{_UNKNOWN}{{0,{gap or GAP}}}{_CODES[name]}"
        out += f"(?:{step})*" if sign == "*" else step
    return out


_ANY_RULE = "|".join(_rule(ids) for _, ids in RULES)


#: In a lowered text, S stands for a sentence end and N for a line end.
_END = "[.;!?]+(?:[\\x20\\x09-\\x0D]+|$)"
_NEXT = " ?N ?(?:(?:dnl|rem) )?"
_HEAD = " ?(?:(?:dnl|rem) )?(?:[a-z0-9] )?"
#: A known sentence, the longest first, or else a line or the rest of one.
_PIECE = f"{_HEAD}(?:{'|'.join(s.replace(' ', f'(?:{_NEXT}| )') for s in sorted(_KNOWN, key=len, reverse=True))}) ?(?![^SN])|[^SN]+"


def _codes() -> Column:
    """The codes of a text's sentences, as a string."""
    known = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])

    def code(piece: Column) -> Column:
        plain = F.trim(F.regexp_replace(piece, _NEXT, " "))
        return F.when(plain == "", F.lit("")).otherwise(F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_replace(plain, f"^{_HEAD}", "")), F.lit(_UNKNOWN)))

    low = F.lower(F.col("text"))
    anchored = reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in ANCHORS])
    marked = F.replace(low, F.lit("licence"), F.lit("license"))
    for pattern, sign in (("(?m)^[\\x20\\x09]*;+", " "), (_END, "S"), ("\\x0D\\x0A?|\\x0A", "N"), ("[^a-z0-9SN]+", " ")):
        marked = F.regexp_replace(marked, pattern, sign)
    return F.when(anchored, F.array_join(F.transform(F.regexp_extract_all(marked, F.lit(_PIECE), F.lit(0)), code), "")).otherwise(F.lit(""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_sentences (known licence sentences), sentence_ids, licenses.

    sentence_ids lists the identifiers and licenses the recognised licences, both in the order of the text and joined by
    commas. Null and empty texts have none. Null ids and repeated rows stay as they are; other columns are ignored.
    """
    name = F.create_map(*[F.lit(x) for i, c in _CODES.items() for x in (c, i)])
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", _codes().alias("codes"))
    ids = F.transform(F.regexp_extract_all("codes", F.lit(_ANY_CODE), F.lit(0)), lambda c: F.element_at(name, c))
    which = lambda m: reduce(lambda rest, r: F.when(m.rlike(f"^(?:{_rule(r[1])})$"), F.lit(r[0])).otherwise(rest), reversed(RULES), F.lit(None).cast("string"))
    found = F.transform(F.regexp_extract_all("codes", F.lit(_ANY_RULE), F.lit(0)), which)
    return rows.select(F.col("id").alias(id_col), F.size(ids).cast("long").alias("n_sentences"), F.array_join(ids, ",").alias("sentence_ids"), F.array_join(found, ",").alias("licenses"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = f"map([{', '.join(map(quoted, _KNOWN))}], [{', '.join(map(quoted, _KNOWN.values()))}])"
    names = f"map([{', '.join(map(quoted, _CODES.values()))}], [{', '.join(map(quoted, _CODES))}])"
    which = "CASE " + " ".join(f"WHEN regexp_full_match(m, {quoted(_rule(ids))}) THEN {quoted(name)}" for name, ids in RULES) + " END"
    plain = f"trim(regexp_replace(replace(lower(s), 'licence', 'license'), '{_OTHER}', ' ', 'g'))"
    return f"""
WITH docs AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(coalesce(text, ''), '{_CUT}'), lambda s:
    CASE WHEN {plain} = '' THEN '' ELSE coalesce({known}[{plain}], '{_UNKNOWN}') END), '') AS codes FROM documents),
ids AS (SELECT doc_id, codes, list_transform(regexp_extract_all(codes, '{_ANY_CODE}'), lambda c: {names}[c]) AS ids FROM docs)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_transform(regexp_extract_all(codes, {quoted(_ANY_RULE)}), lambda m: {which}), ',') AS licenses
FROM ids
"""


ORACLE = _oracle()
