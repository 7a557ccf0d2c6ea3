"""Licence recognition by sentences, with Spark expressions only.

Texts are cut into sentences and normalised (lower case, everything but letters
and digits one space).  A known sentence is found from one cut to another, also
when it is wrapped over lines, with or without comment marks; of those that
begin at one place the longest counts.  Known licence sentences map to
identifiers; a rule is
an ordered sequence of identifiers, and matches where the document's
recognised sentences have it in that order, one right after another.  Other
sentences in between don't matter.  ``{n}`` in a known sentence is a slot for one
to n words, such as a holder's name; other wordings of a sentence have its
identifier.  An SPDX expression (names with OR, AND or WITH) stands for one
identifier line a name, so each licence of it is reported.  A match that lies within a longer one is
not reported, so the most specific rule counts.

The sentence table is small and fixed, so the lookup is part of the expression
and nothing is shuffled.  Null and empty texts have no sentences; rows are
independent, so repeated rows repeat their matches; of equally long matches
each is returned.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "This project is licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "Licensed under CC0 1.0.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "mit-notice-3": "Licensed under the MIT License.",
    "mit-notice-4": "This software is released under the MIT License.",
    "mit-notice-5": "{6} is licensed under the MIT License.",
    "mit-notice-6": "Distributed under the MIT License.",
    "gpl2-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-free-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl2-only-free-3": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 only, as published by the Free Software Foundation.",
    "gpl3-free-named": "{6} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free-named": "{6} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope-named": "{6} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "apache-notice-2": "{6} is licensed under the Apache License, Version 2.0.",
    "apache-notice-3": "Licensed under the Apache License 2.0.",
    "bsd-endorse-named": "Neither the name of {12} nor the names of {6} may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-single": "The name of {12} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is-named": 'THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability-named": "IN NO EVENT SHALL {12} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mit-liability-named": "IN NO EVENT SHALL {12} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cc-by-title": "Creative Commons Attribution 4.0 International Public License",
    "cc-by-sa-title": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc-by-nc-title": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "cc0-title": "CC0 1.0 Universal",
    "epl-title": "Eclipse Public License - v 2.0",
    "apache-title": "Apache License, Version 2.0, January 2004",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Another wording -> the sentence that it stands for; both are cut into as many parts.
WORDINGS = {
    "apache-copy-https": "apache-copy", "apache-notice-2": "apache-notice", "apache-notice-3": "apache-notice", "mit-notice-3": "mit-notice", "mit-notice-4": "mit-notice", "mit-notice-5": "mit-notice", "mit-notice-6": "mit-notice", "gpl2-only-free-2": "gpl2-only-free",
    "gpl2-only-free-3": "gpl2-only-free", "gpl3-free-named": "gpl-free", "gpl2-free-named": "gpl2-free", "gpl-hope-named": "gpl-hope", "bsd-endorse-named": "bsd-endorse", "bsd-endorse-single": "bsd-endorse",
    "bsd-as-is-named": "bsd-as-is", "bsd-liability-named": "bsd-liability", "mit-liability-named": "mit-liability",
}

#: Licences whose identifier line is known; the sentence of each is spdx-<licence>.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib Artistic-2.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EUPL-1.2 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-1.1 NCSA OFL-1.1 PostgreSQL Python-2.0 WTFPL".split()
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}

#: rule -> (licence, sentence identifiers in order)
RULES = {
    "apache-2.0/notice": ("Apache-2.0", ["apache-notice"]),
    "apache-2.0/header": ("Apache-2.0", ["apache-header", "apache-copy", "apache-as-is", "apache-see"]),
    "mit/notice": ("MIT", ["mit-notice"]),
    "mit/notice-2": ("MIT", ["mit-notice-2"]),
    "mit/title": ("MIT", ["mit-title"]),
    "mit/titled-text": ("MIT", ["mit-title", "mit-grant", "mit-notice-kept", "mit-as-is", "mit-liability"]),
    "mit/text": ("MIT", ["mit-grant", "mit-notice-kept", "mit-as-is", "mit-liability"]),
    "gpl-3.0/notice": ("GPL-3.0-only", ["gpl3-notice"]),
    "gpl-3.0/header": ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    "gpl-2.0/header": ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    "gpl-2.0-only/header": ("GPL-2.0-only", ["gpl2-only-free", "gpl-hope", "gpl-see"]),
    "epl-1.0/notice": ("EPL-1.0", ["epl1-notice"]),
    "epl-2.0/title": ("EPL-2.0", ["epl-title"]),
    "cc-by-4.0/title": ("CC-BY-4.0", ["cc-by-title"]),
    "cc-by-sa-4.0/title": ("CC-BY-SA-4.0", ["cc-by-sa-title"]),
    "cc-by-nc-4.0/title": ("CC-BY-NC-4.0", ["cc-by-nc-title"]),
    "cc0-1.0/title": ("CC0-1.0", ["cc0-title"]),
    "apache-2.0/title": ("Apache-2.0", ["apache-title"]),
    "lgpl-2.1/header": ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    "lgpl-3.0/header": ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-see"]),
    "agpl-3.0/header": ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-see"]),
    "bsd-2/whole": ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    "bsd-3/whole": ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    "zlib/text": ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    "bsl-1.0/notice": ("BSL-1.0", ["bsl-notice"]),
    "epl-2.0/notice": ("EPL-2.0", ["epl-notice"]),
    "bsd-2/text": ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    "bsd-3/text": ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "isc/grant": ("ISC", ["isc-grant"]),
    "mpl-2.0/notice": ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    "cc-by-nc-4.0/notice": ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    "cc-by-4.0/notice": ("CC-BY-4.0", ["cc-by-notice"]),
    "cc-by-4.0/text": ("CC-BY-4.0", ["cc-by-text"]),
    "cc-by-sa-4.0/notice": ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    "cc-by-sa-4.0/text": ("CC-BY-SA-4.0", ["cc-by-sa-text"]),
    "cc0-1.0/notice": ("CC0-1.0", ["cc0-notice"]),
    "unlicense/notice": ("Unlicense", ["unlicense"]),
}
RULES |= {f"{name.lower()}/spdx": (name, [f"spdx-{name}"]) for name in SPDX}

#: A sentence ends at a line break, after a web address, or at a stop, question or exclamation mark or colon before white space.
ENDS = r"\s*(?:[.!?:]+\s+|\n)\s*"


def normal(sentence: str) -> str:
    """What ``normalised`` makes of a known sentence (ASCII); slots stay."""
    return re.sub(r"[^a-z0-9{}]+", " ", sentence.lower()).strip()


#: Stands for the end of a sentence within a normalised text, where line breaks stay.
CUT = "\x01"


def normalised(text: Column) -> Column:
    lines = F.regexp_replace(F.translate(F.lower(text), CUT, " "), r"(https?://\S++)\s", rf"$1{CUT}")
    cut = F.regexp_replace(lines, r"(?<![.!?:])[.!?:]++\s+", CUT)
    return F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}\n{CUT}]+", " ")


def as_pattern(known: str, gap: str = " ") -> str:
    """A regular expression for a normalised sentence, its words ``gap`` apart; those of a slot
    in front are on one line, so that it takes no line before."""
    words = []
    for word in known.split(" "):
        slot = re.fullmatch(r"\{(\d+)\}", word)
        between = gap if words else " "
        words.append(rf"[\p{{L}}\p{{N}}]+(?:{between}[\p{{L}}\p{{N}}]+){{0,{int(slot[1]) - 1}}}" if slot else word)
    return gap.join(words)


def spdx_names(gap: str = " ") -> str:
    return "(?:" + "|".join(sorted((as_pattern(normal(n), gap) for n in SPDX), key=len, reverse=True)) + ")"


def expression_pattern(gap: str = " ") -> str:
    """An SPDX expression of several names, or of one with an exception, normalised."""
    names = spdx_names(gap)
    return rf"{names}(?:{gap}(?:and|or){gap}{names}|{gap}with{gap}[\p{{L}}\p{{N}}]+(?:{gap}[\p{{L}}\p{{N}}]+){{0,5}})+"


#: The sentence before SPDX names.
LINE = normal("SPDX-License-Identifier")


def known_pattern() -> str:
    """Matches a known sentence, its words on one line or several, between two cuts; group 1 is
    the sentence.  The cut after it is left for the next one."""
    gap = r"[ \n]+"
    longest_first = sorted(known_parts(), key=len, reverse=True)
    expression = rf"{as_pattern(LINE, gap)} ?{CUT} ?{expression_pattern(gap)}"
    return rf"(?:^|[\n{CUT}]) ?(" + "|".join([expression, *(as_pattern(s, gap) for s in longest_first)]) + rf")(?= ?(?:[\n{CUT}]|\z))"


def _split_known() -> dict[str, tuple[str, ...]]:
    """The parts into which the cutting rule divides each known sentence."""
    return {k: tuple(x for x in (normal(p) for p in re.split(ENDS, s)) if x) for k, s in SENTENCES.items()}


def known_parts() -> dict[str, int]:
    """normalised sentence -> identifier (place in the order of first use); another wording
    has the identifier of the sentence that it stands for."""
    parts = _split_known()
    out: dict[str, int] = {}
    for name, own in parts.items():
        if name not in WORDINGS:
            for p in own:
                out.setdefault(p, len(out) + 1)
    for name, meant in WORDINGS.items():
        for p, q in zip(parts[name], parts[meant], strict=True):
            out.setdefault(p, out[q])
    return out


def rule_sequences() -> dict[str, tuple[str, list[int]]]:
    parts, ids = _split_known(), known_parts()
    return {r: (name, [ids[p] for s in seq for p in parts[WORDINGS.get(s, s)]]) for r, (name, seq) in RULES.items()}


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per match: (key, license_id, rule_id, place, n_sentences); ``place`` counts the
    document's recognised sentences from 0."""
    ids = known_parts()
    known = F.regexp_extract_all(normalised(F.col(text)), F.lit(known_pattern()), F.lit(1))
    table = F.create_map(*(F.lit(x) for s, i in ids.items() if "{" not in s for x in (s, i)))

    def identified(sentence: Column) -> Column:
        """The identifiers of a found sentence: one, or a pair for each name of an expression."""
        plain = F.regexp_replace(sentence, r"[ \n]+", " ")
        named = F.regexp_extract_all(F.regexp_replace(plain, rf"^{LINE} ?{CUT} ?", " "), F.lit(f" ({spdx_names()})(?= |$)"), F.lit(1))
        pairs = F.flatten(F.transform(named, lambda n: F.array(F.lit(ids[LINE]), F.element_at(table, n))))
        slotted = F.coalesce(F.try_element_at(table, plain), *(F.when(plain.rlike(f"^(?:{as_pattern(s)})$"), i) for s, i in ids.items() if "{" in s))
        return F.when(F.contains(plain, F.lit(CUT)), pairs).otherwise(F.array(slotted))

    found = F.flatten(F.transform(known, identified))
    held = docs.select(F.col(key).alias("_key"), found.alias("_ids")).where(F.size("_ids") > 0)

    def matches(rule: str, name: str, seq: list[int]) -> Column:
        want = F.array(*(F.lit(i) for i in seq))
        places = F.filter(F.sequence(F.lit(0), F.size("_ids") - 1), lambda i: F.slice(F.col("_ids"), i + 1, F.lit(len(seq))) == want)
        return F.transform(places, lambda i: F.struct(F.lit(name).alias("license_id"), F.lit(rule).alias("rule_id"), i.cast("long").alias("place"), F.lit(len(seq)).cast("long").alias("n_sentences")))

    every = held.select("_key", F.concat(*(matches(r, *rule) for r, rule in rule_sequences().items())).alias("_all"))

    def within(m: Column, o: Column) -> Column:
        return (o["n_sentences"] > m["n_sentences"]) & (o["place"] <= m["place"]) & (m["place"] + m["n_sentences"] <= o["place"] + o["n_sentences"])

    kept = F.filter("_all", lambda m: ~F.exists("_all", lambda o: within(m, o)))
    return every.select(F.col("_key").alias(key), F.explode(kept).alias("m")).select(key, "m.*")
