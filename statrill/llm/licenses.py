"""Licence recognition by sentences. DataFrame functions only.

A text is cut into sentences: indents, list numbers and comment marks go, wrapped lines are joined whatever their case, and
a sentence ends at a full stop, at a blank line, or where a line begins with the opening words of a known sentence. Each is
normalised to lower-case words, and where a template has a slot for a name (SLOTS), the name gives way to the published one;
known sentences become identifiers, others a `?` (one for several in a row, none at either end); NEUTRAL ones are passed over.
An SPDX expression is a sentence for each of its licences; exceptions are passed over. The sequence of a text's identifiers is
matched against ordered rules. A rule takes effect where an earlier one has not already used the same identifiers, and not
across a `?`.

Null texts count as empty; a text without known sentences has no identifiers and no licence; identifiers that no rule
takes give `unknown`. An empty table gives an empty one; a very long text is scanned whole if it holds one of ANCHORS.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

#: Sentences of public licences as published, and what they are called here.
SENTENCES = {
    "MitGrant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions:""",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MitWarranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MitLiability": """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "BsdName": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission.""",
    "BsdWarranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BsdLiability": """IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "IscGrant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "IscWarranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS.""",
    "IscLiability": """IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ApacheUse": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.""",
    "ApacheBasis": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "ApacheRef": "Licensed under the Apache License, Version 2.0.",
    "MitRef": "Released under the MIT License.",
    "MitUnder": "Licensed under the MIT License.",
    "Gpl2Only": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as
        published by the Free Software Foundation.""",
    "Gpl2Later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "Gpl3Later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Gpl3Ref": "This work is licensed under the GNU General Public License, version 3.",
    "Lgpl21Later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "Lgpl3Later": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Agpl3Later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Mpl2Subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "UnlicenseFree": "This is free and unencumbered software released into the public domain.",
    "CcBy4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CcBySa4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CcByNc4": "Licensed under CC BY-NC 4.0.",
    "Epl2Terms": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/""",
    "Epl2V": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v.",
    "ZlibWarranty": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibLiability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "ZlibGrant": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions:""",
    "Cc0Waiver": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the
        public domain worldwide.""",
}
#: The heads of whole licence texts.
HEADS = {
    "Apache2Text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Gpl2Text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "Gpl3Text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "Lgpl21Text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "Lgpl3Text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "Agpl3Text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Mpl2Text": "Mozilla Public License Version 2.0",
    "Epl2Text": "Eclipse Public License - v 2.0",
    "Bsl1Text": "Boost Software License - Version 1.0 - August 17th, 2003",
}
#: Where published sentences name someone, as patterns of normalised sentences, and what stands there by default.
SLOTS = (
    (r"^neither the names? of .{1,100}? nor the names of (?:its|their) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^this software is provided by .{1,100}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"^in no event shall .{1,100}? be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
    (r"^in no event shall .{1,100}? be liable for any claim damages", "in no event shall the authors or copyright holders be liable for any claim damages"),
    (r"^in no event shall .{1,100}? be liable for any special", "in no event shall the author be liable for any special"),
    (r"^the software is provided as is and .{1,100}? disclaims? all warranties", "the software is provided as is and the author disclaims all warranties"),
    (r"^(this program and the accompanying materials are made available under the terms of the eclipse public license)(?: v)? 2 0 which is available at .*$", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
)
#: Sentences that go with several licences and tell none apart.
NEUTRAL = (
    "All rights reserved.",
    "You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "https://www.apache.org/licenses/LICENSE-2.0",
    "See the License for the specific language governing permissions and limitations under the License.",
    """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE.""",
    """This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE.""",
    "See the GNU General Public License for more details.",
    "See the GNU Lesser General Public License for more details.",
    "See the GNU Affero General Public License for more details.",
    "2.0.",
    "2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
)
#: Licence names of the short form `SPDX-License-Identifier: name`.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
#: Former names of the short form.
FORMER = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
#: Sequences of identifiers, in this order, and the licence that they mean.
RULES = (
    ("MitGrant,MitNotice,MitWarranty,MitLiability", "MIT"),
    ("MitGrant,MitNotice,MitWarranty", "MIT"),
    ("BsdGrant,BsdSource,BsdBinary,BsdName,BsdWarranty,BsdLiability", "BSD-3-Clause"),
    ("BsdGrant,BsdSource,BsdBinary,BsdName,BsdWarranty", "BSD-3-Clause"),
    ("BsdGrant,BsdSource,BsdBinary,BsdWarranty,BsdLiability", "BSD-2-Clause"),
    ("BsdGrant,BsdSource,BsdBinary,BsdWarranty", "BSD-2-Clause"),
    ("IscGrant,IscWarranty,IscLiability", "ISC"),
    ("IscGrant,IscWarranty", "ISC"),
    ("ApacheUse,ApacheBasis", "Apache-2.0"),
    ("ApacheUse", "Apache-2.0"),
    ("ApacheRef", "Apache-2.0"),
    ("MitRef", "MIT"),
    ("MitUnder", "MIT"),
    ("Gpl2Only", "GPL-2.0-only"),
    ("Gpl2Later", "GPL-2.0-or-later"),
    ("Gpl3Later", "GPL-3.0-or-later"),
    ("Gpl3Ref", "GPL-3.0-only"),
    ("Lgpl21Later", "LGPL-2.1-or-later"),
    ("Lgpl3Later", "LGPL-3.0-or-later"),
    ("Agpl3Later", "AGPL-3.0-or-later"),
    ("Mpl2Subject", "MPL-2.0"),
    ("UnlicenseFree", "Unlicense"),
    ("CcBy4", "CC-BY-4.0"),
    ("CcBySa4", "CC-BY-SA-4.0"),
    ("CcByNc4", "CC-BY-NC-4.0"),
    ("Cc0Waiver", "CC0-1.0"),
    ("Epl2Terms", "EPL-2.0"),
    ("Epl2V", "EPL-2.0"),
    ("ZlibWarranty,ZlibLiability,ZlibGrant", "Zlib"),
    ("Apache2Text", "Apache-2.0"),
    ("Gpl2Text", "GPL-2.0-only"),
    ("Gpl3Text", "GPL-3.0-only"),
    ("Lgpl21Text", "LGPL-2.1-only"),
    ("Lgpl3Text", "LGPL-3.0-only"),
    ("Agpl3Text", "AGPL-3.0-only"),
    ("Mpl2Text", "MPL-2.0"),
    ("Epl2Text", "EPL-2.0"),
    ("Bsl1Text", "BSL-1.0"),
    *((f"spdx:{x}", x) for x in SPDX),
)
#: Every known sentence that begins an identifier holds one of these, so a text with none of them need not be cut.
ANCHORS = ("licens", "permission", "redistribut", "warrant", "liable", "promote products", "public domain")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What divides sentences once a text is cut.
CUT = "\x1e"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Normalised sentence -> identifier; neutral ones have none.
KNOWN = {normalised(x): "" for x in NEUTRAL} | {normalised(x): k for k, x in (SENTENCES | HEADS).items()} | {normalised(f"SPDX-License-Identifier: {x}"): f"spdx:{y}" for x, y in (FORMER | {x: x for x in SPDX}).items()}
_OPENINGS = "|".join(dict.fromkeys("[ \t]+".join(x.split()[:3]) for x in sorted(map(normalised, SENTENCES.values()))))
_SPDX = r"(?i)(spdx-license-identifier:[ \t]*)"
#: Licences of an SPDX expression, at most: one step takes one off.
OPERANDS = 6
#: Patterns and what takes their place, one after the other; the same in Java and in RE2.
STEPS = (
    (r"\r\n?", "\n"),
    (r"\n[ \t]*(?:///?!?|/\*+|\*+/|\*+|#+|;+|--+|%+|<!--|>+)?[ \t]*", "\n"),
    (r"\n(?:\(?[0-9a-z][.)]|-)[ \t]+", "\n"),
    (r"\n\n+", CUT),
    *[(_SPDX + r"\(*([a-z0-9.+-]+)(?:[ \t]+with[ \t]+[a-z0-9.-]+)?\)*[ \t]+(?:and|or)[ \t]+", rf"{CUT}\1\2{CUT}SPDX-License-Identifier: ")] * (OPERANDS - 1),
    (_SPDX + r"\(*([a-z0-9.-]+)\+", r"\1\2-or-later"),
    (_SPDX + r"\(*([a-z0-9.-]+)(?:[ \t]+with[ \t]+[a-z0-9.-]+)?\)*", rf"{CUT}\1\2{CUT}"),
    (rf"(?i)\n({_OPENINGS})", rf"{CUT}\1"),
    (r"\n", " "),
    (r"\b([Ii]nc|[Ll]td|[Cc]orp|[Cc]o)\.[ \t]+([a-z])", r"\1 \2"),
    (r"([.!?])[ \t]+", rf"\1{CUT}"),
)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order; without blank ones."""
    out = F.concat(F.lit("\n"), text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    out = F.filter(F.transform(F.split(out, CUT), lambda x: F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), "[^a-z0-9]+", " "))), lambda x: x != "")
    return F.transform(out, lambda x: reduce(lambda y, slot: F.regexp_replace(y, *slot), SLOTS, x))


def licences(ids: Column) -> Column:
    """Licences of a comma-joined sequence of identifiers, by rule: each rule strikes out what it takes."""
    left, names = F.concat(F.lit(","), F.replace(ids, F.lit(","), F.lit(",,")), F.lit(",")), []
    for sequence, name in RULES:
        taken = "," + sequence.replace(",", ",,") + ","
        names.append(F.when(F.instr(left, taken) > 0, F.lit(name)))
        left = F.replace(left, F.lit(taken), F.lit(""))
    names.append(F.when(F.length(F.replace(left, F.lit(",?,"), F.lit(""))) > 2, F.lit("unknown")))
    return F.array_compact(F.array_distinct(F.array(*names)))


def sequence(text: Column) -> Column:
    """Identifiers of a text, comma-joined, `?` for what is not known between them."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    each = F.filter(F.transform(sentences(text), lambda x: F.coalesce(F.element_at(known, x), F.lit("?"))), lambda x: x != "")
    ids = F.regexp_replace(F.array_join(each, ","), r"\?(?:,\?)+", "?")
    return F.regexp_replace(ids, r"^\?(?:,|$)|,\?$", "")


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids array<string> in order, licences array<string>."""
    anchored = F.rlike("text", F.lit("(?i)" + "|".join(ANCHORS)))
    found = texts(docs).select("doc_id", F.when(anchored, sequence(F.col("text"))).otherwise("").alias("ids"))
    # licences of what is not empty only: most texts have none, and the rules are many
    named = F.when(F.col("ids") != "", licences(F.col("ids"))).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", F.filter(F.split("ids", ","), lambda x: x != "").alias("sentence_ids"), named.alias("licences"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter("sentence_ids", lambda x: x != "?")).cast("long").alias("n_known")
    return licence_scan(table(spark, sf_dir, "documents")).select("doc_id", n, F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in KNOWN.items())
    slotted = reduce(lambda y, slot: f"regexp_replace({y}, {quoted(slot[0])}, {quoted(slot[1])})", SLOTS, "y")
    cut = "chr(10) || text"
    for pattern, to in STEPS:
        pattern = pattern.replace("\n", "\\n").replace("\t", "\\t")
        to = " || ".join({CUT: "chr(30)", "\n": "chr(10)"}.get(x, quoted(x)) for x in re.findall(rf"{CUT}|\n|[^{CUT}\n]+", to))
        cut = f"regexp_replace({cut}, {quoted(pattern)}, {to}, 'g')"
    steps, names = "select doc_id, sentence_ids, ',' || replace(sentence_ids, ',', ',,') || ',' as left0 from ids", []
    for i, (some, name) in enumerate(RULES):
        taken = "," + some.replace(",", ",,") + ","
        steps = f"select *, replace(left{i}, '{taken}', '') as left{i + 1} from ({steps})"
        names.append(f"case when contains(left{i}, '{taken}') then '{name}' end")
    names.append(f"case when length(replace(left{len(RULES)}, ',?,', '')) > 2 then 'unknown' end")
    return f"""
    with cuts as (select doc_id, string_split({cut}, chr(30)) as parts from (select doc_id, coalesce(text, '') as text from documents)),
    each as (select doc_id, [coalesce(map {{{known}}}[{slotted}], '?') for y in [trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) for x in parts] if y <> ''] as marks from cuts),
    ids as (select doc_id, regexp_replace(regexp_replace(array_to_string([x for x in marks if x <> ''], ','), '\\?(?:,\\?)+', '?', 'g'), '^\\?(?:,|$)|,\\?$', '', 'g') as sentence_ids from each),
    named as (select doc_id, sentence_ids, [x for x in [{', '.join(names)}] if x is not null] as names from ({steps})),
    listed as (select doc_id, sentence_ids, case when sentence_ids = '' then [] else list_filter(names, lambda x, i: list_position(names, x) = i) end as names from named)
    select doc_id, len([x for x in string_split(sentence_ids, ',') if x <> '' and x <> '?']) as n_known, sentence_ids, array_to_string(names, ',') as licences from listed"""


ORACLE_SQL = {"op3_licences": _sql()}
