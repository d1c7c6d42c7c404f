"""The operators against brute force, exact round trips and the libraries that they stand for, on odd small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statrill.llm import bpe, licenses, line_dedup, links, ngram_join, packing, pii, quality, secrets, spotsigs, topk

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "\n", "a  b", " a", "a ", "a\n b", "a \nb", "x" * 5000, "don't  we're\t\tok ", "日本語 テスト  ½²Ⅷ _a_b__", "a\r\n\r\n b", None, "same text here", "same text here", "<|endoftext|> x"]
SCHEMA = "doc_id long, text string, source string, lang string, key long, row_ long, n_chars long"


def docs(spark, values):
    """With columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, f"s{i % 5}", "en", 1, 1, None if t is None else len(t)) for i, t in enumerate(values)], SCHEMA)


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def test_bpe_is_the_library_and_decodes(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encode(docs(spark, ODD), path, P.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, path, P.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.digests(docs(spark, ODD), path, P.PATTERN).collect()}
    assert all(got[i] == (len(x := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, t in enumerate(ODD))
    assert bpe.digests(docs(spark, ODD).limit(0), path, P.PATTERN).count() == 0


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng, capacity = random.Random(1), 64
    special = ["<|endoftext|>", "hello <|endoftext|> x", "a<|endoftext|>b c  <|endoftext|>", "x <|endoftext|>y\n <|endoftext|><|endoftext|> z", "double  spaced  words  and   more " * 40]
    values = ODD + special + [" ".join(rng.choice(["red", "greenish", "blue,", "x"]) for _ in range(rng.randint(1, 150))) for _ in range(120)]
    rows, of, held = packing.packed(docs(spark, values), P.path("byte_bpe_50k.json"), capacity, keep_ids=True).collect(), defaultdict(list), defaultdict(list)
    assert tokenizer.encode(special[1], add_special_tokens=False).ids == [31373, 220, 50256, 2124]
    for r in rows:
        of[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in enumerate(values):
        got = sorted(of[i], key=lambda r: r.piece)
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4").tolist() == want and all(r.length == capacity for r in got[1:])
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= -(-sum(r.length for r in rows) // capacity) + 1
    assert packing.packed(docs(spark, ODD).limit(0), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("counts", [{}, {5: 1}, {3: 7, 4: 2, 9: 3}, {10: 1, 1: 25}, {7: 4, 6: 4, 3: 9, 2: 1}])
def test_plan_places_each_piece_once(counts):
    seen, fill = Counter(), defaultdict(list)
    for length, number, each, first, offset in packing.plan(counts, 10):
        after = [x[1] for x in packing.plan(counts, 10) if x[0] == length and x[1] > number]
        for k in range((min(after) if after else counts[length]) - number):
            seen[length] += 1
            fill[first + k // each].append((offset + k % each * length, length))
    assert seen == Counter(counts)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 10


def test_pii(spark):
    text = "mail a.b@c.de, x@y 300.1.1.1 10.0.0.255 card 4111 1111 1111 1111 and +1 (555) 555-0100; iban DE89 3704 0044 0532 0130 00. a@b.c@d.e"
    spans = pii.find(text)
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [("email", "a.b@c.de"), ("email", "a@b.c"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 555-0100"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.find("call 123-45-6789") == [] and [s.kind for s in pii.find("SSN 123-45-6789")] == ["ssn"]
    assert {r.doc_id: len(r.spans) for r in pii.pii_spans(docs(spark, [text, None, ""])).collect()} == {0: 6, 1: 0, 2: 0}


def test_short_cards_and_ibans_before_capitals():
    found = lambda text: [(s.kind, text[s.start : s.end]) for s in pii.find(text)]
    assert found("Amex card 3782 822463 10005.") == [("short_card", "3782 822463 10005")] and found("order 3782 822463 10005") == found("card 3782 822463 10006") == []
    assert found("ES91 2100 0418 4502 0005 1332 EUR") == [("iban", "ES91 2100 0418 4502 0005 1332")] and found("AT61 1904 3002 3457 3201 BIC") == [("iban", "AT61 1904 3002 3457 3201")]
    assert found("AT611904300234573201 ES9121000418450200051332 TO") == [("iban", "AT611904300234573201"), ("iban", "ES9121000418450200051332")]
    assert found("ES91 2100 0418 4502 0005 1333 EUR") == [] and {k: n for k, n in pii._IBAN_SIZE.items() if k in ("DE", "MT", "NO")} == {"DE": 22, "MT": 31, "NO": 15}


def test_secrets_are_judged_by_their_owners(spark):
    shared, own, bare = "Zx9" * 8, "deadbeef" * 5, "aB3" * 9
    values = [f'token = "{shared}"', f"API_key:{shared} é", f"secret={shared}", f"token = '{own}'", bare, f"pwd {bare} AKIA{'A1' * 8}", None, "token=abc", f"secret:token:{own}"]
    values += [f"hash {'0a1b' * 7}"] * 3  # copies of one text are one repository, whoever has them
    found = secrets.secret_spans(docs(spark, values)).collect()
    rows = {r.doc_id: [(s.kind, s.live, s.start, s.end) for s in r.spans] for r in found}
    assert [(s.repositories, s.owners) for i in (0, 3, 10) for r in found if r.doc_id == i for s in r.spans] == [(3, 3), (2, 1), (2, 1), (1, 1)] and [x[1] for i in (9, 10, 11) for x in rows[i]] == [True] * 3
    assert [x[:2] for x in rows[0]] == [("assign", False)] and [x[:2] for x in rows[3]] == [("assign", True), ("hex", True)]
    assert rows[4] == [("opaque", True, 0, 27)] and {x[0] for x in rows[5]} == {"opaque", "access"} and rows[6] == rows[7] == [] and [x[0] for x in rows[8]] == ["hex"]
    out = {r.doc_id: r for r in secrets.redacted(docs(spark, values)).collect()}
    assert out[0].text == values[0] and out[3].text == "[SECRET]'" and out[3].n_chars == 9 and out[6].text is None and out[8].text == "secret:token:[SECRET]"
    assert secrets.secret_spans(docs(spark, values).limit(0)).count() == 0


def test_secrets_are_those_of_brute_force(spark):
    """All spans, counts and verdicts against the patterns in another engine and plain counting, over texts put together from
    pieces of every kind, some of them touching."""
    rng = random.Random(11)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
    some = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    values = [some(0, 26), some(2, 30), some(2, 8), "AKIA" + some(1, 16), "AKIA" + some(1, 15), some(0, 23), "\U0001f600é", "word", "-" * 30]
    piece = lambda: rng.choice([rng.choice(values), f"{rng.choice(['Password', 'api_key', 'APIKEY', 'to\u212aen', 'secret'])}{rng.choice(['=', ' : ', '\": \"', '\t='])}{rng.choice(values)}"])
    texts = [None, ""] + [rng.choice([" ", "", "\n", ","]).join(piece() for _ in range(rng.randint(1, 6))) for _ in range(250)]
    texts += texts[5:15]

    def base(t):
        spans = [(m.start(), 0, "assign", m.end(), m[2]) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return spans + [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]

    found = {}
    for i, t in enumerate(texts):
        first = base(t or "")
        more = [(m.start(), 3, "opaque", m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]+", t or "") if len(m[0]) >= 24 and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
        found[i] = sorted(first + [x for x in more if not any(y[0] < x[3] and x[0] < y[3] for y in first)])
    owner = {}
    for i, spans in found.items():
        for x in spans:
            own = owner.setdefault(x[4], {})
            own[texts[i]] = min(own.get(texts[i], "z"), f"s{i % 5}")
    counts = {v: (len(o), len(set(o.values()))) for v, o in owner.items()}
    live = {v: not (a >= 3 and b >= 3) for v, (a, b) in counts.items()}
    want = {i: [(k, a, b, live[v], *counts[v]) for a, _, k, b, v in spans if k != "opaque" or live[v]] for i, spans in found.items()}
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.secret_spans(docs(spark, texts)).collect()} == want
    assert {True, False} == set(live.values()) and {"assign", "access", "hex", "opaque"} == {x[0] for s in want.values() for x in s}


def wrapped(mark, *names, width=72, numbered=()):
    """Sentences of a licence as a file has them: wrapped, indented or behind comment marks, in paragraphs."""
    import textwrap

    out = []
    for n in names:
        text = " ".join(licenses.SENTENCES[n].split())
        lines = textwrap.wrap(f"{numbered.index(n) + 1}. {text}" if n in numbered else text, width, subsequent_indent="   " * (n in numbered))
        out += [*(mark + x for x in lines), mark.rstrip()]
    return "\n".join(out)


BSD = ("BsdGrant", "BsdSource", "BsdBinary", "BsdName", "BsdWarranty", "BsdLiability")
APACHE_HEADER = """#!/bin/sh
# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
echo done
"""
MIT_FILE = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_HEADER = """/* frob.c
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() { return 0; }
"""
MPL_HEADER = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at http://mozilla.org/MPL/2.0/.
let x = 1;
"""
LICENCE_CASES = [
    ("Released under the MIT License.", ["MIT"]), ("x.\nLicensed under the Apache License, Version 2.0. And so on.\nThis work is licensed under the GNU General Public License, version 3.", ["Apache-2.0", "GPL-3.0-only"]),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", ["unknown"]),
    (MIT_FILE, ["MIT"]), (MIT_FILE.replace("\n", "\r\n"), ["MIT"]), (APACHE_HEADER, ["Apache-2.0"]), (GPL_HEADER, ["GPL-3.0-or-later"]), (MPL_HEADER, ["MPL-2.0"]),
    (wrapped(" * ", *BSD, numbered=BSD[1:4]), ["BSD-3-Clause"]), (wrapped("", *(x for x in BSD if x != "BsdName"), numbered=BSD[1:3]), ["BSD-2-Clause"]),
    (wrapped("", *BSD[:3]) + "Something that nobody knows must hold as well.\n\n" + wrapped("", *BSD[4:]), ["unknown"]),
    (wrapped("-- ", "IscGrant", "IscWarranty", "IscLiability"), ["ISC"]), (wrapped("", "UnlicenseFree"), ["Unlicense"]), (wrapped("; ", "Cc0Waiver"), ["CC0-1.0"]),
    *((wrapped("# ", k), [v]) for k, v in licenses.RULES if k in ("Gpl2Only", "Gpl2Later", "Lgpl21Later", "Lgpl3Later", "Agpl3Later", "CcBy4", "CcBySa4")),
    *((f"// SPDX-License-Identifier: {x}\nimport this", [x]) for x in licenses.SPDX), ("SPDX-License-Identifier: Nobody-1.0", []), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("// SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-only WITH Classpath-exception-2.0\nx", ["BSD-3-Clause", "GPL-2.0-only", "MIT"]),
    ("# SPDX-License-Identifier: GPL-2.0+\n", ["GPL-2.0-or-later"]), ("# SPDX-License-Identifier: LGPL-2.1\n", ["LGPL-2.1-only"]), ("SPDX-License-Identifier: MIT OR Nobody-1.0", ["MIT"]),
    (wrapped("", *BSD, numbered=BSD[1:4]).replace("the copyright holder nor", "the University nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"), ["BSD-3-Clause"]),
    (wrapped(" * ", *BSD, numbered=BSD[1:4]).replace("the copyright holder nor", "Example Organisation, Inc. nor"), ["BSD-3-Clause"]),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", ["Apache-2.0"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n                            Preamble\n", ["GPL-3.0-only"]),
    ("/*\n * This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License v. 2.0 which is available at\n * http://www.eclipse.org/legal/epl-2.0.\n */", ["EPL-2.0"]),
    (wrapped("  ", "ZlibWarranty", "ZlibLiability") + wrapped("  ", "ZlibGrant"), ["Zlib"]),
    ("a licensed thing", []), (None, []), ("", []), ("\n\n", []),
]


def test_licences_as_published(spark):
    import duckdb

    df = docs(spark, [t for t, _ in LICENCE_CASES])
    got = {r.doc_id: r.licences for r in licenses.licence_scan(df).collect()}
    assert got == {i: x for i, (_, x) in enumerate(LICENCE_CASES)}
    assert all(any(a in s for a in licenses.ANCHORS) for s, name in licenses.KNOWN.items() if name)
    with duckdb.connect() as db:
        documents = df.select("doc_id", "text").toPandas()  # noqa: F841
        twin = {i: x for i, *_, x in db.execute(licenses.ORACLE_SQL["op3_licences"]).fetchall()}
    assert twin == {i: ",".join(x) for i, x in got.items()}
    assert licenses.licence_scan(df.limit(0)).count() == 0


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (20, 11), (11, 15), (15, 13), *((100 + i, 101 + i) for i in range(40))]
    want = Union()
    for a, b in pairs:
        want.join(a, b)
    got = {r.id: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: want.root(x) for p in pairs for x in p}
    flat = spark.createDataFrame([(5, 4), (7, 2), (8, 2)], "a long, b long")  # nothing is left to do, and the least ids have no link of their own
    assert {r.id: r.component for r in links.components(flat).collect()} == {4: 4, 5: 4, 2: 2, 7: 2, 8: 2}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_is_exact(spark, monkeypatch):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice([2, 4, 9, 14, 30, 80, 200]))] for _ in range(30)]
    values = [None, "", " \t", "One", "one ", "a b", "A  B"]
    for _ in range(200):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 60)}"
        values.append(" ".join(words))
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if (w := re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) else set() for i, t in enumerate(values)}
    want = Union()
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                want.join(i, j)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, values)).collect()}
    assert got == {i: (len(s), want.root(i)) for i, s in sets.items()}
    monkeypatch.setattr(links.cells, "__defaults__", (4, False, None))
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    assert got == {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, values)).collect()}


def test_deletions_are_bought_where_they_pay_and_keep_links():
    """Allocations forgive as many differences as two linked sets can have. In production, bands of some dozen tokens have
    one-deletion neighbourhoods at 90 percent; with many related documents, all bands have, at either percentage. The more
    documents there are, the fewer bands: what a deletion key brings together by chance grows with them."""
    of = lambda percent, documents: [top for top in range(5, 400) if ngram_join.allocation(top, percent, documents)[0]]
    assert (of(90, 10**4)[0], of(90, 10**4)[-1], len(of(90, 10**4))) == (10, 115, 96) and (of(90, 10**6)[0], of(90, 10**6)[-1], len(of(90, 10**6))) == (15, 37, 10)
    assert not of(90, 10**9) and not any(of(80, n) for n in (10**4, 10**6, 10**9))
    assert [ngram_join.allocation(top, 90, 50_000) for top in (12, 30, 45, 60, 200)] == [(1, 0), (2, 0), (2, 1), (3, 1), (0, 23)]
    rng, linked = np.random.default_rng(0), 0
    for percent, related in ((90, 30.0), (90, 1000.0), (80, 1000.0)):
        for top in (12, 30, 60, 90, 200, 700):
            most = ngram_join.differences(top, top, percent)
            for documents in (1, 50_000, 10**12):
                deleting, whole = ngram_join.allocation(top, percent, documents, related)
                assert 2 * deleting + whole >= most + 1
            deleting, whole = ngram_join.allocation(top, percent, 50_000, related)
            assert deleting > 0 or related == 30 and top > 60 or (percent, top) == (80, 12)
            for _ in range(15 if deleting else 0):
                x = np.unique(rng.integers(0, 1 << 62, top).astype(np.uint64))
                gone = int(rng.integers(0, most // 2 + 1))
                y = np.union1d(x[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, gone + 1))).astype(np.uint64))
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    linked += 1
                    with pytest.MonkeyPatch.context() as patch:
                        patch.setattr(ngram_join, "allocation", lambda *_, a=(deleting, whole): a)
                        first, second = (set(ngram_join.band_keys(z, 3, top, percent, 50_000).tolist()) for z in (x, y))
                    assert first & second
    assert linked > 100


@pytest.mark.parametrize(("percent", "documents"), [(80, 1), (80, 20_000), (80, 10**12), (90, 20_000), (90, 10**12), (50, 20_000)])
def test_linked_sets_share_a_key(percent, documents):
    """Leaving out the emptiest segments loses no link, at sizes of neighbouring bands and with every kind of segment."""
    rng, linked = np.random.default_rng(5), 0
    starts = ngram_join.bands(percent, 1000)
    for _ in range(400):
        x = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 250))).astype(np.uint64))
        gone = int(rng.integers(0, len(x) // 4 + 1))
        y = np.union1d(rng.permutation(x)[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, gone + 2))).astype(np.uint64))
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        linked += 1
        found = []
        for z in (x, y):
            own = max(i for i, s in enumerate(starts) if s <= len(z))
            found.append({int(k) for b in (own, own + 1) for k in ngram_join.band_keys(z, b, starts[b + 1] - 1, percent, documents)})
        assert found[0] & found[1]
    assert linked > 50


def test_tied_keys_keep_components():
    rng = np.random.default_rng(6)
    for _ in range(50):
        key, value = rng.integers(0, 20, 60), rng.integers(0, 30, 60)
        want, got = Union(), Union()
        k, v = ngram_join.tied(key, value)
        for union, ks, vs in ((want, key, value), (got, k, v)):
            for a, b in zip(ks.tolist(), vs.tolist(), strict=True):
                union.join(b, 10**6 + a if a in range(20) else a)
        groups = [{frozenset(y for y in value.tolist() if u.root(y) == u.root(x)) for x in value.tolist()} for u in (want, got)]
        assert groups[0] == groups[1]
        assert len(np.unique(np.stack([k, v], 1), axis=0)) == len(k)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(rng.randint(0, n)))
    a = [word(12) for _ in range(600)]
    b = [x[: (k := rng.randint(0, len(x)))] + word(2) + x[k + rng.randint(0, 2) :] for x in a]
    assert line_dedup.near(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize(("edits", "hot"), [(1, 64), (2, 64), (2, 3)])
def test_line_dedup(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(links.cells, "__defaults__", (4, False, None))
    rng = random.Random(hot + edits)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(12)]
    values = [None, "", "\n\n"]
    for _ in range(50):
        lines = [list(rng.choice(base)) for _ in range(rng.randint(1, 5))]
        for x in lines:
            x[rng.randrange(len(x))] = rng.choice("abcd")
        values.append("\n".join(map("".join, lines)))
    seen = [(i, k, x) for i, t in enumerate(values) for k, x in enumerate((t or "").split("\n")) if len(x) >= 4]
    distinct, near = sorted({x for *_, x in seen}), Union()
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if abs(len(x) - len(y)) <= edits and distance(x, y) <= edits:
                near.join(x, y)
    first, gone = {}, defaultdict(set)
    for i, k, x in seen:
        if first.setdefault(near.root(x), (i, k)) != (i, k):
            gone[i].add(k)
    out = {r.doc_id: r.text for r in line_dedup.deduplicated(docs(spark, values), edits, 4, 1).collect()}
    assert out == {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(values)}


def test_pipeline_cuts_all_but_verified_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(12))
    a, b, own = [line() for _ in range(4)], [line() for _ in range(4)], [line() for _ in range(4)]
    values = ["\n".join(a), "\n".join(b), "\n".join([*a[:3], own[0]]), "\n".join([*a[:2], *b[:2]]), "\n".join([*a[:2], *b[:2], own[1]]), "\n".join(a) + " end", "\n".join([own[2], own[2], own[2], own[3]])]
    out = {r.doc_id: r.text for r in corpus_pipeline.fresh_lines(spark, docs(spark, values), "").collect()}
    assert out == {0: values[0], 1: values[1], 2: own[0], 3: "", 4: own[1], 5: values[5], 6: "\n".join(own[2:])}
    left = corpus_pipeline.no_near_duplicates(spark, docs(spark, [out[i] for i in range(7)]), "")
    assert {r.doc_id for r in left.collect()} == {0, 1, 2, 3, 4, 6}


def test_no_line_goes_with_a_copy_that_is_dropped(spark):
    """What begins in a near copy stays in the documents that have it too, whatever the copy's fate."""
    import corpus_pipeline

    rng = random.Random(14)
    line = lambda: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(10))

    def left(values):
        cut = {r.doc_id: r.text for r in corpus_pipeline.fresh_lines(spark, docs(spark, values), "").collect()}
        kept = corpus_pipeline.no_near_duplicates(spark, docs(spark, [cut[i] for i in range(len(values))]), "").collect()
        return {r.doc_id: r.text for r in kept}

    own, x = [line() for _ in range(30)], line()
    values = [line(), line(), line(), "\n".join(own), line(), "\n".join([*own[:15], x, *own[15:]]), line(), "\n".join([line(), x, line()])]
    out = left(values)
    assert 5 not in out and x in out[7].split("\n") and out[3] == values[3]
    dropped = 0
    for _ in range(2):
        shared, values = [line() for _ in range(6)], []
        for i in range(24):
            if i > 4 and rng.random() < 0.4:
                base = rng.choice(values).split("\n")
                base.insert(rng.randrange(len(base) + 1), rng.choice([line(), *shared]))
                values.append("\n".join(base))
            else:
                values.append("\n".join([line() for _ in range(rng.randint(1, 20))] + rng.sample(shared, rng.randint(0, 3))))
        out = left(values)
        there = {y for text in out.values() for y in text.split("\n")}
        assert all(y in there for i in out for y in values[i].split("\n"))
        dropped += 24 - len(out)
    assert dropped > 3


@pytest.mark.parametrize("hot", [64, 3])
def test_budgets_hold_in_hot_keys(spark, monkeypatch, hot):
    """Lines of 20 to 60 characters whose budget is their own, many of which share a key: links and removals of brute force."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(15)
    some = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    values = ["Chapter headings, " + some(rng.randint(4, 7)) for _ in range(40)] + ["A longer heading of chapters, namely " + some(rng.randint(6, 20)) for _ in range(40)]
    values += [x[:-2] + some(rng.randint(1, 3)) for x in rng.sample(values, 30)]
    allowed = lambda x, y: int(line_dedup.budget(np.array([min(len(x), len(y))]))[0])
    distinct = sorted(set(values))
    near = {x: [y for y in distinct if y != x and distance(x, y) <= allowed(x, y)] for x in distinct}
    rows = {r.doc_id: r for r in line_dedup.line_classes(docs(spark, values)).collect()}
    seen, classes = set(), set()
    for i, x in enumerate(values):
        grown, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()]:
                if y not in grown:
                    grown.add(y)
                    todo.append(y)
        alone = len(grown) == 1 and values.count(x) == 1
        assert rows[i].links == ("" if alone else f"0:{len(near[x])}") and rows[i].removed == ("0" if seen & grown else "")
        seen.add(x)
        classes.add(frozenset(grown))
    assert 1 < len(classes) < len(distinct) and any(len(x) > 1 for x in near.values())


def test_keys_hot_over_many_chunks_meet(monkeypatch):
    """A key below what is hot in each of many chunks does not swell its bucket, and loses no row."""
    from statrill.llm import meeting

    monkeypatch.setattr(meeting, "CHUNK", 64)
    monkeypatch.setattr(meeting, "MOST", 128)
    rows, common, rare = 64 * 50, np.uint64(0x1234567800000010), np.uint64(0x9234567800000020)
    hot = meeting.within_chunk(rows)
    assert hot == 2 and meeting.within_chunk(10) == 64 and meeting.within_chunk(10**12) == 1
    own, apart = 0, 0
    for base in range(0, rows, 64):
        place = np.array([1, 2, 3, 4], np.int64)
        packed = meeting.packed(base, place, np.array([common, common, common, rare]), np.ones(4, bool), 64, hot)
        own += sum(len(x) // 2 for b, x in zip(packed["bucket"], packed["rows"], strict=True) if b >= 0)
        apart += sum(len(x) // 2 for b, x in zip(packed["bucket"], packed["rows"], strict=True) if b < 0)
        assert sum(len(x) // 4 for x in packed["marks"]) == 1
    assert (own, apart) == (50, 150)


def test_what_is_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    from statrill.llm import links

    narrow, wide = spark.range(1000), spark.range(1000).select("id", F.repeat(F.lit("x"), 5000).alias("fingerprint"))
    arrays = spark.range(1000).select("id", F.sequence(F.lit(1), F.lit(600)).alias("places"))
    assert links.weight(narrow) < 50_000 < 4_000_000 < min(links.weight(wide), links.weight(arrays))
    monkeypatch.setattr(links, "BROADCAST_BYTES", 1 << 20)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(links.small(narrow)) and not hinted(links.small(wide)) and not hinted(links.small(arrays))
    assert links.weight(spark.range(0)) == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_line_classes_and_exact_links(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(links.cells, "__defaults__", (4, False, None))
    rng = random.Random(hot)
    base = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(5)]
    values = [None, ""]
    for _ in range(40):
        some = [list(rng.choice(base)) for _ in range(3)]
        for x in some:
            x[rng.randrange(6)] = rng.choice("abcd")
        values.append("\n".join(map("".join, some)))
    seen = [(i, k, x) for i, t in enumerate(values) for k, x in enumerate((t or "").split("\n")) if len(x) >= 4]
    distinct, near, degree = sorted({x for *_, x in seen}), Union(), Counter()
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if distance(x, y) <= 1:
                near.join(x, y)
                degree.update([x, y])
    often = Counter(near.root(x) for *_, x in seen)
    rows = {r.doc_id: r for r in line_dedup.line_classes(docs(spark, values), 1, 4, 1).collect()}
    parts = lambda text: {int(x.split(":")[0]): x.split(":")[1] for x in text.split(",") if x}
    want = {(i, k): x for i, k, x in seen if often[near.root(x)] > 1}
    assert {(i, k): n for i, r in rows.items() for k, n in parts(r.links).items()} == {at: str(degree[x]) for at, x in want.items()}
    got = {(i, k): c for i, r in rows.items() for k, c in parts(r.classes).items()}
    assert got.keys() == want.keys() and len({(got[at], near.root(x)) for at, x in want.items()}) == len(set(got.values())) == len({near.root(x) for x in want.values()})
    assert all(r.n_removed == len(r.removed.split(",")) - (r.removed == "") for r in rows.values())


def test_production_finds_changed_words_and_equal_short_lines(spark):
    a = "the quick brown fox jumps over the lazy dog and runs into the wood"
    values = [a, a.replace("fox", "cat"), a.replace("fox", "hens") + ".", "short\n\n----\n ", "x\nshort\n\n----\n "]
    rows = {r.doc_id: r for r in line_dedup.line_classes(docs(spark, values)).collect()}
    assert {i: r.removed for i, r in rows.items()} == {0: "", 1: "0", 2: "", 3: "", 4: "1,3"}
    assert rows[0].links == rows[1].links == "0:1" and rows[0].classes == rows[1].classes and rows[3].links == "0:0,2:0"


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_key(edits):
    rng = random.Random(edits)
    for _ in range(300):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(4, 40)))
        b = list(a)
        for _ in range(edits):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        b = "".join(b) or "a"
        long, short = sorted((a, b), key=len, reverse=True)
        found = defaultdict(set)
        for at, key, indexed in line_dedup.keys([long, short], edits, 1):
            for i, k in zip(at.tolist(), key.tolist(), strict=True):
                found[i, indexed].add(k)
        assert distance(a, b) > edits or len(short) <= edits or (found[0, True] | found[0, False]) & found[1, True]


def test_spot_signatures(spark):
    values = [f"the fox that jumped over lazy dog {i} with a green hat" for i in range(5)] + ["", None, "zz", "zz", "that red fox is very quick for brown dogs"]
    rows = {r.doc_id: r for r in spotsigs.followed(docs(spark, values)).collect()}
    assert [rows[i].after for i in range(10)] == [values[i - 1] or "" for i in range(10)]
    signs = [spotsigs.signatures(t or "") for t in values]
    assert signs[7] == signs[8] and len({spotsigs.fingerprint(s) for s in signs}) == 9 - 1 - (signs[5] == signs[6]) + 1 - (len(set(signs[:5])) < 5) * (5 - len(set(signs[:5])))
    want = Union()
    for i in range(10):
        for j in range(i):
            if spotsigs.likeness(signs[i], signs[j]) >= 0.8:
                want.join(i, j)
    assert {r.doc_id: r.class_id for r in spotsigs.near_duplicates(docs(spark, values)).collect()} == {i: want.root(i) for i in range(10)}
    assert spotsigs.edited("abcde", "xyz") == "abcxy" and spotsigs.edited("", "x") == ""


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 50)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(12)]
    rows += [(300, None), (301, []), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (305, [1.0, 2.0]), (50, [0.1] * 8)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    ints = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    want = set()
    for q, x in ints:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ints if i != q and len(x) == len(y))
            want |= {(q, -s, i) for s, i in scores[:5]} if q != 50 else set()
    got = [tuple(r) for r in topk.top_k(df.where("id % 50 = 0"), df, 5).collect()]
    assert {(q, s, i) for q, _, i, s in got if q != 50} == want


def test_quality_learns_what_it_is_shown(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "fox", "runs", "over", "green", "hills", "and", "sleeps"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "###"]) + "!!" for _ in range(40))
    rows = [(i, (good if (kind := rng.random() < 0.7) else bad)(), int(kind)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2] + [(7, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scored(df, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    high, low = ([got[i] for i, _, q in held if q == k] for k in (1, 0))
    assert sum(a > b for a in high for b in low) >= 0.99 * len(high) * len(low) and min(high) >= 0.3 and 0 <= got[None] <= 1
    assert {r.score for r in quality.scored(df, labels.limit(0)).collect()} == {quality.PRIOR}
    assert [r[0] for r in df.select(quality.held_out(F.col("doc_id"))).limit(50).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ra", "te", "su"]) for _ in range(rng.randint(1, 4)))
    clean = ["\n".join(" ".join(word() for _ in range(30)) + "." for _ in range(4)) for _ in range(60)]
    near = clean[3].split(" ")
    near[50] = "changed"
    values = [*clean, clean[5], " ".join(near), "BUY!! NOW!! " * 40, clean[0] + f'\ntoken = "{"ab12" * 10}"', "same boilerplate line for every page\n" + clean[1][::-1], "same boilerplate line for every page\n" + clean[2][::-1]]
    docs(spark, values).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 62)) for i in range(0, 66, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        kept, table = table, spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(60)) <= ids and not ids & {60, 61}
    assert {r.doc_id for r in table.collect()} == ids and not kept.where("text like '%ab12ab12%'").count()
