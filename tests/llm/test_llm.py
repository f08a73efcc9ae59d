"""The operators of the text pipeline against brute force, round trips and odd inputs."""

import hashlib
import json
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from topolidar.llm import bpe, chunks, contamination, language_model, licenses, quality, separators, simhash, tool_calls, toxicity
from topolidar.llm import queries as llm_queries
from topolidar.llm.components import components

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PROSE = " ".join(f"word{i % 97}x{i * 7 % 53}" for i in range(400))

#: Nulls in any column, empty and very long texts, ties, repeated rows, an id of several texts, texts without words.
ODD = [
    (1, PROSE, "en", "s", 5), (2, PROSE, "en", "s", 5), (2, PROSE, "en", "s", 5), (3, None, "en", None, None), (4, "", None, "s", 0), (None, PROSE + " more", "en", "s", 1), (None, None, None, None, None),
    (5, " \n\t ", "en", "s", 4), (6, "a", "en", "s", 1), (7, "lorem " * 120_000, "en", "s", 1), (7, "other text of the same id", "en", "s", 1), (8, "éß漢字 \U0001f600 naïve \x1c ²", "x", "s", 1), (9, "x" * 70_000, "x", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "ids", "fp", "mark", "row", "words", "postings", "n_words", "kept", "digest", "found", "component_id", "term", "cell"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# 1 and 8


def tik():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_round_trip_and_offsets(odd):
    enc = tik()
    out = bpe.decode(bpe.encode(odd, PATH, PATTERN, keep=["text", "lang"]), PATH, keep=["text"])
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert list(r["ids"]) == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in bpe.encode(odd, PATH, PATTERN, keep=["text"], round_trip=True).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in bpe.encode(odd.where("doc_id = 8"), PATH, PATTERN, keep=["text"]).collect():
        strings = {i: t for t, i in bpe.read_ranks(PATH).items()}
        for i, a, b in zip(r["ids"], r["char_starts"], r["char_stops"], strict=True):
            piece = r["text"][a:b].encode()
            assert strings[i] in piece and len(r["text"][a + 1 : b - 1].encode()) <= len(strings[i])


def test_decoding_odd_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>").withColumn("decoded", F.lit("clash"))
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df.drop("decoded"), PATH).collect()}
    strings = {i: t for t, i in bpe.read_ranks(PATH).items()}
    assert bytes(got[3]) == strings[0] + strings[1] and not got[2] and not got[1]
    with pytest.raises(Exception, match="Error"):
        bpe.decode(spark.createDataFrame([(1, [10_000_000])], "doc_id long, ids array<int>"), PATH).collect()


def test_bpe_equals_tiktoken_on_random_bytes():
    rnd, enc = random.Random(7), tik()
    coder, keys = bpe.BytePairs(bpe.tokenizer_json(PATH), PATTERN), list(bpe.read_ranks(PATH))
    texts = [b"".join(rnd.choice(keys) for _ in range(6)).decode("utf-8", "ignore") for _ in range(2000)] + [c * n for c in "=a \n-" for n in range(1, 60)]
    flat, ends = coder.encode(texts)
    for t, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert flat[a:b].tolist() == enc.encode_ordinary(t)


def test_separator_scan_over_blocks(spark):
    rnd, rows, want = random.Random(5), [], {}
    for f in range(4):
        ids = [rnd.choice([9, 9, 1, 2] if f % 2 else [1, 2, 3] * 9 + [9]) for _ in range(rnd.randint(1, 200))]
        rows += [(f"f{f}", b // 7, np.array(ids[b : b + 7], "<u2").tobytes()) for b in range(0, len(ids), 7)]
        start = order = 0
        for i, x in enumerate([*ids, 9]):
            if x == 9 and (i < len(ids) or start < len(ids)):
                want[f"f{f}", order] = (start, i - start, i < len(ids))
                order, start = order + 1, i + 1
    blocks = spark.createDataFrame(rows, "file string, block long, data binary")
    before, separators.GROUP_BLOCKS = separators.GROUP_BLOCKS, 3
    try:
        got = {(r["file"], r["ordinal"]): (r["start"], r["n_tokens"], r["closed"]) for r in separators.document_counts(blocks, 9).collect()}
        assert got == want
        assert separators.document_counts(blocks.limit(0), 9).count() == 0
    finally:
        separators.GROUP_BLOCKS = before


def test_token_files_are_read_in_blocks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 3, 9, 9, 4], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = separators.document_counts(separators.read_token_files(spark, str(tmp_path), block_tokens=2), 9)
    assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in got.collect()) == [(0, 0, 2, True), (1, 3, 1, True), (2, 5, 0, True), (3, 6, 1, False)]


def test_packing_odd_rows(spark):
    rows = [(1, [1, 2]), (1, [3]), (None, [4, 5, 6]), (2, None), (3, []), (4, list(range(10, 3000)))]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumns({"file": F.lit(1), "block": F.lit("x")}).repartition(2)
    for width in (2, 4):
        blocks, order = separators.pack(df, 9, width, block_tokens=64)
        got = separators.document_counts(blocks, 9, width).join(order, ["file", "ordinal"])
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got.collect()) == sorted((i or -1, len(x or [])) for i, x in rows)
    blocks, order = separators.pack(df.limit(0), 9)
    assert separators.document_counts(blocks, 9).count() == 0 and order.count() == 0
    for wrong, separator in ([9], 9), ([65536], 9), ([-1], 9):
        with pytest.raises(Exception, match="ids must be"):
            separators.pack(spark.createDataFrame([(1, wrong)], "doc_id long, ids array<int>"), separator)
    with pytest.raises(ValueError):
        separators.pack(df, 65536)


def test_counts_of_packed_documents(spark, docs):
    enc = tik()
    got = by_id(llm_queries.op1_separator_scan(spark, SF), "n_tokens")
    assert got == {i: (len(enc.encode_ordinary(t)),) for i, t in docs.items()}


# 2


def slow_cuts(text, rule):
    gears, cuts, h = chunks.gear_table().tolist(), [0], 0
    for i, b in enumerate(text):
        if i and b not in chunks.SPACES and text[i - 1] in chunks.SPACES and (h & ((1 << rule.window) - 1)) < (1 << rule.window) // rule.words:
            cuts.append(i)
        h = ((h << 1) + gears[b]) & 0xFFFFFFFF
    return cuts


def test_cuts_are_those_of_a_rolling_hash(docs):
    rule = chunks.Chunking()
    for t in list(docs.values())[:40]:
        b = t.encode()
        assert chunks.cut(np.frombuffer(b, np.uint8), np.array([0, len(b)]), rule).tolist() == slow_cuts(b, rule)


def test_repeats_go_and_first_ones_stay(spark, docs):
    rule, seen, want = chunks.Chunking(), set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        edges = [*slow_cuts(b, rule), len(b)]
        pieces, own, out, run = [b[x:y] for x, y in zip(edges, edges[1:], strict=False)], set(), b"", b""
        for p in [*pieces, None]:
            if p is not None and (p in seen or p in own):
                run += p
                continue
            out, run = out + (run if len(run) < rule.least else b"") + (p or b""), b""
            own.add(p)
        seen |= own
        want[i] = (out.decode(),)
    assert by_id(llm_queries.op2_chunk_dedup(spark, SF), "text") == want


def test_passage_that_moves_is_found(spark):
    rnd = random.Random(1)
    line = lambda n: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    passage = line(80)
    df = spark.createDataFrame([(1, line(40) + " " + passage), (2, passage + " " + line(33)), (3, line(90))], "doc_id long, text string")
    got = by_id(chunks.dedup_substrings(df), "removed_bytes")
    assert got[1][0] == 0 and got[3][0] == 0 and got[2][0] > 0.6 * len(passage)


def test_forced_cuts_fall_between_characters(spark):
    long = "\u8a9e" * 1400
    rows = [(1, long), (2, long + "\u672b"), (3, "x" + "\U0001f600" * 9000), (4, "x" + "\U0001f600" * 9000), (5, "\u00e9" * 200_000)]
    got = by_id(chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")), "text", "removed_bytes")
    for i, t in rows:
        text, gone = got[i]
        assert len(text.encode()) + gone == len(t.encode())
    assert got[1][1] == 0 and got[2][1] > 4000 and got[4][0] == ""


# 3


AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{0}1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

{1}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
NAME = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
ISC = """Copyright 2019 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GNU = """This {1} is free software{2} you can redistribute it and/or
modify it under the terms of the GNU {0}General Public
License as published by the Free Software Foundation; either
version {3} of the License, or (at your option) any later version.

This {1} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {0}General Public License for more details.
"""


def test_licence_texts_as_they_are(spark):
    commented = lambda t, mark: "\n".join((mark + line).rstrip() for line in t.splitlines())
    cases = [
        (MIT + AS_IS, ["MIT"], 0), (commented(MIT + AS_IS, "// "), ["MIT"], 0), (commented(MIT + AS_IS, " * "), ["MIT"], 0),
        (BSD.format("\n", NAME), ["BSD-3-Clause"], 0), (BSD.format("", ""), ["BSD-2-Clause"], 0), (BSD.format("", NAME), ["BSD-3-Clause"], 0), (BSD.format("", NAME).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), ["BSD-3-Clause"], 0),
        (ISC, ["ISC"], 0), (APACHE, ["Apache-2.0"], 0), (commented(APACHE, "# "), ["Apache-2.0"], 0), (MPL, ["MPL-2.0"], 0), (commented(MPL, " * "), ["MPL-2.0"], 0),
        (GNU.format("Lesser ", "library", ";", "2.1"), ["LGPL-2.1-or-later"], 0), (GNU.format("Affero ", "program", ":", "3"), ["AGPL-3.0-or-later"], 0), (GNU.format("", "program", ":", "3"), ["GPL-3.0-or-later"], 0), (GNU.format("", "program", ";", "2"), ["GPL-2.0-or-later"], 0),
        ("// SPDX-License-Identifier: MPL-2.0\ncode", ["MPL-2.0"], 0), ("SPDX-License-Identifier: nothing", [], 0), ("Text.\nReleased under the MIT License.\nMore text.", ["MIT"], 0), ("Licensed under CC BY-NC 4.0. All rights reserved.", ["CC-BY-NC-4.0"], 1),
        ("Copyright law has changed. Copyright holders know.", [], 0), (AS_IS, [], 2), (MIT + "\n" + APACHE, ["Apache-2.0"], 2), (None, [], 0), ("", [], 0), ("word " * 200_000 + MIT.replace("MIT License", "") + AS_IS, ["MIT"], 0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")
    got = by_id(licenses.license_scan(df), "licenses", "n_unmatched", "sentence_ids")
    for i, (_, names, rest) in enumerate(cases):
        assert got[i][:2] == (names, rest), (i, got[i])
    assert "Copyright" in got[0][2] and "Copyright" in got[7][2] and not got[20][2]


# 4


def test_toxic_words_raise_the_score(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["la", "mi", "ro", "te", "su", "en"]) for _ in range(rnd.randint(1, 4)))
    rows = [(i, " ".join([word() for _ in range(60)] + (["zqag" + word(), "wexx"] * 3 if i % 5 == 0 else []))) for i in range(300)]
    df = spark.createDataFrame([(i, t, int(i % 5 == 0)) for i, t in rows], "doc_id long, text string, toxic int")
    got = by_id(toxicity.toxicity(df, toxicity.train(df.where("doc_id % 3 <> 1"))), "score")
    held = [i for i in range(300) if i % 3 == 1]
    assert sum((got[i][0] >= 0.7) == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    flat = toxicity.train(df.where("toxic = 0"))
    assert all(r["score"] < 0.1 for r in toxicity.toxicity(df, flat).limit(3).collect()) and toxicity.train(df.limit(0)).weights[-1] == 0


def test_ratios_are_those_of_kneser_ney():
    rnd = random.Random(8)
    word = lambda k: "".join(rnd.choice("abcd"[:k]) for _ in range(rnd.randint(1, 9)))
    by_class = tuple(Counter(word(k) for _ in range(300)) for k in (4, 3))
    got = toxicity.Ratios(by_class)
    m, d = toxicity.ORDER, toxicity.DISCOUNT
    own = [Counter(p for w, n in c.items() for p in toxicity.pieces(w) for _ in range(n)) for c in by_class]
    kept = {p for p in own[0] | own[1] if own[0][p] + own[1][p] >= toxicity.LEAST}
    # What each length has: pieces of ORDER characters, then, for shorter ones, the different characters seen before them.
    levels = {m: kept}
    for k in range(m - 1, 0, -1):
        levels[k] = {p[1:] for p in levels[k + 1]}
    before = lambda p: sum(q[1:] == p for q in levels[len(p) + 1])

    def shared(p):
        if not p:
            return 1 / (len(levels[1]) + 1)
        after = [q for q in levels[len(p)] if q[:-1] == p[:-1]]
        if not after:
            return shared(p[1:])
        total = sum(map(before, after))
        return max((before(p) if p in levels[len(p)] else 0) - d, 0) / total + d * len(after) / total * shared(p[1:])

    def chance(c, p):
        after = [q for q in kept if q[:-1] == p[:-1] and own[c][q]]
        total = sum(own[c][q] for q in after)
        if not total:
            return shared(p[1:])
        return max(own[c][p] - d, 0) / total + d * len(after) / total * shared(p[1:])

    some = rnd.sample(sorted(kept), 40)
    for p in some:
        assert got.seen[p] == pytest.approx(math.log(chance(1, p) / chance(0, p)))
        # A continuation that neither class has: backoff weights alone, whatever the shorter pieces say.
        assert got.unseen.get(p[:-1], 0.0) == pytest.approx(math.log(chance(1, p[:-1] + "!") / chance(0, p[:-1] + "!")))
    assert set(got.seen) == kept


# 5


def test_links_and_components_like_brute_force(spark):
    rng = np.random.default_rng(1)
    fps = {0}
    for b in rng.integers(0, 2**63, 30).tolist():
        for _ in range(20):
            f = b
            for k in rng.integers(0, 64, rng.integers(0, 9)).tolist():
                f ^= 1 << k
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
        label = new
    want = {}
    for f, l in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        want.setdefault(l, set()).add(f)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for tile in (1024, 8):
        got = {}
        for r in components(simhash.near_links(df, 4, tile)).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_fingerprints_are_laid_out_by_many_tasks(spark):
    fps = np.random.default_rng(5).integers(-(2**63), 2**63, 30_000)
    df = spark.createDataFrame([(x,) for x in fps.tolist()], "fp long").coalesce(1)
    store, none, gateway = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return [found.apply(i) for i in range(found.size())]

    before = {s.stageId() for s in stages()}
    assert simhash.near_links(df, 4).count() == 0
    of_a_task = [s.peakExecutionMemory() / max(s.numCompleteTasks(), 1) for s in stages() if s.stageId() not in before]
    assert 0 < max(of_a_task) < 200 << 20  # bytes, for 2.1 million rows under masks out of one partition


def test_fingerprint_by_definition():
    import xxhash

    text = "One two THREE four five\nsix one two three four É"
    w = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 4) == want and simhash.fingerprint(b" \n", 4) == 0 and simhash.fingerprint(b"A", 4) == xxhash.xxh64_intdigest(b"a", 42)


# 6


def test_windows_hit_like_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(6)] + ["rare", "Été"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 12, 15, 10, 1, 0])] + [(9, None)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(60)) + ". " + (rnd.choice(items[:4])[1] or "")) for i in range(20)] + [(50, None), (51, "..."), (52, items[1][1].upper())]
    split = lambda t: [x for x in __import__("re").split(contamination.SEPARATORS, "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
    want = {}
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit |= set(range(at, at + n))
                        ids.add(str(item))
        want[i] = (len(w), len(hit), sorted(ids))
    got = contamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert by_id(got, "n_words", "n_hit", "items") == want
    # Tables beyond what is broadcast meet in shuffles.
    before = contamination.BROADCAST_ROWS
    try:
        contamination._small.__defaults__ = (0,)
        got = contamination.contamination(spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit("kept")), spark.createDataFrame(items, "item_id long, text string"), keep=["more"])
        assert by_id(got, "n_words", "n_hit", "items") == want and got.where("more = 'kept'").count() == len(rows)
    finally:
        contamination._small.__defaults__ = (before,)


def test_proximity_finds_shuffled_words(spark):
    items = contamination.items_of(spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha alpha beta")], "item_id long, text string"))
    docs = spark.createDataFrame([(1, "x delta y beta alpha z gamma x"), (2, "alpha beta only"), (3, "beta x x x x x x x alpha delta gamma"), (4, None)], "doc_id long, text string")
    terms = contamination.terms_of(items)
    index = contamination.build_index(docs, terms)
    windows, members = contamination.windows_of(items, terms, index, 4)
    near = contamination.proximity_matches(index, windows, 5).join(members, "window").join(index.where("t = -1").select("row", "doc_id"), "row")
    # The second item needs no second alpha: words are met in any order and as a set.
    assert {(r["doc_id"], r["item_id"]) for r in near.collect()} == {(1, 1), (1, 2), (2, 2)} and contamination.phrase_matches(index, windows).count() == 0


# 7


def test_calls_are_linked_ordered_and_validated(spark):
    calls = [(1, "a", "f", '{"x": 1}'), (1, "b", "f", '{"x": "no"}'), (1, "c", "f", "broken"), (2, "d", "g", "{}"), (2, "e", "f", None), (2, "e2", "f", '{"x": 2, "y": 3}'), (2, None, "f", "{}")]
    needs = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "e2"), ("e2", "d"), ("e", "unknown")]
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}}
    out = tool_calls.link_calls(spark.createDataFrame(calls, "group_id long, call_id string, name string, arguments string"), spark.createDataFrame([("a", "z"), ("a", "y"), (None, "n")], "call_id string, content string"), spark.createDataFrame(needs, "call_id string, needed string"), schema)
    got = {r["call_id"]: r for r in out.collect()}
    assert {k: r["depth"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "e2": None}
    assert {k for k, r in got.items() if r["valid"]} == {"a"} and {k for k, r in got.items() if r["linked"]} == {"a"}
    assert got["a"]["json"] == '{"arguments":{"x":1},"depth":0,"id":"a","name":"f","result":"y"}'
    assert all(json.loads(r["json"]) for r in got.values())


def test_depths_like_brute_force(spark):
    rnd = random.Random(11)
    ids = [f"c{i}" for i in range(120)]
    needs = [(a, rnd.choice(ids)) for a in ids[60:] for _ in range(rnd.randint(0, 3))] + [(ids[i], ids[i - 1]) for i in range(1, 60)] + [("c70", "nobody"), ("elsewhere", "c0"), ("c71", None)]
    of = {a: {b for x, b in needs if x == a and b is not None} for a in ids}
    want, changed = {a: 0 for a in ids if not of[a]}, True
    while changed:
        new = {a: 1 + max(want[b] for b in of[a]) for a in ids if a not in want and of[a] <= want.keys()}
        want |= new
        changed = bool(new)
    assert len(want) < len(ids) and max(want.values()) > 50
    got = tool_calls.depths(spark.createDataFrame([(i,) for i in ids], "call_id string"), spark.createDataFrame(needs, "call_id string, needed string"))
    assert {r["call_id"]: r["depth"] for r in got.collect()} == want


def test_one_long_conversation(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(10_000)] + [(2, 0, "user", ""), (2, 7, "user", "x"), (3, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["call_id"]: r for r in llm_queries.op7_tool_calls(spark, str(tmp_path)).collect()}
    assert {k: r["depth"] for k, r in got.items()} == {f"1:{t}": t // 2 for t in range(0, 10_000, 2)} | {"2:0": 0, "2:7": 1}
    assert not got["2:0"]["valid"] and got["2:7"]["valid"] and not got["2:7"]["linked"] and got["1:0"]["linked"]


def test_arguments_that_json_cannot_say(spark):
    schema = {"f": {"type": ["object", "array"], "properties": {"x": {"type": ["integer", "null"]}, "y": {"type": "strange"}}}}
    cases = {
        "ok": ('{"y": "\\ud83d\\ude00", "x": null}', []), "list": ("[1]", []), "wrong": ('{"x": "s"}', ["$.x: not of type integer or null"]), "half": ('{"x":"\\ud800"}', ["$: no JSON"]), "key": ('{"\\udfff":1}', ["$: no JSON"]),
        "nan": ('{"x":NaN}', ["$: no JSON"]), "inf": ('{"x":1e999}', ["$: no JSON"]), "deep": ("[" * 100_000 + "]" * 100_000, ["$: nested too deep"]), "empty": ("", ["$: no JSON"]), "long": (json.dumps({"x": 1, "y": "é" * 1_000_000}), []), "scalar": ("1", ["$: not of type object or array"]),
    }
    calls = spark.createDataFrame([(1, k, "f", a) for k, (a, _) in cases.items()], "group_id long, call_id string, name string, arguments string").withColumns({c: F.lit(9) for c in ("depth", "content", "linked", "n", "needed", "next")})
    none = spark.createDataFrame([], "call_id string, content string"), spark.createDataFrame([], "call_id string, needed string")
    got = {r["call_id"]: r for r in tool_calls.link_calls(calls, *none, schema).collect()}
    assert {k: r["faults"] for k, r in got.items()} == {k: w for k, (_, w) in cases.items()}
    for k, r in got.items():
        assert json.loads(r["json"])["arguments"] == (cases[k][0] if "$: n" in str(r["faults"]) and "not of" not in str(r["faults"]) else json.loads(cases[k][0]))
    assert tool_calls.link_calls(calls.limit(0), *none, schema).count() == 0


# 9


def test_filter_gives_levels_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    want = language_model.level_of(rng.integers(1, 500, len(keys)))
    bloom = language_model.LogBloom.of(keys, want)
    got = bloom.levels(keys)
    assert (got >= want).all() and (got == want).mean() > 0.97
    assert (bloom.levels(rng.integers(0, 2**63, 20000).astype(np.uint64)) > 0).mean() < 0.02
    least = language_model.least_counts()
    for c in range(1, 3000):
        level = int(language_model.level_of(np.array([c]))[0])
        assert least[level] <= c < least[level + 1] or least[level] == c
    assert language_model.LogBloom.of(keys[:0], want[:0]).levels(keys).max() == 0


def brute_scores(texts, trains):
    """Scores from exact counts, each taken down to the least of its level; the strength that suits the middle text."""
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    grams = [Counter(tuple(tokens[i][k : k + n]) for i in trains for k in range(len(tokens[i]) - n + 1)) for n in (1, 2, 3)]
    n, v = sum(grams[0].values()), len(grams[0])
    n1, n2 = (sum(c == k for c in grams[0].values()) for k in (1, 2))
    d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
    least = lambda c: max((math.ceil(1.5**k - 1e-9) for k in range(60) if 1.5**k <= c + 1e-9), default=0)

    def score(w, s, out):
        total = 0.0
        for k, x in enumerate(w):
            p = max(grams[0][x,] - out - d, 0) / (n - out) + d * v / (n - out) / (v + 1)
            for m in (1, 2):
                if k >= m:
                    h, g = tuple(w[k - m : k]), tuple(w[k - m : k + 1])
                    before = (grams[0][h] if m == 1 else least(grams[1][h])) - out
                    if before > 0:
                        p = (min(max(least(grams[m][g]) - out, 0), before) + s * p) / (before + s)
            total += math.log10(p)
        return total

    votes = sorted(max(range(len(language_model.STRENGTHS)), key=lambda k: score(tokens[i], language_model.STRENGTHS[k], 1)) for i in trains)
    best = language_model.STRENGTHS[votes[(len(votes) - 1) // 2]]
    return {i: score(w, best, 0) for i, w in tokens.items()}


def test_scores_by_definition(spark, docs):
    some = dict(sorted(docs.items())[:120])
    want = brute_scores(some, [i for i in some if i % 3])
    df = spark.createDataFrame(sorted(some.items()), "doc_id long, text string").repartition(3)
    before = language_model.SHARD_KEYS
    try:
        for language_model.SHARD_KEYS in (before, 1000):  # one shard, and many
            got = by_id(language_model.score(df, language_model.train(df), trained=F.col("doc_id") % 3 != 0), "score")
            # The filter takes one in a hundred of absent n-grams for one that occurs once.
            for i, x in want.items():
                assert got[i][0] == pytest.approx(x, rel=0.02, abs=0.5)
    finally:
        language_model.SHARD_KEYS = before


def test_text_is_likelier_than_gibberish(spark, docs):
    rnd = random.Random(3)
    text = next(t for i, t in sorted(docs.items()) if zlib.crc32(str(i).encode()) % 7 != 2 and 200 < len(t.split()) < 2000)
    words = text.split()
    mixed, made_up = rnd.sample(words, len(words)), ["".join(rnd.choice("bcdfgaeiou") for _ in range(7)) for _ in words]
    model = language_model.train(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string"))
    asked = spark.createDataFrame([(1, text), (2, " ".join(mixed)), (3, " ".join(made_up))], "doc_id long, text string")
    got = by_id(language_model.score(asked, model), "score")
    assert got[1][0] > got[2][0] > got[3][0]


def test_ngrams_that_occur_once_count(spark):
    # Pairs and triples that occur once, beside far more tokens.
    filler = " ".join(f"f{i}" for i in range(1000))
    texts = [("lorem " * 20_000,)] * 8 + [(filler,)] * 3 + [("alpha beta gamma",), ("gamma alpha beta gamma",), ("delta epsilon zeta",)]
    model = language_model.train(spark.createDataFrame(texts, "text string").repartition(4))
    asked = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma beta alpha"), (3, "delta epsilon zeta"), (4, "zeta epsilon delta")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score(asked, model).collect()}
    # The same words in an order that is in the texts: each pair and triple has a share of one.
    assert got[1] > got[2] + 2 and got[3] > got[4] + 2


def test_one_pass_for_both_scores_alike(spark, docs):
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(3)
    out = language_model.held_out(F.col("doc_id"))
    model = language_model.train(df.where(~out))
    apart, both = ({r["doc_id"]: r["score"] for r in language_model.score(df, model, **more).collect()} for more in ({}, {"trained": ~out}))
    assert both == pytest.approx(apart, rel=0.01)


def test_base_scores_by_definition(spark, docs):
    counts = Counter()
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in docs.items()}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    better = []
    for r in llm_queries.op9_log_bloom(spark, SF).collect():
        w = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, len(w), sum(x in counts for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] <= 0
        better += [r["score"] > r["base_score"]] if r["held_out"] else []
    assert np.mean(better) > 0.8


# 10


def test_repeats_like_brute_force():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 50))).encode() for _ in range(40)] + [b"", b"x", b"x y " * 20]
    for least in (1, 2, 10):
        got = quality.measure(texts, quality.QualityRules(repeat_words=least))
        for k, t in enumerate(texts):
            w = t.split()
            reach = []
            for i in range(len(w)):
                best = 0
                for j in range(len(w)):
                    n = 0
                    while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                        n += 1
                    best = max(best, n)
                reach.append(best if best >= least else 0)
            triples = Counter(zip(w, w[1:], w[2:], strict=False))
            again = {p for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
            covered = {p for i, n in enumerate(reach) for p in range(i, i + n)}
            assert (got["n_words"][k], got["covered_words"][k], got["longest_repeat"][k], got["n_repeat_words"][k]) == (len(w), len(covered), max(reach, default=0), len(again))
            assert {p for s in got["repeats"][k] for p in range(s["start"], s["stop"])} == covered


def test_base_counts_by_definition(spark, odd, docs):
    import re

    rows = [(i, t) for i, t, *_ in ODD] + sorted(docs.items()) + [(900, "a # b\n\na # b\n \x1ca\n\x0b\na # b"), (901, "x | y < z > $ % & * #"), (902, "one two three one two three"), (903, "\u8a9e \U0001f600\u00e9")]
    got = Counter()
    for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])] += 1
        assert not (r["base_failed"] and r["kept"])
    want = Counter()
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {p for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))] += 1
    assert got == want


# all


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "lorem " * 12), (2, None), (3, "")], "item_id long, text string").withColumn("term", F.lit(1))
    model = language_model.train(odd)
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in language_model.score(odd, language_model.train(odd.limit(0))).collect()} == {(0, 0, 0.0)}
    tox = toxicity.train(odd.withColumn("toxic", F.when(F.col("doc_id") > 4, 1).otherwise(0)))
    for make in (
        quality.quality_rules,
        simhash.simhash_components,
        chunks.dedup_substrings,
        licenses.license_scan,
        lambda df: contamination.contamination(df, items),
        lambda df: language_model.score(df, model),
        lambda df: toxicity.toxicity(df, tox),
        lambda df: bpe.encode(df, PATH, PATTERN),
    ):
        rows = make(odd).collect()
        assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows) == sorted(x[0] if x[0] is not None else -1 for x in ODD)
        assert make(odd.limit(0)).count() == 0
    assert contamination.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    hits = [r for r in contamination.contamination(odd, items).collect() if r["n_hit"]]
    assert [(r["doc_id"], r["n_hit"]) for r in hits] == [(7, 120_000)]


def test_pipeline_stages_keep_their_columns(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == pipeline.COLUMNS
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    out = pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == kept[-1] and out.where("not round_trip").count() == 0
    # Brute force over the first two stages.
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {i: first[i] for i in sorted(first) if quality.measure([first[i].encode()], quality.QualityRules())["kept"][0]}
    assert kept[2] == len(brute_near(good, 5, 6, 0.8))


def brute_near(found, words, radius, similarity):
    """Ids that stay: of equal texts the first; of what fingerprints connect, in turn, those that none that stays resembles."""
    firsts = {}
    for i, t in sorted(found.items()):
        firsts.setdefault(t, i)
    ids = sorted(firsts.values())
    prints, sets = {i: simhash.fingerprint(found[i].encode(), words) for i in ids}, {}
    for i in ids:
        w = found[i].encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
    root, changed = {i: i for i in ids}, True
    while changed:
        changed = False
        for i in ids:
            least = min(root[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= radius)
            changed |= least != root[i]
            root[i] = least
    stay = []
    for i in ids:
        if not any(root[j] == root[i] and sets[i] & sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) for j in stay):
            stay.append(i)
    return stay


def test_near_duplicates_like_brute_force(spark):
    rnd = random.Random(12)
    texts = {}
    for g in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([4, 40, 150]))]
        for _ in range(8):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 50)}"
            texts[len(texts)] = " ".join(t)
    texts |= {len(texts): " \n", len(texts) + 1: "\n", len(texts) + 2: "a b", len(texts) + 3: "A  B"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    before = simhash.FIRST, simhash.PART
    try:
        for radius, simhash.FIRST, simhash.PART in ((6, *before), (20, *before), (20, 3, 7)):
            gone = {r["doc_id"] for r in simhash.near_duplicates(df, radius=radius, together=4 if radius < 10 else 2).collect()}
            assert sorted(set(texts) - gone) == sorted(brute_near(texts, 5, radius, 0.8)) and len(gone) > 20
    finally:
        simhash.FIRST, simhash.PART = before


def test_pipeline_judges_rows_that_share_an_id(spark, tmp_path):
    import corpus_pipeline as pipeline

    leak = " ".join(f"leak{i}" for i in range(12))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = lambda k: " ".join(f"c{k}x{i * i % 97}y{i}" for i in range(60))
    rows = [(1, clean(1)), (1, clean(1)), (1, clean(2)), (2, clean(1)), (3, clean(3) + " " + leak), (3, clean(4)), (None, clean(5) + " " + leak), (None, clean(6)), (None, clean(6)), (4, clean(6)), (5, None), (6, ""), (7, "\u8a9e" * 2000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    text = lambda d: sorted((r["doc_id"] or -1, r["text"] or "") for r in d.collect())
    near = pipeline.near_duplicates(spark, df, str(tmp_path))
    assert near.columns == pipeline.COLUMNS
    assert text(near) == sorted([(1, clean(1)), (1, clean(2)), (3, clean(3) + " " + leak), (3, clean(4)), (-1, clean(5) + " " + leak), (4, clean(6)), (5, ""), (7, "\u8a9e" * 2000)])
    assert text(pipeline.benchmark_leaks(spark, df, str(tmp_path))) == sorted((i or -1, t or "") for i, t in rows if leak not in (t or ""))
    wide = df.withColumns({c: F.lit("clash") for c in CLASHING})
    for _, stage in pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        assert out.count() > 0 and stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_digests_of_whole_texts(spark, docs):
    enc = tik()
    for r in llm_queries.op8_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
