"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Shingles are 5 tokens (lower-case runs of letters and digits). Templates fall into classes by their number of shingles,
each class 1.5 times the last. For a class of size L windows of L + s - 1 shingles begin every s = ceil(L / 2), so one of
them holds any run of L shingles whole. A window with 0.8 of a template's shingles then has a Jaccard similarity of 0.8 *
(L / 1.5) / (1.5 L + 0.2 L / 1.5) = 0.33 or more with it, and with BANDS = 32 bands of one row the chance to miss it is
0.67 ** 32, three in a million.

A window without any shingle of any template can share no minimum with a template, so such windows (and documents) are
passed over before minima are taken; this changes no result. Which shingles templates have is told by a Bloom filter, PROBES
bits set of 16 to 32 for each, 128 K at least (1 MB for 300,000 shingles), so the plan does not grow with the templates; a wrong yes costs time only.

Templates are a parameter: texts by license, or a table. MAX_SHINGLES bounds them, hence the bitmap and the bands' keys;
their texts are broadcast up to MAX_BROADCAST bytes and joined otherwise. Nothing else is shuffled but the candidates.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pinned, table, text_of, upto, written
from .decontaminate import tokens_of

SHINGLE, BANDS, CONTAINMENT = 5, 32, 0.8
#: Of all templates; bytes of their shingles up to which they are broadcast.
MAX_SHINGLES, MAX_BROADCAST = 2_000_000, 64 << 20
PROBES = 3

# Notices by which the licenses are known, and the short licenses whole.
_SOFTWARE = "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, {}."
_WITHOUT = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _FREE.format("GNU Affero General Public License", "either version 3 of the License, or (at your option) any later version"), "This program " + _WITHOUT.format("GNU Affero General Public License"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "Artistic-2.0": ["The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "BSD": [_BSD, " ".join([_BSD_1, _BSD_2]), _BSD_3, _BSD_END, " ".join([_BSD + ":", _BSD_1, _BSD_2, _BSD_END]), " ".join([_BSD + ":", _BSD_1, _BSD_2, _BSD_3, _BSD_END])],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _FREE.format("GNU General Public License", "either version 2 of the License, or (at your option) any later version"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _FREE.format("GNU General Public License", "either version 3 of the License, or (at your option) any later version"), "This program " + _WITHOUT.format("GNU General Public License"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _FREE.format("GNU Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _FREE.format("GNU Lesser General Public License", "either version 3 of the License, or (at your option) any later version"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), " + _SOFTWARE,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "PSF-2.0": ["PSF LICENSE AGREEMENT FOR PYTHON", "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}


def classes(largest: int) -> list[int]:
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def _hashes(tokens: Column) -> Column:
    return F.transform(upto(F.size(tokens) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]))


def _shingles(tokens: Column) -> Column:
    return F.array_distinct(F.transform(upto(F.size(tokens) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(tokens, i + 1, SHINGLE), " ")))


def _minhash(hashes: Column, band: Column) -> Column:
    """The band's order of all hashes, the same for any window."""
    return F.transform(hashes, lambda h: F.xxhash64(band, h))


def _templates(spark: SparkSession, templates: dict[str, list[str]] | DataFrame) -> tuple[DataFrame, list[int], int]:
    """license, template, hashes, shingles of each; the classes that they fall into; how many shingles there are."""
    if isinstance(templates, DataFrame):
        made = pinned(templates, {"license": "string", "text": "string"}).select("license", text_of().alias("t"))
    else:
        listed = json.dumps([{"license": name, "t": text} for name, texts in sorted(templates.items()) for text in texts])
        made = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<license:string,t:string>>")))
    made = made.select("license", F.xxhash64("license", "t").alias("template"), tokens_of(F.col("t")).alias("tokens")).filter(F.size("tokens") >= SHINGLE).dropDuplicates(["license", "template"])
    made = written(made.select("license", "template", _hashes(F.col("tokens")).alias("hashes"), _shingles(F.col("tokens")).alias("shingles")), "license-templates")
    total = made.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    if total > MAX_SHINGLES:
        raise ValueError(f"the templates have more than {MAX_SHINGLES} shingles")
    sizes = [r[0] for r in made.select(F.size("hashes").alias("n")).distinct().collect()]
    every = classes(max(sizes, default=1))
    return made, sorted({min(c for c in every if c >= n) for n in sizes}), total


def _probes(h: Column, bits: int) -> list[Column]:
    """The bits of the filter that stand for a hash: parts of it that begin 13 bits apart."""
    return [F.shiftrightunsigned(F.shiftleft(h, 13 * j) if j else h, 64 - bits) for j in range(PROBES)]


def _filter(known: DataFrame, shingles: int) -> tuple[Column, int]:
    """The Bloom filter of all shingles' hashes as a constant array of 64-bit words, and the log2 of its bits."""
    bits = max(17, (16 * shingles).bit_length())
    at = known.select(F.explode("hashes").alias("h")).select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("at")).distinct()
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("set")).collect()
    array = [0] * (1 << bits - 6)  # bounded by MAX_SHINGLES
    for r in words:
        array[r["word"]] = r["set"]
    return F.split(F.lit(",".join(map(str, array))), ",").cast("array<bigint>"), bits  # folded into one literal


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment (the best), first_token (where the first such window begins) of each license that a document holds.

    templates: texts by license, or a table (license, text). Null texts are empty. Rows with the same doc_id are reported
    together, those without as one. Templates of fewer than five tokens say too little and are left out; repeated ones count
    once. An empty table, or no template, gives an empty result. Other columns are ignored.
    """
    known, sizes, total = _templates(docs.sparkSession, TEMPLATES if templates is None else templates)
    words, bits = _filter(known, total)
    docs = pinned(docs, {"doc_id": "bigint", "text": "string"}).select("doc_id", tokens_of(text_of()).alias("tokens"))
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    keys = lambda orders, start, width, size: F.transform(orders, lambda o, b: F.xxhash64(size, b, F.array_min(F.slice(o, start + 1, width))))

    def hits(hashes: Column) -> Column:
        """Where the filter knows a shingle."""
        def known_to_filter(h: Column) -> Column:
            each = [F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for at in _probes(h, bits)]
            return functools.reduce(Column.__and__, each)

        return F.filter(F.transform(hashes, lambda h, i: F.when(known_to_filter(h), i)), lambda i: i.isNotNull())

    def starts(at: Column, size: int) -> Column:
        step = -(-size // 2)
        width = size + step - 1
        # The windows that hold a place begin at the multiples of the step up to it.
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - (width - 1)) / step)).cast("int")
        holding = F.array_distinct(F.flatten(F.transform(at, lambda p: F.transform(F.sequence(first(p), F.floor(p / step).cast("int")), lambda i: i * step))))
        return F.transform(holding, lambda a: F.struct(F.lit(size).alias("size"), a.alias("start"), F.lit(width).alias("width")))

    def windows(tokens: Column, hashes: Column, at: Column) -> Column:
        one = lambda orders, w: F.struct(w["start"].alias("start"), F.slice(tokens, w["start"] + 1, w["width"] + (SHINGLE - 1)).alias("tokens"), keys(orders, w["start"], w["width"], w["size"]).alias("keys"))
        orders = F.transform(bands, lambda b: _minhash(hashes, b))
        # One expression, each part of it worked out once, and only for documents with a template's shingle.
        return F.when(F.size(at) > 0, let(orders, lambda o: F.transform(F.flatten(F.array(*[starts(at, x) for x in sizes])), lambda w: one(o, w))))

    if not sizes:
        return docs.filter("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_token"))
    seen = docs.select("doc_id", F.explode_outer(let(F.col("tokens"), lambda t: let(_hashes(t), lambda h: let(hits(h), lambda at: windows(t, h, at))))).alias("w"))
    seen = seen.select("doc_id", "w.start", "w.tokens", F.explode_outer("w.keys").alias("key"))
    n = F.size("hashes")
    size = F.array_min(F.filter(F.array(*map(F.lit, sizes)), lambda x: x >= n))
    asked = known.select("template", size.alias("size"), F.transform(bands, lambda b: _minhash(F.col("hashes"), b)).alias("orders"), n.alias("n"))
    asked = asked.select("template", F.explode_outer(keys(F.col("orders"), F.lit(0), F.col("n"), F.col("size"))).alias("key"))
    met = seen.join(F.broadcast(asked), "key").select("doc_id", "template", "start", "tokens").distinct()  # BANDS keys a template
    large = known.agg(F.coalesce(F.sum(F.aggregate("shingles", F.lit(0), lambda a, x: a + F.octet_length(x) + 24)), F.lit(0))).first()[0]
    told = known.select("license", "template", "shingles")
    met = met.join(F.broadcast(told) if large <= MAX_BROADCAST else told, "template")
    share = let(_shingles(F.col("tokens")), lambda own: F.size(F.array_intersect(own, "shingles"))) / F.size("shingles")
    scored = met.select("doc_id", "license", "start", share.alias("share"))
    best = scored.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min(F.when(F.col("share") >= containment, F.col("start"))).alias("first_token"))
    return best.filter(F.col("containment") >= containment)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


#: Windows by the places of the shingles that they share with a template; the list of templates is the fixed one above.
OP8_SQL = """
with given(license, t) as (values {values}),
     cut as (select license, row_number() over () as k, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from given),
     shingled as (select license, k, w, len(w) - 4 as n from cut where len(w) >= 5),
     sizes as (select 1 as size union select unnest([{sizes}])),
     templates as (select license, k, n, w, (select min(size) from sizes where size >= n) as size from shingled),
     own as (select distinct license, k, size, array_to_string(w[i:i + 4], ' ') as s from (select *, unnest(range(1, n + 1)) as i from templates)),
     total as (select k, count(*) as m from own group by k),
     d as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from documents),
     ds as (select doc_id, r, i - 1 as p, array_to_string(w[i:i + 4], ' ') as s from (select *, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
     met as (select doc_id, r, p, s, license, k, size, (size + 1) // 2 as step from ds join own using (s)),
     placed as (select *, unnest(range(greatest(0, cast(ceil((p - (size + step - 2)) / step) as bigint)), p // step + 1)) * step as start from met),
     shares as (select doc_id, r, license, k, start, count(distinct s) / any_value(m) as share from placed join total using (k) group by doc_id, r, license, k, start)
select doc_id, license, max(share) as containment, min(start) filter (where share >= 0.8)::int as first_token from shares group by doc_id, license having max(share) >= 0.8
""".format(values=", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, texts in TEMPLATES.items() for t in texts), sizes=", ".join(map(str, classes(1_000))))
