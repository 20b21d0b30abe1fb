"""License scans with DataFrame functions only.

A text becomes the hashes of its consecutive word triples. MinHash bands of one row
over overlapping windows of SPAN triples, one starting every STEP, retrieve templates.
A template is indexed by at most BLOCKS blocks of SPAN - STEP + 1 triples, evenly
spread, so that every copy of a block lies whole in some window: even a template of
two triples has similarity 2 / 8 with that window, which BANDS bands miss with
probability 1e-6, and a whole block has 5 / 8. A copy of a long template is missed only
if all its blocks are changed and the rest of each goes unseen as well.

Retrieved templates are verified exactly, on whole texts: the share of a template's
distinct triples that stand within its length around the stretch (of its length) that
the window lies in, and all triples that tell it from a template of another license
that holds LEAST of it. Of verified templates in one place (at least half of the places
of the triples of one are the other's too) the one with most triples there stands, at
equal numbers the best contained.

A window can agree with a block in a minimum only if it holds one of its triples, so
windows (and texts) without any triple of a block leave before the minima are taken.
They are told by a bitmap of hashed triples; what passes it by chance is only work.

Defined results: null and empty texts, and texts under three words, match nothing; a
template found in several windows counts once, with its best containment; a repeated
doc_id gets the matches of all its rows in each; an empty table, or no templates, gives
no match; extra columns are not read. Very long texts are single rows throughout.

Scale: two maps over the documents with few rows between them: triples of texts that
pass the bitmap are written once, retrieved (text, template, stretch) rows are joined
to them. The templates may be any number: their list is on the driver as the caller
gives it, the bitmap has at most MAX_BITS bits, and bands and triples of templates are
broadcast only where their size, computed first, is at most BROADCAST_BYTES; beyond it
they are joined by a shuffle. No Python runs on the executors.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import cut

SPAN, STEP, BANDS, BLOCKS = 8, 4, 48, 16
LEAST = 0.8
MIN_BITS, MAX_BITS = 1 << 16, 1 << 24
BROADCAST_BYTES = 64 << 20

# fixed values: notices that the licenses ask for, short lines as projects write them
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES += [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
_GNU = [("GPL", "General Public License", ("1", "2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("LGPL", "Library General Public License", ("2",)), ("AGPL", "Affero General Public License", ("3",))]
for _short, _long, _versions in _GNU:
    for _v in _versions:
        _id = f"{_short}-{_v if '.' in _v else _v + '.0'}"
        for _what in ("program", "library", "software"):
            for _either, _or in (("either version", ", or (at your option) any later version."), ("version", "."), ("version", " only.")):
                _text = f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_long} as published by the Free Software Foundation, {_either} {_v} of the License{_or}"
                if (_id, _text) not in TEMPLATES:
                    TEMPLATES.append((_id, _text))
        TEMPLATES += [(_id, x) for x in dict.fromkeys((f"This work is licensed under the GNU {_long}, version {_v}.", f"GNU {_long} version {_v}", f"GNU {_long} v{_v}", f"GNU {_long} {_id[len(_short) + 1 :]}", f"GNU {_long} v{_id[len(_short) + 1 :]}", f"GNU {_long} version {_id[len(_short) + 1 :]}", f"SPDX-License-Identifier: {_id}")) if (_id, x) not in TEMPLATES]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in _CC.items():
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _kind = {"4.0": "International", "3.0": "Unported"}.get(_v, "Generic")
        TEMPLATES += [(f"CC-{_short}-{_v}", x) for x in (f"This work is licensed under a Creative Commons {_long} {_v} {_kind} License.", f"Creative Commons {_long} {_v}", f"CC {_short} {_v}") if (f"CC-{_short}-{_v}", x) not in TEMPLATES]
for _id, _name in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("BSD-2-Clause", "2-Clause BSD"), ("BSD-3-Clause", "3-Clause BSD")):
    TEMPLATES += [(_id, f"under the {_name} License"), (_id, f"The {_name} License")][: 1 if " " not in _name else 2]
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0")]
for _id, _name in (("Apache-2.0", "Apache License"), ("MPL-2.0", "Mozilla Public License"), ("EPL-1.0", "Eclipse Public License"), ("EPL-2.0", "Eclipse Public License")):
    _v = _id.split("-")[1]
    TEMPLATES += [(_id, f"{_name} {_v}"), (_id, f"{_name} v{_v}"), (_id, f"{_name} v. {_v}"), (_id, f"{_name} version {_v}")]


def _hashes(df: DataFrame, text: str) -> DataFrame:
    """Adds sh: hashes of consecutive word triples, lower-cased, letters and digits only.

    Each array passes through a one-row generator, which keeps the optimizer from
    computing it again for every element that a later function takes from it.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    df = df.select("*", F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("w"))
    at = lambda i: F.element_at("w", i)
    triples = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    own = F.when(F.size("w") >= 3, triples).otherwise(F.array().cast("array<long>"))
    return df.select("*", F.explode(F.array(own)).alias("sh")).drop("w")


def _minima(window: str) -> Column:
    """The smallest hash of a window's triples, under each band's own hash function."""

    def band(k: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[band(k) for k in range(BANDS)])


def blocks_of(n: int) -> list[int]:
    """Where (from 1) the indexed blocks of a template of n triples start."""
    size = SPAN - STEP + 1
    every = list(range(1, n + 1, size))
    return every if len(every) <= BLOCKS else [every[i * (len(every) - 1) // (BLOCKS - 1)] for i in range(BLOCKS)]


def telling(held: list[tuple[int, str, frozenset]], least: float) -> dict[int, list[int]]:
    """For each template, its triples that some near template of another license lacks."""
    need = {}
    for i, name, own in held:
        near = [x for _, other, x in held if other != name and len(x) >= least * len(own) and len(own & x) >= least * len(own)]
        need[i] = sorted(frozenset().union(*(own - x for x in near)))
    return need


def bitmap(triples: np.ndarray) -> tuple[Column, int]:
    """(array of longs, number of bits) that holds every triple's last bits."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (4096 * max(1, len(triples)) - 1).bit_length()))
    on = np.zeros(bits, np.uint8)
    on[triples & (bits - 1)] = 1
    words = np.packbits(on, bitorder="little").view("<i8")
    return F.from_json(F.lit(json.dumps(words.tolist())), "array<bigint>"), bits


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, least: float = LEAST) -> DataFrame:
    """(doc_id, template number, license, containment) of every verified template."""
    spark = docs.sparkSession
    t = _hashes(spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(templates)], "template int, license string, text string"), "text")
    rows = [(r["template"], r["license"], r["sh"]) for r in t.select("template", "license", "sh").filter("size(sh) > 0").collect()]
    need = telling([(i, n, frozenset(sh)) for i, n, sh in rows], least)
    size = SPAN - STEP + 1
    cells = [(i, sh[s - 1 : s - 1 + size]) for i, _, sh in rows for s in blocks_of(len(sh))]
    held, n_bits = bitmap(np.array(sorted({x for _, b in cells for x in b}), np.int64))
    fewest = min((int(np.ceil(least * len(set(sh)) - 1e-9)) for _, _, sh in rows), default=1)

    def shared(df: DataFrame, size: int) -> DataFrame:
        return F.broadcast(df) if size <= BROADCAST_BYTES else df

    lists = spark.createDataFrame([(i, n, list(set(sh)), need[i], len(sh)) for i, n, sh in rows], "template int, license string, own array<long>, need array<long>, len int")
    lists = shared(lists, sum(8 * (2 * len(sh) + 8) for _, _, sh in rows))
    bands = spark.createDataFrame([(i, b, len(sh)) for (i, b), sh in zip(cells, [sh for _, _, sh in rows for _ in blocks_of(len(sh))], strict=True)], "template int, b array<long>, len int")
    bands = shared(bands.select("template", "len", F.posexplode(_minima("b")).alias("band", "min")).distinct(), 48 * BANDS * len(cells))

    def one(x: Column) -> Column:
        at = x.bitwiseAND(F.lit(n_bits - 1))
        return F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    # the triples of texts that can hold a template at all
    d = _hashes(docs.select("doc_id", "text"), "text").select("doc_id", F.xxhash64("sh").alias("row"), "sh").filter(F.exists("sh", one))
    d = cut(d.filter(F.size("sh") >= fewest), "license-triples")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("sh") - F.lit(SPAN - STEP)), F.lit(STEP))
    windows = d.select("doc_id", "row", "sh", F.explode(starts).alias("s")).select("doc_id", "row", "s", F.explode(F.array(F.slice("sh", F.col("s"), F.lit(SPAN)))).alias("win"))
    found = windows.filter(F.exists("win", one)).select("doc_id", "row", "s", F.posexplode(_minima("win")).alias("band", "min")).join(bands, ["band", "min"])
    found = found.select("doc_id", "row", "template", F.floor((F.col("s") - 1) / F.col("len")).alias("stretch")).distinct().withColumnsRenamed({"doc_id": "of", "row": "of_row"})
    hits = d.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))).join(lists, "template")
    # from one template length before the stretch to one after it
    start = F.greatest(F.lit(1), (F.col("stretch") - 1) * F.col("len") + 1).cast("int")
    hits = hits.select("doc_id", "row", "template", "license", "own", "need", start.alias("at"), F.slice("sh", start, 3 * F.col("len") + SPAN).alias("region"))
    hits = hits.withColumn("containment", F.size(F.array_intersect("own", "region")) / F.size("own"))
    hits = hits.filter((F.col("containment") >= least) & (F.size(F.array_except("need", "region")) == 0))
    places = F.filter(F.transform("region", lambda x, k: F.when(F.array_contains("own", x), F.col("at") + k)), lambda p: p.isNotNull())
    hits = hits.select("doc_id", "row", "template", "license", "containment", places.alias("p")).distinct()
    # in one place the largest stands
    hit = F.struct((-F.size("p")).alias("less"), (-F.col("containment")).alias("worse"), "template", "license", F.array_min("p").alias("lo"), F.array_max("p").alias("hi"), "p")
    best = hits.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    kind = best.schema["hits"].dataType

    def covered(kept: Column, h: Column) -> Column:
        return F.exists(kept, lambda k: (k["lo"] <= h["hi"]) & (k["hi"] >= h["lo"]) & (2 * F.size(F.array_intersect(k["p"], h["p"])) >= F.size(h["p"])))

    stand = F.aggregate("hits", F.array().cast(kind), lambda kept, h: F.when(covered(kept, h), kept).otherwise(F.concat(kept, F.array(h))))
    best = best.select("doc_id", F.explode(stand).alias("h"))
    return best.groupBy("doc_id", F.col("h.template").alias("template"), F.col("h.license").alias("license")).agg(F.max(-F.col("h.worse")).alias("containment"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its licenses, sorted, and how well the best template is contained."""
    found = scan(docs).groupBy(F.col("doc_id").alias("of")).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.count("*").alias("n_templates"), F.round(F.max("containment"), 6).alias("containment"))
    every = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return every.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_templates", F.lit(0)).alias("n_templates"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
