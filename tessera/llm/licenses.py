"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only. A window of a text and a window of a template of the same size collide in a band where their
least shingle under the band's hash is the same; with a Jaccard similarity s of the two, some of BANDS bands of one row
collides with probability 1 - (1 - s)^BANDS: certainty for a verbatim copy, over 0.9998 at s = 2/3, which is what a
containment of 0.8 in equal windows means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

#: Wording of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    # whole notices
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    # tags of five words or more
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
#: What stands between words (runs of letters and digits); splitting there is twice as fast as matching the words.
BREAK_RE = r"[^\p{L}\p{N}]+"
SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 8
_REGION = 64
#: Of one family's templates found within so many words of each other, only those with the greatest containment count.
_APART = 16


def family(license_: Column) -> Column:
    """Licenses whose notices differ in little: the GNU ones, the Creative Commons ones; any other is its own."""
    return F.when(license_.contains("GPL"), "GNU").when(license_.startswith("CC"), "CC").otherwise(license_)


def _shifted(h: Column, a: Column, by: int, n: Column) -> Column:
    """Hashes of a[i] with h[i + by], n of them."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(h, F.lit(1 + by), n), lambda x, y: F.xxhash64(x, y))


def shingled(rows: DataFrame) -> DataFrame:
    """rows (text, others) -> the others and sh: hashes of all five-word shingles, in order (fewer words: none)."""
    kept = [c for c in rows.columns if c not in ("text", "sh")]
    words = rows.select(*kept, F.transform(F.array_remove(F.split(F.lower(text_of()), BREAK_RE), ""), lambda w: F.xxhash64(w)).alias("__h"))
    n = F.size("__h")
    two = words.withColumn("__p", _shifted(F.col("__h"), F.col("__h"), 1, n - 1))
    four = two.withColumn("__p", _shifted(F.col("__p"), F.col("__p"), 2, n - 3))
    return four.select(*kept, _shifted(F.col("__h"), F.col("__p"), 4, n - 4).alias("sh"))


def _band(x: Column, band: int) -> Column:
    return F.xxhash64(x, F.lit(band))


def _halves(a: Column, width: int) -> Column:
    """The lesser of a[i] and a[i + width]."""
    n = F.greatest(F.size(a) - width, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + width), n), lambda x, y: F.least(x, y))


def _largest(n: int) -> int:
    """The size of windows that stand for a template of n shingles."""
    return 1 << (n.bit_length() - 1)


def _templates(spark: SparkSession, templates: tuple) -> tuple[list[tuple], list[int]]:
    """(size, band, least, template, license, shingles) of all windows of all templates, and the shingles that are least.

    The templates are few and given; their hashes come from the same expressions as the texts'.
    """
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    hashed = shingled(rows).select("template", "license", "sh", F.transform("sh", lambda x: F.array(*(_band(x, b) for b in range(BANDS)))).alias("bands"))
    keys, least = set(), set()
    for r in hashed.collect():
        distinct, size = sorted(set(r["sh"])), _largest(max(len(r["sh"]), 1))
        for start in range(len(r["sh"]) - size + 1):
            for band in range(BANDS):
                value, shingle = min((r["bands"][k][band], r["sh"][k]) for k in range(start, start + size))
                keys.add((size, band, value, r["template"], r["license"], tuple(distinct)))
                least.add(shingle)
    return sorted(keys), sorted(least)


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, license, containment, word: a row for each license that a document states.

    containment: the greatest share of a template's distinct shingles near a colliding window (at least CONTAINMENT);
    word: the first such window's place. Where templates of one family (see family) are found side by side, the best
    stays; licenses of other families never give way. Windows of every size that a template asks for start at every word.
    Only regions that hold a shingle which is some template window's least are looked at: no other window can collide.
    Null, empty and short texts state none. Each row of docs is a document of its own, also where it shares its doc_id
    (or a null one) with others. Other columns are ignored. Only findings are shuffled.
    """
    spark = docs.sparkSession
    keys, least = _templates(spark, templates)
    sizes = sorted({k[0] for k in keys})
    longest = max((len(k[5]) for k in keys), default=1)
    reach = -(-5 * longest // 4) + _REGION
    marks = F.split(F.lit(",".join(map(str, least))), ",").cast("array<bigint>") if least else F.expr("cast(array() as array<bigint>)")
    # the row's number keeps the windows of rows apart; and, not being deterministic, keeps the optimizer from moving the
    # filter below the steps of shingled, where it would work them out again, several times over
    numbered = shingled(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    hit = numbered.where(F.arrays_overlap("sh", marks))
    regions = F.array_distinct(F.filter(F.transform("sh", lambda x, i: F.when(F.array_contains(marks, x), F.floor(i / _REGION).cast("int"))), lambda r: r.isNotNull()))
    region = hit.withColumn("region", F.explode(regions))
    begin = F.greatest(F.col("region") * _REGION - reach, F.lit(0))
    near = region.select("doc_id", "row", begin.alias("begin"), F.slice("sh", begin + 1, F.lit(_REGION + 2 * reach)).alias("sh"))

    # m<size>: for each band, the least hash of the window of that size at each place, from windows of half the size
    bands = F.transform(F.array(*map(F.lit, range(BANDS))), lambda b: F.transform("sh", lambda x: F.xxhash64(x, b)))
    met, width = near.withColumn("m1", bands), 1
    while width < sizes[-1] if sizes else False:
        met, width = met.withColumn(f"m{2 * width}", F.transform(f"m{width}", lambda a: _halves(a, width))), 2 * width

    def colliding(size: int) -> Column:
        values = sorted({k[2] for k in keys if k[0] == size})
        listed = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
        at = F.transform(f"m{size}", lambda a, b: F.filter(F.transform(a, lambda v, i: F.struct(F.lit(size).alias("size"), b.alias("band"), v.alias("least"), i.alias("at"))), lambda w: F.array_contains(listed, w["least"])))
        return F.flatten(at)

    windows = F.concat(*map(colliding, sizes)) if sizes else F.expr("cast(array() as array<struct<size: int, band: int, least: bigint, at: int>>)")
    met = met.select("doc_id", "row", "begin", "sh", F.explode(windows).alias("w")).select("doc_id", "row", "begin", "sh", "w.*")
    known = spark.createDataFrame(keys, "size int, band int, least bigint, template int, license string, shingles array<bigint>")
    found = met.join(F.broadcast(known), ["size", "band", "least"]).groupBy("row", "doc_id", "begin", "at", "template", "license").agg(F.first("sh").alias("sh"), F.first("shingles").alias("shingles"))
    length = F.size("shingles")
    slack = F.ceil(length * 1.25).cast("int")
    first = F.greatest(F.col("at") - slack, F.lit(0))
    share = F.size(F.array_intersect("shingles", F.slice("sh", first + 1, 2 * slack + length))) / length
    true = found.select("row", "doc_id", "license", (F.col("begin") + F.col("at")).cast("long").alias("word"), share.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    around = Window.partitionBy("row", family(F.col("license"))).orderBy("word").rangeBetween(-_APART, _APART)
    true = true.withColumn("__best", F.max("containment").over(around)).where(F.col("containment") == F.col("__best"))
    return true.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.min("word").alias("word")).drop("row")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license that a document states."""
    return scan(table(spark, sf_dir, "documents"))
