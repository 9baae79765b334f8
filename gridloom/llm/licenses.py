"""Licence scans: Dice coefficient of word bigrams against licence templates.

Built-in DataFrame functions only. A text is normalised once and becomes an
array of bigram hashes. Bigrams of two function words are common to all
English; of a template's others a text must have so many that a coefficient of
the threshold is possible at all, which rules out nearly all pairs of text and
template. For each pair left, the places of the template's bigrams are walked
once: a window grows while what its bigrams bring outweighs the gaps between
them, and ends at its best place once it has lost half a template. Size bounds
and the coefficient of the window's distinct bigrams decide; of windows that
overlap, the one that is most above the threshold stands.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contamination import lowered

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# English function words; a bigram of two of them says nothing of a licence.
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be been but by can do for from had has have if in into is it its may no not of on or our shall so such than that the their them then there these they this those to under was we were what when which who will with you your".split()
)

# Short public licence texts and notices, as licences word them; whole texts are in the folder license_texts.
TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
 associated documentation files (the "Software"), to deal in the Software without restriction, including without
 limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
 Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
 above copyright notice and this permission notice shall be included in all copies or substantial portions of the
 Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
 LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
 THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
 CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
 THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
 hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
 SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
 IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
 INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
 AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
 PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
 compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
 an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
 specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the
 GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
 option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
 without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
 License for more details. You should have received a copy of the GNU General Public License along with this program.
 If not, see https://www.gnu.org/licenses/.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
 MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
 provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
 notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
 above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
 materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
 AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
 FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
 ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
 PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
 AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
 ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
 provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
 notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
 above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
 materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
 contributors may be used to endorse or promote products derived from this software without specific prior written
 permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
 WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
 PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
 INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
 GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
 LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
 OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
 modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
 for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
 held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
 for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
 following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
 the original software. If you use this software in a product, an acknowledgment in the product documentation would be
 appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
 misrepresented as being the original software. 3. This notice may not be removed or altered from any source
 distribution.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the
 GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
 option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
 without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
 License for more details.""",
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "This project is licensed under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice, long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


def whole_texts() -> dict[str, str]:
    """The licence texts of the package's folder by name."""
    return {f"{p.stem} text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def normalised(text: Column) -> Column:
    """A-Z in lower case, one space for each run of other characters than letters and digits."""
    return F.trim(F.regexp_replace(lowered(text), r"[^\p{L}\p{N}]+", " "))


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a span whose coefficient with n bigrams can reach the threshold."""
    return math.ceil(threshold * n / (2 - threshold) - 1e-9), math.floor((2 - threshold) * n / threshold + 1e-9)


def _hashed(bigram: str) -> int:
    """``xxhash64`` of the two words, as Spark has it."""
    a, b = bigram.split()
    h = xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42))
    return h - (1 << 64) if h >> 63 else h


def _telling(bigram: str) -> bool:
    return not set(bigram.split()) <= FUNCTION_WORDS


def _one_of(hashes: list[int]) -> str:
    return f"h in ({', '.join(f'{h}L' for h in hashes)})"


def _once(value: Column) -> Column:
    """``value``, computed once for a row however often it is used: expressions that seem to depend on the task stay in their own projection."""
    return F.when(F.spark_partition_id() >= 0, value)


def _windows(places: Column, n: int, unit: int) -> Column:
    """Windows (a, b) of places: each bigram of the template gains 2000 - ``unit``, each other one costs ``unit``.

    A window starts anew where its sum is used up, and ends at its best place
    where the sum has fallen by ``unit`` for half of the ``n`` bigrams.
    """
    ends = "array<struct<a:int,b:int>>"
    state = F.struct(F.array().cast(ends).alias("done"), F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("peak"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("last"))

    def closed(s: Column) -> Column:
        return F.when(s["a"] >= 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        left = s["sum"] - (p - s["last"] - 1) * unit
        total = left + (2000 - unit)
        fresh = (s["a"] < 0) | (left <= 0) | ((s["peak"] - left) * 2 > unit * n)
        new = F.struct(closed(s).alias("done"), p.alias("a"), p.alias("b"), F.lit(2000 - unit).cast("long").alias("peak"), F.lit(2000 - unit).cast("long").alias("sum"), p.alias("last"))
        more = F.struct(s["done"].alias("done"), s["a"].alias("a"), F.when(total >= s["peak"], p).otherwise(s["b"]).alias("b"), F.greatest(s["peak"], total).alias("peak"), total.alias("sum"), p.alias("last"))
        return F.when(fresh, new).otherwise(more)

    return F.aggregate(places, state, step, closed)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_spans, best_dice (to 6 digits): the licences that a document's spans match.

    A span is a run of words anywhere in the text, over lines, paragraphs and
    comment marks; spans do not overlap, and each goes to the licence that is
    most above the threshold there: 2000 times the common bigrams less 1000
    times the threshold for each bigram of either, then the larger template,
    then the first. Null and empty texts, and texts of fewer than two words, match
    nothing; a row that repeats is scanned as one with its double, so that
    n_spans counts both. No templates or no documents give no rows. Very long
    texts are scanned whole.
    """
    unit = round(1000 * threshold)
    known = [(name, template_bigrams(t)) for name, t in (TEMPLATES | whole_texts() if templates is None else templates).items()]
    sized = []
    for name, b in known:
        if b:
            lo, hi = size_bounds(len(b), threshold)
            telling = [_hashed(x) for x in b if _telling(x)]
            # So many bigrams of two function words may be among the least number that a match has.
            sized.append((name, [_hashed(x) for x in b], telling, len(b), lo, hi, lo - (len(b) - len(telling))))
    if not sized:
        return docs.select(F.col(doc_id), F.lit("").alias("license"), F.lit(0).cast("long").alias("n_spans"), F.lit(0.0).alias("best_dice")).limit(0)
    telling = sorted({h for _, _, t, *_ in sized for h in t})
    enough = min(need for *_, need in sized)
    w = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), _once(F.split(normalised(F.col(text)), " ")).alias("_w")).where(F.size("_w") > 1)
    rows = w.select("_id", _once(F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1)))).alias("_b"))
    if enough > 0:
        rows = rows.withColumn("_r", _once(F.array_distinct(F.expr(f"filter(_b, h -> {_one_of(telling)})")))).where(F.size("_r") >= enough)
    else:
        rows = rows.withColumn("_r", _once(F.array_distinct("_b")))
    can = [f"case when size(filter(_r, h -> {_one_of(t)})) >= {need} then {k} end" if need > 0 else f"{k}" for k, (_, _, t, _, _, _, need) in enumerate(sized)]
    rows = rows.withColumn("_t", _once(F.expr(f"filter(array({', '.join(can)}), x -> x is not null)"))).where(F.size("_t") > 0)
    none = F.array().cast("array<struct<margin:long,n:int,k:int,a:int,b:int,dice:double>>")

    def found(k: int) -> Column:
        _, hashes, _, n, lo, hi, _ = sized[k]
        hits = F.expr(f"filter(transform(_b, (h, i) -> named_struct('i', i, 'h', h)), x -> exists(array(x.h), h -> {_one_of(hashes)}))")

        def scored(held: Column) -> Column:
            def one(x: Column) -> Column:
                d = F.size(F.array_distinct(F.slice("_b", x["a"] + 1, x["b"] - x["a"] + 1)))
                h = F.size(F.array_distinct(F.transform(F.filter(held, lambda y: y["i"].between(x["a"], x["b"])), lambda y: y["h"])))
                return F.struct((2000 * h - unit * (d + n)).cast("long").alias("margin"), F.lit(n).alias("n"), F.lit(k).alias("k"), x["a"].alias("a"), x["b"].alias("b"), F.when(d.between(lo, hi), 2.0 * h / (d + n)).otherwise(0.0).alias("dice"))

            return F.filter(F.transform(_windows(F.transform(held, lambda y: y["i"]), n, unit), one), lambda x: x["dice"] >= threshold - 1e-9)

        return F.flatten(F.transform(F.array(hits), scored))

    def chosen(k: Column) -> Column:
        out = none
        for n in range(len(sized)):
            out = F.when(k == n, found(n)).otherwise(out) if n else F.when(k == 0, found(0)).otherwise(none)
        return out

    ranked = F.array_sort(F.transform(F.flatten(F.transform("_t", chosen)), lambda x: F.struct((-x["margin"]).alias("up"), (-x["n"]).alias("m"), x["k"].alias("k"), x["a"].alias("a"), x["b"].alias("b"), x["dice"].alias("dice"))))
    kept = F.array().cast("array<struct<up:long,m:int,k:int,a:int,b:int,dice:double>>")
    best = F.aggregate("_m", kept, lambda s, x: F.when(F.exists(s, lambda y: (y["a"] <= x["b"]) & (x["a"] <= y["b"])), s).otherwise(F.concat(s, F.array(x))))
    names = F.array(*(F.lit(name) for name, *_ in sized))
    met = rows.withColumn("_m", _once(ranked)).where(F.size("_m") > 0).select("_id", F.explode(best).alias("m")).select("_id", F.get(names, F.col("m.k")).alias("license"), "m.dice")
    return met.groupBy("_id", "license").agg(F.count("*").alias("n_spans"), F.round(F.max("dice"), 6).alias("best_dice")).withColumnRenamed("_id", doc_id)


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over documents with the built-in templates: every bigram of every template, walked by recursion."""
    unit = round(1000 * threshold)
    rows = ",\n  ".join(f"({k}, '{name}', string_split('{'|'.join(template_bigrams(t))}', '|'))" for k, (name, t) in enumerate((TEMPLATES | whole_texts()).items()))
    return f"""
with recursive templates(k, license, tb) as materialized (values
  {rows}
), sized as materialized (select k, len(tb) as n from templates), grams as materialized (select k, unnest(tb) as g from templates
), folded as materialized (
  select row_number() over () as r, doc_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as w from documents where text is not null
), pairs as materialized (select r, i - 1 as i, w[i] || ' ' || w[i + 1] as g from folded, lateral (select unnest(range(1, len(w))) as i)
), met as materialized (select r, k, i, g from pairs join grams using (g)
), able as (select r, k from met join sized using (k) group by r, k, n having 3 * count(distinct g) >= 2 * n
), hits as materialized (select r, k, i, row_number() over (partition by r, k order by i) as s, i - lag(i) over (partition by r, k order by i) - 1 as gap from met join able using (r, k)
), walk as (
  select r, k, s, i as a, i as b, {2000 - unit} as peak, {2000 - unit} as total, cast(null as bigint) as done_a, cast(null as bigint) as done_b from hits where s = 1
  union all
  select r, k, h.s, case when fresh then i else a end, case when fresh or left_ + {2000 - unit} >= peak then i else b end,
         case when fresh then {2000 - unit} else greatest(peak, left_ + {2000 - unit}) end, case when fresh then {2000 - unit} else left_ + {2000 - unit} end,
         case when fresh then a end, case when fresh then b end
  from (select x.*, y.i, total - y.gap * {unit} as left_, total - y.gap * {unit} <= 0 or 2 * (peak - (total - y.gap * {unit})) > {unit} * n as fresh, y.s as hs
        from walk x join hits y on y.r = x.r and y.k = x.k and y.s = x.s + 1 join sized on sized.k = x.k) z, lateral (select z.hs as s) h
), ends as (
  select r, k, done_a as a, done_b as b from walk where done_a is not null
  union all
  select r, k, a, b from (select *, row_number() over (partition by r, k order by s desc) as back from walk) where back = 1
), scored as materialized (
  select e.r, e.k, n, a, b, count(distinct p.g) as d, count(distinct p.g) filter (p.g in (select g from grams where grams.k = e.k)) as h
  from ends e join sized using (k) join pairs p on p.r = e.r and p.i between e.a and e.b group by e.r, e.k, n, a, b
), good as (
  select *, row_number() over (partition by r order by 2000 * h - {unit} * (d + n) desc, n desc, k, a) as place from scored
  where 2.0::double * h / (d + n) >= {threshold - 1e-9}
), taken as (
  select r, k, 2.0::double * h / (d + n) as dice, place, true as kept, [struct_pack(a := a, b := b)] as spans from good where place = 1
  union all
  select g.r, g.k, 2.0::double * g.h / (g.d + g.n), g.place, len(list_filter(t.spans, lambda y: y.a <= g.b and g.a <= y.b)) = 0,
         case when len(list_filter(t.spans, lambda y: y.a <= g.b and g.a <= y.b)) = 0 then list_append(t.spans, struct_pack(a := g.a, b := g.b)) else t.spans end
  from taken t join good g on g.r = t.r and g.place = t.place + 1
)
select doc_id, license, count(*) as n_spans, round(max(dice), 6) as best_dice
from taken join folded using (r) join templates using (k) where kept group by doc_id, license
"""
