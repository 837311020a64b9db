"""Licence scans: lines, passages and whole texts compared with templates by word bigrams (DataFrame expressions only)."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import named

THRESHOLD = 0.8

# Licence notices and short licence texts, by name.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
    "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
    "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
    "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
    "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
    "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a "
    "copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def passage_lengths(text: str, threshold: float) -> list[int]:
    """Lengths in bigrams of the passages compared with a template: five, in even proportion between the size bounds."""
    bigrams = len(re.findall("[a-z0-9]+", text.lower())) - 1
    step = math.sqrt(threshold / (2 - threshold))
    return sorted({max(1, int(bigrams * step**k + 0.5)) for k in (2, 1, 0, -1, -2)})


def anchors(bigrams: list[str], threshold: float, most: int = 4) -> list[list[str]]:
    """Groups of words: a text that reaches the threshold against a template holds a word of each group.

    With m bigrams in the template and a Dice coefficient of t, at least m * t / (2 - t) of them are shared. So if
    the bigrams without the words of a group are fewer than that, every match holds a word of the group. Longer words,
    being rarer, are chosen first; the groups have no word in common.
    """
    needed = len(bigrams) * threshold / (2 - threshold)
    words = sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w))
    groups: list[list[str]] = []
    while len(groups) < most:
        left, chosen = list(bigrams), []
        for word in words:
            if len(left) < needed - 1e-9:
                break
            if any(word in b.split() for b in left):
                chosen.append(word)
                left = [b for b in left if word not in b.split()]
        if len(left) >= needed - 1e-9:
            break
        groups.append(chosen)
        words = [w for w in words if w not in chosen]
    return groups


def shapes_of(templates: dict[str, str], threshold: float) -> Column:
    """The templates as one constant array: name, place by name, distinct bigrams, fewest shared ones, passage lengths."""
    rows = []
    for place, (name, body) in enumerate(sorted(templates.items())):
        bag = template_bigrams(body)
        least = math.ceil(len(bag) * threshold / (2 - threshold) - 1e-9)
        rows.append({"name": name, "place": place, "bag": bag, "least": least, "lengths": passage_lengths(body, threshold)})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,place:int,bag:array<string>,least:int,lengths:array<int>>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits, A-Z lower-cased."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """The neighbouring pairs of an array of words, in order; empty for fewer than two."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def bigrams_of(words: Column) -> Column:
    """The distinct neighbouring pairs of an array of words; empty for fewer than two."""
    return F.array_distinct(let(words, pairs_of))


def passages_of(pairs: Column, templates: dict[str, str], threshold: float) -> Column:
    """The passages ``(licence, dice, n_bigrams, start, length)`` of a text's neighbouring pairs of words.

    A passage begins with a pair of its template and has one of the template's lengths. Of those with one beginning the
    best, then the shortest, counts, and of those that overlap only the ones that no other exceeds (by Dice, then by place).
    Templates of which the text holds too few pairs, and beginnings too few pairs follow, are passed over.
    """
    every = sorted({b for body in templates.values() for b in template_bigrams(body)})

    def of(t: Column, known: Column) -> Column:
        longest = F.element_at(t["lengths"], -1)

        def window(start: Column, length: Column) -> Column:
            return let(F.array_distinct(F.slice(pairs, start + 1, length)), lambda unit: F.struct(
                (2.0 * F.size(F.array_intersect(unit, t["bag"])) / (F.size(unit) + F.size(t["bag"]))).alias("dice"),
                (-length).alias("shorter"), F.size(unit).cast("long").alias("n"),
            ))

        def best(start: Column) -> Column:
            return let(F.array_max(F.transform(t["lengths"], lambda n: window(start, n))), lambda x: F.struct(
                t["name"].alias("licence"), x["dice"].alias("dice"), x["n"].alias("n_bigrams"), start.alias("start"),
                F.least(-x["shorter"], F.size(pairs) - start).alias("length"),
            ))

        def exceeds(other: Column, one: Column) -> Column:
            meets = (other["start"] < one["start"] + one["length"]) & (one["start"] < other["start"] + other["length"])
            return meets & ((other["dice"] > one["dice"]) | ((other["dice"] == one["dice"]) & (other["start"] < one["start"])))

        def unexceeded(found: Column) -> Column:
            def around(i: Column) -> Column:
                return F.slice(found, F.greatest(i + 1 - longest, F.lit(1)), longest * 2 + 1)

            return F.filter(found, lambda one, i: ~F.exists(around(i), lambda other: exceeds(other, one)))

        def windows(hits: Column) -> Column:
            full = F.filter(hits, lambda h, i: F.get(hits, i + t["least"] - 1)["at"] - h["at"] < longest)
            good = F.filter(F.transform(full, lambda h: best(h["at"])), lambda x: x["dice"] >= threshold)
            enough = F.size(F.array_distinct(F.transform(hits, lambda h: h["b"]))) >= t["least"]
            return F.when(enough, let(good, unexceeded))

        return let(F.filter(known, lambda h: F.array_contains(t["bag"], h["b"])), windows)

    placed = F.transform(pairs, lambda b, i: F.when(b.isin(every), F.struct(i.cast("int").alias("at"), b.alias("b"))))
    shapes = shapes_of(templates, threshold)
    return let(F.array_compact(placed), lambda known: F.flatten(F.array_compact(F.transform(shapes, lambda t: of(t, known)))))


def scan(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Matches ``doc_id, scope, line_no, licence, dice, n_bigrams``: the best template of every line and whole text, and passages.

    A line (``scope`` "line", numbered from 0) and the whole text of several lines ("document", line number -1) match a
    template if twice the shared distinct word bigrams make up ``threshold`` or more of both sides' (Dice); of several
    templates the best, then the first by name, is given. A notice inside a longer line, and a licence wrapped over
    several lines of a longer text, are found as stretches of words ("passage", with the number of the line they begin
    in), judged by the same measure: see ``passages_of``. A passage is not given where the whole text, or a line that it
    touches, matches the same template. Templates whose size alone rules a match out are not compared; texts without
    any word that every match needs are passed over.

    Null and empty texts and texts of fewer than two words match nothing. Repeated rows give repeated matches. Null
    ids are kept. Everything is computed within the row: no shuffle, whatever the groups are.
    """
    templates = {name: body for name, body in (TEMPLATES if templates is None else templates).items() if template_bigrams(body)}
    rows = documents.select(named(doc_id).alias("doc_id"), named(text).cast("string").alias("text"))
    if not templates:
        empty = {"scope": "string", "line_no": "long", "licence": "string", "dice": "double", "n_bigrams": "long"}
        return rows.where("false").select("doc_id", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])
    needed = [anchors(template_bigrams(body), threshold) for body in templates.values()]
    result = "array<struct<scope:string,line_no:bigint,licence:string,dice:double,n_bigrams:bigint>>"

    def hopeful(body: Column) -> Column:
        def holds(low: Column) -> Column:
            every = [[reduce(or_, [F.contains(low, F.lit(w)) for w in group]) for group in groups] for groups in needed]
            return reduce(or_, [reduce(and_, groups, F.lit(True)) for groups in every], F.lit(False))

        return let(F.lower(body), holds)

    def near(bag: Column, n: Column) -> Column:
        """The best template of a set of ``n`` bigrams, among those whose size permits a match."""
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        sized = F.filter(shapes_of(templates, threshold), lambda t: n.between(F.size(t["bag"]) * low - 1e-9, F.size(t["bag"]) * high + 1e-9))
        return F.array_max(F.transform(sized, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(bag, t["bag"])) / (n + F.size(t["bag"]))).alias("dice"),
            (-t["place"]).alias("place"), t["name"].alias("licence"), n.cast("long").alias("n_bigrams"),
        )))

    def judged(scope: str, line_no: Column, bag: Column) -> Column:
        return let(let(F.size(bag), lambda n: near(bag, n)), lambda best: F.struct(
            F.lit(scope).alias("scope"), line_no.cast("long").alias("line_no"), best["licence"].alias("licence"),
            best["dice"].alias("dice"), best["n_bigrams"].alias("n_bigrams"),
        ))

    def further(pairs: Column, found: Column) -> Column:
        """The passages that no match in ``found`` accounts for."""
        split = F.split("text", "\n")
        line_of = F.flatten(F.transform(split, lambda line, i: F.transform(words_of(line), lambda _: i.cast("long"))))

        def numbered(passages: Column, lines: Column) -> Column:
            ends = F.transform(passages, lambda p: F.struct(
                F.get(lines, p["start"]).alias("first"), F.get(lines, p["start"] + p["length"]).alias("last"), p.alias("p"),
            ))
            new = F.filter(ends, lambda e: ~F.exists(found, lambda u: (u["licence"] == e["p"]["licence"]) & (
                (u["scope"] == "document") | u["line_no"].between(e["first"], e["last"])
            )))
            return F.transform(new, lambda e: F.struct(
                F.lit("passage").alias("scope"), e["first"].alias("line_no"), e["p"]["licence"].alias("licence"),
                e["p"]["dice"].alias("dice"), e["p"]["n_bigrams"].alias("n_bigrams"),
            ))

        def with_lines(passages: Column) -> Column:
            return F.when(F.size(passages) > 0, let(line_of, lambda lines: numbered(passages, lines))).otherwise(F.array().cast(result))

        return let(passages_of(pairs, templates, threshold), with_lines)

    def matches(pairs: Column) -> Column:
        lines = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("body"))), lambda x: hopeful(x["body"]))
        each = F.transform(lines, lambda x: let(bigrams_of(words_of(x["body"])), lambda bag: judged("line", x["i"], bag)))
        whole = F.when(F.contains("text", F.lit("\n")), F.array(let(F.array_distinct(pairs), lambda bag: judged("document", F.lit(-1), bag))))
        units = F.concat(each, F.coalesce(whole, F.array().cast(result)))
        return let(F.filter(units, lambda u: u["dice"] >= threshold), lambda found: F.concat(found, further(pairs, found)))

    # Units are judged inside the generator's input, once each; only matches become rows.
    found = rows.where(hopeful(F.col("text"))).select("doc_id", F.explode(let(let(words_of(F.col("text")), pairs_of), matches)).alias("u"))
    return found.select("doc_id", "u.scope", "u.line_no", "u.licence", "u.dice", "u.n_bigrams")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql() -> str:
    """The same result over ``documents`` in SQL, without any of the shortcuts."""
    bags = {name: template_bigrams(body) for name, body in sorted(TEMPLATES.items())}
    values = ", ".join(
        f"({quoted(n)}, {i}, [{', '.join(map(quoted, b))}], {passage_lengths(TEMPLATES[n], THRESHOLD)})" for i, (n, b) in enumerate(bags.items())
    )

    def words(body: str) -> str:
        return f"list_filter(string_split(regexp_replace(translate({body}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"

    return f"""
with templates(licence, place, t, lengths) as (values {values}),
units as (
  select doc_id, 'line' as scope, unnest(range(len(string_split(text, chr(10))))) :: bigint as line_no, unnest(string_split(text, chr(10))) as body
  from documents where text is not null
  union all
  select doc_id, 'document', -1 :: bigint, text from documents where contains(text, chr(10))
),
worded as (select doc_id, scope, line_no, {words("body")} as w from units),
bagged as (
  select doc_id, scope, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bag
  from worded where len(w) >= 2
),
scored as (
  select doc_id, scope, line_no, licence, place, 2.0 :: double * len(list_intersect(bag, t)) / (len(bag) + len(t)) as dice, len(bag) :: bigint as n_bigrams
  from bagged join templates on len(bag) * 3 >= len(t) and len(t) * 3 >= len(bag)
),
matched as (
  select doc_id, scope, line_no, licence, dice, n_bigrams from (
    select *, row_number() over (partition by doc_id, scope, line_no order by dice desc, place) as r from scored where dice >= {THRESHOLD}
  ) where r = 1
),
numbered as (select doc_id, line_no, unnest(w) as word, generate_subscripts(w, 1) as n from worded where scope = 'line'),
placed as (
  select doc_id, line_no, word, row_number() over (partition by doc_id order by line_no, n) as p,
    word || ' ' || lead(word) over (partition by doc_id order by line_no, n) as pair
  from numbered
),
pairs as (select doc_id, list(pair order by p) filter (pair is not null) as pairs, list(line_no order by p) as lines from placed group by doc_id),
begun as (
  select doc_id, licence, t, p, unnest(lengths) as length from placed join (select *, unnest(t) as pair from templates) using (pair)
),
cut as (
  select doc_id, licence, t, p, length, lines[p] as line_no, lines[least(p + length, len(lines))] as last_line, least(length, len(pairs) - p + 1) as held,
    list_distinct(pairs[p : p + length - 1]) as bag
  from begun join pairs using (doc_id)
),
judged as (
  select *, 2.0 :: double * len(list_intersect(bag, t)) / (len(bag) + len(t)) as dice, len(bag) :: bigint as n_bigrams from cut
),
best as (select * from (select *, row_number() over (partition by doc_id, licence, p order by dice desc, length) as r from judged where dice >= {THRESHOLD}) where r = 1),
passages as (
  select * from best one where not exists (
    select 1 from best other where other.doc_id = one.doc_id and other.licence = one.licence and other.p < one.p + one.held and one.p < other.p + other.held
      and (other.dice > one.dice or (other.dice = one.dice and other.p < one.p))
  )
)
select * from matched
union all
select doc_id, 'passage', line_no, licence, dice, n_bigrams from passages p where not exists (
  select 1 from matched m where m.doc_id = p.doc_id and m.licence = p.licence and (m.scope = 'document' or m.line_no between p.line_no and p.last_line)
)"""
