"""Licence scan: texts against licence templates by Dice coefficient over word bigrams.

Templates are notices, file headers, SPDX lines and, for the usual licences,
full texts.  Units are the lines of a text, and the whole text where it has several lines.
A unit and a template are lower-cased, everything but letters a-z and digits
becomes a space, and their distinct word bigrams are compared:
``2 * shared / (unit + template)``.  Only units whose number of bigrams lies
within the bounds that the threshold allows for some template are looked at:
more than ``(2 - t) / t`` times the template's number, or less than its
inverse, cannot reach ``t``.  Templates are a short list (checked), so they
stand in the expression itself, and all of it is Spark SQL functions without
any join or exchange.

Defined results: null text has no units and no licence; a template of fewer
than two words is refused; ties go to the first name in alphabetical order;
rows are judged one by one, so repeated ids and other columns do not matter.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, functions as F

MOST_TEMPLATES = 256
#: Short notices of public licences, as their texts recommend them or as they are often put.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_GNU = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} "
        "version {} of the License, or (at your option) any later version.")
_WARRANTY = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
             "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. "
             "If not, see <https://www.gnu.org/licenses/>.")
_KINDS = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3"),
          "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3")}
#: Headers of files and further notices in common use.
HEADERS = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        'the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License '
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        'governing permissions and limitations under the License.'],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
                "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "ISC": ["Released under the ISC License."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "MIT": ["Licensed under the MIT License.", "This project is licensed under the MIT License, see the LICENSE file for details."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."],
}


def _templates() -> dict[str, tuple[str, ...]]:
    """All texts of every licence: notice, headers, SPDX lines, and the full text from ``licence_texts``."""
    out: dict[str, list[str]] = {k: [v] for k, v in NOTICES.items()}
    for name, texts in HEADERS.items():
        out.setdefault(name, []).extend(texts)
    for name, (title, version) in _KINDS.items():
        head = _GNU.format(":", title, ", either", version)
        out.setdefault(name, []).extend([head, head + _WARRANTY.format(title, title)])
    full = {f.name[:-4]: f.read_text(encoding="utf-8") for f in resources.files("muster.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")}
    for name, text in full.items():
        out.setdefault(name, []).append(text)
    for name, texts in out.items():
        texts += [f"SPDX-License-Identifier: {name}{end}" for end in (("", "-only", "-or-later") if name in _KINDS else ("",))]
    return {k: tuple(v) for k, v in sorted(out.items())}


TEMPLATES = _templates()


def pairs_of(templates: dict[str, str | tuple[str, ...]]) -> list[tuple[str, str]]:
    """Every template with its name, in order of names."""
    return [(k, text) for k, v in sorted(templates.items()) for text in ((v,) if isinstance(v, str) else v)]


def normalised(text: str) -> list[str]:
    """Words of a template, as the scan sees words."""
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split()


def bigrams(text: str) -> list[str]:
    words = normalised(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold with a template of ``n``."""
    fits = [m for m in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(m, n) >= threshold * (m + n) - 1e-9]
    return min(fits), max(fits)


def scan(documents: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, *, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, n_units, licence, shared, total, licences)`` per document.

    ``licence`` is the best match over all units, with shared bigrams and the
    sum of both sizes (Dice is ``2 * shared / total``); ``licences`` lists all
    names that reach the threshold, in order, separated by commas.
    """
    texts = [(k, bigrams(v)) for k, v in pairs_of(templates or TEMPLATES)]
    if len(texts) > MOST_TEMPLATES or not all(b for _, b in texts):
        raise ValueError(f"at most {MOST_TEMPLATES} templates, each of two words or more")
    bounds = [size_bounds(len(b), threshold) for _, b in texts]
    most = max(hi for _, hi in bounds)
    known = ", ".join(f"'{x}'" for x in sorted({x for _, b in texts for x in b}))

    def unit(raw: Column) -> Column:
        flat = F.trim(F.regexp_replace(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))
        return F.split(flat, " ")

    def pairs(words: Column) -> Column:
        n = F.size(words)
        return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

    text = F.col("text").cast("string")
    lines = F.split(text, "\n")
    units = F.filter(F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines), lambda x: F.length(F.trim(x)) > 0)

    order = {name: -i for i, name in enumerate(sorted({k for k, _ in texts}))}

    def rated(u: Column) -> Column:
        """``(dice, order, shared, total, name)`` of a unit for every template whose size allows it."""
        sizes = F.array(*[F.struct(
            F.lit(order[k]).alias("order"),
            F.when(u["n"].between(*bound), F.size(F.array_intersect(u["hit"], F.split(F.lit(",".join(b)), ",")))).otherwise(0).alias("shared"),
            (u["n"] + len(b)).alias("total"), F.lit(k).alias("name")) for (k, b), bound in zip(texts, bounds)])
        return F.filter(F.transform(sizes, lambda x: F.struct((F.lit(2.0) * x["shared"] / x["total"]).alias("dice"), x["order"], x["shared"], x["total"], x["name"])),
                        lambda x: x["dice"] >= threshold - 1e-9)

    # A bigram has at least three characters and repeats may be many, so a long
    # line is told by its distinct bigrams only; words are counted before them.
    least = min(lo for lo, _ in bounds)
    near = F.filter(
        F.transform(F.transform(F.col("_units"), unit), lambda w: F.when(F.size(w) > least, pairs(w)).otherwise(F.array().cast("array<string>"))),
        lambda b: (F.size(b) >= least) & (F.size(b) <= most))
    # With n bigrams, at least n * t / (2 - t) must be a template's.
    hits = F.filter(F.expr(f"transform(_near, b -> struct(size(b) as n, filter(b, x -> x in ({known})) as hit))"),
                    lambda u: F.size(u["hit"]) >= u["n"] * (threshold / (2 - threshold)) - 1e-9)
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), units.alias("_units")).select(
        "doc_id", F.coalesce(F.size("_units"), F.lit(0)).alias("n_units"), near.alias("_near")).select("doc_id", "n_units", hits.alias("_hits"))
    best = found.select("doc_id", "n_units", F.flatten(F.transform("_hits", rated)).alias("_best"))
    top = F.array_max("_best")
    return best.select(
        "doc_id", F.greatest(F.col("n_units"), F.lit(0)).cast("long").alias("n_units"), top["name"].alias("licence"),
        top["shared"].cast("long").alias("shared"), top["total"].cast("long").alias("total"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("_best", lambda x: x["name"]))), ","), F.lit("")).alias("licences"))
