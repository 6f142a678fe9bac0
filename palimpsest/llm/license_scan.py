"""Licence scan in DataFrame functions alone: a sparse logistic regression over word n-grams, confirmed by templates.

A paragraph (a line of text) is the set of its word pairs, and of its words that stand in licences' short names. Notices wrapped over several lines are found as well:
at every line break but those at blank lines, the last words of the line and the first of the lines after it, as many
of either as the longest notice has, are one more paragraph, numbered after its first line. It counts where it is likelier
than each line in it that names a licence, and then stands for those lines; of two such paragraphs with a line in common
the likelier counts.

A multinomial logistic regression with an L1 penalty is trained on wordings by which works name their licence and on the
licences' own paragraphs (LICENSES), within other words, against paragraphs of the corpus and sentences that only sound
alike (the class `unknown`). Every third learning row is held out: the unknown class is calibrated by the margins of
these, scale and shift putting the surest of the held-out unknown at 5 percent and the least sure notice at 95. A
paragraph that the regression gives to a family is confirmed if it holds at least `confirm` of the word pairs of one of
the family's templates.

The penalty leaves weights on few n-grams. Each of these has a hint, its n-gram's rarer word, but for the commonest words,
as many as cannot make a notice without any other; texts and lines without any hint (nearly all) drop out by one look-up
a word, as what they are: unknown. Of the others only the
n-grams that some weight or template has are carried on, without the text, so the work grows with a paragraph's length
and no faster.

Learning takes a bounded sample of at most `unknowns` corpus paragraphs of up to `longest_paragraph` characters, from
texts of up to `longest_text`, in the order of a hash of the text, less those that share much with a template; n-grams
that more than the share `common` of them have are no features.

Defined results: a null or empty text has no paragraphs; a blank line is white space only, and lines without letters or
digits (rulers, comment marks) are passed over; a row per paragraph found, so a document without licences has
no row; of equally likely families the last by its place in LICENSES counts; of equally likely passages with a line in
common the narrower, then the first; repeated rows of one doc_id are scanned one by one; a null doc_id is passed on; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table

# By family, the licence's names, its short names, its identifiers, and paragraphs of its own wording.
LICENSES = {
    "MIT": (["MIT License", "MIT license"], ["MIT"], ["MIT"], [
        "Permission is hereby granted, free of charge, to any person",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software",
    ]),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache 2.0 License"], ["Apache 2.0", "Apache-2.0"], ["Apache-2.0"], [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ]),
    "GPL-3.0": (["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3"], ["GPLv3", "GPL v3", "GPL-3.0"], ["GPL-3.0-only", "GPL-3.0-or-later"], [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ]),
    "GPL-2.0": (["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2"], ["GPLv2", "GPL v2", "GPL-2.0"], ["GPL-2.0-only", "GPL-2.0-or-later"], [
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ]),
    "LGPL": (["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License"], ["LGPLv3", "LGPL v2.1", "LGPL"], ["LGPL-2.1-or-later", "LGPL-3.0-or-later"], [
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU LESSER GENERAL PUBLIC LICENSE",
    ]),
    "AGPL-3.0": (["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL version 3"], ["AGPLv3", "AGPL v3", "AGPL-3.0"], ["AGPL-3.0-only", "AGPL-3.0-or-later"], [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ]),
    "BSD": (["BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "Simplified BSD License", "New BSD License"], ["BSD 3-Clause", "BSD 2-Clause", "BSD"], ["BSD-2-Clause", "BSD-3-Clause"], [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ]),
    "ISC": (["ISC License"], ["ISC"], ["ISC"], [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ]),
    "Zlib": (["zlib License", "zlib/libpng License"], ["zlib"], ["Zlib"], [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ]),
    "BSL-1.0": (["Boost Software License, Version 1.0", "Boost Software License"], ["BSL-1.0"], ["BSL-1.0"], [
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    ]),
    "EPL-2.0": (["Eclipse Public License v. 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License"], ["EPL-2.0", "EPL 2.0"], ["EPL-2.0"], [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ]),
    "MPL-2.0": (["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"], ["MPL-2.0", "MPL 2.0"], ["MPL-2.0"], [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ]),
    "CC-BY": (["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"], ["CC BY 4.0", "CC-BY"], ["CC-BY-4.0"], []),
    "CC-BY-SA": (["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"], ["CC BY-SA 4.0", "CC-BY-SA"], ["CC-BY-SA-4.0"], []),
    "CC-BY-NC": (["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"], ["CC BY-NC 4.0", "CC-BY-NC"], ["CC-BY-NC-4.0"], []),
    "CC0": (["CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal"], ["CC0 1.0", "CC0"], ["CC0-1.0"], [
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ]),
    "Unlicense": (["Unlicense"], [], ["Unlicense"], [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ]),
    "proprietary": ([], [], [], [
        "All rights reserved.", "Copyright (c) 2020 Example Ltd. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This software is proprietary and confidential.", "No part of this work may be reproduced without the prior written permission of the publisher.",
    ]),
}
#: Ways to name a licence by its name, by a short name, and by its identifier.
BY_NAME = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This program is licensed under the {}.", "This project is distributed under the terms of the {}.", "The code is available under the {}; see LICENSE for details."]
BY_SHORT = ["This project is {} licensed.", "License: {}", "Licensed under {}."]
BY_ID = ["SPDX-License-Identifier: {}"]
#: Sentences that share words with notices and name no licence; {} is a short name.
DECOYS = [
    "He showed the officer a driver license.", "The version of the story that was released is free of charge.", "This work is a copy of the public record.",
    "All rights are equal.", "They reserved a table under the name of a friend.", "The terms of the agreement were general.", "A software license costs more every year.",
    "Under the bridge the source of the river is public.", "The commons were reserved for all.", "The foundation published a version of the book.",
    "Version 2 of the work is in this file.", "Permission was granted.", "The apache helicopter landed.", "She studied at MIT.", "Use of this file is free.",
    "The license plate is under the seat.", "Attribution of the work is open.", "The public domain is large.", "Without restriction they may use it.",
    "All human rights reserved to the people.", "All human rights are reserved by law to all the people.", "The rights of all are reserved to the people.", "A professor at MIT released a paper.", "MIT is a university in Cambridge.",
    "The band released a new version under the old name.", "The eclipse was seen by the general public.", "A boost for the software of the public.", "The Mozilla foundation published a report.",
    "The driver was licensed under the old law.", "The general public was free to copy the file.", "He was granted permission to use the software.", "A license to fish is free of charge.",
    "Copyright is a right of authors.", "The copyright law of the country is old.", "The court reserved its decision on all rights of the people.", "The project is available under the name of the city.",
    "The program is distributed by the ministry.", "The creative director praised the commons.", "Attribution of the painting is uncertain.", "The notice shall be included in the report.",
    "Any person may obtain a copy of the report.", "The above conditions are met.", "They identified the license of the driver.", "Software is licensed by the year.", "See the license office for details.",
    "The terms of the public license were debated in general.", "A warranty is implied by law.", "No part of this story is true.", "Confidential papers were found.", "Copying is prohibited in the exam.",
    "He has a house and a garden by the river.", "It is one of the oldest towns in the country, and it has been so for a long time.", "You may see it from the hill if the weather is good.", "She was the first of the three to be there.",
    "This is the end of the story, or so they say.", "They have to be in the city by the end of the week.", "As for the others, they did not say a word in any case.", "The law of the land is not the same for all of them.",
    "A copy of the book was sold at the fair to a person who paid for it.", "The people of the town must not use the old bridge at all.",
]
AROUND = ["{}", "This project: {}", "Copyright (c) 2019 Jane Doe. {}", "{} See the file for details.", "Notice. {} Thank you for reading this page."]
UNKNOWN = "unknown"


def _templates() -> dict[str, list[str]]:
    """By family, the wordings that confirm it."""
    said = {}
    for family, (names, shorts, ids, own) in LICENSES.items():
        made = [way.format(x) for ways, some in ((BY_NAME, names), (BY_SHORT, shorts), (BY_ID, ids)) for way in ways for x in some]
        said[family] = list(dict.fromkeys([*own, *made]))
    return said


NOTICES = _templates()
#: Words that are features on their own: those of short names. All others are so in pairs only, as common words say nothing about licences.
SINGLE = {w for names, shorts, _, _ in LICENSES.values() for n in (*shorts, *(n for n in names if " " not in n)) for w in re.split(r"[\W_]+", n.lower()) if len(w) > 2}


def grams(text: Column) -> Column:
    """The distinct words and word pairs of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.array_compact(F.concat(words, _pairs(words))))


def _pairs(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, paragraph, text) of docs(doc_id, text), blank lines left out but counted."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", "\n").alias("lines"))
    return rows.select("row", "doc_id", F.posexplode("lines").alias("paragraph", "text")).filter(F.trim("text") != "")


#: The most words that any of NOTICES has.
LONGEST = max(len([w for w in re.split(r"[\W_]+", n) if w]) for own in NOTICES.values() for n in own)


def passages(docs: DataFrame, hints: list[str]) -> DataFrame:
    """(row, doc_id, paragraph, last, text): the lines of docs(doc_id, text) with a hint, and around each break near one the words of `paragraph` to `last`."""
    words = lambda x: F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # A word of ASCII letters and digits is a piece, whatever stands around it; SQL text, as so many literals are slow to make one by one.
    listed = ", ".join(f"'{h}'" for h in hints) or "NULL"
    flags = F.expr(f"transform(split(text, '\\n'), x -> exists(split(lower(x), '[^a-z0-9]+'), w -> coalesce(w IN ({listed}), false)))")
    read = lambda x, n: F.struct(n.alias("n"), x.alias("text"), F.get("flags", n).alias("hinted"), F.slice(words(x), 1, LONGEST).alias("head"))
    worded = lambda s: (F.size(s["head"]) > 0) | ~s["text"].rlike(r"\S")
    some = docs.withColumn("flags", flags).filter(F.array_contains("flags", True))
    rows = some.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(F.transform(F.split("text", "\n"), read), worded).alias("lines"))
    near = F.transform("lines", lambda s, k: F.struct(s.alias("s"), k.alias("k"), F.exists(F.slice("lines", k + 1, LONGEST + 1), lambda x: x["hinted"]).alias("near")))
    near = F.filter(near, lambda x: x["near"] & x["s"]["text"].rlike(r"\S"))
    count = lambda a, s: F.when(a["words"] >= LONGEST, a).otherwise(F.struct((a["words"] + F.size(s["head"])).alias("words"), (a["lines"] + 1).alias("lines")))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    blank = lambda some: F.array_position(F.transform(some, lambda s: F.size(s["head"]) == 0), True).cast("int")
    block = lambda some: F.when(blank(some) > 0, F.slice(some, 1, F.greatest(blank(some) - 1, F.lit(0)))).otherwise(some)
    after = lambda some: F.slice(some, 1, F.aggregate(some, none, count)["lines"])  # noqa: E731  # lines enough for LONGEST words
    following = F.transform(near, lambda x: F.struct(x["s"]["n"].alias("n"), x["s"]["text"].alias("text"), x["s"]["hinted"].alias("hinted"), after(block(F.slice("lines", x["k"] + 2, LONGEST))).alias("after")))
    lines = rows.select("row", "doc_id", F.explode(following).alias("s")).select("row", "doc_id", F.col("s.n").alias("paragraph"), "s.text", "s.hinted", "s.after")
    own = words(F.col("text"))
    joined = F.array_join(F.concat(F.slice(own, F.greatest(F.size(own) - LONGEST + 1, F.lit(1)), F.lit(LONGEST)), F.slice(F.flatten("after.head"), 1, LONGEST)), " ")
    line = F.when(F.col("hinted"), F.struct(F.col("paragraph").alias("last"), F.col("text")))
    wrapped = F.when(F.size("after") > 0, F.struct(F.element_at("after", -1)["n"].alias("last"), joined.alias("text")))
    return lines.select("row", "doc_id", "paragraph", F.explode(F.array_compact(F.array(line, wrapped))).alias("p")).select("row", "doc_id", "paragraph", "p.last", "p.text")


#: The most words that any of NOTICES has.
LONGEST = max(len([w for w in re.split(r"[\W_]+", n) if w]) for own in NOTICES.values() for n in own)


def _template_table(spark: SparkSession) -> DataFrame:
    """(family, template, own): each template's number and word pairs."""
    notices = spark.createDataFrame([(f, k, n) for f, own in NOTICES.items() for k, n in enumerate(own)], "family string, template int, notice string")
    words = F.filter(F.split(F.lower("notice"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return notices.select("family", "template", F.array_distinct(F.array_compact(_pairs(words))).alias("own")).filter(F.size("own") > 0)


def _quantile(values: list[float], q: float) -> float:
    return sorted(values)[min(len(values) - 1, int(q * len(values)))]


def fit_licenses(docs: DataFrame, unknowns: int = 600, longest_text: int = 32_768, longest_paragraph: int = 4096, common: float = 0.005) -> DataFrame:
    """(gram, weights, hint): the regression's few weights, an array in the order of the families, unknown first; gram '' is the intercept."""
    spark = docs.sparkSession
    families = [UNKNOWN, *LICENSES]
    known = [(float(k), around.format(n)) for k, f in enumerate(families[1:], 1) for m, n in enumerate(NOTICES[f]) for around in (AROUND[m % 5], AROUND[(m + 2) % 5])]
    known += [(float(k), x) for k, f in enumerate(families[1:], 1) for x in (*LICENSES[f][0], *LICENSES[f][1]) if x not in ("MIT", "ISC", "zlib", "BSD")]  # what these short names mean is too open
    known += [(0.0, around.format(d)) for d in DECOYS for around in AROUND]
    some = docs.filter(F.length("text").between(1, longest_text)).select("doc_id", "text").orderBy(F.xxhash64("text"), "text").limit(max(1, unknowns // 4))
    drawn = paragraphs(some).filter(F.length("text") <= longest_paragraph).orderBy("row", "paragraph").limit(2 * unknowns)
    pairs = _template_table(spark).select("family", "template", F.size("own").alias("n"), F.explode("own").alias("gram"))
    alike = drawn.select("row", "paragraph", F.explode(grams(F.col("text"))).alias("gram")).join(F.broadcast(pairs), "gram").groupBy("row", "paragraph", "family", "template").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    drawn = drawn.join(alike.filter("k >= 4 or 2 * k >= n"), ["row", "paragraph"], "left_anti")  # what may be a notice is no evidence against one
    drawn = drawn.orderBy("row", "paragraph").limit(unknowns).select(F.lit(0.0).alias("label"), "text")
    told = spark.createDataFrame(known, "label double, text string").unionByName(drawn).select("label", grams(F.col("text")).alias("grams")).collect()  # a bounded number of rows
    others = [r.grams for r in told[len(known) :]]
    seen = Counter(g for gs in others for g in gs)
    often = {g for g, n in seen.items() if n > max(1, len(others) * common)}
    features = {g for r in told[: len(known)] for g in r.grams if " " in g or g in SINGLE} - often  # what only corpus paragraphs have leads none of them to a family
    told = [(r.label, [g for g in r.grams if g in features]) for r in told]
    held = [n % 3 == 2 for n in range(len(told))]
    rows = spark.createDataFrame([x for x, h in zip(told, held) if not h], "label double, grams array<string>").coalesce(1)
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=1 << 16).fit(rows)
    model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.0003, maxIter=60, tol=1e-5, standardization=False).fit(counts.transform(rows))
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    # Calibration on what was held out: scale and shift, so that the surest unknown paragraph and the least sure notice stand at 5 and 95 percent.
    place = {g: n for n, g in enumerate(counts.vocabulary)}
    margins: dict[bool, list[float]] = {True: [], False: []}
    for (label, own_grams), h in zip(told, held):
        if h:
            logits = start + weights[:, [place[g] for g in own_grams if g in place]].sum(1)
            margins[label > 0].append(float(logits[1:].max() - logits[0]))
    low, high = _quantile(margins[False], 0.99), _quantile(margins[True], 0.02)
    scale = 2 * math.log(19) / max(high - low, 1.0)
    weights, start = weights * scale, start * scale
    start[0] += scale * (low + high) / 2
    kept = [(g, weights[:, n], _hint(g, seen)) for n, g in enumerate(counts.vocabulary) if abs(weights[:, n]).max() > 1e-9]
    # The commonest words are no hints as long as all they stand for together makes no paragraph likelier a notice than not.
    support: dict[str, np.ndarray] = {}
    for _, own, hint in kept:
        support[hint] = support.get(hint, 0) + np.maximum(own[1:] - own[0], 0)
    margin, idle = start[1:] - start[0], set()
    for hint in sorted(support, key=lambda w: (-seen[w], len(w), w)):
        if (margin + support[hint]).max() < 0:
            margin = margin + support[hint]
            idle.add(hint)
    kept = [(g, own.tolist(), "" if hint in idle else hint) for g, own, hint in kept]
    return spark.createDataFrame([("", start.tolist(), ""), *kept], "gram string, weights array<double>, hint string")


def _hint(gram: str, seen: Counter) -> str:
    """The rarer word of a pair, in the paragraphs drawn: whatever holds the pair holds it."""
    return min(gram.split(" "), key=lambda w: (seen[w], -len(w), w))


def scan_licenses(docs: DataFrame, weights: DataFrame, confirm: float = 0.8) -> DataFrame:
    """(doc_id, paragraph, family, probability, confirmed, likeness): the paragraphs of docs(doc_id, text) that name a licence."""
    spark, families = docs.sparkSession, [UNKNOWN, *LICENSES]
    told = weights.collect()  # the regression's few weights
    start = next(r.weights for r in told if r.gram == "")
    hints = sorted({r.hint for r in told if r.hint})
    templates = _template_table(spark)
    of_templates = templates.select(F.explode("own").alias("gram")).distinct()
    carried = weights.filter("gram <> ''").select("gram", "weights").join(of_templates, "gram", "full_outer")  # some thousand n-grams
    carried = carried.select("gram", F.coalesce("weights", F.array_repeat(F.lit(0.0), len(families))).alias("weights"))
    near = passages(docs.select("doc_id", "text"), hints)
    said = near.select("row", "doc_id", "paragraph", "last", F.explode(grams(F.col("text"))).alias("gram"))
    met = said.join(F.broadcast(carried), "gram")
    sums = [(F.sum(F.get("weights", F.lit(k))) + start[k]).alias(f"l{k}") for k in range(len(families))]
    logits = met.groupBy("row", "paragraph", "last").agg(*sums, F.first("doc_id").alias("doc_id"), F.collect_list("gram").alias("grams"))
    names = [F.struct(F.col(f"l{k}").alias("logit"), F.lit(k).alias("place"), F.lit(f).alias("family")) for k, f in enumerate(families)]
    top = logits.select("row", "doc_id", "paragraph", "last", "grams", F.array(*names).alias("all")).withColumn("best", F.array_max("all")).filter(F.col("best.family") != UNKNOWN)
    total = F.aggregate("all", F.lit(0.0), lambda t, x: t + F.exp(x["logit"] - F.col("best.logit")))
    found = top.select("row", "doc_id", "paragraph", "last", "grams", "best.family", (1 / total).alias("probability"))
    texts = found.join(F.broadcast(templates), "family")
    alike = F.size(F.array_intersect("grams", "own")) / F.size("own")
    out = texts.groupBy("row", "doc_id", "paragraph", "last", "family", "probability").agg(F.max(alike).alias("likeness"))
    out = _unwrapped(out)
    return out.select("doc_id", "paragraph", "family", "probability", (F.col("likeness") >= confirm).alias("confirmed"), "likeness")


def _unwrapped(found: DataFrame) -> DataFrame:
    """Of the passages found in each document, those that no likelier one with a line in common stands for; of equals a line, then the first."""
    one = F.struct("likeness", (F.col("paragraph") - F.col("last")).alias("less"), (-F.col("paragraph")).alias("place"), "last", "family", "probability")
    kept = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(one).alias("all"))  # no more than the document's own licences
    first = lambda s: -s["place"]
    meets = lambda a, b: (first(a) <= b["last"]) & (first(b) <= a["last"]) & ((a["less"] < 0) | (b["less"] < 0))
    better = lambda a, b: (a["likeness"] > b["likeness"]) | (a["likeness"] == b["likeness"]) & ((a["less"] > b["less"]) | (a["less"] == b["less"]) & (a["place"] > b["place"]))
    kept = kept.select("doc_id", F.explode(F.filter("all", lambda b: ~F.exists("all", lambda a: meets(a, b) & better(a, b)))).alias("s"))
    return kept.select("doc_id", (-F.col("s.place")).alias("paragraph"), "s.family", "s.probability", "s.likeness")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that names a licence, with its family."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, fit_licenses(docs))
