"""Licence scan: a trained paragraph classifier, with DataFrame operations only.

A paragraph is a block between empty lines, each line of a block of several, and each sentence of several.
Its features are the words, word pairs and word triples of licence notices that
hold a word of licensing or, with a negation, one of the notices' verbs. A
multinomial logistic regression gives every class a weight per feature: the
families, "unknown" (other licences, and mentions that grant nothing) and "none"
(ordinary text). It is fitted on notices, their variants and a bounded sample of
ordinary paragraphs. Whole notices are held out first, and calibrate its
temperature and the probability that a family needs; then all are learned. Every family that is likely enough
against "unknown" and "none" is compared with its templates: the likeliest one stands when enough of one of its notices,
or of a name in a sentence that grants, is found, and no other family's fits better; further ones stand when a whole
name of theirs is in a sentence that grants. A sentence grants by its words (GRANTS, and no DENIED), or by being little
else than the name.

Documents without a word of licensing have no feature, so they are passed over
by a pattern; paragraphs of the others are joined with the broadcast features
where they lie, and only what matches is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.common import BROADCAST_IDS, ascii_lower, stored
from calibrant.llm.decontaminate import BREAKS, NO_ID

UNKNOWN, NONE = "unknown", "none"
#: Ordinary paragraphs that training sees at most, from so many different texts at most.
ORDINARY_PARAGRAPHS, ORDINARY_TEXTS = 4_000, 1_000
#: Share of a template's word pairs that confirms a prediction.
CONFIRMED = 0.6
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)
#: The probability that a family needs is the least of these with which at most so many held-out paragraphs without a family get one.
LEVELS, FALSE_SHARE = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95), 0.05
#: What an ordinary paragraph of the corpus weighs in training; most have no feature, and only raise the intercept of their class.
ORDINARY_WEIGHT = 0.02
#: One notice in so many is held out from training.
HOLD = 4
#: Stands for a whole block where others have the number of a line.
BLOCK = -1
#: Stands for a whole block or line where sentences have their number.
WHOLE = -1
#: Where a sentence ends.
SENTENCES = r"(?<=[.!?;])\s+"

# Words of licensing (after licenc- has become licens-), and patterns that find every text that has one.
ANCHORS = (
    "license", "licenses", "licensed", "licensing", "licensor", "licensee", "sublicense", "unlicense", "copyright", "copyrighted", "copyrights", "copyleft",
    "gnu", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "agpl", "agplv3", "apache", "bsd", "mozilla", "mpl", "expat", "spdx", "commons", "cc", "cc0",
    "attribution", "noncommercial", "sharealike", "redistribute", "redistributed", "redistribution", "redistributions", "unencumbered", "waived", "domain",
    "wtfpl", "hereby", "permission", "permitted", "reserved", "reproduced", "proprietary", "confidential", "unauthorized", "merchantability", "warranty",
)
STEMS = (
    r"licen[cs]|c(?:opy(?:right|left)|ommons|onfidential)|(?<![a-z0-9])cc|g(?:nu|pl)|a(?:pache|ttribution)|bsd|m(?:ozilla|pl|erchantability)|expat|s(?:pdx|harealike)"
    r"|wtfpl|noncommercial|re(?:distribut|served|produced)|un(?:encumbered|authorized)|wa(?:ived|rranty)|domain|hereby|p(?:ermi(?:ssion|tted)|roprietary)"
)
NEGATORS = ("not", "never", "unlike", "longer", "without")

# Names of licences by family, and of licences outside the families.
NAMES: dict[str, tuple[str, ...]] = {
    "GPL": ("GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3 or later", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPLv3", "LGPL-2.1-or-later", "GNU Lesser General Public License"),
    "AGPL": ("GNU Affero General Public License, version 3", "AGPLv3", "GNU AGPL v3", "AGPL-3.0-only"),
    "Apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License"),
    "MIT": ("MIT License", "MIT License (MIT)", "MIT/X11 License", "Expat License", "MIT"),
    "BSD": ("3-clause BSD License", "BSD-3-Clause", "BSD 2-Clause License", "New BSD License", "BSD-style license", "BSD"),
    "MPL": ("Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 1.1", "MPL 2.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-3.0", "CC BY-NC-ND 4.0"),
    "CC-BY": ("CC BY 4.0", "CC BY-SA 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC-BY-3.0"),
    "Public-Domain": ("CC0 1.0 Universal", "Unlicense", "CC0", "Public Domain Dedication"),
}
OTHERS = (
    "Eclipse Public License 2.0", "EPL-2.0 license", "ISC License", "Boost Software License 1.0", "zlib License", "Artistic License 2.0", "SIL Open Font License", "European Union Public License", "Microsoft Public License",
    "PostgreSQL License", "Academic Free License", "Common Public License", "Python Software Foundation License", "Universal Permissive License", "IBM Public License", "Open Software License", "WTFPL",
)

# How notices speak of a licence, and how texts do that grant nothing.
PHRASES = (
    "{}", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This program is distributed under the terms of the {}.", "You can use this code under the {}.",
    "License: {}", "SPDX-License-Identifier: {}", "The source code is available under the {}.", "Published under {}.", "See the {} for details.", "Licensed under {}.",
)
DENIALS = ("It is not licensed under the {}.", "This is not released under the {}.", "It is no longer available under the {}.", "Unlike the {}, these terms forbid copies.", "This code may not be used under the {}.", "Never licensed under the {}.", "not under the {}", "Not licensed under the {}.", "This file is not licensed under {}.")
MENTIONS = ("The {} is popular among developers.", "We compared the {} with others.", "Many companies dislike the {}.", "The {} was written long ago.")
#: What a sentence says that puts something under the licence it names, and what takes that back.
GRANTS = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered|code|work|software|use)\s+under\b|under the terms|licen[cs]e(?:-identifier)?\s*[:=]|\b(?:see|uses?) the\b|governed by|subject to|dedicated"
DENIED = r"\b(?:not|never|unlike|longer)\b"
#: Words that a sentence without a grant may have beside the name.
BESIDE = 2

# Usual notices of the families, and sentences with words of licensing that are none.
TEMPLATES: dict[str, list[str]] = {
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY. See the GNU General Public License for more details.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is distributed in the hope that it will be useful. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "Apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the Apache License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Text is available for non-commercial use under CC BY-NC 3.0.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "Public-Domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright holder. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential; no license is granted.",
    ],
}
ORDINARY = (
    "She was granted permission to leave the building at noon.", "A driving license must be renewed every ten years.", "The committee reserved the right to change the version of the text.",
    "He released the dog into the public garden.", "They were licensed to sell food at the market.", "We were licensed to sell food at the market.", "The table was reserved for six people.",
    "Smoking is not permitted in the house of commons.", "The car comes with a warranty of two years.", "The domain of the function is the set of real numbers.", "The letter was confidential and she hid it.",
    "Permission to land was given at once.", "He lost his license after the accident.", "Parking is permitted without a ticket on Sundays.", "The apache people lived in the south west.", "I hereby declare the games open.",
    "Her fishing license was renewed in June.", "He got a pilot license after two years.", "My driving license expired last week.", "The license plate of the car was stolen.", "She is a licensed plumber.",
    "The shop has no license to sell wine.", "That is poetic license.", "You need a license to drive a truck.", "The doctor is licensed in two states.", "We reserved a room, and the permission came late.",
    "His hunting license was taken away.", "A license for fishing costs ten pounds.", "They lost the license to broadcast in May.", "Licensed guides show the way.",
)


@dataclass
class LicenceModel:
    classes: list[str]
    intercepts: list[float]
    weights: list[tuple[str, list[float]]]  # feature, a weight for each class
    temperature: float
    level: float
    templates: dict[str, list[str]]
    held_right: float  # recall: share of the held-out notices of a family that were given it before others
    held_false: float  # share of the held-out other licences, denials and mentions that were given a family
    held_precision: float  # share of right ones among the held-out paragraphs that were given a family


def words(text: Column) -> Column:
    """Words as in decontamination, with licenc- spelt licens-."""
    return F.filter(F.split(F.regexp_replace(ascii_lower(text), "licenc", "licens"), BREAKS), lambda w: w != "")


def _runs(units: DataFrame, keys: list[str], ws: Column) -> DataFrame:
    """(keys, a, b, c): each word with the two after it, null past the end. Shifted arrays, so it is linear in the text."""
    listed = units.select(*keys, ws.alias("ws"))
    n = F.greatest(F.size("ws"), F.lit(1))
    zipped = F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", F.lit(2), n).alias("b"), F.slice("ws", F.lit(3), n).alias("c"))
    return listed.select(*keys, F.explode(zipped).alias("z")).select(*keys, "z.a", "z.b", "z.c")


def grams(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, g): words of licensing, and pairs and triples that hold one, or a negation; a row for every place."""
    runs = _runs(units, keys, words(F.col(text)))

    def listed(*names: str) -> Column:
        return reduce(or_, [F.coalesce(F.col(c).isin(*ANCHORS, *NEGATORS), F.lit(False)) for c in names])

    near = runs.where(listed("a", "b", "c"))
    one = F.when(F.col("a").isin(*ANCHORS), F.col("a"))
    two = F.when(F.col("b").isNotNull() & listed("a", "b"), F.concat_ws(" ", "a", "b"))
    three = F.when(F.col("c").isNotNull(), F.concat_ws(" ", "a", "b", "c"))
    return near.select(*keys, F.explode(F.array(one, two, three)).alias("g")).where("g IS NOT NULL")


#: Names of one word.
SINGLE = tuple(n.lower() for names in NAMES.values() for n in names if n.isalnum())


def _pairs(units: DataFrame, keys: list[str], alone: bool = False) -> DataFrame:
    """(keys, g): word pairs of each text, once, and the words that are names; with alone only where no other word is there."""
    runs = _runs(units, keys, words(F.col("text")))
    named = runs.where(F.col("a").isin(*SINGLE))
    if alone:
        named = named.join(runs.groupBy(*keys).count().where("count = 1"), keys, "left_semi")
    return runs.where("b IS NOT NULL").select(*keys, F.concat_ws(" ", "a", "b").alias("g")).union(named.select(*keys, F.col("a").alias("g"))).distinct()


def _sentences(units: DataFrame) -> DataFrame:
    """UNIT, piece, text, grants and n_words of the sentences of each unit that don't deny."""
    each = units.select(*UNIT, F.posexplode(F.split("text", SENTENCES)).alias("piece", "text")).where(~F.lower("text").rlike(DENIED))
    return each.select(*UNIT, "piece", "text", F.lower("text").rlike(GRANTS).alias("grants"), F.size(words(F.col("text"))).alias("n_words"))


def speaks(text: str) -> Column:
    """Whether the text may hold a word of licensing."""
    return F.lower(text).rlike(STEMS)


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns, paragraph (block between empty lines, from 0), line (BLOCK for the whole block), sentence
    (WHOLE for a block or line) and text, for every paragraph that may hold a word of licensing. A sentence has line 0 in
    a block of one line, else BLOCK, as it may lie on several."""
    rest = [c for c in docs.columns if c != text]
    blocks = docs.select(*rest, F.posexplode(F.split(text, r"\n[ \t\r\f]*\n")).alias("paragraph", "block")).where(speaks("block"))
    unit = lambda line, sentence, x: F.struct(line.alias("line"), sentence.alias("sentence"), x.alias("text"))
    nothing = F.array().cast("array<struct<line:int,sentence:int,text:string>>")
    parts = blocks.select(*rest, "paragraph", "block", F.split("block", "\n").alias("ls"), F.split("block", SENTENCES).alias("ts"))
    whole = F.when(F.size("ls") > 1, F.array(unit(F.lit(BLOCK), F.lit(WHOLE), F.col("block"))))
    lines = F.transform("ls", lambda x, i: unit(i, F.lit(WHOLE), x))
    told = F.when(F.size("ts") > 1, F.transform("ts", lambda x, i: unit(F.lit(0), i, x)))
    units = F.concat(F.coalesce(whole, nothing), lines, F.coalesce(told, nothing))
    made = parts.select(*rest, "paragraph", (F.size("ls") > 1).alias("several"), F.explode(units).alias("u"))
    line = F.when(F.col("several") & (F.col("u.sentence") != WHOLE), BLOCK).otherwise(F.col("u.line")).alias("line")
    made = made.select(*rest, "paragraph", line, "u.sentence", "u.text")
    return made.where(speaks("text"))


def variants(notice: str) -> list[str]:
    """The notice, with words left out, and after or before other words; deterministic."""
    ws = notice.split()
    out = [notice, "Copyright 2020 by the authors. " + notice, notice + " See the file for details."]
    if len(ws) > 8:
        out += [" ".join(w for i, w in enumerate(ws) if i % 7 != k) for k in (2, 4, 6)]
        out += [" ".join(ws[: len(ws) * 2 // 3]), " ".join(ws[len(ws) // 4 :])]
    return out


def notices(templates: dict[str, list[str]]) -> list[tuple[str, str, bool]]:
    """(class, text, held out): a notice is held out with all its variants, a licence outside the families with its name."""
    out = [(c, v, k % HOLD == HOLD - 1) for c, ts in templates.items() for k, t in enumerate(ts) for v in variants(t)]
    for c, names in NAMES.items():
        for i, name in enumerate(names):
            spoken = [(c, p.format(name), (i + k) % HOLD == HOLD - 1) for k, p in enumerate(PHRASES)]
            spoken += [(UNKNOWN, p.format(name), (i + k) % HOLD == HOLD - 1) for ps in (DENIALS, MENTIONS) for k, p in enumerate(ps)]
            out += [x for x in spoken if re.search(STEMS, x[1].lower())]  # others are passed over, as documents' are
    for i, name in enumerate(OTHERS):
        out += [(UNKNOWN, p.format(name), i % HOLD == HOLD - 1) for p in (*PHRASES, *DENIALS, *MENTIONS)]
    return out + [(NONE, s, k % HOLD == HOLD - 1) for k, s in enumerate(ORDINARY)]


def fit_licences(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None) -> LicenceModel:
    """Fit on the notices and a bounded sample of ordinary paragraphs of docs: lines that don't speak of licences, of
    the ORDINARY_TEXTS different texts that hash lowest. What is held out calibrates temperature and level."""
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    made = notices(templates)
    classes = [*dict.fromkeys(c for c, *_ in made if c not in (UNKNOWN, NONE)), UNKNOWN, NONE]
    known = spark.createDataFrame([(k, classes.index(c), t, h) for k, (c, t, h) in enumerate(made)], "id long, label int, text string, held boolean")
    texts = docs.select(docs[text].alias("t")).where(F.length("t") > 0).withColumn("hash", F.xxhash64("t"))
    lowest = texts.select("hash").distinct().orderBy("hash").limit(ORDINARY_TEXTS)
    drawn = texts.join(F.broadcast(lowest), "hash").groupBy("hash").agg(F.min("t").alias("t"))
    lines = drawn.select(F.explode(F.split("t", "\n")).alias("text")).where((F.length("text") > 0) & ~F.lower("text").rlike(r"licen|copyright|rights reserved|redistribut|spdx"))
    plain = lines.select("text", F.xxhash64("text").alias("hash")).groupBy("hash").agg(F.min("text").alias("text")).orderBy("hash").limit(ORDINARY_PARAGRAPHS)
    ordinary = plain.select((F.shiftrightunsigned("hash", 1) + len(made)).alias("id"), F.lit(classes.index(NONE)).alias("label"), "text", (F.pmod("hash", F.lit(HOLD)) == HOLD - 1).alias("held"))
    rows = stored(known.union(ordinary), "licence-training")
    found = stored(grams(rows, ["id", "held", "label"]).distinct(), "licence-grams")
    weight = F.when(F.col("id") < len(made), 1.0).otherwise(ORDINARY_WEIGHT)
    listed = rows.select("id", "label", "held", weight.alias("weight")).join(found.groupBy("id").agg(F.collect_set("g").alias("grams")), "id", "left").withColumn("grams", F.coalesce("grams", F.array().cast("array<string>")))
    listed = stored(listed, "licence-listed")
    none, unknown = classes.index(NONE), classes.index(UNKNOWN)

    def fitted(seen: DataFrame, of: DataFrame):
        """A regression on the rows of `of`, over the features of licence talk in `seen`; its vectors and its vocabulary."""
        vocabulary = [r[0] for r in seen.where(F.col("label") != none).select("g").distinct().orderBy("g").collect()]
        vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "x", binary=True)
        model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=2e-4, maxIter=60, standardization=False).fit(stored(vectors.transform(of).select("label", "weight", "x"), "licence-vectors"))
        return model, vectors, vocabulary

    trial, vectors, _ = fitted(found.where("NOT held"), listed.where("NOT held"))
    held = vectors.transform(listed.where("held AND weight = 1"))
    raw = stored(trial.transform(held).select("label", vector_to_array("rawPrediction").alias("r")), "licence-held")
    loss = [F.avg(_log_sum(F.transform("r", lambda v: v / t)) - F.get("r", F.col("label")) / t).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    got = raw.agg(*loss).first()
    temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: got[f"t{k}"])]
    families = [k for k, c in enumerate(classes) if c not in (UNKNOWN, NONE)]
    scaled = F.transform("r", lambda v: v / temperature)
    best = F.array_max(F.array(*[F.struct(_against(scaled, k, unknown, none).alias("p"), F.lit(k).alias("k")) for k in families]))
    tried = raw.select("label", best["k"].alias("k"), best["p"].alias("p"))
    over = lambda c, v: F.coalesce(F.avg(F.when(c, (F.col("p") >= v).cast("double"))), F.lit(0.0))
    shares = tried.agg(*[over(F.col("label") == unknown, v).alias(f"v{k}") for k, v in enumerate(LEVELS)]).first()
    chosen = next((k for k in range(len(LEVELS)) if shares[f"v{k}"] <= FALSE_SHARE), len(LEVELS) - 1)
    of_family = ~F.col("label").isin(none, unknown)
    given, hit = F.col("p") >= LEVELS[chosen], (F.col("k") == F.col("label")).cast("double")
    right, precise = tried.agg(F.avg(F.when(of_family, hit * given.cast("double"))), F.avg(F.when(given, hit))).first()
    # Temperature and level stand; the weights are of all notices.
    model, _, vocabulary = fitted(found, listed)
    matrix = model.coefficientMatrix.toArray()
    weights = [(g, [float(v) for v in matrix[:, j]]) for j, g in enumerate(vocabulary)]
    return LicenceModel(classes, [float(b) for b in model.interceptVector], weights, temperature, LEVELS[chosen], templates, right or 0.0, shares[f"v{chosen}"], precise or 0.0)


def _log_sum(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def _against(logits: Column, family: int, *others: int) -> Column:
    """The chance of one class against the others alone, so that several families of a paragraph can be likely."""
    return 1 / reduce(lambda s, o: s + F.exp(F.get(logits, o) - F.get(logits, family)), others, F.lit(1.0))


UNIT = ["doc_id", "row", "paragraph", "line", "sentence"]


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(docs[id].cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(docs[id], docs[text]).alias("row"), docs[text].alias("text"))


def scan_paragraphs(docs: DataFrame, model: LicenceModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, paragraph, line, sentence, family, confirmed, probability, similarity) for each family that a paragraph is likely
    of (its probability against "unknown" and "none" reaches the model's level), or once for a paragraph of no such family
    that is likelier of a licence than ordinary (family unknown, not confirmed). paragraph counts blocks between empty lines, line the lines of a block (BLOCK: the block as a whole),
    sentence its sentences (WHOLE: all of it).
    row is a hash of id and text, a null id is NO_ID."""
    spark = docs.sparkSession
    units = paragraphs(_keyed(docs, id, text).where(speaks("text")))
    weights = F.broadcast(spark.createDataFrame([(g, k, w) for k, (g, w) in enumerate(model.weights)], "g string, k int, w array<double>"))
    per = grams(units, UNIT).join(weights.select("g", "k"), "g").groupBy(*UNIT).agg(F.collect_set("k").alias("ks"))
    held = per.select(*UNIT, F.explode("ks").alias("k")).join(weights.select("k", "w"), "k")
    classes = range(len(model.classes))
    sums = held.groupBy(*UNIT).agg(*[F.sum(F.get("w", c)).alias(f"s{c}") for c in classes])
    logits = F.array(*[(F.col(f"s{c}") + F.lit(model.intercepts[c])) / F.lit(model.temperature) for c in classes])
    scored = sums.select(*UNIT, logits.alias("l")).select(*UNIT, "l", _log_sum(F.col("l")).alias("z"))
    chance = lambda c: F.exp(F.get("l", c) - F.col("z"))
    unknown, none = model.classes.index(UNKNOWN), model.classes.index(NONE)
    families = [c for c in classes if c not in (unknown, none)]
    each = F.array(*[F.struct(_against(F.col("l"), c, unknown, none).alias("p"), F.get("l", c).alias("l"), F.lit(model.classes[c]).alias("family")) for c in families])
    ranked = scored.select(*UNIT, F.filter(each, lambda e: e["p"] >= model.level).alias("over"), chance(none).alias("none"), chance(unknown).alias("other"))
    unsure = F.array(F.struct(F.col("other").alias("p"), F.lit(0.0).alias("l"), F.lit(UNKNOWN).alias("family")))
    kept = ranked.where((F.size("over") > 0) | (F.col("none") < 0.5)).select(*UNIT, F.array_max(F.transform("over", lambda e: e["l"])).alias("most"), F.explode(F.when(F.size("over") > 0, F.col("over")).otherwise(unsure)).alias("e"))
    likely = stored(kept.select(*UNIT, "e.family", F.col("e.p").alias("probability"), (F.col("e.l") == F.col("most")).alias("top")), "licence-likely")

    listed = templates_of(model)
    texts = spark.createDataFrame([(c, i, t, i >= len(model.templates.get(c, ()))) for c, ts in listed.items() for i, t in enumerate(ts)], "family string, template int, text string, is_name boolean")
    pairs = _pairs(texts, ["family", "template", "is_name"], alone=True)
    sizes = texts.select("family", "template", F.size(words(F.col("text"))).alias("length")).join(pairs.groupBy("family", "template").agg(F.count("*").alias("n")), ["family", "template"])
    sized = stored(pairs.join(sizes, ["family", "template"]).withColumnRenamed("family", "of"), "licence-pairs")
    notice, name = F.broadcast(sized.where("NOT is_name")), F.broadcast(sized.where("is_name"))
    wanted = likely.where(F.col("family") != UNKNOWN).select(*UNIT, "family")
    ids = stored(wanted.select("row").distinct(), "licence-rows")
    n = ids.count()
    # The likely paragraphs once more, now with their texts; few, so they are stored.
    again = paragraphs(_keyed(docs, id, text).join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "row", "left_semi"))
    own = stored(again.join(wanted.select(*UNIT).distinct(), UNIT, "left_semi").dropDuplicates(UNIT), "licence-texts")
    share = (F.count("*") / F.first("n")).alias("s")
    whole = _pairs(own, UNIT).join(notice, "g").groupBy(*UNIT, "of", "template").agg(share).select(*UNIT, "of", "s", F.lit(0.0).alias("named"))
    said = stored(_sentences(own), "licence-sentences")
    by = [*UNIT, "piece", "grants", "n_words"]
    inside = _pairs(said, by).join(name, "g").where("grants OR n_words <= length + " + str(BESIDE)).groupBy(*by, "of", "template").agg(share).select(*UNIT, "of", "s", F.col("s").alias("named"))
    shares = whole.union(inside).groupBy(*UNIT, "of").agg(F.max("s").alias("s"), F.max("named").alias("named"))
    mine = F.col("of") == F.col("family")
    fits = wanted.join(shares, UNIT).groupBy(*UNIT, "family").agg(F.max(F.when(mine, F.col("s"))).alias("similarity"), F.max(F.when(mine, F.col("named"))).alias("named"), F.max("s").alias("nearest"))
    out = likely.join(fits, [*UNIT, "family"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    first = F.col("top") & (F.col("similarity") >= CONFIRMED) & (F.col("similarity") >= F.coalesce("nearest", F.lit(0.0)))
    stands = (F.col("family") != UNKNOWN) & F.coalesce(first | (F.col("named") >= 1.0), F.lit(False))
    return out.select(*UNIT, "family", stands.alias("confirmed"), "probability", "similarity")


def templates_of(model: LicenceModel) -> dict[str, list[str]]:
    """What predictions are compared with: the families' notices and names."""
    return {c: [*dict.fromkeys([*model.templates.get(c, ()), *NAMES.get(c, ())])] for c in model.classes if c not in (UNKNOWN, NONE)}


def licence_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, licence, families, n_paragraphs, paragraph, line, probability, similarity.

    Whole texts are read, by paragraphs (see scan_paragraphs). licence is the family of the confirmed paragraph of the
    highest probability (ties: the first paragraph, a line before the whole block, the first line, the whole before the first sentence, the last family by name); unknown where a paragraph speaks of a licence
    that no template confirms; none otherwise, null and empty texts included. families are all confirmed ones, sorted;
    n_paragraphs counts blocks with a confirmed family, once for each of its families; paragraph, line, probability and
    similarity are of the paragraph that decides, null for none. Ids may be null or repeat: rows count by id and text.
    Other columns aren't read. An empty table gives no rows.
    """
    found = scan_paragraphs(docs, fit_licences(docs, text, templates), id, text)
    first = F.max(F.struct("confirmed", "probability", (-F.col("paragraph")).alias("p"), (F.col("line") != BLOCK).alias("a_line"), (-F.col("line")).alias("l"), (-F.col("sentence")).alias("k"), "family", "similarity")).alias("b")
    sure = F.when(F.col("confirmed"), F.col("family"))
    per = found.groupBy("doc_id", "row").agg(first, F.array_sort(F.collect_set(sure)).alias("families"), F.countDistinct("paragraph", sure).alias("n_paragraphs"))
    per = stored(per, "licence-found")
    out = _keyed(docs, id, text).select("doc_id", "row").join(per, ["doc_id", "row"], "left")
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.when(F.col("b").isNull(), NONE).when(F.col("b.confirmed"), F.col("b.family")).otherwise(UNKNOWN).alias("licence"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_paragraphs", F.lit(0).cast("bigint")).alias("n_paragraphs"),
        (-F.col("b.p")).alias("paragraph"),
        (-F.col("b.l")).alias("line"),
        F.col("b.probability").alias("probability"),
        F.col("b.similarity").alias("similarity"),
    )
