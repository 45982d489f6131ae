"""Licence scans: a trained paragraph classifier. DataFrame functions and Spark ML only.

Paragraphs (lines) become hashed word unigrams and bigrams, and a multinomial logistic regression with an L1 penalty
tells licence families from ordinary text. It is trained here on the templates below, in several disguises (with a
copyright line before, ordinary words after, in capitals, cut off), and on NEGATIVES ordinary lines of the corpus, a documented
bound. Probabilities are calibrated on wordings of the families that it was not trained on, on licences of no known family,
and on held-out ordinary lines: the temperature of the least log loss, and the threshold under which a licence counts as
unknown. A prediction stands only if a template of its family confirms it, by the share of the template's words that the
paragraph holds; otherwise it is unknown too.

Every line is classified. Where its score for no licence leads those of all families so far that they can't make up half of
the probability together, it is ordinary and has no confidence, and no probabilities are worked out.

A notice may be wrapped: windows of neighbouring lines between blank lines are classified too where they hold CONFIRM of a
template's words. A window's family counts if it is known and no line of it holds that share alone; its block of lines
is then one licence more. Paragraphs and unknown ones are counted by line.

Cases: null or empty text, or lines without words, have no paragraphs, the family none and no families (the empty string); a
very long text is one row of lines; rows that share an id are one document, whose paragraphs all count; ties between families
go to the first in alphabetical order; an empty table gives an empty table (the classifier then learns from templates
alone); extra columns are not read.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEGATIVES, FEATURES, CONFIRM = 2_000, 1 << 13, 0.6

#: Notices as the licences' authors word them.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "You should have received a copy of the GNU Affero General Public License along with this program", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "See the License for the specific language governing permissions and limitations under the License"],
    "artistic-2.0": ["Licensed under the Artistic License 2.0", "This package is free software; you may redistribute and modify it under the terms of the Artistic License 2.0", "You are permitted to use the Standard Version and create and use Modified Versions for any purpose without restriction, provided that you do not Distribute the Modified Version"],
    "bsd-2-clause": ["Licensed under the BSD 2-Clause License", "Released under the Simplified BSD License", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Released under the BSD License", "Licensed under the BSD 3-Clause License"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "licensed under the Creative Commons Attribution License", "You must give appropriate credit, provide a link to the license, and indicate if changes were made"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "for noncommercial use only under CC BY NC", "You may not use the material for commercial purposes under Creative Commons NonCommercial"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "If you remix, transform, or build upon the material, you may not distribute the modified material"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "available under the Creative Commons Attribution-ShareAlike License", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"],
    "cc0-1.0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "epl-2.0": ["Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "gpl-2.0": ["Licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "You should have received a copy of the GNU General Public License along with this program", "Released under the GPL version 3"],
    "isc": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "lgpl-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "Licensed under the MIT License"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "The fonts, including any derivative works, can be bundled, embedded, redistributed and/or sold with any software provided that any reserved names are not used by derivative works"],
    "proprietary": ["All rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher", "Unauthorized copying of this file is strictly prohibited", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "wtfpl": ["Licensed under the WTFPL, version 2", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "zlib": ["Licensed under the zlib License", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"],
}
#: Other wordings of the families, which calibrate and train nothing.
HELD_OUT: dict[str, list[str]] = {
    "agpl-3.0": ["The server is free software under version 3 of the GNU Affero General Public License"],
    "apache-2.0": ["The code is available under the Apache License, Version 2.0", "Licensed to the Foundation under the Apache License, Version 2.0"],
    "bsd-3-clause": ["The sources are distributed under the BSD 3-Clause License"],
    "cc-by-4.0": ["The text is available under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Photographs are licensed under CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply"],
    "cc0-1.0": ["The data set is released under CC0 1.0 Universal, a dedication to the public domain"],
    "epl-2.0": ["The plugin is licensed under the Eclipse Public License 2.0"],
    "gpl-2.0": ["The driver is licensed under the GNU General Public License, version 2 only"],
    "gpl-3.0": ["The package is licensed under the GNU General Public License, version 3 or later"],
    "isc": ["The module is licensed under the ISC License"],
    "lgpl-2.1": ["The library is licensed under the GNU Lesser General Public License, version 2.1"],
    "mit": ["The project is released under the MIT License", "Use of this source code is governed by the MIT License"],
    "mpl-2.0": ["The contents of this file are subject to the Mozilla Public License, version 2.0"],
    "proprietary": ["Copyright 2021 the company. All rights reserved", "Unauthorized copying of this file, in whole or in part, is strictly prohibited"],
    "zlib": ["The compression code is licensed under the zlib License"],
}
#: Licence talk of no family above, for the calibration of unknown.
OTHER_LICENCES = ["Use of this material is governed by the terms of the customer licence agreement", "Distributed under the terms of the Example Community License", "licensed to the subscriber under a separate written contract", "This data is released under an open licence of the city council", "Permission to use is granted under the terms of the vendor agreement", "Released under the Museum Image License, second edition", "Contains public sector information licensed under the Open Government Licence", "Made available under the Open Database License", "Licensed under the Academic Free License", "Usage is subject to the terms of service of the provider", "This model is released under a responsible use licence", "Licensed for evaluation purposes only under the trial agreement"]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def grams(w: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def _own(template: str) -> list[str]:
    return sorted({x for x in "".join(c if c.isalnum() else " " for c in template.lower()).split()})


def needed(template: str) -> int:
    """How many of a template's distinct words make CONFIRM of them."""
    own = len(_own(template))
    return next(k for k in range(own + 1) if k / own >= CONFIRM)


def required_words(ordinary: DataFrame) -> list[str]:
    """Words of which a text that confirms any template holds one at least: of each template all but needed() - 1 words, those that the ordinary lines hold least."""
    every = sorted({w for ts in TEMPLATES.values() for t in ts for w in _own(t)})
    seen = {r["w"]: r["count"] for r in ordinary.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(every)))).alias("w")).groupBy("w").count().collect()}
    return sorted({w for ts in TEMPLATES.values() for t in ts for w in sorted(_own(t), key=lambda w: (seen.get(w, 0), w))[: len(_own(t)) - needed(t) + 1]})


def windows(docs: DataFrame, text_col: str, id_col: str, required: list[str] | None = None) -> DataFrame:
    """(doc_id, block, lines, words) of windows of 2 or more lines between blank lines that may hold a wrapped notice.

    Windows have 2 to 8, 16 or 32 lines, or all of their block. A window that holds CONFIRM of a template's words lies in a
    block that does, so other blocks are dropped first, and before them those without any of the required words.
    """
    known = sorted({w for ts in TEMPLATES.values() for t in ts for w in _own(t)})
    least = min(len(_own(t)) for ts in TEMPLATES.values() for t in ts) * CONFIRM

    def holding(rows: DataFrame) -> DataFrame:
        # exists() names the words in common, so that they are found once a row.
        held = lambda w: template_share(w) >= CONFIRM
        common = F.array_distinct(F.filter("words", lambda w: w.isin(known)))
        return rows.withColumn("_common", common).filter(F.size("_common") >= least).filter(F.exists(F.array("_common"), held)).drop("_common")

    cut = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n\\s*\n", -1)).alias("block", "part"))
    wide = cut.filter(F.trim("part").contains("\n")).withColumn("words", words(F.col("part")))
    blocks = holding(wide if required is None else wide.filter(F.exists("words", lambda w: w.isin(required))))
    lines = F.filter(F.transform(F.split("part", "\n", -1), words), lambda w: F.size(w) > 0)
    many = blocks.select("doc_id", "block", lines.alias("_lines")).filter(F.size("_lines") > 1)
    sizes = F.array_distinct(F.filter(F.concat(F.array(*map(F.lit, [2, 3, 4, 5, 6, 7, 8, 16, 32])), F.array(F.size("_lines"))), lambda n: n <= F.size("_lines")))
    # Each window is cut from its block's lines inside one expression; the lines themselves go with none of them.
    every = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size("_lines") - n + 1), lambda at: F.slice("_lines", at, n))))
    cuts = many.select("doc_id", "block", F.explode(every).alias("lines"))
    return holding(cuts.withColumn("words", F.flatten("lines")))


def _classes() -> list[str]:
    return ["none", *sorted(TEMPLATES)]


def template_share(w: Column, family: Column | None = None) -> Column:
    """The largest share of a template's distinct words that the paragraph holds; family: of its templates alone."""
    # One literal and one lambda for all templates: code made for each of them would fill the driver's memory.
    known = F.array(*[F.struct(F.lit(name).alias("family"), F.array(*map(F.lit, _own(t))).alias("words")) for name, ts in TEMPLATES.items() for t in ts])
    asked = known if family is None else F.filter(known, lambda t: t["family"] == family)
    return F.coalesce(F.array_max(F.transform(asked, lambda t: F.size(F.array_intersect(t["words"], w)) / F.size(t["words"]))), F.lit(0.0))


def _ordinary(docs: DataFrame, text_col: str) -> DataFrame:
    """(words, part): ordinary lines in the order of a hash of their content, a bounded sample."""
    lines = docs.select(F.explode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("line")).filter(F.length("line") > 0)
    # Distinct, so that a frequent line is one of them; only hashes low enough for four times the sample are shuffled.
    kinds = lines.agg(F.approx_count_distinct("line")).first()[0]
    if kinds > 8 * NEGATIVES:
        lines = lines.filter(F.xxhash64("line") < int(-(1 << 63) + (1 << 64) * 4 * NEGATIVES / kinds))
    lines = lines.distinct()
    sample = lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).select(words(F.col("line")).alias("words")).filter(F.size("words") > 0)
    return sample.filter(template_share(F.col("words")) < CONFIRM).select("words", F.pmod(F.xxhash64("words"), F.lit(5)).cast("int").alias("part"))


def _examples(ordinary: DataFrame) -> DataFrame:
    """(words, label, part): label -1 for licences of no family; part 0 to 3 train, 4 calibrates."""
    spark = ordinary.sparkSession
    classes = _classes()
    rows = [(t, classes.index(f), 0) for f, ts in TEMPLATES.items() for t in ts]
    rows += [(t, classes.index(f), 4) for f, ts in HELD_OUT.items() for t in ts] + [(t, -1, 4) for t in OTHER_LICENCES]
    notices = spark.createDataFrame(rows, "line string, label int, held int").coalesce(1)
    around = spark.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("k"))
    filler = F.expr("transform(sequence(1, 1 + k % 7), j -> concat('w', cast(pmod(xxhash64(k, j, line), 5000) as string)))")
    w = words(F.col("line"))
    # A long notice may be cut off.
    whole = w
    w = F.when((F.col("k") % 3 == 2) & (F.size(whole) > 12), F.slice(whole, 1, F.ceil(F.size(whole) * 0.7).cast("int"))).otherwise(whole)
    disguised = F.when(F.col("k") % 4 == 0, w).when(F.col("k") % 4 == 1, F.concat(F.array(*map(F.lit, ["copyright", "c", "2020"])), w)).when(F.col("k") % 4 == 2, F.concat(w, filler)).otherwise(F.concat(filler, w, filler))
    licences = notices.crossJoin(F.broadcast(around)).select(disguised.alias("words"), "label", F.col("held").alias("part"))
    return licences.unionByName(ordinary.select("words", F.lit(0).alias("label"), "part"))


class LicenceModel:
    def __init__(self, regression: LogisticRegressionModel, temperature: float, threshold: float, required: list[str]):
        self.regression, self.temperature, self.threshold, self.required = regression, temperature, threshold, required

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows, which have words, with raw: a score for each class."""
        tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features")
        made = self.regression.transform(tf.transform(rows.withColumn("_grams", grams(F.col("words")))))
        return made.withColumn("raw", vector_to_array("_raw")).drop("_grams", "features", "_raw")

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """rows, which have words, with p: a probability for each class; null where no licence is sure to have less than half."""
        ordinary = lambda raw: raw[0] - F.array_max(F.slice(raw, 2, len(TEMPLATES))) > self.temperature * log(len(TEMPLATES))
        p = F.transform(F.array("raw"), lambda raw: F.when(~ordinary(raw), softmax(raw, self.temperature)))[0]
        return self.scores(rows).withColumn("p", p).drop("raw")


def softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    e = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.element_at(F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b))), 1)


def train(docs: DataFrame, text_col: str = "text") -> LicenceModel:
    ordinary = _ordinary(docs, text_col).cache()
    examples = _examples(ordinary).cache()
    tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features")
    known = examples.filter("label >= 0 and part <> 4").withColumn("_grams", grams(F.col("words")))
    lr = LogisticRegression(featuresCol="features", labelCol="label", rawPredictionCol="_raw", probabilityCol="", predictionCol="", family="multinomial", regParam=3e-4, elasticNetParam=0.8, maxIter=40, standardization=False)
    model = LicenceModel(lr.fit(tf.transform(known).select("features", F.col("label").cast("double").alias("label"))), 1.0, 0.5, required_words(ordinary))
    held = model.scores(examples.filter("part = 4").select("words", "label"))
    temperatures, thresholds = [round(0.3 + 0.1 * i, 1) for i in range(28)], [round(0.2 + 0.05 * i, 2) for i in range(16)]
    # One pass over the held-out rows for all temperatures, and one for all thresholds.
    loss = lambda t: F.avg(F.when(F.col("label") >= 0, -F.log(F.try_element_at(softmax(F.col("raw"), t), F.col("label") + 1) + 1e-12)))
    losses = held.agg(*[loss(t).alias(str(i)) for i, t in enumerate(temperatures)]).first()
    model.temperature = min(zip([x if x is not None else 0.0 for x in losses], temperatures, strict=True))[1]
    # The threshold that tells known families from unknown licences best.
    best = F.array_max(F.slice(softmax(F.col("raw"), model.temperature), 2, len(TEMPLATES)))
    right = held.filter("label <> 0").withColumn("best", best)
    shares = right.agg(*[F.avg(F.when(F.col("label") > 0, (F.col("best") >= t).cast("double"))) + F.avg(F.when(F.col("label") < 0, (F.col("best") < t).cast("double"))) for t in thresholds]).first()
    model.threshold = max(zip([c or 0.0 for c in shares], [-t for t in thresholds], strict=True))[1] * -1
    examples.unpersist()
    ordinary.unpersist()
    return model


def classify(rows: DataFrame, model: LicenceModel) -> DataFrame:
    """rows, which have words, with family (a family, unknown or none), confidence (null where it is sure to be none) and share (of the template's words)."""
    names = F.array(*map(F.lit, _classes()))
    p = model.probabilities(rows)
    best = F.array_max(F.slice("p", 2, len(TEMPLATES)))
    named = p.withColumn("confidence", best).withColumn("_family", F.element_at(names, F.array_position(F.col("p"), best).cast("int")))
    licence = F.coalesce(F.element_at("p", 1) < 0.5, F.lit(False))
    named = named.withColumn("share", F.when(licence, template_share(F.col("words"), F.col("_family"))))
    family = F.when(~licence, F.lit("none")).when((F.col("confidence") < model.threshold) | (F.col("share") < CONFIRM), F.lit("unknown")).otherwise(F.col("_family"))
    return named.withColumn("family", family).drop("p", "_family")


def scan_documents(docs: DataFrame, model: LicenceModel | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_paragraphs, n_licence, n_unknown, families, family, confidence) of every document; family: that of its surest paragraph."""
    model = model or train(docs, text_col)
    lines = F.filter(F.transform(F.split(F.col(f"`{text_col}`"), "\n", -1), words), lambda w: F.size(w) > 0)
    cut = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(lines, F.array().cast("array<array<string>>")).alias("_lines"))
    # A document's number of lines goes with its first line, or stands alone.
    each = cut.select("doc_id", F.size("_lines").alias("n"), F.posexplode_outer("_lines").alias("_at", "words"))
    plain = each.filter("words is null").select("doc_id", F.col("n").alias("lines"), F.lit("none").alias("family"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("block"))
    told = classify(each.filter("words is not null"), model).select("doc_id", F.when(F.col("_at") == 0, F.col("n")).otherwise(0).alias("lines"), "family", "confidence", F.lit(None).cast("int").alias("block"))
    # explode() keeps the filters behind the classifier, which would run again in each of them.
    wrapped = classify(windows(docs, text_col, id_col, model.required), model).select(F.explode(F.array(F.struct("doc_id", "block", "lines", "family", "confidence"))).alias("_w")).select("_w.*")
    wrapped = wrapped.filter(~F.col("family").isin("none", "unknown"))
    wrapped = wrapped.filter(~F.exists("lines", lambda w: template_share(w, F.col("family")) >= CONFIRM))
    wrapped = wrapped.groupBy("doc_id", "block", "family").agg(F.max("confidence").alias("confidence")).withColumn("lines", F.lit(0))
    found = plain.unionByName(told).unionByName(wrapped)
    known = ~F.col("family").isin("none", "unknown")
    rank = F.when(known, F.struct(F.lit(2).alias("kind"), "confidence", "family")).when(F.col("family") == "unknown", F.struct(F.lit(1).alias("kind"), "confidence", "family"))
    out = found.groupBy("doc_id").agg(F.sum("lines").alias("n_paragraphs"), F.count_if(F.col("family") != "none").alias("n_licence"), F.count_if(F.col("family") == "unknown").alias("n_unknown"), F.array_sort(F.collect_set(F.when(known, F.col("family")))).alias("families"), F.max(rank).alias("_top"))
    return out.select("doc_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"), "n_licence", "n_unknown", F.array_join("families", ",").alias("families"), F.coalesce("_top.family", F.lit("none")).alias("family"), F.coalesce("_top.confidence", F.lit(0.0)).alias("confidence"))
