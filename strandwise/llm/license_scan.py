"""License scans by diagonal voting: rolling word k-grams of texts meet template positions in a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import ascii_lower, table

#: Phrases that count wherever their words stand consecutively.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Opening sentences of well-known notices, found also when some words differ.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]
#: Whole texts of short licenses and notices, found also when some words differ or are missing.
LICENSES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
        "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and "
        "on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of "
        "such damage",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "gpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
        "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be "
        "misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
]
#: Separators of words: every ASCII character but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The gram that stands for the document itself; it matches the template row of kind "doc".
SELF = -7046029254386353131


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def template_grams(spark: SparkSession, phrases, notices, k_phrase: int, k_notice: int) -> DataFrame:
    """One row for each template position: (t, kind, label, grams, k, tpos, gram, gram_text)."""
    rows = [(-1, "doc", "", 1, 0, -1, "")]
    for t, (kind, k, text, label) in enumerate([("phrase", k_phrase, *x) for x in phrases] + [("notice", k_notice, *x) for x in notices]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"template of fewer than {k} words: {text}")
        rows += [(t, kind, label, len(words) - k + 1, k, p, " ".join(words[p : p + k])) for p in range(len(words) - k + 1)]
    values = ", ".join(f"({t}, '{kind}', '{label}', {n}, {k}, {p}, '{g}')" for t, kind, label, n, k, p, g in rows)
    flat = spark.sql(f"SELECT * FROM VALUES {values} AS x(t, kind, label, grams, k, tpos, gram_text)")
    words = F.split("gram_text", " ")
    by_k = [F.when((F.col("kind") != "doc") & (F.col("k") == k), F.xxhash64(F.lit(k), *(F.get(words, F.lit(j)) for j in range(k)))) for k in sorted({k_phrase, k_notice})]
    return flat.withColumn("gram", F.coalesce(*by_k, F.lit(SELF)))


def scan(docs: DataFrame, key: list[str], text: str = "text", phrases=PHRASES, notices=NOTICES, licenses=LICENSES, k_phrase: int = 2, k_notice: int = 4, shift: int = 3, coverage: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Spans of license templates in every whole text: (spans, documents).

    spans: key, t, label, kind, first (start word), last, score. documents: key, copies, n_words, and
    spans as an array of structs. Every k-gram of a text is joined to the template positions with the
    same hash; the words themselves confirm the match. Votes are counted by the diagonal (word
    position less template position). A phrase stands where a diagonal holds all its grams. Votes for
    a notice on diagonals at most `shift` apart merge; the span counts if the merged votes cover
    `coverage` of the template's grams.

    The templates are Python lists, so their broadcast is bounded by construction. Null text is
    empty: no span, no words. Rows equal in key and text are one document with copies > 1.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, phrases, [*notices, *licenses], k_phrase, k_notice)
    # the hashes of the templates' own grams, as many as their words: only where one of them stands are a text's words put together
    known = ", ".join(f"{r['gram']}L" for r in grams.where("kind <> 'doc'").select("gram").distinct().collect()) or "null"

    def rolled(k: int) -> str:
        """All k-grams of _w as (pos, kk, g, gram words where g is a template's)."""
        hashed = ", ".join(f"_w[i + {j}]" for j in range(k))
        every = f"transform(sequence(0, size(_w) - {k}), i -> struct(i AS pos, xxhash64({k}, {hashed}) AS g))"
        shown = f"transform({every}, x -> struct(x.pos AS pos, {k} AS kk, x.g AS g, if(x.g IN ({known}), array_join(slice(_w, x.pos + 1, {k}), ' '), cast(null AS string)) AS said, cast(null AS bigint) AS n))"
        return f"if(size(_w) >= {k}, {shown}, array())"

    whole_text = f"array(struct(-1 AS pos, 0 AS kk, {SELF}L AS g, cast(null AS string) AS said, cast(size(_w) AS bigint) AS n))"
    all_grams = F.expr(f"concat({', '.join([whole_text, rolled(k_phrase), rolled(k_notice)])})")
    cut = docs.select(*key, F.xxhash64(text).alias("_x"), words_of(F.col(text)).alias("_w"))
    each = cut.select(*key, "_x", F.explode(all_grams).alias("_g")).select(*key, "_x", "_g.pos", F.col("_g.kk").alias("kk"), F.col("_g.g").alias("gram"), "_g.said", "_g.n")
    met = each.join(F.broadcast(grams), "gram").where((F.col("kind") == "doc") | ((F.col("kk") == F.col("k")) & (F.col("said") == F.col("gram_text"))))
    hit = met.select(*key, "_x", "t", "kind", "label", "grams", "k", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"), F.when(F.col("kind") == "doc", F.col("n")).alias("n_words"))
    by = [*key, "_x"]
    votes = hit.groupBy(*by, "t", "kind", "label", "grams", "k", "diagonal").agg(F.collect_set("tpos").alias("tposs"), F.max("n_words").alias("n_words"), F.when(F.first("kind") == "doc", F.count("*")).alias("copies"))

    order = W.partitionBy(*by, "t").orderBy("diagonal")
    joined = (F.col("kind") == "notice") & (F.col("diagonal") - F.lag("diagonal").over(order) <= shift)
    votes = votes.withColumn("_new", F.when(joined, 0).otherwise(1))
    votes = votes.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = votes.groupBy(*by, "t", "kind", "label", "grams", "_run").agg(
        F.min(F.col("diagonal") + F.array_min("tposs")).cast("long").alias("first"), F.max(F.col("diagonal") + F.array_max("tposs") + F.col("k") - 1).cast("long").alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("tposs")))) / F.col("grams")).alias("score"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies"),
    )
    found = found.where((F.col("kind") == "doc") | (F.col("score") >= F.when(F.col("kind") == "phrase", 1.0).otherwise(coverage)))
    spans = found.where("kind <> 'doc'").select(*key, "t", "label", "kind", "first", "last", "score")
    span = F.when(F.col("kind") != "doc", F.struct("kind", "label", "first", "last", "score"))
    whole = found.groupBy(*by).agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.collect_list(span).alias("spans"))
    return spans, whole.drop("_x")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of documents.

    Null, empty and wordless texts have no words, no labels and score 0. Very long texts are scanned
    whole. Repeated rows and null doc_ids are rows of their own. An empty table gives no rows. Other
    columns aren't read.
    """
    _, docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    base = F.expr("filter(spans, s -> s.kind = 'phrase')")
    labels = lambda x: F.array_join(F.sort_array(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    firsts = F.transform(F.col("_b"), lambda s: s["first"])
    out = docs.withColumn("_b", base).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "doc_id", "n_words", F.size("_b").cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels(F.col("_b")).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
