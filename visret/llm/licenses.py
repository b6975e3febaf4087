"""License scan by diagonal voting.

All rolling word k-grams of a document are looked up among the k-grams of the templates; Spark
joins what is found to the template positions, and each match votes for its diagonal (document
position minus template position). Votes are summed by diagonal; each diagonal is merged with those
within ``BAND`` of it (words put in or left out). A merged diagonal is verified by the share of the
template's words that its k-grams cover; its span in the document can be no longer than the
template and twice the band. k is 3, or the template's length if shorter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import ALNUM, starts_of, texts
from visret.llm.decontam import keys_of

K, BAND, COVER = 3, 4, 0.8

# Phrases whose every place counts, with their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Notices and whole licenses as they are worded, lower-cased and without marks.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
     "the software or the use or other dealings in the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
     "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
     "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not "
     "limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort "
     "including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd-2-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
     "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable "
     "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising "
     "out of or in connection with the use or performance of this software", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
     "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
     "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
     "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution", "zlib"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
     "see the license for the specific language governing permissions and limitations under the license", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or "
     "at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
     "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program", "gpl-3.0"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
     "for any purpose commercial or non commercial and by any means", "unlicense"),
)

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("pos", T.LongType()), T.StructField("gram", T.LongType())]))),
])


def numbered(base, notices):
    """Word numbers, and (template, label, is base, length, k, place, k-gram) of each place."""
    vocab: dict[str, int] = {}
    rows = []
    for t, (phrase, label, exact) in enumerate([(*x, True) for x in base] + [(*x, False) for x in notices]):
        ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in phrase.split()], np.int64)
        k = min(K, len(ids))
        rows += [(t, label, exact, len(ids), k, i, int(g)) for i, g in enumerate(keys_of(ids, k))]
    return {w.encode(): n for w, n in vocab.items()}, rows


def scan(docs: DataFrame, *, text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """``doc_id``, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted),
    spans (label, first and last document word and coverage of each verified notice) and score.

    One row per row of ``docs``, also where rows or ids repeat or are null; null and empty texts
    have no words and score 0. The score is the largest share of a template that is covered. A span's
    first and last word are those of its best diagonal, so they are off by BAND words at most.
    """
    spark = docs.sparkSession
    vocab, rows = numbered(base, notices)
    sizes = sorted({r[4] for r in rows})
    wanted = {k: np.unique([r[6] for r in rows if r[4] == k]) for k in sizes}

    @F.arrow_udf(HITS)
    def find(array: pa.Array) -> pa.Array:
        flat, counts, get = [], [], vocab.get
        for one in texts(array):
            words = one.translate(ALNUM).split()
            counts.append(len(words))
            flat.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            flat.append(np.zeros(1, np.int64))  # no k-gram reaches into the next text
        begins = starts_of(np.array(counts, np.int64) + 1)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        pos, gram = [], []
        for k in sizes:
            key = keys_of(ids, k)
            at = np.flatnonzero(key)
            at = at[np.isin(key[at], wanted[k])]
            pos.append(at)
            gram.append(key[at])
        pos, gram = np.concatenate(pos), np.concatenate(gram)
        order = np.argsort(pos, kind="stable")
        pos, gram = pos[order], gram[order]
        doc = np.searchsorted(begins, pos, side="right") - 1
        per = starts_of(np.bincount(doc, minlength=len(counts)))
        hits = pa.StructArray.from_arrays([pa.array(pos - begins[doc]), pa.array(gram)], ["pos", "gram"])
        return pa.StructArray.from_arrays(
            [pa.array(np.array(counts, np.int64)), pa.ListArray.from_arrays(pa.array(per, pa.int32()), hits)],
            ["n_words", "hits"])

    templates = spark.createDataFrame(rows, "template int, label string, exact boolean, size int, k int, place int, gram long")
    found = (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", find.asNondeterministic()(F.col(text)).alias("f"))
             .select("row", "doc_id", "f.n_words", F.explode_outer("f.hits").alias("h"))
             .select("row", "doc_id", "n_words", "h.pos", "h.gram")
             .repartition("row"))  # the one exchange; all that follows is grouped by row and more
    votes = (found.join(F.broadcast(templates), "gram", "left")
             .groupBy("row", "doc_id", "n_words", "template", "label", "exact", "size", "k", (F.col("pos") - F.col("place")).alias("diagonal"))
             .agg(F.count("gram").alias("votes"), F.collect_set("place").alias("places")))
    w = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-BAND, BAND)
    near = votes.withColumn("near", F.array_distinct(F.flatten(F.collect_list("places").over(w))))
    words = F.array_distinct(F.flatten(F.transform("near", lambda p: F.sequence(p, p + F.col("k") - 1))))
    near = near.withColumn("cover", F.coalesce(F.size(words) / F.col("size"), F.lit(0.0)))
    # Of diagonals that are merged with one another the best stands for all.
    best = F.max(F.struct("cover", "votes", -F.col("diagonal"))).over(w) == F.struct("cover", "votes", -F.col("diagonal"))
    full = F.col("exact") & (F.col("votes") == F.col("size") - F.col("k") + 1)
    good = ~F.col("exact") & (F.col("cover") >= COVER)
    span = F.struct("label", (F.col("diagonal") + F.array_min("near")).alias("first"),
                    (F.col("diagonal") + F.array_max("near") + F.col("k") - 1).alias("last"), "cover")
    return (near.withColumn("best", best).groupBy("row", "doc_id", "n_words")
            .agg(F.count_if(full).alias("n_base"),
                 F.min(F.when(full, F.col("diagonal"))).alias("first_word"),
                 F.max(F.when(full, F.col("diagonal"))).alias("last_word"),
                 F.array_sort(F.collect_set(F.when(full, F.col("label")))).alias("base_labels"),
                 F.array_sort(F.collect_set(F.when(full | good, F.col("label")))).alias("labels"),
                 F.array_sort(F.collect_list(F.when(good & F.col("best"), span))).alias("spans"),
                 F.max("cover").alias("score"))
            .drop("row"))


def digest(docs: DataFrame, **options) -> DataFrame:
    joined = lambda c: F.concat_ws(",", c).alias(c)
    return scan(docs, **options).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")
