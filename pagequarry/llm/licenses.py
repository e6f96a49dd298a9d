"""License scans, native: sparse TF-IDF cosine of lines to templates, then inheritance along paths.

Every line of a whole text is a vector of its terms (runs of a-z and 0-9, A-Z lowered), weighted by
count times inverse document frequency over the templates. A line belongs to the template of the
highest cosine if that is at least ``MIN_COSINE``; a file to that of its best line. A file of which
such lines make up half of the characters is a licence file and licenses its directory. A file with no
licence of its own takes that of its nearest ancestor directory, found by joining the ancestors of the
distinct directories with the licensed ones.

Whole files and their leading comments are also compared with full licence texts, and blocks (lines
joined up to a blank one) and lines with ``NOTICES``. A file of at least ``MIN_COSINE`` to a full text is a
licence file and has its licence, whatever its lines say; a leading comment of that cosine names the
licence, not the directory's. A notice counts where no line has a licence but "All rights reserved.".

Lines are cut by a bound before any is scored: terms are split so that the weights outside a template's
signature alone cannot reach the cosine, so a line without a signature term is passed over.

Null texts are empty, null paths have no directory and inherit nothing. Between equal cosines the first
template wins, and between licence files of one directory the higher cosine, then the smaller path.
Repeated rows get the same answer.
"""

from __future__ import annotations

import math
import re
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import UPPER, materialize, small

#: Licence ids and wordings of their notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Proprietary", "All rights reserved."),
)
#: Header paragraphs, titles and SPDX lines. Between equal cosines the first wins.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    *((f"{short}-{v}.0", f"This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.") for short, name, v in (("GPL", "GNU General Public License", 2), ("GPL", "GNU General Public License", 3), ("LGPL", "GNU Lesser General Public License", 3), ("AGPL", "GNU Affero General Public License", 3))),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE"),  # of no version
    *((re.sub("-(only|or-later)$", "", name), f"SPDX-License-Identifier: {name}") for name in "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-1.1 MPL-2.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()),
    ("Proprietary", "Copyright. All rights reserved."),
)
MIN_COSINE = 0.8
MAX_BROADCAST_ROWS = 200_000
TERMS = "[^a-z0-9]+"
#: Terms of ordinary prose, which a signature avoids where the bound allows it.
COMMON = frozenset("a all and any are by following for form free in is met of or person provided subject that the this to under use v with work 0 2 3 4".split())


#: Parts of words of which a file, and a unit compared with notices, must hold one: every licence text has some.
KEYS = ("licen", "copyright", "permission", "permitted", "warrant", "redistribut")
#: A line of a leading comment.
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|\"\"\"|$)"


def _weigh(texts: tuple[str, ...]) -> tuple[dict[str, float], float, tuple[dict[str, float], ...]]:
    """idf by term, idf of a term in no template, and each template's vector of length one."""
    bags = [[t for t in re.split(TERMS, text.lower()) if t] for text in texts]
    n = len(bags)
    df = {t: sum(t in b for b in bags) for b in map(set, bags) for t in b}
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    vectors = []
    for b in bags:
        v = {t: b.count(t) * idf[t] for t in b}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    return idf, math.log(1 + n) + 1, tuple(vectors)


@cache
def weights() -> tuple[dict[str, float], float, tuple[dict[str, float], ...]]:
    """What ``_weigh`` gives for ``TEMPLATES``."""
    return _weigh(tuple(text for _, text in TEMPLATES))


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Licence ids and their full texts; that of BSD-2-Clause is the other without its third clause."""
    found = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    found["BSD-2-Clause"] = re.sub(r"(?s)\n3\. Neither.*?(?=\n\n|\nTHIS SOFTWARE)", "", found["BSD-3-Clause"])
    return tuple(sorted(found.items()))


@cache
def signature_terms() -> tuple[str, ...]:
    """Terms of which a line must have one: what is left of a template has a norm below the least cosine."""
    found = set()
    for v in weights()[2]:
        rest = 0.0
        for t, x in sorted(v.items(), key=lambda p: (p[0] not in COMMON, p[1], p[0])):
            rest += x * x
            if rest >= (MIN_COSINE - 1e-9) ** 2:
                found.add(t)
    return tuple(sorted(found))


def _constant(values: list, kind: str) -> Column:
    """An array that the optimizer folds into one literal, where an array of literals is built again for each row."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def terms_of(line: Column) -> Column:
    """struct(characters, sorted terms with their vocabulary places, 0 for none) of a line with A-Z lowered."""
    vocabulary = _constant(sorted(weights()[0]), "string")
    terms = F.sort_array(F.filter(F.split(line, TERMS), lambda t: t != ""))
    return F.struct(F.length(line).alias("chars"), F.transform(terms, lambda t: F.struct(t.alias("t"), F.array_position(vocabulary, t).cast("int").alias("i"))).alias("ts"))


def measured(line: Column) -> Column:
    """What ``terms_of`` gives, with the squared norm of the line and of its terms that some template has."""
    idf, unseen, _ = weights()
    of = _constant([unseen, *(idf[t] for t in sorted(idf))], "double")
    zero = F.lit(0.0)

    def square(a: Column, x: Column) -> Column:
        # a term that occurs n times adds its weight n times to a dot product, and n**2 squares to the norm
        w, again = F.get(of, x["i"]), a["t"] == x["t"]
        run = F.when(again, a["run"]).otherwise(zero)
        more = w * w + 2 * w * run
        return F.struct(x["t"].alias("t"), (run + w).alias("run"), (a["sq"] + more).alias("sq"), (a["known"] + F.when(x["i"] > 0, more).otherwise(zero)).alias("known"))

    start = F.struct(F.lit("").alias("t"), zero.alias("run"), zero.alias("sq"), zero.alias("known"))
    return F.struct(line["chars"].alias("chars"), line["ts"].alias("ts"), F.aggregate(line["ts"], start, square, lambda a: F.struct(a["sq"].alias("all"), a["known"].alias("known"))).alias("sq"))


def line_match(line: Column) -> Column:
    """struct(cosine, -template number, characters) of the best template of what ``measured`` gives."""
    idf, _, vectors = weights()
    zero = F.lit(0.0)

    def dot(v: dict[str, float]) -> Column:
        product = _constant([0.0, *(v.get(t, 0.0) * idf[t] for t in sorted(idf))], "double")
        return F.aggregate(line["ts"], zero, lambda a, x: a + F.get(product, x["i"]))

    best = F.array_max(F.array(*[F.struct(F.round(F.try_divide(dot(v), F.sqrt(line["sq"]["all"])), 9).alias("cosine"), F.lit(-k).alias("no")) for k, v in enumerate(vectors)]))
    return F.struct(F.coalesce(best["cosine"], zero).alias("cosine"), best["no"].alias("no"), line["chars"].alias("chars"))


def keyed(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in KEYS])


def whole_matches(texts: DataFrame) -> DataFrame:
    """(_h, _full, _head, _note): the best full text of a file and of its leading comment, and its best notice.

    ``texts`` has _h and a lowered text _t. Each is struct(cosine, -number, characters), or null below ``MIN_COSINE``.
    """
    spark = texts.sparkSession
    lines = F.split("_t", "\n")
    comments = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), F.lit(False))
    head = F.array_join(F.when(comments > 0, F.slice(lines, F.lit(1), (comments - 1).cast("int"))), "\n")
    blocks = F.split(F.regexp_replace("_t", "(?m)^[^a-z0-9\n]+$", ""), "\n{2,}")
    # the holder and the years of a copyright line are no wording
    plain = lambda x: F.regexp_replace(x, "(?s)copyright(?:(?!licen).){0,200}?all rights reserved", "copyright all rights reserved")
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.length(x).alias("chars"), x.alias("x"))
    short = F.transform(F.filter(F.array_distinct(F.concat(blocks, lines)), keyed), lambda x: F.struct(F.lit(0).alias("kind"), F.length(x).alias("chars"), plain(x).alias("x")))
    large = F.filter(F.array(unit(2, F.col("_t")), unit(1, F.coalesce(head, F.lit("")))), lambda u: keyed(u["x"]))
    # texts that are the same are one
    units = texts.dropDuplicates(["_h"]).select("_h", F.posexplode(F.concat(short, large)).alias("_u", "_x"))
    terms = units.select("_h", "_u", "_x.kind", "_x.chars", F.explode(F.split("_x.x", TERMS)).alias("term")).where("term <> ''")
    terms = materialize(terms.groupBy("_h", "_u", "kind", "chars", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("full", F.col("kind") > 0))
    rows, unseen = [], []
    for full, family in enumerate((NOTICES, full_texts())):
        idf, none, vectors = _weigh(tuple(text for _, text in family))
        unseen.append(none)
        rows += [(bool(full), t, w, [(-k, v[t]) for k, v in enumerate(vectors) if t in v]) for t, w in idf.items()]
    known = F.broadcast(spark.createDataFrame(rows, "full boolean, term string, idf double, of array<struct<no int, x double>>"))
    weighed = terms.join(known, ["full", "term"], "left")
    square = F.pow(F.col("tf") * F.coalesce("idf", F.when(F.col("full"), F.lit(unseen[1])).otherwise(F.lit(unseen[0]))), 2)
    norms = weighed.groupBy("_h", "_u").agg(F.sum(square).alias("_all"), F.sum(F.when(F.col("idf").isNotNull(), square).otherwise(0.0)).alias("_known"))
    possible = materialize(norms.where((F.col("_known") >= (MIN_COSINE**2 - 1e-9) * F.col("_all")) & (F.col("_all") > 0)).select("_h", "_u", "_all"))
    dots = terms.join(small(possible, MAX_BROADCAST_ROWS), ["_h", "_u"]).join(known, ["full", "term"]).select("_h", "_u", "kind", "chars", "_all", F.col("tf") * F.col("idf"), F.explode("of").alias("o")).toDF("_h", "_u", "kind", "chars", "_all", "w", "o")
    cosines = dots.groupBy("_h", "_u", "kind", "chars", "_all", F.col("o.no").alias("no")).agg(F.sum(F.col("w") * F.col("o.x")).alias("dot")).withColumn("cosine", F.round(F.col("dot") / F.sqrt("_all"), 9)).where(F.col("cosine") >= MIN_COSINE)
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("cosine", "no", "chars")))
    return cosines.groupBy("_h").agg(best(2).alias("_full"), best(1).alias("_head"), best(0).alias("_note"))


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, path, own_license, own_score, license_file, license, license_dir of each row of ``df``."""
    src = df.select(df[id_col].alias("_id"), df[path_col].alias("_path"), F.translate(F.coalesce(df[text_col], F.lit("")), UPPER, UPPER.lower()).alias("_t"))
    hit = lambda line: reduce(lambda a, b: a | b, [line.contains(t) for t in signature_terms()])
    digest = F.when(keyed(F.col("_t")), F.sha2(F.col("_t").cast("binary"), 256))
    lines = src.select("_id", "_path", digest.alias("_h"), F.length("_t").alias("_n"), F.filter(F.split("_t", "\n"), hit).alias("_lines"))
    # a cosine is at most the share of the line's norm that lies in terms of templates
    possible = lambda m: m["sq"]["known"] >= (MIN_COSINE**2 - 1e-9) * m["sq"]["all"]
    own_terms = _constant(list(signature_terms()), "string")
    lines = lines.withColumn("_lines", F.filter("_lines", lambda x: F.arrays_overlap(F.split(x, TERMS), own_terms)))
    scored = lines.select("_id", "_path", "_h", "_n", F.filter(F.transform(F.filter(F.transform(F.transform("_lines", terms_of), measured), possible), line_match), lambda m: m["cosine"] >= MIN_COSINE).alias("_m"))
    best = F.array_max("_m")
    ids = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    own = scored.select(
        "_id",
        "_path",
        "_h",
        "_n",
        F.get(ids, -best["no"]).alias("_own"),
        best["cosine"].alias("_score"),
        (F.aggregate("_m", F.lit(0), lambda a, m: a + m["chars"]) * 2 >= F.greatest("_n", F.lit(1))).alias("_file"),
        F.when(F.col("_path").contains("/"), F.regexp_replace("_path", "/[^/]*$", "")).alias("_dir"),
    )
    own = materialize(own)
    whole = small(materialize(whole_matches(src.where(keyed(F.col("_t"))).select(digest.alias("_h"), "_t"))), MAX_BROADCAST_ROWS)
    name = lambda family, m: F.get(F.array(*[F.lit(k) for k, _ in family]), -m["no"])
    texts, note = F.coalesce("_full", "_head"), F.col("_note")
    use_text = texts.isNotNull()
    use_note = ~use_text & note.isNotNull() & (F.col("_own").isNull() | ((F.col("_own") == "Proprietary") & (name(NOTICES, note) != "Proprietary")))
    changed = own.where("_h is not null").join(whole, "_h", "left").select(
        "_id",
        "_path",
        F.when(use_text, name(full_texts(), texts)).when(use_note, name(NOTICES, note)).otherwise(F.col("_own")).alias("_own"),
        F.when(use_text, texts["cosine"]).when(use_note, note["cosine"]).otherwise(F.col("_score")).alias("_score"),
        (F.col("_file") | F.col("_full").isNotNull() | (use_note & (note["chars"] * 2 >= F.col("_n")))).alias("_file"),
        "_dir",
    )
    own = materialize(own.where("_h is null").select(changed.columns).unionByName(changed))
    first = own.where(F.col("_file") & F.col("_dir").isNotNull()).groupBy("_dir").agg(F.max("_score").alias("_top"))
    named = own.where(F.col("_file")).join(small(materialize(first), MAX_BROADCAST_ROWS), "_dir").where(F.col("_score") == F.col("_top")).groupBy("_dir").agg(F.min_by("_own", "_path").alias("_license"))
    named = materialize(named)
    parts = F.split("_dir", "/")
    dirs = own.where(F.col("_own").isNull() & F.col("_dir").isNotNull()).select("_dir").distinct()
    above = dirs.select("_dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_depth")).withColumn("_above", F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), F.col("_depth")), "/"))
    inherited = above.join(small(named, MAX_BROADCAST_ROWS).withColumnRenamed("_dir", "_above"), "_above").groupBy("_dir").agg(F.max_by("_license", "_depth").alias("_from"), F.max_by("_above", "_depth").alias("_where"))
    done = own.join(small(materialize(inherited), MAX_BROADCAST_ROWS), "_dir", "left")
    return done.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias(path_col),
        F.col("_own").alias("own_license"),
        F.coalesce("_score", F.lit(0.0)).alias("own_score"),
        F.col("_file").alias("license_file"),
        F.coalesce("_own", "_from").alias("license"),
        F.when(F.col("_own").isNull(), F.col("_where")).alias("license_dir"),
    )
