"""License scans by a positional rare-token index, in DataFrame functions only.

Words are lower-cased runs of ASCII digits and letters and of all other non-ASCII characters. Base
labels are places of three phrases. The method's labels come from licence templates (names, notices and
passages of whole texts). The index holds, of each template, the places of the two highest-IDF words of
the key phrase whose second-rarest word is the rarest (IDF counted over all rows). All words of a file that
stand in the index are looked up; a template is a candidate where both of its words agree on one
position relative to it (postings sorted by template and offset), and holds where the file has all of
its mandatory key phrases. Wherever a key phrase stands both of its words do, so no template is lost, however
many stand in one file. Null and empty texts have no words, score 0 and empty label strings.
Repeated phrases count at each place; other columns of the input are not read.

The score is the largest share of a verified template's words that stand in place, taken where its
indexed key phrase may stand, 0.5 at least
where a base phrase stands, else 0. Nothing is shuffled but the word counts of the templates'
vocabulary, whose size is fixed by the templates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import only

#: Base phrases by label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Fixed values: (label, template, mandatory key phrases within the template).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("agpl-3.0", "gnu affero general public license version 3", ("affero general public license version 3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("copy modify and or distribute this software",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("mit-notice", "released under the mit license", ("released under the mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("granted free of charge to any person obtaining a copy",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    (
        "apache-2.0-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind"),
    ),
    (
        "bsd-3-clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce", "endorse or promote products derived from this software"),
    ),
    (
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("redistribute it and or modify it under the terms of the gnu general public license", "as published by the free software foundation", "in the hope that it will be useful"),
    ),
    (
        "mit-full",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("without restriction including without limitation", "sublicense and or sell copies of the software", "shall be included in all copies or substantial portions"),
    ),
    (
        "mpl-2.0-header",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        ("source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"),
    ),
    (
        "agpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at "
        "your option any later version",
        ("modify it under the terms of the gnu affero general public license", "as published by the free software foundation"),
    ),
    (
        "lgpl-header",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at "
        "your option any later version",
        ("modify it under the terms of the gnu lesser general public license", "as published by the free software foundation"),
    ),
    (
        "bsd-disclaimer",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        ("any express or implied warranties", "are disclaimed", "special exemplary or consequential damages"),
    ),
    (
        "isc-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the "
        "software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies", "the author disclaims all warranties with regard to this software"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim "
        "that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        ("will the authors be held liable for any damages", "the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
    ),
    (
        "unlicense-full",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
        ("unencumbered software released into the public domain", "either in source code form or as a compiled binary", "commercial or non commercial and by any means"),
    ),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain by waiving all",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("under the terms of the eclipse public license 2 0",)),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", ("licensed under the eupl", "subsequent versions of the eupl")),
)
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Words in order. Lower-casing other than A-Z too joins or cuts no word and makes none of the
    ASCII words that templates and phrases consist of."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def vocabulary() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def frequencies(worded: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template word over all rows of worded (words)."""
    seen = worded.select(F.explode_outer(F.concat(F.array(F.lit("")), F.array_intersect("words", _array(vocabulary())))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in seen.collect()}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in vocabulary()}


def rare_index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position), words by falling IDF: of each template, the two rarest words of the key
    phrase whose second-rarest word is the rarest, at each of their places in this phrase."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, template, keys) in enumerate(TEMPLATES):
        phrases = [key.split() for key in keys]
        pairs = [sorted(set(p), key=lambda w: (-idf[w], p.index(w)))[:2] for p in phrases]  # noqa: B023
        n = max(range(len(phrases)), key=lambda i: (idf[pairs[i][1]], -i))
        start = len(f" {template} "[: f" {template} ".index(f" {keys[n]} ")].split())
        for i, w in enumerate(phrases[n]):
            if w in pairs[n]:
                out.setdefault(w, []).append((k, start + i))
    return dict(sorted(out.items(), key=lambda x: (-idf[x[0]], x[0])))


def _places(words: Column, word: str) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())


def _stands(words: Column, phrase: list[str], at: Column) -> Column:
    """Whether a phrase's words stand at a place; places below 0 have no words."""
    out = at >= 0
    for k, w in enumerate(phrase):
        out = out & F.coalesce(F.get(words, F.greatest(at + k, F.lit(0))) == w, F.lit(False))
    return out


def base_places(words: Column) -> Column:
    """array<struct<start,label>> of the base phrases, from the places of their last word."""

    def of(label: str, phrase: list[str]) -> Column:
        back = len(phrase) - 1
        here = F.filter("license_at", lambda i: _stands(words, phrase, i - back))
        return F.transform(here, lambda i: F.struct((i - back).cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[of(label, phrase.split()) for label, phrase in PHRASES.items()])


def _postings(index: dict[str, list[tuple[int, int]]]) -> Column:
    posts = [x for w, of in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in of]))]
    return F.create_map(*posts)


# The steps below are columns of their own, each read twice at least by the next, so that Spark works
# them out once a file and not once an element.
def postings_of(words: Column, top: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """array<struct<t,o>> sorted: template and offset of each place of a file's indexed words (top)."""
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(top, w), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    return F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(_postings(index), h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("o"))))))


def agreed_offsets(posts: Column) -> Column:
    """The template and offset pairs that stand twice at least in sorted postings."""
    return F.array_distinct(F.filter(posts, lambda c, i: F.coalesce(F.get(posts, F.greatest(i - 1, F.lit(0))) == c, F.lit(False)) & (i > 0)))


def verified(words: Column, agreed: Column, flat: Column) -> Column:
    """array<struct<label,share>>: the templates of agreed offsets all of whose key phrases stand in flat,
    the words of a file with blanks around each."""
    labels, templates, keys = zip(*TEMPLATES)
    of = lambda values, t: F.get(_array(values), t)

    def holds(c: Column) -> Column:
        out = F.lit(False)
        for t, k in enumerate(keys):
            out = F.when(c["t"] == t, _all([F.contains(flat, F.lit(f" {x} ")) for x in k])).otherwise(out)
        return out

    def share(c: Column) -> Column:
        parts = F.split(of(templates, c["t"]), " ")
        same = F.transform(parts, lambda w, i: F.when((c["o"] + i >= 0) & (F.get(words, F.greatest(c["o"] + i, F.lit(0))) == w), 1.0).otherwise(0.0))
        return F.aggregate(same, F.lit(0.0), lambda n, x: n + x) / F.size(parts)

    return F.transform(F.filter(agreed, holds), lambda c: F.struct(of(labels, c["t"]).alias("label"), share(c).alias("share")))


def _all(some: list[Column]) -> Column:
    out = some[0]
    for x in some[1:]:
        out = out & x
    return out


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    worded = only(docs, doc_id="long", text="string").select("doc_id", words_of("text").alias("words"))
    index = rare_index(frequencies(worded))
    none = F.array().cast("array<struct<t:int,o:int>>")
    rows = worded.withColumn("license_at", F.when(F.array_contains("words", "license"), _places(F.col("words"), "license")).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("base", F.when(F.size("license_at") > 0, base_places(F.col("words"))).otherwise(F.array().cast("array<struct<start:bigint,label:string>>")))
    rows = rows.withColumn("top", F.array_intersect(_array(index), F.col("words")))
    rows = rows.withColumn("posts", F.when(F.size("top") > 1, postings_of(F.col("words"), F.col("top"), index)).otherwise(none))
    rows = rows.withColumn("agreed", F.when(F.size("posts") > 1, agreed_offsets(F.col("posts"))).otherwise(none))
    rows = rows.withColumn("flat", F.when(F.size("agreed") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    rows = rows.withColumn("more", F.when(F.size("agreed") > 0, verified(F.col("words"), F.col("agreed"), F.col("flat"))).otherwise(F.array().cast("array<struct<label:string,share:double>>")))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "more.label")).alias("labels"),
        F.coalesce(F.greatest(F.array_max("more.share"), F.when(F.size("base") > 0, F.lit(0.5))), F.lit(0.0)).alias("score"),
    )
