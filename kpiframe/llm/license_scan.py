"""License scan over a positional index of licence words (DataFrame functions only).

1. *Index.* One pass splits every whole text into words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
   lower-casing A-Z) and keeps, per file, the places of words that occur in any licence template.
2. *Rarity.* Document frequencies of the licence words over all files give every template its ``RARE`` words of the
   highest IDF (among those that occur at all, and not in more than ``COMMON_SHARE`` of the files), and the word of the highest IDF of its mandatory key phrase, which every
   hit holds. A template of whose key phrase some word occurs in no file has no such key word and no hits.
3. *Look-up and intersection.* Every place of one of these words, less its place in the template, is an offset. A
   template is ``SPAN`` words long at most, so the licence words that may meet it there are at most as many neighbours in
   the file's places; they are intersected with the template by relative position, inside the row.
4. *Verification.* An offset is a hit if it has every word of the template's mandatory key phrase, and the whole name:
   the words from the first that isn't a lead-in (``LEAD``) to the end of the key phrase. Lead-in words and the rest
   only raise the score. The name keeps "lesser general public license version 3" from being the GPL. An offset without
   the whole name is a hit with ``COVERAGE`` of the template's words. The base phrases are mandatory as a whole.

Defined results: null and empty texts have 0 words, no labels (empty strings), null places and score 0; repeated
rows are files of their own; a null ``doc_id`` is kept; very long texts are scanned whole, as one row; an empty table gives
an empty result; other columns are ignored. ``score`` is the largest share of a template's words found at one offset that has one of its
rare words or is a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import collect_garbage, written

COVERAGE = 0.8
RARE = 3
#: A word in more than this share of the files (and in more than so many) has too low an IDF to be looked up.
COMMON_SHARE = 0.1
COMMON_FILES = 20

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Grants, notices and names of the common licences, as their publishers word them. Label, words, mandatory
#: key phrase.
TEMPLATES = [
    # names
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "public license version 2"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("lgpl", "gnu library general public license", "library general public license"),
    ("lgpl", "lgplv3", "lgplv3"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("agpl", "agplv3", "agplv3"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("epl", "eclipse public license v 2 0", "eclipse public license"),
    ("epl", "epl 2 0", "epl 2 0"),
    ("bsl", "boost software license version 1 0", "boost software license"),
    ("bsd", "bsd 2 clause license", "bsd 2 clause"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause"),
    ("isc", "the isc license", "isc license"),
    ("zlib", "the zlib license", "zlib license"),
    # grants
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights to use "
     "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
     "is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice this list of conditions "
     "and the following disclaimer", "redistribution and use in source and binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission", "to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "permission to use copy modify and or distribute"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies",
     "permission to use copy modify and or distribute"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
     "and redistribute it freely", "permission is granted to anyone to use this software for any purpose"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license", "person or organization obtaining a copy of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    # notices
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "subject to the terms of the mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
     "under the terms of the eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights",
     "waived all copyright and related or neighboring rights"),
]

#: Words of SPDX identifiers, as they stand behind ``SPDX-License-Identifier:``.
SPDX = {
    "mit": "mit", "apache 2 0": "apache-2.0", "gpl 3 0": "gpl-3.0", "gpl 2 0": "gpl-2.0", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl",
    "agpl 3 0": "agpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc": "isc", "mpl 2 0": "mpl", "epl 2 0": "epl",
    "bsl 1 0": "bsl", "zlib": "zlib", "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc",
}
TEMPLATES += [(label, f"spdx license identifier {words}", f"license identifier {words}") for words, label in SPDX.items()]

#: Words that lead in to a licence's name or grant; texts often put others in their place.
LEAD = {"licensed", "under", "the", "this", "is"}

_GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings() -> list[tuple[int, str, bool, str, int, bool, int]]:
    """(template, label, base, word, place, mandatory, words of the template), one row per template word."""
    rows = []
    templates = [(label, phrase, phrase, True) for phrase, label in BASE.items()]
    templates += [(label, words, key, False) for label, words, key in TEMPLATES]
    for number, (label, phrase, key, base) in enumerate(templates):
        words, must = phrase.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        for place, word in enumerate(words):
            rows.append((number, label, base, word, place, at <= place < at + len(must), len(words)))
    return rows


def name_starts() -> dict[int, int]:
    """Per template, where its whole name begins: at the first word that is mandatory or no lead-in."""
    out: dict[int, int] = {}
    for template, _, _, word, place, must, _ in postings():
        if must or word not in LEAD:
            out.setdefault(template, place)
    return out


#: Words of the longest template.
SPAN = max(row[-1] for row in postings())


def licence_index(docs: DataFrame) -> DataFrame:
    """Per file: doc_id, n_words, places (array of word, pos) of licence words. Written once."""
    vocabulary = sorted({row[3] for row in postings()})
    parts = F.col("parts")
    lead = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    trail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    # Only licence words become structs: one for every word of a long text would be most of the pass's garbage.
    hits = F.filter(
        F.transform(parts, lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct(w.alias("word"), i.alias("pos")))),
        lambda x: x.isNotNull(),
    )
    # lower() also folds a few characters beyond A-Z into ASCII; only A-Z may be folded.
    plain = F.filter(
        F.transform(
            hits,
            lambda x: F.struct(
                F.translate(x["word"], _UPPER, _LOWER).alias("word"), (x["pos"] - F.col("lead")).alias("pos")
            ),
        ),
        lambda x: x["word"].isin(vocabulary),
    )
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), _GAP, -1).alias("parts"))
    return written(
        split.withColumn("lead", lead)
        .select(
            "doc_id",
            (F.size(parts) - F.col("lead") - trail).cast("long").alias("n_words"),
            plain.alias("places"),
        ),
        "licence-index",
    )


def file_counts(index: DataFrame) -> dict[str, int]:
    """In how many files each licence word occurs. The fewer, the higher its IDF."""
    return {
        r["word"]: r["files"]
        for r in index.select(F.explode(F.array_distinct(F.transform("places", lambda x: x["word"]))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("files"))
        .collect()  # one row per licence word at most
    }


def probes(counts: dict[str, int], files: int) -> dict[str, list[tuple[int, int, bool, bool]]]:
    """Per word that is looked up: (template, place in it, rare, key). Every hit is found by one key place."""
    words: dict[int, set] = {}
    keys: dict[int, list] = {}
    for template, _, _, word, place, must, _ in postings():
        if word in counts and counts[word] <= max(COMMON_FILES, files * COMMON_SHARE):
            words.setdefault(template, set()).add((counts[word], word))
        if must:
            keys.setdefault(template, []).append((counts.get(word, 0), word, place))
    rare = {(t, w) for t, found in words.items() for _, w in sorted(found)[:RARE]}
    key = {(t, *min(found)[1:]) for t, found in keys.items() if min(found)[0]}
    out: dict[str, list] = {}
    for template, _, _, word, place, _, _ in postings():
        flags = (template, word) in rare, (template, word, place) in key
        if any(flags):
            out.setdefault(word, []).append((template, place, *flags))
    return out


def _literal(rows: list[tuple], *names: str) -> Column:
    """Tuples as an array of structs."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def _templates() -> Column:
    """The templates by number: label, base, words, and the places where the name and the key phrase begin and the key phrase ends."""
    rows: dict[int, list] = {}
    for row in postings():
        rows.setdefault(row[0], []).append(row)
    out = []
    for of in rows.values():
        must = [place for _, _, _, _, place, must, _ in of if must]
        out.append((of[0][1], of[0][2], [row[3] for row in of], name_starts()[of[0][0]], min(must), max(must) + 1))
    return _literal(out, "label", "base", "words", "name_from", "key_from", "key_to")


def _offsets(places: Column, looked_up: dict) -> Column:
    """Array of label, base, start, holds, score: the offsets that looked-up words of a file give."""
    templates = _templates()
    at = F.create_map(
        *[x for word, of in looked_up.items() for x in (F.lit(word), _literal(of, "template", "place", "rare", "key"))]
    )
    seen = F.filter(
        F.transform(places, lambda x, i: F.struct(i.alias("i"), x["word"].alias("word"), x["pos"].alias("pos"))),
        lambda x: x["word"].isin(sorted(looked_up)),
    )

    def met(x: Column, probe: Column) -> Column:
        """Template, start and the template's places whose words stand there."""
        start = x["pos"] - probe["place"]
        # Licence words less than SPAN words away are less than SPAN elements away.
        near = F.slice(places, F.greatest(x["i"] - (SPAN - 1), F.lit(0)) + 1, F.lit(2 * SPAN - 1))
        words = F.get(templates, probe["template"])["words"]
        here = F.filter(near, lambda y: F.coalesce(F.get(words, y["pos"] - start) == y["word"], F.lit(False)))
        return F.struct(
            F.get(templates, probe["template"]).alias("t"),
            start.alias("start"),
            probe["rare"].alias("rare"),
            probe["key"].alias("key"),
            F.transform(here, lambda y: y["pos"] - start).alias("here"),
        )

    def judged(m: Column) -> Column:
        t = m["t"]
        coverage = F.size(m["here"]) / F.size(t["words"])
        whole = lambda lo: F.size(F.filter(m["here"], lambda p: (p >= lo) & (p < t["key_to"]))) == t["key_to"] - lo
        holds = m["key"] & whole(t["key_from"]) & (whole(t["name_from"]) | (coverage >= COVERAGE))
        return F.struct(
            t["label"].alias("label"),
            t["base"].alias("base"),
            m["start"].alias("start"),
            holds.alias("holds"),
            F.when(m["rare"] | holds, coverage).alias("score"),
        )

    found = F.flatten(F.transform(seen, lambda x: F.transform(F.element_at(at, x["word"]), lambda probe: met(x, probe))))
    return F.transform(found, judged)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per file: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    # Splitting texts makes the executors' heaps grow; neither pass begins with what an earlier one made them claim.
    collect_garbage(docs.sparkSession)
    index = licence_index(docs)
    collect_garbage(docs.sparkSession)
    looked_up = probes(file_counts(index), index.count())
    if not looked_up:
        # No licence word in any file: the same columns, over a word that no file has.
        looked_up = {postings()[0][3]: [(0, 0, False, False)]}
    found = index.select("doc_id", "n_words", _offsets(F.col("places"), looked_up).alias("found"))
    # The offsets are made once; every column below reads them.
    found = found.select(
        "doc_id",
        "n_words",
        F.array_max(F.transform("found", lambda x: x["score"])).alias("score"),
        F.filter("found", lambda x: x["holds"]).alias("hits"),
    ).withColumn("base", F.filter("hits", lambda x: x["base"]))
    joined = lambda hits: F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("hits").alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for the scan, from the definitions: words one by one, the base phrases by comparing neighbouring words.

    An offset counts for the score with any of a template's ``RARE`` rarest words, or as a hit: the whole key phrase, and the
    whole name or ``COVERAGE`` of the words.
    """
    begins = name_starts()
    ends = {t: place + 1 for t, _, _, _, place, must, _ in postings() if must}
    values = ", ".join(
        f"({t}, '{label}', {str(base).lower()}, '{word}', {place}, {int(must)}, {int(begins[t] <= place < ends[t])}, {length})"
        for t, label, base, word, place, must, length in postings()
    )
    return rf"""
WITH posting(template, label, base, word, place, must, named, length) AS (VALUES {values}),
files AS (
  SELECT row_number() OVER () AS file, doc_id,
    regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents
), placed AS (SELECT file, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM files),
lic AS (SELECT * FROM placed WHERE word IN (SELECT word FROM posting)),
freq AS (SELECT word, count(DISTINCT file) AS n FROM lic GROUP BY word),
rare AS (
  SELECT template, word FROM (SELECT DISTINCT template, word, n FROM posting JOIN freq USING (word))
  WHERE n <= greatest({COMMON_FILES}, (SELECT count(*) FROM files) * {COMMON_SHARE})
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY n, word) <= {RARE}
), need AS (SELECT template, sum(must) AS needs, sum(named) AS names FROM posting GROUP BY template),
found AS (
  SELECT file, template, pos - place AS start, any_value(label) AS label, any_value(base) AS base, bool_or(r.word IS NOT NULL) AS has_rare,
    sum(must) AS must, sum(named) AS named, count(*) / any_value(length)::DOUBLE AS coverage
  FROM lic JOIN posting USING (word) LEFT JOIN rare r USING (template, word)
  GROUP BY file, template, pos - place
), judged AS (
  SELECT *, must = needs AND (named = names OR coverage >= {COVERAGE}) AS holds FROM found JOIN need USING (template)
), phrases AS (
  SELECT file, pos AS start, label FROM (
    SELECT file, pos, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c, lead(word, 3) OVER p AS d
    FROM placed WINDOW p AS (PARTITION BY file ORDER BY pos)
  ) JOIN (VALUES {", ".join(f"('{p}', '{label}')" for p, label in BASE.items())}) b(phrase, label)
    ON phrase = concat_ws(' ', a, b) OR phrase = concat_ws(' ', a, b, c, d)
), bases AS (
  SELECT file, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM phrases GROUP BY file
), best AS (
  SELECT file, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE holds)), ',') AS labels,
    max(coverage) FILTER (WHERE has_rare OR holds) AS score FROM judged GROUP BY file
)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels,
  round(COALESCE(score, 0), 6) AS score
FROM files LEFT JOIN bases USING (file) LEFT JOIN best USING (file)
"""
