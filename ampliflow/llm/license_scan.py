"""License scans: normalised sentences are mapped to known licence sentences, whose sequences are matched to ordered rules.

Only DataFrame functions; one pass over the rows, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliflow.llm.common import let

#: Known sentences in normal form (see ``normal_form``) by identifier. Public licence wordings.
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-notice-long": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "licensed under the gnu general public license version 3",
    "gpl2-notice": "licensed under the gnu general public license version 2",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3-notice": "licensed under the gnu lesser general public license version 3",
    "agpl3-notice": "licensed under the gnu affero general public license version 3",
    "cc-by-nc4": "licensed under cc by nc 4 0",
    "cc-by-nc-sa4": "licensed under cc by nc sa 4 0",
    "cc-by-nd4": "licensed under cc by nd 4 0",
    "cc-by-sa4": "licensed under cc by sa 4 0",
    "cc-by4": "licensed under cc by 4 0",
    "cc-by4-long": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa4-long": "licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "released under cc0 1 0",
    "bsd-permit": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-notice": "subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}

#: Rules in order; each names the sentences that must follow each other, others may stand between. A rule that an earlier
#: rule of the same licence family has already explained does not count again.
RULES = (
    ("BSD-3-Clause", "bsd", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "bsd", ("bsd-permit", "bsd-source", "bsd-binary")),
    ("MIT", "mit", ("mit-grant", "mit-include", "mit-asis")),
    ("MIT", "mit", ("mit-grant", "mit-include")),
    ("MIT", "mit", ("mit-notice",)),
    ("MIT", "mit", ("mit-notice-2",)),
    ("Apache-2.0", "apache", ("apache2-notice-long", "apache2-comply")),
    ("Apache-2.0", "apache", ("apache2-notice-long",)),
    ("Apache-2.0", "apache", ("apache2-notice",)),
    ("GPL-3.0-or-later", "gpl", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", "gpl", ("gpl2-redistribute",)),
    ("GPL-3.0", "gpl", ("gpl3-notice",)),
    ("GPL-2.0", "gpl", ("gpl2-notice",)),
    ("LGPL-3.0", "lgpl", ("lgpl3-notice",)),
    ("AGPL-3.0", "agpl", ("agpl3-notice",)),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa", ("cc-by-nc-sa4",)),
    ("CC-BY-NC-4.0", "cc-by-nc", ("cc-by-nc4",)),
    ("CC-BY-ND-4.0", "cc-by-nd", ("cc-by-nd4",)),
    ("CC-BY-SA-4.0", "cc-by-sa", ("cc-by-sa4",)),
    ("CC-BY-SA-4.0", "cc-by-sa", ("cc-by-sa4-long",)),
    ("CC-BY-4.0", "cc-by", ("cc-by4",)),
    ("CC-BY-4.0", "cc-by", ("cc-by4-long",)),
    ("CC0-1.0", "cc0", ("cc0",)),
    ("MPL-2.0", "mpl", ("mpl2-notice",)),
    ("ISC", "isc", ("isc-grant",)),
    ("Unlicense", "unlicense", ("unlicense",)),
    ("all-rights-reserved", "reserved", ("reserved",)),
)

#: Every known sentence holds one of these.
HINT = r"licen[cs]e|redistribut|permission|copyright|software|rights reserved|cc0"
_IDS, _FORMS = tuple(SENTENCES), tuple(SENTENCES.values())
#: Ends of sentences: an end mark before white space, or the end of a line or paragraph.
_ENDS = r"[.!?:;][\x20\x09-\x0D]+|\n+"
_WRAPPED_ENDS = r"[.!?:;][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
#: Subjects before a licence sentence that say nothing about the licence.
_SUBJECT = r"^(this|the) (work|file|project|software|program|document|code|text|content|page|article|library|package) is (free software )?|^it is |^is "


def normal_form(sentence: Column) -> Column:
    """Lower case; runs of other than letters and digits become one blank; a subject such as "this work is" is left out."""
    plain = F.btrim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(plain, _SUBJECT, "")


def sentence_ids(text: Column, ends: str) -> Column:
    """Numbers (from 1) of the known sentences of a text, in order."""
    known = F.array(*[F.lit(x) for x in _FORMS])
    return F.filter(F.transform(F.split(text, ends), lambda s: F.array_position(known, normal_form(s)).cast("int")), lambda k: k > 0)


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every input row and column, with ``ls_sentences`` (identifiers in order) and ``ls_licenses`` (in the order of the rules).

    Sentences are looked for in the text as it stands and, for hard-wrapped texts, with single line ends taken as blanks;
    the reading that finds more counts, the first if equal. Null and empty texts have no sentence and no licence; null ids
    and repeated rows are rows like any other; an empty table gives an empty one. The prefix ``ls_`` is this operator's: a
    column of that name is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<int>")
    by_line, wrapped = sentence_ids(text, _ENDS), sentence_ids(text, _WRAPPED_ENDS)
    best = let(by_line, lambda a: let(wrapped, lambda b: F.when(F.size(b) > F.size(a), b).otherwise(a)))
    found = docs.withColumn("ls_sentence_ids", F.when(F.lower(text).rlike(HINT), best).otherwise(none))
    marks = F.concat(F.lit(" "), F.array_join(F.transform("ls_sentence_ids", lambda k: k.cast("string")), "  "), F.lit(" "))
    found = found.withColumn("ls_marks", marks)
    number = {name: k + 1 for k, name in enumerate(_IDS)}
    hits, before = [], {}
    for name, family, sequence in RULES:
        hit = F.col("ls_marks").like("%" + "%".join(f" {number[x]} " for x in sequence) + "%")
        fresh = hit & ~before.get(family, F.lit(False))
        before[family] = before.get(family, F.lit(False)) | hit
        hits.append(F.when(fresh, F.lit(name)))
    names = F.array(*[F.lit(x) for x in _IDS])
    return found.withColumns({"ls_licenses": F.array_compact(F.array(*hits)), "ls_sentences": F.transform("ls_sentence_ids", lambda k: F.element_at(names, k))}).drop("ls_sentence_ids", "ls_marks")


def op9_query(docs: DataFrame) -> DataFrame:
    found = license_scan(docs.select("doc_id", "text"))
    return found.select("doc_id", F.size("ls_sentences").cast("long").alias("n_sentences"), F.array_join("ls_sentences", ",").alias("sentences"), F.array_join("ls_licenses", ",").alias("licenses"))


def _oracle() -> str:
    quote = lambda x: x.replace("'", "''")
    known = ", ".join(f"({k + 1}, '{i}', '{quote(s)}')" for k, (i, s) in enumerate(SENTENCES.items()))
    number = {name: k + 1 for k, name in enumerate(_IDS)}
    cases, before = [], {}
    for name, family, sequence in RULES:
        hit = f"marks LIKE '%{'%'.join(f' {number[x]} ' for x in sequence)}%'"
        cases.append(f"CASE WHEN {hit}{''.join(f' AND NOT {b}' for b in before.get(family, []))} THEN '{name}' END")
        before.setdefault(family, []).append(f"({hit})")
    split = lambda ends: f"regexp_split_to_array(text, '{ends}')"
    found = lambda ends, name: f"""{name} AS (SELECT rid, list(k ORDER BY pos) AS ks, list(id ORDER BY pos) AS ids FROM (
  SELECT rid, pos, regexp_replace(trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '{_SUBJECT}', '') AS form FROM (
    SELECT rid, unnest({split(ends)}) AS s, generate_subscripts({split(ends)}, 1) AS pos FROM d)) JOIN known USING (form) GROUP BY rid)"""  # noqa: E731
    return f"""
WITH known(k, id, form) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{found(_ENDS, "a")},
{found(_WRAPPED_ENDS, "b")},
m AS (SELECT doc_id, CASE WHEN coalesce(len(b.ks), 0) > coalesce(len(a.ks), 0) THEN b.ks ELSE a.ks END AS ks,
  CASE WHEN coalesce(len(b.ks), 0) > coalesce(len(a.ks), 0) THEN b.ids ELSE a.ids END AS ids FROM d LEFT JOIN a USING (rid) LEFT JOIN b USING (rid)),
n AS (SELECT *, ' ' || coalesce(array_to_string(ks, '  '), '') || ' ' AS marks FROM m)
SELECT doc_id, coalesce(len(ks), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences,
  coalesce(array_to_string(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL), ','), '') AS licenses FROM n
"""


ORACLE = _oracle()
