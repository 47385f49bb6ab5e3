"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into sentences, known licence sentences are found among them whether on one line or wrapped over
several, and the resulting sequence of identifiers is matched against licence rules in their stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Identifiers of known licence sentences, as they read after normalisation.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-work": "this work is licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2-work": "this work is licensed under the apache license version 2 0",
    "apache-2-released": "released under the apache license version 2 0",
    "apache-2-comply": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl-3-released": "released under the gnu general public license version 3",
    "gpl-2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-2": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-3": "licensed under the bsd 3 clause license",
    "bsd-2": "licensed under the bsd 2 clause license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-nc-sa-4": "licensed under cc by nc sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "public-domain": "this work is in the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}

# Rules in order of precedence, (licence, sentence identifiers that follow one another).
RULES = [
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-grant"]),
    ("Apache-2.0", ["apache-2", "apache-2-comply", "apache-2-copy"]),
    ("Apache-2.0", ["apache-2"]),
    ("Apache-2.0", ["apache-2-work"]),
    ("Apache-2.0", ["apache-2-released"]),
    ("GPL-3.0", ["gpl-3-work"]),
    ("GPL-3.0", ["gpl-3"]),
    ("GPL-3.0", ["gpl-3-released"]),
    ("GPL-2.0", ["gpl-2-work"]),
    ("GPL-2.0", ["gpl-2"]),
    ("GPL", ["gpl-free", "gpl-hope"]),
    ("LGPL-3.0", ["lgpl-3"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-work"]),
    ("BSD-3-Clause", ["bsd-3"]),
    ("BSD-2-Clause", ["bsd-2"]),
    ("ISC", ["isc"]),
    ("MPL-2.0", ["mpl-2"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["public-domain"]),
    ("Proprietary", ["reserved"]),
]

# Marks of a normalised text: END after a sentence or a blank line, LINE where a line ends within a paragraph.
END, LINE = "\x01", "\x02"
_NAME = f"(?: (?:[{END}{LINE}] )?[a-z0-9]+){{1,12}}(?: {END})?"
_GRANT = "you can redistribute it and or modify it under the terms of "
_FSF = " as published by the free software foundation"


def _grant(name: str, version: str) -> str:
    later = f"(?:{END} )?(?:either )?version {version} of the license( or at your option any later version)?( or at your option any later version)?"
    return _GRANT + f"(version {version} of the gnu {name} public license{_FSF}|the gnu {name} public license version {version}{_FSF}|the gnu {name} public license{_FSF} {later})"


# The sentences of full licence texts with their variants, as patterns over normalised words.
FULL_SENTENCES = [
    (
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)?"
        "( to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions)?",
    ),
    ("mit-notice", "the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied( including but not limited to the warranties of merchantability fitness for a particular purpose and non( )?infringement)?"),
    ("mit-title", "the mit license( mit)?"),
    ("apache-2", "(licensed|the asf licenses this file to you) under the apache license version 2 0( the license)?"),
    ("apache-2-comply", "you may not use this (file|software|work|project) except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at( https? www apache org licenses license 2 0( txt| html)?)?"),
    ("gpl-free", "this (program|library|file|software) is free software"),
    *[(f"{i}-{v}-grant", _grant(name, v.replace(".", " "))) for i, name, v in [("gpl", "general", "3"), ("gpl", "general", "2"), ("lgpl", "lesser general", "3"), ("lgpl", "lesser general", "2.1"), ("agpl", "affero general", "3")]],
    ("gpl-hope", "this (program|library|file|software) is distributed in the hope that it will be useful but without any warranty"),
    ("bsd-redistribution", "redistribution and use( of this software)? in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-endorse", f"([0-9a-z] )?(neither the names? of{_NAME} nor the names of( its| their| any)?( other)? contributors may|the names? of{_NAME} may not) be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted( provided that the above copyright notice and this permission notice appear in all copies)?"),
    ("mpl-2", f"this source code form is subject to the terms of the mozilla public license v( {END})? 2 0"),
    *[(i, f"(this work is )?licensed under (a|the) creative commons attribution {kind}4 0 international( public)? license") for i, kind in [("cc-by-4", ""), ("cc-by-sa-4", "share( )?alike "), ("cc-by-nc-4", "non( )?commercial "), ("cc-by-nc-sa-4", "non( )?commercial share( )?alike ")]],
]
_SPECIFIC = [("GPL-3.0", ["gpl-3-grant"]), ("GPL-2.0", ["gpl-2-grant"]), ("LGPL-3.0", ["lgpl-3-grant"]), ("LGPL-2.1", ["lgpl-2.1-grant"]), ("AGPL-3.0", ["agpl-3-grant"])]
_AT = RULES.index(("GPL-3.0", ["gpl-3-work"]))
ALL_RULES = RULES[:_AT] + _SPECIFIC + RULES[_AT:]

# Every known sentence holds one of these, so a text without them needs no sentence lookup.
ANCHORS = ["licens", "permission", "as is", "compliance", "free software", "redistribut", "distributed", "endorse", "public domain", "rights reserved", "copy"]
BOUNDARY = r"\n|[.;:!?]+[ \t\r\n]|[.;:!?]+$"
JUNK = r"[^a-z0-9]+"


def _marked(text: Column) -> Column:
    """Normalised words in one line, with a mark at each end of a sentence or line; comment leaders are junk."""
    s = F.translate(F.lower(text), END + LINE, "  ")
    s = F.regexp_replace(s, r"[.;:!?]+(?:[ \t\r\n]|$)", f" {END} ")
    s = F.regexp_replace(F.concat(F.lit("\n"), s, F.lit("\n")), "\n", f" {LINE} ")
    s = F.regexp_replace(s, f"[^a-z0-9{END}{LINE}]+", " ")
    return F.regexp_replace(s, f"[{END}{LINE}][ {END}{LINE}]*[{END}{LINE}]", END)


def _sentence_ids(text: Column) -> Column:
    """Known sentences in text order; one starts and ends at a mark, and may hold line ends between its words."""
    short = sorted(SENTENCES.values(), key=len, reverse=True)
    any_known = "|".join([p for _, p in FULL_SENTENCES] + short).replace(" ", f" (?:{LINE} )?")
    found = F.regexp_extract_all(_marked(text), F.lit(f"(?<=[{END}{LINE}] )(?:{any_known})(?= [{END}{LINE}])"), F.lit(0))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])

    def name(match: Column) -> Column:
        words = F.replace(match, F.lit(f"{LINE} "), F.lit(""))
        return F.coalesce(F.element_at(known, words), *[F.when(words.rlike(f"^(?:{p})$"), F.lit(i)) for i, p in FULL_SENTENCES])

    return F.transform(found, name)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_known, sentence_ids, licenses, license.

    `sentence_ids` lists the known sentences in text order, `licenses` the licences of all rules that match them in
    rule order, `license` the first; each is joined by spaces and empty where nothing matches. A sentence is found on
    one line or wrapped, with comment leaders or without; a blank line ends it. Null and empty texts have no sentence. The whole text is read; only DataFrame functions are used, and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    anchored = F.lit(False)
    for a in ANCHORS:
        words = a.split(" ")
        anchored = anchored | (low.contains(a) if len(words) == 1 else F.lit(True) & low.contains(words[0]) & low.contains(words[1]))
    ids = F.when(anchored, F.array_join(_sentence_ids(text), " ")).otherwise(F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("sentence_ids"))
    padded = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    hits = F.array_compact(F.array(*[F.when(padded.contains(f" {' '.join(seq)} "), F.lit(name)) for name, seq in ALL_RULES]))
    return (
        found.withColumn("hits", F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(hits)))
        .select(
            "doc_id",
            F.when(F.col("sentence_ids") == "", F.lit(0)).otherwise(F.size(F.split("sentence_ids", " "))).cast("long").alias("n_known"),
            "sentence_ids",
            F.array_join("hits", " ").alias("licenses"),
            F.coalesce(F.get("hits", F.lit(0)), F.lit("")).alias("license"),
        )
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    hits = ", ".join(f"CASE WHEN contains(p, ' {' '.join(seq)} ') THEN '{name}' END" for name, seq in RULES)
    return f"""
    WITH known(s, i) AS (VALUES {known}),
    cut AS (SELECT doc_id, unnest(c) AS s, generate_subscripts(c, 1) AS n
            FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '{BOUNDARY}') AS c FROM documents)),
    ids AS (SELECT doc_id, string_agg(i, ' ' ORDER BY n) AS ids, count(*) AS k
            FROM cut JOIN known ON known.s = trim(regexp_replace(cut.s, '{JUNK}', ' ', 'g')) GROUP BY doc_id),
    hit AS (SELECT d.doc_id, coalesce(k, 0) AS k, coalesce(ids, '') AS ids, ' ' || coalesce(ids, '') || ' ' AS p
            FROM documents d LEFT JOIN ids USING (doc_id)),
    named AS (SELECT doc_id, k, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS h FROM hit),
    uniq AS (SELECT doc_id, k, ids, list_filter(h, lambda x, j: list_position(h, x) = j) AS h FROM named)
    SELECT doc_id, k AS n_known, ids AS sentence_ids, array_to_string(h, ' ') AS licenses, coalesce(h[1], '') AS license
    FROM uniq"""


ORACLE = _oracle()
