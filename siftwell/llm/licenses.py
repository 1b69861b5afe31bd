"""License scans by sentence rules.

A text is split into sentences, each is normalised and looked up among the known licence sentences. A line that is
a known sentence stands by itself; other lines are joined with the next one, as texts are wrapped, up to the end of a
sentence, a colon at the end of a line, a line without letters or digits, or a line that begins a notice. The identifiers
found, in text order, are then matched against ordered rules. Each rule takes its identifier sequence out of the list
wherever it stands, so a longer grant listed first is not reported again by a shorter one. One projection, no shuffle.

Null or empty texts have no sentences and no licence. Repeated rows give their result again, empty tables an empty
result, other columns are ignored. A long text stays inside its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import let

# Licence sentences in normalised form and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2_ref",
    "licensed under the apache license version 2.0 the license": "apache2_grant",
    "you may not use this file except in compliance with the license": "compliance",
    "you may obtain a copy of the license at": "copy_at",
    "released under the mit license": "mit_ref",
    "this software is released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_grant",
    "either version 3 of the license or at your option any later version": "gpl3_later",
    "either version 2 of the license or at your option any later version": "gpl2_later",
    "licensed under cc by nc 4.0": "cc_by_nc_4_ref",
    "licensed under cc by 4.0": "cc_by_4_ref",
    "licensed under cc by sa 4.0": "cc_by_sa_4_ref",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd_grant",
    "all rights reserved under license": "reserved",
    "spdx license identifier mit": "mit_ref",
    "spdx license identifier apache 2.0": "apache2_ref",
    "spdx license identifier gpl 3.0 or later": "gpl3_or_later_ref",
}

# Licences and their identifier sequences, in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("apache2_grant", "compliance", "copy_at")),
    ("Apache-2.0", ("apache2_grant",)),
    ("GPL-3.0-or-later", ("gpl_grant", "gpl3_later")),
    ("GPL-2.0-or-later", ("gpl_grant", "gpl2_later")),
    ("GPL-3.0-or-later", ("gpl3_or_later_ref",)),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_grant",)),
    ("BSD", ("bsd_grant",)),
    ("Apache-2.0", ("apache2_ref",)),
    ("MIT", ("mit_ref",)),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4_ref",)),
    ("CC-BY-4.0", ("cc_by_4_ref",)),
)

_GNU = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
    "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
    "the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
)

# Whole sentences of the licences' standard texts. GPL-2 and LGPL-2.1 part theirs by semicolons, GPL-3 and LGPL-3 by a colon and a comma.
FULL_SENTENCES = {
    _MIT: "mit_grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    _GNU.format(""): "gpl_grant",
    _GNU.format("lesser "): "lgpl_grant",
    "this library is free software " + _GNU.format("lesser "): "lgpl_grant",
    "this program is free software " + _GNU.format("lesser "): "lgpl_grant",
    _LATER.format("2.1"): "lgpl21_later",
    **{
        f"{start}{_GNU.format(kind)} {_LATER.format('3')}": name
        for kind, name in (("", "gpl3_or_later_ref"), ("lesser ", "lgpl3_or_later_ref"))
        for start in ("", "this program is free software ", "this library is free software ")
    },
}

FULL_RULES = (
    ("LGPL-2.1-or-later", ("lgpl_grant", "lgpl21_later")),
    ("LGPL-3.0-or-later", ("lgpl_grant", "gpl3_later")),
    ("LGPL-3.0-or-later", ("lgpl3_or_later_ref",)),
)

# Only sentences with one of these can be known ones.
KEYWORDS = "licen[sc]e|permission|redistribution"
BREAK = r"([.!?;])[\x20\x09-\x0D]+"
NOISE = r"[^a-z0-9.]+"
EDGES = r"^[. ]+|[. ]+$"


# A line that ends a sentence, and one that begins a notice.
ENDS = r"[.!?;:][^A-Za-z0-9]*$"
STARTS = "^(permission is hereby|redistribution and use|licensed under|this program is free|this library is free)"


def sentences(text: Column, lookup: Column) -> Column:
    """Normalised sentences that may be known: lower case, one space for anything but letters, digits and dots."""
    def line(part: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.lower(part), NOISE, " "), EDGES, "")
        return let(
            clean,
            lambda s: F.when((s == "") | (s.rlike(KEYWORDS) & lookup[s].isNotNull()), F.concat(F.lit("\n"), s, F.lit("\n"))).otherwise(
                F.concat(F.when(s.rlike(STARTS), "\n").otherwise(""), s, F.when(part.rlike(ENDS), "\n").otherwise(""))
            ),
        )

    parts = F.split(F.regexp_replace(text, BREAK, "$1\n"), "\n")
    joined = F.transform(F.split(F.array_join(F.transform(parts, line), " "), "\n"), lambda s: F.trim(s))
    likely = F.filter(joined, lambda s: s.rlike(KEYWORDS))
    return F.when(F.lower(text).rlike(KEYWORDS), likely).otherwise(F.array().cast("array<string>"))


def _between(ids: Sequence[str]) -> str:
    return ";" + ";;".join(ids) + ";"


def scan(
    docs: DataFrame, known: Mapping[str, str] = SENTENCES | FULL_SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES + FULL_RULES
) -> DataFrame:
    """Per document: ``doc_id, sentence_ids`` (in text order), ``licenses`` (each once, in rule order), ``unmatched``.

    Needs ``doc_id`` and ``text``; one row per input row.
    """
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.filter(F.transform(sentences(F.col("text"), lookup), lambda s: lookup[s]), lambda i: i.isNotNull())
    ids = docs.select("doc_id", found.alias("ids"))

    def tried(left: Column, names: Column, rest: Sequence[tuple[str, Sequence[str]]]) -> Column:
        if not rest:
            return F.struct(left.alias("left"), names.alias("names"))
        (name, sequence), pattern = rest[0], _between(rest[0][1])
        state = F.struct(
            F.replace(left, F.lit(pattern), F.lit(";|;")).alias("left"),
            F.when(F.contains(left, F.lit(pattern)), F.array_union(names, F.array(F.lit(name)))).otherwise(names).alias("names"),
        )
        return let(state, lambda s: tried(s["left"], s["names"], rest[1:]))

    marked = F.array_join(F.transform("ids", lambda i: F.concat(F.lit(";"), i, F.lit(";"))), "")
    none = F.struct(F.lit("").alias("left"), F.array().cast("array<string>").alias("names"))
    matched = F.when(F.size("ids") > 0, tried(marked, none["names"], list(rules))).otherwise(none)
    return ids.select("doc_id", "ids", matched.alias("m")).select(
        "doc_id",
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join("m.names", " AND ").alias("licenses"),
        F.size(F.filter(F.split("m.left", ";+"), lambda i: (i != "") & (i != "|"))).cast("long").alias("unmatched"),
    )
