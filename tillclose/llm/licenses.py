"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, letters and digits only) and
mapped to the identifier of a known licence sentence; the sequence of identifiers is then matched
against ordered licence rules. A rule is a sequence of identifiers that must follow each other in the
text, at any distance: unknown sentences in between are skipped. Rules are tried in order, and the identifiers that a
longer rule has used are not used again by a later one. The catalogue has grants, conditions, disclaimers,
notices and SPDX tags of the common public licences, not their whole texts.

Sentences are cut both at line ends (a notice on its own line) and across single line ends (wrapped
licence texts); both sequences are matched. All of it is built-in functions on single rows: no shuffle.

Nulls and edge cases: a null or empty text has no sentences and no licence; rows are independent, so
null or repeated ``doc_id`` come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, and their identifiers (fixed values: wording of public licences).
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including "
    "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
    "of the software and to permit persons to whom the software is furnished to do so subject to the "
    "following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software": "mit-condition",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-condition",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the license or "
    "at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "all rights reserved": "reserved",
}
#: Wording of further public licences: identifier and sentences, normalised.
_MORE = {
    "mit-disclaimer": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache-disclaimer": [
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        f"the following conditions are met{x}"
        for x in ("", " 1")
    ],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer"
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd-name": [
        f"neither the name of {x} nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission"
        for x in ("the copyright holder", "the copyright owner", "the author", "the organization", "the university")
    ],
    "isc-grant": [
        f"permission to use copy modify and{x} distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
        for x in ("", " or")
    ],
    # "v." ends a sentence; only version 2.0 speaks of a source code form.
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v"],
    # Semicolons end a sentence, so the version is one of its own.
    **{
        f"{short}-terms": [
            f"you can redistribute it and or modify it under the terms of the gnu {name}general public license as "
            "published by the free software foundation"
        ]
        for short, name in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero "))
    },
    **{
        f"version-{version}-or-later": [
            f"either version {version.replace('.', ' ')} of the license or at your option any later version"
        ]
        for version in ("2", "2.1", "3")
    },
    "epl-notice": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v"
    ],
    "epl2-place": [f"2 0 which is available at {x} www eclipse org legal epl 2 0" for x in ("http", "https")],
    "epl2-notice": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license "
        f"2 0 which is available at {x} www eclipse org legal epl 2 0"
        for x in ("http", "https")
    ],
    "unlicense-grant": ["this is free and unencumbered software released into the public domain"],
    "bsl-grant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license the software to use reproduce display distribute "
        "execute and transmit the software and to prepare derivative works of the software and to permit third "
        "parties to whom the software is furnished to do so all subject to the following"
    ],
}
#: Licences by the sentences above that grant them.
_GRANTS = [
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("GPL-2.0-or-later", ("gpl-terms", "version-2-or-later")),
    ("GPL-3.0-or-later", ("gpl-terms", "version-3-or-later")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "version-2.1-or-later")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "version-3-or-later")),
    ("AGPL-3.0-or-later", ("agpl-terms", "version-3-or-later")),
    ("EPL-2.0", ("epl-notice", "epl2-place")),
    ("EPL-2.0", ("epl2-notice",)),
    ("Unlicense", ("unlicense-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
]
#: Licences by SPDX identifier, with the names that notices use. A bare GNU tag may stand for its "+" form.
_NAMED = {
    "MIT": [],
    "Apache-2.0": ["apache license 2 0", "apache 2 0 license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0"],
    "GPL-2.0": [],
    "GPL-2.0-only": ["gnu general public license version 2"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later"],
    "GPL-3.0": [],
    "GPL-3.0-only": [],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later"],
    "LGPL-2.1": [],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1"],
    "LGPL-2.1-or-later": ["gnu lesser general public license version 2 1 or later"],
    "LGPL-3.0": [],
    "LGPL-3.0-only": ["gnu lesser general public license version 3"],
    "LGPL-3.0-or-later": ["gnu lesser general public license version 3 or later"],
    "AGPL-3.0": [],
    "AGPL-3.0-only": ["gnu affero general public license version 3"],
    "AGPL-3.0-or-later": ["gnu affero general public license version 3 or later"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v 2 0"],
    "Unlicense": ["unlicense"],
    "BSL-1.0": ["boost software license version 1 0"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
}
_NOTICES = ("licensed under", "released under", "distributed under", "this project is licensed under")
_NOTICES += ("this work is licensed under", "this software is licensed under")


def _catalogue() -> None:
    for key, sentences in _MORE.items():
        for sentence in sentences:
            SENTENCES.setdefault(sentence, key)
    for name, called in _NAMED.items():
        plain = name.lower().replace("-", " ").replace(".", " ")
        tag = f"is-{name.lower()}"
        SENTENCES.setdefault(f"spdx license identifier {plain}", tag)
        for notice in _NOTICES:
            for own in called:
                for article in ("", "the ", "a "):
                    SENTENCES.setdefault(f"{notice} {article}{own}", tag)


_catalogue()
#: Ordered rules: licence and the identifiers that make it. Longer ones of a licence come first.
RULES = [
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-notice", "apache-condition")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("Proprietary", ("reserved",)),
]
RULES += [*_GRANTS, *((name, (f"is-{name.lower()}",)) for name in _NAMED)]


def _identified(text: Column) -> Column:
    """Sentences that are known: their place and identifier, in order."""
    marked = F.regexp_replace(F.lower(text), r"[.!?;]+([ \t\r\n\f]|$)", "\n$1")
    plain = F.regexp_replace(marked, r"[^\p{L}\p{N}\n]+", " ")
    sentences = F.split(plain, r" ?\n[ \n]*")
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    named = F.transform(sentences, lambda x, at: F.struct(at.alias("at"), F.try_element_at(known, F.trim(x)).alias("id")))
    return F.filter(named, lambda x: x["id"].isNotNull())


def _matched(ids: Column) -> Column:
    """Licences of a sequence of identifiers, each rule in turn on what earlier rules left."""
    state = F.struct(
        F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"),
        F.array().cast("array<string>").alias("found"),
    )
    rules = F.array(
        *(F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(x) + " ").alias("ids")) for name, x in RULES)
    )

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.replace(state["left"], rule["ids"], F.lit(" / ")).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(rules, state, apply, lambda state: state["found"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_known`` sentences, their ``sentence_ids`` in order and the ``licenses`` found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Only blank lines end a sentence of wrapped text.
    marked = F.regexp_replace(text, r"\n[ \t\r]*\n", "\u0001")
    joined = F.translate(F.translate(marked, "\n", " "), "\u0001", "\n")
    found = docs.select("doc_id", _identified(text).alias("lines"), _identified(joined).alias("wrapped"))
    ids = [F.transform(x, lambda y: y["id"]) for x in ("lines", "wrapped")]
    every = F.array_sort(F.array_distinct(F.concat(*(_matched(x) for x in ids))))
    longer = F.when(F.size("wrapped") > F.size("lines"), ids[1]).otherwise(ids[0])
    none = (F.size("lines") == 0) & (F.size("wrapped") == 0)
    return found.select(
        "doc_id",
        F.size(longer).cast("long").alias("n_known"),
        F.array_join(longer, ",").alias("sentence_ids"),
        F.when(none, F.lit("")).otherwise(F.array_join(every, ",")).alias("licenses"),
    )
