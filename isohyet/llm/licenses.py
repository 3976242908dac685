"""License scans by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm._common import cut

#: Words of a text in lower case are runs of digits, a-z and whatever isn't ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that are reported wherever they stand, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Classes of rules, the strongest first, and how sure a detection of the class makes us.
TEXT, TAG, GRANT, NAME, HINT = range(5)
WEIGHT = (1.0, 0.95, 0.9, 0.7, 0.4)
BASE_WEIGHT = 0.6


@dataclass(frozen=True)
class Rule:
    """A signature: a regular expression over words with single blanks, tried where one keyword of each group stands in the text."""

    label: str
    level: int
    pattern: str
    keys: tuple[tuple[str, ...], ...]


# Parts of patterns. Versions lose their points and marks: "2.0" is the words "2 0".
LATER = r"(?: or (?:any )?later(?: version)?| or at your option any later version| and later)"
GRANTED = r"(?:licensed|released|distributed|available|published|provided|made available|redistributable|covered|governed|offered|sublicensed|relicensed) (?:to you )?(?:under|by|according to|subject to)(?: the terms(?: and conditions)? of)?(?: the)?"

# label | words of the SPDX identifier | name | keywords: parts of words that a match holds, all of those between commas, one of those between slashes
FAMILIES = r"""
0bsd | 0bsd | (?:zero clause bsd|bsd zero clause|0 clause bsd) | bsd
afl-3.0 | afl 3 0 | academic free license(?: v(?:ersion)?)?(?: 3 0)? | academic,licen
agpl-3.0-only | agpl 3 0(?: only)? | (?:gnu )?affero general public license(?: version)? (?:v )?3(?: 0)? | affero
agpl-3.0-or-later | agpl 3 0 or later | (?:gnu )?affero general public license(?: version)? (?:v )?3(?: 0)?(?: of the license)?@LATER | affero
apache-1.1 | apache 1 1 | apache (?:software )?licen[sc]e(?: version)? 1 1 | apache,licen
apache-2.0 | apache 2 0 | apache (?:software )?licen[sc]e(?: version)? (?:v )?2(?: 0)? | apache,licen
artistic-1.0 | artistic 1 0 | artistic licen[sc]e(?: version)? 1(?: 0)? | artistic,licen
artistic-2.0 | artistic 2 0 | artistic licen[sc]e(?: version)? 2(?: 0)? | artistic,licen
beerware | beerware | (?:beerware|beer ware) licen[sc]e | beer,licen
bsd-2-clause | bsd 2 clause | (?:2|two) clause bsd(?: licen[sc]e)?|(?:simplified|freebsd) bsd licen[sc]e|bsd (?:2|two) clause(?: licen[sc]e)? | bsd
bsd-3-clause | bsd 3 clause | (?:3|three) clause bsd(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e|bsd (?:3|three) clause(?: licen[sc]e)? | bsd
bsd-4-clause | bsd 4 clause | (?:4|four) clause bsd(?: licen[sc]e)?|(?:original|old) bsd licen[sc]e | bsd
bsl-1.0 | bsl 1 0 | boost software licen[sc]e(?: version)?(?: 1 0)? | boost,licen
busl-1.1 | busl 1 1 | business source licen[sc]e(?: version)?(?: 1 1)? | business,licen
cc0-1.0 | cc0 1 0 | (?:cc0|cc zero)(?: 1 0)?(?: universal)?|creative commons zero(?: 1 0)? | zero/cc0
cc-by-2.0 | cc by 2 0 | (?:cc by|creative commons attribution)(?: generic)? 2 0 | cc/creative,by/attribution
cc-by-3.0 | cc by 3 0 | (?:cc by|creative commons attribution)(?: unported)? 3 0 | cc/creative,by/attribution
cc-by-4.0 | cc by 4 0 | (?:cc by|creative commons attribution)(?: international)? 4 0 | cc/creative,by/attribution
cc-by-sa-3.0 | cc by sa 3 0 | (?:cc by sa|creative commons attribution share ?alike)(?: unported)? 3 0 | cc/creative,by/attribution
cc-by-sa-4.0 | cc by sa 4 0 | (?:cc by sa|creative commons attribution share ?alike)(?: international)? 4 0 | cc/creative,by/attribution
cc-by-nc-3.0 | cc by nc 3 0 | (?:cc by nc|creative commons attribution non ?commercial)(?: unported)? 3 0 | cc/creative,by/attribution
cc-by-nc-4.0 | cc by nc 4 0 | (?:cc by nc|creative commons attribution non ?commercial)(?: international)? 4 0 | cc/creative,by/attribution
cc-by-nd-4.0 | cc by nd 4 0 | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: international)? 4 0 | cc/creative,by/attribution
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: international)? 4 0 | cc/creative,by/attribution
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: international)? 4 0 | cc/creative,by/attribution
cddl-1.0 | cddl 1 0 | common development and distribution licen[sc]e(?: cddl)?(?: version)?(?: 1 0)?|cddl(?: version)? 1 0 | cddl/development
cecill-2.1 | cecill 2 1 | cecill(?: free software licen[sc]e(?: agreement)?)?(?: version| v)? 2 1 | cecill
cpl-1.0 | cpl 1 0 | common public licen[sc]e(?: version)?(?: 1 0)? | common,public,licen
ecl-2.0 | ecl 2 0 | educational community licen[sc]e(?: version)?(?: 2 0)? | educational,licen
epl-1.0 | epl 1 0 | eclipse public licen[sc]e(?: version)?(?: v)? 1(?: 0)? | eclipse,licen
epl-2.0 | epl 2 0 | eclipse public licen[sc]e(?: version)?(?: v)? 2(?: 0)? | eclipse,licen
eupl-1.2 | eupl 1 2 | european union public licen[sc]e(?: version| v)?(?: 1 2)?|eupl(?: version| v)? 1 2 | eupl/european
fdl-1.3 | gfdl 1 3(?: only| or later)? | gnu free documentation licen[sc]e(?: version)?(?: 1 3)? | documentation,licen
gpl-2.0-only | gpl 2 0(?: only)? | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v )?2(?: 0)?|(?:gnu )?gpl(?: version)? ?v?2(?: 0)? | gpl/general
gpl-2.0-or-later | gpl 2 0 or later | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v )?2(?: 0)?(?: of the licen[sc]e)?@LATER|(?:gnu )?gpl(?: version)? ?v?2(?: 0)?@LATER | gpl/general
gpl-3.0-only | gpl 3 0(?: only)? | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v )?3(?: 0)?|(?:gnu )?gpl(?: version)? ?v?3(?: 0)? | gpl/general
gpl-3.0-or-later | gpl 3 0 or later | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v )?3(?: 0)?(?: of the licen[sc]e)?@LATER|(?:gnu )?gpl(?: version)? ?v?3(?: 0)?@LATER | gpl/general
isc | isc | isc licen[sc]e | isc,licen
lgpl-2.1-only | lgpl 2 1(?: only)? | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? (?:v )?2 1|(?:gnu )?lgpl(?: version)? ?v?2 1 | lgpl/general
lgpl-2.1-or-later | lgpl 2 1 or later | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? (?:v )?2 1(?: of the licen[sc]e)?@LATER|(?:gnu )?lgpl(?: version)? ?v?2 1@LATER | lgpl/general
lgpl-3.0-only | lgpl 3 0(?: only)? | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? (?:v )?3(?: 0)?|(?:gnu )?lgpl(?: version)? ?v?3(?: 0)? | lgpl/general
lgpl-3.0-or-later | lgpl 3 0 or later | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? (?:v )?3(?: 0)?(?: of the licen[sc]e)?@LATER|(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?@LATER | lgpl/general
lppl-1.3c | lppl 1 3c | latex project public licen[sc]e(?: version)?(?: 1 3c?)? | latex,licen
mit | mit | (?:mit|expat|mit x11|x11 mit) licen[sc]e | mit/x11/expat,licen
mit-0 | mit 0 | mit(?: licen[sc]e)? (?:no|without) attribution | mit,attribution
mpl-1.1 | mpl 1 1 | mozilla public licen[sc]e(?: version)? (?:v )?1 1|mpl(?: version| v)? 1 1 | mozilla/mpl
mpl-2.0 | mpl 2 0 | mozilla public licen[sc]e(?: version)? (?:v )?2(?: 0)?|mpl(?: version| v)? 2 0 | mozilla/mpl
ms-pl | ms pl | microsoft public licen[sc]e | microsoft,licen
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e | ncsa,licen
odbl-1.0 | odbl 1 0 | open (?:data commons open )?database licen[sc]e(?: odbl)?(?: version| v)?(?: 1 0)? | database,licen
ofl-1.1 | ofl 1 1 | (?:sil )?open font licen[sc]e(?: version)?(?: 1 1)? | font,licen
openssl | openssl | openssl licen[sc]e | openssl,licen
osl-3.0 | osl 3 0 | open software licen[sc]e(?: version| v)?(?: 3 0)? | open,software,licen
php-3.01 | php 3 01 | php licen[sc]e(?: version)?(?: 3 01)? | php,licen
postgresql | postgresql | postgresql licen[sc]e | postgresql,licen
psf-2.0 | psf 2 0 | (?:python software foundation|psf) licen[sc]e(?: version)?(?: 2)? | psf/python,licen
sspl-1.0 | sspl 1 0 | server side public licen[sc]e(?: version| v)?(?: 1(?: 0)?)? | server,side,licen
unlicense | unlicense | unlicense | unlicense
upl-1.0 | upl 1 0 | universal permissive licen[sc]e(?: version)?(?: v)?(?: 1 0)? | permissive,licen
vim | vim | vim licen[sc]e | vim,licen
wtfpl | wtfpl | (?:wtfpl|do what the f\S* you want to public licen[sc]e) | wtfpl/want,wtfpl/licen
zlib | zlib | zlib(?: libpng)? licen[sc]e | zlib,licen
zpl-2.1 | zpl 2 1 | zope public licen[sc]e(?: version)?(?: 2 1)? | zope,licen
"""

# label | level | pattern | keywords: texts, grants and names without a version, hints
SIGNATURES = r"""
mit | TEXT | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction | permission
mit | TEXT | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | permission
mit-0 | TEXT | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is | permission
isc | TEXT | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies | permission
0bsd | TEXT | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is | permission
hpnd | TEXT | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted | permission
postgresql | TEXT | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | permission
bsd-2-clause | TEXT | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer (?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided | redistributions
bsd-3-clause | TEXT | neither the name of (?:the )?(?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission | endorse
bsd-4-clause | TEXT | all advertising materials mentioning features or use of this software must display the following acknowledgement | advertising
bsd | TEXT | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met | redistribution
apache-2.0 | TEXT | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license | apache
apache-2.0 | TEXT | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | applicable
apache-2.0 | TEXT | apache license version 2 0 january 2004 | apache
apache-1.1 | TEXT | the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation | apache
gpl-2.0-or-later | TEXT | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version | general,licen
gpl-3.0-or-later | TEXT | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version | general,licen
gpl-2.0-only | TEXT | under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation | general,licen
gpl-3.0-only | TEXT | under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation | general,licen
gpl-2.0-only | TEXT | gnu general public license version 2 june 1991 | general,licen
gpl-3.0-only | TEXT | gnu general public license version 3 29 june 2007 | general,licen
gpl | TEXT | you should have received a copy of the gnu general public license along with this program | general,licen
gpl | TEXT | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license | general,licen
lgpl-2.1-or-later | TEXT | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version | general,licen
lgpl-3.0-or-later | TEXT | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version | general,licen
lgpl-2.1-only | TEXT | gnu lesser general public license version 2 1 february 1999 | general,licen
lgpl-3.0-only | TEXT | gnu lesser general public license version 3 29 june 2007 | general,licen
lgpl | TEXT | you should have received a copy of the gnu lesser general public license along with this | general,licen
agpl-3.0-or-later | TEXT | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version | affero
agpl-3.0-only | TEXT | gnu affero general public license version 3 19 november 2007 | affero
mpl-2.0 | TEXT | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0 | mozilla
mpl-1.1 | TEXT | the contents of this file are subject to the mozilla public license version 1 1 | mozilla
epl-1.0 | TEXT | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 | eclipse
epl-2.0 | TEXT | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 | eclipse
cddl-1.0 | TEXT | the contents of this file are subject to the terms of the common development and distribution license | development
bsl-1.0 | TEXT | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license | permission
zlib | TEXT | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software | implied
zlib | TEXT | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | altered
unlicense | TEXT | this is free and unencumbered software released into the public domain | unencumbered
cc0-1.0 | TEXT | to the extent possible under law the (?:person|author)s? (?:who associated cc0 with this work )?(?:has|have) waived all copyright and related or neighboring rights | waived
ofl-1.1 | TEXT | this font software is licensed under the sil open font license version 1 1 | font
wtfpl | TEXT | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed | verbatim
gpl | TEXT | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed | verbatim
beerware | TEXT | as long as you retain this notice you can do whatever you want with this stuff | whatever
artistic-2.0 | TEXT | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied | verbatim
psf-2.0 | TEXT | this license agreement is between the python software foundation | python
openssl | TEXT | this product includes software developed by the openssl project for use in the openssl toolkit | openssl
ncsa | TEXT | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers | redistributions
ms-pl | TEXT | if you use the software you accept this license if you do not accept the license do not use the software | accept
cc-by-4.0 | TEXT | this work is licensed under a creative commons attribution 4 0 international license | creative
cc-by-sa-4.0 | TEXT | this work is licensed under a creative commons attribution share ?alike 4 0 international license | creative
cc-by-nc-4.0 | TEXT | this work is licensed under a creative commons attribution non ?commercial 4 0 international license | creative
cc-by-nd-4.0 | TEXT | this work is licensed under a creative commons attribution no ?derivatives 4 0 international license | creative
cc-by-nc-sa-4.0 | TEXT | this work is licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license | creative
cc-by-nc-nd-4.0 | TEXT | this work is licensed under a creative commons attribution non ?commercial no ?derivatives 4 0 international license | creative
cc-by-3.0 | TEXT | this work is licensed under (?:a|the) creative commons attribution 3 0 (?:unported )?license | creative
apache | GRANT | @GRANTED apache (?:software )?licen[sc]e | apache,licen
bsd | GRANT | @GRANTED bsd(?: style)? licen[sc]e | bsd,licen
gpl | GRANT | @GRANTED (?:gnu )?(?:general public licen[sc]e|gpl) | gpl/general
lgpl | GRANT | @GRANTED (?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl) | lgpl/general
agpl | GRANT | @GRANTED (?:gnu )?(?:affero general public licen[sc]e|agpl) | agpl/affero
mpl | GRANT | @GRANTED (?:mozilla public licen[sc]e|mpl) | mpl/mozilla
epl | GRANT | @GRANTED (?:eclipse public licen[sc]e|epl) | epl/eclipse
cc-by | GRANT | @GRANTED (?:a )?(?:cc by|creative commons attribution) | cc/creative,by/attribution
cc | GRANT | @GRANTED (?:a )?creative commons(?: licen[sc]e)? | creative
public-domain | GRANT | (?:released|placed|dedicated|donated)(?: in)?(?:to| to) the public domain | domain
apache | NAME | apache (?:software )?licen[sc]e | apache,licen
bsd | NAME | (?:bsd licen[sc]e|bsd style licen[sc]e) | bsd,licen
gpl | NAME | (?:gnu )?general public licen[sc]e|gnu gpl | gpl/general
lgpl | NAME | (?:gnu )?(?:lesser|library) general public licen[sc]e|gnu lgpl | lgpl/general
agpl | NAME | (?:gnu )?affero general public licen[sc]e|gnu agpl | agpl/affero
mpl | NAME | mozilla public licen[sc]e | mpl/mozilla
epl | NAME | eclipse public licen[sc]e | epl/eclipse
artistic | NAME | artistic licen[sc]e | artistic
cc | NAME | creative commons(?: licen[sc]e)? | creative
public-domain | NAME | in the public domain | domain
proprietary | GRANT | (?:proprietary and confidential|unauthorized copying of this file) | proprietary/unauthorized
proprietary | GRANT | unauthorized copying of this file via any medium is strictly prohibited | unauthorized
proprietary | NAME | all rights reserved | reserved
unknown-tag | TAG | spdx licen[sc]e identifier \S+ | spdx
unknown | HINT | @GRANTED (?:\S+ ){1,5}licen[sc]e | licen
unknown | HINT | (?:see|read|refer to|included in|found in)(?: the)? licen[sc]e(?: file| txt| md)? (?:for|file|in the) | licen
unknown | HINT | use of this (?:software|source code|file|work|document) is governed by | governed
unknown | HINT | this (?:software|file|work|document|project|package|text) is licensed | licensed
"""


def _filled(pattern: str) -> str:
    return pattern.replace("@LATER", LATER).replace("@GRANTED", GRANTED)


def _keys(text: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(one.split("/")) for one in text.split(","))


def standard_rules() -> tuple[Rule, ...]:
    """Base phrases first, then texts, each family's identifier, grants and name, then what names no version: within a class the earlier rule is the stronger."""
    out = [Rule(label, NAME, phrase, _keys(",".join(phrase.split()))) for phrase, label in BASE.items()]
    lines = [[c.strip() for c in line.split(" | ")] for line in SIGNATURES.strip().splitlines()]
    rules = [Rule(label, globals()[level], _filled(pattern), _keys(keys)) for label, level, pattern, keys in lines]
    out += [r for r in rules if r.level == TEXT]
    for line in FAMILIES.strip().splitlines():
        label, tag, name, keys = (c.strip() for c in line.split(" | "))
        name = f"(?:{_filled(name)})"
        out += [
            Rule(label, TAG, rf"spdx licen[sc]e identifier {tag}", _keys("spdx")),
            Rule(label, GRANT, rf"{GRANTED} {name}(?: licen[sc]e)?", _keys(keys)),
            Rule(label, NAME, name, _keys(keys)),
        ]
    return tuple(out + [r for r in rules if r.level != TEXT])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once for a row."""
    return F.transform(F.array(value), use)[0]


HIT = "array<struct<rule:int,start:int,stop:int>>"


def places(words: Column, rule: Column, pattern: Column) -> Column:
    """Where a rule matches a text of single blanks: from word start up to, not including, word stop.

    Matches get a mark in front and one behind (no word holds control
    characters); the marked words then say where they stand, whatever the length of the text.
    """

    def marked(text: Column) -> Column:
        parts = F.slice(F.split(text, " "), 2, F.greatest(F.size(F.split(text, " ")) - 2, F.lit(0)))
        at = lambda sign: F.transform(F.filter(F.transform(parts, lambda w, i: F.when(sign(w), i)), lambda i: i.isNotNull()), lambda i: i.cast("int"))
        pairs = F.arrays_zip(at(lambda w: F.startswith(w, F.lit("\x01"))).alias("a"), at(lambda w: F.endswith(w, F.lit("\x02"))).alias("z"))
        return F.transform(pairs, lambda p: F.struct(rule.alias("rule"), p["a"].alias("start"), (p["z"] + 1).cast("int").alias("stop"))).cast(HIT)

    return let(F.regexp_replace(words, F.concat(F.lit(" ("), pattern, F.lit(")(?= )")), F.lit(" \x01$1\x02")), lambda text: F.when(F.contains(text, F.lit("\x01")), marked(text)).otherwise(F.array().cast(HIT)))


def hits(lower: Column, rules: Sequence[Rule]) -> Column:
    """All matches of all rules, each rule tried only where its keywords stand."""
    keys = sorted({k for r in rules for group in r.keys for k in group})
    listed = lambda words: F.array(*[F.lit(k) for k in words])
    known = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.pattern).alias("pattern"), F.array(*[listed(group) for group in r.keys]).alias("keys")) for i, r in enumerate(rules)])
    # most texts hold no word that starts a rule: they are done after this look
    found = F.filter(listed(keys), lambda k: F.contains(lower, k))
    squeezed = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))

    def tried(have: Column) -> Column:
        live = F.filter(known, lambda r: F.forall(r["keys"], lambda group: F.arrays_overlap(group, have)))
        return let(live, lambda some: F.when(F.size(some) > 0, let(squeezed, lambda words: F.flatten(F.transform(some, lambda r: places(words, r["rule"], r["pattern"])))))).cast(HIT)

    return F.coalesce(let(found, lambda have: F.when(F.size(have) > 0, tried(have))), F.array().cast(HIT))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """(id, n_words, base array<struct<label, start, stop>>, found array<struct<label, level, start, stop>>, score) for each row; places in words.

    Texts are lower-cased (A-Z) and become words with single blanks. Rules are
    tried where their keywords stand. ``base`` has every place of a base phrase.
    ``found`` are the detections left after suppression: one goes if a detection
    of a stronger class overlaps it, or if one of the same or a stronger class
    contains it (of two with the same place the earlier rule stays). Whether the
    other one goes itself makes no difference, so nothing depends on order. The
    score is that of the strongest class left, 0.6 at least for a base phrase,
    else 0.

    All in built-in functions. Texts never leave their task: only rows with hits
    go on, as (row, place, rule), to running maxima over each row's hits, which
    spill where a text has very many. Null and empty texts have no words, no
    places and a score of 0. Null and repeated ids, repeated rows: every row has
    its own result. An empty table gives an empty table; other columns are not read.
    """
    rules = standard_rules() if rules is None else tuple(rules)
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), let(lower, lambda t: F.struct(F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_words"), hits(t, rules).alias("hits"))).alias("seen"))
    rows = cut(rows.select("id", "row", "seen.n_words", "seen.hits"), "license-hits")
    label, level = (F.array(*[F.lit(getattr(r, what)) for r in rules]) for what in ("label", "level"))
    is_base = len([r for r in rules if r.pattern in BASE and BASE[r.pattern] == r.label])
    each = rows.where(F.size("hits") > 0).select("row", F.inline("hits")).withColumns({"level": F.element_at(level, F.col("rule") + 1), "label": F.element_at(label, F.col("rule") + 1)})
    levels = sorted({r.level for r in rules})
    # in the order of starts: what reaches beyond me from in front; in the order of stops: what starts before my end behind me
    front = Window.partitionBy("row").orderBy("start", F.desc("stop"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), "stop").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"front_{k}": F.max(F.when(F.col("level") == k, F.col("stop"))).over(front) for k in levels})
    each = each.withColumns({f"behind_{k}": F.min(F.when(F.col("level") == k, F.col("start"))).over(behind) for k in levels[:-1]})
    gone = F.lit(False)
    for k in levels:
        gone |= (F.col("level") >= k) & F.coalesce(F.col(f"front_{k}") >= F.col("stop"), F.lit(False))
        gone |= (F.col("level") > k) & F.coalesce(F.col(f"front_{k}") > F.col("start"), F.lit(False))
        if k != levels[-1]:
            gone |= (F.col("level") > k) & F.coalesce(F.col(f"behind_{k}") < F.col("stop"), F.lit(False))
    place = F.struct("start", "stop", "label", "level")
    each = each.withColumn("gone", gone).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("rule") < is_base, F.struct("start", "stop", "label")))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("gone"), place))).alias("found"),
        F.max(F.when(F.col("rule") < is_base, BASE_WEIGHT)).alias("base_score"),
        F.max(F.when(~F.col("gone"), F.element_at(F.array(*[F.lit(w) for w in WEIGHT]), F.col("level") + 1))).alias("score"),
    )
    base_kind, found_kind = "array<struct<start:int,stop:int,label:string>>", "array<struct<start:int,stop:int,label:string,level:int>>"
    with_hits = rows.where(F.size("hits") > 0).select("id", "row", "n_words").join(each, "row").select("id", "n_words", F.col("base").cast(base_kind), F.col("found").cast(found_kind), F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("base_score", F.lit(0.0))).alias("score"))
    without_hits = rows.where(F.size("hits") == 0).select("id", "n_words", F.array().cast(base_kind).alias("base"), F.array().cast(found_kind).alias("found"), F.lit(0.0).alias("score"))
    return with_hits.unionByName(without_hits)
