"""License scans by ordered signature rules (DataFrame functions only).

A text is looked at only if it holds one of a few gate words. Such a text becomes its
normal form: lower-cased A-Z, words of letters, digits and non-ASCII characters, one
space before and after each. Rules are regexes over that form, and one is only tried
where the form holds its keyword. Detections are word intervals; one that lies inside
an interval of a rule of higher priority (or of the same priority and longer) is
suppressed, in one sweep over the intervals by start. Base rules are never suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, stored, with_rid

#: What separates words, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing: A-Z are letters
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Families: label, how the name is written, its versions (as words), keyword.
#: An empty version stands for the name alone.
FAMILIES = (
    ("gpl", "(?:gnu )?general public licen[sc]e", ("", "1", "2", "3", "2 0", "3 0"), "general public"),
    ("gpl", "gnu gpl", ("", "1", "2", "3", "2 0", "3 0"), "gnu gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", ("", "2", "2 1", "3", "3 0"), "general public"),
    ("lgpl", "(?:gnu )?lgpl", ("", "2", "2 1", "3", "3 0"), "lgpl"),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", ("", "1", "3", "3 0"), "affero"),
    ("agpl", "(?:gnu )?agpl", ("", "1", "3", "3 0"), "agpl"),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", ("", "1 1", "1 2", "1 3"), "free documentation"),
    ("apache", "apache (?:software )?licen[sc]e", ("", "1 0", "1 1", "2", "2 0"), "apache"),
    ("mit", "(?:the )?mit licen[sc]e", ("",), "mit licen"),
    ("bsd", "(?:(?:new|modified|simplified|revised) )?bsd licen[sc]e", ("",), "bsd licen"),
    ("bsd-2", "(?:2|two) clause bsd(?: licen[sc]e)?", ("",), "clause bsd"),
    ("bsd-3", "(?:3|three) clause bsd(?: licen[sc]e)?", ("",), "clause bsd"),
    ("bsd-4", "(?:4|four) clause bsd(?: licen[sc]e)?", ("",), "clause bsd"),
    ("isc", "isc licen[sc]e", ("",), "isc licen"),
    ("mpl", "mozilla public licen[sc]e", ("", "1 0", "1 1", "2", "2 0"), "mozilla"),
    ("epl", "eclipse public licen[sc]e", ("", "1", "1 0", "2", "2 0"), "eclipse"),
    ("cddl", "common development and distribution licen[sc]e", ("", "1", "1 0", "1 1"), "common development"),
    ("cpl", "common public licen[sc]e", ("", "1 0"), "common public"),
    ("eupl", "european union public licen[sc]e", ("", "1 0", "1 1", "1 2"), "european union"),
    ("artistic", "artistic licen[sc]e", ("", "1 0", "2 0"), "artistic"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", ("",), "zlib"),
    ("boost", "boost software licen[sc]e", ("", "1 0"), "boost"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", ("", "2"), "what the fuck"),
    ("unlicense", "(?:the )?unlicense", ("",), "unlicense"),
    ("ofl", "(?:sil )?open font licen[sc]e", ("", "1 0", "1 1"), "open font"),
    ("odbl", "open (?:data commons open )?database licen[sc]e", ("", "1 0"), "database licen"),
    ("odc-by", "open data commons attribution licen[sc]e", ("", "1 0"), "open data commons"),
    ("pddl", "public domain dedication and licen[sc]e", ("", "1 0"), "public domain"),
    ("ogl-uk", "open government licen[sc]e", ("", "1 0", "2 0", "3 0"), "open government"),
    ("python", "python software foundation licen[sc]e", ("", "2"), "python software"),
    ("php", "php licen[sc]e", ("", "3 0", "3 01"), "php licen"),
    ("postgresql", "postgresql licen[sc]e", ("",), "postgresql"),
    ("ms-pl", "microsoft public licen[sc]e", ("",), "microsoft"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", ("",), "microsoft"),
    ("osl", "open software licen[sc]e", ("", "1 0", "2 0", "2 1", "3 0"), "open software"),
    ("afl", "academic free licen[sc]e", ("", "1 1", "2 0", "2 1", "3 0"), "academic free"),
    ("upl", "universal permissive licen[sc]e", ("", "1 0"), "universal permissive"),
    ("mulan", "mulan permissive software licen[sc]e", ("", "1", "2"), "mulan"),
    ("bsl", "business source licen[sc]e", ("", "1 0", "1 1"), "business source"),
    ("sspl", "server side public licen[sc]e", ("", "1"), "server side"),
    ("elastic", "elastic licen[sc]e", ("", "2", "2 0"), "elastic"),
    ("rail", "(?:open ?)?rail(?: m)? licen[sc]e", ("",), "rail"),
    ("llama", "llama (?:2 |3 )?community licen[sc]e", ("",), "community licen"),
    ("jasper", "jasper licen[sc]e", ("", "2 0"), "jasper"),
    ("qpl", "q public licen[sc]e", ("", "1 0"), "q public"),
    ("sleepycat", "sleepycat licen[sc]e", ("",), "sleepycat"),
    ("ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[sc]e", ("",), "ncsa"),
    ("w3c", "w3c software (?:notice and )?licen[sc]e", ("",), "w3c"),
)

#: Creative Commons: the parts after the name, short and long.
CC_PARTS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))
CC_VERSIONS = ("", "1 0", "2 0", "2 5", "3 0", "4 0")

#: Signatures written out: label, regex, keyword, weight.
NOTICES = (
    # permissive
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 0.98),
    ("mit", "to deal in the software without restriction", "without restriction", 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission notice", 0.97),
    ("mit", "licensed under (?:the )?(?:terms of the )?mit", "licensed under", 0.9),
    ("mit", "mit x11 licen[sc]e", "mit x11", 0.95),
    ("mit-0", "mit no attribution", "no attribution", 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 0.95),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee", "permission to use", 0.95),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use", 0.93),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation", "permission to use", 0.93),
    ("bsd", "redistributions? (?:and use )?in source and binary forms with or without modification", "redistribution", 0.97),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistribution", 0.95),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistribution", 0.95),
    ("bsd", "(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:new |modified |simplified )?bsd", "bsd", 0.9),
    ("bsd", "bsd style licen[sc]e", "bsd style", 0.85),
    ("bsd-3", "neither the name of (?:\\S+ ){1,8}nor the names of its contributors", "contributors", 0.95),
    ("bsd-3", "may be used to endorse or promote products derived from this software", "endorse or promote", 0.93),
    ("bsd-4", "all advertising materials mentioning features or use of this software", "advertising materials", 0.95),
    ("bsd-0", "zero clause bsd", "clause bsd", 0.95),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation", 0.95),
    ("apache-2", "licensed under the apache licen[sc]e version 2 0", "apache", 0.98),
    ("apache-2", "www apache org licen[sc]es licen[sc]e 2 0", "apache org", 0.97),
    ("apache-2", "you may not use this file except in compliance with the licen[sc]e", "compliance with the licen", 0.95),
    ("apache-2", "apache 2 0 licen[sc]ed?", "apache 2", 0.95),
    ("apache", "(?:released|licensed|distributed|available) under (?:the )?apache", "apache", 0.9),
    ("zlib", "this software is provided as is without any express or implied warranty", "implied warrant", 0.9),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable", 0.9),
    ("zlib", "altered source versions must be plainly marked as such", "altered source versions", 0.97),
    ("zlib", "this notice may not be removed or altered from any source distribution", "removed or altered", 0.95),
    ("boost", "distributed under the boost software licen[sc]e", "boost", 0.97),
    ("boost", "boost org licen[sc]e 1 0 txt", "boost org", 0.97),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered", 0.98),
    ("unlicense", "unlicense org", "unlicense", 0.9),
    ("wtfpl", "you just do what the fuck you want to", "what the fuck", 0.95),
    ("beerware", "the beer ?ware licen[sc]e", "licen", 0.95),
    ("beerware", "you can buy me a beer in return", "buy me a beer", 0.9),
    ("curl", "curl licen[sc]e", "curl licen", 0.9),
    ("libpng", "libpng licen[sc]e", "libpng licen", 0.9),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 0.95),
    ("openssl", "openssl licen[sc]e", "openssl", 0.9),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic software", 0.95),
    ("freetype", "freetype (?:project )?licen[sc]e", "freetype", 0.9),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group", 0.95),
    ("unicode", "unicode (?:data files and software )?licen[sc]e(?: agreement)?", "unicode", 0.85),
    ("icu", "icu licen[sc]e", "icu licen", 0.9),
    ("vim", "vim licen[sc]e", "vim licen", 0.9),
    ("ruby", "ruby s licen[sc]e|ruby licen[sc]e", "ruby", 0.85),
    ("blueoak", "blue oak model licen[sc]e", "blue oak", 0.95),
    ("psf", "psf licen[sc]e agreement for python", "psf licen", 0.95),
    # copyleft
    ("gpl", "gpl ?v?[123](?: 0)?(?: only| or later)?", "gpl", 0.9),
    ("gpl", "gplv[123]\\+?", "gplv", 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it", "free software", 0.95),
    ("gpl", "it under the terms of the gnu general public licen[sc]e", "general public", 0.97),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e", "general public", 0.97),
    ("gpl", "gnu org licen[sc]es gpl(?: [123] 0)?", "gnu org", 0.95),
    ("gpl", "(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl", "gpl", 0.9),
    ("gpl-or-later", "either version [123] of the licen[sc]e or at your option any later version", "later version", 0.95),
    ("gpl-exception", "gpl linking exception", "linking exception", 0.9),
    ("gpl-exception", "classpath exception", "classpath exception", 0.9),
    ("lgpl", "lgpl ?v?[23](?: [01])?(?: only| or later)?", "lgpl", 0.9),
    ("lgpl", "it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "general public", 0.97),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "general public", 0.97),
    ("lgpl", "gnu org licen[sc]es lgpl", "gnu org", 0.95),
    ("agpl", "agpl ?v?[13](?: 0)?(?: only| or later)?", "agpl", 0.9),
    ("agpl", "it under the terms of the gnu affero general public licen[sc]e", "affero", 0.97),
    ("agpl", "interacting with it remotely through a computer network", "interacting with it remotely", 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", "free documentation", 0.97),
    ("gfdl", "with no invariant sections", "invariant sections", 0.9),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mozilla", 0.98),
    ("mpl", "mozilla org mpl", "mozilla org", 0.93),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e", "mozilla", 0.95),
    ("epl", "eclipse org legal epl", "eclipse org", 0.95),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", "accompanying materials", 0.95),
    ("cecill", "cecill(?: [abc])?(?: licen[sc]e)?", "cecill", 0.9),
    ("eupl", "licensed under the eupl", "eupl", 0.95),
    ("copyleft", "copyleft licen[sc]e", "copyleft", 0.7),
    ("copyleft", "strong copyleft", "copyleft", 0.6),
    ("copyleft", "share alike licen[sc]e", "share alike", 0.7),
    # content and data
    ("cc0", "creative commons zero", "creative commons", 0.95),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 0.9),
    ("cc0", "waived all copyright and related or neighboring rights", "neighboring rights", 0.95),
    ("cc", "creativecommons org licen[sc]es \\S+", "creativecommons org", 0.93),
    ("cc", "creativecommons org publicdomain \\S+", "creativecommons org", 0.93),
    ("cc", "(?:licensed|released|available) under (?:a |the )?creative commons", "creative commons", 0.9),
    ("cc", "some rights reserved creative commons", "rights reserved", 0.9),
    ("cc", "this work is licensed under a creative commons", "creative commons", 0.95),
    ("cc-nc", "for non ?commercial use only", "commercial use only", 0.7),
    ("cc-nc", "not for commercial use", "commercial use", 0.6),
    ("cc-nd", "no derivative works", "derivative works", 0.6),
    ("odbl", "opendatacommons org licen[sc]es odbl", "opendatacommons", 0.95),
    ("odbl", "contains information from (?:\\S+ ){1,8}which is made available here under the open database licen[sc]e", "open database", 0.95),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain", 0.9),
    ("public-domain", "(?:is|are) in the public domain", "public domain", 0.8),
    ("public-domain", "public domain mark", "public domain", 0.85),
    ("public-domain", "no known copyright(?: restrictions)?", "no known copyright", 0.8),
    ("public-domain", "copyright (?:has )?expired", "copyright", 0.7),
    ("public-domain", "not subject to copyright", "subject to copyright", 0.8),
    ("gutenberg", "project gutenberg licen[sc]e", "gutenberg licen", 0.95),
    ("gutenberg", "this ebook is for the use of anyone anywhere", "this ebook", 0.95),
    ("ofl", "this font software is licensed under the sil open font", "open font", 0.97),
    ("ogl-uk", "contains public sector information licensed under the open government", "open government", 0.95),
    ("ogl-uk", "crown copyright", "crown copyright", 0.8),
    # warranty
    ("warranty", "without warrant(?:y|ies) of any kind", "warrant", 0.6),
    ("warranty", "(?:provided )?as is without (?:any )?warrant(?:y|ies)", "warrant", 0.6),
    ("warranty", "merchantability or fitness for a particular purpose", "merchantability", 0.6),
    ("warranty", "merchantability fitness for a particular purpose and non ?infringement", "merchantability", 0.6),
    ("warranty", "any express or implied warranties including but not limited to", "implied warrant", 0.6),
    ("warranty", "no warrant(?:y|ies) (?:is|are) (?:given|made|provided)", "warrant", 0.5),
    ("warranty", "disclaims? all warrant(?:y|ies)", "warrant", 0.6),
    ("warranty", "limitation of liability", "of liability", 0.4),
    ("warranty", "in no event shall (?:the )?(?:\\S+ ){1,8}be liable", "be liable", 0.5),
    # ownership
    ("copyright", "copyright (?:c )?(?:©)? ?(?:19|20)[0-9]{2}", "copyright", 0.7),
    ("copyright", "© ?(?:19|20)[0-9]{2}", "©", 0.7),
    ("copyright", "copyright holders?", "copyright holder", 0.4),
    ("copyright", "copyright notice", "copyright notice", 0.4),
    ("copyright", "copyright (?:is )?(?:owned|held) by", "copyright", 0.7),
    ("copyright", "all copyrights? (?:and trademarks? )?(?:are|is) (?:the )?propert(?:y|ies)", "copyright", 0.7),
    ("copyright", "protected by copyright(?: law)?s?", "protected by copyright", 0.7),
    ("copyright", "subject to copyright", "subject to copyright", 0.6),
    ("copyright", "copyrighted (?:material|work)s?", "copyrighted", 0.6),
    ("proprietary", "proprietary and confidential", "proprietary", 0.8),
    ("proprietary", "confidential and proprietary", "proprietary", 0.8),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution)", "unauthori", 0.7),
    ("proprietary", "no part of this (?:publication|book|work|document) may be reproduced", "reproduced", 0.9),
    ("proprietary", "may not be reproduced (?:or distributed )?without (?:prior )?(?:written )?permission", "reproduced", 0.9),
    ("proprietary", "may not be copied (?:or )?(?:distributed|redistributed)?", "not be copied", 0.6),
    ("proprietary", "reproduction (?:in whole or in part )?(?:is )?(?:strictly )?prohibited", "prohibited", 0.7),
    ("proprietary", "redistribution (?:is )?(?:strictly )?(?:not permitted|prohibited|forbidden)", "redistribution", 0.8),
    ("proprietary", "without (?:the )?(?:express|prior) written permission", "written permission", 0.6),
    ("proprietary", "without (?:the )?(?:express|prior) written consent", "written consent", 0.6),
    ("proprietary", "trade secrets? of", "trade secret", 0.6),
    ("proprietary", "end user licen[sc]e agreement", "licen", 0.8),
    ("proprietary", "this software is licensed not sold", "not sold", 0.9),
    ("proprietary", "evaluation licen[sc]e", "evaluation licen", 0.6),
    ("proprietary", "commercial licen[sc]e", "commercial licen", 0.5),
    ("proprietary", "patents? pending", "pending", 0.4),
    ("trademark", "registered trademarks? of", "trademark", 0.5),
    ("trademark", "trademarks? (?:are|is) (?:the )?propert(?:y|ies) of (?:its|their) respective owners?", "trademark", 0.6),
    ("reserved", "some rights reserved", "rights reserved", 0.7),
    ("reserved", "no rights reserved", "rights reserved", 0.7),
    ("reserved", "rights of the author are reserved", "are reserved", 0.6),
    ("reserved", "alle rechte vorbehalten", "rechte vorbehalten", 0.8),
    ("reserved", "todos los derechos reservados", "reservados", 0.8),
    ("reserved", "tous droits réservés", "droits réserv", 0.8),
    # pointers
    ("spdx", "spdx licen[sc]e identifier \\S+", "spdx", 0.9),
    ("spdx", "spdx filecopyrighttext", "spdx", 0.8),
    ("dual", "dual licensed under", "dual licen", 0.8),
    ("licensed", "licensed under the (?:\\S+ ){1,6}licen[sc]e", "licensed under", 0.5),
    ("licensed", "(?:released|distributed) under the terms of", "under the terms", 0.4),
    ("licensed", "see (?:the )?(?:file )?licen[sc]e(?: txt| md)? for (?:more )?(?:details|information)", "licen", 0.6),
    ("licensed", "see the accompanying licen[sc]e", "accompanying licen", 0.6),
    ("licensed", "subject to the (?:following )?(?:licen[sc]e|terms and conditions)", "subject to the", 0.4),
    ("licensed", "under an? open source licen[sc]e", "open source licen", 0.6),
    ("licensed", "licen[sc]e agreement", "licen", 0.4),
    ("licensed", "licen[sc]e terms", "licen", 0.4),
    ("licensed", "royalty free", "royalty free", 0.4),
    ("licensed", "used (?:here )?(?:with|by) permission", "permission", 0.5),
    ("licensed", "reprinted (?:with|by) (?:kind )?permission", "permission", 0.6),
)
#: A text that a rule can match holds one of these words, or one of the pieces, which
#: may stand inside of a word; "cc by" has a regex of its own.
GATE_WORDS = (
    "license licence licenses licences licensed licenced unlicense reserved reservados rechte copyright copyrights copyrighted filecopyrighttext copyleft copied domain publicdomain spdx "
    "warranty warranties merchantability liability liable redistribution redistributions redistribute endorse advertising proprietary prohibited unauthorized unauthorised reproduced "
    "bsd commons creativecommons opendatacommons creative granted permission unencumbered contributors terms restriction attribution apache altered boost fuck beer openssl cryptographic jpeg "
    "royalty classpath interacting invariant mozilla eclipse accompanying cecill eupl alike sharealike neighboring derivative commercial noncommercial ebook secret secrets consent pending trademark trademarks droits"
).split()
GATE_PIECES = ("©", "cc0", "gpl")
#: Rules are tried in groups, those behind one of these pieces together.
GATE = (
    "licen", "reserv", "rechte", "copyright", "copyleft", "copied", "©", "domain", "gpl", "cc0", "spdx", "warrant", "merchantab", "liab", "redistrib", "endorse", "advertising", "proprietary", "prohibited", "unauthori", "reproduced",
    "bsd", "commons", "creative", "granted", "permission", "unencumbered", "contributors", "terms", "restriction", "attribution", "apache", "altered", "boost", "fuck", "beer", "openssl", "cryptographic", "jpeg",
    "royalty", "classpath", "interacting", "invariant", "mozilla", "eclipse", "accompanying", "cecill", "eupl", "alike", "neighboring", "derivative", "commercial", "ebook", "secret", "consent", "pending", "trademark", "droits",
)
GATE_CC = r"(?i)(?<![a-z0-9])cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


def rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(label, regex, keyword, priority, weight, base), base rules first, then by priority."""
    out = [(label, phrase, phrase, 100, 0.6, True) for phrase, label in BASE]
    for label, name, versions, word in FAMILIES:
        for v in versions:
            full = f"{label}-{v.removesuffix(' 0').replace(' ', '.')}" if v else label
            tail = f"(?: version)? v?{v}(?! [0-9])" if v else ""
            out.append((full, f"{name}{tail}", word, 60 if v else 40, 0.95 if v else 0.8, False))
            if v:
                out.append((f"{full}-or-later", f"{name}{tail}(?: or (?:\\(?at your option\\)? )?(?:any )?later(?: version)?)", word, 80, 0.97, False))
    for part, words in CC_PARTS:
        for v in CC_VERSIONS:
            full, tail = (f"cc-{part}-{v.replace(' ', '.')}", f" {v}") if v else (f"cc-{part}", "")
            out.append((full, f"cc {part.replace('-', ' ')}{tail}(?! [0-9])", "cc by", 60 + 5 * part.count("-") + 10 * bool(v), 0.9, False))
            out.append((full, f"creative commons {words}(?: licen[sc]e)?{tail}(?! [0-9])", "creative commons", 60 + 5 * part.count("-") + 10 * bool(v), 0.95, False))
    out += [(label, regex, word, 50, weight, False) for label, regex, word, weight in NOTICES]
    return out


def n_words(pieces: Column) -> Column:
    """How many words there are among the pieces between separators: all but empty ones at the ends."""
    last = F.element_at(pieces, -1) == ""
    return F.size(pieces) - (pieces[0] == "").cast("int") - (last & (F.size(pieces) > 1)).cast("int")


def normal_form(text: Column) -> Column:
    """' w0 w1 ... ', lower-cased A-Z: one space before and after each word, where there are any."""
    return ascii_lower(F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), SEPARATORS, " "))


#: What stands before and after a match; no word holds it.
_OPEN, _CLOSE = "\x01", "\x02"


def _must(regex: str) -> str:
    """A regex without its optional parts and alternatives."""
    return re.sub(r"\(\?:[^()]*\)\??", "", regex) if "|" not in re.sub(r"\([^()]*\)", "", regex) else ""


def _marked(norm: str) -> str:
    """SQL for the rules that match ``norm``: m, the form with all matches marked, and the rule's own values.

    Regexes are literals, compiled once for each task; a keyword guards all of its rules.
    """
    levels = sorted({priority for _, _, _, priority, _, _ in rules()})
    gated: dict[str, dict[str, list[str]]] = {}
    for label, regex, word, priority, weight, base in rules():
        gate = next((g for g in GATE if g in word), next((g for g in GATE if g in _must(regex)), word))
        found = f"named_struct('m', regexp_replace({norm}, r'(?<= )(?:{regex})(?= )', '{_OPEN}$0{_CLOSE}'), 'level', {levels.index(priority)}, 'label', '{label}', 'weight', {weight}D, 'base', {str(base).lower()})"
        gated.setdefault(gate, {}).setdefault(word, []).append(found)

    def either(cases: list[str]) -> str:
        return f"flatten(filter(array({', '.join(cases)}), x -> x is not null))"

    of_word = lambda word, found: f"case when contains({norm}, '{word}') then array({', '.join(found)}) end"
    of_gate = [f"case when contains({norm}, '{gate}') then {either([of_word(w, f) for w, f in words.items()])} end" for gate, words in gated.items()]
    return f"filter({either(of_gate)}, x -> contains(x.m, '{_OPEN}'))"


def detect(norm: str) -> Column:
    """Array of the detections that stay, over the column of a text's normal form.

    Word intervals come from the places of the marks among the words. A sweep by start,
    longer ones first, keeps for each level of priority the interval that reaches
    furthest: whatever lies inside of another lies inside of one of those.
    """
    start = f"filter(transform(split(r.m, ' '), (w, i) -> if(startswith(w, '{_OPEN}'), i - 1, -1)), x -> x >= 0)"
    end = f"filter(transform(split(r.m, ' '), (w, i) -> if(endswith(w, '{_CLOSE}'), i, -1)), x -> x >= 0)"
    one = "named_struct('start', cast(a as bigint), 'nend', cast(-b as bigint), 'nlevel', -r.level, 'label', r.label, 'weight', r.weight, 'base', r.base)"
    # inside of a lambda, so that the many rules are not one huge generated method
    found = F.expr(f"flatten(transform(array({norm}), n -> flatten(transform({_marked('n')}, r -> zip_with({start}, {end}, (a, b) -> {one})))))")
    n_levels = len({priority for _, _, _, priority, _, _ in rules()})
    kind = "struct<start:bigint,nend:bigint,nlevel:int,label:string,weight:double,base:boolean>"
    far = F.array_repeat(F.struct(F.lit(-1).cast("long").alias("end"), F.lit(-1).cast("long").alias("start")), n_levels)
    first = F.struct(far.alias("far"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        at, end, reach = -d["nlevel"], -d["nend"], acc["far"]
        same = reach[at]
        higher = F.exists(F.slice(reach, at + 2, F.lit(n_levels)), lambda x: x["end"] >= end)
        gone = ~d["base"] & (higher | (same["end"] > end) | ((same["end"] == end) & (same["start"] < d["start"])))
        further = F.transform(reach, lambda x, i: F.when(i == at, F.struct(end.alias("end"), d["start"].alias("start"))).otherwise(x))
        return F.struct(F.when(~d["base"] & (end > same["end"]), further).otherwise(reach).alias("far"), F.when(gone, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(F.array_sort(found), first, step, lambda acc: acc["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) -> rid, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row per input row, in one pass without a shuffle. A null or empty text, or one
    without words, has 0 words, no labels ('') and score 0. The score is the chance
    that at least one label holds, were the rules' weights independent chances.
    Repeated rows are so many rows. A very long text is scanned whole, in time that
    grows with its length and with its matches. An empty table gives no rows.
    """
    rows = with_rid(stored(docs.select("doc_id", "text"))).select("rid", "doc_id", "text", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.select("rid", "doc_id", "text", "low", F.split("low", SEPARATORS).alias("pieces"))
    hit = F.arrays_overlap("pieces", F.array(*map(F.lit, GATE_WORDS)))
    for piece in GATE_PIECES:
        hit = hit | F.contains("low", F.lit(piece))
    hit = hit | (F.contains("low", F.lit("cc")) & F.rlike("text", F.lit(GATE_CC)))
    rows = rows.select("rid", "doc_id", n_words(F.col("pieces")).cast("long").alias("n_words"), F.when(hit, normal_form(F.col("text"))).alias("norm"))
    rows = rows.select("rid", "doc_id", "n_words", F.when(F.col("norm").isNotNull(), detect("norm")).alias("found"))
    base = F.filter("found", lambda d: d["base"])
    best = F.transform(F.array_distinct(F.transform("found", lambda d: d["label"])), lambda x: F.array_max(F.transform(F.filter("found", lambda d: d["label"] == x), lambda d: d["weight"])))
    names = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ","), F.lit(""))
    return rows.select(
        "rid",
        "doc_id",
        "n_words",
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(F.round(1 - F.aggregate(best, F.lit(1.0), lambda acc, w: acc * (1 - w)), 9), F.lit(0.0)).alias("score"),
    )
