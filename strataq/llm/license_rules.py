"""Signature rules of the license scan: (label, keyword, regex, priority, confidence).

Regexes are written for a text's normalised words, each followed by one space and the
first preceded by one. Priority: 3 names an exact version or identifier, 2 a
family in a sentence of licensing, 1 a bare name.
"""

from __future__ import annotations

#: Label -> (keyword that begins a word of every match, patterns of the license's name as words).
NAMES = {
    "afl-3.0": ("academic", ["academic free license(?: v| version)? 3(?: 0)?"]),
    "agpl-1.0": ("affero", ["affero general public license(?: v| version)? 1(?: 0)?"]),
    "agpl-3.0": ("agpl", ["agpl ?v?(?: version)? ?3(?: 0)?", "agplv3"]),
    "agpl-3.0-name": ("affero", ["gnu affero general public license(?: v| version)? 3(?: 0)?"]),
    "apache-1.0": ("apache", ["apache(?: software)? license(?: v| version)? 1 0"]),
    "apache-1.1": ("apache", ["apache(?: software)? license(?: v| version)? 1 1"]),
    "apache-2.0": ("apache", ["apache(?: software)? license,?(?: v| version)? 2(?: 0)?", "apache 2(?: 0)? license", "apache v?2(?: 0)?"]),
    "apsl-2.0": ("apple", ["apple public source license(?: v| version)? 2(?: 0)?"]),
    "artistic-1.0": ("artistic", ["artistic license(?: v| version)? 1(?: 0)?"]),
    "artistic-2.0": ("artistic", ["artistic license(?: v| version)? 2(?: 0)?"]),
    "beerware": ("beer", ["beer ?ware license"]),
    "blueoak-1.0.0": ("oak", ["blue oak model license(?: version)? 1(?: 0)*"]),
    "bsd-1-clause": ("bsd", ["bsd 1 clause(?: license)?", "one clause bsd(?: license)?"]),
    "bsd-2-clause": ("bsd", ["bsd 2 clause(?: license)?", "(?:simplified|freebsd) bsd license", "two clause bsd(?: license)?"]),
    "bsd-3-clause": ("bsd", ["bsd 3 clause(?: license)?", "(?:new|modified|revised) bsd license", "three clause bsd(?: license)?"]),
    "bsd-4-clause": ("bsd", ["bsd 4 clause(?: license)?", "(?:original|old) bsd license", "four clause bsd(?: license)?"]),
    "bsl-1.0": ("boost", ["boost software license(?: v| version)?(?: 1(?: 0)?)?"]),
    "busl-1.1": ("business", ["business source license(?: v| version)?(?: 1 1)?"]),
    "catosl-1.1": ("open", ["computer associates trusted open source license(?: version)? 1 1"]),
    "cc-by-1.0": ("creative", ["creative commons attribution(?: license)? 1 0"]),
    "cc-by-2.0": ("creative", ["creative commons attribution(?: license)? 2 0"]),
    "cc-by-2.5": ("creative", ["creative commons attribution(?: license)? 2 5"]),
    "cc-by-3.0": ("creative", ["creative commons attribution(?: license)? 3 0(?: unported)?"]),
    "cc-by-4.0": ("creative", ["creative commons attribution(?: license)? 4 0(?: international)?"]),
    "cc-by-nc-4.0": ("noncommercial", ["creative commons attribution noncommercial(?: license)? 4 0"]),
    "cc-by-nd-4.0": ("noderivatives", ["creative commons attribution noderivatives(?: license)? 4 0"]),
    "cc-by-sa-3.0": ("sharealike", ["creative commons attribution sharealike(?: license)? 3 0"]),
    "cc-by-sa-4.0": ("sharealike", ["creative commons attribution sharealike(?: license)? 4 0"]),
    "cc-by-nc-sa-4.0": ("noncommercial", ["creative commons attribution noncommercial sharealike(?: license)? 4 0"]),
    "cc-by-nc-nd-4.0": ("noncommercial", ["creative commons attribution noncommercial noderivatives(?: license)? 4 0"]),
    "cc0-1.0": ("cc0", ["cc0 1 0(?: universal)?", "cc0 public domain dedication"]),
    "cddl-1.0": ("cddl", ["cddl(?: v| version)? 1(?: 0)?"]),
    "cddl-1.1": ("cddl", ["cddl(?: v| version)? 1 1"]),
    "cddl": ("distribution", ["common development and distribution license"]),
    "cecill-2.1": ("cecill", ["cecill(?: free software)?(?: license)?(?: agreement)?(?: v| version)? 2 1"]),
    "cecill-b": ("cecill", ["cecill b(?: license)?"]),
    "cecill-c": ("cecill", ["cecill c(?: license)?"]),
    "cpal-1.0": ("attribution", ["common public attribution license(?: version)? 1(?: 0)?"]),
    "cpl-1.0": ("public", ["common public license(?: v| version)? 1(?: 0)?"]),
    "ecl-2.0": ("educational", ["educational community license(?: version)? 2(?: 0)?"]),
    "efl-2.0": ("eiffel", ["eiffel forum license(?: version)? 2(?: 0)?"]),
    "elastic-2.0": ("elastic", ["elastic license(?: v| version)? ?2(?: 0)?"]),
    "epl-1.0": ("eclipse", ["eclipse public license(?: v| version)? 1(?: 0)?"]),
    "epl-2.0": ("eclipse", ["eclipse public license(?: v| version)? 2(?: 0)?"]),
    "eupl-1.1": ("european", ["european union public licen[cs]e(?: v| version)? 1 1"]),
    "eupl-1.2": ("european", ["european union public licen[cs]e(?: v| version)? 1 2"]),
    "gfdl-1.2": ("documentation", ["gnu free documentation license(?: v| version)? 1 2"]),
    "gfdl-1.3": ("documentation", ["gnu free documentation license(?: v| version)? 1 3"]),
    "gpl-1.0": ("gnu", ["gnu general public license(?: v| version)? ?1(?: 0)?"]),
    "gpl-2.0": ("gnu", ["gnu general public license(?: v| version)? ?2(?: 0)?", "gnu gpl ?v?2(?: 0)?"]),
    "gpl-3.0": ("gnu", ["gnu general public license(?: v| version)? ?3(?: 0)?", "gnu gpl ?v?3(?: 0)?"]),
    "gpl-2.0-short": ("gpl", ["gpl ?v?2(?: 0)?(?: only)?", "gpl version 2"]),
    "gpl-3.0-short": ("gpl", ["gpl ?v?3(?: 0)?(?: only)?", "gpl version 3"]),
    "hpnd": ("historical", ["historical permission notice and disclaimer"]),
    "ipl-1.0": ("ibm", ["ibm public license(?: version)? 1(?: 0)?"]),
    "isc": ("isc", ["isc license"]),
    "jquery": ("jquery", ["jquery license"]),
    "lgpl-2.0": ("library", ["gnu library general public license(?: v| version)? 2(?: 0)?"]),
    "lgpl-2.1": ("lesser", ["gnu lesser general public license(?: v| version)? 2 1"]),
    "lgpl-3.0": ("lesser", ["gnu lesser general public license(?: v| version)? 3(?: 0)?"]),
    "lgpl-2.1-short": ("lgpl", ["lgpl ?v?2 1", "lgpl version 2 1"]),
    "lgpl-3.0-short": ("lgpl", ["lgpl ?v?3(?: 0)?", "lgpl version 3"]),
    "lppl-1.3c": ("latex", ["latex project public license(?: v| version)? 1 3c?"]),
    "mit-0": ("mit", ["mit no attribution", "mit 0 license"]),
    "mpl-1.0": ("mozilla", ["mozilla public license(?: v| version)? 1(?: 0)?"]),
    "mpl-1.1": ("mozilla", ["mozilla public license(?: v| version)? 1 1"]),
    "mpl-2.0": ("mozilla", ["mozilla public license(?: v| version)? 2(?: 0)?"]),
    "mpl-2.0-short": ("mpl", ["mpl ?v?2(?: 0)?"]),
    "ms-pl": ("microsoft", ["microsoft public license"]),
    "ms-rl": ("microsoft", ["microsoft reciprocal license"]),
    "mulan-2.0": ("mulan", ["mulan (?:permissive software|psl)(?: license)?(?: v)?2?"]),
    "ncsa": ("ncsa", ["university of illinois ncsa open source license", "ncsa license"]),
    "nposl-3.0": ("profit", ["non profit open software license(?: version)? 3(?: 0)?"]),
    "odbl-1.0": ("database", ["open (?:data commons open )?database license(?: v)?(?: 1 0)?"]),
    "ofl-1.1": ("font", ["(?:sil )?open font license(?: v| version)?(?: 1 1)?"]),
    "osl-3.0": ("open", ["open software license(?: v| version)? 3(?: 0)?"]),
    "php-3.01": ("php", ["php license(?: v| version)? ?3(?: 01)?"]),
    "postgresql": ("postgresql", ["postgresql licen[cs]e"]),
    "psf-2.0": ("python", ["python software foundation license(?: version)?(?: 2)?"]),
    "qpl-1.0": ("public", ["q public license(?: version)?(?: 1 0)?"]),
    "ruby": ("ruby", ["ruby license"]),
    "sspl-1.0": ("server", ["server side public license(?: v| version)?(?: 1)?"]),
    "unicode": ("unicode", ["unicode license(?: v3)?(?: agreement)?"]),
    "unlicense": ("unlicense", ["the unlicense", "unlicense org"]),
    "upl-1.0": ("universal", ["universal permissive license(?: v| version)?(?: 1 0)?"]),
    "vim": ("vim", ["vim license"]),
    "w3c": ("w3c", ["w3c software(?: notice)?(?: and)?(?: document)?(?: notice and)? license"]),
    "wtfpl": ("wtfpl", ["wtfpl(?: version)?(?: 2)?"]),
    "wtfpl-name": ("want", ["do what the fuck you want to public license"]),
    "zlib": ("zlib", ["zlib(?: libpng)? license"]),
    "zpl-2.1": ("zope", ["zope public license(?: version)? 2 1"]),
}
#: Phrases of license texts and notices.
NOTICES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "merge", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,400}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "http (?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "apache", "www apache org licenses license 2 0"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "later", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "later", "either version 3 of the license or at your option any later version"),
    ("lgpl", "lesser", "under the terms of the gnu lesser general public license"),
    ("agpl", "affero", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "dedicated", "dedicated the work to the public domain"),
    ("public-domain", "domain", "(?:is|placed|released) (?:in|into|to) the public domain"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty"),
    ("bsl-1.0", "boost", "distributed under the boost software license"),
    ("wtfpl", "want", "you just do what the fuck you want to"),
    ("epl-1.0", "eclipse", "www eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "www eclipse org legal epl 2 0"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc 4 0"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prohibited", "unauthorized (?:copying|use|distribution) .{0,400}?is strictly prohibited"),
]
#: Bare family names.
FAMILIES = [
    ("gpl", "gnu", "gnu general public license"), ("lgpl", "lesser", "lesser general public license"), ("lgpl", "library", "library general public license"), ("agpl", "affero", "affero general public license"),
    ("gfdl", "documentation", "free documentation license"), ("apache", "apache", "apache license"), ("mit", "mit", "mit license"), ("mit", "mit", "licensed under mit"), ("bsd", "bsd", "bsd license"),
    ("mpl", "mozilla", "mozilla public license"), ("epl", "eclipse", "eclipse public license"), ("cc-by", "cc", "cc by"), ("cc-by-sa", "cc", "cc by sa"), ("cc-by-nc", "cc", "cc by nc"), ("cc-by-nd", "cc", "cc by nd"),
    ("cc-by-nc-sa", "cc", "cc by nc sa"), ("cc-by-nc-nd", "cc", "cc by nc nd"), ("cc0", "cc0", "cc0"), ("artistic", "artistic", "artistic license"), ("gpl", "gplv2", "gplv2"), ("gpl", "gplv3", "gplv3"), ("lgpl", "lgplv3", "lgplv3"),
]
_SPDX = "0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 cc0-1.0 cddl-1.0 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3-only gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 osl-3.0 postgresql psf-2.0 python-2.0 ruby sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(id, label, keyword, regex, priority, confidence), in order of definition."""
    out: list[tuple[str, str, str, int, float]] = []
    for label, (kw, patterns) in NAMES.items():
        clean = label.removesuffix("-short").removesuffix("-name")
        for p in patterns:
            out.append((clean, kw, rf"(?<= ){p} (?:or(?: at your option)? (?:any )?later(?: version)? )?", 3, 0.9))
    for label in _SPDX:
        words = label.replace("-", " ").replace(".", " ")
        out.append((label, "spdx", rf"(?<= )spdx license identifier {words} ", 3, 1.0))
        out.append((label, words.split()[0], rf"(?<= )(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{words} (?:license )?", 2, 0.8))
    for label, kw, p in NOTICES:
        out.append((label, kw, rf"(?<= ){p} ", 2, 0.8))
    for label, kw, p in FAMILIES:
        out.append((label, kw, rf"(?<= ){p} ", 1, 0.6))
    return [(i, *r) for i, r in enumerate(out)]
