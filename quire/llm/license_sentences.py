"""What licenses say of themselves, written by hand, license by license.

Each line: label, priority, expression over lowered text with single blanks, and a word (or several, of which one) that every match holds. Links stand
first, then names whose number or version comes behind "license", then sentences of the licenses' own texts.
"""

SENTENCES = (
    # Apache
    ("apache-2.0", 92, r"apache\.org/licenses/license-2\.0", "apache.org"),
    ("apache-1.1", 92, r"apache\.org/licenses/license-1\.1", "apache.org"),
    ("apache-1.0", 92, r"apache\.org/licenses/license-1\.0", "apache.org"),
    ("apache-2.0", 82, r"\bapache[- ]licen[cs]e[, ]+(?:\()?(?:version |v\.? ?)?2(?:\.0)?(?![\d.]*\d)", "apache"),
    ("apache-2.0", 66, r"you may not use this file except in compliance with the license", "in compliance with the license"),
    ("apache-2.0", 64, r"grant of patent license\. subject to the terms and conditions of this license", "grant of patent"),
    ("apache-1.1", 64, r"this product includes software developed by the apache (?:software foundation|group)", "apache"),
    # GNU
    ("gpl-3.0", 92, r"gnu\.org/licenses/gpl-3\.0", "gnu.org"),
    ("gpl-2.0", 92, r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu.org"),
    ("lgpl-3.0", 92, r"gnu\.org/licenses/lgpl-3\.0", "gnu.org"),
    ("lgpl-2.1", 92, r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "gnu.org"),
    ("agpl-3.0", 92, r"gnu\.org/licenses/agpl-3\.0", "gnu.org"),
    ("gfdl-1.3", 92, r"gnu\.org/licenses/fdl-1\.3", "gnu.org"),
    ("gpl", 62, r"gnu\.org/(?:licenses/gpl|copyleft/gpl)(?!-\d)", "gnu.org"),
    ("gpl-3.0", 84, r"(?<![al])gpl[- ,]*(?:version |v\.? ?)3(?:\.0)?(?![\d.]*\d)", "gpl"),
    ("gpl-2.0", 84, r"(?<![al])gpl[- ,]*(?:version |v\.? ?)2(?:\.0)?(?![\d.]*\d)", "gpl"),
    ("lgpl-3.0", 84, r"\blgpl[- ,]*(?:version |v\.? ?)3(?:\.0)?(?![\d.]*\d)", "lgpl"),
    ("lgpl-2.1", 84, r"\blgpl[- ,]*(?:version |v\.? ?)2\.1(?![\d.]*\d)", "lgpl"),
    ("agpl-3.0", 84, r"\bagpl[- ,]*(?:version |v\.? ?)3(?:\.0)?(?![\d.]*\d)", "agpl"),
    ("gpl-3.0", 83, r"(?:the|gnu) general public license as published by the free software foundation[;,] (?:either )?version 3", "as published by the free software"),
    ("gpl-2.0", 83, r"(?:the|gnu) general public license as published by the free software foundation[;,] (?:either )?version 2", "as published by the free software"),
    ("lgpl-2.1", 83, r"lesser general public license as published by the free software foundation[;,] (?:either )?version 2\.1", "as published by the free software"),
    ("lgpl-3.0", 83, r"lesser general public license as published by the free software foundation[;,] (?:either )?version 3", "as published by the free software"),
    ("agpl-3.0", 83, r"affero general public license as published by the free software foundation[;,] (?:either )?version 3", "as published by the free software"),
    ("gpl-3.0", 64, r"gnu general public license version 3, 29 june 2007", "29 june 2007"),
    ("gpl-2.0", 64, r"gnu general public license version 2, june 1991", "june 1991"),
    ("gpl", 48, r"this (?:program|library) is free software[;:,] you can redistribute it and/or modify it", "redistribute it and/or modify"),
    # BSD
    ("bsd-2-clause", 86, r"\bbsd[- ](?:2|two)[- ]clause\b(?:[- ]+(?:\"?simplified\"? )?licen[cs]e)?", "bsd"),
    ("bsd-3-clause", 86, r"\bbsd[- ](?:3|three)[- ]clause\b(?:[- ]+(?:\"?(?:new|revised|modified)\"? (?:or )?){0,2}licen[cs]e)?", "bsd"),
    ("bsd-4-clause", 86, r"\bbsd[- ](?:4|four)[- ]clause\b(?:[- ]+(?:\"?(?:original|old)\"? (?:or )?){0,2}licen[cs]e)?", "bsd"),
    ("0bsd", 86, r"\b0bsd\b|\b(?:zero|0)[- ]clause bsd\b|\bbsd[- ](?:zero|0)[- ]clause\b", "bsd"),
    ("bsd-2-clause", 92, r"opensource\.org/licen[cs]es?/bsd-2-clause", "opensource.org"),
    ("bsd-3-clause", 92, r"opensource\.org/licen[cs]es?/bsd-3-clause", "opensource.org"),
    ("bsd", 44, r"redistributions? (?:in binary form must reproduce|of source code must retain) the above copyright notice", "redistribution"),
    ("bsd-3-clause", 65, r"neither the names? of (?:the )?[\w ,.<>\[\]]{1,80} nor the names of (?:its|their) contributors may be used to endorse", "may be used to endorse"),
    ("bsd-4-clause", 66, r"all advertising materials mentioning features or use of this software must display", "advertising materials"),
    # MIT, ISC and other short ones
    ("mit", 92, r"opensource\.org/licen[cs]es?/mit\b", "opensource.org"),
    ("mit", 49, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "this permission notice shall"),
    ("mit", 47, r"the software is provided [\"'“]?as is[\"'”]?, without warranty of any kind, express or implied", "without warranty of any kind"),
    ("mit-0", 86, r"\bmit[- ]0\b|\bmit no attribution\b", "mit"),
    ("x11", 63, r"\bx11 licen[cs]e\b", "x11"),
    ("isc", 92, r"opensource\.org/licen[cs]es?/isc\b", "opensource.org"),
    ("isc", 47, r"the software is provided [\"'“]?as is[\"'”]? and the author disclaims all warranties", "the author disclaims"),
    ("zlib", 48, r"altered source versions must be plainly marked as such", "altered source versions"),
    ("zlib", 46, r"this notice may not be removed or altered from any source distribution", "this notice may not be"),
    ("unlicense", 92, r"\bunlicense\.org\b", "unlicense"),
    ("unlicense", 67, r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", 67, r"you just do what the f\w+ you want to", "do what the f"),
    ("curl", 63, r"\bcurl licen[cs]e\b", "curl"),
    ("beerware", 67, r"\bbeer-?ware licen[cs]e\b|you can buy me a beer in return", "beer"),
    ("json", 67, r"the software shall be used for good, not evil", "not evil"),
    ("ncsa", 92, r"opensource\.org/licen[cs]es?/(?:uoi-)?ncsa\b", "opensource.org"),
    ("postgresql", 63, r"\bpostgresql licen[cs]e\b", "postgresql"),
    # Weaker copyleft
    ("mpl-2.0", 92, r"mozilla\.org/(?:en-us/)?mpl/2\.0|mozilla\.org/mpl/2\.0", "mozilla.org"),
    ("mpl-1.1", 92, r"mozilla\.org/mpl/(?:mpl-)?1\.1", "mozilla.org"),
    ("mpl-2.0", 83, r"subject to the terms of the mozilla public license, v\. ?2\.0", "mozilla"),
    ("mpl-2.0", 84, r"\bmpl[- ]?(?:v\.? ?)?2(?:\.0)?(?![\d.]*\d)", "mpl"),
    ("epl-2.0", 92, r"eclipse\.org/(?:legal/epl-2\.0|org/documents/epl-2\.0)", "eclipse.org"),
    ("epl-1.0", 92, r"eclipse\.org/(?:legal/epl-v10|org/documents/epl-v10)", "eclipse.org"),
    ("epl-2.0", 82, r"eclipse public licen[cs]e[ ,-]*(?:version |v\.? ?)?2(?:\.0)?(?![\d.]*\d)", "eclipse"),
    ("epl-1.0", 82, r"eclipse public licen[cs]e[ ,-]*(?:version |v\.? ?)?1(?:\.0)?(?![\d.]*\d)", "eclipse"),
    ("cddl-1.0", 82, r"common development and distribution licen[cs]e \(cddl\)[ ,-]*(?:version |v\.? ?)?1\.0", "cddl"),
    ("cddl-1.1", 82, r"common development and distribution licen[cs]e \(cddl\)[ ,-]*(?:version |v\.? ?)?1\.1", "cddl"),
    ("eupl-1.2", 82, r"european union public licen[cs]e[ ,-]*(?:\(eupl\)[ ,-]*)?(?:version |v\.? ?)?1\.2", "european union"),
    ("osl-3.0", 82, r"open software licen[cs]e[ ,-]*(?:version |v\.? ?)3\.0", "open software"),
    ("bsl-1.0", 92, r"boost\.org/license_1_0", "boost.org"),
    ("bsl-1.0", 82, r"boost software licen[cs]e[ ,-]*(?:version |v\.? ?)?1(?:\.0)?(?![\d.]*\d)", "boost"),
    ("artistic-2.0", 82, r"artistic licen[cs]e[ ,-]*(?:version |v\.? ?)?2(?:\.0)?(?![\d.]*\d)", "artistic"),
    ("ms-pl", 82, r"microsoft public licen[cs]e|\bms-pl\b", "microsoft public|ms-pl"),
    ("ms-rl", 82, r"microsoft reciprocal licen[cs]e|\bms-rl\b", "microsoft reciprocal|ms-rl"),
    # Content, data and fonts
    ("cc0-1.0", 92, r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons"),
    ("cc0-1.0", 66, r"creative commons zero|\bcc0 1\.0 universal", "cc0"),
    ("cc0-1.0", 66, r"creative commons zero(?: v?1\.0)?(?: universal)?", "creative commons zero"),
    ("pdm-1.0", 92, r"creativecommons\.org/publicdomain/mark/1\.0", "creativecommons"),
    ("odbl-1.0", 92, r"opendatacommons\.org/licenses/odbl", "opendatacommons"),
    ("odc-by-1.0", 92, r"opendatacommons\.org/licenses/by", "opendatacommons"),
    ("pddl-1.0", 92, r"opendatacommons\.org/licenses/pddl", "opendatacommons"),
    ("odc-by-1.0", 80, r"open data commons attribution licen[cs]e", "open data commons"),
    ("pddl-1.0", 80, r"public domain dedication and licen[cs]e", "public domain dedication and"),
    ("ofl-1.1", 92, r"scripts\.sil\.org/ofl|openfontlicense\.org", "scripts.sil|openfontlicense"),
    ("ofl-1.1", 82, r"sil open font licen[cs]e[ ,-]*(?:\(ofl\)[ ,-]*)?(?:version |v\.? ?)?1\.1", "sil open font"),
    ("ofl-1.1", 48, r"the font software may be modified, altered, or added to", "font software"),
    ("ogl-uk-3.0", 80, r"open government licen[cs]e[ ,-]*(?:version |v\.? ?)?3(?:\.0)?(?![\d.]*\d)", "open government"),
    ("ogl-uk", 60, r"open government licen[cs]e", "open government"),
    # Source-available and model licenses
    ("busl-1.1", 82, r"business source licen[cs]e[ ,-]*(?:\(bsl\)[ ,-]*)?(?:version |v\.? ?)?1\.1|\bbusl-1\.1", "business source|busl"),
    ("sspl-1.0", 82, r"server side public licen[cs]e[ ,-]*(?:\(sspl\)[ ,-]*)?(?:version |v\.? ?)?1(?:\.0)?(?![\d.]*\d)|\bsspl(?:[- ]?v?1(?:\.0)?)?\b", "server side public|sspl"),
    ("elastic-2.0", 82, r"elastic licen[cs]e[ ,-]*(?:version |v\.? ?)?2(?:\.0)?(?![\d.]*\d)", "elastic"),
    ("commons-clause", 80, r"\bcommons clause\b", "commons clause"),
    ("llama", 80, r"\bllama \d(?:\.\d)? community licen[cs]e", "community licen"),
    ("polyform", 62, r"polyformproject\.org/licenses", "polyformproject"),
)
