"""License scan: ordered signature rules behind a keyword gate, overlaps settled by priority and containment.

A signature is a regular expression with a label, a priority and groups of keywords; each of its matches holds one of every group. A text is
lowered (A-Z only, so places stay) and each run of white space, line ends too, becomes one blank, so wrapped texts match
like others; each keyword is looked up once, and only signatures whose keywords occur run. Places are those of the text.
Matches are taken in order of priority, then length, then place; a match inside the interval of one already taken is
suppressed. Beside this, the base phrases of the contract are counted word by word.

Defined results: null text is empty; a text without finds has empty labels, null places and score 0; texts are scanned
whole; repeated rows repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from quire.llm import common
from quire.llm.license_sentences import SENTENCES

#: Fixed values of the contract: phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses by SPDX-like key: (names as regular expressions, words of which every name holds one, versions).
FAMILIES = {
    "apache": (r"apache(?: software)?", ("apache",), ("1.0", "1.1", "2.0")),
    "gpl": (r"(?:gnu )?(?:general public|gpl)", ("general public", "gpl"), ("1.0", "2.0", "3.0")),
    "lgpl": (r"(?:gnu )?(?:lesser|library) general public|(?:gnu )?lgpl", ("lesser general", "library general", "lgpl"), ("2.0", "2.1", "3.0")),
    "agpl": (r"(?:gnu )?affero general public|(?:gnu )?agpl", ("affero general", "agpl"), ("1.0", "3.0")),
    "gfdl": (r"gnu free documentation", ("free documentation",), ("1.1", "1.2", "1.3")),
    "mpl": (r"mozilla public|mpl", ("mozilla public", "mpl"), ("1.0", "1.1", "2.0")),
    "epl": (r"eclipse public|epl", ("eclipse public", "epl"), ("1.0", "2.0")),
    "cddl": (r"common development and distribution|cddl", ("common development", "cddl"), ("1.0", "1.1")),
    "eupl": (r"european union public|eupl", ("european union public", "eupl"), ("1.0", "1.1", "1.2")),
    "osl": (r"open software", ("open software",), ("1.0", "2.0", "2.1", "3.0")),
    "afl": (r"academic free", ("academic free",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": (r"(?:perl )?artistic", ("artistic",), ("1.0", "2.0")),
    "bsl": (r"boost software", ("boost software",), ("1.0",)),
    "busl": (r"business source", ("business source",), ("1.0", "1.1")),
    "mit": (r"(?:mit|expat)", ("mit", "expat"), ()),
    "bsd-2-clause": (r"(?:2|two)[- ]clause bsd|simplified bsd|freebsd", ("bsd",), ()),
    "bsd-3-clause": (r"(?:3|three)[- ]clause bsd|(?:new|modified|revised) bsd", ("bsd",), ()),
    "bsd-4-clause": (r"(?:4|four)[- ]clause bsd|original bsd", ("bsd",), ()),
    "bsd": (r"bsd(?:-style)?", ("bsd",), ()),
    "isc": (r"isc", ("isc",), ()),
    "zlib": (r"zlib(?:/libpng)?", ("zlib",), ()),
    "ncsa": (r"(?:university of illinois/)?ncsa(?: open source)?", ("ncsa",), ()),
    "postgresql": (r"postgresql", ("postgresql",), ()),
    "python": (r"python software foundation|psf", ("python software", "psf"), ("2.0",)),
    "ms-pl": (r"microsoft public", ("microsoft",), ()),
    "ms-rl": (r"microsoft reciprocal", ("microsoft",), ()),
    "unlicense": (r"unlicense", ("unlicense",), ()),
    "wtfpl": (r"wtfpl|do what the f\w+ you want to public", ("wtfpl", "do what the f"), ()),
    "odbl": (r"open database|odbl", ("open database", "odbl"), ("1.0",)),
    "ofl": (r"sil open font|ofl", ("sil open font", "ofl"), ("1.0", "1.1")),
    "elastic": (r"elastic", ("elastic",), ("2.0",)),
    "sspl": (r"server side public", ("server side public",), ("1.0",)),
    "polyform": (r"polyform(?: noncommercial| small business| strict)?", ("polyform",), ("1.0.0",)),
    "rail": (r"(?:open|big\w*|creativeml)(?: open)?[- ]?rail(?:[-+]+m)?", ("rail",), ()),
}
CC = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non[- ]?commercial"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Notices without a license's name: label, expression, keyword.
NOTICES = (
    ("all-rights-reserved", r"all rights (?:are )?reserved", "reserved"),
    *(("copyright", mark + r"[ \t]*(?:\(c\)|©)?[ \t]*(?:19|20)\d\d(?:[ \t]*[-–,][ \t]*(?:19|20)\d\d)*", word) for mark, word in (("copyright", "copyright"), ("©", "©"), (r"\(c\)", "(c)"))),
    ("public-domain", r"(?:released (?:in)?to|dedicated to|in) the public domain|public domain dedication", "public domain"),
    ("cc0-1.0", r"\bcc0(?:[- ]1\.0)?\b", "cc0"),
    ("cc0-1.0", r"creativecommons\.org/publicdomain/zero", "publicdomain/zero"),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", "redistribution and use"),
    ("warranty-disclaimer", r"provided [\"'“”]?as is[\"'“”]?,? without warrant(?:y|ies)", "as is"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", "proprietary"),
    ("proprietary", r"do not (?:copy|distribute|redistribute)", "do not "),
    ("non-commercial", r"(?:for )?non[- ]?commercial (?:use|purposes) only", "commercial"),
    ("permission-required", r"(?:without|with) (?:the )?(?:prior|express|written)[\w, ]{0,30} permission of", "permission of"),
    ("permission-required", r"(?:without|with) (?:the )?(?:prior|express|written)[\w, ]{0,30} consent of", "consent of"),
)


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int  # larger wins
    keywords: tuple[tuple[str, ...], ...]  # each match holds one of every group
    pattern: re.Pattern


@lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """All rules, most specific first: tags and links, versioned names, names, notices."""
    out = []

    def rule(label: str, priority: int, pattern: str, *keywords: tuple[str, ...]) -> None:
        out.append(Signature(label, priority, keywords, re.compile(pattern)))

    gap, the = r"[ \t,]+(?:software )?licen[cs]e[ \t,(]*", r"(?:under|by)[ \t]+(?:the[ \t]+)?(?:terms of (?:the )?)?"
    for key, (name, word, versions) in FAMILIES.items():
        for v in versions:
            short = v.removesuffix(".0").replace(".", r"\.") + (r"(?:\.0)?" if v.endswith(".0") else "")
            tail = rf"(?:version|v\.?)?[ \t]*{short}(?![\d.]*\d)"
            rule(f"{key}-{v}", 90, rf"spdx-license-identifier:[ \t]*{key}-{re.escape(v)}(?:-only|-or-later|\+)?(?![\w.])", ("spdx",))
            rule(f"{key}-{v}", 80, rf"\b(?:licensed|released|distributed|available)[ \t]+{the}(?:{name}){gap}{tail}", word, ("licen",))
            rule(f"{key}-{v}", 70, rf"\b(?:{name})(?:{gap}|[ \t]*[-v]+[ \t]*){tail}", word)
        rule(key, 85, rf"spdx-license-identifier:[ \t]*{re.escape(key)}(?![\w.])", ("spdx",))
        rule(key, 60, rf"\b(?:{name})[ \t,]+(?:software )?licen[cs]e\b", ("licen",), word)
        rule(key, 50, rf"\blicen[cs]ed[ \t]+{the}(?:{name})\b", ("licen",), word)
        rule(key, 45, rf"(?:opensource|spdx)\.org/licenses?/{re.escape(key)}\b", ("license/", "licenses/"))
    for kind in CC:
        dashed = kind.replace("-", r"[- ]")
        words = r"[- ,]*".join(CC_WORDS[w] for w in kind.split("-"))
        for v in CC_VERSIONS:
            v_ = re.escape(v)
            rule(f"cc-{kind}-{v}", 88, rf"creativecommons\.org/licenses/{kind}/{v_}", ("creativecommons",))
            rule(f"cc-{kind}-{v}", 78, rf"\bcc[- ]{dashed}[- ]v?{v_}(?![\d.]*\d)", ("cc",))
            rule(f"cc-{kind}-{v}", 76, rf"creative commons[- ]+{words}[ \w]{{0,15}}[ \t]{v_}(?![\d.]*\d)", ("creative commons",))
        rule(f"cc-{kind}", 58, rf"\bcc[- ]{dashed}\b(?![- ](?:nc|sa|nd)\b)", ("cc",))
        rule(f"cc-{kind}", 56, rf"creative commons[- ]+{words}(?![- ,]*(?:{CC_WORDS['nc']}|{CC_WORDS['sa']}|{CC_WORDS['nd']}))", ("creative commons",))
    for i, (label, pattern, keyword) in enumerate(NOTICES):
        rule(label, 40 - i, pattern, (keyword,))
    for label, priority, pattern, keyword in SENTENCES:
        rule(label, priority, pattern, tuple(keyword.split("|")))
    return tuple(sorted(out, key=lambda s: -s.priority))


def lowered(text: str) -> str:
    """A-Z lowered, everything else and every place as it was."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def detections(low: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, priority) of the matches that stand in a lowered text, by place."""
    here: dict[str, bool] = {}
    found = []
    for s in signatures():
        for words in s.keywords:
            ok = here.get(words)
            if ok is None:
                ok = here[words] = any(w in low for w in words)
            if not ok:
                break
        else:
            found += [(s.priority, m.end() - m.start(), m.start(), m.end(), s.label) for m in s.pattern.finditer(low)]
    found.sort(key=lambda d: (-d[0], -d[1], d[2], d[4]))
    taken: list[tuple[str, int, int, int]] = []
    # For each start the farthest end of what is taken there or before, as a Fenwick tree of maxima over the starts.
    starts = sorted({d[2] for d in found})
    farthest = [0] * (len(starts) + 1)
    for priority, _, a, b, label in found:
        at = k = bisect_right(starts, a)
        end = 0
        while k:
            end = max(end, farthest[k])
            k &= k - 1
        if end < b:
            taken.append((label, a, b, priority))
            while at < len(farthest):
                farthest[at] = max(farthest[at], b)
                at += at & -at
    return sorted(taken, key=lambda d: (d[1], d[2], d[0]))


_RUNS = re.compile(r"\s{2,}|[^\S ]")
_FULL = re.compile(r"\S+")


def unwrapped(low: str) -> str:
    """The text with one blank for each run of white space."""
    return _RUNS.sub(" ", low)


def placed(found: list[tuple[str, int, int, int]], low: str) -> list[tuple[str, int, int, int]]:
    """Finds of ``unwrapped(low)`` at their places in low; a blank stands for the first of its run."""
    starts, moved, at = [], [], 0
    for m in _FULL.finditer(low):
        at += bool(moved or m.start())  # the blank before it
        starts.append(at)
        moved.append(m.start() - at)
        at += m.end() - m.start()

    def back(x: int) -> int:
        k = bisect_right(starts, x) - 1
        return x + moved[k] if k >= 0 else x

    return [(label, back(a), back(b - 1) + 1, priority) for label, a, b, priority in found]


_APART = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def base_places(text: str) -> tuple[int, list[int], set[str]]:
    """Number of words, first words of all places of base phrases, their labels."""
    words = text.encode("utf-8", "replace").lower().translate(_APART).split()
    line = b" " + b" ".join(words) + b" "
    found, labels = [], set()
    for phrase, label in BASE.items():
        sought = b" " + phrase.encode() + b" "
        at = line.find(sought)
        while at >= 0:
            found.append(at)
            labels.add(label)
            at = line.find(sought, at + 1)
    places, word, seen = [], 0, 0
    for at in sorted(found):  # words counted once, from place to place
        word += line.count(b" ", seen, at)
        seen = at
        places.append(word)
    return len(words), places, labels


def scan(text: str | None) -> dict:
    """What the query returns of one text, and the detections with their spans."""
    text = text or ""
    n_words, places, base = base_places(text)
    low = lowered(text)
    plain = unwrapped(low)
    found = detections(plain)
    if found and plain != low:
        found = placed(found, low)
    score = max([f[3] / 100 for f in found] + [0.6] * bool(base), default=0.0)
    return {
        "n_words": n_words, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {f[0] for f in found})), "score": score, "found": found,
    }


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the columns of ``scan`` and ``found``: array of (label, start, end, priority) in code points of the text."""

    def run(x: dict[str, list]) -> dict:
        rows = [scan(t) for t in x["text"]]
        out = {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        spans = [[{"label": f[0], "start": f[1], "end": f[2], "priority": f[3]} for f in r["found"]] for r in rows]
        return {"doc_id": x["doc_id"], **out, "found": spans}

    return common.text_map(docs, ["doc_id", "text"], run, f"doc_id long, {COLUMNS}, found array<struct<label: string, start: int, end: int, priority: int>>")
