"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features from its ancestors'
tags and class names, from its text, from the elements around it (their share of the page's words, how much of them is
links, how often they repeat), and from its neighbours; the chain of blocks is labelled main text or not by Viterbi
decoding. The weights are learned by maximum likelihood (forward-backward, Adam) on labelled pages that ``labelled_pages``
lays out: pages of many unlike forms, with telling, foreign, meaningless or no class names, whose every block is known to be
main text or not.

Text rules: scripts, styles and other raw content are no blocks; character references are decoded; white space within a
block becomes one space; empty blocks vanish; blocks join in page order by one line end.

Defined results: null html is empty; a page without main text has the empty text; broken markup (unclosed tags, stray
ends, cut references) is read as browsers do, roughly: a tag without an end is text, elements are nested 512 deep at most and
deeper ones count as their parent; pages of any length are read whole, in time linear in their length; repeated rows
repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quire.llm import common

TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
NAMES = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video select title".split())
#: Raw elements whose text runs to the end of the page where their end tag is missing; others then are as if not there.
ENDLESS = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: A start tag of the key closes an open element of these names.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Words of class names and ids that say what a part of a page is, by feature.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs topbar toolbar skip toc",
    "head": "header masthead head logo brand hero",
    "foot": "footer foot colophon copyright legal",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more trending popular tags tagcloud archive",
    "comment": "comment comments discussion disqus reply replies respond reader readers feedback thread guestbook review reviews",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay privacy warning message announcement disclaimer",
    "form": "form subscribe subscription newsletter signup login search contact",
    "share": "share sharing social follow buttons toolbar",
    "meta": "meta byline author date time credit caption",
    "main": "content main article post entry story body text prose page",
}
HINT_OF = {w: f for f, words in HINTS.items() for w in words.split()}


DEEPEST = 512


class Element:
    """An open block-level element, and what stands in it."""

    __slots__ = ("parent", "tag", "key", "tags", "hints", "label", "blocks", "words", "chars", "linked", "kin", "marks")

    def __init__(self, parent: "Element | None", tag: str, key: str, hints: frozenset[str], label: int):
        self.parent, self.tag, self.key, self.hints, self.label = parent, tag, key, hints, label
        above = parent.tags if parent else frozenset()
        self.tags = above if tag in above else above | {tag}
        self.blocks = self.words = self.chars = self.linked = 0
        self.kin: dict[tuple[str, str], int] = {}  # children by tag and name
        self.marks: list[int] | None = None
        if parent:
            parent.kin[tag, key] = parent.kin.get((tag, key), 0) + 1


@dataclass(slots=True)
class Block:
    text: str
    at: Element
    linked: int  # characters inside links
    words: int

    @property
    def label(self) -> int:
        return self.at.label


def blocks(source: str | None) -> list[Block]:
    out: list[Block] = []
    root = Element(None, "", "", frozenset(), -1)
    elements, stack, open_tags = [root], [root], {}
    parts: list[str] = []
    linked, in_link, deeper = 0, False, 0
    unended: set[str] = set()  # raw elements without a further end tag
    source = source or ""

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                here, n = stack[-1], text.count(" ") + 1
                out.append(Block(text, here, linked, n))
                here.blocks += 1
                here.words += n
                here.chars += len(text)
                here.linked += linked
            parts, linked = [], 0

    def pop(names: Iterable[str], stop: tuple[str, ...] = ()) -> None:
        for x in names:
            if open_tags.get(x):
                break
        else:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                for e in stack[k:]:
                    open_tags[e.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)

    at, n, last = 0, len(source), source.rfind(">")
    while at < n:
        start = source.find("<", at)
        if start < 0 or start > last:
            add(source[at:])
            break
        add(source[at:start])
        nxt = source[start + 1 : start + 2]
        if nxt == "!" or nxt == "?":
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else n
            else:
                at = source.find(">", start) + 1
            continue
        m = TAG.match(source, start)
        if not m:
            if nxt == "/" or nxt.isalpha():  # a quote without an end: the tag ends at the next bracket
                at = source.find(">", start) + 1
            else:
                add("<")
                at = start + 1
            continue
        at = m.end()
        name, inside = m[2].lower(), m[3]
        end = m[1] == "/"
        if name in RAW:
            if not end and not inside.endswith("/"):
                stop = None if name in unended else re.compile(rf"</{name}\b", re.I).search(source, at)
                if not stop:
                    unended.add(name)
                    at = n if name in ENDLESS else at
                else:
                    at = source.find(">", stop.end()) + 1 or n
            continue
        if name in INLINE:
            if name == "a":
                in_link = not end
            elif name == "br":
                add(" ")
            continue
        close()
        in_link = False
        if stack[-1].tag == "option" and not (end and name == "option"):
            pop(("option",))  # an option holds text only, and its end tag is usually left out
        if end:
            if deeper and name == "div":
                deeper -= 1  # of a div that was too deep to open
            else:
                pop((name,))
            continue
        if name in CLOSES:
            pop(CLOSES[name], ("table", "ul", "ol", "div", "article", "section", "body", "td") if name not in ("td", "th", "tr") else ("table",))
        if name in VOID or inside.endswith("/"):
            continue
        if len(stack) > DEEPEST:
            deeper += name == "div"
            continue
        above = stack[-1]
        hints, label, key = above.hints, above.label, ""
        if "=" in inside:
            key = " ".join([a or b or c for a, b, c in NAMES.findall(inside)])
            if key:
                more = {HINT_OF[w] for w in PARTS.findall(key) if w in HINT_OF} if key.islower() else {HINT_OF[w.lower()] for w in PARTS.findall(key) if w.lower() in HINT_OF}
                if not more <= hints:
                    hints = hints | more
            marked = "data-label" in inside and re.search(r"data-label=[\"']([01])", inside)
            label = int(marked[1]) if marked else label
        if name == "option":
            hints = hints | {"form"}
        stack.append(Element(above, name, key, hints, label))
        elements.append(stack[-1])
        open_tags[name] = open_tags.get(name, 0) + 1
    close()
    for e in reversed(elements):  # children come after their parents
        if e.parent:
            e.parent.blocks += e.blocks
            e.parent.words += e.words
            e.parent.chars += e.chars
            e.parent.linked += e.linked
    return out


#: Parts of class names: runs of small letters, a capital before them included.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAGS = "article aside blockquote body caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section table td th tr ul".split()
#: What a text says of its part of the page, by feature: words and phrases, each between non-letters.
SIGNS = {
    "rights": "©|(c)|copyright|all rights|alle rechte|tous droits|derechos reservados|impressum|imprint|terms of|powered by",
    "cookie": "cookie|cookies|privacy|datenschutz|gdpr|consent|confidentialité|privacidad",
    "join": "subscribe|newsletter|sign up|sign in|log in|login|register|abonnieren|abonnez|suscríbete|suscribirse|anmelden|e-mail address|email address",
    "share": "share|follow us|tweet|facebook|twitter|teilen|partager|partagez|compartir|comparte",
    "sell": "advert|advertisement|sponsored|buy now|buy our|buy your|order now|shop now|offer|offers|% off|deal|deals|free shipping|werbung|anzeige|publicité|publicidad|jetzt kaufen|angebot|limited time|click here",
    "talk": "reply|replies|replied|comment|comments|kommentar|kommentare|commentaire|commentaires|comentario|comentarios|says|wrote|schrieb|antworten|répondre|responder|posted by|posted on|likes|votes|responses|discussion",
    "menu": "menu|home|search|startseite|accueil|inicio|suche|skip to|back to top|next|previous|read more",
    "more": "related|you may also|recommended|trending|popular|most read|see also|weitere|mehr zum|à lire|más leídas|latest|archives|archive|tags|categories",
}
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
DIGIT = re.compile(r"\d")
#: What stands between the names of a menu.
PARTED = re.compile(r"[|·•»/]")


@lru_cache(maxsize=1)
def _signs():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in SIGNS.items():
        for w in words.split("|"):
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def sign_of(text: str, words: int) -> str | None:
    """The first sign of the text, if it has one for every fifty words or more: a long text that names a thing once says little
    of its part."""
    low = text.lower()
    first, n = None, 0
    for end, (kind, size) in _signs().iter(low):
        if not low[end + 1 : end + 2].isalpha() and (end < size or not low[end - size].isalpha()):
            first = first or kind
            n += 1
    return first if 50 * n >= words else None


CHECKS = [
    "words<4", "words<10", "words<25", "words>=25", "words>=60", "ends", "links>0", "links>.5", "links>.9", "digits", "first", "last", "bare", "same parent", "bias", "early", "late",
    "after h1", "before h1", "under junk heading", "heading", "prev<4", "prev>=25", "next<4", "next>=25", "prev links", "next links", "around>=15", "around<6", "most of page", "commas",
    *(f"{who} {what}" for who in ("up", "top") for what in ("words>.5", "words>.2", "words<.03", "links>.5", "mean>=20", "mean<6", "one block", "repeats")), "repeats", "after main words", "far after",
    "alone", "only", "few blocks", "short page", "parted", "no junk",
]
FEATURES = {f: i for i, f in enumerate([*(f"in {t}" for t in TAGS), *(f"is {t}" for t in TAGS), *(f"hint {h}" for h in HINTS), *(f"sign {k}" for k in SIGNS), *(f"head sign {k}" for k in SIGNS), *CHECKS])}


def _marks(e: Element, total: int) -> list[int]:
    """Features of all blocks of an element: its tags, hints, and the two elements around it."""
    if e.marks is None:
        names = [f"in {t}" for t in e.tags] + [f"is {e.tag}"] + [f"hint {h}" for h in e.hints]
        if not e.hints:
            names.append("bare")
        if e.parent and e.parent.kin.get((e.tag, e.key), 0) >= 3 and e.tag != "p":
            names.append("repeats")
        up = e.parent
        for who in ("up", "top"):
            if not up:
                break
            share, mean = up.words / max(1, total), up.words / max(1, up.blocks)
            names += [f"{who} words>.5"] * (share > 0.5) + [f"{who} words>.2"] * (0.2 < share <= 0.5) + [f"{who} words<.03"] * (share < 0.03)
            names += [f"{who} links>.5"] * (2 * up.linked > up.chars) + [f"{who} mean>=20"] * (mean >= 20) + [f"{who} mean<6"] * (mean < 6) + [f"{who} one block"] * (up.blocks == 1)
            if up.parent and up.parent.kin.get((up.tag, up.key), 0) >= 2 and up.tag not in ("p", "tr", "td"):
                names.append(f"{who} repeats")
            up = up.parent
        e.marks = [FEATURES[f] for f in names if f in FEATURES]
    return e.marks


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of the features that each block has."""
    out, f = [], FEATURES
    n, total = len(page), sum(b.words for b in page)
    h1 = next((k for k, b in enumerate(page) if b.at.tag == "h1"), None)
    body = [k for k, b in enumerate(page) if b.words >= 25 and 2 * b.linked < len(b.text)]
    longest = max(page, key=lambda b: b.words).at.parent if page else None
    final = body[-1] if body else n
    prose = [k for k, b in enumerate(page) if b.words >= 8 and 2 * b.linked < len(b.text)]
    plain = not any(b.at.hints or b.linked for b in page)
    said = None  # what the last heading or short line says
    for k, b in enumerate(page):
        text, w, size = b.text, b.words, max(1, len(b.text))
        own = list(_marks(b.at, total))
        add = own.append
        add(f["bias"])
        add(f["words<4" if w < 4 else "words<10" if w < 10 else "words<25" if w < 25 else "words>=25"])
        if w >= 60:
            add(f["words>=60"])
        if text[-1] in ".!?…\"”»:":
            add(f["ends"])
        share = b.linked / size
        if share:
            add(f["links>0"])
            if share > 0.5:
                add(f["links>.5"])
                if share > 0.9:
                    add(f["links>.9"])
        sign = sign_of(text, w)
        if sign:
            add(f["sign " + sign])
        head = b.at.tag in HEADS
        if head or w < 5:
            said = sign or (None if head else said)
        if said:
            add(f["head sign " + said])
        if head:
            add(f["heading"])
        if DIGIT.search(text):
            add(f["digits"])
        if text.count(",") + text.count(". ") >= 2:
            add(f["commas"])
        if k == 0:
            add(f["first"])
        else:
            a = page[k - 1]
            if a.at.parent is b.at.parent:
                add(f["same parent"])
            if a.words < 4:
                add(f["prev<4"])
            elif a.words >= 25:
                add(f["prev>=25"])
            if 2 * a.linked > len(a.text):
                add(f["prev links"])
        if k == n - 1:
            add(f["last"])
        else:
            c = page[k + 1]
            if c.words < 4:
                add(f["next<4"])
            elif c.words >= 25:
                add(f["next>=25"])
            if 2 * c.linked > len(c.text):
                add(f["next links"])
        near = page[max(0, k - 2) : k + 3]
        mean = sum(x.words for x in near) / len(near)
        if mean >= 15:
            add(f["around>=15"])
        elif mean < 6:
            add(f["around<6"])
        if 5 * k < n:
            add(f["early"])
        elif 5 * k >= 4 * n:
            add(f["late"])
        if h1 is not None:
            add(f["after h1" if k >= h1 else "before h1"])
        if b.at.parent is longest:
            add(f["most of page"])
        if prose == [k]:
            add(f["alone"])
        if n == 1:
            add(f["only"])
        if n <= 4:
            add(f["few blocks"])
        if total < 80:
            add(f["short page"])
        if w < 12 and len(PARTED.findall(text)) >= 2:
            add(f["parted"])
        if plain:
            add(f["no junk"])
        if k > final:
            add(f["after main words"])
            if k > final + 3:
                add(f["far after"])
        out.append(own)
    return out


@dataclass(frozen=True)
class Chain:
    emit: np.ndarray  # features x 2
    move: np.ndarray  # 2 x 2

    @cached_property
    def pairs(self) -> list[list[float]]:
        return self.emit.tolist()

    def decode(self, page: list[Block]) -> list[int]:
        """Most likely labels (Viterbi)."""
        emit = self.pairs
        scores = [(sum([emit[i][0] for i in f]), sum([emit[i][1] for i in f])) for f in features(page)]
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b > a, d > c))
            s0, s1 = (b if b > a else a) + e0, (d if d > c else c) + e1
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[list[Block]], rounds: int = 160, rate: float = 0.15, ridge: float = 0.002) -> Chain:
    """Maximum likelihood of the pages' labels, all pages at once."""
    pages = [p for p in pages if p]
    longest, nf = max(map(len, pages)), len(FEATURES)
    there = np.arange(longest) < np.array([len(p) for p in pages])[:, None]
    x = np.zeros((int(there.sum()), nf), dtype=np.float32)  # a row for each block, page after page
    for k, f in enumerate(f for p in pages for f in features(p)):
        x[k, f] = 1
    y = np.zeros(there.shape, dtype=np.int64)
    y[there] = [b.label for p in pages for b in p]
    gold = np.eye(2)[y] * there[..., None]
    pairs = there[:, 1:] & there[:, :-1]
    gold_move = np.einsum("nti,ntj->ij", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    w = np.zeros(nf * 2 + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    xt = np.ascontiguousarray(x.T)
    e = np.zeros((*there.shape, 2))
    for step in range(1, rounds + 1):
        emit, move = w[: nf * 2].reshape(nf, 2), w[nf * 2 :].reshape(2, 2)
        e[there] = x @ emit.astype(np.float32)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            a = alpha[:, t - 1, :, None] + move
            now = np.logaddexp(a[:, 0], a[:, 1]) + e[:, t]
            alpha[:, t] = np.where(there[:, t, None], now, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            a = (e[:, t + 1] + beta[:, t + 1])[:, None, :] + move
            beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp(a[..., 0], a[..., 1]), 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        node = np.exp(alpha + beta - z) - gold
        edge = np.exp(alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - z[..., None]) * pairs[..., None, None]
        g = np.concatenate([(xt @ node[there].astype(np.float32)).ravel(), (edge.sum((0, 1)) - gold_move).ravel()]) / len(pages) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(w[: nf * 2].reshape(nf, 2).copy(), w[nf * 2 :].reshape(2, 2).copy())


def labelled_pages(n: int = 1_300, seed: int = 7) -> list[str]:
    """Pages of many forms. Every part has ``data-label``: 1 for main text, 0 for everything else."""
    r = random.Random(seed)
    syllables = "an be co de er fi ga ho in ja ka lo me na or pa qui re sa ti un ve wa".split()

    def words(k: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))

    def sentence(a: int = 4, b: int = 18) -> str:
        return words(r.randint(a, b)).capitalize() + r.choice(".......!?")

    def para(k: int = 4) -> str:
        return " ".join(sentence() for _ in range(r.randint(1, k)))

    def some(tag: str, inner: str, names: str = "", label: int | None = None) -> str:
        attr = f' {r.choice(["class", "id"])}="{names}"' if names else ""
        return f"<{tag}{attr}{'' if label is None else f' data-label={chr(34)}{label}{chr(34)}'}>{inner}</{tag}>"

    def links(k: int) -> str:
        return "".join(some("li", f'<a href="/{words(1)}">{words(r.randint(1, 3))}</a>') for _ in range(k))

    def junk(kind: str) -> str:
        text = r.random()
        body = para(3) if text < 0.5 else f"<p>{para(2)}</p>" * r.randint(1, 3) if text < 0.8 else f"<ul>{links(r.randint(2, 6))}</ul>"
        if kind == "nav":
            return some(r.choice(["nav", "nav", "div", "ul"]), f"<ul>{links(r.randint(3, 9))}</ul>", r.choice(["", "menu", "nav main-menu", "navbar", "breadcrumb", "site-nav"]) or "nav", 0)
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            return some(tag, r.choice([f"<h1>{words(2)}</h1>", f"<p>{sentence()}</p>", words(3), f"<a href='/'>{words(2)}</a>"]), "" if tag == "header" and r.random() < 0.4 else r.choice(["header", "masthead", "site-header", "logo"]), 0)
        if kind == "footer":
            tag = r.choice(["footer", "footer", "footer", "div"])
            return some(tag, r.choice([f"&copy; 2024 {words(2)} &middot; {para(2)}", f"<p>{para(2)}</p>", f"<ul>{links(4)}</ul>"]), "" if tag == "footer" and r.random() < 0.5 else r.choice(["footer", "site-footer", "copyright", "legal"]), 0)
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            return some(tag, f"<h3>{words(2)}</h3>{body}", "" if tag == "aside" and r.random() < 0.4 else r.choice(["sidebar", "widget", "related-posts", "side", "trending", "recommended"]), 0)
        if kind == "ad":
            return some(r.choice(["div", "div", "aside", "section"]), body, r.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "banner", "advertisement"]), 0)
        if kind == "notice":
            return some(r.choice(["div", "div", "section"]), r.choice([f"<p>{para(2)}</p><button>{words(1)}</button>", para(2)]), r.choice(["cookie-notice", "notice", "cookie", "consent", "alert", "gdpr", "popup", "modal"]), 0)
        if kind == "form":
            return some("form", f"<label>{words(2)}</label><input name='q'><p>{sentence()}</p><button>{words(1)}</button>", r.choice(["", "newsletter", "search", "subscribe", "login"]), 0)
        if kind == "share":
            return some("div", f"<ul>{links(4)}</ul>", r.choice(["share", "social", "share-buttons"]), 0)
        items = "".join(some(r.choice(["div", "li", "p", "article"]), f"<p>{para(2)}</p>" if r.random() < 0.5 else para(2), r.choice(["", "comment", "reply"])) for _ in range(r.randint(1, 5)))
        return some(r.choice(["section", "div", "ol", "ul", "div"]), f"<h3>{words(1)}</h3>{items}", r.choice(["comments", "comment-list", "reader-comments", "discussion", "replies", "respond"]), 0)

    def main() -> str:
        parts = [f"<h1>{words(r.randint(1, 10))}</h1>"] if r.random() < 0.9 else []
        if r.random() < 0.2:  # a text of a line
            parts.append(r.choice([f"<p>{sentence(1, 9)}</p>", f"<p>{words(r.randint(1, 8))}</p>", f"<p><b>{sentence(1, 6)}<br>"]))
        for _ in range(r.randint(1, 12) if r.random() < 0.85 or len(parts) < 2 else 0):
            x = r.random()
            if x < 0.62:
                parts.append(f"<p>{para()}</p>" if r.random() < 0.8 else f"<p><b>{para()}<br>")
            elif x < 0.72:
                parts.append(f"<h{r.choice('234')}>{words(r.randint(1, 7))}</h{r.choice('234')}>")
            elif x < 0.78:
                parts.append("<ul>" + "".join(f"<li>{words(r.randint(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.82:
                parts.append(f"<blockquote><p>{para()}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{para()}</blockquote>")
            elif x < 0.85:
                parts.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{r.randint(1, 99)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.88:
                parts.append(f"<pre>{words(6)}</pre>")
            elif x < 0.9:
                parts.append(f"<figure><img src='x.png'><figcaption>{words(6)}</figcaption></figure>")
            elif x < 0.92:  # main text may talk like a footer
                said = r.choice(["All rights reserved.", "Licensed under the MIT License.", f"© {r.randint(1990, 2024)} {words(2)}", f"{sentence()} Share this.", f"Subscribe to our newsletter. {sentence()}", f"{sentence()} Read the comments.", "Cookie policy", f"Log in to {words(2)}."])
                parts.append(f"<p>{said}</p>" if r.random() < 0.7 else f"<li>{said}</li>")
            elif x < 0.95:
                parts.append(f"<div>{para()}</div>")
            else:
                parts.append(some("div", f"<p>{para()}</p>"))
            if r.random() < 0.07:
                parts.append(junk(r.choice(["ad", "ad", "side", "form", "notice", "share"])))
        if r.random() < 0.15:
            parts.append(junk("comments"))
        if r.random() < 0.07:
            parts.insert(0, junk("nav"))
        if r.random() < 0.07:
            parts.append(junk("footer"))
        tag, names = r.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "post"), ("div", "main")])
        return some(tag, "".join(parts), names, 1)

    out = []
    for i in range(n):
        if i % 3 == 2:
            out.append(_plain_form(r, words, sentence, para))
            continue
        if i % 3:
            out.append(_other_form(r, words, sentence, para))
            continue
        before = [junk(k) for k in ("nav", "header", "ad", "notice", "form", "side") if r.random() < 0.45]
        after = [junk(k) for k in ("side", "comments", "ad", "share", "form", "footer", "notice", "nav") if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        middle = main()
        if r.random() < 0.3:
            middle = f"<div class='{r.choice(['wrapper', 'container', 'page', 'layout'])}'>{middle}{''.join(after[:2])}</div>"
            after = after[2:]
        out.append(f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body data-label=\"0\">{''.join(before)}{middle}{''.join(after)}</body></html>")
    return out


def _other_form(r: random.Random, words, sentence, para) -> str:
    """A page whose class names tell little or nothing: random, foreign or none, in one of several layouts."""
    foreign = {
        "nav": "navigation menue hauptmenue navegacion barre-menu", "header": "kopf kopfzeile entete cabecera", "footer": "fuss fusszeile pied pie-de-pagina", "side": "seitenleiste randspalte barre-laterale barra-lateral",
        "ad": "werbung anzeige publicite pub publicidad", "notice": "hinweis avis aviso", "form": "formular formulaire formulario", "comments": "kommentare commentaires comentarios leserbriefe", "share": "teilen partager compartir", "main": "inhalt beitrag contenu contenido cuerpo",
    }
    style = r.choice(["none", "none", "random", "random", "foreign", "short"])

    def named(kind: str) -> str:
        if style == "none":
            return ""
        if style == "random":
            return f' class="{r.choice(["css-", "sc-", "x", "_"])}{r.randrange(16**6):06x}"'
        if style == "foreign":
            return f' class="{r.choice(foreign[kind].split())}"'
        return f' id="{r.choice("abcdefgh")}{r.randint(1, 9)}"'

    def part(kind: str, inner: str, label: int, tag: str = "div") -> str:
        return f'<{tag}{named(kind)} data-label="{label}">{inner}</{tag}>'

    def link(k: int = 2) -> str:
        return f'<a href="/{words(1)}">{words(r.randint(1, k)).capitalize()}</a>'

    def links(k: int) -> str:
        how = r.randrange(4)
        every = [link() for _ in range(k)]
        return [f"<ul>{''.join(f'<li>{x}</li>' for x in every)}</ul>", " | ".join(every), "".join(f"<p>{x}</p>" for x in every), "".join(f"<div>{x}</div>" for x in every)][how]

    year = r.randint(1999, 2025)

    def junk(kind: str) -> str:
        if kind == "nav":
            return part(kind, links(r.randint(3, 9)), 0)
        if kind == "header":
            return part(kind, r.choice([f"<h1>{words(2).title()}</h1>", f"<a href='/'>{words(2).title()}</a>", f"{words(2).title()}<p>{words(r.randint(3, 7))}</p>", f"<h2>{words(2).title()}</h2>{links(4)}"]), 0)
        if kind == "footer":
            said = r.choice([f"&copy; {year} {words(2).title()}", f"Copyright &copy; {year} {words(2)}. All rights reserved.", f"(c) {year} {words(2)} - {r.choice(['Alle Rechte vorbehalten', 'Tous droits réservés', 'Todos los derechos reservados', 'All rights reserved'])}", f"Powered by {words(1).title()}", f"{words(3).title()} &copy; {year} &middot; {link()} &middot; {link()}"])
            return part(kind, r.choice([said, f"<p>{said}</p>", f"{links(3)}<p>{said}</p>", f"<p>{said}</p><p>{sentence()}</p>"]), 0, r.choice(["div", "div", "p", "footer"]))
        if kind == "side":
            title = r.choice([words(2).title(), "Related", "Most read", "Recommended for you", "Categories", "Archives", "Weitere Artikel", "À lire aussi", "Tags", "Latest posts"])
            items = r.choice([links(r.randint(3, 8)), "".join(f"<div>{link(8)}<p>{words(r.randint(4, 12))}</p></div>" for _ in range(r.randint(2, 5)))])
            return part(kind, f"<h{r.choice('234')}>{title}</h4>{items}", 0, r.choice(["div", "div", "aside", "section"]))
        if kind == "ad":
            said = r.choice(["Advertisement", "Sponsored", "Anzeige", "Publicité", "Buy now", "Limited time offer", "Special offer: 50% off", "Shop now and save", "Order now", "Free shipping today", "Click here for deals"])
            return part(kind, r.choice([f"{said}: {words(4)}!", f"<p>{said}</p><p>{link(4)}</p>", f"<a href='/x'>{said} {words(3)}</a>", f"<p>{said} &mdash; {sentence(3, 9)}</p>"]), 0)
        if kind == "notice":
            return part(kind, r.choice([f"<p>We use cookies to {words(6)}.</p><button>OK</button>", f"This site uses cookies. {link()}", f"<p>Wir verwenden Cookies. {sentence()}</p><a href='#'>Akzeptieren</a>", f"<p>We value your privacy. {sentence()}</p><button>Accept</button>"]), 0)
        if kind == "form":
            return part(kind, r.choice([f"<p>Subscribe to our newsletter</p><input><button>Sign up</button>", f"<form><label>{words(1).title()}</label><input><button>Search</button></form>", f"<h3>Newsletter</h3><p>{sentence(4, 9)}</p><form><input><input type=submit></form>", f"<form>Log in <input> <input></form>"]), 0)
        if kind == "share":
            return part(kind, r.choice(["<a href=x>Share</a> <a href=y>Tweet</a> <a href=z>E-mail</a>", "<ul><li><a href=x>Facebook</a></li><li><a href=x>Twitter</a></li></ul>", "<p>Share this:</p><a href=x>Teilen</a>"]), 0)
        tag, how = r.choice(["div", "div", "li", "article", "section", "p"]), r.randrange(4)
        title = r.choice(["Comments", f"{r.randint(1, 30)} Comments", "Kommentare", "Leave a reply", "Responses", "Discussion", "Commentaires", "Comentarios", f"{r.randint(2, 9)} replies"])

        def said() -> str:
            who, when = words(r.randint(1, 2)).title(), r.choice([f"{r.randint(1, 28)} May {year}", f"{r.randint(1, 12)}:{r.randint(10, 59)} pm", f"{r.randint(2, 20)} hours ago", f"{year}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"])
            body = para(r.choice([1, 1, 2, 3]))
            return [f"<b>{who}</b> says: {body}", f"<div>{who} &middot; {when}</div><p>{body}</p><a href='#'>Reply</a>", f"<p>{who} wrote on {when}:</p><p>{body}</p>", f"<h4>{who}</h4><span>{when}</span><p>{body}</p>"][how]

        items = "".join(f"<{tag}{named('comments') if style != 'foreign' else ''}>{said()}</{tag}>" for _ in range(r.randint(1, 7)))
        return part(kind, f"<h{r.choice('234')}>{title}</h3>{items}" + ("<p>Leave a comment</p><form><textarea></textarea><input type=submit></form>" if r.random() < 0.4 else ""), 0)

    def main() -> str:
        out = [f"<h{r.choice('1112')}>{words(r.randint(2, 9)).capitalize()}</h1>"] if r.random() < 0.92 else []
        if r.random() < 0.12:
            out.append(f"<div data-label='1'>{para(r.randint(2, 4))}</div>")
        breaks = r.random() < 0.12
        for _ in range(r.randint(2, 14)):
            x = r.random()
            if breaks:
                out.append(f"{para(3)}<br><br>")
            elif x < 0.68:
                out.append(f"<p>{para(r.choice([2, 3, 4, 5]))}</p>" if r.random() < 0.85 else f"<div>{para(3)}</div>")
            elif x < 0.78:
                out.append(f"<h{r.choice('234')}>{words(r.randint(1, 6)).capitalize()}</h3>")
            elif x < 0.84:
                out.append(f"<{r.choice(['ul', 'ol'])}>" + "".join(f"<li>{words(r.randint(2, 14))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote>{para(2)}</blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{r.randint(1, 99)}</td><td>{words(1)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.94:
                out.append(f"<pre><code>{words(8)}</code></pre>")
            elif x < 0.97:
                out.append(f"<p>{r.choice(['Licensed under the MIT License.', 'All rights reserved.', f'As of {year}, {words(6)}.', 'See the comments in the code.', f'{sentence()} You can subscribe to it.'])}</p>")
            else:
                out.append(f"<p>{para(1)} <a href='/'>{words(2)}</a> {para(1)}</p>")
            if r.random() < 0.05:
                out.append(junk(r.choice(["ad", "ad", "side", "form", "share"])))
        return "".join(out)

    top = [junk(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < (0.7 if k in ("header", "nav") else 0.25)]
    end = [junk(k) for k in ("share", "side", "comments", "ad", "form", "nav", "footer") if r.random() < (0.75 if k == "footer" else 0.35)]
    if r.random() < 0.25:
        r.shuffle(top)
        r.shuffle(end)
    form = r.randrange(6)
    if form == 0:  # a table lays the page out
        side = "".join(f"<td{named('side')} data-label='0'>{links(r.randint(3, 8))}</td>" for _ in range(r.randint(0, 2)))
        middle = f"<table width='100%'><tr>{side}<td{named('main')} data-label='1'>{main()}</td></tr></table>"
    elif form == 1:  # nothing around the text but the body
        out = main()
        return f"<html><body data-label='1'>{''.join(top)}{out}{''.join(end)}</body></html>"
    elif form == 2:
        middle = f"<div{named('main')}><div>{part('main', main(), 1)}</div></div>"
    elif form == 3:
        middle = part("main", main(), 1, r.choice(["main", "article", "section"]))
    elif form == 4:  # text and what stands beside it in one box
        k = r.randint(0, min(2, len(end)))
        middle = f"<div{named('main')} data-label='1'>{main()}{''.join(end[:k])}</div>"
        end = end[k:]
    else:  # sections of one text
        middle = f"<div{named('main')}>" + "".join(part("main", main(), 1, "section") for _ in range(r.randint(2, 3))) + "</div>"
    return f"<html><head><title>{words(3)}</title></head><body data-label='0'>{''.join(top)}{middle}{''.join(end)}</body></html>"


def _plain_form(r: random.Random, words, sentence, para) -> str:
    """A short page with little or nothing around its text, and no names that tell."""
    mark = r.choice(["", "", "css-", "x"])

    def div(inner: str, label: int, tag: str = "div") -> str:
        return f"<{tag}{f' class={mark}{r.randrange(16**5):05x}' if mark else ''} data-label='{label}'>{inner}</{tag}>"

    name = lambda: words(r.randint(1, 2)).title()
    link = lambda k=2: f"<a href='/{words(1)}'>{words(r.randint(1, k)).capitalize()}</a>"
    year = r.randint(1995, 2025)
    bar = r.choice([" | ", " · ", " / ", " • "])

    def menu() -> str:
        entries = ["Home", *(words(1).title() for _ in range(r.randint(2, 4)))]
        return div(r.choice([bar.join(entries), bar.join(f"<a href='/'>{e}</a>" for e in entries), "".join(f"<a href='/'>{e}</a> " for e in entries), f"<ul>{''.join(f'<li><a href=/x>{e}</a></li>' for e in entries)}</ul>"]), 0, r.choice(["div", "div", "p"]))

    def foot() -> str:
        return div(r.choice([f"Copyright {year} {name()} Ltd", f"Copyright {year} {name()}", f"© {year} {name()}. All rights reserved.", f"(c) {year} {name()}", f"{name()} © {year}"]), 0, r.choice(["div", "p"]))

    def notes() -> str:
        head = r.choice([f"{r.randint(1, 9)} comments", "Comments", "Kommentare", "Replies", "Commentaires", "Leave a comment", ""])
        how = r.randrange(4)

        def note() -> str:
            who, said = name(), para(2)
            when = f"{r.randint(1, 28)} {r.choice(['May', 'June', 'March'])} {year}"
            return [f"<b>{who}</b> wrote: {said}", f"<span>{who}, {when}</span><p>{said}</p>", f"<b>{who}</b><p>{said}</p>", f"<p>{who} says: {said}</p>"][how]

        inner = "".join(div(note(), 0) for _ in range(r.randint(1, 5)))
        return div((f"<h{r.choice('34')}>{head}</h3>" if head else "") + inner, 0) if head or how in (0, 3) else div(f"<h3>Comments</h3>{inner}", 0)

    def advert() -> str:
        return div(r.choice([f"<a href='/x'>Buy our {words(1)} now</a>", f"<a href='/x'>{name()}: {r.choice(['order now', 'special offer', 'shop now'])}</a>", f"Advertisement: {words(3)}"]), 0, "p")

    def related() -> str:
        return div(f"<h3>{r.choice(['Related', 'Most read', 'See also', name()])}</h3><ul>{''.join(f'<li>{link(4)}</li>' for _ in range(r.randint(2, 5)))}</ul>", 0)

    def notice() -> str:
        return div(f"<p>We use cookies on this {r.choice(['site', 'page'])}.</p><button>OK</button>", 0)

    def site() -> str:
        return div(f"<a href='/'>{name()}</a>", 0)

    def form() -> str:
        return div(f"<label>E-mail</label><input><button>{r.choice(['Subscribe', 'Sign up'])}</button>", 0, "form")

    tag = r.choice(["p", "p", "p", "div"])
    how = r.random()
    if how < 0.15:  # one paragraph
        text = [f"<p data-label='1'>{para(3)}</p>" if r.random() < 0.6 else para(4)]
    elif how < 0.25:
        text = [f"{para(3)}<br><br>" for _ in range(r.randint(2, 4))]
    else:
        head = [div(words(r.randint(1, 5)).capitalize(), 1, r.choice(["h1", "h1", "h2"]))] if r.random() < 0.85 else []
        text = head + [div(para(r.choice([1, 1, 2, 3])), 1, tag) for _ in range(r.randint(1, 4))]
        if r.random() < 0.15:
            text.insert(1, "<ul data-label='1'>" + "".join(f"<li>{words(r.randint(1, 5))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
        if r.random() < 0.2:
            text.insert(1, f"<h2 data-label='1'>{words(r.randint(1, 3)).capitalize()}</h2>")
        if r.random() < 0.2:
            text = [f"<div>{x}</div>" for x in text]
    before = [f() for f, p in ((notice, 0.1), (site, 0.2), (menu, 0.3)) if r.random() < p]
    after = [f() for f, p in ((advert, 0.12), (related, 0.15), (notes, 0.3), (form, 0.1), (foot, 0.4)) if r.random() < p]
    if how < 0.25 and r.random() < 0.6:  # nothing but the text
        before, after = [], []
    middle = "".join(text)
    for _ in range(r.randint(0, 3)):
        middle = f"<div>{middle}</div>" if not mark else div(middle, 1)
    return f"<html><body data-label='{int(how < 0.25)}'>{''.join(before)}{middle}{''.join(after)}</body></html>"


@lru_cache(maxsize=1)
def model() -> Chain:
    return train([[b for b in blocks(p) if b.label >= 0] for p in labelled_pages()])


def main_text(source: str | None, chain: Chain) -> str:
    page = blocks(source)
    return "\n".join(b.text for b, keep in zip(page, chain.decode(page)) if keep)


def extracted(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (columns page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or model())

    def run(x: dict[str, list]) -> dict:
        text = [main_text(h, shared.value) for h in x["html"]]
        return {"page_id": x["page_id"], "url": x["url"], "text": text, "n_chars": [len(t) for t in text]}

    return common.text_map(pages, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long")
