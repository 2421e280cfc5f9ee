"""Main-text extraction by a recurrent labeller of a page's blocks.

A page is cut into its leaf blocks in order. Each block is a vector: the hashed tags, classes and ids on its path,
what they and the innermost named element say of its role, hashed words, shares of links, case and punctuation, and
its container's share of the page. A bidirectional LSTM in numpy reads the whole sequence and labels every block with
the document around it in view; the blocks it takes for the article's are joined. It is trained here, on N_PAGES pages
built by rule in many layouts (with telling names, with none, with names that mislead), once a process on the driver;
its size has nothing to do with the data. A page of any length is read from end to end by both directions: their
states are carried from one part of a long page to the next.

Cases: null, empty and textless pages give empty texts; unclosed, crossed and broken tags end where the page ends, and
a tag that no > follows is text; pages of any length are read in full, in time linear in it; repeated rows are read one
by one; no rows give no rows; other columns may have any name.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import settled, ship

N_PAGES, EPOCHS, HIDDEN, SEED = 1400, 7, 24, 11
#: Steps, blocks times pages, that are labelled together; a longer page is labelled in parts of PART blocks.
STEPS, PART = 16_384, 4096
#: Characters in which a tag's quotes must close to count; else the tag ends at its first >.
LONG_TAG = 1 << 16
N_TAGS, N_NAMES, N_WORDS = 32, 48, 24

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas audio video title textarea select".split())
#: What ends the skip over an element of RAW.
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.A | re.I) for tag in RAW}
_HEAD_END = re.compile(r"(?:</head|<body)(?=[\s/>]|\Z)", re.A | re.I)
#: An element of the key is closed by the start of one of these.
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: What words in tag names, classes and ids say of a block.
ROLES = [
    ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "toolbar"),
    ("ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense", "outbrain", "taboola"),
    ("comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "feedback", "reader", "readers", "thread", "reactions"),
    ("footer", "foot", "bottom", "copyright", "legal", "colophon", "imprint"),
    ("aside", "sidebar", "related", "widget", "widgets", "share", "social", "sharing", "recommended", "popular", "trending", "tags", "rail", "teaser", "more"),
    ("notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "dialog", "warning", "announcement", "toast", "hidden"),
    ("form", "fieldset", "login", "search", "subscribe", "newsletter", "signup", "register", "input", "button", "legend", "contact"),
    ("header", "masthead", "top", "logo", "branding", "topbar", "hgroup"),
    ("article", "post", "entry", "story", "main", "content", "body", "text", "prose", "articlebody"),
]
_ROLE = {w: i for i, words in enumerate(ROLES) for w in words}
_LEAVES = ("p", "h1", "h2", "h3", "li", "td", "div", "blockquote", "pre", "figcaption", "dd", "span")
#: What notices, footers, forms and the like say of themselves.
CUES = frozenset("copyright rights reserved cookie cookies privacy policy consent accept subscribe newsletter advertisement sponsored promoted comments comment reply replies login signup register password share tweet menu navigation related terms imprint powered sitemap loading javascript".split())
N_MORE = 23
N_INPUT = N_TAGS + N_NAMES + 2 * len(ROLES) + len(_LEAVES) + N_WORDS + N_MORE

_OPEN = re.compile(r"<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)|(?P<other>!--|!\[CDATA\[|[!?]))")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ENDS = {"!--": "-->", "![CDATA[": "]]>"}
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_HUGE = re.compile(r"&#[0-9]{8,};?")
_NAME = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _marks(tag: str, attributes: str) -> frozenset[int]:
    """Numbers of the inputs that an element on the path sets."""
    names = [tag]
    if "=" in attributes:
        for value in _NAME.findall(attributes):
            names += _PART.findall(value.lower())
    out = {zlib.crc32(tag.encode()) % N_TAGS}
    for n in names:
        if n in _ROLE:
            out.add(N_TAGS + N_NAMES + _ROLE[n])
    for n in names[1:]:
        out.add(N_TAGS + zlib.crc32(n.encode()) % N_NAMES)
    return frozenset(out)


def _plain(text: str) -> str:
    """Text with its character references decoded; numbers beyond Unicode, however long, are U+FFFD."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return _SPACE.sub(" ", html.unescape(text)).strip()


#: text, inputs set by its path, innermost roles, leaf tag, characters inside links, number of its container.
Block = tuple[str, frozenset[int], frozenset[int], str, int, int]
_TOP = ("", frozenset(), frozenset(), 0)


def blocks(page: str) -> list[Block]:
    """The leaf blocks that have text."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[int], frozenset[int], int]] = [_TOP]
    open_count: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, at, n, serial = 0, 0, 0, len(page), 0
    marks: dict[tuple[str, str], frozenset[int]] = {}
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _plain("".join(parts))
            if text:
                leaf, path, near, own = stack[-1]
                # Paragraphs and their like stand in the element around them; others are their own container.
                inside = stack[-2][3] if len(stack) > 1 and leaf in _LEAVES and leaf != "div" else own
                out.append((text, path, near, leaf, linked, inside))
            parts.clear()
        linked = 0

    def pop() -> None:
        open_count[stack.pop()[0]] -= 1

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            linked += len(piece) * in_link

    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        if m["other"]:
            end = _ENDS.get(m["other"], ">")
            found = page.find(end, m.end())
            at = n if found < 0 else found + len(end)
            continue
        end = page.find(">", m.end())
        if end < 0:
            # No tag ends any more.
            text(page[m.start() :])
            break
        attributes = page[m.end() : end]
        if '"' in attributes or "'" in attributes:
            whole = _QUOTED.match(page, m.end(), min(n, m.end() + LONG_TAG))
            if whole:
                attributes, end = page[m.end() : whole.end() - 1], whole.end() - 1
        at = end + 1
        tag, closing = m["name"].lower(), bool(m["close"])
        if tag in RAW and not closing:
            if tag in ("svg", "math") and attributes.endswith("/"):
                continue
            ended = None if tag in endless else _END[tag].search(page, at)
            if ended is not None:
                at = page.find(">", ended.end()) + 1 or n
            else:
                # What isn't code is read on; code goes to the end of a head that follows, else to the page's.
                endless.add(tag)
                if tag not in ("script", "style"):
                    continue
                ended = _HEAD_END.search(page, at)
                at = n if ended is None else ended.start()
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            continue
        flush()
        if closing:
            if open_count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        # A head's own elements are skipped one by one: its end tag may be left out, and any other element or text ends it.
        if tag in VOID or tag == "head":
            continue
        while tag in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        key = (tag, attributes)
        own = marks.get(key)
        if own is None:
            own = _marks(*key)
            if len(attributes) < 200:
                marks[key] = own
        _, path, near, _ = stack[-1]
        roles = frozenset(x - N_TAGS - N_NAMES for x in own if x >= N_TAGS + N_NAMES)
        serial += 1
        stack.append((tag, path if own <= path else path | own, roles or near, serial))
        open_count[tag] = open_count.get(tag, 0) + 1
    flush()
    return out


class Page:
    """A page's blocks and what only the whole page tells of them."""

    def __init__(self, found: list[Block]) -> None:
        self.found = found
        self.chars = sum(len(b[0]) for b in found)
        self.longest = max(len(b[0]) for b in found)
        #: By container: characters, those inside links, blocks.
        self.inside: dict[int, list[int]] = {}
        for b in found:
            c = self.inside.setdefault(b[5], [0, 0, 0])
            c[0] += len(b[0])
            c[1] += min(b[4], len(b[0]))
            c[2] += 1
        self.widest = max(c[0] - c[1] for c in self.inside.values())

    def vectors(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        found = self.found[start:stop]
        x = np.zeros((len(found), N_INPUT), "f4")
        near_at = N_TAGS + N_NAMES + len(ROLES)
        leaf_at = near_at + len(ROLES)
        words_at = leaf_at + len(_LEAVES)
        for i, (text, path, near, leaf, linked, inside) in enumerate(found):
            x[i, list(path)] = 1
            x[i, [near_at + r for r in near]] = 1
            if leaf in _LEAVES:
                x[i, leaf_at + _LEAVES.index(leaf)] = 1
            words = text.split()
            lower = [w.lower() for w in words]
            n, k = len(text), len(words)
            x[i, words_at : words_at + N_WORDS] = np.bincount([zlib.crc32(w.encode()) % N_WORDS for w in lower], minlength=N_WORDS) / k
            v = x[i, words_at + N_WORDS :]
            v[0], v[1], v[2] = np.log1p(n) / 6, np.log1p(k) / 4, min(1.0, linked / n)
            v[3] = sum(text.count(c) for c in ".,;:") / k
            v[4] = text[-1] in ".!?:\"”»"
            v[5] = "©" in text
            v[6] = text[0].isupper()
            v[7] = sum(w[0].isupper() for w in words) / k
            v[8] = sum(map(str.isdigit, text)) / n
            place = start + i
            v[9], v[10], v[11] = place / len(self.found), place == 0, place == len(self.found) - 1
            v[12] = n < 25
            v[13] = n > 120
            v[14] = np.log1p(len(self.found)) / 5
            v[15] = 1
            v[16] = min(1.0, 4 * sum(w.strip(".,:;!()") in CUES for w in lower) / k)
            chars, links, many = self.inside[inside]
            v[17], v[18], v[19] = chars / self.chars, links / chars, np.log1p(many) / 4
            v[20] = n / self.longest
            v[21] = np.log1p(chars - links) / 8
            v[22] = chars - links == self.widest
        return x


def vectors(found: list[Block]) -> np.ndarray:
    return Page(found).vectors()


class Labeller:
    """A bidirectional LSTM over blocks and a logistic unit on its states."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        size = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype("f4")
        self.p = {}
        for d in "fb":
            self.p["w" + d] = size(N_INPUT + HIDDEN, 4 * HIDDEN)
            self.p["c" + d] = np.zeros(4 * HIDDEN, "f4")
            self.p["c" + d][HIDDEN : 2 * HIDDEN] = 1
        self.p["v"] = size(2 * HIDDEN + N_INPUT, 1)
        self.p["o"] = np.zeros(1, "f4")

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        batch, steps, _ = x.shape
        w, bias = self.p["w" + d], self.p["c" + d]
        inner = x.reshape(-1, N_INPUT) @ w[:N_INPUT] + bias
        inner, out = inner.reshape(batch, steps, -1), np.zeros((batch, steps, HIDDEN), "f4")
        h = c = np.zeros((batch, HIDDEN), "f4")
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inner[:, t] + h @ w[N_INPUT:]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[:, t : t + 1]
            new_c = (f * c + i * g) * on
            th = np.tanh(new_c)
            new_h = o * th * on
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, th, on))
            h, c = new_h, new_c
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-odds of main text, batch by steps."""
        states = np.concatenate([self._pass(x, mask, "f", None), self._pass(x, mask, "b", None), x], 2)
        return (states @ self.p["v"])[:, :, 0] + self.p["o"]

    def long_scores(self, page: Page) -> np.ndarray:
        """The same for one page of any length, in parts: both directions at once, each from its end of the page, with carried states."""
        n = len(page.found)
        out = np.zeros(n, "f4")
        own = np.stack([self.p["wf"][N_INPUT:], self.p["wb"][N_INPUT:]])
        v = self.p["v"][:, 0]
        h, c = np.zeros((2, 1, HIDDEN), "f4"), np.zeros((2, HIDDEN), "f4")
        for a in range(0, n, PART):
            b = min(n, a + PART)
            # The backward direction reads the mirrored part, from its end on.
            ahead, behind = page.vectors(a, b), page.vectors(n - b, n - a)
            out[a:b] += ahead @ v[2 * HIDDEN :] + self.p["o"]
            inner = np.stack([ahead @ self.p["wf"][:N_INPUT] + self.p["cf"], (behind @ self.p["wb"][:N_INPUT] + self.p["cb"])[::-1]], 1)
            states = np.empty((b - a, 2, HIDDEN), "f4")
            for t in range(b - a):
                z = inner[t] + (h @ own)[:, 0]
                gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                states[t] = gates[:, 2 * HIDDEN :] * np.tanh(c)
                h = states[t][:, None, :]
            out[a:b] += states[:, 0] @ v[:HIDDEN]
            out[n - b : n - a] += (states[:, 1] @ v[HIDDEN : 2 * HIDDEN])[::-1]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._pass(x, mask, d, kept[d]) for d in "fb"] + [x], 2)
        z = (states @ self.p["v"])[:, :, 0] + self.p["o"]
        prob = 1 / (1 + np.exp(-z))
        total = mask.sum()
        loss = float((np.logaddexp(0, z) - y * z)[mask > 0].sum() / total)
        dz = ((prob - y) * mask / total)[:, :, None]
        grads = {"v": (states * dz).sum((0, 1))[:, None], "o": dz.sum((0, 1))}
        back = dz * self.p["v"][:, 0]
        for k, d in enumerate("fb"):
            w = self.p["w" + d]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p["c" + d])
            dh = dc = np.zeros((len(x), HIDDEN), "f4")
            for t, i, f, o, g, c, h, th, on in reversed(kept[d]):
                dh = (dh + back[:, t, k * HIDDEN : (k + 1) * HIDDEN]) * on
                dcell = (dc + dh * o * (1 - th * th)) * on
                dpre = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dh * th * o * (1 - o), dcell * i * (1 - g * g)], 1)
                gw[:N_INPUT] += x[:, t].T @ dpre
                gw[N_INPUT:] += h.T @ dpre
                gb += dpre.sum(0)
                dh, dc = dpre @ w[N_INPUT:].T, dcell * f
            grads["w" + d], grads["c" + d] = gw, gb
        return loss, grads


def _padded(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(f) for f in found)
    x, mask = np.zeros((len(found), steps, N_INPUT), "f4"), np.zeros((len(found), steps), "f4")
    for i, f in enumerate(found):
        x[i, : len(f)], mask[i, : len(f)] = f, 1
    return x, mask


_SYLLABLES = "an ba co de er fi ga hu in ja ko le mi no or pa qu ra si te un vo wi xe yo zu th ing ent el ou ai".split()


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page by rule, and the texts of its main blocks."""
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    pick = rng.choice

    def sentence(low: int = 4, high: int = 18) -> str:
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(low, high))]
        return " ".join(words).rstrip(",").capitalize() + pick("....!?")

    odd = rng.random() < 0.25

    def prose() -> str:
        """Sentences; on odd pages also what looks like no prose at all, which an article may hold too."""
        if odd and rng.random() < 0.6:
            words, kind = [word() for _ in range(rng.choice([3, 8, 20, 60]))], pick("ptsrun")
            if kind == "p":
                return " | ".join(words) + pick(["", "."])
            if kind == "t":
                return " ".join(w.upper() + "!!" for w in words)
            if kind == "s":
                return " ".join(w + pick(["***", "%%%", "$$$", "###"]) for w in words)
            if kind == "r":
                return " ".join([words[0]] * len(words))
            if kind == "u":
                return " ".join(f"{w} {rng.randint(0, 99999)}" for w in words)
            return "".join(words)
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))

    title = lambda: " ".join(word() for _ in range(rng.randint(2, 8))).capitalize() + pick(["", "", "."])
    main: set[str] = set()

    def own(text: str) -> str:
        main.add(text)
        return text

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{pick([word(), word().capitalize(), title()])}</a></{tag}>' for _ in range(rng.randint(2, 9)))

    def named(role: int, tags: tuple[str, ...], inside: str) -> str:
        known = pick(ROLES[role])
        tag = pick(tags)
        if tag in ("div", "section", "ul"):
            name = pick([known, known, f"{word()}-{known}", f"{known}-{word()}", f"{known}_{rng.randint(1, 9)} {word()}"])
            return f'<{tag} {pick(["class", "class", "id"])}="{name}">{inside}</{tag}>'
        return f"<{tag}>{inside}</{tag}>"

    # Pages with telling names; with none, on which only what is plainly no prose is no main text; with names that mislead.
    layout = rng.choices(("named", "neutral", "misnamed", "bare"), (0.55, 0.22, 0.15, 0.08))[0]
    p = lambda: f"<p>{prose()}</p>"
    cue = lambda: pick(
        [f"We use cookies. {word().capitalize()} {word()} privacy policy.", "Advertisement", "Sponsored", "Share this", "Subscribe to our newsletter", "Leave a reply", "All rights reserved.", f"Copyright 20{rng.randint(10, 24)} {word().capitalize()}", "Accept all cookies", "Related"]
    )
    menu = lambda: named(0, ("nav", "nav", "div", "ul"), pick([f"<ul>{links()}</ul>", links("span"), links("div"), links(), "<br>".join(re.findall(r"<a.*?</a>", links())), " | ".join(re.findall(r"<a.*?</a>", links()))]))
    advert = lambda: named(1, ("div", "div", "section"), pick([sentence(), p(), title(), sentence() + " " + sentence()]))
    reader = lambda: f'<{pick(["div", "li", "article"])} class="comment">{pick(["", "<h4>" + title() + "</h4>", "<span>" + word() + "</span>"])}{p()}</div>'
    talk = lambda: named(2, ("section", "div"), pick(["", f"<h2>{title()}</h2>", f"<h3>{title()}</h3>"]) + "".join(pick([reader, p])() for _ in range(rng.randint(1, 5))))
    foot = lambda: named(3, ("footer", "footer", "div"), pick([f"&copy; {word()}.{word()} &middot; {prose()}", p(), f"<p>&copy; {title()}</p>" + f"<ul>{links()}</ul>", sentence()]))
    side = lambda: named(4, ("aside", "aside", "div", "section"), pick([f"<h3>{title()}</h3><ul>{links()}</ul>", p(), f"<h4>{title()}</h4>{p()}", "<p>" + title() + "</p>" + links("div")]))
    notice = lambda: named(5, ("div", "div", "section"), pick([p(), sentence() + f" <button>{word()}</button>", prose()]))
    form = lambda: named(6, ("form", "form", "div"), f"<label>{title()}</label><input>{pick(['', p()])}<button>{word()}</button>")
    head = lambda: named(7, ("header", "header", "div"), pick([f"<h1>{title()}</h1>", f'<a href="/">{word()}</a>', f"<p>{title()}</p>", f"<div>{word()}</div>" + menu()]))

    def inner() -> str:
        kind = rng.random()
        text = prose() if rng.random() < 0.85 else title()
        if kind < 0.62:
            marked = text
            own(text)
            if rng.random() < 0.3:
                words = marked.split(" ")
                i = rng.randrange(len(words))
                words[i] = pick([f'<a href="/{word()}">{words[i]}</a>', f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", f"<span>{words[i]}</span>"])
                marked = " ".join(words)
            return pick([f"<p>{marked}</p>", f"<p>{marked}</p>", f"<p>{marked}", f"<p><b>{marked}<br>", f"<div>{marked}</div>"])
        if kind < 0.72:
            return f"<{(t := pick(['h2', 'h3', 'h4']))}>{own(title())}</{t}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{own(pick([title, sentence])())}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{pick(['<p>', ''])}{own(prose())}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{own(title())}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        if kind < 0.95:
            return f"<pre>{own(title())}</pre>"
        return pick([advert, side, form, notice])()

    if layout in ("neutral", "bare"):
        small = lambda: pick([cue(), f"<p>{cue()}</p>", f"<div>{cue()}</div>"])
        advert = notice = lambda: f'<div class="{word()}">{small()}</div>'
        talk = side = lambda: f'<div class="{word()}">{pick(["", f"<h3>{cue()}</h3>", f"<h4>{title()}</h4>"])}<ul>{links()}</ul></div>'
        form = lambda: f'<form class="{word()}"><label>{pick([word(), cue()])}</label><input><button>{word()}</button></form>'
        head = lambda: f'<div class="{word()}"><a href="/">{word()}</a></div>'
        foot = lambda: f'<div class="{word()}">{pick([f"&copy; {word()} 20{rng.randint(10, 24)}", f"<p>&copy; 20{rng.randint(10, 24)} {title()}</p>", f"<p>{cue()}</p><ul>{links()}</ul>", f"<span>{cue()}</span>"])}</div>'
    body = f"<h1>{own(title())}</h1>" if rng.random() < 0.75 else ""
    if body and rng.random() < 0.25:
        body = f"<header>{body}</header>"
    body += "".join(inner() for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])))
    if rng.random() < 0.25:
        body += f"<p>{own('This work is licensed under ' + title())}</p>"
    if rng.random() < 0.1:
        body += talk()
    tag = pick(["article", "article", "main", "div", "section"])
    attribute = f' class="{pick([pick(ROLES[8]), pick(ROLES[8]) + "-" + word(), word() + " " + pick(ROLES[8])])}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    whole = f"<{tag}{attribute}>{body}</{tag}>"
    if rng.random() < 0.3:
        whole = f"<main>{whole}</main>" if tag != "main" else f'<div class="{word()}">{whole}</div>'
    chance = 0.12 if layout == "bare" else 0.45
    before = [f() for f in (head, menu, notice, advert, form, side) if rng.random() < chance]
    after = [f() for f in (talk, side, advert, form, menu, notice) if rng.random() < chance * 0.9]
    rng.shuffle(before)
    rng.shuffle(after)
    if layout == "named" and rng.random() < 0.06:  # a layout of table cells
        whole = f'<table><tr><td class="{pick(ROLES[0])}">{menu()}</td><td class="{pick(ROLES[8])}">{whole}</td></tr></table>'
    if layout == "bare":
        whole = body
    end = foot() if rng.random() < (0.3 if layout == "bare" else 0.85) else ""
    inside = f"{''.join(before)}{whole}{''.join(after)}{end}"
    if layout == "misnamed":
        wrong = lambda: f'<div class="{pick(["page", "wrap", word(), ""])} {pick(pick(ROLES[:8]))}">'
        if rng.random() < 0.5:
            inside = f"{''.join(before)}{wrong()}{whole}</div>{''.join(after)}{end}"
        else:
            inside = f"{wrong()}{inside}</div>"
    close = pick(["</body></html>", "</body></html>", ""])
    page = f"<!DOCTYPE html><html><head><title>{title()}</title><style>p{{}}</style></head><body>{inside}{close}"
    if layout == "neutral":
        if rng.random() < 0.8:
            page = re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section)\b", r"<\1div", page)
        known: dict[str, str] = {}
        other = lambda m: f'{m[1]}="{known.setdefault(m[2], pick([word(), chr(97 + rng.randrange(26)) + str(rng.randint(1, 99))]))}"'
        page = re.sub(r' (?:class|id)="[^"]*"', "", page) if rng.random() < 0.3 else re.sub(r'\b(class|id)="([^"]*)"', other, page)
    return page, main


def train(n_pages: int = N_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng, model = random.Random(seed), Labeller(seed)
    data = []
    for _ in range(n_pages):
        page, main = made_page(rng)
        found = blocks(page)
        if found:
            data.append((vectors(found), np.array([text in main for text, *_ in found], "f4")))
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rng.shuffle(data)
        for at in range(0, len(data), 20):
            part = data[at : at + 20]
            x, mask = _padded([v for v, _ in part])
            y = np.zeros(mask.shape, "f4")
            for i, (_, labels) in enumerate(part):
                y[i, : len(labels)] = labels
            _, grads = model.gradients(x, mask, y)
            step += 1
            rate = 0.006 * (1 - 0.85 * epoch / max(1, epochs - 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page: its blocks that the model takes for the article's, one to a line."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    todo = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    while todo:
        # The longest pages first; with them as many of the next ones as fit.
        n = min(256, STEPS // len(found[todo[-1]]))
        if not n:
            i = todo.pop()
            out[i] = "\n".join(b[0] for b, z in zip(found[i], model.long_scores(Page(found[i])), strict=True) if z > 0)
            found[i] = []
            continue
        group, todo = todo[-n:], todo[:-n]
        x, mask = _padded([vectors(found[i]) for i in group])
        good = model.scores(x, mask) > 0
        for row, i in enumerate(group):
            out[i] = "\n".join(b[0] for b, keep in zip(found[i], good[row], strict=False) if keep)
    return out


@cache
def trained() -> Labeller:
    """The model, trained once in a process."""
    return train()


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    weights = (model or trained()).p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = weights
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = main_texts(own, [h.as_py() or "" for h in part.column("html")])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(settled(run), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
