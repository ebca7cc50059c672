"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks in page order: runs of text between block-level tags, each with its open
ancestors. Features of a block are its ancestors' tags, the words in their class, id and role attributes, the shape of
its text, both together, and whether the page has an article that the block stands beside; the two labels are main
text and everything else. The field is trained in numpy, by
stochastic gradient ascent on the likelihood (forward-backward), on labelled pages that `training_pages`
generates, and decoded by Viterbi.

Defined cases: null or empty html gives an empty text. Comments, scripts, styles and the head are never
text. Unclosed and stray tags are tolerated; an unclosed comment outside scripts and styles, or an unclosed script, swallows the rest. Character references
are decoded, white space inside a block becomes one space, blocks are joined by one newline. A `<br>` is white
space. Pages are read whole, in time in proportion to their length however their tags nest; from the first tag on
whose quotes never close, tags end at their first `>`. Repeated rows get equal results. An empty table gives an
empty result. Other columns pass through; the result columns replace columns of the same name.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packetloom.llm.common import bounded_batches

#: HTML's block-level elements, elements without content, and elements without visible text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul video audio canvas button textarea label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript title textarea".split())
#: An opening tag ends an open element of these names (HTML's optional end tags).
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",), "body": ("head",),
}
SCOPE = frozenset("ul ol dl table article section div main aside nav body html".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN_RUN = re.compile(r"""[^"'>]*""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
STRIP_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass(eq=False)
class Place:
    """An open element with its ancestors. `fresh` are its features that no ancestor has."""

    above: Place | None
    fresh: tuple[str, ...]
    #: Nearest tag, nearest element of STRUCTURE, and what kind of surroundings this is.
    tag: str = "body"
    inner: str = ""
    around: str = "plain"
    #: Whether an article, a main element or a container named like one is open.
    within: frozenset = frozenset()
    scores: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Block:
    text: str
    place: Place
    link_chars: int


#: Elements that lay a page out, and fixed values: words of class, id and role attributes on either side.
STRUCTURE = frozenset("article main section aside nav header footer form".split())
MAIN_WORDS = "article articlebody body-text content entry entry-content main main-content page-content post post-body post-content story story-body text".split()
SIDE_WORDS = {
    "menu": "breadcrumb breadcrumbs main-nav menu nav navbar navigation site-nav skip-link tabs toc topnav",
    "header": "banner brand header logo masthead page-header site-header top-bar",
    "footer": "bottom colophon copyright footer legal site-footer",
    "sidebar": "aside column-right popular related recommended rail side sidebar trending widget",
    "notice": "alert announcement consent cookie cookie-banner gdpr message modal newsletter notice notification popup privacy subscribe warning",
    "ad": "ad ad-slot ads adsense advert advertisement banner-ad commercial promo promotion sponsor sponsored",
    "comment": "comment comment-list comments discussion disqus feedback replies reply respond responses user-comment",
    "form": "contact-form form login search search-form signup",
    "share": "author-bio byline meta pagination post-meta share sharing social tags",
}
MAIN_SET = frozenset(w for x in MAIN_WORDS for w in x.split("-"))
SIDE_KIND = {w: kind for kind, words in SIDE_WORDS.items() for x in words.split() for w in x.split("-") if w not in MAIN_SET}


def attribute_words(raw: str) -> tuple[str, ...]:
    out = []
    for m in ATTRIBUTE.finditer(raw):
        value = STRIP_CAMEL.sub(r"\1 \2", m[2] or m[3] or m[4] or "")
        out += WORD.findall(value.lower())
    return tuple(dict.fromkeys(out))


class Stack:
    """Open elements, with what is asked of them kept up to date, so that no question walks through them."""

    def __init__(self):
        self.names: list[str] = []
        self.places = [Place(None, ())]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.hidden = 0
        self.active: set[str] = set()

    def open(self, name: str, words: tuple[str, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if name in SCOPE:
            self.scopes.append(len(self.names))
        self.hidden += name in HIDDEN or name == "head"
        self.names.append(name)
        here = self.places[-1]
        self.places.append(self._place(here, name, words) if name in BLOCK or words else here)

    def _place(self, here: Place, name: str, words: tuple[str, ...]) -> Place:
        own = [f"word={w}" for w in words]
        kinds = [SIDE_KIND[w] for w in words if w in SIDE_KIND]
        own += [f"kind={k}" for k in kinds]
        named = any(w in MAIN_SET for w in words)
        if named:
            own.append("main")
        tag, inner, within = here.tag, here.inner, here.within
        if name not in ("html", "body"):
            tag = name
            own.append(f"tag={name}")
            if name in STRUCTURE:
                inner = name
                if not here.inner:
                    own.append(f"outer={name}")
            own += [f"{x}>{name}" for x in ("article", "main") if x in within and name in ("header", "footer", "aside", "nav", "form", "section", "div")]
        within |= {x for x in ("article", "main") if name == x} | ({"named"} if named else set())
        side = kinds or name in ("nav", "aside", "footer", "form")
        around = "side" if side or here.around == "side" else "article" if within & {"article", "main"} else "named" if within else "plain"
        if side:
            own.append("side")
        fresh = tuple(f for f in dict.fromkeys(own) if f not in self.active)
        self.active.update(fresh)
        return Place(here, fresh, tag, inner, around, within)

    def cut(self, depth: int) -> None:
        """Close all elements from depth on."""
        while len(self.names) > depth:
            name = self.names.pop()
            self.at[name].pop()
            if name in SCOPE:
                self.scopes.pop()
            self.hidden -= name in HIDDEN or name == "head"
            last = self.places.pop()
            if last is not self.places[-1]:
                self.active.difference_update(last.fresh)

    def close(self, name: str) -> None:
        if self.at.get(name):
            self.cut(self.at[name][-1])

    def end(self, names: tuple[str, ...]) -> None:
        """Close the innermost open element of these names, unless a scope stands inside it."""
        inmost = max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)
        if inmost >= 0 and (not self.scopes or inmost >= self.scopes[-1]):
            self.cut(inmost)

    @property
    def linked(self) -> bool:
        return bool(self.at.get("a")) and self.at["a"][-1] >= len(self.names) - 6


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; name is empty for comments, declarations and the like. An
    element without visible text is one item, which ends behind its closing tag: nothing inside it is read as a tag, a
    comment or a quote."""
    at, size, quoted = 0, len(page), True
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = size if end < 0 else end + 3
            yield start, end, "", False, ""
            at = end
            continue
        if start > last:
            return  # no tag ends any more
        closing = page.startswith("/", start + 1)
        name = NAME.match(page, start + 1 + closing)
        if not name:
            if start + 1 < size and page[start + 1] in "!?/":
                at = page.find(">", start) + 1
                yield start, at, "", False, ""
            else:
                at = start + 1
            continue
        end = name.end()
        while quoted:
            end = PLAIN_RUN.match(page, end).end()
            if end < size and page[end] == ">":
                break
            end = page.find(page[end], end + 1) + 1 if end < size else 0
            quoted = end > 0
        if not quoted:
            end = page.find(">", name.end())
        lowered, raw, at = name[0].lower(), page[name.end() : end], end + 1
        if lowered in HIDDEN and lowered not in VOID and not closing and not raw.endswith("/"):
            at = end_of(lowered, page, at)
        yield start, at, lowered, closing, raw


def end_of(name: str, page: str, at: int) -> int:
    """Where the closing tag of an element without visible text ends; the page's end if it has none."""
    found = at
    while (hit := re.compile(rf"</{name}", re.I).search(page, found)) is not None:
        found = hit.end()
        if not page[found : found + 1].isalnum():
            end = page.find(">", found)
            return end + 1 if end >= 0 else len(page)
    return len(page)


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks with text, in page order."""
    out: list[Block] = []
    stack, parts, links, at = Stack(), [], 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text and not stack.hidden:
                out.append(Block(text, stack.places[-1], links))
            parts.clear()
        links = 0

    def take(upto: int) -> None:
        nonlocal links
        if upto > at:
            piece = html.unescape(page[at:upto])
            parts.append(piece)
            if stack.linked:
                links += len(piece.strip())

    for start, end, name, closing, raw in tags(page):
        take(start)
        at = end
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if closing:
            stack.close(name)
            continue
        if name in BLOCK and name not in ("label", "button", "option") and name not in ENDS:
            stack.end(("p",))
        if name in ENDS:
            stack.end(ENDS[name])
        if name in VOID or raw.endswith("/"):
            continue
        if name in HIDDEN:
            continue
        stack.open(name, attribute_words(raw) if raw else ())
    take(len(page))
    flush()
    return out


def place_features(place: Place) -> list[str]:
    """All features of a place, its ancestors' ones included."""
    out, up = [], place
    while up is not None:
        out += up.fresh
        up = up.above
    return out + nearest_features(place)


def nearest_features(place: Place) -> list[str]:
    out = [f"parent={place.tag}", f"around={place.around}"]
    if place.inner:
        out.append(f"inner={place.inner}")
    if place.tag == "body":
        out.append("bare")
    return out


def shape(block: Block) -> tuple[str, ...]:
    """Features of a block's text."""
    text = block.text
    words = text.count(" ") + 1
    out = [f"words={min(6, words.bit_length())}", f"links={min(4, 4 * block.link_chars // max(1, len(text)))}", "stop" if text[-1] in ".!?:;\"'”»…" else "nostop"]
    if "©" in text or "all rights reserved" in text.lower():
        out.append("copyright")
    if words <= 2:
        out.append("tiny")
    return tuple(out)


def with_surroundings(own: tuple[str, ...], place: Place, page: frozenset, edge: str) -> list[str]:
    """A text's features, alone and with its surroundings. page: what main containers the page has."""
    out = [*own, *(f"{place.around}&{x}" for x in own), *(f"{place.tag}&{x}" for x in own[:2])]
    out += [f"beside={x}" for x in page - place.within]
    if edge:
        out += [edge, f"{edge}&{own[0]}"]
    return out


def described(blocks: list[Block]) -> Iterator[tuple[Block, tuple]]:
    """Each block with what with_surroundings() asks for."""
    page = frozenset(x for b in blocks for x in b.place.within)
    for i, b in enumerate(blocks):
        yield b, (shape(b), b.place, page, "first" if i == 0 else "last" if i == len(blocks) - 1 else "")


def block_features(blocks: list[Block]) -> list[list[str]]:
    return [[*place_features(b.place), *with_surroundings(*about)] for b, about in described(blocks)]


@dataclass
class Field:
    """Scores of label 1 (main text) over label 0 by feature; transition and start scores."""

    weights: dict[str, float]
    step: np.ndarray
    start: np.ndarray
    known: dict[tuple, float] = field(default_factory=dict)

    def emissions(self, blocks: list[Block]) -> list[float]:
        out = []
        for b, (own, place, page, edge) in described(blocks):
            # Few of these differ: shapes, tags and surroundings are small sets.
            key = own, place.around, place.tag, place.within, page, edge
            if key not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[key] = sum(self.weights.get(f, 0.0) for f in with_surroundings(own, place, page, edge))
            out.append(self.place_score(place) + self.known[key])
        return out

    def place_score(self, place: Place) -> float:
        """Summed weights of a place's features; places share the sums of their ancestors."""
        chain, up = [], place
        while up is not None and "sum" not in up.scores:
            chain.append(up)
            up = up.above
        total = up.scores["sum"] if up is not None else 0.0
        for p in reversed(chain):
            total += sum(self.weights.get(f, 0.0) for f in p.fresh)
            p.scores["sum"] = total
        if "all" not in place.scores:
            place.scores["all"] = place.scores["sum"] + sum(self.weights.get(f, 0.0) for f in nearest_features(place))
        return place.scores["all"]

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.step.tolist()
        scores = self.emissions(blocks)
        s0, s1 = self.start[0], self.start[1] + scores[0]
        back = []
        for e in scores[1:]:
            from0, from1 = s0 + t00 < s1 + t10, s0 + t01 < s1 + t11
            back.append((from0, from1))
            s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11) + e
        label = int(s1 > s0)
        out = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            out.append(label)
        return out[::-1]


def _posterior(e: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: probability of label 1 at each block, and summed transition probabilities."""
    n = len(e)
    emit = np.stack([np.zeros(n), e], 1)
    a, b = np.empty((n, 2)), np.zeros((n, 2))
    a[0] = start + emit[0]
    for i in range(1, n):
        a[i] = np.logaddexp(a[i - 1, 0] + step[0], a[i - 1, 1] + step[1]) + emit[i]
    for i in range(n - 2, -1, -1):
        x = step + emit[i + 1] + b[i + 1]
        b[i] = np.logaddexp(x[:, 0], x[:, 1])
    z = np.logaddexp(a[-1, 0], a[-1, 1])
    moves = np.zeros((2, 2))
    for i in range(n - 1):
        moves += np.exp(a[i][:, None] + step + (emit[i + 1] + b[i + 1])[None] - z)
    return np.exp(a + b - z), moves


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    features = [block_features(blocks) for blocks, _ in pages]
    names = sorted({f for page in features for x in page for f in x})
    number = {f: i for i, f in enumerate(names)}
    bags = [[np.array([number[f] for f in x]) for x in page] for page in features]
    w, step, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    rng = np.random.default_rng(seed)
    done, total = 0, epochs * len(pages)
    for _ in range(epochs):
        for p in rng.permutation(len(pages)):
            bag, y = bags[p], np.array(pages[p][1])
            lr = rate * (1 - 0.9 * done / total)
            done += 1
            if not len(y):
                continue
            prob, moves = _posterior(np.array([w[f].sum() for f in bag]), step, start)
            w *= 1 - lr * decay
            for f, d in zip(bag, y - prob[:, 1], strict=True):
                np.add.at(w, f, lr * d / 3)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            step += lr * 0.1 * (seen - moves)
            start += lr * 0.1 * (np.eye(2)[y[0]] - prob[0])
    return Field({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, step, start)


# ---- labelled pages ---------------------------------------------------------------------------------------

SIDE_TAGS = {"menu": ("nav", "ul", "div", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "p", "dialog"), "ad": ("div", "aside", "p", "section", "ins"), "comment": ("section", "div", "ol", "ul"), "form": ("form",), "share": ("div", "ul", "p")}
#: Tags that say what they are without any attribute.
PLAIN = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


#: Private-use characters that mark a training text with its label until it is parsed.
MARKS = chr(0xE000) + chr(0xE001)


class PageMaker:
    """Random labelled pages: words are made up, so that only structure and shape can be learned."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = "ba co du fe gi ha je ka lo mi nu or pe qui ra so ti un va wo".split()
        self.vocabulary = ["".join(self.r.choice(parts) for _ in range(self.r.randint(1, 4))) for _ in range(400)]

    def prose(self, low: int, high: int) -> str:
        r = self.r
        words = [r.choice(self.vocabulary) for _ in range(r.randint(low, high))]
        words = [w + r.choice([",", ".", "***", "!!"]) if r.random() < 0.08 else w for w in words]
        return " ".join(words).capitalize() + (r.choice([".", ".", ".", "!", "?", ""]))

    def attributes(self, words: str | list[str]) -> str:
        r = self.r
        options = words.split() if isinstance(words, str) else words
        value = r.choice(options)
        if r.random() < 0.2:
            value += " " + r.choice(self.vocabulary)
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def bare_side(self) -> list[tuple[str, int | None]]:
        """What is not main text, in elements that don't say so: none, or a made-up name."""
        r = self.r
        named = f' class="{r.choice(self.vocabulary)}{r.choice(self.vocabulary)}"' if r.random() < 0.5 else ""
        kind = r.choice(["links", "links", "copyright", "remarks"])
        if kind == "links":
            tag, item = r.choice([("ul", "li"), ("div", "span"), ("div", "div"), ("p", "span"), ("div", "")])
            if not item:  # one block of several links
                links = r.choice(["<br>", " | ", " "]).join(f"<a href='/x'>{self.prose(1, 2)}</a>" for _ in range(r.randint(2, 8)))
                return [(f"<div{named}>" if r.random() < 0.5 else "", None), (links, 0), ("</div>", None)]
            return [(f"<{tag}{named}>", None), *[x for _ in range(r.randint(2, 8)) for x in ((f"<{item}><a href='/x'>", None), (self.prose(1, 3), 0), (f"</a></{item}>", None))], (f"</{tag}>", None)]
        if kind == "copyright":
            return [(f"<div{named}>", None), ((r.choice(["&copy; ", "Copyright &copy; ", "2024 "]) if r.random() < 0.9 else "") + self.prose(1, 8) + (" All rights reserved." if r.random() < 0.5 else ""), 0), ("</div>", None)]
        return [(f"<div{named}>", None), *[x for _ in range(r.randint(1, 4)) for x in (("<div><b>", None), (self.prose(1, 2), 0), ("</b><p>", None), (self.prose(3, 40), 0), ("</p></div>", None))], ("</div>", None)]

    def side(self, kind: str, inner: bool) -> list[tuple[str, int | None]]:
        """Pieces (markup, None) and (text, label)."""
        r = self.r
        tag = r.choice(SIDE_TAGS[kind])
        plain = tag == PLAIN.get(kind) and r.random() < 0.6
        out: list[tuple[str, int | None]] = [(f"<{tag}{'' if plain else self.attributes(SIDE_WORDS[kind])}>", None)]
        if kind in ("menu", "share", "sidebar") and r.random() < 0.7:
            n = r.randint(2, 8)
            wrap = r.random() < 0.7 and tag != "ul"
            if wrap:
                out.append(("<ul>", None))
            for _ in range(n):
                out += [("<li><a href='/x'>", None), (self.prose(1, 3), 0), ("</a></li>" if r.random() < 0.8 else "</a>", None)]
            if wrap:
                out.append(("</ul>", None))
        elif kind == "form":
            out += [("<label>", None), (self.prose(1, 4), 0), ("</label><input name='q'><button>", None), (self.prose(1, 2), 0), ("</button>", None)]
            if r.random() < 0.4:
                out += [("<p>", None), (self.prose(3, 20), 0), ("</p>", None)]
        elif kind == "header" and r.random() < 0.5:
            level = r.choice(["h1", "h2", "a", "p"])
            out += [(f"<{level}>", None), (self.prose(1, 5), 0), (f"</{level}>", None)]
            if r.random() < 0.5:
                out += self.side("menu", True)
        elif kind == "footer":
            out.append((("&copy; " if r.random() < 0.6 else "") + self.prose(2, 14), 0))
            if r.random() < 0.4:
                out += [("<p>", None), (self.prose(2, 20), 0), ("</p>", None)]
        elif kind == "comment":
            if r.random() < 0.5:
                level = r.choice(["h2", "h3", "h4"])
                out += [(f"<{level}>", None), (self.prose(1, 3), 0), (f"</{level}>", None)]
            for _ in range(r.randint(1, 5)):
                inner_tag = r.choice(["div", "li", "p", "article"])
                out += [(f"<{inner_tag}{self.attributes(SIDE_WORDS[kind]) if r.random() < 0.5 else ''}>", None), (self.prose(3, 60), 0), (f"</{inner_tag}>", None)]
        else:
            if r.random() < 0.5:
                out.append((self.prose(2, 25), 0))
            for _ in range(r.randint(0, 2)):
                sub = r.choice(["p", "div", "h3", "span"])
                out += [(f"<{sub}>", None), (self.prose(2, 30), 0), (f"</{sub}>", None)]
        out.append((f"</{tag}>", None))
        return out

    def main(self) -> list[tuple[str, int | None]]:
        r = self.r
        out: list[tuple[str, int | None]] = []
        if r.random() < 0.8:
            wrapped = r.random() < 0.15
            out += [("<header><h1>" if wrapped else "<h1>", None), (self.prose(1, 12), 1), ("</h1></header>" if wrapped else "</h1>", None)]
        for _ in range(r.randint(1, 14)):
            roll = r.random()
            if roll < 0.05:
                link = f"<a href='/{r.choice(self.vocabulary)}'>"
                out += r.choice(
                    [
                        [(f"<p>{link}", None), (self.prose(2, 9), 1), ("</a></p>", None)],
                        [("<p>", None), (f"{self.prose(2, 9)} {link}{self.prose(1, 6)}</a> {self.prose(1, 9)}", 1), ("</p>", None)],
                        [("<ul>", None), *[x for _ in range(r.randint(1, 4)) for x in ((f"<li>{link}", None), (self.prose(1, 8), 1), ("</a></li>", None))], ("</ul>", None)],
                    ]
                )
            elif roll < 0.62:
                bold = r.random() < 0.15
                out += [("<p><b>" if bold else "<p>", None), (self.prose(1, 3) if r.random() < 0.15 else self.prose(4, 90), 1), ("<br>" if bold else "</p>", None)]
            elif roll < 0.70:
                level = r.choice(["h2", "h3", "h4"])
                out += [(f"<{level}>", None), (self.prose(1, 8), 1), (f"</{level}>", None)]
            elif roll < 0.78:
                kind = r.choice(["ul", "ol"])
                out.append((f"<{kind}>", None))
                for _ in range(r.randint(1, 5)):
                    out += [("<li>", None), (self.prose(1, 20), 1), ("</li>", None)]
                out.append((f"</{kind}>", None))
            elif roll < 0.84:
                out += [("<blockquote><p>", None), (self.prose(4, 50), 1), ("</p></blockquote>", None)]
            elif roll < 0.88:
                out += [("<pre>", None), (self.prose(3, 30), 1), ("</pre>", None)]
            elif roll < 0.92:
                out += [("<table><tr><td>", None), (self.prose(1, 6), 1), ("</td><td>", None), (self.prose(1, 6), 1), ("</td></tr></table>", None)]
            elif roll < 0.95:
                out += [("<figure><figcaption>", None), (self.prose(2, 12), 1), ("</figcaption></figure>", None)]
            else:
                out += [("<div>", None), (self.prose(4, 60), 1), ("</div>", None)]
            if r.random() < 0.12:
                out += self.side(r.choice(["ad", "ad", "share", "notice", "notice", "sidebar", "sidebar", "form", "menu"]), True)
        return out

    def page(self) -> list[tuple[str, int | None]]:
        r = self.r
        out: list[tuple[str, int | None]] = [("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>", None)]
        alone = r.random() < 0.15  # a fragment: main text and nothing else
        for kind, share in () if alone else (("notice", 0.25), ("header", 0.45), ("menu", 0.75), ("ad", 0.5), ("form", 0.15), ("sidebar", 0.2)):
            if r.random() < share:
                out += self.side(kind, False)
        shell = r.uniform(0.6, 1.2) if alone else r.uniform(0, 1.06)
        if shell < 0.45:
            opened, closed = "<article>", "</article>"
        elif shell < 0.6:
            opened, closed = "<main>", "</main>"
        elif shell < 0.68:
            opened, closed = "<main><article>", "</article></main>"
        elif shell < 0.94:
            tag = r.choice(["div", "div", "section"])
            opened, closed = f"<{tag}{self.attributes(MAIN_WORDS)}>", f"</{tag}>"
        else:
            opened, closed = r.choice([("<div>", "</div>"), ("<div>", "</div>"), ("", ""), (f'<div class="{r.choice(self.vocabulary)}{r.choice(self.vocabulary)}">', "</div>")])
        cells = shell >= 0.6 and r.random() < 0.15
        if cells:  # a table that lays the page out, with its menu in a cell
            out.append((f"<table{self.attributes('layout page wrap grid')}><tr><td>", None))
            out += self.bare_side()
            out.append(("</td>", None))
            opened, closed = r.choice([(f"<td{self.attributes(MAIN_WORDS)}>", "</td></tr></table>"), ("<td>", "</td></tr></table>")])
        elif not alone and r.random() < 0.25:
            out += self.bare_side()
        out.append((opened, None))
        out += self.main()
        if not alone and r.random() < 0.12:
            out += self.side("comment", True)
        if cells or r.random() < 0.9:
            out.append((closed, None))
        if alone:
            return out
        for kind, share in (("share", 0.2), ("comment", 0.3), ("sidebar", 0.35), ("ad", 0.25), ("footer", 0.8), ("notice", 0.15)):
            if r.random() < share:
                out += self.side(kind, False)
            if r.random() < 0.08:
                out += self.bare_side()
        return out


def training_pages(n: int, seed: int = 1) -> list[tuple[list[Block], list[int], str]]:
    """Labelled blocks and the page's markup. Each text carries a mark that gives its label back after parsing."""
    maker, out = PageMaker(seed), []
    for _ in range(n):
        pieces = maker.page()
        marked = "".join(t if label is None else MARKS[label] + t for t, label in pieces)
        blocks, labels = [], []
        for b in leaf_blocks(marked):
            found = {MARKS.index(c) for c in b.text if c in MARKS}
            if found:
                blocks.append(Block(b.text.translate(dict.fromkeys(map(ord, MARKS))), b.place, b.link_chars))
                labels.append(max(found))
        keep = [i for i, b in enumerate(blocks) if b.text]
        out.append(([blocks[i] for i in keep], [labels[i] for i in keep], "".join(t for t, _ in pieces)))
    return out


@lru_cache(maxsize=2)
def default_field(pages: int = 2_000, seed: int = 1) -> Field:
    return train([(b, y) for b, y, _ in training_pages(pages, seed)])


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract(df: DataFrame, html_col: str = "html", field: Field | None = None) -> DataFrame:
    """df with its html replaced by text (main text) and n_chars (its code points)."""
    made = ("text", "n_chars")
    base = df.select(*[c for c in df.columns if c not in made])
    keep = [f for f in base.schema.fields if f.name != html_col]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    sent = df.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches):
        model = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [main_text(x or "", model) for x in part.column(part.schema.get_field_index(html_col)).to_pylist()]
                arrays = [part.column(part.schema.get_field_index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema])

    return bounded_batches(base).mapInArrow(run, schema)
