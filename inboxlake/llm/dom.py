"""Block-level DOM of HTML pages and features of its nodes.

A tolerant parse in one linear pass: block-level elements are nodes, text between their boundaries becomes text nodes
("runs"), inline elements only leave counts.  Features are computed for a batch of pages at once, level by level.
"""

from __future__ import annotations

import html
import re

import numpy as np

# ---- fixed values: element names of the HTML standard and usual words of class, id and role attributes ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER_TEXT = frozenset("head template svg math canvas audio video object button select datalist".split()) | RAW_TEXT
CONTROLS = frozenset("input button select textarea label option".split())
TAG_GROUPS = ["html body", "article main", "nav menu", "header hgroup", "footer", "aside dialog", "form fieldset", "p",
              "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "div", "section details summary center", "td th",
              "table thead tbody tfoot tr caption", "figure figcaption", "blockquote pre address", "search", "hr"]
ATTRIBUTE_GROUPS = {
    "content": "article articlebody content main post entry story text body prose page blog news maincontent",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager topbar toolbar links",
    "header": "header masthead logo brand branding tagline banner hero site",
    "footer": "footer foot copyright legal colophon contentinfo imprint bottom",
    "side": "sidebar side aside widget widgets related rail recommended recommendations more popular trending tags "
            "complementary teaser",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsbygoogle adslot partner",
    "notice": "cookie cookies consent notice gdpr modal popup alert privacy overlay dialog newsletter subscribe signup "
              "paywall disclaimer",
    "comments": "comment comments reply replies respond response responses disqus discussion thread feedback reviews",
    "form": "form search login signin register contact",
    "social": "share sharing social follow facebook twitter author byline meta",
    "hidden": "hidden none invisible offscreen sr",
}
# ----------------------------------------------------------------------------------------------------------
GROUP_OF_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
TEXT_RUN, OTHER = len(TAG_GROUPS), len(TAG_GROUPS) + 1
GROUP_OF_TOKEN = {t: 1 << i for i, g in enumerate(ATTRIBUTE_GROUPS.values()) for t in g.split()}
_P, _HEADING, _ITEM = GROUP_OF_TAG["p"], GROUP_OF_TAG["h1"], GROUP_OF_TAG["li"]
# an open element of the key is closed by a start tag of the values
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
              "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
_SCOPES = frozenset("ul ol dl table td th body html article section div blockquote form aside".split())
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|aria-label|itemprop|hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                        re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LABEL = "data-training-label"


class Page:
    """Nodes of a page in document order, parents before children; ``texts`` are the texts of runs."""

    __slots__ = ("parent", "group", "tokens", "texts", "links", "inline", "controls", "images", "label",
                 "depth")

    def __init__(self):
        for name in self.__slots__:
            setattr(self, name, [])

    def add(self, parent: int, group: int, tokens: int = 0, text: str | None = None, links: int = 0,
            label: int = 0) -> int:
        for name, value in zip(self.__slots__, (parent, group, tokens, text, links, 0, 0, 0, label,
                                                self.depth[parent] + 1 if parent >= 0 else 0)):
            getattr(self, name).append(value)
        return len(self.parent) - 1


def attribute_tokens(attributes: str) -> int:
    """Groups (bits) of the words in class, id, role and label attributes."""
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "hidden" or name.lower() == "style":
            if name.lower() == "hidden" or _HIDDEN.search(value):
                found |= GROUP_OF_TOKEN["hidden"]
        else:
            for token in _TOKEN.findall(value):
                found |= GROUP_OF_TOKEN.get(token.lower(), 0)
    return found


def tokens_of(page: str):
    """(text, closing, tag, attributes) in page order; text outside tags comes with an empty tag.

    Comments and declarations are left out, as is what an unclosed tag leaves over.  Where quotes of one tag stay open,
    tags end at the next ``>`` from there on, so every character is looked at a bounded number of times.
    """
    at, end, pattern, lower = 0, len(page), _TAG, None
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield page[at:], "", "", ""
            return
        if start > at:
            yield page[at:start], "", "", ""
        following = page[start + 1:start + 2]
        if following in ("!", "?") or page.startswith("</", start) and not page[start + 2:start + 3].isalpha():
            close = page.find("-->", start + 4) if page.startswith("<!--", start) else page.find(">", start + 1)
            at = end if close < 0 else close + (3 if page.startswith("<!--", start) else 1)
            continue
        if not following.isascii() or not following.isalpha() and following != "/":
            yield "<", "", "", ""
            at = start + 1
            continue
        found = pattern.match(page, start)
        if not found and pattern is _TAG:
            pattern = _PLAIN
            found = pattern.match(page, start)
        if not found:
            return
        closing, tag, attributes = found.groups()
        tag, at = tag.lower(), found.end()
        yield "", closing, tag, attributes
        if tag in RAW_TEXT and not closing:
            if lower is None:
                lower = page.lower() if len(page.lower()) == end else page
            close = lower.find(f"</{tag}", at)
            at = end if close < 0 else close


def parse(page: str) -> Page:
    """The block-level tree of a page; an empty page is its root alone."""
    out = Page()
    stack = [(out.add(-1, GROUP_OF_TAG["html"]), "#root", 0)]  # (node, tag, label)
    text, link_chars, link_depth, muted = [], 0, 0, 0

    def flush():
        nonlocal text, link_chars
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            if run:
                out.add(stack[-1][0], TEXT_RUN, 0, run, min(link_chars, len(run)), stack[-1][2])
            text, link_chars = [], 0

    def pop_to(depth):
        nonlocal link_depth
        del stack[depth:]
        if link_depth > len(stack):
            link_depth = 0

    for chunk, closing, tag, attributes in tokens_of(page):
        if not tag:
            if not muted:
                text.append(chunk)
                if link_depth:
                    link_chars += len(chunk.strip())
            continue
        if tag in NEVER_TEXT:
            if tag in CONTROLS and not closing:
                out.controls[stack[-1][0]] += 1
            if closing:
                muted = max(0, muted - 1)
            elif not attributes.endswith("/"):
                muted += 1
            continue
        if muted:
            if tag != "body":
                continue
            muted = 0  # a head that was never closed
        if tag == "a":
            link_depth = 0 if closing else len(stack)
        group = GROUP_OF_TAG.get(tag, OTHER if "-" in tag else None)
        if group is None or tag == "hr":  # inline
            node = stack[-1][0]
            if not closing:
                out.inline[node] += 1
                out.controls[node] += tag in CONTROLS
                out.images[node] += tag in ("img", "picture")
                if tag in ("br", "hr"):
                    text.append(" ")
            if tag == "hr":
                flush()
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] == tag:
                    pop_to(depth)
                    break
                if tag == "p" and stack[depth][1] in _SCOPES:
                    break
            continue
        if tag in ("html", "body"):
            if attributes:
                out.tokens[0] |= attribute_tokens(attributes)
            continue
        while len(stack) > 1:  # end tags that this start tag implies
            closes = _CLOSED_BY.get(stack[-1][1], ())
            if closes is None or tag in closes:
                pop_to(len(stack) - 1)
            else:
                break
        label = stack[-1][2]
        if LABEL in attributes:
            label = int(attributes.split(LABEL + "=", 1)[1][1])
        node = out.add(stack[-1][0], group, attribute_tokens(attributes) if attributes else 0, None, 0, label)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((node, tag, label))
    flush()
    return out


_COUNTED = re.compile(r"[.,;:!?。，！？]")
_SYMBOLS = re.compile(r"[©®|»«·•›→]")
SUMS = ["chars", "links", "words", "points", "symbols", "digits", "runs", "nodes", "inline", "controls", "images",
        "p_chars", "heading_chars", "items"]
FEATURES = (["depth", "children", "position", "siblings", "alike", "page_chars", "before", "chars", "own_chars",
             "link_share", "density", "nodes", "words_a_run", "points_a_word", "symbols", "digits", "controls",
             "images", "p_share", "heading_share", "item_share", "page_share", "parent_chars", "parent_links",
             "parent_share", "previous_chars", "next_chars", "previous_links", "next_links", "siblings_links",
             "siblings_chars"]
            + [f"tag {g}" for g in [*TAG_GROUPS, "text run", "other"]]
            + [f"parent {g}" for g in [*TAG_GROUPS, "text run", "other"]]
            + [f"above {g}" for g in TAG_GROUPS]
            + [f"own {g}" for g in ATTRIBUTE_GROUPS] + [f"above {g}" for g in ATTRIBUTE_GROUPS])


class Nodes:
    """Nodes of several pages as arrays: page, parent (-1 for roots), depth, features (a row each), labels."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        offset = np.concatenate([[0], np.cumsum(sizes)])
        self.offset = offset
        n = int(offset[-1])
        column = lambda name, kind=np.float64: np.fromiter(
            (v for p in pages for v in getattr(p, name)), kind, n)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.parent = column("parent", np.int64)
        self.parent = np.where(self.parent >= 0, self.parent + offset[self.page], -1)
        self.group, tokens = column("group", np.int64), column("tokens", np.int64)
        self.texts = [t for p in pages for t in p.texts]
        self.depth = column("depth", np.int64)
        runs = np.flatnonzero(self.group == TEXT_RUN)
        s = {name: np.zeros(n) for name in SUMS}
        texts = [self.texts[i] for i in runs]
        s["chars"][runs] = [len(t) for t in texts]
        s["words"][runs] = [t.count(" ") + 1 for t in texts]
        s["points"][runs] = [len(_COUNTED.findall(t)) for t in texts]
        s["symbols"][runs] = [len(_SYMBOLS.findall(t)) for t in texts]
        s["digits"][runs] = [sum(map(t.count, "0123456789")) for t in texts]
        s["links"], s["inline"], s["controls"], s["images"] = (column(c) for c in ("links", "inline", "controls", "images"))
        s["runs"][runs], s["nodes"][:] = 1, 1
        above = np.where(self.parent >= 0, self.group[self.parent], -1)
        s["p_chars"] = np.where(above == _P, s["chars"], 0)
        s["heading_chars"] = np.where(above == _HEADING, s["chars"], 0)
        s["items"] = (self.group == _ITEM).astype(float)
        own = np.zeros(n)
        child_of = self.parent[runs]
        np.add.at(own, child_of[child_of >= 0], s["chars"][runs][child_of >= 0])
        before_run = np.cumsum(s["chars"]) - s["chars"]
        before = before_run - before_run[offset[:-1]][self.page] if n else before_run
        inherited, above_tags = tokens.copy(), np.int64(1) << self.group
        levels = np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1])
        for level in levels[1:]:
            inherited[level] |= inherited[self.parent[level]]
            above_tags[level] |= above_tags[self.parent[level]]
        for level in levels[:0:-1]:
            for values in s.values():
                np.add.at(values, self.parent[level], values[level])
        self.levels = levels
        self.features = self._features(s, own, before, tokens, inherited, above_tags) if n else np.zeros((len(FEATURES), 0))
        labels = column("label", np.int64) * (self.group == TEXT_RUN)
        for level in levels[:0:-1]:  # a node holds main text where a run of its subtree does
            np.maximum.at(labels, self.parent[level], labels[level])
        self.labels = labels

    def _features(self, s, own, before, tokens, inherited, above_tags) -> np.ndarray:
        n, parent = len(self.parent), self.parent
        root = parent < 0
        safe = np.where(root, np.arange(n), parent)
        share = lambda a, b: a / np.maximum(b, 1)
        children = np.zeros(n)
        np.add.at(children, parent[~root], 1)
        order = np.lexsort((np.arange(n), safe, self.page))
        order = order[~root[order]]
        first = np.ones(len(order), bool)
        first[1:] = parent[order][1:] != parent[order][:-1]
        starts = np.flatnonzero(first)
        rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
        position = np.zeros(n)
        position[order] = rank
        siblings = np.where(root, 0, children[safe])
        groups = len(TAG_GROUPS) + 2
        alike_key = safe * groups + self.group
        _, inverse, counts = np.unique(alike_key, return_inverse=True, return_counts=True)
        previous, following = np.full(n, -1), np.full(n, -1)
        if len(order):
            previous[order[1:]] = np.where(first[1:], -1, order[:-1])
            following[order[:-1]] = np.where(first[1:], -1, order[1:])
        page_chars = s["chars"][self.offset[:-1]][self.page]
        links = share(s["links"], s["chars"])
        at = lambda values, index: np.where(index >= 0, values[index], -1)
        chars = np.log1p(s["chars"])
        columns = [
            self.depth, children, share(position, siblings), siblings, counts[inverse] / np.maximum(siblings, 1),
            np.log1p(page_chars), share(before, page_chars), chars, np.log1p(own), links,
            s["chars"] / (s["nodes"] + s["inline"]), np.log1p(s["nodes"]), share(s["words"], s["runs"]),
            share(s["points"], s["words"]), share(s["symbols"], s["words"]), share(s["digits"], s["chars"]),
            s["controls"], s["images"], share(s["p_chars"], s["chars"]), share(s["heading_chars"], s["chars"]),
            share(s["items"], s["nodes"]), share(s["chars"], page_chars), chars[safe], links[safe],
            share(s["chars"], s["chars"][safe]), at(chars, previous), at(chars, following), at(links, previous),
            at(links, following), share(s["links"][safe] - s["links"], s["chars"][safe] - s["chars"]),
            share(s["chars"][safe] - s["chars"], np.maximum(siblings - 1, 1))]
        out = np.empty((len(FEATURES), n), np.float32)  # a row a feature
        for i, values in enumerate(columns):
            out[i] = values
        i = len(columns)
        above_parent, tags_parent = np.where(root, 0, inherited[safe]), np.where(root, 0, above_tags[safe])
        parent_group = np.where(root, -1, self.group[safe])
        bits = range(len(ATTRIBUTE_GROUPS))
        for flags in ([self.group == g for g in range(groups)], [parent_group == g for g in range(groups)],
                      [tags_parent >> g & 1 for g in range(len(TAG_GROUPS))], [tokens >> b & 1 for b in bits],
                      [above_parent >> b & 1 for b in bits]):
            out[i:i + len(flags)] = flags
            i += len(flags)
        return out
