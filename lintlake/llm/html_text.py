"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its number of words and its link density,
the same of the blocks before and after it, and by the element that holds it. A decision tree, grown from the small
table of blocks that `labelled_pages` give, tells main text from the rest. Each page is handled by itself
inside a map task; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by role, from the HTML standard.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
_CHROME = frozenset("aside button dialog fieldset footer header label legend menu nav option search select".split())
_CLOSES_SELF = frozenset("p li dt dd option tr td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p blockquote pre".split())
# Words of class and id names: of what is not main text, of what is, and of names that only tell a state.
_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promos promoted related replies reply share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
_MAIN = frozenset("article body content entry main page post section story text".split())
_STATE = frozenset("has is js no show hide with without enabled disabled open opened closed active visible hidden on off layout".split())
_FILLER = frozenset("a an and at by for from in of on or the to".split())
# Words that say where or in what shape something stands, so that a name of them and of aside words is sure.
_SHAPE = frozenset(
    "area bar block bottom box container footer global group header holder inner left list main outer panel primary right secondary site slot sticky thread top unit wrap wrapper".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_EMBEDDED = frozenset("template svg noscript iframe".split())
_EMBEDDED_TAG = re.compile(r"<(/?)(template|svg|noscript|iframe)\b[^>]*>", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_]+")
_OWN = ("in_article", "in_chrome", "hinted", "heading", "paragraph")
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", *_OWN)


def _hints(name: str) -> int:
    """Whether one class or id name names what is not main text: 2 if it surely does, 1 if it may, else 0.

    Names of states and slugs of titles don't. A name is sure if it has no other words than those of `_ASIDE` and `_SHAPE`.
    """
    words = [w.lower() for w in _HUMP.split(name) if w]
    if not words or len(words) > 3 or not {words[0], words[-1]} & _ASIDE or set(words) & (_STATE | _FILLER):
        return 0
    if words[-1] == "header" and words[0] in _MAIN:  # the header of an article has its title
        return 0
    return 2 if all(w in _ASIDE or w in _SHAPE for w in words) else 1


def _hinted(tag: str, attributes: str) -> int:
    """The surest hint of an element's own class, id and role. A name of main text beside them outweighs them."""
    names = "".join(f" {''.join(m)}" for m in _NAMED.findall(attributes)).split()
    if tag in ("html", "body", "main") or tag in _HEADINGS or any(n.lower() in _MAIN for n in names):
        return 0
    if tag == "article":  # only a name that is such a word, as of a reader's comment
        return 2 * any(n.lower() in _ASIDE for n in names)
    return max(map(_hints, names), default=0)


def _embedded_ends(page: str) -> dict[int, int]:
    """Where each svg, template, noscript and iframe element that has an end tag ends, by where it begins.

    One scan from the end to the start: svg and template end at the next end tag of their name, the others only if none
    of their name begins before it.
    """
    ends, after = {}, {}
    for m in reversed(list(_EMBEDDED_TAG.finditer(page))):
        name = m[2].lower()
        if m[1]:
            after[name] = m.end()
        else:
            if name in after and not m[0].endswith("/>"):
                ends[m.start()] = after[name]
            if name in ("noscript", "iframe"):
                after.pop(name, None)
    return ends


def blocks(page: str) -> list[tuple]:
    """(text, words, words in links, *`_OWN`) of the blocks of a page, in order.

    References are decoded and white space becomes one space. Scripts, styles and comments hold no text,
    nor does the head, which ends where anything stands that can't be in it. Self-closed and unclosed svg, template,
    noscript and iframe elements are empty. Main, and a page's only article, are main text whatever holds them. A form is
    chrome unless it holds an article, or most words of the page and a heading. Titles in an article's header are not. A
    name that may but need not mean something else than main text is no hint where most of the page's text outside of chrome, links
    and sure hints has such names.
    """
    found, forms = [], [[0, False, False]]  # forms: words, article inside, heading inside; the first is the page
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, in_article, in_chrome, hint, form
    parts: list[str] = []
    linked: list[str] = []
    link, alone = False, len(re.findall(r"<article\b", page, re.I)) == 1

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            tag, article, chrome, hint, form = stack[-1] if stack else ("", False, False, 0, 0)
            heading = tag in _HEADINGS
            if heading and chrome and article and all(t not in _CHROME or t == "header" for t, *_ in stack):
                chrome = False
            found.append([text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), article, chrome, hint, heading, tag in _PARAGRAPHS, form])
        parts.clear()
        linked.clear()

    at, embedded = 0, _embedded_ends(page)
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked.append(parts[-1])
        at = embedded.get(m.start(), m.end())
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag or m.start() in embedded:
            continue
        tag = tag.lower()
        if tag == "a":
            link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            flush()
            if closing:
                at_tag = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if at_tag is not None:
                    del stack[at_tag:]
            elif tag != "hr":
                if stack and (stack[-1][0] == "p" or (tag == stack[-1][0] and tag in _CLOSES_SELF)):
                    stack.pop()
                _, article, chrome, hint, form = stack[-1] if stack else ("", False, False, 0, 0)
                own = _hinted(tag, attributes) if "=" in attributes else 0
                if tag == "form":
                    forms.append([0, False, False])
                    form = len(forms) - 1
                elif tag in ("article", "main") and not own:
                    forms[form][1] = True
                    if tag == "main" or alone:
                        chrome, hint = False, 0
                forms[form][2] |= tag in _HEADINGS
                stack.append((tag, article or tag in ("article", "main"), chrome or tag in _CHROME, max(hint, own), form))
    parts.append(page[at:])
    if link:
        linked.append(parts[-1])
    flush()
    for block in found:
        forms[block[-1]][0] += block[1]
    total = sum(f[0] for f in forms)
    for block in found:
        words, article, heading = forms[block[-1]]
        block[4] |= bool(block[-1]) and not (article or (heading and 2 * words > total))
    plain = [sum(b[1] - b[2] for b in found if not b[4] and b[5] == hint) for hint in (0, 1)]
    for block in found:
        block[5] = block[5] == 2 or (block[5] == 1 and plain[1] <= plain[0])
    return [tuple(block[:-1]) for block in found]


def features(found: list[tuple]) -> np.ndarray:
    """A row of `FEATURES` for each block; a missing neighbour has no words."""
    own = np.array([(x[1], min(1.0, x[2] / x[1])) for x in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    return np.hstack([own, before, after, np.array([x[3:] for x in found], float).reshape(-1, len(_OWN))])


_MARK = "¶"  # starts the main text blocks of labelled pages
_PROSE = (
    "the river rose in the night and by morning the lower road was under water so the carts went round by the mill and came late to market where "
    "nobody had seen it so high since the year of the two harvests and few of them slept before the rain had gone"
).split()


def _text(words: int, main: bool = False, links: int = 0) -> str:
    own = [_PROSE[k % len(_PROSE)] for k in range(words)]
    own[0] = (_MARK if main else "") + own[0]
    return f"<a href=/>{' '.join(own[:links])}</a> {' '.join(own[links:])}" if links else " ".join(own)


def _run(tag: str, words: tuple[int, ...], main: bool = False, linked: bool = False) -> str:
    return "".join(f"<{tag}>{_text(n, main, n if linked else 0)}</{tag}>" for n in words)


def labelled_pages() -> list[str]:
    """The small labelled table: pages of the usual shapes, with texts of several lengths; `_MARK` starts what is main text.

    Inside articles all is main text but runs of links. Elsewhere a short block is told by its neighbours: beside text
    it belongs to it; between links, at the edge of the page or before links it is a menu, a site's name or a button.
    """
    pages = []
    for s, n in ((1, 9), (2, 14), (3, 22), (4, 40), (6, 75), (8, 160)):  # words of short and of long blocks
        menu, short = f"<ul>{_run('li', (1, 2, s, 3, 1), linked=True)}</ul>", _run("p", (s,), True)
        body = _run("p", (n, n + 7), True) + short + _run("p", (n, 3, n + 5), True)
        pages += [
            f"<nav>{menu}</nav><div class=ad>{_text(n)}</div><article><h1>{_text(s, True)}</h1>{body}<ul>{_run('li', (1, s, 1), True)}</ul></article><footer>{_text(s)}</footer>",
            f"<header>{_text(s)}</header><main>{_run('h2', (s,), True)}{body}<p>{_text(n, True, 4)}</p>{menu}<p>{_text(6, True, 6)}</p>{_run('p', (n,), True)}</main><aside>{_run('p', (n, s))}</aside>",
            f"<div class=sidebar>{_run('p', (n, s))}</div><article>{_run('h1', (s,), True)}{_run('p', (2, n), True)}<form>{_run('p', (s,))}</form>{_run('div', (n, s), True)}</article><div id=comments>{_run('p', (n, s, n))}</div>",
            f"<article><header><h1>{_text(5, True)}</h1><p>{_text(s)}</p></header>{_run('p', (n, n), True)}<table><tr>{_run('td', (1, s, 2), True)}</tr></table><footer>{_text(s)}</footer></article><div class=newsletter>{_text(n)}</div>",
            f"<div>{_text(s)}</div>{menu}{_run('h1', (s,), True)}{body}{_run('h2', (s,), True)}{_run('p', (n,), True)}<ul>{_run('li', (1, s, 1), True)}</ul>{_run('p', (n,), True)}<p>{_text(9, links=9)}</p><div>{_text(s)}</div>{menu}",
            f"<div>{_text(s)}</div><div>{_run('h1', (s,), True)}{short}{body}</div><div>{_text(s)}</div>{menu}<div>{_text(s)}</div>",
            f"<table><tr>{_run('td', (1, s), linked=True)}<td>{_text(s)}</td><td>{_text(8, links=7)}</td></tr></table><td>{_text(n, True)}</td>{short}<td>{_text(n + 9, True)}</td>{menu}<p>{_text(s)}</p>{menu}",
            f"{body}{short}",
            f"{_run('h1', (s,), True)}{short}{body}",
            f"{_run('h1', (s,), True)}<div>{_text(n, True)}</div>{short}{menu}",
            f"<div>{_text(n, True)}</div>",
            f"<div>{_text(n, True)}</div>{_run('p', (n, s), True)}<div>{_text(n, True)}</div>",
            f"{menu}<div>{_text(n, True)}</div>{menu}<div>{_text(n + 3, True)}</div><div>{_text(s, True)}</div>",
            f"<article>{_run('p', (n,), True)}<p>{_text(12, True, 12)}</p><p>{_text(s, True, s)}</p>{_run('p', (n,), True)}<p>{_text(20, True, 19)}</p></article>{_run('p', (s,), linked=True)}",
            f"{menu}<article>{_run('h1', (s,), True)}{_run('div', (n, s, n), True)}{short}{menu}</article><p>{_text(s, links=s)}</p>",
            f"{menu}<article>{_run('div', (s, n, n, s), True)}{menu}{_run('div', (s,), True)}</article>",
            f"{menu}<div>{_text(n, True)}</div><div>{_text(s, True)}</div><div>{_text(n, True, 2)}</div><div>{_text(5, links=4)}</div><div>{_text(20, links=18)}</div>",
        ]
        for order in (order for k in (1, 2, 3) for order in product((s, n), repeat=k)):
            pages += [f"<article>{_run(tag, order, True)}{end}</article>" for tag in ("p", "div") for end in ("", menu)]
            if n in order:
                pages += [f"{start}{_run('p', order, True)}{end}" for start in ("", menu) for end in ("", menu)]
    pages.append(f"<nav><p>{_text(1)}</p></nav><article>{_run('h1', (1,), True)}{_run('p', (1,), True)}</article><footer><p>{_text(1)}</p></footer>")
    return pages


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    found = [blocks(page) for page in labelled_pages()]
    return np.vstack([features(x) for x in found]), np.array([text.startswith(_MARK) for x in found for text, *_ in x])


def grown_tree(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """A decision tree: a share of main text at a leaf, else (feature, threshold, tree at or below, tree above)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return float(share)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):  # among equal splits, words and densities go first
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            score = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if score < best[0] - 1e-12:
                best = (score, f, cut)
    if best[0] == np.inf:
        return float(share)
    _, f, cut = best
    low = x[:, f] <= cut
    return f, float(cut), grown_tree(x[low], y[low], depth - 1), grown_tree(x[~low], y[~low], depth - 1)


def _judged(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree > 0.5)
    f, cut, low, high = tree
    below = x[:, f] <= cut
    out = np.zeros(len(x), bool)
    out[below], out[~below] = _judged(low, x[below]), _judged(high, x[~below])
    return out


@cache
def block_tree():
    """The tree of the labelled table."""
    return grown_tree(*labelled_table())


def main_text(page: str, tree=None) -> str:
    """The main text: its blocks in page order, two line ends between."""
    found = blocks(page)
    if not found:
        return ""
    kept = _judged(tree or block_tree(), features(found))
    return "\n\n".join(x[0] for x, k in zip(found, kept, strict=True) if k)


def page_texts(pages: DataFrame, carried: list[str]) -> DataFrame:
    """The columns `carried` of every row of `pages`, text and n_chars.

    A null or empty page has an empty text; cut-off markup at the end of a page is dropped; repeated rows each get
    a row; an empty table gives an empty one; further columns are ignored.
    """
    schema = pages.select(*carried).schema.simpleString()[7:-1]
    tree = block_tree()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch["_html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in range(len(carried))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*carried, "text", "n_chars"]
            )

    return pages.select(*carried, F.coalesce("html", F.lit("")).alias("_html")).mapInArrow(extracted, f"{schema}, text string, n_chars bigint")
