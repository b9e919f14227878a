"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at its block-level tags. Each block has its number of words and its link density, those
of the blocks before and after it, and what its markup says of it: inside an article or not, and a mark of how clearly
tags, roles and class names call it something else (menu, footer, advert, comment and so on). A decision tree decides
which blocks are main text. It is trained on a small labelled table: the blocks of the sample pages below, in a few
layouts and lengths, with the same features.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Elements whose content is never text; that of the first four is no markup either.
RAW = "script style textarea title".split()
DROPPED = frozenset([*RAW, *"noscript template svg select button object iframe canvas audio video datalist".split()])
#: Elements that a block does not reach across.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: Form controls, and block elements that hold no blocks.
CONTROLS = frozenset("button input label option select textarea".split())
LEAVES = frozenset("p hr".split())
#: Elements and roles that are not main text.
BOILERPLATE_TAGS = frozenset("aside dialog footer head header menu nav search".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
#: What a class or id may call an element. The first mark it clearly, also around or on an article.
CLEAR_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense comment comments commentlist consent cookie disqus
    newsletter paywall popup promo replies respond signup sponsor sponsored subscribe""".split()
)
HINT_WORDS = frozenset(
    """alert alerts banner breadcrumb breadcrumbs cookies copyright disclaimer dropdown feedback foot footer form gdpr head header hidden login
    masthead menu menubar modal nav navbar navigation notice notification overlay pager pagination promotion related search share sharing sidebar skip
    social subscription toolbar topbar warning widget""".split()
)
#: Words that only say that an element holds something; the word before them names it.
NEUTRAL_WORDS = frozenset(
    "area articles bar block body bottom box buttons col column container content group holder inner item items left links list main outer panel posts right row section slot stories text thread top unit wrap wrapper zone".split()
)
_HEADERS = frozenset({"header", "head"})
#: Whose header is part of the text, where a name says it.
OWN_HEADERS = frozenset("article content entry page post story".split())
CLEAR, HINT = 2.0, 1.0
_RAW = "|".join(RAW)
_SPECIAL = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:{_RAW})\b[^>]*+(?<!/)>(?:(?!<(?:{_RAW})\b).)*?</(?:{_RAW})\s*>|<[!?][^>]*+>", re.I | re.S)
_QUOTED = re.compile(r"""<(/?)([a-z][^\s/>]*+)((?:[^'">]|"[^"]*"|'[^']*')*+)>""", re.I | re.S)
_PLAIN = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>]*+)>", re.I | re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Block(NamedTuple):
    """One flat block: its text, and what the decision tree sees of it alone. ``form`` numbers the innermost form."""

    text: str
    words: int
    link_words: int
    in_article: bool
    mark: float
    form: int


def _named(name: str, allowed: frozenset) -> float:
    """The mark of one class name or id: that of its last word that says more than that it holds something."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words or {"has", "with", "no", "without"} & set(words):
        return 0.0
    while len(words) > 1 and words[-1] in NEUTRAL_WORDS:
        words.pop()
    word = words[-1]
    if word in _HEADERS and words[0] in OWN_HEADERS:
        return 0.0
    return 0.0 if word in allowed else CLEAR if word in CLEAR_WORDS else HINT if word in HINT_WORDS else 0.0


def _mark(tag: str, attributes: str, in_article: bool) -> float:
    """How clearly an element says of itself that it is no main text; an article's own header does not."""
    allowed = _HEADERS if in_article else frozenset()
    if tag in BOILERPLATE_TAGS - allowed:
        return CLEAR
    mark = 0.0
    if attributes and tag not in ("html", "body", "main"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                mark = CLEAR
            elif name == "role" and value in BOILERPLATE_ROLES:
                mark = CLEAR
            elif name in ("class", "id"):
                mark = max([mark, *(_named(x, allowed) for x in value.split())])
    return mark if tag != "article" or mark == CLEAR else 0.0


class Token(NamedTuple):
    """A tag, or with an empty name a comment, a declaration or an element whose content is no text."""

    start: int
    stop: int
    ends: bool
    tag: str
    attributes: str


def tokens(page: str) -> Iterator[Token]:
    """The tags of a page in order, in time that grows with the page: quotes that nothing closes are read as far as the
    next ``>``, and once such searches have passed over the page four times, quotes mean nothing."""
    end, at, passed = page.rfind(">") + 1, 0, 0
    while (at := page.find("<", at, end)) >= 0:
        m = _SPECIAL.match(page, at, end)
        if m:
            yield Token(at, m.end(), False, "", "")
            at = m.end()
            continue
        m = _QUOTED.match(page, at, end) if passed <= 4 * end else None
        if m is None:
            m = _PLAIN.match(page, at, end)
            passed += end - at if m else 0
        if m:
            yield Token(at, m.end(), bool(m[1]), m[2].lower(), m[3])
        at = m.end() if m else at + 1


def _unclosed(found: list[Token]) -> set[int]:
    """Places of the start tags of dropped elements that no end tag closes."""
    opened: dict[str, list[int]] = {}
    for t in found:
        if t.tag in DROPPED:
            if not t.ends:
                opened.setdefault(t.tag, []).append(t.start)
            elif opened.get(t.tag):
                opened[t.tag].pop()
    return {at for places in opened.values() for at in places}


def flat_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without empty ones.

    An element that nothing closes ends with its parent; one whose content is dropped ends at the next block tag then.
    A form's blocks are marked if the form holds controls and few words for them.
    """
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    # of open elements: tag, and the state outside: whether text is dropped, in an article, mark, links, form
    stack: list[tuple] = []
    opened: Counter = Counter()  # of the tags on the stack, so that a stray end tag does not search it
    found = list(tokens(page))
    open_ended = _unclosed(found)
    dropped = in_article = loose = False
    mark, links, form, at = 0.0, 0, -1, 0
    forms: list[list[int]] = []  # controls and words

    def close() -> None:
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append(Block(whole, whole.count(" ") + 1, len(html.unescape("".join(linked)).split()), in_article, mark, form))
            if form >= 0:
                forms[form][1] += whole.count(" ") + 1
        text.clear()
        linked.clear()

    def enter(tag: str) -> None:
        stack.append((tag, dropped, in_article, mark, links, form))
        opened[tag] += 1

    def leave(depth: int) -> tuple:
        outside = stack[depth]
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]
        return outside

    for start, stop, ends, tag, attributes in found:
        if start > at and not dropped and not loose:
            text.append(page[at:start])
            if links:
                linked.append(page[at:start])
        at = stop
        if not tag:
            continue
        if tag in CONTROLS and not ends and form >= 0:
            forms[form][0] += 1
        if tag in DROPPED:
            if not ends and not attributes.endswith("/"):
                if start in open_ended:
                    loose = True
                else:
                    enter(tag)
                    dropped = True
            elif ends and stack and stack[-1][0] == tag:
                dropped = leave(len(stack) - 1)[1]
        elif tag == "a":
            links = 0 if ends else 1
        elif tag == "br":
            text.append(" ")
            linked.append(" ")
        elif tag in BLOCK_TAGS:
            if dropped and not ends:
                enter(tag)
                continue
            loose = False
            depth = None
            if ends:
                depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag) if opened[tag] else None
                if depth is None and dropped:
                    continue
            elif stack and stack[-1][0] in LEAVES:
                depth = len(stack) - 1  # a new block ends a paragraph
            close()
            if depth is not None:
                _, dropped, in_article, mark, links, form = leave(depth)
            if not ends:
                if tag != "hr":
                    enter(tag)
                if tag in ("article", "main") and not in_article and mark == HINT:
                    mark = 0.0  # hints outside do not reach into an article
                mark = max(mark, _mark(tag, attributes, in_article)) if tag != "hr" else mark
                in_article = in_article or tag in ("article", "main")
                if tag == "form":
                    forms.append([0, 0])
                    form = len(forms) - 1
    if at < len(page) and not dropped and not loose:
        text.append(page[at:].split("<")[0] if re.search(r"<[a-z/!][^>]*\Z", page[at:], re.I) else page[at:])
    close()
    inputs = {i for i, (controls, words) in enumerate(forms) if controls and words < 15 * (controls + 1)}
    return [b._replace(mark=CLEAR) if b.form in inputs else b for b in out]


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in article", "mark", "page has article")


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block, in the order of ``FEATURES``."""
    words = np.array([b.words for b in blocks], float)
    density = np.array([min(1.0, b.link_words / b.words) for b in blocks])
    article = np.array([b.in_article for b in blocks], float)
    shift = lambda x, k: np.r_[np.zeros(1), x[:-1]] if k < 0 else np.r_[x[1:], np.zeros(1)]
    return np.column_stack(
        [words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), article, np.array([b.mark for b in blocks], float), np.full(len(blocks), article.max(initial=0))]
    )


#: Sample pages; {n} stands for n words, and a block that begins with + is main text.
SAMPLES = [
    # an article among everything that is marked
    """<header><h1>{2}</h1></header><nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a></ul></nav><div class=ad>{9}</div><div class=cookie-notice>{30} <a>{3}</a></div>
    <article><header><h1>+ {9}</h1></header><p>+ {60}<p>+ {3}<p>+ {45} <a>{6}</a><h2>+ {4}</h2><p>+ {1}<blockquote>+ {15}</blockquote><ul><li>+ {6}<li>+ {4}</ul><p>+ {80}
    <div class=ad>{12}</div><p>+ {25}<p>+ <a>{2}</a><p>+ {7} <a>{9}</a></p><section class=comments><h3>{2}</h3><p>{40}<p>{3}<p>{75}</section></article>
    <aside><h2>{3}</h2><p>{35}</aside><footer>{20} <a>{1}</a></footer>""",
    "<nav><a>{2}</a></nav><main><h1>+ {6}</h1><p>+ {2}<p>+ {20}<p>+ {90}<div class=newsletter>{25}</div><p>+ {1}<p>+ {12}</main><div class=sponsored>{50}</div><div id=comments><article class=comment>{35}</article></div><footer>{6}</footer>",
    "<article><h1>+ {4}</h1><p>+ {10}<p>+ {5}</article><footer>{60}</footer>",
    "<div class=ad>{90}</div><article><p>+ {1}</article><article><p>+ {30}<p>+ <a>{10}</a></article><div class=related-articles><h3>{2}</h3><a>{8}</a></div><div>{7}</div><div>{40}</div>",
    # the same without an article
    """<header>{3}</header><nav><ul><li><a>{1}</a><li><a>{2}</a></ul></nav><div class=advert>{35}</div><h1>+ {7}</h1><p>+ {60}<p>+ {8}<p>+ {45} <a>{4}</a><p>+ {1}<p>+ {30}<h2>+ {5}</h2>
    <p>+ {70}</p><div class=comments><p>{20}<p>{90}</div><aside><p>{30}</aside><footer>{12} <a>{2}</a></footer>""",
    "<div class=ads>{15}</div><div id=content><h1>+ {5}</h1><p>+ {25}<p>+ {4}<p>+ {50}</div><div class=sponsor>{40}</div><form><label>{2}</label><input><input></form>",
    # pages that mark nothing: menus, then a heading and paragraphs, then lists of links with a heading
    "<div><a>{1}</a></div><div><a>{2}</a></div><div><a>{1}</a></div><div><a>{3}</a></div><h1>+ {6}</h1><p>+ {70}<p>+ {40} <a>{5}</a><p>+ {8}<p>+ {55}<h2>+ {3}</h2><p>+ {60}</p><h4>{3}</h4><div><a>{7}</a></div><div><a>{9}</a></div><div><a>{6}</a></div><div>{4} <a>{5}</a></div>",
    "<table><tr><td><a>{2}</a><td><a>{1}</a><td><a>{2}</a></tr><tr><td>+ {40}</td></tr><tr><td>+ {90} <a>{8}</a></td></tr><tr><td>+ {12}</td></tr><tr><td>{2}</td></tr><tr><td><a>{5}</a><td><a>{9}</a><td>{1} <a>{6}</a></tr></table>",
    "<div>{2} <a>{3}</a></div><div><a>{4}</a></div><div>+ {5}</div><div>+ {80}</div><div>+ {30}</div><div>+ {2}</div><div>+ {65}</div><div>{2}</div><div><a>{4}</a></div><div><a>{3}</a></div>",
    "<p>+ {15}",
    "<p>+ {60}<p>+ {20}<p>+ {3}<p>+ {40}",
    # hints: names that may or may not mean it
    "<div class=banner><a>{2}</a></div><div class=banner>{6}</div><div class=header>{4}</div><h1>+ {8}</h1><div class=notice>+ {70}</div><div class=header>+ {60}</div><p>+ {50}</p><div class=share>{3} <a>{2}</a></div><div class=related><a>{6}</a></div><div class=sidebar>{5} <a>{9}</a></div><div class=notice>{10}</div>",
    "<div class=sidebar><a>{4}</a></div><div class=social><a>{1}</a> {3}</div><p>+ {45}<p>+ {60}<div class=widget>+ {80}</div><p>+ {30}</p><div class=widget>{4}</div><div class=footer>{8} <a>{3}</a></div><div class=copyright>{6}</div>",
]

#: Kinds of blocks that articles, adverts and comments hold in any order.
KINDS = ["{2}", "{7}", "{12}", "{60}", "<a>{3}</a>", "<a>{12}</a>", "{8} <a>{9}</a>"]
SAMPLES += [f"<article><p>+ {a}<p>+ {b}<p>+ {c}</article>" for a, b, c in product(KINDS, repeat=3)]
SAMPLES += [f"<p>+ {{60}}<p>+ {{30}}</p><div class={name}><p>{a}<p>{b}</div><p>+ {{50}}" for name in ("ad", "comments") for a, b in product(KINDS, repeat=2)]
SAMPLES += [f"<article><p>+ {{30}}<div class={name}><p>{a}<p>{b}</div><p>+ {{12}}</article><footer>{a}</footer>" for name in ("ad", "comments") for a, b in product(KINDS, repeat=2)]
#: Texts that nothing marks, from one paragraph to several, up to the page's end.
SAMPLES += [f"<div><a>{{2}}</a></div><div><a>{{1}}</a></div><p>+ {a}<p>+ {b}<p>+ {c}" for a, b, c in product(["{12}", "{60}", "{20} <a>{3}</a>"], repeat=3)]
#: The same between a menu and a list of links under a heading of its own.
SAMPLES += [
    f"<div><a>{{{n}}}</a></div><div><a>{{1}}</a></div><div>+ {{{n}}}</div><div>+ {a}</div><div>+ {b}</div><div>+ {{{n}}}</div><div>+ {a}</div><div>{{{n}}}</div><div><a>{{{m}}}</a></div><div><a>{{{m}}}</a></div>"
    for a, b, n, m in product(["{30}", "{70}", "{40} <a>{6}</a>"], ["{12}", "{60}"], (2, 4, 7), (3, 7, 12))
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of the samples' blocks, in a few lengths of the texts, so that no chance length decides."""
    rows, labels = [], []
    for page, factor in product(SAMPLES, (0.5, 1.0, 1.7, 3.0)):
        blocks = flat_blocks(re.sub(r"\{(\d+)\}", lambda m: "w " * max(1, round(int(m[1]) * factor if int(m[1]) > 9 else int(m[1]))), page))
        labels += [b.text.startswith("+") for b in blocks]
        rows.append(features([b._replace(words=b.words - b.text.startswith("+")) for b in blocks]))
    return np.concatenate(rows), np.array(labels, float)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: ('leaf', share) or (feature, threshold, low, high)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return ("leaf", share)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < t
            gini = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t))
    if best is None:
        return ("leaf", share)
    _, f, t = best
    low = x[:, f] < t
    return (f, t, grow_tree(x[low], y[low], depth - 1), grow_tree(x[~low], y[~low], depth - 1))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Shares of main text, for rows of features."""
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    f, t, low, high = tree
    under = x[:, f] < t
    out = np.empty(len(x))
    out[under], out[~under] = classify(low, x[under]), classify(high, x[~under])
    return out


def main_text(page: str, tree: tuple) -> str:
    """The main text of one page, its blocks joined by line ends; empty if there is none."""
    blocks = flat_blocks(page)
    if not blocks:
        return ""
    kept = classify(tree, features(blocks)) >= 0.5
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``text`` and its length in code points for every page.

    A null html counts as empty and gives an empty text, as does a page without main text. Truncated pages, unclosed,
    self-closed and stray tags are read as far as they go; pages of any length are read whole. Each input row gives one
    output row, repeated and null ids included; other columns of ``pages`` are not read. An empty table gives an empty
    result.
    """
    tree = grow_tree(*labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = [main_text(p or "", tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    out = source.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
