"""Main text of web pages: a conditional random field over the leaf blocks of the page tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpaudit.llm import crf
from corpaudit.llm.common import in_arrow, text_slices

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content is no text of the page.
_SILENT = frozenset("script style noscript template title svg textarea select button iframe object head".split())
#: Silent elements that are skipped up to their end; those of the second list stand in the line.
_RAW = frozenset("script style title textarea iframe svg".split())
_RAW_INLINE = frozenset(["svg"])
#: Elements that stand in the line; all others begin and end a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br input "
    # formulas are text of the line that they stand in
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same list ends.
_ENDED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}}
_WORD = re.compile(r"[a-z]+")
#: Elements that a worker remembers between pages.
TREE_NODES = 100_000


class Node:
    """An element as its ancestors and its name tell; equal ones of all pages are one node of a tree."""

    __slots__ = ("tag", "words", "up", "fresh", "below", "scored")

    def __init__(self, name: str, up: Node | None, fresh: bool):
        self.tag, _, words = name.partition(".")
        self.words = words.split()
        self.up = up
        self.fresh = fresh  # no ancestor has this tag
        self.below: dict[str, Node] = {}
        self.scored: tuple | None = None

    def ancestors(self) -> list[Node]:
        """From the root down to this one, the root left out."""
        out, node = [], self
        while node.up is not None:
            out.append(node)
            node = node.up
        return out[::-1]


class Tree:
    """Nodes that pages share. Depth costs nothing: a node knows its parent, not its path."""

    def __init__(self) -> None:
        self.root = Node("", None, False)
        self.size = 0

    def below(self, up: Node, name: str, fresh: bool) -> Node:
        found = up.below.get(name)
        if found is None:
            found = up.below[name] = Node(name, up, fresh)
            self.size += 1
        return found


@dataclass
class Block:
    node: Node
    text: str
    linked: int  # characters inside links
    label: str | None = None  # of a labelled page


def _name(tag: str, rest: str) -> tuple[str, str | None]:
    words: list[str] = []
    label = None
    if "=" in rest:
        for key, *values in _ATTRIBUTE.findall(rest):
            if key.lower() in ("class", "id", "role"):
                words += _WORD.findall("".join(values).lower())
            elif key == "data-label":
                label = "".join(values)
    return (f"{tag}.{' '.join(words)}" if words else tag), label


def blocks(page: str, tree: Tree | None = None) -> list[Block]:
    """Leaf blocks of a page in page order, without empty ones; broken markup never fails."""
    tree = tree or Tree()
    out: list[Block] = []
    stack: list[tuple[str, Node, str | None]] = []  # tag, node, nearest label
    opened: Counter[str] = Counter()  # tags of the stack
    parts: list[str] = []
    linked = 0
    links = 0
    at = 0
    silent = 0  # depth of the stack below which nothing is text

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, node, label = stack[-1] if stack else ("", tree.root, None)
            out.append(Block(node, text, linked, label))
        parts.clear()
        linked = 0

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while at < len(page):
        found = _MARKUP.search(page, at)
        text = page[at:found.start() if found else len(page)]
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        tag = found["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in _INLINE:
                continue
            if not silent:
                flush()
            if opened[tag]:
                while close() != tag:
                    pass
            if silent and len(stack) < silent:
                silent = 0
            continue
        if tag in _INLINE:
            if tag == "a":
                links += 1
            elif tag == "br" and not silent:
                parts.append(" ")
            continue
        if not silent and tag not in _RAW_INLINE:
            flush()
        if tag in _VOID or found["rest"].endswith("/"):
            continue
        if tag == "body":
            stack.clear()
            opened.clear()
            silent = 0
        closing = _ENDED_BY.get(tag)
        if tag not in _RAW_INLINE and stack and (stack[-1][0] in closing if closing and stack[-1][0] in closing else stack[-1][0] == "p"):
            close()  # one of the same list, or a paragraph that a block ends
        if tag in _RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        name, label = _name(tag, found["rest"])
        _, up, above = stack[-1] if stack else ("", tree.root, None)
        stack.append((tag, tree.below(up, name, not opened[tag]), label or above))
        opened[tag] += 1
        if tag in _SILENT and not silent:
            silent = len(stack)
        links = 0
    if not silent:
        flush()
    return out


@lru_cache(maxsize=len(_RAW))
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE)


_HINT = re.compile(
    r"\b(cookies?|subscribe|newsletter|sign (?:in|up)|log in|privacy|terms|copyright|all rights reserved|advert\w*|sponsored|"
    r"share|follow us|related|comments?|repl(?:y|ies)|read more|menu|home|contact|search|posted by|says)\b|©|·"
)


def _is_article(tag: str) -> bool:
    return tag in ("article", "main")


def _near_features(node: Node) -> list[str]:
    """What the last three elements say."""
    tags = []
    while node.up is not None and len(tags) < 3:
        tags.append(node.tag)
        node = node.up
    named = [f"up{depth}={tag}" for depth, tag in enumerate(tags)]
    return ["bias", f"own={tags[0] if tags else '#'}", *named, "path=" + ">".join(reversed(tags))]


def _path_features(node: Node) -> list[str]:
    out, side, found = _near_features(node), [], "outer"
    for one in node.ancestors():
        out += [f"class={w}" for w in one.words]
        if one.fresh:
            out.append(f"in={one.tag}")
        # what is nearer to the block than the article around it
        if _is_article(one.tag):
            side, found = [], "inner"
        else:
            side.append(one.tag)
    return out + [f"{found}={tag}" for tag in side]


def _path_scores(node: Node, chain: crf.Chain) -> np.ndarray:
    """Scores of _path_features, each node's from its parent's: (sum of all ancestors, side, kind, scores)."""
    missing = []
    while node is not None and node.scored is None:
        missing.append(node)
        node = node.up
    zero = np.zeros(len(chain.labels))
    for one in reversed(missing):
        summed, side, kind, _ = one.up.scored if one.up is not None else (zero, zero, "outer", None)
        if one.up is not None:
            own = [f"class={w}" for w in one.words] + ([f"in={one.tag}"] if one.fresh else [])
            summed = summed + chain.scores([own])[0]
            if _is_article(one.tag):
                side, kind = zero, "inner"
            else:
                side = side + chain.scores([[f"{kind}={one.tag}"]])[0]
        one.scored = summed, side, kind, summed + side + chain.scores([_near_features(one)])[0]
        node = one
    return node.scored[3]


def _text_features(block: Block) -> list[str]:
    size = len(block.text)
    link = block.linked / size if size else 0
    out = [f"size={min(8, size.bit_length())}", f"link={'all' if link > 0.8 else 'some' if link > 0.2 else 'no'}"]
    if size < 200:
        out += [f"hint={h or 'sign'}" for h in set(_HINT.findall(block.text.lower()))]
    return out


# The labelled pages: own markup, every part labelled by its nearest data-label.
_PROSE = (
    "A long walk along the river took most of the day, and nobody minded the rain that fell on the way back home.",
    "Short note.",
    "Der alte Turm steht noch immer am Rand der Stadt, und wer hinaufsteigt, sieht bis zu den Bergen hinter dem See.",
    "Words without a stop",
    "Three people came, two of them late; the fourth sent word that he would be there before dark if the road was open.",
)
_FRAMES = (
    '<body><nav data-label="drop"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="ad" data-label="drop">{1}</div>'
    '<article data-label="keep"><h1>{1}</h1><p>{0}</p><p>{2}</p><p><b>{1}<br><p>{3}</article><footer data-label="drop">&copy; example.com &middot; {1}</footer>',
    '<body><header data-label="drop"><h1>Site name</h1><p>{1}</p></header><main data-label="keep"><h1>{1}</h1><p>{0}</p><ul><li>{1}</li><li>{3}</li></ul></main>'
    '<aside data-label="drop"><h3>Related</h3><p>{2}</p></aside><footer data-label="drop"><p>{0}</p></footer>',
    '<body><div class="header" data-label="drop">{1}</div><div class="menu" data-label="drop"><a href="/">{1}</a></div><div class="content" data-label="keep"><h2>{1}</h2><p>{0}</p>'
    '<blockquote>{3}</blockquote></div><div class="sidebar" data-label="drop"><p>{2}</p></div><div class="footer" data-label="drop">{0}</div>',
    '<body><div class="cookie notice banner" data-label="drop"><p>We use cookies. {0}</p></div><article data-label="keep"><header><h1>{1}</h1></header><p>{0}</p><p>{1}</p>'
    '<div class="ad" data-label="drop">{2}</div><p>{3}</p></article><section class="comments" id="comments" data-label="drop"><h3>Comments</h3><p>{0}</p><p>{2}</p></section>',
    '<body><div id="main" data-label="keep"><p>{3}</p><p>{1}</p><table><tr><td>{1}</td><td>{2}</td></tr></table><pre>{0}</pre></div><form data-label="drop"><p>Search: {1}</p>{2}</form>',
    '<body data-label="keep"><h1>{1}</h1><p>{0}</p><p>{2}</p><p>{1}</p></body>',
    '<body><article class="post" data-label="keep"><h1>{1}</h1><section><h2>{1}</h2><p>{3}</p></section><figure><figcaption>{1}</figcaption></figure><aside data-label="drop"><p>{2}</p></aside>'
    '<nav data-label="drop"><a href="/next">{1}</a></nav><footer data-label="drop"><p>Share: {1}</p></footer></article><div class="comment" data-label="drop"><p>{0}</p><p>{3}</p></div>',
    '<body><div class="advert promo sponsored" data-label="drop"><p>{0}</p></div><div class="article text" data-label="keep"><p>{2}</p><div>{0}</div><p>{1}</p></div><ol class="commentlist" data-label="drop">'
    '<li><p>{3}</p></li><li>{1}</li></ol><div class="newsletter subscribe popup" data-label="drop"><p>{2}</p></div><div class="related links" data-label="drop"><p>{0}</p></div>',
    '<body><div class="nav topbar breadcrumb" data-label="drop">{1}</div><section class="story" data-label="keep"><h2>{1}</h2><p>{0}</p><p>{1}</p></section><div class="notice alert" data-label="drop"><p>{2}</p></div>'
    '<div role="complementary" class="widget" data-label="drop"><ul><li>{1}</li></ul></div><div role="contentinfo" data-label="drop">{0}</div>',
    '<body><article data-label="keep"><p>{1}</p></article><footer data-label="drop">&copy; {2}</footer>',
    '<section id="comments" data-label="drop"><article class="comment"><p>{0}</p></article><article class="comment reply"><p>{1}</p></article></section><article data-label="keep"><p>{2}</p></article>',
    '<article data-label="keep">{1}</article>', '<p data-label="keep">{1}<p data-label="keep">{0}', '<div data-label="keep">{2}</div>',
    '<body><nav data-label="drop">{2}</nav><article data-label="keep"><h1>{1}</h1><ul><li>{1}</li><li><a href="/x">{3}</a></li></ul><p>{0}</p><div class="comments" data-label="drop"><p>{0}</p></div></article>',
)
LABELS = ("keep", "drop")


def labelled_pages() -> list[str]:
    """Small pages whose parts say in data-label whether they are main text."""
    turns = [[_PROSE[(i + k) % len(_PROSE)] for i in range(4)] for k in range(len(_PROSE))]
    return [frame.format(*texts) for frame in _FRAMES for texts in turns]


def train() -> crf.Chain:
    pages = [blocks(p) for p in labelled_pages()]
    features = [[_path_features(b.node) + _text_features(b) for b in page] for page in pages]
    return crf.fit(features, [[b.label for b in page] for page in pages], LABELS, steps=80)


def main_text(page: str, chain: crf.Chain) -> str:
    return main_texts([page], chain)[0]


def main_texts(pages: list[str], chain: crf.Chain) -> list[str]:
    """Main text of every page: the kept blocks in page order, one line each."""
    tree = chain.cache.get("tree")
    if tree is None or tree.size > TREE_NODES:
        tree = chain.cache["tree"] = Tree()
    parsed = [blocks(p, tree) for p in pages]
    scores = [_path_scores(b.node, chain) for page in parsed for b in page]
    if not scores:
        return [""] * len(pages)
    total = np.array(scores) + chain.scores([_text_features(b) for page in parsed for b in page])
    kept = chain.decode(total, np.array([len(p) for p in parsed])) == LABELS.index("keep")
    out, at = [], 0
    for page in parsed:
        out.append("\n".join(b.text for b, k in zip(page, kept[at:at + len(page)]) if k))
        at += len(page)
    return out


def extract(pages: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """`pages` with text and n_chars in the place of html.

    A null or empty page has the empty text; pages of any length are parsed whole; repeated rows are
    extracted each; columns named text or n_chars are replaced, others kept.
    """
    chain = replace(chain or train(), cache={})
    kept = [c for c in pages.columns if c not in ("text", "n_chars", "html")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = main_texts([h or "" for h in batch.column("html").to_pylist()], chain)
            columns = [batch.column(c) for c in kept]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), sizes], [*kept, "text", "n_chars"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*kept).schema)
    return in_arrow(pages.select(*kept, "html"), run, f"{schema}text string, n_chars long")
