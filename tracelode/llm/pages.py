"""HTML extraction by equivalence classes of template tokens.

A page is read as blocks: stretches of text between block-level tags, each with the path of open elements. The tokens of a
page are the element paths (names with their class or id) and whole block texts, as path and hash, that it holds once. Their occurrence
vectors over the host's pages are folded into one hash, so tokens of the same pages meet in one equivalence class by an
aggregation over (host, token) and one over (host, vector). A class is valid if its pages are a fair share of the host's
(SUPPORT) and it has two tokens or more; one in nearly all pages (SHARE) needs no second token. A host of several layouts so
has classes for each of them. A page's skeleton is made of the valid classes it holds, those of more pages first, which
contain the narrower ones: its main element is the one whose slot holds most text, and the texts of the classes are template
unless nothing else would remain of the page. Slots whose path names something that surrounds an article are left out, also
texts that are template and lie outside the slot with most text. What remains beneath the element that holds this slot is
the article.

Defined results: null and empty html give an empty text; a page without a usable url belongs to the host "" ; a host of few
pages has no skeleton, and each of its pages is judged by its own elements, as is a page without a valid class; pages without
text and elements do not count; repeated rows and repeated ids are pages each;
a page of plain text without any tag is one block; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelode.llm.columns import mix

# HTML elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea select option button svg iframe object canvas head title form nav footer aside dialog menu".split())
RAW = frozenset("script style noscript textarea title iframe template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"body": frozenset({"head"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
          "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset({"article", "main"})
# Words of a class, id or role for what surrounds an article, and for the article itself.
AROUND = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs "
                   "sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                   "subscription signup login comment comments reply replies discussion disqus respond share sharing social related recommended "
                   "widget pagination pager toolbar search copyright legal hidden contentinfo complementary".split())
WITHIN = frozenset("article content main post story entry body articlebody maincontent postcontent entrycontent".split())

#: Pages a host must have for a skeleton, and a class for being valid; share of the pages that a class must be in, and share
#: with which a single token is a class.
PAGES = 4
SUPPORT = 0.2
SHARE = 0.9
#: Parts in which the pages of a host meet its template, so that a large host is not one task.
SALTS = 16

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|([^<]+|<)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_NUMBER = re.compile(r"\d+")


#: Characters of a path that stand as they are; what lies further out is a hash, so deep elements have short paths.
PATH = 300


class Node:
    """An element: label (name, classes and id without digits), kind (-1 for what surrounds an article, 1 for one, else 0), its path
    of labels from the outside in, whether nothing around an article encloses it, and the outermost article it lies in."""

    __slots__ = ("parent", "name", "label", "kind", "path", "clean", "article")

    def __init__(self, parent: Node | None, name: str, label: str, kind: int) -> None:
        self.parent, self.name, self.label, self.kind = parent, name, label, kind
        above = parent.path if parent else ""
        if len(above) > PATH:
            above = "#" + hashlib.blake2b(above.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.path = f"{above}/{label}" if parent and parent.path else label
        self.clean = kind >= 0 and (parent is None or parent.clean)
        self.article = parent.article if parent and parent.article else self if kind == 1 else None


class Page:
    """blocks: (node, text) in page order. nodes: elements in order of opening, the page itself first, so parents come before
    children. elements: how often each path of labels was opened."""

    def __init__(self, html: str) -> None:
        self.nodes = [Node(None, "", "", 0)]
        self.blocks: list[tuple[Node, str]] = []
        self.elements: dict[str, int] = {}
        self._stack = [self.nodes[0]]
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        at = 0
        while at < len(html):
            found = _PIECE.match(html, at)
            at = found.end()
            if found[4] is not None:
                self._text.append(entities.unescape(found[4]) if "&" in found[4] else found[4])
            elif found[2]:
                name = found[2].lower()
                if found[1]:
                    self._end(name)
                elif name in RAW:
                    tail = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                    at = tail.end() if tail else len(html)
                else:
                    self._begin(name, found[3])
        self._close()

    def _close(self) -> None:
        """Ends the block that is open."""
        joined = " ".join("".join(self._text).split())
        self._text.clear()
        if joined:
            self.blocks.append((self._stack[-1], joined))

    def _leave(self, place: int) -> None:
        """Closes the elements from a place of the stack on."""
        while len(self._stack) > place:
            self._open[self._stack.pop().name] -= 1

    def _innermost(self) -> int:
        """Place of the innermost open element that is not inline, 0 (the page) if there is none."""
        place = len(self._stack) - 1
        while self._stack[place].name in INLINE:
            place -= 1
        return place

    def _end(self, name: str) -> None:
        # Names that are not open are not looked for; else what is passed over is closed.
        place = len(self._stack) - 1 if self._open[name] > 0 else 0
        while place and self._stack[place].name != name:
            place -= 1
        if name not in INLINE or place:
            self._close()
        if place:
            self._leave(place)

    def _begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name in INLINE:
            if not attributes or self._kind(name, attributes)[1] >= 0:
                return
            self._close()
        else:
            self._close()
            place = self._innermost()
            if self._stack[place].name == "p":
                self._leave(place)
                place = self._innermost()
            if self._stack[place].name in CLOSES.get(name, ()):
                self._leave(place)
            if name == "tr" and self._stack[self._innermost()].name == "tr":
                self._leave(self._innermost())
        if name in VOID or attributes.rstrip().endswith("/"):
            return
        node = Node(self._stack[-1], name, *self._kind(name, attributes))
        self._stack.append(node)
        self._open[name] += 1
        self.nodes.append(node)
        self.elements[node.path] = self.elements.get(node.path, 0) + 1

    def _kind(self, name: str, attributes: str) -> tuple[str, int]:
        named = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(attributes)} if attributes else {}
        words = {w.lower() for key in ("class", "id", "role") for w in _WORDS.findall(named.get(key, ""))}
        label = name + _NUMBER.sub("", "".join(f".{c}" for c in named.get("class", "").split()) + (f"#{named['id']}" if named.get("id") else ""))
        if name in ("html", "body"):
            return label, 0
        if name in HIDDEN or "hidden" in named or "display:none" in named.get("style", "").replace(" ", "").lower():
            return label, -1
        if name == "header" and not self._stack[-1].article or words & AROUND and not (name in ARTICLE and not words & {"comment", "comments", "reply", "related", "ad", "sponsored"}):
            return label, -1
        return label, int(name in ARTICLE or bool(words & WITHIN))


TOKENS = "host string, token string, whole boolean, vector bigint, chars bigint"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def text_token(path: str, text: str) -> str:
    """Path and hash, so that a long text makes no longer a row."""
    return f"{path}\t{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def text_counts(blocks: list[tuple[str, str]]) -> dict[str, int]:
    """How often a page holds each token that is a text; blocks are (path, text)."""
    return Counter(text_token(at, text) for at, text in blocks)


def page_tokens(pages: DataFrame) -> DataFrame:
    """Tokens that a page holds once: element paths and block texts (whole: a text), a hash of the page, and the text
    that lies directly in the slot of an element. Path "" is the page; pages without text and elements have no tokens."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, key, html in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
                page = Page(html or "")
                if not page.blocks and not page.elements:
                    continue
                # The slot of a text is the innermost element around it that the page holds once.
                chars: dict[str, int] = {}
                slots: dict[Node, str] = {}
                for node in page.nodes:
                    slots[node] = node.path if node.parent is None or page.elements.get(node.path) == 1 else slots[node.parent]
                blocks = [(node.path, text) for node, text in page.blocks if node.clean]
                for node, text in page.blocks:
                    if node.clean:
                        chars[slots[node]] = chars.get(slots[node], 0) + len(text)
                rows.append((host, "", False, key, chars.get("", 0)))
                rows += [(host, path, False, key, chars.get(path, 0)) for path, n in page.elements.items() if n == 1]
                rows += [(host, text, True, key, 0) for text, n in text_counts(blocks).items() if n == 1]
            columns = list(zip(*rows)) if rows else [[]] * 5
            vector = mix(np.array(columns[3], dtype=np.int64).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_()),
                                              pa.array(vector), pa.array(columns[4], pa.int64())], [c.split()[0] for c in TOKENS.split(", ")])

    return pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), F.col("html").alias("html")).mapInArrow(read, TOKENS)


def templates(pages: DataFrame, least: int = PAGES, support: float = SUPPORT, share: float = SHARE) -> DataFrame:
    """The valid classes of hosts of `least` pages or more: host, pages, sign (one of the tokens: a page holds all or none),
    main (the element whose slot holds most text, chars a page) and texts (block texts). Tokens meet by (host, token), classes
    by (host, occurrence vector)."""
    tokens = page_tokens(pages).groupBy("host", "token", "whole").agg(F.count("*").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"))
    every = tokens.where("token = '' and not whole").select("host", F.col("pages").alias("all_pages")).where(F.col("all_pages") >= least)
    frequent = tokens.where(F.col("pages") >= least).join(every, "host").where(F.col("pages") >= support * F.col("all_pages"))
    order = F.when(~F.col("whole"), F.struct("chars", F.length("token"), "token"))
    found = frequent.groupBy("host", "vector", "pages", "all_pages").agg(
        F.count("*").alias("tokens"), F.min("token").alias("sign"), F.max_by("token", order).alias("main"), (F.max(F.when(~F.col("whole"), F.col("chars"))) / F.col("pages")).alias("chars"),
        F.collect_list(F.when(F.col("whole"), F.col("token"))).alias("texts"))
    return found.where((F.col("tokens") > 1) | (F.col("pages") >= share * F.col("all_pages"))).select("host", "pages", "sign", "main", "chars", "texts")


_LEAF = HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "tr", "td", "th"}


def article_root(node: Node) -> Node:
    """The element that holds the whole article of which `node` is a slot: the outermost one that says so, else the innermost
    that is more than a paragraph, list or heading."""
    if node.article:
        return node.article
    while node.parent and node.name in _LEAF:
        node = node.parent
    return node


def skeleton(counts: dict[str, int], blocks: list[tuple[str, str]], classes: list[dict]) -> tuple[str | None, set[str]]:
    """Main element (None without one) and template texts of a page with these counts of tokens."""
    main, texts, left = None, set(), {text_token(*block) for block in blocks}
    for found in sorted((c for c in classes if counts.get(c["sign"]) == 1), key=lambda c: (-c["pages"], c["sign"])):
        if found["main"] is not None:
            own = (found["chars"], len(found["main"]), found["main"])
            main = own if main is None else max(main, own)
        rest = left.difference(found["texts"])
        if rest:
            left = rest
            texts.update(found["texts"])
    return main and main[-1], texts


def main_text(html: str, classes: list[dict]) -> str:
    """The article of one page, by the valid classes of its host."""
    page = Page(html)
    kept = [(node, text) for node, text in page.blocks if node.clean]
    blocks = [(node.path, text) for node, text in kept]
    main, texts = skeleton({**text_counts(blocks), **page.elements, "": 1}, blocks, classes)

    def under(path: str) -> list[tuple[Node, str]]:
        inside: dict[Node, bool] = {}
        for node in page.nodes:
            inside[node] = not path or node.path == path or node.parent is not None and inside[node.parent]
        return [x for x in kept if inside[x[0]]]

    found = next((node for node in page.nodes if node.path == main), None) if main is not None else None
    root = article_root(found) if found else page.nodes[0]
    chosen = under(root.path)
    if found is None or not chosen or root.kind != 1:
        length: dict[str, int] = {}
        for node, text in kept:
            if node.article:
                length[node.article.path] = length.get(node.article.path, 0) + len(text)
        if length:
            chosen = under(max(length, key=lambda path: (length[path], path)))
        else:
            chosen = [x for x in chosen or kept if text_token(x[0].path, x[1]) not in texts] or chosen or kept
    return " ".join(text for _, text in chosen)


def extract(pages: DataFrame, least: int = PAGES, support: float = SUPPORT, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page's article."""
    hosts = templates(pages, least, support, share).groupBy("host").agg(F.collect_list(F.struct("pages", "sign", "main", "chars", "texts")).alias("classes"))
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html")).withColumn("host", host_of(F.col("url")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html or "", classes or []) for html, classes in zip(*(batch.column(c).to_pylist() for c in ("html", "classes")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars bigint"
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["host", "salt"], "left").select("page_id", "url", "html", "classes").mapInArrow(cut, schema)
