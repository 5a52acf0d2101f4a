"""Main text of web pages by equivalence-class template deduction.

1. ``events`` reads a page into opening and closing tags and text, tolerating what browsers tolerate.
   A structural token is a container tag with its class and id below the containers above it; a text token
   is the whole text of one such container, below the same path.
2. Tokens of one host that have equal occurrence vectors (how often in which page) form an equivalence
   class; vectors are compared by an exclusive-or of hashes of (page, count), so classes are plain
   aggregates. A class is valid if it occurs in at least half of the host's pages and has a structural
   token; valid classes are nested by their tokens' containers (``deduce``). The order of siblings isn't used.
3. A text token in its own container's class is the container's text wherever the container is: template,
   not content (one page repeats nothing, so two pages are needed; their number plays no other part). What
   varies between template tokens are slots.
   Slots of menus, headers, footers, sidebars, notices, adverts, forms, comments (by tag, role or name) and
   slots that are mostly link text on the host are boilerplate. The main slot is the article or main element
   that the template has once (of several the one with most varying text), else the deepest one that holds
   four fifths of the varying text.
4. ``extract`` takes a page's main slot, leaves out boilerplate nested in it, decodes character references,
   turns white space within a block into one space and joins blocks by a newline. A header within an article
   belongs to it. Within an article only names that articles don't use for their own parts (adverts, reader
   comments, share buttons and the like) decide alone; a container with another boilerplate name (``legal``,
   ``related-work``) stays unless its class makes it template or it is mostly links on the page. Constant
   text of other containers stays in an article or main element; in a main slot without such a tag it goes.

Pages without a host, and pages that lack their host's main slot, use the template deduced over all pages
(structural tokens only), then the page's own.

Defined results: null, empty and text-free pages give an empty string; a null url has no host; repeated
rows each keep a row; an empty table gives no rows; other columns are not read. Time and memory are linear
in a page, however deep it is nested.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Templates go to all executors if they take at most this many bytes together; else they are joined.
BROADCAST_BYTES = 4 << 20
ALL_HOSTS = ""

_EVENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][a-zA-Z0-9:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# HTML's element names by their part in a page.
_RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "select", "title", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {"html", "head", "body", "nav", "header", "footer", "aside", "main", "article", "section", "div", "form", "ul", "ol", "dl", "table", "figure", "fieldset", "dialog", "details", "menu", "button"}
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "tr", "td", "th", "caption", "figcaption", "br", "hr", "address", "summary", "thead", "tbody", "tfoot", "legend", "center"}
_BOILER_TAGS = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|footer\w*|sidebar\w*|side|aside|widget\w*"
    r"|comment\w*|disqus|respond|replies|reply|cookie\w*|consent|gdpr|notice\w*|newsletter|subscri\w*|signup|login|popup|modal|overlay|share\w*|social\w*|related\w*|recommend\w*|pagination|pager|search\w*|form\w*|legal|copyright|skip\w*|toolbar|alert)(?:$|[\s_-])",
    re.I,
)


# Names of containers that aren't an article's own even within it.
_FOREIGN_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement\w*|advertising|adsense|sponsor\w*|navbar|navigation|breadcrumb\w*|sidebar\w*|widget\w*|comments|comment-?list|disqus|respond|replies"
    r"|cookie\w*|consent|gdpr|newsletter|subscribe|subscription|signup|login|popup|modal|share|sharing|share-?buttons?|social|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): "open" with a token name and "boiler", "named" (by a name that an article's part may have), "header" or none, "close", "text"."""
    at = 0
    while m := _EVENT.match(page, at):
        at = m.end()
        if m[4] is not None:
            yield "text", "", m[4]
        elif m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
                continue
            if name in _RAW and not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] and name in _CONTAINERS else {}
            named = " ".join(filter(None, (attributes.get("class", ""), attributes.get("id", ""))))
            boiler = name in _BOILER_TAGS or attributes.get("role", "").lower() in _BOILER_ROLES or bool(named and _FOREIGN_NAME.search(named)) or "hidden" in attributes
            maybe = not boiler and bool(named and _BOILER_NAME.search(named))
            header = name == "header" or bool(named and _HEADER_NAME.search(named))
            if name in ("html", "body", "main", "article"):
                boiler = maybe = header = False
            token = name + ("." + ".".join(sorted(re.sub(r"\d+", "", named).split())) if named else "")
            yield "open", token, "boiler" if boiler else "named" if maybe else "header" if header else ""
        if at >= len(page):
            return


class Slots:
    """A page's structural tokens in order, and the text blocks in the slot below each."""

    def __init__(self, page: str | None):
        #: of each token: a hash of its path, its own name, its parent's number, boilerplate or not
        self.path, self.name, self.parent, self.boiler = [0], [""], [-1], [False]
        #: boilerplate by its name only, in an article or main element
        self.named = [False]
        beside: list[int] = []
        #: (token number, text, characters of link text)
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        open_: dict[str, int] = defaultdict(int)
        parts: list[str] = []
        linked, link_depth = 0, 0

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                if text := " ".join(html.unescape("".join(parts)).split()):
                    self.blocks.append((stack[-1][1], text, linked))
                parts, linked = [], 0

        for kind, name, value in events(page or ""):
            if kind == "text":
                parts.append(value)
                linked += len(value) if link_depth else 0
                continue
            tag = name.split(".")[0]
            if tag in _BLOCKS:
                flush()
            if tag == "a":
                link_depth = 1 if kind == "open" else 0
            if tag not in _CONTAINERS:
                continue
            if kind == "open":
                parent = stack[-1][1]
                self.path.append(_mark(name, self.path[parent]))
                self.name.append(name)
                self.parent.append(parent)
                # a header within an article is the article's
                own = bool(open_["article"] or open_["main"])
                self.boiler.append(value == "boiler" or (value in ("header", "named") and not own))
                self.named.append(value == "named" and own)
                if self.named[-1] and not open_["article"]:
                    beside.append(len(self.path) - 1)
                stack.append((tag, len(self.path) - 1))
                open_[tag] += 1
                link_depth = 0
            elif open_[tag]:
                while True:
                    closed = stack.pop()[0]
                    open_[closed] -= 1
                    if closed == tag:
                        break
                link_depth = 0
        flush()
        if beside and any(n.split(".")[0] == "article" for n in self.name):
            for k in beside:  # in the main element, but not in the article that it has
                self.boiler[k], self.named[k] = True, False

    def measure(self) -> list[Token]:
        """The page's structural tokens, and the text token of each with any text."""
        out: dict[int, Token] = {}
        words: dict[int, list[str]] = defaultdict(list)
        for path, name, parent, boiler, named in zip(self.path, self.name, self.parent, self.boiler, self.named, strict=True):
            t = out.setdefault(path, Token(path, 0, self.path[parent] if parent >= 0 else -1, name, boiler, named=named))
            t.times += 1
        for token, text, linked in self.blocks:
            t = out[self.path[token]]
            t.text += len(text)
            t.links += min(linked, len(text))
            words[t.path].append(text)
        return [*out.values(), *(Token(p, _mark("\n".join(x), 1) or 1, times=out[p].times) for p, x in words.items())]

    def main_text(self, template: dict) -> str | None:
        """Text of the template's main slot without boilerplate slots; None if the page hasn't that slot."""
        main, constant = template["main"], set(template["constant"])
        inside, out = [False] * len(self.path), [False] * len(self.path)
        size, links = [0] * len(self.path), [0] * len(self.path)
        for k, text, linked in self.blocks:
            size[k] += len(text)
            links[k] += min(linked, len(text))
        for k in range(len(self.path) - 1, 0, -1):
            size[self.parent[k]] += size[k]
            links[self.parent[k]] += links[k]
        for k, path in enumerate(self.path):
            p = self.parent[k]
            starts = path == main
            inside[k] = starts or (p >= 0 and inside[p])
            out[k] = not starts and ((p >= 0 and out[p]) or self.boiler[k] or path in constant or (self.named[k] and links[k] > 0.6 * size[k]))
        if not any(inside):
            return None
        return "\n".join(text for k, text, _ in self.blocks if inside[k] and not out[k])


def _mark(text: str, seed: int) -> int:
    """63 bits of a hash."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


@dataclass
class Token:
    """What a host's (or a page's) pages have of a token: a container below ``parent``, or, if ``words`` isn't 0, its text."""

    path: int
    words: int
    parent: int = -1
    name: str = ""
    boiler: bool = False
    pages: int = 1
    vector: int = 0
    times: int = 0
    text: int = 0
    links: int = 0
    named: bool = False


def classes(tokens: list[Token]) -> dict[tuple[int, int, int], list[Token]]:
    """Tokens by occurrence vector."""
    out: dict[tuple[int, int, int], list[Token]] = defaultdict(list)
    for t in tokens:
        out[t.vector, t.pages, t.times].append(t)
    return out


def deduce(pages: int, tokens: list[Token]) -> dict | None:
    """A template: the main slot's path and the constant containers in it."""
    valid = [c for c in classes(tokens).values() if c[0].pages * 2 >= pages and not all(t.words for t in c)]
    known = {t.path: t for c in valid for t in c if not t.words}
    # text tokens in the class of their own container
    same = {t.path for c in valid for t in c if t.words and any(not s.words and s.path == t.path for s in c)} if pages > 1 else set()
    below: dict[int, list[Token]] = defaultdict(list)
    for t in known.values():
        below[t.parent].append(t)
    order, depth = [t for t in known.values() if t.path == 0], {0: 0}
    for t in order:  # nested: from the root down; grows as it goes
        for child in below[t.path]:
            depth[child.path] = depth[t.path] + 1
            order.append(child)
    gone: set[int] = set()
    for t in order:
        if t.boiler or t.named or t.parent in gone or (t.text and t.links > 0.6 * t.text and t.name.split(".")[0] not in ("article", "main")):
            gone.add(t.path)

    def sums(constant: set[int]) -> dict[int, int]:
        text = {t.path: 0 if t.path in gone or t.path in constant else t.text for t in order}
        for t in reversed(order):
            if t.parent in text:
                text[t.parent] += text[t.path]
        return text

    text, whole = sums(same), sums(set())
    if not any(text.values()):  # pages of one host that are all alike
        same, text = set(), whole
    total = text.get(0, 0)
    if not total:
        return None
    once = [t for t in order if t.times == t.pages and t.path not in gone and t.name.split(".")[0] in ("article", "main") and whole[t.path] > 0]
    if once:
        main = max(once, key=lambda t: (text[t.path], whole[t.path], -depth[t.path]))
    else:
        main = max((t for t in order if t.path and t.path not in gone and text[t.path] >= 0.8 * total), key=lambda t: (depth[t.path], t.name), default=order[0])
    within = {main.path}
    for t in order:
        if t.parent in within:
            within.add(t.path)
    if once:  # the article's own: only what is named like boilerplate and is the same on all pages goes
        constant = sorted(p for p in within if known[p].named and p in same)
    else:
        constant = sorted(p for p in within - {main.path} if whole[p] and not text[p] and (p in same or not known[p].text))
    return {"main": main.path, "constant": constant}


def main_text(page: str | None, *templates: dict | None) -> str:
    """By the first template whose main slot the page has, else by the page's own structure."""
    slots = Slots(page)
    for template in templates:
        if template and (text := slots.main_text(template)) is not None:
            return text
    own = deduce(1, slots.measure())
    text = slots.main_text(own) if own else None
    if text is None:  # no containers at all
        text = "\n".join(t for k, t, _ in slots.blocks if not slots.boiler[k])
    return text


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


_TOKENS = "host string, path long, words long, parent long, name string, boiler boolean, pages long, vector long, times long, text long, links long, named boolean"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, html, host) -> sums by host and token over the batch; a page's structural tokens count for its host and for all."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in _TOKENS.split(", ")]
    for b in batches:
        sums: dict[tuple[str, int, int], Token] = {}
        for page_id, page, host in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for t in Slots(page).measure():
                vector = _mark(f"{page_id}:{t.times}", 2)
                for h in {host} if t.words else {host, ALL_HOSTS}:
                    if h == ALL_HOSTS and t.words:
                        continue
                    s = sums.get((h, t.path, t.words))
                    if s is None:
                        sums[h, t.path, t.words] = replace(t, vector=vector)
                    else:
                        s.pages += 1
                        s.vector ^= vector
                        s.times += t.times
                        s.text += t.text
                        s.links += t.links
                        s.boiler = s.boiler or t.boiler
                        s.named = s.named or t.named
        rows = [(h, *astuple(t)) for (h, _, _), t in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _deduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, found = [], []
        for host, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tokens = [Token(**t) for t in listed]
            if template := deduce(max(t.pages for t in tokens), tokens):
                hosts.append(host)
                found.append(json.dumps(template))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string())], names=["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): one row for each host with a template, and one of host "" over all pages.

    Only tokens that half of a host's pages have are gathered; others can't be in a valid class, and a
    page has a bounded number of them, so a list is no longer than a page is. All pages' tokens are
    filtered by their number, which is one value, so no key holds all paths.
    """
    sums = _pages(pages).select("page_id", "html", "host").mapInArrow(_measure, _TOKENS)
    by = sums.groupBy("host", "path", "words").agg(
        F.max("parent").alias("parent"), F.max("name").alias("name"), F.max("boiler").alias("boiler"),
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("times", "text", "links")], F.max("named").alias("named"),
    )
    by = cut(by)
    # the root token is on every page of a host
    size = by.where("path = 0 AND words = 0").select("host", F.col("pages").alias("all_pages"))
    every = size.where(F.col("host") == ALL_HOSTS).first()
    common = by.where((F.col("host") == ALL_HOSTS) & (F.col("pages") * 2 >= F.lit(every[1] if every else 0)))
    own = by.where(F.col("host") != ALL_HOSTS).join(size.where(F.col("host") != ALL_HOSTS), "host").where(F.col("pages") * 2 >= F.col("all_pages")).drop("all_pages")
    listed = own.unionByName(common).groupBy("host").agg(F.collect_list(F.struct(*[c for c in by.columns if c != "host"])).alias("tokens"))
    return listed.mapInArrow(_deduce_batches, "host string, template string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    found = cut(templates(pages))
    n, size = found.agg(F.count("*"), F.sum(F.length("template") + F.length("host"))).first()
    common = [r[0] for r in found.where(F.col("host") == ALL_HOSTS).select("template").collect()]
    shared = json.loads(common[0]) if common else None
    side = found.where(F.col("host") != ALL_HOSTS)
    rows = _pages(pages).join(F.broadcast(side) if (size or 0) <= BROADCAST_BYTES else side, "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page, json.loads(t) if t else None, shared) for page, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
