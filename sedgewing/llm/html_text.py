"""Main text of web pages, by wrapper induction over the pages of a host.

1. Every page becomes a tree of its block elements; inline elements are part of their block's text, and siblings of one label
   (tag and class) that stand side by side are one node.
2. The trees of a host's pages are aligned by simple tree matching: of two nodes with one label, the children are matched in
   order so that most nodes agree. The union of the aligned trees is the host's wrapper; each node counts its pages and knows
   whether its text was the same in all of them. All pages take part. A task folds the pages that it reads, partial wrappers are
   folded by host and salt and then by host, so a host with a third of all pages costs a few small rows per task.
3. Nodes whose text is constant over MIN_PAGES pages or more, while other text of the host varies, are template; the slots that vary are
   content, save those that elements, roles or class names mark as menus, headers, footers, sidebars, notices, adverts, forms
   or reader comments. Where a page marks its article (article, main), the content lies in there, and only constant nodes with
   a class of their own are template: hosts may hold copies of one article, whose paragraphs are then constant too. Elsewhere
   all blocks are content that are neither template nor marked, save lists of links.

Character references are decoded; white space within a block becomes one space, blocks are joined by one space.

A null html counts as empty and gives an empty text; a null or odd url has no host, and such a page stands for itself. Rows
that repeat a page give repeated rows. An empty table gives an empty result; other columns are not read. Unclosed, misnested
and truncated markup is read as browsers do in the common cases: text after it is never lost.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import hot_keys, salted_join, saved, small_batches

#: Pages on which a node must have had one text to be template.
MIN_PAGES = 3
#: Nodes of a partial wrapper, beyond GROWTH times its first page's, from which it is handed on whole and a new one begun.
MAX_NODES, GROWTH = 4000, 8
#: Bytes of all wrappers up to which they are broadcast; beyond that pages are joined with them by salted host.
BROADCAST_BYTES = 16 << 20
#: Nodes of partial wrappers that a task holds before it hands them on.
HELD_NODES = 200_000
#: Tasks over which the partial wrappers of one host are dealt first.
SALTS = 16
#: Depth of nesting that is told apart; deeper elements stand side by side at that depth, as browsers do.
MAX_DEPTH = 150
#: Runs of siblings beyond which all siblings of a label are one node, and labels beyond which those of a tag are.
MAX_RUNS, MAX_LABELS = 64, 256
#: Share of link text from which a list is one of links; other containers are menus only if all their words are links.
LINK_SHARE = 0.6

# fixed values: names of HTML elements
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html li dt dd tbody td tfoot th thead tr option optgroup legend".split())
#: A start tag closes open elements of the first set, up to one of the second.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"])),
}
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that are never main text.
DROPPED = frozenset("head script style noscript template iframe svg nav footer aside form button select textarea input datalist dialog menu search audio video canvas object title xmp noembed noframes".split())
#: ARIA roles that are never main text.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark an element as no main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended recommendations teaser teasers widget widgets toolbar pagination pager skip disclaimer alert alerts announcement".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS, CONTAINERS = frozenset("ul ol dl dir".split()), frozenset("div section table".split())

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.IGNORECASE) for x in RAW}
_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Element:
    """An element of a page; parts holds texts (str, with link flag) and elements in page order."""

    __slots__ = ("tag", "label", "marked", "semantic", "parts", "classed")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.marked, self.semantic, self.classed = tag, tag, tag in DROPPED, tag in ("article", "main"), False
        self.parts: list = []
        if attributes and "=" in attributes or "hidden" in attributes:
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        found = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        self.semantic |= found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
        if names:
            self.classed = True
            self.label = f"{self.tag}.{re.sub('[0-9]+', '', names[0]).lower()}"
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            self.marked = True
        if found.get("role", "").lower() in ROLES:
            self.marked = True
        if self.tag in ("html", "body", "main") or self.tag in HEADINGS:
            return
        for name in names:
            words = [x.lower() for x in _WORD.findall(name)]
            if words and words[0] not in ("has", "with", "no", "without") and MARKS.intersection(words):
                self.marked = True


def parsed(html: str) -> Element:
    """The tree of a page's elements."""
    root = Element("#root")
    stack, at, n = [root], 0, len(html)
    links = 0

    def close(k: int) -> None:
        nonlocal links
        links -= sum(x.tag == "a" for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            break
        if m.start() > at:
            stack[-1].parts.append((html[at : m.start()], links > 0))
        at = m.end()
        if m.group(0) == "<!--":
            end = html.find("-->", at - 2)
            at = n if end < 0 else max(at, end + 3)
            continue
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), bool(m.group(1) or m.group(4)), m.group(3) if m.group(2) else m.group(6)
        if ending:
            inline = tag not in BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if inline and stack[k].tag in BLOCK or stack[k].tag in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in CLOSES:
            own, bound = CLOSES[tag]
            first = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bound:
                    break
                if stack[k].tag in own:
                    first = k
            if first:
                close(first)
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(len(stack) - 1)
        if len(stack) > MAX_DEPTH:
            close(MAX_DEPTH)
        node = Element(tag, attributes)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            upto = html.find(">", end.end()) if end else -1
            at = n if upto < 0 else upto + 1
        elif tag not in VOID:
            stack.append(node)
            links += tag == "a"
    if at < n:
        rest = html[at:]
        cut = re.search(r"<(?=[a-zA-Z/!?])[^>]*\Z", rest)  # a tag that the page's end cuts off
        stack[-1].parts.append((rest[: cut.start()] if cut else rest, links > 0))
    return root


class Slot:
    """A node of a page's or a host's tree of blocks."""

    __slots__ = ("label", "n", "text", "chars", "links", "children")

    def __init__(self, label: str, n: int = 1, text: int = 0, chars: int = 0, links: int = 0, children: list | None = None):
        self.label, self.n, self.text, self.chars, self.links, self.children = label, n, text, chars, links, children or []

    def packed(self) -> list:
        return [self.label, self.n, self.text, self.chars, self.links, [x.packed() for x in self.children]]

    @classmethod
    def unpacked(cls, x: list) -> Slot:
        return cls(*x[:5], [cls.unpacked(y) for y in x[5]])

    def count(self) -> int:
        return 1 + sum(x.count() for x in self.children)


#: Hash of a text that varies.
VARIES = -1


def _collapsed(elements: list[Element]) -> list[tuple[str, list[Element]]]:
    runs: list[tuple[str, list[Element]]] = []
    for e in elements:
        if runs and runs[-1][0] == e.label:
            runs[-1][1].append(e)
        else:
            runs.append((e.label, [e]))
    for most, name in ((MAX_RUNS, "label"), (MAX_LABELS, "tag")):
        if len(runs) > most:
            groups: dict[str, list[Element]] = {}
            for e in elements:
                groups.setdefault(getattr(e, name), []).append(e)
            runs = list(groups.items())
    return runs


def _inner(elements: list[Element]) -> tuple[list[tuple[str, bool]], list[Element]]:
    """Texts and block children of blocks, through their inline elements."""
    texts, blocks = [], []
    stack = [p for e in reversed(elements) for p in reversed(e.parts)]
    while stack:
        p = stack.pop()
        if isinstance(p, tuple):
            texts.append(p)
        elif p.tag in BLOCK or p.marked or p.semantic:
            blocks.append(p)
        elif p.tag not in VOID:
            stack += reversed(p.parts)
    return texts, blocks


def _slot(label: str, elements: list[Element]) -> Slot:
    out = Slot(label)
    stack = [(out, elements)]
    while stack:
        slot, own = stack.pop()
        texts, blocks = _inner(own)
        text = " ".join("".join(t for t, _ in texts).split())
        slot.chars, slot.links = len(text), sum(len(t) for t, link in texts if link)
        slot.text = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest(), "little") if text else 0
        for name, run in _collapsed(blocks):
            child = Slot(name)
            slot.children.append(child)
            if not run[0].tag in DROPPED or len(run) > 1:
                stack.append((child, run))
    return out


def aligned(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Places of the matched children, in order, so that most nodes below agree (simple tree matching)."""
    if [x.label for x in a] == [x.label for x in b]:
        return [(i, i) for i in range(len(a))]
    best = _table(a, b)
    i, j, out = len(a), len(b), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _table(a: list[Slot], b: list[Slot]) -> list[list[int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            pair = above[j] + matched(x, y) if x.label == y.label else 0
            row[j + 1] = max(pair, above[j + 1], row[j])
    return best


def matched(a: Slot, b: Slot) -> int:
    """Nodes that agree when a's tree is laid over b's."""
    if a.label != b.label:
        return 0
    return 1 + (_table(a.children, b.children)[-1][-1] if a.children and b.children else 0)


def merge(wrapper: Slot, page: Slot) -> int:
    """Lays page (a page's tree or another wrapper) over the wrapper; returns the number of nodes that are new in it."""
    new = 0
    stack = [(wrapper, page)]
    while stack:
        w, p = stack.pop()
        w.n += p.n
        w.text = w.text if w.text == p.text else VARIES
        w.chars += p.chars
        w.links += p.links
        if not p.children:
            continue
        pairs = aligned(w.children, p.children)
        stack += [(w.children[i], p.children[j]) for i, j in pairs]
        if len(pairs) < len(p.children):
            out, i, j = [], 0, 0
            for x, y in [*pairs, (len(w.children), len(p.children))]:
                out += w.children[i:x] + p.children[j:y] + w.children[x : x + 1]
                new += sum(c.count() for c in p.children[j:y])
                i, j = x + 1, y + 1
            w.children = out
    return new


def page_tree(root: Element) -> Slot:
    return _slot("#root", [root])


def _fold(rows: Iterator[tuple[str, Slot]], held: int = HELD_NODES) -> Iterator[tuple[str, Slot]]:
    """Wrappers by host; a host may come more than once, and no node of its pages is left out."""
    wrappers: dict[str, Slot] = {}
    nodes: dict[str, list[int]] = {}  # now and at most
    size = 0
    for host, tree in rows:
        have = wrappers.get(host)
        if have is None:
            new = tree.count()
            wrappers[host], nodes[host] = tree, [new, MAX_NODES + GROWTH * new]
        else:
            new = merge(have, tree)
            nodes[host][0] += new
        size += new
        if nodes[host][0] > nodes[host][1]:
            yield host, wrappers.pop(host)
            size -= nodes.pop(host)[0]
        if size > held:
            yield from wrappers.items()
            wrappers, nodes, size = {}, {}, 0
    yield from wrappers.items()


def _rows(found: Iterator[tuple[str, Slot]]) -> Iterator[pa.RecordBatch]:
    some: list[tuple[str, str]] = []
    for host, w in found:
        some.append((host, json.dumps(w.packed(), separators=(",", ":"))))
        if len(some) >= 1000:
            yield pa.RecordBatch.from_pydict({"host": pa.array([x for x, _ in some], pa.string()), "wrapper": pa.array([y for _, y in some], pa.string())})
            some = []
    yield pa.RecordBatch.from_pydict({"host": pa.array([x for x, _ in some], pa.string()), "wrapper": pa.array([y for _, y in some], pa.string())})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, pages): one row per host."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trees() -> Iterator[tuple[str, Slot]]:
            for batch in batches:
                for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield host, page_tree(parsed(html.as_py()))

        yield from _rows(_fold(trees()))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trees() -> Iterator[tuple[str, Slot]]:
            for batch in batches:
                for host, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield host, Slot.unpacked(json.loads(w.as_py()))

        yield from _rows(_fold(trees()))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a host stand side by side."""

        def trees() -> Iterator[tuple[str, Slot]]:
            host, now = None, None
            for batch in batches:
                for h, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    tree = Slot.unpacked(json.loads(w.as_py()))
                    if h != host:
                        if now is not None:
                            yield host, now
                        host, now = h, tree
                    else:
                        merge(now, tree)
            if now is not None:
                yield host, now

        yield from _rows(trees())

    schema = "host string, wrapper string"
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).filter("host <> ''")
    some = rows.mapInArrow(first, schema).withColumn("_salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    fewer = some.repartition(parts, "host", "_salt").drop("_salt").mapInArrow(again, schema)
    return fewer.repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(last, schema)


class Wrapper:
    """What a host's wrapper says about a page's nodes."""

    def __init__(self, root: Slot | None):
        self.root = root
        self.varies = self._varies(root) if root else False

    def _varies(self, w: Slot) -> bool:
        return w.text == VARIES or any(self._varies(x) for x in w.children)

    def template(self, w: Slot | None) -> bool:
        return bool(w and self.varies and w.n >= MIN_PAGES and w.text not in (0, VARIES))


def _emit(e: Element, slot: Slot | None, w: Wrapper, inside: bool, out: list[str], links: bool) -> None:
    """Text of e's tree into out; inside: within a marked article."""
    own = not (w.template(slot) and (not inside or e.classed and e.tag not in HEADINGS))
    stack: list = [(x, own) for x in reversed(e.parts)]
    slots = _children(slot)
    n = 0
    blocks = _inner([e])[1]
    places = _places(blocks, slots)
    while stack:
        p, shown = stack.pop()
        if isinstance(p, tuple):
            if shown:
                out.append(unescape(p[0]) if "&" in p[0] else p[0])
        elif p.tag in BLOCK or p.marked or p.semantic:
            child = places[n]
            n += 1
            out.append(" ")
            if not _left_out(p, inside) and not (links and _link_list(p)):
                _emit(p, child, w, inside or p.semantic, out, links)
            out.append(" ")
        elif p.tag in VOID:
            if p.tag in ("br", "hr"):
                out.append(" ")
        else:
            stack += [(x, shown) for x in reversed(p.parts)]


def _left_out(e: Element, inside: bool) -> bool:
    return e.marked or e.tag == "header" and not inside


def _children(slot: Slot | None) -> list[Slot]:
    return slot.children if slot else []


def _places(blocks: list[Element], slots: list[Slot]) -> list[Slot | None]:
    """The wrapper's node of each block."""
    runs = _collapsed(blocks)
    if not slots:
        return [None] * len(blocks)
    pairs = dict((j, i) for i, j in aligned(slots, [_slot(label, run) for label, run in runs] if [x.label for x in slots] != [x for x, _ in runs] else [Slot(x) for x, _ in runs]))
    own = {id(e): slots[pairs[j]] for j, (_, run) in enumerate(runs) if j in pairs for e in run}
    return [own.get(id(e)) for e in blocks]


def _link_list(e: Element) -> bool:
    """Whether a list or a container is a menu: two links or more, and in a list most of the text, in a container all words."""
    if e.tag not in LISTS and e.tag not in CONTAINERS:
        return False
    total = links = n = 0
    stack = [e]
    while stack:
        for p in stack.pop().parts:
            if isinstance(p, tuple):
                size = len(p[0].strip())
                total += size
                links += size * p[1]
                if e.tag in CONTAINERS and not p[1] and re.search(r"\w", unescape(p[0])):
                    return False
            elif not p.marked:
                if e.tag in CONTAINERS and (p.tag == "p" or p.tag in HEADINGS):
                    return False
                n += p.tag == "a"
                stack.append(p)
    return n > 1 and total > 0 and links >= LINK_SHARE * total


def _articles(root: Element) -> list[Element]:
    """The outermost elements that the page marks as its article, outside of marked ones."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.semantic and not e.marked:
            out.append(e)
        elif not e.marked:
            stack += [p for p in reversed(e.parts) if not isinstance(p, tuple)]
    return out


def extracted(html: str, w: Wrapper) -> str:
    root = parsed(html)
    out: list[str] = []
    articles = _articles(root)
    if articles:
        slots = _slots_of(root, w.root, articles) if w.root is not None else {}
        for e in articles:
            _emit(e, slots.get(id(e)), w, True, out, False)
            out.append(" ")
    else:
        _emit(root, w.root, w, False, out, True)
    return " ".join("".join(out).split())


def _slots_of(root: Element, top: Slot, wanted: list[Element]) -> dict[int, Slot]:
    """The wrapper's nodes of the wanted elements, by id()."""
    ids, out = {id(e) for e in wanted}, {}
    stack = [(root, top)]
    while stack:
        e, slot = stack.pop()
        blocks = _inner([e])[1]
        for b, s in zip(blocks, _places(blocks, slot.children), strict=True):
            if s is not None:
                if id(b) in ids:
                    out[id(b)] = s
                else:
                    stack.append((b, s))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, url, text and n_chars of each row of pages."""
    small_batches(pages.sparkSession)
    found = saved(wrappers(pages, url_col, html_col), "wrappers")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    total = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    if total <= broadcast_bytes:
        both = rows.join(F.broadcast(found), "host", "left")
    else:
        counts = saved(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
        n = counts.agg(F.sum("n")).first()[0]
        none = rows.filter("host = ''").withColumn("wrapper", F.lit(None).cast("string"))
        both = salted_join(rows.filter("host <> ''"), found, "host", hot_keys(counts, "host", "n", n), F.xxhash64("id", "html")).select("host", "id", "url", "html", "wrapper").unionByName(none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for host, html, w in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if host not in known:
                    if len(known) > 5000:
                        known.clear()
                    raw = w.as_py()
                    known[host] = Wrapper(Slot.unpacked(json.loads(raw)) if raw else None)
                texts.append(extracted(html.as_py(), known[host]))
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column(0), "url": batch.column(1), "text": pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    out = both.select("id", "url", "host", "html", "wrapper").mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE: dict[str, str] = {}
