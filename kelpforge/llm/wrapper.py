"""HTML extraction by wrapper induction.

The pages of a host are aligned node by node with simple tree matching: the largest set of matched nodes that keeps
order and ancestry. Neighbours with equal labels are folded into one node first. What has the same text in every page
of the host is template, what varies is a slot. A page's main text is the varying text of its article slot, without
the parts whose element or name says that they are menus, forms, adverts, comments and the like, since those vary too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import materialize, slices, table

#: Nodes are template if their text is in all pages of a host, of which at least so many have different main texts.
MIN_PAGES = 3
#: A node is template only if at least this percentage of the host's pages have it, so that copies of one page are not.
COMMON_PERCENT = 80
#: The nodes that a template keeps; beyond them the rarest go, which then count as slots.
MAX_NODES = 1500
#: Levels of a template; what lies below is text of the last one.
LEVELS = 150
SALTS = 32
#: Templates are broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20

#: Elements that never hold main text, and words in class, id or role that say so (fixed lists).
OUTER = frozenset("nav footer aside form button select input label dialog menu object embed canvas audio video map head".split()) | dom.RAW
NEVER = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup social share sharing related recommended recommendations sidebar breadcrumb breadcrumbs navbar navigation nav menu comment comments disqus "
    "replies respond discussion reactions footer masthead pagination pager paywall".split()
)
#: Of these words those that hold even of what encloses the page's title.
REMARKS = frozenset("comment comments".split())
MAYBE = frozenset("header banner notice notices alert widget widgets side rail aside form search login toolbar topbar skip tags meta byline complementary contentinfo".split())
CONTENT = frozenset("article content post entry main story body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def host_of(url):
    """Column: the host of a URL in lower case, without a port; null and odd URLs share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# A template node is a list: [label, pages, constants or None (not yet seen), children].
LABEL, PAGES, CONSTANTS, CHILDREN = range(4)


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text)


def fold(node: dom.Node) -> list:
    """The template of one page: neighbours with equal labels become one node that holds the hashes of all their texts."""

    def build(nodes: list[dom.Node], label: str) -> list:
        texts: set[int] = set()
        below: list[tuple[str, list[dom.Node]]] = []
        for one in nodes:
            own: list[str] = []
            for child in one.children:
                if isinstance(child, str):
                    own.append(child)
                elif child.tag in dom.RAW:
                    continue
                elif child.tag in dom.BLOCK and one.depth < LEVELS:
                    name = child.label
                    if below and below[-1][0] == name:
                        below[-1][1].append(child)
                    else:
                        below.append((name, [child]))
                else:
                    own.append(" ".join(text for _, text in dom.walk(child)))
            if text := dom.clean(own):
                texts.add(_hash(text))
        # the same sequence of labels over again, as with headings and paragraphs, is folded too
        merged: dict[str, list[dom.Node]] = {}
        for name, group in below:
            merged.setdefault(name, []).extend(group)
        return [label, 1, sorted(texts), [build(group, name) for name, group in merged.items()]]

    return build([node], node.label)


def match(a: list, b: list) -> list[tuple[list, list]]:
    """Pairs of children of ``a`` and ``b`` in the best simple tree matching of the two nodes."""
    memo: dict[tuple[int, int], int] = {}

    def score(x: list, y: list) -> int:
        if x[LABEL] != y[LABEL]:
            return 0
        key = (id(x), id(y))
        if key not in memo:
            memo[key] = 1 + align(x[CHILDREN], y[CHILDREN])[-1][-1]
        return memo[key]

    def align(p: list, q: list) -> list[list[int]]:
        best = [[0] * (len(q) + 1)]
        for x in p:
            row = [0]
            for j, y in enumerate(q):
                row.append(max(row[j], best[-1][j + 1], best[-1][j] + score(x, y)))
            best.append(row)
        return best

    p, q = a[CHILDREN], b[CHILDREN]
    best = align(p, q)
    i, j, pairs = len(p), len(q), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((p[i], q[j]))
    return pairs[::-1]


def merge(a: list, b: list) -> list:
    """Both templates as one: counts add up, constants are what all pages share, unmatched nodes stand side by side."""
    children, at = [], 0
    rest = b[CHILDREN]
    partner = {id(x): y for x, y in match(a, b)}
    for x in a[CHILDREN]:
        y = partner.get(id(x))
        if y is None:
            children.append(x)
            continue
        while rest[at] is not y:
            children.append(rest[at])
            at += 1
        at += 1
        children.append(merge(x, y))
    children += rest[at:]
    return [a[LABEL], a[PAGES] + b[PAGES], sorted(set(a[CONSTANTS]) & set(b[CONSTANTS])), children]


def _prune(root: list, most: int = MAX_NODES) -> list:
    """The template with its ``most`` most frequent nodes; of equal counts those nearer the root, then the earlier ones, stay."""
    nodes = [root]
    for node in nodes:
        nodes += node[CHILDREN]
    if len(nodes) <= most:
        return root
    # no child is on more pages than its parent, so parents come before their children
    kept = {id(x) for x in sorted(nodes, key=lambda x: -x[PAGES])[:most]}
    for node in nodes:
        node[CHILDREN] = [x for x in node[CHILDREN] if id(x) in kept]
    return root


class Wrapper:
    """The template of a host: how many different texts it has seen, and its tree."""

    def __init__(self, seen: list[int] | None = None, root: list | None = None):
        self.seen, self.root = set(seen or ()), root

    def add(self, other: Wrapper) -> None:
        if not other.seen - self.seen and len(self.seen) < MIN_PAGES:
            return  # a copy of a page says nothing about what varies
        self.seen = set(sorted(self.seen | other.seen)[:MIN_PAGES])
        self.root = _prune(merge(self.root, other.root)) if self.root else other.root

    @classmethod
    def of_page(cls, html: str) -> Wrapper:
        tree = dom.parse(html)
        text = "\n".join(x for slot in slots(tree) for _, x in dom.walk(slot, _dropped))
        return cls([_hash(text)], fold(tree))

    def dump(self) -> bytes:
        return json.dumps([sorted(self.seen), self.root]).encode()

    @classmethod
    def load(cls, data: bytes | None) -> Wrapper:
        return cls(*json.loads(data)) if data else cls()

    def constants(self, page: list) -> dict[str, set[int]]:
        """Hashes of a page's texts that are template, by the label path of their node."""
        found: dict[str, set[int]] = {}
        if self.root is None or len(self.seen) < MIN_PAGES:
            return found
        stack = [(self.root, page, page[LABEL])]
        while stack:
            known, node, path = stack.pop()
            if 100 * known[PAGES] >= COMMON_PERCENT * self.root[PAGES] and known[CONSTANTS]:
                found.setdefault(path, set()).update(known[CONSTANTS])
            stack += [(x, y, f"{path}>{y[LABEL]}") for x, y in match(known, node)]
        return found


def _dropped(node: dom.Node) -> bool:
    if node.tag in OUTER or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    names = node.names
    if node.tag in HEADINGS or node.tag in ("html", "body", "main"):
        return False
    if names & NEVER and (names & REMARKS or node.tag != "article" and not any(x.tag == "h1" for x in _below(node))):
        return True
    if node.tag == "header" or (names & MAYBE and not names & CONTENT):
        return not any(x.tag in HEADINGS for x in _below(node))
    return False


def _below(node: dom.Node) -> Iterator[dom.Node]:
    stack = [x for x in node.children if not isinstance(x, str)]
    while stack:
        one = stack.pop()
        yield one
        stack += [x for x in one.children if not isinstance(x, str)]


def _mass(node: dom.Node) -> int:
    return sum(len(text) for _, text in dom.walk(node, _dropped))


def slots(tree: dom.Node) -> list[dom.Node]:
    """The nodes that hold the article: ``article`` or ``main`` elements, else the smallest node with most of the text."""
    found: list[dom.Node] = []
    stack = [tree]
    while stack:
        node = stack.pop()
        if node is not tree and _dropped(node):
            continue
        if node.tag == "article" or node.attrs.get("itemprop") == "articleBody":
            found.append(node)
            continue
        stack += [x for x in reversed(node.children) if not isinstance(x, str)]
    if len(found) == 1:
        return found
    if found:
        masses = [_mass(x) for x in found]
        return [x for x, m in zip(found, masses, strict=True) if 4 * m >= max(masses)]
    mains = [x for x in _below(tree) if (x.tag == "main" or x.attrs.get("role") == "main") and not _dropped(x)]
    node = mains[0] if mains else tree
    while True:  # down to the child with nearly all of the text
        parts = [x for x in node.children if not isinstance(x, str) and x.tag in dom.BLOCK and not _dropped(x)]
        total = _mass(node)
        best = max(parts, key=_mass, default=None)
        named = [x for x in parts if x.names & CONTENT and 2 * _mass(x) > total]
        if named:
            node = named[0]
        elif best is not None and best.tag in ("html", "body", "div", "section", "main", "center", "table", "tbody", "tr", "td") and 10 * _mass(best) >= 9 * total:
            node = best
        else:
            return [node]


def extract_text(html: str | None, wrapper: Wrapper) -> str:
    """The main text of a page: the blocks of its slots that are not template, joined by blank lines."""
    if not html:
        return ""
    tree = dom.parse(html)
    constant = wrapper.constants(fold(tree)) if len(wrapper.seen) >= MIN_PAGES else {}
    path_of: dict[int, str] = {}
    if constant:
        stack = [(tree, tree.label)]
        while stack:
            node, path = stack.pop()
            path_of[id(node)] = path
            for child in node.children:
                if not isinstance(child, str):
                    stack.append((child, f"{path}>{child.label}" if child.tag in dom.BLOCK else path))
    blocks = []
    for slot in slots(tree):
        for owner, text in dom.walk(slot, _dropped):
            if not constant or _hash(text) not in constant.get(path_of[id(owner)], ()):
                blocks.append(text)
    return "\n\n".join(blocks)


def _merged(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Templates of equal keys as one, streamed in order: a task holds two templates at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in slices(batches, 64):
            for host, salt, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (host, salt) != now:
                    if held is not None:
                        yield pa.RecordBatch.from_pydict({"host": [now[0]], "salt": pa.array([now[1]], pa.int32()), "template": [held.dump()]})
                    now, held = (host, salt), Wrapper()
                held.add(Wrapper.load(data))
        if held is not None:
            yield pa.RecordBatch.from_pydict({"host": [now[0]], "salt": pa.array([now[1]], pa.int32()), "template": [held.dump()]})

    dealt = partial.repartition(*keys).sortWithinPartitions("host", "salt", "template")
    return dealt.mapInArrow(run, "host string, salt int, template binary")


def induce(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, template`` for each host, from all its pages.

    Each task merges the pages that it reads, then the partial templates of a host meet in SALTS groups and then in
    one, so that a host with a third of all pages is not gathered anywhere.
    """
    picked = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, Wrapper] = {}

        def done():
            n = len(held)
            return pa.RecordBatch.from_pydict({"host": list(held), "salt": pa.array([salt] * n, pa.int32()), "template": [x.dump() for x in held.values()]})

        for batch in slices(batches, 128):
            for host, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(host, Wrapper()).add(Wrapper.of_page(html))
            if len(held) > 5000:
                yield done()
                held.clear()
        if held:
            yield done()

    partial = picked.mapInArrow(run, "host string, salt int, template binary")
    salted = _merged(partial, ["host", "salt"])
    return _merged(salted.withColumn("salt", F.lit(0)), ["host"]).select("host", "template")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``; the text is empty if there is none.

    Null html counts as empty, null and odd URLs as one host; ids, null or repeated, are carried as they are; other
    columns are ignored; an empty table gives no rows. A host with fewer than MIN_PAGES different pages has no template,
    its pages are judged by their elements alone. Limits: an element below DEEPEST others is not nested, so that a menu
    there stays text; templates have LEVELS levels and keep MAX_NODES nodes, the rest counts as varying.
    """
    templates = materialize(induce(pages, url_col=url_col, html_col=html_col), "templates")
    size = templates.agg(F.coalesce(F.sum(F.length("template") + F.length("host")), F.lit(0)).alias("n")).first()["n"]
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = own.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes | None, Wrapper] = {}
        for batch in slices(batches, 128):
            texts = []
            for html, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if data not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[data] = Wrapper.load(data)
                texts.append(extract_text(html, known[data]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = own.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")


def op4_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
