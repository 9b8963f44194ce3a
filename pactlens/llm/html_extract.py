"""Main text of web pages by wrapper induction over the pages of a host.

For each host one page of its most frequent layout is the reference. Every page's DOM
tree is aligned to its host's reference by simple tree matching: the largest
order-preserving match of the trees, computed by dynamic programming over children.
Counts over all different articles of the host tell how often a reference node's text
recurs unchanged; nodes that hardly vary are the host's template, and what aligns to
them with the same text is dropped from a page. Varying slots are content, unless their
element says that they are a menu, header, footer, sidebar, notice, advert, form,
comment section or the like; within an article only containers can say so. The main text
is what the outermost ``main`` and ``article`` elements hold, all of them; where that is less
than a quarter of the text, and on pages without, what is left of the page.
A host that prints one article again and again counts it once, and template removal
never takes more than half of a page's main text.

Scale: one row a page, of its host, the hash of its main text and the nodes that recur,
is shuffled for the counts, pre-aggregated. Pages meet their host's reference in a join
whose frequent hosts Spark splits (AQE skew join, which needs the references as a
written table: an aggregate below a join is not split); no host's pages are ever
gathered. The table of two child lists is never held: its rows are computed again for
the trace, in linear memory but for a logarithm. Equal subtrees at both ends are paired
beforehand. The work is done when the frame is made, but for the last pass over the pages.

Edges: null or empty html gives the empty text; pages without a host in their url have
no template; exact copies of the reference say nothing about it and don't count; repeated
rows are returned each; pages of any depth are matched without recursion.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_work_table, work_table

#: Elements without content, and those whose content is no markup; fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An open element (first) ends where one of these starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
SCOPE = frozenset("table ul ol dl select html body".split())
#: Elements, roles and words in class or id that mark what is not the article.
DROPPED = frozenset("head script style noscript template nav footer aside form button select input textarea iframe object embed svg canvas dialog menu map audio video noframes noembed xmp title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist reply replies respond disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social widget widgets toolbar pagination pager paging skip hidden".split())
HEADERS = frozenset("header topbar".split())
#: Words that mark boilerplate only as a whole class or id, or before one of the second kind.
AROUND = frozenset("related recommended recommendations".split())
LINKS = frozenset("posts articles stories links news content items".split())
#: Within an article, words mark containers alone, as a whole class or id or before one of
#: the second kind: a paragraph, a heading or a figure there is the article's own.
DROPPED_INSIDE = DROPPED_WORDS - frozenset("notice notices banner skip respond widget widgets hidden toolbar overlay modal popup".split())
PARTS = frozenset("area bar block box button buttons container form icons inner link links list panel section slot thread unit wrap wrapper".split())
OWN = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hgroup header address details summary".split()) | INLINE
MAIN = ("article", "main")

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|\b(hidden)\b")
WORD = re.compile(r"[a-z]+")

#: Share of the other articles in which a template node recurs, outside and inside the
#: main text; different articles needed.
SHARE, SHARE_INSIDE, PAGES, PAGES_INSIDE = 0.6, 0.9, 3, 8


class Node:
    __slots__ = ("tag", "label", "kids", "text", "drop", "size", "height", "number", "shape", "same")

    def __init__(self, tag: str, label: str, text: str = "", drop: bool = False):
        self.tag, self.label, self.text, self.drop, self.kids = tag, label, text, drop, []
        self.size = self.height = self.number = self.shape = self.same = 0


def _element(tag: str, attributes: str, inside: bool) -> Node:
    """``inside``: within an article, where a header is the article's own."""
    drop = tag in DROPPED or tag == "header" and not inside
    label = tag
    if attributes:
        words: set[str] = set()
        marked = False
        for name, a, b, c, flag in ATTR.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if flag or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                drop = True
            elif name in ("class", "id"):
                for part in value.split():
                    found = WORD.findall(part)
                    words.update(found)
                    if found and found[0] in AROUND and (len(found) == 1 or found[1] in LINKS):
                        drop = True
                    marked = marked or bool(found) and found[0] in DROPPED_INSIDE and (len(found) == 1 or found[1] in PARTS)
                if name == "class":
                    label = f"{tag}.{value}"
            elif name == "role":
                drop = drop or value in DROPPED_ROLES
        if inside:
            drop = drop or marked and tag not in OWN
        elif tag not in ("html", "body", *MAIN):
            drop = drop or not DROPPED_WORDS.isdisjoint(words) or not HEADERS.isdisjoint(words)
    return Node(tag, label, drop=drop)


def parse(page: str) -> Node:
    """The page's tree; text nodes have the tag ``#``."""
    root = Node("#root", "#root")
    stack, names = [root], ["#root"]
    at, inside = 0, 0

    def close(k: int) -> None:
        nonlocal inside
        for name in names[k:]:
            inside -= name in MAIN
        del stack[k:], names[k:]

    def add_text(raw: str) -> None:
        if raw and not raw.isspace():
            stack[-1].kids.append(Node("#", "#", html_module.unescape(raw) if "&" in raw else raw))
        elif raw and stack[-1].kids:
            stack[-1].kids.append(Node("#", "#", " "))

    while True:
        m = TAG.search(page, at)
        if not m:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end cuts off
            add_text(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add_text(re.sub(r"^<!\[CDATA\[|\]\]>$", "", m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in names[1:]:
                close(len(names) - 1 - names[::-1].index(tag))
            elif tag == "p":
                stack[-1].kids.append(Node("p", "p"))
            continue
        if tag in ENDS_P and "p" in names:
            k = len(names) - 1 - names[::-1].index("p")
            if not {"button", "table", "td", "th", "caption"}.intersection(names[k:]):
                close(k)
        for k in range(len(names) - 1, 0, -1):
            if tag in ENDS.get(names[k], ()):
                close(k)
                break
            if names[k] in SCOPE and not (names[k] == "table" and tag in ("tr", "tbody")) or names[k] not in INLINE and names[k] not in ENDS and names[k] != "p":
                break
        node = _element(tag, m[3], inside > 0)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
        elif tag not in VOID:
            stack.append(node)
            names.append(tag)
            inside += tag in MAIN
    _count(root)
    return root


def _count(root: Node) -> None:
    """Number the nodes in document order; ``size`` is a subtree's number of nodes,
    ``height`` that of the levels below it, ``shape`` the hash of its labels, ``same`` that of its labels and texts."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        todo.extend(reversed(node.kids))
    for node in reversed(order):
        kids = node.kids
        if kids:
            node.size = 1 + sum([k.size for k in kids])
            node.height = 1 + max([k.height for k in kids])
            node.shape = hash((node.label, *[k.shape for k in kids]))
            node.same = hash((node.label, *[k.same for k in kids]))
        else:
            node.size, node.shape, node.same = 1, hash((node.label,)), hash((node.label, node.text))


def _known(a: Node, b: Node, scores: dict) -> int:
    """Nodes of the largest match of two trees, if ``scores`` has what it needs."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    return scores[a.shape, b.shape] if a.kids and b.kids else 1  # the two alone


def _score(a: Node, b: Node, scores: dict) -> int:
    """Nodes of the largest match of two trees; ``scores`` is a memo by their shapes.

    The pairs of subtrees that it rests on are listed first and then scored from the
    lowest up, so that no depth of a page exhausts the stack.
    """
    todo, pairs = [(a, b)], {}
    while todo:
        p, q = todo.pop()
        key = p.shape, q.shape
        if p.label != q.label or p.shape == q.shape or key in scores or key in pairs:
            continue
        x, y = _differing(p.kids, q.kids)
        pairs[key] = p.height, p, x, y
        left, right = ({k.shape: k for k in z if k.kids}.values() for z in (x, y))
        todo.extend((k, c) for k in left for c in right if k.label == c.label)
    for key, (_, p, x, y) in sorted(pairs.items(), key=lambda item: item[1][0]):
        found = 1 + sum(k.size for k in p.kids) - sum(k.size for k in x)
        scores[key] = found + (int(_rows(x, y, scores)[-1]) if x and y else 0)
    return _known(a, b, scores)


def _ends(x: list[Node], y: list[Node], what: str) -> tuple[int, int]:
    """Lengths of the equal leading and trailing runs of two lists; some largest match
    pairs them."""
    n, lead, tail = min(len(x), len(y)), 0, 0
    get = attrgetter(what)
    while lead < n and get(x[lead]) == get(y[lead]):
        lead += 1
    while tail < n - lead and get(x[-1 - tail]) == get(y[-1 - tail]):
        tail += 1
    return lead, tail


def _differing(x: list[Node], y: list[Node]) -> tuple[list[Node], list[Node]]:
    """Both lists without the runs at their ends that are equal in shape."""
    lead, tail = _ends(x, y, "shape")
    return x[lead : len(x) - tail], y[lead : len(y) - tail]


def _paired(x: list[Node], y: list[Node], what: str) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """(pairs of the equal runs at both ends, what is left of either list)."""
    lead, tail = _ends(x, y, what)
    pairs = [*zip(x[:lead], y[:lead]), *zip(x[len(x) - tail :], y[len(y) - tail :])]
    return pairs, x[lead : len(x) - tail], y[lead : len(y) - tail]


def _weights(y: list[Node], scores: dict) -> Callable[[Node], np.ndarray]:
    """node -> its scores with all of ``y``, computed once for each shape."""
    classes: dict[int, int] = {}
    of = np.array([classes.setdefault(c.shape, len(classes)) for c in y])
    first = list({c.shape: c for c in reversed(y)}.items())
    first = [c for _, c in sorted(first, key=lambda f: classes[f[0]])]
    memo: dict[int, np.ndarray] = {}

    def weigh(k: Node) -> np.ndarray:
        w = memo.get(k.shape)
        if w is None:
            if len(memo) * len(y) > 1 << 20:
                memo.clear()
            w = memo[k.shape] = np.array([_known(k, c, scores) for c in first], np.int64)[of]
        return w

    return weigh


def _step(row: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The next row of the table: the best of above, left, and the diagonal plus ``w``."""
    out = np.zeros_like(row)
    np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w), out=out[1:])
    return out


def _rows(x: list[Node], y: list[Node], scores: dict) -> np.ndarray:
    """The table's last row."""
    weigh = _weights(y, scores)
    row = np.zeros(len(y) + 1, np.int64)
    for k in x:
        row = _step(row, weigh(k))
    return row


def _align(x: list[Node], y: list[Node], scores: dict) -> list[tuple[Node, Node]]:
    """Pairs of the largest order-preserving match of two lists; among matches of equal
    size, one with more pairs that are equal in their texts too.

    The table is traced back from its end in halves of its rows, the later first, whose
    first rows alone are kept: memory is a row times the logarithm of their number.
    """
    pairs: list[tuple[Node, Node]] = []
    if {k.same for k in x}.isdisjoint([c.same for c in y]):
        pairs, x, y = _paired(x, y, "shape")
        if not x or not y:
            return pairs
        weigh = _weights(y, scores)
    else:
        structure, same = _weights(y, scores), np.array([c.same for c in y])
        weigh = lambda k: structure(k) * (len(y) + 1) + (same == k.same)

    def back(lo: int, hi: int, row: np.ndarray, j: int) -> int:
        if not j:
            return 0
        if hi - lo > 32:
            mid, middle = (lo + hi) // 2, row
            for k in x[lo:mid]:
                middle = _step(middle, weigh(k)[:j])
            j = back(mid, hi, middle, j)
            return back(lo, mid, row[: j + 1], j)
        rows = [row]
        for k in x[lo:hi]:
            rows.append(_step(rows[-1], weigh(k)[:j]))
        i = hi - lo
        while i and j:
            w = weigh(x[lo + i - 1])[j - 1]
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                pairs.append((x[lo + i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return j

    back(0, len(x), np.zeros(len(y) + 1, np.int64), len(y))
    return pairs


def match(a: Node, b: Node) -> tuple[int, list]:
    """Simple tree matching: (number of matched nodes, pairs of text nodes)."""
    if a.label != b.label:
        return 0, []
    scores: dict = {}
    total = _score(a, b, scores)
    pairs, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.tag == "#":
            pairs.append((p, q))
            continue
        if p.shape == q.shape:
            todo.extend(zip(p.kids, q.kids))
            continue
        equal, x, y = _paired(p.kids, q.kids, "same")
        todo.extend(equal)
        if x and y:
            for k in {k.shape: k for k in x if k.kids}.values():
                for c in {c.shape: c for c in y if c.kids}.values():
                    if k.label == c.label and k.shape != c.shape and (k.shape, c.shape) not in scores:
                        _score(k, c, scores)
            todo.extend(_align(x, y, scores))
    return total, pairs


def _squeeze(text: str) -> str:
    return " ".join(text.split())


@lru_cache(256)
def _reference(page: str) -> Node:
    return parse(page)


def _visible(nodes: list[Node], template: frozenset[int]) -> int:
    """Characters of subtrees without what is dropped."""
    n, todo = 0, list(nodes)
    while todo:
        x = todo.pop()
        if x.tag == "#":
            n += 0 if x.number in template else len(_squeeze(x.text))
        elif not x.drop:
            todo.extend(x.kids)
    return n


def _main(root: Node) -> list[Node]:
    """The outermost ``main`` and ``article`` elements that have text, in page order; where
    they hold less than a quarter of the page's text, and on pages without, the whole page."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.drop:
            continue
        if x.tag in MAIN:
            if _visible([x], frozenset()):
                found.append(x)
        else:
            todo.extend(reversed(x.kids))
    if found and 4 * _visible(found, frozenset()) < _visible([root], frozenset()):
        found = []
    return found or [root]


def _template(root: Node, parts: list[Node], constant: frozenset[int], inner: frozenset[int]) -> frozenset[int]:
    """What to leave out of a page: text nodes aligned to constant ones outside its main
    text, and those inside, unless less than half of the main text would stay: an article
    that its host prints again and again is no template."""
    if parts[0] is root:
        return constant if _visible(parts, constant) else frozenset()
    out = inner if 2 * _visible(parts, inner) >= _visible(parts, frozenset()) else frozenset()
    return frozenset(out)


def text_of(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The main text's blocks, joined by blank lines."""
    blocks, part = [], []

    def flush() -> None:
        if block := _squeeze("".join(part)):
            blocks.append(block)
        part.clear()

    todo: list[Node | None] = [None, *reversed(_main(root))]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.tag == "#":
            if x.number not in template:
                part.append(x.text)
        elif x.tag == "br":
            part.append(" ")
        elif not x.drop:
            if x.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return "\n\n".join(blocks)


def _inside(root: Node) -> set[int]:
    """Numbers of the nodes within articles."""
    out: set[int] = set()
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag in MAIN and not x.drop:
            out.update(range(x.number, x.number + x.size))
        else:
            todo.extend(x.kids)
    return out


# --- Spark ---------------------------------------------------------------------------

#: Start tags of a page's frame, with their class, as far as it is the first attribute.
SKELETON = r"<(?:body|div|main|section|article|aside|nav|header|footer|form|table)\b(?:\s+class=\"[^\"0-9]*)?"
#: Kinds of frames told apart on a host; the reference has the most frequent one.
LAYOUTS = 8
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _article_hash(root: Node) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text_of(root).encode()) - (1 << 63)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page the hash of its main text and the reference's text nodes that recur
    in it; none for copies of the reference."""
    for b in batches:
        hosts, articles, nodes = [], [], []
        for host, page, ref in zip(*(b.column(k) for k in range(3))):
            page, ref = page.as_py(), ref.as_py()
            if page == ref:
                continue
            tree, root = _reference(ref), parse(page)
            hosts.append(host.as_py())
            articles.append(_article_hash(root))
            nodes.append([mine.number for mine, theirs in match(tree, root)[1] if mine.text.strip() and _squeeze(mine.text) == _squeeze(theirs.text)])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(articles, pa.int64()), pa.array(nodes, pa.list_(pa.int32()))], names=["host", "article", "nodes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts, dropped = [], []
            for page, ref, outer, inner in zip(*(part.column(k) for k in range(2, 6))):
                page, ref = page.as_py(), ref.as_py()
                if not page:
                    texts.append("")
                    dropped.append(0)
                    continue
                root = parse(page)
                outer, inner = set(outer.as_py() or ()), set(inner.as_py() or ())
                template: frozenset[int] = frozenset()
                if outer and ref is not None:
                    equal = [(mine.number, theirs.number) for mine, theirs in match(_reference(ref), root)[1] if mine.number in outer and _squeeze(mine.text) == _squeeze(theirs.text)]
                    template = _template(root, _main(root), frozenset(q for _, q in equal), frozenset(q for p, q in equal if p in inner))
                texts.append(text_of(root, template))
                dropped.append(len(template))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=["page_id", "url", "text", "n_template"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) of every page; ``n_template``: how many
    of its text nodes the host's template took out of the main text."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract("url", HOST, 1))
    rows = rows.withColumn("host", F.when(host != "", host))
    layout = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit(SKELETON), F.lit(0))))
    known = rows.where("host IS NOT NULL AND html <> ''").withColumn("layout", F.pmod(F.xxhash64(layout), F.lit(LAYOUTS)))
    of_layout = known.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min_by("html", F.xxhash64("page_id", "html")).alias("html"))
    references = of_layout.groupBy("host").agg(F.max_by("html", F.struct("n", "layout")).alias("reference"))
    references = work_table(references, "reference-pages")
    met = rows.where("html <> ''").join(references, "host").select("host", "html", "reference")
    found = met.mapInArrow(_evidence, "host string, article long, nodes array<int>")
    articles = work_table(found.groupBy("host", "article").agg(F.max("nodes").alias("nodes")), "article-evidence")
    counts = articles.select("host", F.explode("nodes").alias("node")).groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"))
    often = counts.join(articles.groupBy("host").agg(F.count(F.lit(1)).alias("articles")), "host")
    constant = often.groupBy("host").agg(
        F.collect_list(F.when((F.col("articles") >= PAGES) & (F.col("n") >= SHARE * F.col("articles")), F.col("node"))).alias("outer"),
        F.collect_list(F.when((F.col("articles") >= PAGES_INSIDE) & (F.col("n") >= SHARE_INSIDE * F.col("articles")), F.col("node"))).alias("inner"),
    )
    templates = work_table(references.join(constant, "host", "left"), "templates")
    drop_work_table(references)
    drop_work_table(articles)
    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.join(templates, "host", "left").select("page_id", "url", "html", "reference", "outer", "inner").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_template long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
