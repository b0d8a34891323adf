"""Main text of web pages by wrapper induction over the pages of a host.

1. Each page is parsed once into a tree of its block elements; siblings that repeat one another's shape count as one node.
   What is left is the page's shape, a small tree of labels, and blocks of text that hang on its nodes.
2. The distinct shapes of a host are aligned with its most frequent one by simple tree matching. Aligned nodes are a slot.
3. Of each slot, over all pages of the host: how many different contents have it, how many different texts it shows, how
   much of its text is linked. Slots that show the same on all pages are the template; slots that vary are content.
4. Of each shape, the nodes to keep: varying slots inside the article (marked as such, or else the smallest node that holds
   most of the varying text) and in none of the parts that are never article. The pages' blocks are filtered by that.

Pages are written once, parsed, to the shared folder; all else is about shapes and slots, which are aggregated before they
meet, and what a host's pages show is counted in parts, so a host with a third of all pages is many tasks.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, spread_join, stored

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr ins del".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; none of it is text of the page.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math select button object canvas audio video".split())
IGNORED = frozenset("html head body".split())
#: An element that ends with the start of another of its kind, and where the search for it ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = frozenset("ul ol dl menu table".split())
#: Such siblings are one node wherever they stand, if their shape is the same.
LISTED = frozenset("p li dt dd td th tr h2 h3 h4 h5 h6 blockquote pre ul ol dl table tbody figure figcaption".split())
DEEPEST = 200

NEVER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
NEVER_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer contentinfo copyright colophon sidebar aside complementary widget"
    " notice notices cookie cookies consent gdpr alert ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion"
    " form login signup register search newsletter subscribe subscription comment comments commentlist respond replies disqus share sharing social related recommended"
    " popup modal dialog overlay pagination pager toolbar hidden".split()
)
#: Marks of the article, the surest first.
ARTICLE = (lambda tag, words: tag == "article" or "articlebody" in words, lambda tag, words: tag == "main" or "main" in words, lambda tag, words: bool(words & {"article", "content", "post", "entry", "story"}))
#: A class that begins so says what is beside the element ("has-sidebar").
BESIDE = frozenset("has with no without".split())
#: Different contents that a slot needs before it can be the template's, outside and inside a marked article.
ENOUGH, ENOUGH_INSIDE = 3, 12
#: A slot is constant if it has at most one text for so many contents; linked, if more than this part of its text is.
PER_TEXT, LINKED, MOST = 10, 0.6, 0.8
BROADCAST_BYTES = 32 << 20

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*>)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
END = re.compile(r"<[a-zA-Z/!?]")


def marks(attributes: str) -> str:
    """Words of class, id, role and itemprop, sorted; `hidden` if the element is."""
    words = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "itemprop"):
            for part in value.split():
                pieces = [w for w in re.split("[^a-z]+", part) if w]
                if pieces and pieces[0] not in BESIDE:
                    words.update(pieces)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.add("hidden")
    return ".".join(sorted(words))


class Page:
    """Block elements of a page in order: label and parent of each; and its blocks of text: node, text, linked characters."""

    def __init__(self, source: str):
        self.labels, self.parents, self.blocks = ["page"], [-1], []
        self.stack, self.tags = [0], ["page"]
        self.text, self.links, self.link = [], 0, 0
        self._read(source)
        self._end()

    def _end(self) -> None:
        """The block so far ends."""
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((self.stack[-1], text, min(self.links, len(text))))
            self.text, self.links = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        self._end()
        if "p" == self.tags[-1]:
            self._close("p")
        if tag in CLOSES:
            for k in range(len(self.tags) - 1, 0, -1):
                if self.tags[k] in SCOPES or self.tags[k] not in CLOSES and self.tags[k] in NEVER_TAGS:
                    break
                if self.tags[k] in CLOSES[tag]:
                    del self.stack[k:], self.tags[k:]
                    break
        named = marks(attributes) if attributes else ""
        self.labels.append(f"{tag}.{named}" if named else tag)
        self.parents.append(self.stack[-1])
        if len(self.stack) < DEEPEST:  # as browsers do, deeper elements are siblings
            self.stack.append(len(self.labels) - 1)
            self.tags.append(tag)

    def _close(self, tag: str) -> None:
        self._end()
        self.link = 0
        for k in range(len(self.tags) - 1, 0, -1):
            if self.tags[k] == tag:
                del self.stack[k:], self.tags[k:]
                return
            if tag in ("p", *CLOSES) and self.tags[k] in ("article", "section", "main", "div", "table"):
                return  # an end tag of what isn't open there

    def _read(self, source: str) -> None:
        whole, at = source.rfind(">") + 1, 0
        skipped = None  # the inline tag whose content is left out, and how many of it are open
        while True:
            m = TOKEN.search(source, at, whole)
            piece = source[at : m.start() if m else whole]
            if piece and not skipped:
                self.text.append(piece)
                if self.link:
                    self.links += len(piece)
            if not m:
                break
            at = m.end()
            tag = m[2] and m[2].lower()
            if not tag:
                continue
            if skipped:
                if tag == skipped[0]:
                    skipped[1] += -1 if m[1] else 1
                    if not skipped[1]:
                        skipped = None
                continue
            if tag in RAW and not m[1]:
                if not m[3].endswith("/>"):
                    end = re.compile(f"</{re.escape(tag)}[^a-z0-9]", re.I).search(source, at)
                    if not end:  # all the rest is in it
                        return
                    at = end.start()
                if tag not in ("script", "style", "noscript", "template", "title"):
                    self.text.append(" ")
            elif tag in INLINE:
                attributes = m[3][:-1]
                if not m[1] and "=" in attributes and tag not in VOID and not m[3].endswith("/>") and NEVER_WORDS & set(marks(attributes).split(".")):
                    skipped = [tag, 1]
                elif tag == "a":
                    self.link = 0 if m[1] else 1
                elif tag == "br":
                    self.text.append(" ")
            elif tag in IGNORED or tag in RAW:
                continue
            elif tag in VOID:
                if tag == "hr":
                    self._end()
            elif m[1]:
                self._close(tag)
            else:
                self._open(tag, m[3][:-1].strip())
        tail = source[whole:]
        cut = END.search(tail)
        if not skipped:
            self.text.append(tail[: cut.start()] if cut else tail)

    def shape(self) -> tuple[str, list[int]]:
        """The shape, one line `depth label` a node in order, and of each element its node of the shape."""
        n = len(self.labels)
        groups: list[list[list[int]]] = [[] for _ in range(n)]  # of each element, its children; those alike in one list
        known, signature = {}, [0] * n
        children = defaultdict(list)
        for k in range(n - 1, -1, -1):
            seen, last = {}, None
            for child in reversed(children.pop(k, ())):
                label, sign = self.labels[child], signature[child]
                tag = label.partition(".")[0]
                if tag in LISTED and sign in seen:
                    groups[k][seen[sign]].append(child)
                elif sign == last and (tag != "div" or "." in label):
                    groups[k][-1].append(child)
                else:
                    seen[sign] = len(groups[k])
                    groups[k].append([child])
                last = sign
            signature[k] = known.setdefault((self.labels[k], *(signature[g[0]] for g in groups[k])), len(known))
            if k:
                children[self.parents[k]].append(k)
        node, lines, below = [0] * n, [], {}

        def walk() -> None:
            todo = [(0, 0)]
            while todo:
                element, depth = todo.pop()
                node[element] = len(lines)
                lines.append(f"{depth} {self.labels[element]}")
                todo += [(g[0], depth + 1) for g in reversed(groups[element])]

        walk()
        for element in range(n):  # parents come first
            firsts = below.setdefault(node[element], [node[g[0]] for g in groups[element]])
            for g, at in zip(groups[element], firsts):
                for child in g:
                    node[child] = at
        return "\n".join(lines), node


class Shape:
    """A shape as a tree: labels, parents, children and the hash of what is below each node."""

    def __init__(self, text: str):
        self.labels, self.parents, self.children, path = [], [], [], []
        for k, line in enumerate(text.split("\n")):
            depth, label = line.split(" ", 1)
            del path[int(depth) :]
            self.labels.append(label)
            self.parents.append(path[-1] if path else -1)
            self.children.append([])
            if path:
                self.children[path[-1]].append(k)
            path.append(k)
        self.below, self.size = [0] * len(self.labels), [1] * len(self.labels)
        for k in range(len(self.labels) - 1, -1, -1):
            self.below[k] = hash((self.labels[k], *(self.below[c] for c in self.children[k])))
            self.size[k] += sum(self.size[c] for c in self.children[k])


def aligned(shape: Shape, other: Shape) -> list[int]:
    """Of each node of shape that of other it is matched with (-1: none), by simple tree matching from the roots on.

    Children are matched in order, so that most nodes are; equal first and last children are matched with each other,
    which never costs a match.
    """
    known: dict[tuple[int, int], int] = {}

    def ends(a: list[int], b: list[int]) -> tuple[int, int]:
        head = tail = 0
        most = min(len(a), len(b))
        while head < most and shape.below[a[head]] == other.below[b[head]]:
            head += 1
        while tail < most - head and shape.below[a[-1 - tail]] == other.below[b[-1 - tail]]:
            tail += 1
        return head, tail

    def table(a: list[int], b: list[int]) -> list[list[int]]:
        best = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(row[j], best[-1][j + 1], best[-1][j] + score(x, y)))
            best.append(row)
        return best

    def score(x: int, y: int) -> int:
        if shape.labels[x] != other.labels[y]:
            return 0
        if shape.below[x] == other.below[y]:
            return shape.size[x]
        if (x, y) not in known:
            a, b = shape.children[x], other.children[y]
            head, tail = ends(a, b)
            inner = table(a[head : len(a) - tail], b[head : len(b) - tail])[-1][-1]
            known[x, y] = 1 + inner + sum(shape.size[c] for c in a[:head] + a[len(a) - tail :])
        return known[x, y]

    out, todo = [-1] * len(shape.labels), [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        a, b = shape.children[x], other.children[y]
        head, tail = ends(a, b)
        todo += list(zip(a[:head], b[:head])) + list(zip(a[len(a) - tail :], b[len(b) - tail :]))
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        best, i, j = table(a, b), len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((a[i], b[j]))
    return out


def slot_names(shape: Shape, pivot: Shape) -> list[str]:
    """A name for each node: that of the pivot's node, or one made of the parent's name and the label."""
    names: list[str] = []
    for k, at in enumerate(aligned(shape, pivot)):
        names.append(str(at) if at >= 0 else f"{names[shape.parents[k]]}/{shape.labels[k]}")
    return names


def parts(shape: Shape) -> tuple[list[bool], list[int]]:
    """Of each node: whether it is in a part that is never article; how sure a mark of the article it is in (3: none)."""
    n = len(shape.labels)
    tags = [label.partition(".")[0] for label in shape.labels]
    words = [frozenset(label.split(".")[1:]) for label in shape.labels]
    holds_article, holds_heading = [False] * n, [t == "h1" for t in tags]
    for k in range(n - 1, 0, -1):
        up = shape.parents[k]
        holds_article[up] |= holds_article[k] or tags[k] in ("article", "main")
        holds_heading[up] |= holds_heading[k]
    never, sure = [False] * n, [3] * n
    for k in range(1, n):
        up = shape.parents[k]
        sure[k] = min([sure[up], *(i for i, is_so in enumerate(ARTICLE) if is_so(tags[k], words[k]))])
        own = (tags[k] in NEVER_TAGS or bool(words[k] & NEVER_WORDS)) and tags[k] not in ("article", "main", "h1")
        if tags[k] == "article" and words[k] & {"comment", "comments", "ad", "advert", "sponsored", "promo", "related"}:
            own = True
        if holds_article[k] and "hidden" not in words[k]:
            own = False
        # The article's own head has its heading; a form around everything isn't a form.
        if holds_heading[k] and ((sure[up] < 3 and (tags[k] == "header" or "header" in words[k])) or tags[k] == "form"):
            own = False
        never[k] = never[up] or own
    return never, sure


def kept_nodes(shape: Shape, facts: dict[int, tuple[int, int, bool, int, int]]) -> list[int]:
    """The nodes whose blocks are the article. facts: of a node's slot the contents, texts, whether all are one text,
    characters and those that are linked."""
    never, sure = parts(shape)
    texts = [k for k in sorted(facts) if not never[k]]

    def constant(k: int, enough: int) -> bool:
        contents, several, same, _, _ = facts[k]
        return contents >= enough and (same or several * PER_TEXT <= contents)

    for level in range(3):
        inside = [k for k in texts if sure[k] <= level]
        if inside:
            tops = {}
            for k in inside:  # the outermost marked node of each
                top = k
                while shape.parents[top] >= 0 and sure[shape.parents[top]] <= level:
                    top = shape.parents[top]
                tops.setdefault(top, []).append(k)
            headed = [top for top, ks in tops.items() if any(shape.labels[k].partition(".")[0] == "h1" for k in ks)]
            inside = sorted(k for top in headed or tops for k in tops[top])
            return [k for k in inside if not constant(k, ENOUGH_INSIDE)] or inside
    varying = [k for k in texts if not constant(k, ENOUGH) and facts[k][4] <= LINKED * facts[k][3]] or [k for k in texts if not constant(k, ENOUGH)] or texts
    weight = [0] * len(shape.labels)
    for k in varying:
        weight[k] += facts[k][3]
    for k in range(len(weight) - 1, 0, -1):
        weight[shape.parents[k]] += weight[k]
    top = 0
    while True:
        into = [c for c in shape.children[top] if weight[c] > 0 and weight[c] >= MOST * weight[0] and shape.children[c]]
        if not into:
            break
        top = into[0]
    own = set()
    for k in range(len(weight)):
        if k == top or shape.parents[k] in own:
            own.add(k)
    return [k for k in varying if k in own or shape.labels[k].partition(".")[0] == "h1"]


BLOCK = pa.struct([("node", pa.int32()), ("text", pa.string())])
FACT = pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32())])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parsed_page(host: str, source: str) -> tuple[int, str, int, list[dict], list[dict]]:
    """key (of host and shape), shape, content (a hash of what isn't in a part that is never article), blocks, facts."""
    page = Page(source)
    shape, node = page.shape()
    never, _ = parts(Shape(shape))
    blocks, texts, content = [], {}, xxhash.xxh64()
    for element, text, linked in page.blocks:
        at = node[element]
        blocks.append({"node": at, "text": text})
        held = texts.setdefault(at, [xxhash.xxh64(), 0, 0])
        held[0].update(text.encode("utf-8", "surrogatepass") + b"\n")
        held[1] += len(text)
        held[2] += linked
        if not never[at]:
            content.update(text.encode("utf-8", "surrogatepass") + b"\n")
    facts = [{"node": k, "text": signed(h.intdigest()), "chars": min(n, 1 << 30), "linked": min(linked, 1 << 30)} for k, (h, n, linked) in sorted(texts.items())]
    return signed(xxhash.xxh64_intdigest(f"{host}\n{shape}".encode("utf-8", "surrogatepass"))), shape, signed(content.intdigest()), blocks, facts


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, key, shape, content, blocks, facts of pages (page_id, url, host, html)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [parsed_page(h, s) for h, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        key, shape, content, blocks, facts = zip(*rows) if rows else [()] * 5
        columns = [pa.array(key, pa.int64()), pa.array(shape, pa.string()), pa.array(content, pa.int64()), pa.array(blocks, pa.list_(BLOCK)), pa.array(facts, pa.list_(FACT))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["page_id", "url", "host", "key", "shape", "content", "blocks", "facts"])

    kind = pages.schema["page_id"].dataType.simpleString()
    columns = f"page_id {kind}, url string, host string, key long, shape string, content long, blocks array<struct<node: int, text: string>>, facts array<struct<node: int, text: bigint, chars: int, linked: int>>"
    return pages.mapInArrow(by_slices(each, 64), columns)


def shapes_of(pages: DataFrame) -> DataFrame:
    """key, host, shape, n: the distinct shapes of each host and how many pages have each."""
    return pages.groupBy("key").agg(F.any_value("host").alias("host"), F.any_value("shape").alias("shape"), F.count("*").alias("n"))


def slots_of(shapes: DataFrame) -> DataFrame:
    """key, node, slot (a hash of host and slot) of every node of every shape, aligned with the host's most frequent shape."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, node, slot = [], [], []
        for k, host, shape, pivot in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for at, name in enumerate(slot_names(Shape(shape), Shape(pivot))):
                key.append(k)
                node.append(at)
                slot.append(signed(xxhash.xxh64_intdigest(f"{host}\n{name}".encode("utf-8", "surrogatepass"))))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int32()), pa.array(slot, pa.int64())], ["key", "node", "slot"])

    pivots = shapes.groupBy("host").agg(F.max(F.struct("n", "shape"))["shape"].alias("pivot"))
    met = spread_join(shapes, pivots, "host").select("key", "host", "shape", "pivot")
    return met.mapInArrow(by_slices(each), "key long, node int, slot long")


def shown(pages: DataFrame) -> DataFrame:
    """key, node and what the node shows on the pages of that shape, pages alike in content counted once."""
    rows = pages.select("key", "content", F.explode("facts").alias("f")).select("key", "content", "f.*").distinct()
    texts = rows.groupBy("key", "node", "text").agg(F.count("*").alias("contents"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    sums = [F.sum(c).alias(c) for c in ("contents", "chars", "linked")]
    return texts.groupBy("key", "node").agg(*sums, F.count("*").alias("texts"), F.min("text").alias("least"), F.max("text").alias("most"))


def decisions(pages: DataFrame) -> DataFrame:
    """key, keep: of every shape the nodes whose blocks are the article."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [kept_nodes(Shape(shape), {f["node"]: (f["contents"], f["texts"], f["same"], f["chars"], f["linked"]) for f in facts}) for shape, facts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.list_(pa.int32()))], ["key", "keep"])

    shapes = stored(shapes_of(pages))
    # What a slot shows is summed over the shapes that have it (its texts are counted in each).
    nodes = stored(slots_of(shapes).join(shown(pages), ["key", "node"]))
    sums = [F.sum(c).alias(c) for c in ("contents", "texts", "chars", "linked")]
    slots = nodes.groupBy("slot").agg(*sums, (F.min("least") == F.max("most")).alias("same"))
    facts = spread_join(nodes.select("key", "node", "slot"), slots, "slot").groupBy("key").agg(F.collect_list(F.struct("node", "contents", "texts", "same", "chars", "linked")).alias("facts"))
    return shapes.join(facts, "key").select("key", "shape", "facts").mapInArrow(by_slices(each), "key long, keep array<int>")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): the article of every page, its blocks joined by an empty line.

    One row per row of df; ids and rows may repeat, other columns don't matter. A null html is empty; an empty page, or one
    without text, has the empty text. Pages with a null or odd url are one host. On a host with few pages there is no
    template to see: the marks of the elements and the lengths of texts decide alone. If all text of an article looks
    constant (copies of one page), it is kept. Character references are decoded and white space (any of Unicode) in a block
    becomes one space; the text of inline elements stays in its block, `br` is white space. Texts are never cut. Shapes,
    slots and contents are known by 64-bit hashes.
    """
    column = lambda c: F.col(f"`{c}`")
    rows = df.select(column(id_col).alias("page_id"), column(url_col).cast("string").alias("url"), host_of(column(url_col)).alias("host"), F.coalesce(column(html_col), F.lit("")).alias("html"))
    pages = stored(parsed(rows), codec="zstd")
    found = stored(decisions(pages))
    size = found.agg(F.sum(F.size("keep") * 4 + 32)).first()[0] or 0
    texts = pages.select("page_id", "url", "key", "blocks")
    if size < BROADCAST_BYTES:
        met = texts.join(F.broadcast(found), "key", "left")
    else:  # pages without blocks have no decision; they take one with nothing kept
        none = pages.select("key").distinct().join(found, "key", "left_anti").select("key", F.expr("cast(array() as array<int>)").alias("keep"))
        met = spread_join(texts, found.union(none), "key", counted=texts.select("key", "page_id", "url"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("keep", b["node"])), lambda b: b["text"]), "\n\n")
    return met.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
