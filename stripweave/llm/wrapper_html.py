"""Main text of web pages by wrapper induction.

For every host a bounded sample of its distinct pages (``sample_pages``, chosen by hash) is parsed and
aligned by simple tree matching. Aligned nodes with different texts are slots; the path to the node that
holds most of them is the host's content. Then every page is read: a block that stands at the same place
with the same text on two or more, and on more than half, of a host's distinct pages that the path fits
is template. Beside the content template goes block by block. Inside it whole sections go, all of whose blocks are template and more than
headings or labels, and single passages of more than 12 words; a subheading, label or formula that articles share stays. All text that is
neither template nor furniture is kept, wherever it stands. Pages of the same content text count once.

Where template would take more than half of the content text of a host's distinct pages, it is left in
there: such pages are near copies of each other rather than filled forms. This holds for any number of
pages.

Defined results: null or empty html gives an empty text; a null or odd url counts as one host of its
own; repeated rows are extracted one by one; empty tables give empty results; other columns are
ignored; very long and very deep pages are read whole, in time that grows with their length. A page's own
notices, adverts, forms and comments, which may differ from page to page, are left out by tag or by a whole
class, id or role name. A form, or an element so named, that wraps the page's article is read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PerWorker, materialise

#: Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEFT_OUT = frozenset(
    "head script style noscript template iframe object svg canvas button select option textarea input label fieldset "
    "nav footer aside menu dialog audio video".split()
)
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote "
    "pre figure figcaption header footer nav aside address form fieldset hr details summary hgroup center".split()
)
ENDS_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body", "li", "dt", "dd"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure li tr td th dt dd".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot tr select".split())
#: Class, id and role names of what is not the article. A name counts as a whole, alone or
#: with an ending that says no more than "a part of the page": related-links does, related-work does not.
FURNITURE = (
    "nav navbar navigation menu sidebar aside advert adverts advertisement ad ads sponsor sponsored banner cookie cookies consent gdpr notice "
    "alert comment comments disqus replies share sharing social related promo newsletter subscribe subscription breadcrumb breadcrumbs "
    "footer popup modal overlay login signup widget contentinfo complementary search toolbar dialog masthead pagination pager"
).split()
ENDINGS = "area articles bar block box button buttons container content form footer header inner items label links list main panel posts section slot stories text title unit widget wrap wrapper".split()
FURNITURE_NAME = re.compile(rf"(?:(?:{'|'.join(ENDINGS)}|main|page|post|site|top|side|left|right)[-_])?(?:{'|'.join(FURNITURE)})(?:[-_]?(?:{'|'.join(FURNITURE + ENDINGS)}))*(?:[-_]?\d+)?")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


_judged = PerWorker()


def is_furniture(name: str) -> bool:
    """Whether a class, id or role name is one of what is not the article."""
    found = _judged.get(name)
    if found is None:
        if len(_judged) > 10_000:
            _judged.clear()
        found = _judged[name] = FURNITURE_NAME.fullmatch(name) is not None
    return found


class Node:
    """An element: signature (tag and first class), children in order, texts as plain strings.

    ``out`` elements give no text. ``soft`` ones are out by name, or as a form, and come back if they
    turn out to wrap the article.
    """

    __slots__ = ("kids", "out", "sig", "soft", "tag")

    def __init__(self, tag: str, sig: str, out: bool = False, soft: bool = False):
        self.tag, self.sig, self.out, self.soft, self.kids = tag, sig, out, soft, []


class _Tree(HTMLParser):
    """Builds a forgiving element tree: end tags may be missing, extra or cut off.

    ``open`` counts the open elements of each tag, so a tag costs no walk over the open elements unless
    it closes some of them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", "#")
        self.stack = [self.root]
        self.open: Counter = Counter()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def _close(self, i: int) -> None:
        for node in self.stack[i:]:
            self.open[node.tag] -= 1
        del self.stack[i:]

    def _open_p(self) -> int:
        if self.open["p"] > 0:
            for i in range(len(self.stack) - 1, 0, -1):
                tag = self.stack[i].tag
                if tag == "p":
                    return i
                if tag in BLOCK or tag == "button":
                    return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and (i := self._open_p()):
            self._close(i)
        if tag in SAME_LEVEL and any(self.open[t] > 0 for t in SAME_LEVEL[tag]):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in SAME_LEVEL[tag]:
                    self._close(i)
                    break
                if self.stack[i].tag in LISTS:
                    break
        names, soft, hard = [], tag == "form", tag in LEFT_OUT or (tag == "header" and self.open["article"] + self.open["main"] <= 0)
        if attrs:
            a = {k: v or "" for k, v in attrs}
            names = (a.get("class", "") + " " + a.get("id", "")).lower().split()
            soft = soft or (tag not in ("html", "body", "main") and any(map(is_furniture, names + a.get("role", "").lower().split())))
            hard = hard or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        node = Node(tag, f"{tag}.{names[0]}" if names else tag, hard or soft, soft and not hard)
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "script"):  # XML style of a foreign element
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if self.open[tag] <= 0:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                return
            if tag in ("p", "b", "i", "a", "em", "strong", "span", "u") and self.stack[i].tag in BLOCK and self.stack[i].tag != tag:
                return

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


def _take_back_wrappers(root: Node) -> None:
    """Soft elements round all articles of a page, or a form round most of its text, are no furniture."""
    holders, visible = [], False
    todo: list = [(root, None)]
    while todo:
        node, above = todo.pop()
        if node.out and not node.soft:
            continue
        if node.soft:
            above = (node, above)
        elif node.tag in ("article", "main"):
            visible |= above is None
            while above is not None:
                holders.append(above[0])
                above = above[1]
            continue
        todo.extend((k, above) for k in node.kids if not isinstance(k, str))
    if visible:
        return
    for node in holders:
        node.out = False
    if holders:
        return
    mass: dict[int, int] = {}
    forms: dict[int, Node] = {}
    todo = [(root, None)]
    while todo:
        node, form = todo.pop()
        if node.out and node.tag != "form":
            continue
        if node.tag == "form" and node.out and form is None:
            form = id(node)
            forms[form] = node
        mass[form] = mass.get(form, 0) + sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        todo.extend((k, form) for k in node.kids if not isinstance(k, str))
    for key, node in forms.items():
        node.out = 2 * mass[key] <= sum(mass.values())


def parse(html: str | None) -> Node:
    """Element tree of a page."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    _take_back_wrappers(tree.root)
    return tree.root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node in page order, white space made single spaces."""
    done, now = [], []

    def end():
        text = SPACE.sub(" ", "".join(now)).strip(" ")
        now.clear()
        if text:
            done.append(text)

    todo: list = [node]
    while todo:  # a stack, as nesting may be deep
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not (x.out and x is not node):
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.kids))
    end()
    return done


class Page:
    """Blocks of a page in order, and the sections that they lie in.

    ``blocks`` are (place and text, text, inside, section, whether a heading): the place is a hash of the signatures from the
    root to the block; ``section`` is the nearest element strictly inside the content that is more than a piece of text,
    -1 for none. ``parents`` are the sections around sections, which come first.
    """

    #: Up to so many words a template block inside the content is taken as a heading, label or formula of the articles.
    LABEL, FORMULA = 3, 12

    def __init__(self):
        self.blocks: list[tuple[str, str, bool, int, bool]] = []
        self.parents: list[int] = []

    def without(self, template, inside: bool) -> list[str]:
        """Texts that are not template. Inside the content a template block goes with its whole section, if every block of that is
        template and one is more than a heading or label; or alone, if it is a passage. Headings, labels and short formulas
        that stand among varying text stay."""
        if not template:
            return [t for _, t, *_ in self.blocks]
        known = [_digest(place) in template for place, *_ in self.blocks]
        varies, says = [False] * len(self.parents), [False] * len(self.parents)
        for (_, text, _, section, heading), k in zip(self.blocks, known):
            for flags, up in ((varies, not k), (says, not heading and text.count(" ") >= self.LABEL)):
                s = section
                while up and s >= 0 and not flags[s]:
                    flags[s] = True
                    s = self.parents[s]
        gone: list[bool] = []
        for s, parent in enumerate(self.parents):
            gone.append(inside and not varies[s] and (says[s] or (parent >= 0 and gone[parent])))

        def goes(text: str, within: bool, section: int, heading: bool) -> bool:
            passage = inside and not heading and text.count(" ") >= self.FORMULA
            return not within or passage or (section >= 0 and gone[section])

        return [t for (_, t, *where), k in zip(self.blocks, known) if not (k and goes(t, *where))]


def parts(tree: Node, inner: set[int]) -> Page:
    """The blocks of a page; ``inner`` are the ids of its content nodes."""
    page, now, at = Page(), [], [("", False, -1, False)]

    def end():
        text = SPACE.sub(" ", "".join(now)).strip(" ")
        now.clear()
        if text:
            page.blocks.append((f"{at[-1][0]} {text}", text, *at[-1][1:]))

    todo: list = [tree]
    while todo:  # a stack, as nesting may be deep
        x = todo.pop()
        if x is None:
            end()
            at.pop()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.out:
            if x.tag in BLOCK:
                end()
                place, within, section, _ = at[-1]
                if within and x.tag not in TEXT_LEVEL:
                    page.parents.append(section)
                    section = len(page.parents) - 1
                at.append((xxhash.xxh64_hexdigest(f"{place}/{x.sig}"), within or id(x) in inner, section, x.tag in HEADINGS))
                todo.append(None)
            todo.extend(reversed(x.kids))
    end()
    return page


class _Fold:
    """A node of the aligned tree: runs of equal siblings are one node."""

    __slots__ = ("kids", "out", "sig", "texts")

    def __init__(self, node: Node):
        self.sig, self.out, self.texts, self.kids = node.sig, node.out, (), []


def _folded(tree: Node) -> tuple[_Fold, list[_Fold]]:
    """The folded tree and its nodes, parents first."""
    top = _Fold(tree)
    todo, made = [(top, [tree])], []
    while todo:
        fold, nodes = todo.pop()
        made.append(fold)
        own, runs = [], []
        for x in (k for node in nodes for k in node.kids):
            if isinstance(x, str):
                if t := SPACE.sub(" ", x).strip(" "):
                    own.append(t)
            elif runs and runs[-1][0].sig == x.sig and runs[-1][0].out == x.out:
                runs[-1].append(x)
            else:
                runs.append([x])
        fold.texts = tuple(own)
        fold.kids = [_Fold(run[0]) for run in runs]
        todo.extend(zip(fold.kids, runs))
    return top, made


def tree_match(a: _Fold, b: _Fold) -> tuple[int, list]:
    """Simple tree matching: size of the largest order-preserving match and its node pairs."""
    if a.sig != b.sig:
        return 0, []
    todo, met = [(a, b)], []
    while todo:  # pairs of children are met after their parents, so they are sized before them
        x, y = todo.pop()
        met.append((x, y))
        todo.extend((k, j) for k in x.kids for j in y.kids if k.sig == j.sig)
    tables: dict = {}
    for x, y in reversed(met):
        m, n = len(x.kids), len(y.kids)
        size = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                inner = tables.get((id(x.kids[i]), id(y.kids[j])))
                size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + (inner[-1][-1] + 1 if inner else 0))
        tables[id(x), id(y)] = size
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        size, i, j = tables[id(x), id(y)], len(x.kids), len(y.kids)
        while i and j:
            inner = tables.get((id(x.kids[i - 1]), id(y.kids[j - 1])))
            if inner and size[i][j] == size[i - 1][j - 1] + inner[-1][-1] + 1:
                todo.append((x.kids[i - 1], y.kids[j - 1]))
                i, j = i - 1, j - 1
            elif size[i][j] == size[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return tables[id(a), id(b)][-1][-1] + 1, pairs


def induce(pages: list[str | None]) -> dict:
    """Wrapper of a host from some of its pages: ``path`` to the content."""
    folded = [_folded(parse(h)) for h in dict.fromkeys(pages)]
    (first, nodes), slot = folded[0], {}
    for other, _ in folded[1:]:
        for a, b in tree_match(first, other)[1]:
            if a.texts != b.texts:
                slot[id(a)] = slot.get(id(a), 0) + max(sum(map(len, a.texts)), sum(map(len, b.texts)))
    mass: dict[int, int] = {}  # varying text under a node that is not furniture
    for x in reversed(nodes):
        own = slot.get(id(x), 0) if len(folded) > 1 else sum(map(len, x.texts))
        mass[id(x)] = 0 if x.out else own + sum(mass[id(k)] for k in x.kids)

    path, now = [], first
    while True:
        best = max(now.kids, key=lambda k: mass[id(k)], default=None)
        tag = best.sig.split(".")[0] if best else ""
        if best is None or tag in TEXT_LEVEL or 10 * mass[id(best)] < 6 * mass[id(now)] or mass[id(best)] == 0 or tag not in BLOCK:
            break
        path.append(best.sig)
        now = best
        if tag in ("article", "main"):
            break
    return {"path": path}


def _at(tree: Node, path: list[str]) -> list[Node]:
    """All nodes under the path of signatures."""
    found = [tree]
    for sig in path:
        found = [k for node in found for k in node.kids if not isinstance(k, str) and k.sig == sig and not k.out]
    return found if path else []


def _read(html: str, wrapper: dict | None) -> Page:
    tree = parse(html)
    return parts(tree, {id(n) for n in _at(tree, wrapper["path"])} if wrapper else set())


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(html: str | None, wrapper: dict | None) -> str:
    """Main text of one page; ``template`` of a wrapper holds digests of places and texts."""
    if not html:
        return ""
    return " ".join(_read(html, wrapper).without(wrapper["template"] if wrapper else (), bool(wrapper) and wrapper["inside"]))


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, broadcast_hosts: int) -> DataFrame:
    return rows.join(F.broadcast(wrappers) if wrappers.count() <= broadcast_hosts else wrappers, "__host", "left")


def induce_wrappers(pages: DataFrame, sample_pages: int = 8, broadcast_hosts: int = 20_000) -> DataFrame:
    """``__host, wrapper`` (JSON with ``path``) for every host, from distinct pages."""
    keyed = pages.select("__host", "html", F.xxhash64("html").alias("__d"), F.md5("html").alias("__m"))
    order = Window.partitionBy("__host").orderBy("__d", "__m")
    ranked = keyed.select("__host", "__d", "__m").distinct().withColumn("__k", F.row_number().over(order))
    chosen = materialise(ranked.where(F.col("__k") <= sample_pages).drop("__k"))
    chosen = F.broadcast(chosen) if chosen.count() <= sample_pages * broadcast_hosts else chosen
    picked = keyed.join(chosen, ["__host", "__d", "__m"]).groupBy("__host", "__d", "__m").agg(F.first("html").alias("html"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__d", "__m"])
        return pd.DataFrame({"__host": [frame["__host"].iloc[0]], "wrapper": [json.dumps(induce(frame["html"].tolist()))]})

    return picked.groupBy("__host").applyInPandas(fit, "__host string, wrapper string")


def count_template(rows: DataFrame, wrappers: DataFrame, broadcast_hosts: int) -> DataFrame:
    """``__host, wrapper`` with ``template``, counted over all pages of each host, and ``inside``: whether
    template inside the content is left out too."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            hosts, contents, made = [], [], []
            for host, html, wrapper in zip(frame["__host"], frame["html"], frame["wrapper"]):
                page = _read(html, json.loads(wrapper)).blocks
                content = [t for _, t, inside, *_ in page if inside]
                if content:
                    found = {None: (sum(map(len, content)), True)} | {_digest(place): (len(t), inside) for place, t, inside, *_ in page}
                    hosts += [host] * len(found)
                    contents += [_digest("\n".join(content))] * len(found)
                    made += [(block, *facts) for block, facts in found.items()]
            if not made:
                continue
            blocks_, sizes, insides = zip(*made)
            columns = {"block": pd.array(blocks_, dtype="Int64"), "size": pd.array(sizes, dtype="int64"), "inside": pd.array(insides, dtype="bool")}
            yield pd.DataFrame({"__host": hosts, "content": pd.array(contents, dtype="int64")} | columns)

    held = _with_wrappers(rows, wrappers, broadcast_hosts).select("__host", "html", "wrapper").where("wrapper IS NOT NULL")
    seen = held.mapInPandas(emit, "__host string, content long, block long, size long, inside boolean").distinct()
    sums = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass"), F.max("inside").alias("inside")]
    counts = materialise(seen.groupBy("__host", "block").agg(*sums).where("n >= 2 OR block IS NULL"))
    pages = counts.where("block IS NULL").select("__host", F.col("n").alias("pages"), F.col("mass").alias("whole"))
    common = counts.where("block IS NOT NULL").join(pages, "__host").where("2 * n > pages")
    # each template block stands on over half of the pages, so a page's length bounds the list
    template = common.groupBy("__host").agg(
        F.to_json(F.sort_array(F.collect_list("block"))).alias("template"),
        (2 * F.coalesce(F.sum(F.when(F.col("inside"), F.col("mass"))), F.lit(0)) <= F.first("whole")).alias("inside"),
    )
    made = [F.expr("left(wrapper, length(wrapper) - 1)"), F.lit(', "inside": '), F.coalesce("inside", F.lit(True)).cast("string")]
    made += [F.lit(', "template": '), F.coalesce("template", F.lit("[]")), F.lit("}")]
    return wrappers.join(template, "__host", "left").select("__host", F.concat(*made).alias("wrapper"))


def main_text(pages: DataFrame, sample_pages: int = 8, broadcast_hosts: int = 20_000) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    The wrappers of up to ``broadcast_hosts`` hosts are broadcast; more are joined by a shuffle.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("__host"))
    paths = materialise(induce_wrappers(rows, sample_pages, broadcast_hosts))
    wrappers = materialise(count_template(rows, paths, broadcast_hosts))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, dict] = {}
        for frame in batches:
            texts = []
            for html, wrapper in zip(frame["html"], frame["wrapper"]):
                if wrapper and wrapper not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[wrapper] = json.loads(wrapper)
                    read[wrapper]["template"] = set(read[wrapper]["template"])
                texts.append(extract(html, read.get(wrapper)))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # ids as strings: pandas would turn whole numbers beside a null into doubles
    joined = _with_wrappers(rows, wrappers, broadcast_hosts).select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "html", "wrapper")
    read_ = joined.mapInPandas(apply, "page_id string, url string, text string, n_chars long")
    return read_.withColumn("page_id", F.col("page_id").cast("long"))


def op9_wrapper_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
