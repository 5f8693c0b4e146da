"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: an element node stands for all elements with the same
path of tags and classes on that host, and it keeps in how many pages it occurs and which contents
it has there. A node's importance is the entropy of its contents over the pages: text that comes
again and again has little, text of its own on every page has much. A presentation node takes the
importance of its parts. Each page then drops those contents of nodes of low importance that come again
over the pages; what is its own stays. Pages are counted, not blocks, and copies of a page count once.

Structure alone tells some branches apart that no count can: scripts, styles, forms and the like hold
no text to read, and navigation, headers of a page, footers, asides, adverts and comments are no part
of an article whatever their entropy. Where a page has an ``article`` or ``main`` element, that is
the place to look; the tree then judges the branches in it. An element whose id or role says that it is the
content comes before articles outside of it, as teasers are, unless it has an article itself.
Branches left out by a name, or as a form, are a guess: of a page with no text but in such branches, what lies in
the fewest of them is its text.

Pages are parsed once. Contents are summed up by (host, path, hash), so a host with a third of all
pages is spread over its contents; only its repeated contents come back to the pages, by a join that Spark
broadcasts where their table is small and splits by host where it is not.

Edge cases: null html is empty and gives an empty text; null urls share one unnamed host; markup that
is not closed, or cut off, is read as browsers do; hosts with few pages have no statistics, so only
structure decides; repeated rows each give a text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Set
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgauge.llm.shared import keep

#: Elements by what HTML has them for (fixed values).
IN_HEAD = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset(
    "head script style template noscript iframe svg math canvas object audio video form button select "
    "option textarea input nav aside footer menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot body html legend summary".split())
#: Elements in which a slash at the end of a tag closes it.
FOREIGN = ("svg", "math")
LISTS = frozenset("ul ol".split())
TABLE = frozenset("table caption tbody thead tfoot tr td th".split())
#: Elements that an end tag from inside them does not look beyond.
SCOPE = frozenset("table caption td th object template".split())
_LIST_STOP = frozenset("ul ol dl table tbody thead tfoot tr td th caption select".split())
#: What the start of an element ends, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, _LIST_STOP), "dt": ({"dt", "dd"}, _LIST_STOP), "dd": ({"dt", "dd"}, _LIST_STOP),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, TABLE - {"td", "th", "caption"}),
    "th": ({"td", "th", "caption"}, TABLE - {"td", "th", "caption"}),
    "tr": ({"tr", "caption"}, TABLE - {"tr", "td", "th", "caption"}),
} | dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}))
#: Names in class, id or role of branches beside the article; compounds count by their last word.
BESIDE = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo related "
    "share sharing sidebar social sponsor sponsored subscribe toolbar".split())
#: Names that say so as a whole only: page builders call every part of an article some kind of widget.
BESIDE_WHOLE = frozenset("widget widgets".split())
#: Roles of what stands beside an article, but within it is a part of it.
ROLES_OF_PAGES = frozenset("banner".split())
#: Ids and roles of the element with the article.
CONTENT = frozenset("content main main-content maincontent page-content".split())
#: A node whose contents and presentation both have less than this share of the most entropy is noise.
LEAST_IMPORTANCE = 0.2
#: Pages of a host that a node has to be in before its entropy says anything.
LEAST_PAGES = 8
#: Pages that a task reads together.
ROWS = 500


#: What a cut-off page may end with.
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


#: Words that make a compound say what else is on the page, as in has-sidebar.
_SAYS_OF = frozenset("has have with without no not hide hides show shows".split())


def _is_beside(name: str) -> bool:
    """Whether a name of a class, id or role is that of a branch beside the article."""
    if name.lower() in BESIDE_WHOLE:
        return True
    words = [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]
    while len(words) > 1 and words[-1][0].isdigit():  # ad-1, ad-300x250
        words.pop()
    return bool(words) and words[-1] in BESIDE and not _SAYS_OF.intersection(words[:-1])


#: What a block is in.
ANYWHERE, ARTICLE, BY_NAME = range(3)


def _path(parent: int, label: str) -> int:
    """A path as a hash, so that deep pages take no more memory for each element than flat ones."""
    key = parent.to_bytes(8, "little", signed=True) + label.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


class _Node:
    __slots__ = ("children", "no_text", "out", "path", "parent", "place", "tag")

    def __init__(self, tag: str, path: int, parent: _Node | None, no_text: bool = False, out: bool = False):
        self.tag, self.path, self.parent = tag, path, parent
        self.no_text = no_text  # in an element that never holds article text
        self.out = out  # left out with its branch, unless an article comes to light in it
        self.place = ANYWHERE
        self.children: list[_Node | str] = []


class _Builder(HTMLParser):
    """A tree of the page without the branches that hold no article text.

    Elements of such branches are opened and closed like all others, marked as left out, so that a
    branch ends where a browser ends it. A mark by name or on a form is taken back where a main or article
    element begins in the branch.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", 0, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag == "head" and tag not in IN_HEAD:
            self.at = self.at.parent
        if tag in CLOSES_P:
            self._close({"p"}, BLOCK - {"p"})
        if tag in ENDS:
            while self._close(*ENDS[tag]):
                pass
        if tag in VOID:
            if not self.at.no_text:
                if tag in BLOCK:
                    self.at.children.append(_Node(tag, self.at.path, self.at))
                elif tag == "br":
                    self.at.children.append(" ")
            return
        given = dict(attrs)
        label = f"{tag}.{given['class']}" if given.get("class") else tag
        no_text = (self.at.no_text or "hidden" in given or tag in NO_TEXT and tag != "form"
                   or tag == "label" and self._inside(("form",)))
        node = _Node(tag, _path(self.at.path, label), self.at, no_text, self._left_out(tag, given))
        if not no_text:
            self.at.children.append(node)
            if tag in ("article", "main"):
                node.place = ARTICLE
                self._open_up(node)
            elif tag in BLOCK and CONTENT.intersection(
                    (given.get(x) or "").lower() for x in ("id", "role")) and not self._inside(("article",)):
                node.place = BY_NAME
        self.at = node

    def _left_out(self, tag: str, given: dict[str, str | None]) -> bool:
        if tag in ("html", "body", "main", "article"):
            return False
        roles = (given.get("role") or "").lower().split()
        if tag == "form" or any(_is_beside(n) for x in ("class", "id") for n in (given.get(x) or "").split()):
            return True
        if any(_is_beside(n) for n in roles if n not in ROLES_OF_PAGES):
            return True
        return (tag == "header" or not ROLES_OF_PAGES.isdisjoint(roles)) and not self._inside(("article", "main"))

    def _open_up(self, node: _Node | None) -> None:
        """Takes the marks of the branches around an article back."""
        while node is not None:
            node.out = False
            if node.place == BY_NAME:
                node.place = ANYWHERE
            node = node.parent

    def _inside(self, tags: tuple[str, ...]) -> bool:
        node: _Node | None = self.at
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def _close(self, tags: Set[str], stop: Set[str]) -> bool:
        """Closes the nearest open element of ``tags``, unless one of ``stop`` lies before it."""
        node: _Node | None = self.at
        while node is not None and node.tag not in tags:
            if node.tag in stop:
                return False
            node = node.parent
        if node is None or node.parent is None:
            return False
        self.at = node.parent
        return True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in FOREIGN and not self._inside(FOREIGN):  # there the slash closes the element
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("article", "main", "body", "html"):
            stop: Set[str] = frozenset()
        elif tag in TABLE:
            stop = {"table"} - {tag}
        elif tag in BLOCK or tag in NO_TEXT:
            stop = LISTS.union(SCOPE) if tag == "li" else SCOPE
        else:
            stop = BLOCK
        self._close({tag}, stop)

    def handle_data(self, data: str) -> None:
        if not self.at.no_text:
            self.at.children.append(data)


def blocks(html: str | None) -> list[dict]:
    """path, text, style (its inline marks) and whether inside the place of the article, of each
    block with text, in page order; and whether its path, its text there and its style there are the
    page's first. Of blocks in left-out branches only where there are no others, those in the fewest."""
    parser = _Builder()
    parser.feed(_CUT_OFF.sub("", html or ""))
    parser.close()
    found: list[dict] = []
    parts: list[str] = []
    marks: list[str] = []
    begun: list[dict] = []

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(begun[0] | {"text": text, "style": " ".join(marks)})
        parts.clear()
        marks.clear()
        begun.clear()

    def walk(left_out: bool) -> None:
        # Depth first without recursion: pages may be nested deeply.
        stack: list[tuple[_Node, int, int, int]] = [(parser.root, 0, ANYWHERE, 0)]
        while stack:
            node, i, place, outs = stack.pop()
            apart = node.tag in BLOCK or node.out
            if i == 0 and apart:
                end_block()
            if i == len(node.children):
                if apart:
                    end_block()
                continue
            stack.append((node, i + 1, place, outs))
            child = node.children[i]
            if isinstance(child, str):
                if not begun and child.strip():
                    begun.append({"path": _block_path(node), "place": place, "outs": outs})
                parts.append(child)
            elif left_out or not child.out:
                if child.tag not in BLOCK:
                    marks.append(child.tag)
                stack.append((child, 0, max(place, child.place), outs + child.out))
        end_block()

    walk(False)
    if not found:
        walk(True)
        fewest = min((block["outs"] for block in found), default=0)
        found = [block for block in found if block["outs"] == fewest]
    best = max((block["place"] for block in found), default=ANYWHERE)
    for block in found:
        del block["outs"]
        block["inside"] = block.pop("place") == best != ANYWHERE
    met: set[tuple] = set()
    for block in found:
        for name, key in (("new_path", (block["path"],)), ("new_text", ("text", block["path"], block["text"])),
                          ("new_style", ("style", block["path"], block["style"]))):
            block[name] = key not in met
            met.add(key)
    return found


def _block_path(node: _Node) -> int:
    """The path of the block that a text is in: inline marks do not tell styles apart."""
    while node.parent is not None and node.tag not in BLOCK:
        node = node.parent
    return node.path


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)),
                      F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks) of each page; a block has what ``blocks`` gives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [blocks(html.as_py()) for html in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("page_id", "url", "host")), pa.array(found, kind)],
                    ["page_id", "url", "host", "blocks"])

    kind = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.string()), ("text", pa.string()),
                               ("inside", pa.bool_()), ("new_path", pa.bool_()), ("new_text", pa.bool_()),
                               ("new_style", pa.bool_())]))
    own = pages.select("page_id", "url", _host("url").alias("host"), "html")
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(read, f"page_id {types['page_id']}, url {types['url']}, host string, "
                                "blocks array<struct<path bigint, style string, text string, inside boolean, "
                                "new_path boolean, new_text boolean, new_style boolean>>")


def _importance(n: Column, total: Column) -> Column:
    """How little a value that is in n pages repeats: 1 where it is its page's own, near 0 where it is in all."""
    return 1 - F.log(n.cast("double")) / F.log(total.cast("double"))


def _entropy(counts: DataFrame) -> DataFrame:
    """(host, path, total, importance): the entropy of a node's values over the pages, as a share of
    what as many different values would have."""
    return counts.groupBy("host", "path").agg(
        F.sum("n").alias("total"), F.sum("pages").alias("pages"),
        F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"),
    ).where(F.col("pages") >= LEAST_PAGES).select(
        "host", "path", "total",
        (1 - F.col("s") / (F.col("total") * F.log(F.col("total").cast("double")))).alias("importance"))


def _pages_with(nodes: DataFrame, value: str, new: str) -> DataFrame:
    """(host, path, value, n, pages): the pages that have the value at the path; ``pages`` counts each
    page with the path at one of its values."""
    return nodes.groupBy("host", "path", value).agg(
        F.count_if(new).alias("n"), F.count_if("new_path").alias("pages"))


def _nodes(trees: DataFrame) -> DataFrame:
    """(host, path, content, style, new_path, new_text, new_style) of the blocks of all different pages:
    copies of a page say nothing about what different pages have in common."""
    return trees.select("host", F.transform("blocks", lambda b: F.struct(
        F.xxhash64(b["path"]).alias("path"), F.xxhash64(b["path"], b["text"]).alias("content"),
        F.xxhash64(b["style"]).alias("style"), b["new_path"].alias("new_path"), b["new_text"].alias("new_text"),
        b["new_style"].alias("new_style"))).alias("page")).distinct().select("host", F.inline("page"))


def style_tree(trees: DataFrame) -> DataFrame:
    """(host, path, total, content, presentation) of each node on enough pages: the importance of its
    contents, and of the ways in which it presents them."""
    nodes = _nodes(trees)
    content = _entropy(_pages_with(nodes, "content", "new_text"))
    style = _entropy(_pages_with(nodes, "style", "new_style")).drop("total")
    return content.withColumnRenamed("importance", "content").join(
        style.withColumnRenamed("importance", "presentation"), ["host", "path"])


def repeated(trees: DataFrame, least: float) -> DataFrame:
    """(host, content) of what goes: contents of noisy nodes that themselves come again on so many
    pages that they have little importance. Of a node there are few, total ** least at most."""
    noisy = style_tree(trees).where(F.greatest("content", "presentation") < least).select("host", "path", "total")
    # No content in fewer pages can pass, so contents of a page's own do not gather at their path.
    often = _pages_with(_nodes(trees), "content", "new_text").where(F.col("n") > LEAST_PAGES ** (1 - least))
    return often.join(noisy, ["host", "path"]).where(
        _importance(F.col("n"), F.col("total")) < least).select("host", "content")


def main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url and the text of each page's blocks that have importance, in page order.

    A page of which nothing would be left keeps its blocks: all its host's pages are alike, and there
    is nothing to tell the article from the rest.
    """
    trees = keep(parsed(pages), "pages-parsed")
    noise = keep(
        repeated(trees, least).groupBy("host").agg(F.collect_set("content").alias("noise")),  # of one site's style
        "pages-noise",
    )
    inside = F.filter("blocks", lambda b: b["inside"])
    placed = trees.withColumn("blocks", F.when(F.size(inside) > 0, inside).otherwise(F.col("blocks")))
    judged = placed.join(noise, "host", "left").withColumn(
        "left", F.filter("blocks", lambda b: ~F.array_contains(
            F.coalesce("noise", F.array().cast("array<bigint>")), F.xxhash64(b["path"], b["text"]))))
    chosen = F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("blocks"))
    return judged.select(
        "page_id", "url", F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n").alias("text"))


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
