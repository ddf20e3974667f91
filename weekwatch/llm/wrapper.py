"""Main text of web pages by wrapper induction over the pages of a host.

A page is read into a tree of its block elements, labelled by tag, classes, id and role; siblings of one label are
folded into one node, so that lists and runs of paragraphs are one slot. The trees of a host are aligned by
simple tree matching and merged into its wrapper; what does not match is inserted where it stood. Each page
tree is aligned with the wrapper, which tells the slots of different pages that are the same. Slots whose text
is the same on nearly all pages of the host are template. Slots that vary are content, but for
those in menus, headers, footers, sidebars, notices, adverts, forms or comments by their label, and those
that are links throughout. Where a page marks its article, content is what lies in it.

A host is merged in bounded groups of distinct trees, again until one is left, so a host with a third of
all pages is spread like any other; texts are counted, never gathered.

Defined cases: a null html is empty and gives an empty text; pages with a null url form a host; hosts with fewer
than `least` pages of different text have no template texts, their labels decide alone; pages with the same tree
and the same texts in all its slots count once for the template. An empty table gives no row. Only page_id, url and html are read, so other columns cannot
clash.
"""

from __future__ import annotations

import html as html_entities
import re
import sys
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store
from weekwatch.session import cut_lineage

CONSTANT_SHARE, LEAST_PAGES, MERGE_TREES = 0.8, 10, 400
LINKS, LINKS_IN_ARTICLE = 0.5, 0.9
SMALL_TABLE = 16 << 20

BLOCKS = frozenset(
    "html head body address article aside blockquote button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr iframe legend li main menu nav noscript object ol optgroup option p pre search section "
    "select summary svg table tbody td template textarea tfoot th thead title tr ul video audio math".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = BLOCKS - {"html", "head", "body", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "title", "template", "noscript", "iframe", "object", "svg", "canvas", "video", "audio", "math"}
HOLDS_P = frozenset({"td", "th", "button", "caption", "table"})
#: An opening tag ends open elements of these tags, up to the tags that hold them in.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Elements that never hold main text.
DROPPED_TAGS = frozenset("head title nav footer aside form script style noscript button select option optgroup textarea iframe svg template dialog menu search fieldset object canvas video audio".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of classes and ids that name what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement adslot banner sponsor sponsored promo promotion sidebar aside nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead topbar header comment comments commentlist reply replies respond disqus notice notices alert cookie cookies consent gdpr popup "
    "modal overlay newsletter subscribe subscription signup login search share sharing social related recommended pagination pager toolbar "
    "widget skip hidden paywall teaser".split()
)
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)", re.S)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A slot of a page: a block element with all its siblings of the same label."""

    __slots__ = ("children", "label")

    def __init__(self, label: str, children: list[Node] | None = None):
        self.label, self.children = label, children or []

    def child(self, label: str) -> Node:
        """The child of that label, made if it is not there."""
        for c in self.children:
            if c.label == label:
                return c
        c = Node(label)
        self.children.append(c)
        return c


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def ascii_lower(text: str) -> str:
    """Same length, capitals A-Z lowered."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _label(tag: str, attributes: str) -> str:
    """tag.class#id@role, digits as 0; `!` marks an element that is not shown."""
    if not attributes or attributes == "/":
        return tag
    out, found = tag, {}
    for m in _ATTRIBUTE.finditer(attributes):
        if m[5]:
            found.setdefault(m[5].lower(), "")
        else:
            found.setdefault(m[1].lower(), next((v for v in m.group(2, 3, 4) if v is not None), ""))
    for name, mark in (("class", "."), ("id", "#"), ("role", "@")):
        if found.get(name):
            out += mark + re.sub(r"\d+", "0", re.sub(r"[(),]", "_", " ".join(sorted(html_entities.unescape(found[name]).lower().split()))))
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        out += "!"
    return out


def parse(text: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The folded tree, and its blocks of text in page order: (slot, text, characters in links)."""
    root, blocks = Node("#page"), []
    stack: list[tuple[str, Node]] = [("", root)]
    pieces: list[str] = []
    link_pieces: list[str] = []
    in_link = False

    def flush() -> None:
        if pieces:
            block = " ".join("".join(pieces).split())
            if block:
                blocks.append((stack[-1][1], block, len(" ".join("".join(link_pieces).split()))))
            pieces.clear()
            link_pieces.clear()

    def add(raw: str) -> None:
        if raw:
            t = html_entities.unescape(raw) if "&" in raw else raw
            pieces.append(t)
            if in_link:
                link_pieces.append(t)

    def innermost(wanted, held=frozenset()) -> int:
        """Depth of the innermost open element of the wanted tags, 0 if one of `held` stands before it."""
        for d in range(len(stack) - 1, 0, -1):
            if stack[d][0] in wanted:
                return d
            if stack[d][0] in held:
                break
        return 0

    at, n, lower = 0, len(text), None
    while at < n:
        start = text.find("<", at)
        if start < 0:
            add(text[at:])
            break
        add(text[at:start])
        m = _TOKEN.match(text, start)
        if m is None:  # a bare less-than sign
            pieces.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:-3])
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            pieces.append(" ")
        elif tag in RAW and not closing:
            # text up to the closing tag, whatever it looks like; none of it is shown
            lower = ascii_lower(text) if lower is None else lower
            end = lower.find(f"</{tag}", at)
            close = text.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
        elif tag not in BLOCKS:
            continue
        elif closing:
            flush()
            d = innermost({tag})
            if d:
                del stack[d:]
                in_link = False
        else:
            flush()
            ended = [innermost({"p"}, HOLDS_P)] if tag in CLOSES_P else []
            if tag in ENDS:
                tags, held = ENDS[tag]
                while d := innermost(tags, held):
                    del stack[d:]
            ended = [d for d in ended if 0 < d < len(stack)]
            if ended:
                del stack[ended[0] :]
            if tag not in VOID:
                stack.append((tag, stack[-1][1].child(_label(tag, attributes))))
            in_link = False
    flush()
    return root, blocks


# --- trees -------------------------------------------------------------------------------------------


def dump(node: Node) -> str:
    return node.label + (f"({','.join(map(dump, node.children))})" if node.children else "")


def load(text: str) -> Node:
    top = Node("")
    stack = [top]
    for label, mark in re.findall(r"([^(),]*)([(),]|$)", text):
        if label:
            stack[-1].children.append(Node(label))
        if mark == "(":
            stack.append(stack[-1].children[-1])
        elif mark == ")":
            stack.pop()
    return top.children[0]


def preorder(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += reversed(x.children)
    return out


class Matching:
    """Simple tree matching: the most nodes that two trees can pair, in order, parents with parents."""

    def __init__(self):
        self.memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def of(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        """Number of pairs, and which children of a and b are paired; (0, []) for different labels."""
        if a.label != b.label:
            return 0, []
        got = self.memo.get((id(a), id(b)))
        if got is None:
            m, n = len(a.children), len(b.children)
            weight = [[self.of(x, y)[0] for y in b.children] for x in a.children]
            best = [[0] * (n + 1) for _ in range(m + 1)]
            for i in range(m):
                for j in range(n):
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
            pairs, i, j = [], m, n
            while i and j:
                if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            got = self.memo[id(a), id(b)] = (1 + best[m][n], pairs[::-1])
        return got


def merge(a: Node, b: Node, matching: Matching | None = None) -> Node:
    """The wrapper of two trees with one root label: pairs become one node, all others stay where they stood."""
    matching = matching or Matching()
    out, i, j = [], 0, 0
    for x, y in [*matching.of(a, b)[1], (len(a.children), len(b.children))]:
        out += a.children[i:x] + b.children[j:y]
        if x < len(a.children):
            out.append(merge(a.children[x], b.children[y], matching))
        i, j = x + 1, y + 1
    return Node(a.label, out)


def align(wrapper: Node, tree: Node) -> dict[int, int]:
    """Place in the wrapper, in preorder, of each place in the tree that matches."""
    matching = Matching()
    place_w, place_t = {id(x): i for i, x in enumerate(preorder(wrapper))}, {id(x): i for i, x in enumerate(preorder(tree))}
    out, todo = {}, [(wrapper, tree)] if wrapper.label == tree.label else []
    while todo:
        w, t = todo.pop()
        out[place_t[id(t)]] = place_w[id(w)]
        todo += [(w.children[x], t.children[y]) for x, y in matching.of(w, t)[1]]
    return out


# --- what a slot is ----------------------------------------------------------------------------------


def _parts(label: str) -> tuple[str, list[str], str]:
    tag = re.match(r"[^.#@!]*", label)[0]
    role = re.search(r"@([a-z ]*)", label)
    return tag, re.split(r"[.# ]+", label[len(tag) :].partition("@")[0].rstrip("!"))[1:], role[1].strip() if role else ""


def is_dropped(label: str, in_article: bool) -> bool:
    """Whether a label names something that is not the article."""
    tag, names, role = _parts(label)
    if label.endswith("!") or tag in DROPPED_TAGS or role in DROPPED_ROLES or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main"):
        return False  # their classes speak of the whole page
    words = {w for x in names for w in _WORD.findall(x)}
    return bool(words & (DROPPED_WORDS - {"header"} if in_article else DROPPED_WORDS))


def judge_slots(tree: Node) -> list[tuple[str, bool, bool]]:
    """(path, allowed, in article) of each slot in preorder."""
    out: list[list] = []
    todo = [(tree, "", False, False)]
    while todo:
        x, path, dropped, article = todo.pop()
        tag, _, role = _parts(x.label)
        dropped = dropped or is_dropped(x.label, article)
        article = article or (not dropped and (tag == "article" or tag == "main" or role == "main"))
        path = f"{path}/{x.label}"
        out.append([path, not dropped, article])
        todo += [(c, path, dropped, article) for c in reversed(x.children)]
    marked = any(allowed and article for _, allowed, article in out)
    return [(path, allowed and (article or not marked), article) for path, allowed, article in out]


# --- pages -------------------------------------------------------------------------------------------

#: What is counted of the blocks stands apart from their texts, so that counting does not read these.
READ = (
    "page_id long, url string, host string, tree string, "
    "blocks array<struct<node:int,hash:long,links:int,chars:int>>, texts array<string>"
)


def _deep(run):
    """Trees can be deep; the functions on them follow their depth."""

    def with_depth(frames):
        sys.setrecursionlimit(1_000_000)
        yield from run(frames)

    return with_depth


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, folded tree, and all blocks with their slots."""

    @_deep
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page_id, url, text in zip(f["page_id"], f["url"], f["html"]):
                url = url if isinstance(url, str) else None
                root, blocks = parse(text if isinstance(text, str) else "")
                place = {id(x): i for i, x in enumerate(preorder(root))}
                out = [(place[id(x)], _hash(t), n, len(t)) for x, t, n in blocks]
                rows.append((None if page_id is None else int(page_id), url, host_of(url), dump(root), out, [t for _, t, _ in blocks]))
            yield pd.DataFrame(rows, columns=["page_id", "url", "host", "tree", "blocks", "texts"])

    cols = [F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*cols).mapInPandas(run, READ)


def induce(trees: DataFrame, group: int = MERGE_TREES) -> DataFrame:
    """(host, tree, n) -> (host, wrapper): merged in groups of at most about `group` trees, again until one is left."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        sys.setrecursionlimit(1_000_000)
        f = f.sort_values(["n", "tree"], ascending=[False, True])
        whole = load(f["tree"].iloc[0])
        for t in f["tree"].iloc[1:]:
            whole = merge(whole, load(t))
        return pd.DataFrame({"host": [f["host"].iloc[0]], "tree": [dump(whole)], "n": [int(f["n"].sum())]})

    while True:
        most = trees.groupBy("host").agg(F.count("*").alias("trees"))
        largest = most.agg(F.max("trees")).first()[0] or 0
        if largest <= 1:
            return trees.select("host", F.col("tree").alias("wrapper"))
        buckets = -(-largest // group)
        dealt = trees.withColumn("deal", F.pmod(F.xxhash64("tree"), F.lit(buckets)))
        trees = cut_lineage(dealt.groupBy("host", "deal").applyInPandas(run, "host string, tree string, n long"))


SLOTS = "host string, tree_id long, node int, slot string, allowed boolean, in_article boolean"


def slots_of(trees: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Each slot of each distinct tree of a host: its slot in the wrapper and what its labels say."""

    @_deep
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for host, tree_id, tree, wrapper in zip(f["host"], f["tree_id"], f["tree"], f["wrapper"]):
                t = load(tree)
                place = align(load(wrapper), t)
                for i, (path, allowed, article) in enumerate(judge_slots(t)):
                    rows.append((host, tree_id, i, str(place[i]) if i in place else path, allowed, article))
            yield pd.DataFrame(rows, columns=["host", "tree_id", "node", "slot", "allowed", "in_article"])

    return trees.join(wrappers, "host").select("host", "tree_id", "tree", "wrapper").mapInPandas(run, SLOTS)


def decisions(pages: DataFrame, slots: DataFrame, least: int = LEAST_PAGES, share: float = CONSTANT_SHARE) -> DataFrame:
    """(host, tree_id, keep, template): slots to keep, and (slot, text hash) pairs that are template."""
    # pages of one tree and the same text in every slot count once; rows of one key are equal, so it does not matter which one stays
    keyed = pages.select("host", "tree_id", "blocks", F.xxhash64("tree_id", "blocks").alias("page_hash"))
    one_each = store(keyed.dropDuplicates(["host", "page_hash"]))
    blocks = one_each.select("host", "tree_id", F.explode(F.array_distinct("blocks")).alias("b")).select("host", "tree_id", "b.*")
    merged = blocks.groupBy("host", "tree_id", "node", "hash", "links", "chars").agg(F.count("*").alias("n"))
    texts = cut_lineage(merged.join(slots, ["host", "tree_id", "node"]).groupBy("host", "slot", "hash").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("links")).alias("links"), F.sum(F.col("n") * F.col("chars")).alias("chars")
    ))
    with_slot = one_each.select("host", "tree_id", F.explode(F.array_distinct(F.col("blocks.node"))).alias("node"))
    with_slot = with_slot.groupBy("host", "tree_id", "node").agg(F.count("*").alias("n")).join(slots, ["host", "tree_id", "node"])
    n_pages = with_slot.groupBy("host", "slot").agg(F.sum("n").alias("n_pages"))
    template = (
        texts.join(n_pages, ["host", "slot"]).where((F.col("n_pages") >= least) & (F.col("n") >= share * F.col("n_pages"))).select("host", "slot", "hash")
    )
    links = texts.groupBy("host", "slot").agg((F.sum("links") / F.sum("chars")).alias("link_share"))
    judged = slots.join(links, ["host", "slot"], "left")
    linked = F.coalesce(F.col("link_share"), F.lit(0.0)) >= F.when(F.col("in_article"), LINKS_IN_ARTICLE).otherwise(LINKS)
    keep = judged.groupBy("host", "tree_id").agg(F.collect_list(F.when(F.col("allowed") & ~linked, F.col("node"))).alias("keep"))
    pairs = slots.where("allowed").join(template, ["host", "slot"]).groupBy("host", "tree_id").agg(F.collect_set(F.struct("node", "hash")).alias("template"))
    return keep.join(pairs, ["host", "tree_id"], "left")


def main_text(pages: DataFrame, least: int = LEAST_PAGES, share: float = CONSTANT_SHARE) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars."""
    read = store(read_pages(pages)).withColumn("tree_id", F.xxhash64("tree"))
    trees = cut_lineage(read.groupBy("host", "tree_id").agg(F.first("tree").alias("tree"), F.count("*").alias("n")))
    wrappers = induce(trees.select("host", "tree", "n"))
    slots = cut_lineage(slots_of(trees, wrappers))
    verdicts = cut_lineage(decisions(read, slots, least, share))
    size = verdicts.agg(F.sum(64 + 8 * F.size("keep") + 24 * F.coalesce(F.size("template"), F.lit(0)))).first()[0] or 0
    # a row for each distinct tree of a host; beyond the bound the join is left to Catalyst
    verdicts = F.broadcast(verdicts) if size <= SMALL_TABLE else verdicts
    joined = read.join(verdicts.select(F.col("host").alias("v_host"), F.col("tree_id").alias("v_tree"), "keep", "template"), (F.col("host") == F.col("v_host")) & (F.col("tree_id") == F.col("v_tree")))

    def is_kept(b) -> Column:
        in_template = F.exists("template", lambda t: (t["node"] == b["node"]) & (t["hash"] == b["hash"]))
        return F.array_contains("keep", b["node"]) & ~F.coalesce(in_template, F.lit(False))

    kept = F.filter("texts", lambda _, i: is_kept(F.get("blocks", i)))
    text = F.array_join(kept, "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("op2_extract_main_text")
def op2(spark, sf_dir):
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
