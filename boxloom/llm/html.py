"""HTML extraction by wrapper induction.

1. Each page is parsed to a tree of block elements (inline markup is transparent); runs of equal siblings are folded, so
   a page's *skeleton* is a small tree and its text blocks sit in numbered nodes of it.
2. The skeletons of a host are merged into the host's wrapper by simple tree matching, ``FAN`` at a time and then the results of
   that, so that no task holds a host. Each skeleton is aligned with the wrapper; its nodes are the wrapper's slots.
3. A text that fills a slot on more than half of the host's different pages (two at least) is a constant node: template.
   A page that repeats another as a whole does not count twice. Slots whose texts vary are content.
4. Regions named as no content (menus, headers, footers, sidebars, notices, adverts, forms, comments) go, whether their texts
   vary or not. Where the name alone is no proof (``WEAK_WORDS``, a header in an article), the wrapper decides: in an article or
   main element a slot that varies is content. A name proves nothing about what holds the article: the page's first article or main element
   opens again what names around it or on it closed (comments, asides, menus and footers apart), words like has-sidebar say what is inside, and
   without an article, a region of its own name with more than half of the page's text is open (comments apart).
5. If a page has an article or main element with content, only what lies within it stays, and there constant nodes stay too:
   the page itself says that they are its text.

Character references are decoded, white space inside a block (no-break space too) becomes one space, blocks are trimmed,
empty blocks go, and blocks are joined by a line feed in page order. A raw element (script, style ...) ends at its own end
tag, whatever it holds; without one it reaches to the end of the page. Nesting may be of any depth.

Defined results: a null or empty page gives an empty text; a page without a host is of the host ''; pages that
repeat stay rows of their own; ties in the alignment go to the first child; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import hot_keys, over_salts, salted, write_table

#: Element names by role, and words of class and id attributes that mark a region as no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
BLOCK = frozenset(
    "html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog menu center "
    "button select option label legend".split()
)
NO_CONTENT = frozenset("head nav header footer aside form menu dialog button select option label legend fieldset".split())
STRONG_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup sidebar signup sponsor "
    "sponsored subscribe toolbar topbar bottombar widget".split()
)
WEAK_WORDS = frozenset(
    "alert aside discussion form header promo promotion rail recommended related replies reply respond search share sharing side "
    "skip social subscription".split()
)
CONTENT_ROLE = frozenset({"article", "main"})
#: Words of readers' comments, and first parts of a class that tell what an element holds or how it is laid out.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
HOLDS = ("has-", "with-", "no-", "without-", "is-")
#: Closed regions that an article or main element inside does not open again.
SHUT = frozenset("aside nav footer menu dialog head".split())
CLOSED_BY = {
    "p": BLOCK - {"button", "select", "option", "label", "legend"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"},
}

#: A text is a constant node of a slot if it fills it on more than this share of the host's different pages.
CONSTANT_SHARE = 0.5
#: Skeletons that one task merges into a wrapper at a time.
FAN = 64
#: Skeletons up to which their slots are broadcast to the pages; pages of one skeleton beyond which they are dealt over tasks.
BROADCAST_SKELETONS, HOT_ROWS = 10_000, 2_000

# a quote opens a value only behind an equals sign
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
#: Kinds of blocks: may be content, named as none by a weak word, named as none.
OPEN, WEAK, CLOSED = 0, 1, 2


def blocks(page: str) -> tuple[list[tuple[int, int, bool, str]], list[tuple[int, str]]]:
    """The text blocks (node, kind, whether in an article, text) in page order, and the folded tree's nodes (parent, label).

    Node 0 is the root. A label is the element's name, marked where its region is named as no content.
    """
    nodes: list[tuple[int, str]] = [(-1, "")]
    child: dict[tuple[int, str], int] = {}
    # name, node, strong and weak regions around, in an article, in a region that stays shut, the outermost region closed by its own name
    stack: list[tuple[str, int, int, int, bool, bool, int]] = [("", 0, 0, 0, False, False, 0)]
    out: list[tuple[int, int, bool, str]] = []
    region: list[int] = []
    text: list[str] = []
    depth: dict[str, int] = {}  # open elements by name
    at, n_regions, article = 0, 0, False

    def flush():
        if text:
            s = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            text.clear()
            if s:
                _, node, strong, weak, main, _, own = stack[-1]
                out.append((node, CLOSED if strong else WEAK if weak else OPEN, main, s))
                region.append(own if strong == 1 else 0)

    def pop():
        depth[stack.pop()[0]] -= 1

    while m := _TAG.search(page, at):
        text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCK:
            continue
        flush()
        if m[1]:
            if depth.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        tokens = [t for a in _ATTR.finditer(m[3]) for t in (a[2] or a[3] or a[4] or "").lower().split()] if m[3] else ()
        words = {w for t in tokens if not t.startswith(HOLDS) for w in re.split(r"[^a-z0-9]+", t)}
        if name in VOID or m[3].endswith("/"):
            continue
        _, parent, strong, weak, main, shut, own = stack[-1]
        comments = not COMMENT_WORDS.isdisjoint(words)
        if name in CONTENT_ROLE and not (article or shut or comments):
            # the page's first article: names on it and around it are no proof
            article, strong, weak, own, words = True, 0, 0, 0, set()
        by_word = name not in ("html", "body")
        is_weak = (name == "header" and main) or (by_word and not WEAK_WORDS.isdisjoint(words))
        is_strong = (name in NO_CONTENT and not (name == "header" and main)) or (by_word and not STRONG_WORDS.isdisjoint(words))
        label = name + ("!" if is_strong else "?" if is_weak else "")
        node = child.get((parent, label))
        if node is None:
            node = child[parent, label] = len(nodes)
            nodes.append((parent, label))
        stays = is_strong and (name in SHUT or comments)
        if is_strong and not strong and not stays and name not in NO_CONTENT - {"form", "fieldset"}:
            n_regions += 1
            own = n_regions
        is_main = main or name in CONTENT_ROLE or (name == "div" and "main" in words)
        stack.append((name, node, strong + is_strong, weak + is_weak, is_main, shut or stays, own))
        depth[name] = depth.get(name, 0) + 1
    text.append(page[at:])
    flush()
    if any(region) and not any(main and kind != CLOSED for _, kind, main, _ in out):
        size = [0] * (n_regions + 1)
        for r, (*_, t) in zip(region, out, strict=True):
            size[r] += len(t)
        most = max(range(1, n_regions + 1), key=size.__getitem__)
        if 2 * size[most] > sum(size):  # a region with most of the page's text is no menu
            out = [(n, OPEN if r == most else k, m, t) for r, (n, k, m, t) in zip(region, out, strict=True)]
    return out, nodes


# ------------------------------------------------------------------ trees: nodes (parent, label), parents first


def skeleton(nodes: list[tuple[int, str]]) -> str:
    return "/".join(f"{p},{label}" for p, label in nodes[1:])


def parse_skeleton(s: str) -> list[tuple[int, str]]:
    return [(-1, "")] + [(int(p), label) for p, label in (x.split(",", 1) for x in s.split("/") if x)]


def _children(nodes: list[tuple[int, str]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, (p, _) in enumerate(nodes):
        if p >= 0:
            out[p].append(i)
    return out


def tree_match(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: (matched nodes, aligned pairs of nodes). Children of aligned nodes are aligned in order, as many
    nodes as possible; ties go to the first. Bottom-up over all pairs of nodes that can meet, without recursion."""
    x, y = _children(a), _children(b)
    level = [(0, 0)]  # pairs that can meet: equal labels below pairs that can meet
    pairs = [(0, 0)]
    while level:
        level = [(i, j) for p, q in level for i in x[p] for j in y[q] if a[i][1] == b[j][1]]
        pairs += level
    weight: dict[tuple[int, int], int] = {}

    def table(p: int, q: int) -> list[list[int]]:
        best = [[0] * (len(y[q]) + 1) for _ in range(len(x[p]) + 1)]
        for i, u in enumerate(x[p], 1):
            for j, v in enumerate(y[q], 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + weight.get((u, v), 0))
        return best

    for p, q in reversed(pairs):
        weight[p, q] = table(p, q)[-1][-1] + 1
    out, todo = [], [(0, 0)]
    while todo:
        p, q = todo.pop()
        out.append((p, q))
        best, i, j = table(p, q), len(x[p]), len(y[q])
        while i and j:
            w = weight.get((x[p][i - 1], y[q][j - 1]), 0)
            if w and best[i][j] == best[i - 1][j - 1] + w:
                todo.append((x[p][i - 1], y[q][j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return weight[0, 0], sorted(out)


def merged(wrapper: list[tuple[int, str]], tree: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The wrapper with the nodes of ``tree`` that it cannot align, each behind the sibling before it. Parents stay first."""
    partner = {j: i for i, j in tree_match(wrapper, tree)[1]}
    kids, nodes = _children(wrapper), list(wrapper)
    below = _children(tree)
    for j in range(len(tree)):
        here, last = partner[j], -1
        for c in below[j]:
            if c in partner:
                last = kids[here].index(partner[c])
            else:
                partner[c] = len(nodes)
                nodes.append((here, tree[c][1]))
                kids.append([])
                last += 1
                kids[here].insert(last, partner[c])
    order, todo, new = [], [0], {}
    while todo:  # numbered anew, parents first, children in order
        n = todo.pop()
        new[n] = len(order)
        order.append((new[nodes[n][0]] if n else -1, nodes[n][1]))
        todo += reversed(kids[n])
    return order


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("kind", pa.int32()), ("main", pa.bool_()), ("text", pa.string())]))


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, skeleton, blocks(node, kind, main, text)."""

    def run(batches):
        for b in batches:
            found = [blocks(page or "") for page in b.column(3).to_pylist()]
            rows = [[{"node": n, "kind": k, "main": i, "text": t} for n, k, i, t in x] for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([skeleton(n) for _, n in found], pa.string()), pa.array(rows, _BLOCKS)], names=["page_id", "url", "host", "skeleton", "blocks"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, host string, skeleton string, blocks array<struct<node:int,kind:int,main:boolean,text:string>>")


def wrappers(skeletons: DataFrame) -> DataFrame:
    """(host, skeleton), distinct, to (host, wrapper): ``FAN`` skeletons at a time are merged, until each host has one."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["skeleton"], key=lambda s: (-len(s), s))
        out = parse_skeleton(names[0])
        for s in names[1:]:
            out = merged(out, parse_skeleton(s))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "skeleton": [skeleton(out)]})

    cur, old = skeletons, []
    while True:
        n = write_table(cur.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "skeleton_counts")
        if n.isEmpty():
            return cur.withColumnRenamed("skeleton", "wrapper")
        parts = cur.join(n, "host", "left").withColumn("part", F.pmod(F.xxhash64("skeleton"), F.coalesce(F.ceil(F.col("n") / FAN), F.lit(1))))
        cur = write_table(parts.groupBy("host", "part").applyInPandas(lambda pdf: merge(pdf), "host string, skeleton string").distinct(), "wrappers", [n, *old])
        old = [cur]


def slots_of(skeletons: DataFrame, wrapper: DataFrame) -> DataFrame:
    """(host, skeleton, slots): the wrapper's slot of each node; -1 where it has none."""

    def run(batches):
        for b in batches:
            out = []
            for s, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = parse_skeleton(s)
                got = dict.fromkeys(range(len(tree)), -1) | {j: i for i, j in tree_match(parse_skeleton(w), tree)[1]}
                out.append([got[j] for j in range(len(tree))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["host", "skeleton", "slots"])

    return skeletons.join(wrapper, "host").select("host", "skeleton", "wrapper").mapInArrow(run, "host string, skeleton string, slots array<int>")


def constants(parsed: DataFrame, slots: DataFrame) -> DataFrame:
    """(host, fixed(slot, h)): the constant nodes of every host's wrapper. A host has fewer than twice the blocks of a page."""
    seen = parsed.select("host", "skeleton", F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("h"))).alias("b"))
    seen = seen.groupBy("host", "skeleton", F.xxhash64(F.transform("b", lambda x: x["h"])).alias("page")).agg(F.first("b").alias("b"))
    distinct = write_table(seen, "distinct_pages")
    pages = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    texts = distinct.select("host", "skeleton", F.explode(F.array_distinct("b")).alias("x")).groupBy("host", "skeleton", "x.node", "x.h").agg(F.count(F.lit(1)).alias("n"))
    by_slot = texts.join(slots, ["host", "skeleton"]).groupBy("host", F.get("slots", F.col("node")).alias("slot"), "h").agg(F.sum("n").alias("n"))
    fixed = by_slot.where("n > 1 AND slot >= 0").join(pages, "host").where(F.col("n") > F.col("pages") * CONSTANT_SHARE)
    return write_table(fixed.groupBy("host").agg(F.collect_set(F.struct("slot", "h")).alias("fixed")), "constants", [distinct])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host, n_blocks, n_template (blocks left out as constant nodes)."""
    parsed = write_table(parse_pages(pages), "parsed")
    skeletons = write_table(parsed.select("host", "skeleton").distinct(), "skeletons")
    wrapper = wrappers(skeletons)
    slots = write_table(slots_of(skeletons, wrapper), "slots")
    known = slots.join(constants(parsed, slots), "host", "left").select(F.xxhash64("host", "skeleton").alias("key"), "host", "skeleton", "slots", "fixed")
    known = write_table(known, "known", [slots])
    rows = parsed.withColumn("key", F.xxhash64("host", "skeleton"))
    # few skeletons travel to the pages; many are joined by key, the pages of a frequent one dealt over several tasks
    if known.count() <= BROADCAST_SKELETONS:
        rows = rows.join(F.broadcast(known), ["key", "host", "skeleton"])
    else:
        hot = write_table(hot_keys(rows.select("key"), "key", HOT_ROWS), "hot_skeletons")
        rows = salted(rows, hot, "key", "page_id").join(over_salts(known, hot, "key").hint("merge"), ["key", "host", "skeleton", "salt"])
    constant = lambda b: F.coalesce(F.array_contains("fixed", F.struct(F.get("slots", b["node"]).alias("slot"), F.xxhash64(b["text"]).alias("h"))), F.lit(False))
    marked = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["main"].alias("main"), b["text"].alias("text"), constant(b).alias("fixed")))
    named = F.filter(marked, lambda b: (b["kind"] == OPEN) | ((b["kind"] == WEAK) & b["main"] & ~b["fixed"]))
    rows = rows.select("page_id", "url", "host", named.alias("named"))
    inner = F.filter("named", lambda b: b["main"])
    rows = rows.withColumn("region", F.when(F.size(inner) > 0, inner).otherwise(F.col("named")))
    rows = rows.withColumn("kept", F.filter("region", lambda b: b["main"] | ~b["fixed"]))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    return rows.select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "host",
        F.size("kept").cast("long").alias("n_blocks"), (F.size("region") - F.size("kept")).cast("long").alias("n_template"),
    )
