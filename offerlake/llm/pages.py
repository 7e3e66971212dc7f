"""Main text of web pages by wrapper induction: same-host pages are aligned, varying slots are content."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .vec import groups

GROUP_BYTES = 4 << 20
CONSTANT = 0.6  # of a host's pages with a slot: so many with one and the same text make it template
MIN_PAGES = 3  # different pages of a host that a slot must be on to be in its template, whatever the host's size
LINKS = 0.5
ON, OFF_BLOCK, OFF_INLINE = range(3)  # how a part of a page is marked up

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object video audio canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option legend summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article section div body html menu".split())
# What names parts of a page that are not its article, and its article.
OFF_TAGS = frozenset("nav footer aside form button select dialog menu head header".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OFF_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|adsense|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|overlay|pager|pagination|popup|promo|promoted|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|toolbar|widget|widgets)(?:$|[\s_\d-])"
)
ON_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story)(?:$|[\s_-])")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Node:
    """A slot of a page: all siblings with one label. ``path`` is a hash of the labels from the root on, "" for the root itself; ``links`` counts characters."""

    label: str
    path: str
    children: dict[str, Node] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    links: int = 0


@dataclass
class Page:
    root: Node
    blocks: list[tuple[Node, str, bool, bool]]  # slot, text, whether in what is marked up as the article, as no part of it


def _below(path: str, label: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(f"{path}>{label}")


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def parse(source: str) -> Page:
    """Slots and text blocks of a page, without inline parts that are marked up as no part of its article."""
    root = Node("", "")
    stack: list[tuple[str, Node, int, bool, bool]] = [("", root, ON, False, False)]  # tag, slot, whether off, on, link
    places: dict[str, list[int]] = {"": []}  # of the open elements of a tag in the stack, and under "" of those of SCOPE
    blocks: list[tuple[Node, str, bool, bool]] = []
    held: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if held:
            said = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if said:
                _, node, off, on, _ = stack[-1]
                node.pieces.append(said)
                node.links += min(linked, len(said))
                blocks.append((node, said, on and off != OFF_BLOCK, off == OFF_BLOCK))
        linked = 0

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def pop_to(k: int) -> None:
        if any(stack[i][0] in BLOCKS for i in range(k, len(stack))):
            close_block()
        while len(stack) > k:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in SCOPE:
                places[""].pop()

    def end_open(tag: str) -> None:
        """Ends the last open element of a tag, unless one of SCOPE was opened since."""
        k = last(tag)
        if k and k >= last(""):
            pop_to(k)

    def say(piece: str) -> None:
        nonlocal linked
        if piece and stack[-1][2] != OFF_INLINE:
            held.append(piece)
            linked += len(piece) if stack[-1][4] else 0

    at, end, ending = 0, len(source), source.rfind(">")
    while at < end:
        # without another sign that ends one there is no tag, and only a comment is left to look for
        m = _TOKEN.search(source, at) if at <= ending else _OPEN_COMMENT.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is _TOKEN else ""
        if not tag:
            continue
        if m[1] or m[4]:
            if last(tag):
                pop_to(last(tag))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = source.find(">", close.end()) + 1 if close and close.end() <= ending else end
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            else:
                say(" " if tag == "br" else "")
            continue
        if tag in ENDS_P:
            end_open("p")
        for other in SAME.get(tag, ()):
            end_open(other)
        raw = m[3] or m[6] or ""
        attributes = _attributes(raw) if raw.strip(" /") else {}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().strip()
        role = attributes.get("role", "").lower()
        _, node, off, on, link = stack[-1]
        starts_on = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody" or bool(names and tag in BLOCKS and tag != "body" and ON_NAMES.search(names))
        # a page's header is no part of its article; the header of an article has its title
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        out = (tag in OFF_TAGS and not (tag == "header" and on)) or role in OFF_ROLES or hidden or (tag not in ("body", "html") and bool(names) and bool(OFF_NAMES.search(names)) and tag not in ("main",))
        if out and not off:
            off = OFF_BLOCK if tag in BLOCKS else OFF_INLINE
        if tag in BLOCKS:
            close_block()
            label = (f"{tag}.{re.sub(r'\d+', '', names)}" if names else tag) + ("~" if off else "")
            child = node.children.get(label)
            if child is None:
                child = node.children[label] = Node(label, _below(node.path, label))
            node = child
        on = on or (starts_on and not out)
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            places[""].append(len(stack))
        stack.append((tag, node, off, on, link or tag == "a"))
    close_block()
    return Page(root, blocks)


def _heaviest(weights: list[int], places: list[int]) -> list[int]:
    """The numbers of the heaviest subsequence whose ``places`` ascend; they are 0 .. n - 1 in some order."""
    n = len(places)
    best = [(0, -1)] * (n + 1)  # a Fenwick tree of the largest sums that end up to a place
    before, ends = [-1] * n, (0, -1)
    for k, (w, place) in enumerate(zip(weights, places, strict=True)):
        sum_, at = (0, -1), place
        while at:
            sum_ = max(sum_, best[at])
            at -= at & -at
        before[k] = sum_[1]
        mine = (sum_[0] + w, k)
        ends = max(ends, mine)
        at = place + 1
        while at <= n:
            best[at] = max(best[at], mine)
            at += at & -at
    out, k = [], ends[1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def simple_tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of the largest order-preserving match of two trees with equal roots, and the matched pairs.

    Children of a slot differ in their labels, so that each can match one other at most, and of those that have one the heaviest
    run in the same order on both sides is taken. Pairs are met from the roots down and weighed from the leaves up, without recursion.
    """
    if a.label != b.label:
        return 0, []
    pairs, under = [(a, b)], []
    for x, y in pairs:  # grows as it goes
        at = {label: k for k, label in enumerate(y.children)}
        met = [(at[label], child) for label, child in x.children.items() if label in at]
        under.append(range(len(pairs), len(pairs) + len(met)))
        pairs += [(child, y.children[child.label]) for _, child in met]
    order = [{label: k for k, label in enumerate(y.children)} for _, y in pairs]
    size, taken = [1] * len(pairs), [[] for _ in pairs]
    for k in range(len(pairs) - 1, -1, -1):
        if under[k]:
            places = [order[k][pairs[c][0].label] for c in under[k]]
            rank = {p: i for i, p in enumerate(sorted(places))}
            taken[k] = [under[k][i] for i in _heaviest([size[c] for c in under[k]], [rank[p] for p in places])]
            size[k] += sum(size[c] for c in taken[k])
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        out.append(pairs[k])
        todo += taken[k]
    return size[0], out


def template_tree(slots: list[dict]) -> Node:
    """The host's tree, slots in the order in which pages have them. A slot's parent is on as many pages, so it is there too."""
    known = {"": Node("", "")} | {s["path"]: Node(s["label"], s["path"]) for s in slots}
    for s in sorted(slots, key=lambda s: (s["place"], s["path"])):
        known[s["parent"]].children[s["label"]] = known[s["path"]]
    return known[""]


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _is_template(node: Node, text: str, on: bool, slot: dict | None) -> bool:
    """Whether the host's pages repeat the slot or the block, or the slot is mostly links and not marked up as the article."""
    if slot and slot["same"] >= max(MIN_PAGES, CONSTANT * slot["pages"]):
        return True
    if slot and slot["constant"] and text_hash(text) in slot["constant"]:
        return True
    # a slot that too few pages have is judged by its links on this one
    links = slot["links"] if slot else node.links / max(1, sum(map(len, node.pieces)))
    return not on and links >= LINKS


def extract(page: Page, template: Node, stats: dict[str, dict]) -> tuple[str, int, int]:
    """The text, and how many blocks the template took, and of the others those that are marked up as something else.

    Where the article is marked up and not all template, only its blocks are text.
    """
    of = {id(x): y.path for x, y in simple_tree_match(page.root, template)[1]}
    left = [(text, on, off) for node, text, on, off in page.blocks if not _is_template(node, text, on, stats.get(of.get(id(node), "")))]
    said = [(text, on) for text, on, off in left if not off]
    return "\n".join([text for text, on in said if on] or [text for text, _ in said]), len(page.blocks) - len(left), len(left) - len(said)


def _slots(batches):
    for batch in groups(batches, "html", GROUP_BYTES):
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse(source or "")
            # pages that differ in adverts or comments alone are copies
            copy = text_hash("\0".join(f"{node.path}\0{said}" for node, said, _, off in page.blocks if not off))
            todo, place = [("", page.root)], 0
            for parent, node in todo:  # grows as it goes
                todo += [(node.path, child) for child in node.children.values()]
                text = "\n".join(node.pieces)
                place += 1
                if node.path:
                    rows.append((host, node.path, text_hash(text), copy, 1, len(text), node.links, place, parent, node.label))
                    if len(node.pieces) > 1:
                        rows += [(host, node.path, h, copy, 0, 0, 0, 0, parent, node.label) for h in {text_hash(said) for said in node.pieces}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()])], names=["host", "path", "text", "copy", "whole", "chars", "links", "place", "parent", "label"])


def _extract(batches):
    known: dict[str, tuple[Node, dict]] = {}
    for batch in groups(batches, "html", GROUP_BYTES):
        found = []
        for host, source, slots in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
            if host not in known:
                if len(known) > 256:
                    known.clear()
                listed = slots.as_py() or []
                known[host] = (template_tree(listed), {s["path"]: s | {"constant": frozenset(s["constant"] or ())} for s in listed})
            found.append(extract(parse(source or ""), *known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), *[pa.array(c, pa.int64()) for c in ([len(x[0]) for x in found], [x[1] for x in found], [x[2] for x in found])]], names=["page_id", "url", "text", "n_chars", "n_template", "n_named"])


def induce_templates(pages: DataFrame) -> DataFrame:
    """One row a host: its slots, with their pages, the most pages of one text, the share of link text, and the
    hashes of the single blocks that ``CONSTANT`` of the pages have.

    Counts run over all pages, copies of a page once; a page and slot give one row, and one for each block where
    there are several. Equal texts of a slot are summed before the shuffle, so that a host with a third of all
    pages has no larger group than another.
    """
    rows = pages.mapInArrow(_slots, "host string, path string, text bigint, copy bigint, whole bigint, chars bigint, links bigint, place bigint, parent string, label string")
    rows = rows.groupBy("host", "path", "text", "copy").agg(*[F.max(c).alias(c) for c in ("whole", "chars", "links", "place", "parent", "label")])
    same = stash(rows.groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("whole", "chars", "links", "place")], *[F.max(c).alias(c) for c in ("parent", "label")]))
    slots = same.groupBy("host", "path").agg(F.sum("whole").alias("pages"), F.max("whole").alias("same"), (F.sum("links") / F.greatest(F.sum("chars"), F.lit(1))).alias("links"), (F.sum("place") / F.sum("whole")).alias("place"), F.max("parent").alias("parent"), F.max("label").alias("label"))
    slots = stash(slots.filter(F.col("pages") >= MIN_PAGES))
    # at most as many blocks of a slot as its pages have in the mean, by the inverse of CONSTANT
    constant = same.filter(F.col("n") >= MIN_PAGES).join(slots.select("host", "path", "pages"), ["host", "path"]).filter(F.col("n") >= F.col("pages") * CONSTANT)
    constant = constant.groupBy("host", "path").agg(F.collect_list("text").alias("constant"))
    return slots.join(constant, ["host", "path"], "left").groupBy("host").agg(F.collect_list(F.struct("path", "pages", "same", "links", "place", "parent", "label", "constant")).alias("slots"))


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of each page of ``pages`` (page_id, url, html).

    The slots of every page are aligned with those of its host's pages by simple tree matching: slots and blocks
    that are the same on most of the host's pages, and slots that are mostly links, are template, the others content.
    Of content, what varies but is no article goes by its elements, roles and names: adverts, notices, comments,
    footers with a changing line. Where a page marks up its article (article, main, or names like content), what
    is left of it is the text; elsewhere, or where all of it is template, what is left of the page.

    Returns page_id, url, text (blocks joined by a line break, white space in blocks collapsed, character
    references decoded), n_chars, n_template (blocks that the template took), n_named (blocks that only their marks took). A null or empty page has an empty text; pages without a host in their url
    share the empty host. Repeated rows each get their row.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    # as a table, so that its size decides whether it is broadcast
    templates = stash(induce_templates(rows.select("host", "html")))
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "host", "slots")
    return joined.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint, n_template bigint, n_named bigint")
