"""HTML extraction by deduction of templates from equivalence classes (operator 9).

1. A page is read as a stream of block tags and text blocks. Every token has a role: the
   path of open block elements (containers with their classes, id and number among siblings
   of that name), and for a block of text its path and words.
2. A role's occurrence vector is its count on every page of the host. Spark adds up a hash
   of (page, count) over the pages, so roles with equal vectors have equal sums and fall
   into one equivalence class, without any vector being gathered.
3. A class is valid if it holds MIN_ROLES roles and occurs on MIN_SHARE of the host's pages
   (of MIN_PAGES at least). Valid classes nest: the parent of a class is the class of the
   elements around it, and only classes with a chain of valid parents make the template.
   Pages of a host with copies or near copies of one article count as one page in all this.
4. What lies between the template's tokens are its slots. The article's slot is found in the
   template, for all pages of the host at once: from the top it is the template element
   inside which DOMINANT of the text is that isn't template, linked or unwanted, down to the
   last such element (or to the article or main element around it, if there is one).
5. From each page the blocks of that slot are taken, with the page's first heading: without
   text that belongs to the template (it stands once on every page of the host, as the
   page's own elements do), without navigation, headers, footers, asides, forms, adverts,
   notices and comments inside it, which are known by element, role, class or id, and without
   blocks that are mostly links where there is no article. Pages of hosts with too few pages
   for a template, and pages that lack the slot, are read by the second half of this rule.

Text that is on every page is taken for template only if something else is left of the page.
Pages are parsed twice, once for the template and once for the text: to keep the blocks
between would double the data written.

Edge cases: null and empty pages give an empty text; a page without a valid url is its own
host; unclosed and stray tags are read as browsers do, near enough; very long pages are read
whole; ties between slots go to the smaller role; equal pages are pages of their own; an
empty table gives no rows; other columns are ignored, also with clashing names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import settle, table
from loomgraph.llm.simhash import components

MIN_PAGES, MIN_SHARE, MIN_ROLES, DOMINANT = 5, 0.95, 3, 0.8
#: Bytes up to which the templates of all hosts are broadcast; beyond, a join by host, whose
#: hot hosts Spark splits.
MAX_BROADCAST_BYTES = 16 << 20

#: Elements by kind.
RAW = "script style noscript template textarea title iframe svg select".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = (
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address nav header footer aside form fieldset details summary hr center dialog menu hgroup search"
).split()
DROPPED = "nav header footer aside form dialog menu button label fieldset search head".split()
DROPPED_ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
DROPPED_NAMES = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget footer header masthead comment comments respond disqus replies share sharing social related newsletter subscribe subscription signup login popup modal pagination pager"
).split()
#: Words that only say where or what kind of box something named above is.
BOX_NAMES = "left right top bottom site global primary secondary sticky fixed mobile box bar list area section block container wrapper wrap inner outer slot unit item items link links button buttons form posts articles stories".split()
#: Elements that a name never makes unwanted.
KEPT = "html body main article".split()
#: Elements whose role holds their class, id and number among siblings of that name.
SIGNED = "div section article aside nav header footer form ul ol dl table fieldset details hgroup center".split()
#: An open element of the first kind is ended by the start of one of the second.
CLOSES = {"p": set(BLOCKS), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile("[a-z]+")
_END = {x: re.compile(f"</{x}(?=[\\s/>]|$)", re.I | re.A) for x in RAW}
_SIGNED, _DIGITS = frozenset(SIGNED), re.compile(r"\d+")
_RAW, _VOID, _BLOCKS, _DROPPED, _DROPPED_ROLES, _DROPPED_NAMES, _BOX_NAMES, _KEPT = map(frozenset, (RAW, VOID, BLOCKS, DROPPED, DROPPED_ROLES, DROPPED_NAMES, BOX_NAMES, KEPT))
_HEADERS = frozenset(("header", "masthead"))


def _named(value: str, inside: bool) -> bool:
    """Whether a whole class or id names something unwanted: a name, or names and words for
    boxes. The header of an article is part of it."""
    for token in value.lower().split():
        pieces = set(_NAME.findall(token))
        names = pieces & _DROPPED_NAMES
        if names and pieces <= _DROPPED_NAMES | _BOX_NAMES and not (inside and names <= _HEADERS):
            return True
    return False


def _unwanted(tag: str, attrs: str, inside: bool = False) -> int:
    """0 for what is wanted, 1 for what is unwanted by its class or id alone, else 2."""
    if tag in _DROPPED and not (tag == "header" and inside):
        return 2
    if not attrs.strip():
        return 0
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if found.get("role", "").lower() in _DROPPED_ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|$|=)", _ATTR.sub("", attrs)) or "display:none" in found.get("style", "").replace(" ", "").lower():
        return 0 if tag == "header" and inside else 2
    return int(tag not in _KEPT and _named(f"{found.get('class', '')} {found.get('id', '')}", inside) and not (tag == "header" and inside))


class Block:
    """A block of text: its path, words joined by a space, share of linked characters, and
    whether it stands in an article (or main) and in something that isn't content."""

    __slots__ = ("in_article", "linked", "path", "text", "unwanted")

    def __init__(self, path: str, text: str, linked: float, in_article: bool, unwanted: int) -> None:
        self.path, self.text, self.linked, self.in_article, self.unwanted = path, text, linked, in_article, unwanted


def _signature(tag: str, attrs: str) -> str:
    """What a container is called in roles: classes and id, without numbers."""
    if tag not in _SIGNED or not attrs.strip():
        return tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = sorted(set(_DIGITS.sub("", f"{found.get('class', '')} {found.get('id', '')}").replace("/", "").split()))
    return ".".join([tag, *names])


def parse(html: str) -> tuple[list[Block], Counter, dict[str, float]]:
    """The blocks of a page, the counts of its element paths, and by path the characters
    inside that are neither linked nor unwanted."""
    # open block elements: (tag, path, in article, unwanted, children by signature)
    stack: list[tuple[str, str, bool, int, dict[str, int]]] = [("", "", False, 0, {})]
    blocks: list[Block] = []
    paths: Counter = Counter()
    masses: dict[str, float] = {}
    text: list[str] = []
    linked = chars = 0
    link = hidden = 0  # depth of open links and of unwanted inline elements
    at = 0

    def flush() -> None:
        nonlocal linked, chars
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                _, path, inside, bad, _ = stack[-1]
                share = linked / max(chars, 1)
                blocks.append(Block(path, joined, share, inside, bad))
                if not bad:
                    for x in stack[1:]:
                        masses[x[1]] = masses.get(x[1], 0.0) + len(joined) * (1 - share)
            text.clear()
        linked = chars = 0

    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        if (run := m[4]) is not None:
            if not hidden:
                text.append(run)
                if run.strip():
                    chars += len(run)
                    linked += len(run) * bool(link)
            continue
        if m[2] is None:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in _RAW:
            if not end and not m[3].endswith("/"):
                close = _END[tag].search(html, at)
                at = close.start() if close else len(html)
            continue
        if tag in _VOID or tag not in _BLOCKS:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link = 0 if end else 1
            elif tag in ("button", "label"):
                hidden = 0 if end else 1
            continue
        flush()
        link = hidden = 0
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and tag not in ("body", "html"):
                    break  # a stray end tag doesn't end what is around it
            continue
        while len(stack) > 1 and tag in CLOSES.get(stack[-1][0], ()):
            stack.pop()
        _, path, inside, bad, children = stack[-1]
        name = _signature(tag, m[3])
        if tag in _SIGNED:
            n = children[name] = children.get(name, 0) + 1
            name = f"{name}[{n}]"
        path = f"{path}/{name}"
        paths[path] += 1
        stack.append((tag, path, inside or tag in ("article", "main") or 'role="main"' in m[3], max(bad, _unwanted(tag, m[3], inside)), {}))
    flush()
    return blocks, paths, masses


#: Elements that hold a line of text; what holds those is the place of a text.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre caption figcaption summary address".split())


#: Those that are never a menu, however much of them is linked.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 caption figcaption pre blockquote".split())


def _place(path: str) -> str:
    while path.rpartition("/")[2] in LINES:
        path = path.rpartition("/")[0]
    return path


#: Elements of the page itself, which are never the article's.
PAGE = ("/html", "/html/body", "/body")


def role(path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode()) - (1 << 63)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.withColumn("host", F.when(host != "", host).otherwise(F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))


#: Random bits of the minima that sketch an article: BANDS of ROWS minima each.
BANDS, ROWS = 8, 8
_MIX = np.random.default_rng(9).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(text: str) -> list[int]:
    """A hash for each band of minima of the text's 3-word hashes: texts share one with a
    chance of 1 - (1 - s ** ROWS) ** BANDS, for a share s of 3-word runs in common."""
    words = text.split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else ()
    if not runs:
        return []
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    every = np.array([xxhash.xxh64_intdigest(r.encode()) for r in runs], np.uint64)
    for s in range(0, len(every), 4096):
        mixed = every[s : s + 4096, None] * _MIX[0] + _MIX[1]
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return [xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, BANDS * ROWS, ROWS)]


_ROLES = pa.list_(pa.struct([("role", pa.int64()), ("parent", pa.int64()), ("is_text", pa.bool_()), ("is_main", pa.bool_()), ("n", pa.int64()), ("mass", pa.float64())]))
_ROLES_DDL = "roles array<struct<role: long, parent: long, is_text: boolean, is_main: boolean, n: long, mass: double>>"
_MAIN = re.compile(r"(?:article(?:\.[^/]*)?\[\d+\]|main)$")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, bands, roles): of each page its sketch, and its roles with their counts."""
    for b in batches:
        bands, roles = [], []
        for page_html in b.column("html").to_pylist():
            blocks, paths, masses = parse(page_html or "")
            bands.append(_sketch("\n".join(x.text for x in _slots(blocks))))
            own = [(role(p), role(p.rpartition("/")[0]), False, bool(_MAIN.search(p)), n, masses.get(p, 0.0)) for p, n in paths.items()]
            own += [(role(p, t), role(_place(p)), True, False, n, 0.0) for (p, t), n in Counter((x.path, x.text) for x in blocks).items()]
            roles.append([dict(zip(("role", "parent", "is_text", "is_main", "n", "mass"), x, strict=True)) for x in own])
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("node"), pa.array(bands, pa.list_(pa.int64())), pa.array(roles, _ROLES)], ["host", "node", "bands", "roles"])


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, node, roles) of one page for each group of pages of a host that hold copies or
    near copies of one article: copies linked by a band of their sketches, in chains of any
    length. Equal pages of a host are one node."""
    pages = pages.select("host", "html", F.xxhash64("host", F.coalesce("html", F.lit(""))).alias("node"))
    sketches = settle(pages.mapInArrow(_sketches, f"host string, node long, bands array<long>, {_ROLES_DDL}"), "sketches")
    bands = sketches.select("host", "node", F.explode("bands").alias("band")).distinct()
    low = bands.groupBy("host", "band").agg(F.min("node").alias("root"), F.max("node").alias("last")).where("root < last").drop("last")
    linked = components(bands.join(low, ["host", "band"]).where("node <> root").select("node", "root"))
    return sketches.dropDuplicates(["node"]).join(linked, "node", "left").where("component IS NULL OR component = node").select("host", "node", "roles")


def templates(pages: DataFrame) -> DataFrame:
    """(host, class, parent_class, role, parent, is_text, is_main, n_pages, mass): the roles of
    all valid, nested classes of all hosts. pages has host and html. Copies of an article
    count as one page: they must not make its text a template."""
    pages = distinct_pages(pages)
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= MIN_PAGES)
    roles = pages.select("host", "node", F.explode("roles").alias("r")).select("host", "r.*", F.shiftright(F.xxhash64("node", "r.n"), 8).alias("vec"))
    # sums of 56-bit hashes: a wrong equality needs a chance of 1 in 2^56
    vectors = roles.groupBy("host", "role", "parent", "is_text", "is_main").agg(F.sum("mass").alias("mass"), F.sum(F.col("vec").cast("decimal(20,0)")).alias("vec"), F.count("*").alias("n_pages"), F.sum("n").alias("n"))
    frequent = vectors.join(hosts, "host").where(F.col("n_pages") >= MIN_SHARE * F.col("host_pages"))
    frequent = settle(frequent.withColumn("class", F.xxhash64(F.col("vec").cast("string"), "n_pages", "n")), "roles")
    valid = frequent.groupBy("host", "class").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_ROLES).select("host", "class")
    nested = frequent.join(valid, ["host", "class"])
    around = nested.where(~F.col("is_text")).select("host", F.col("role").alias("parent"), F.col("class").alias("parent_class"))
    top = F.col("parent") == F.lit(role(""))
    return nested.join(around, ["host", "parent"], "left").where(F.col("parent_class").isNotNull() | top).select("host", "class", "parent_class", "role", "parent", "is_text", "is_main", "n_pages", "mass")


def _region(elements: pd.DataFrame) -> pd.DataFrame:
    """The role of the article's slot, from the elements of one host's template."""
    below: dict[int, list[tuple[float, int, bool]]] = {}
    for r in elements.itertuples():
        below.setdefault(r.parent, []).append((-r.mass, r.role, r.is_main))
    at, chain = role(""), []
    room = sum(-x[0] for x in below.get(at, ()))
    while best := min(below.get(at, ()), default=None):
        if -best[0] <= 0 or -best[0] < DOMINANT * room or best[1] in {x[1] for x in chain}:
            break
        chain.append(best)
        at, room = best[1], -best[0]
    mains = [x[1] for x in chain if x[2]]
    found = mains[-1] if mains else at if chain and at not in {role(x) for x in PAGE} else None
    return pd.DataFrame({"host": elements["host"].iloc[:1], "region": pd.Series([found], dtype="Int64", index=elements.index[:1])})


def slots(template: DataFrame) -> DataFrame:
    """(host, region): the role of the article's slot, null where none dominates. A group is
    the template elements of one host, no more than its smallest page has, nearly."""
    return template.where(~F.col("is_text")).select("host", "role", "parent", "is_main", "mass").groupBy("host").applyInPandas(_region, "host string, region long")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [main_text(h or "", frozenset(t or ()), r) for h, t, r in zip(*(b.column(c).to_pylist() for c in ("html", "template", "region")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.bool_())], ["page_id", "url", "text", "by_template"])


def _slots(blocks: list[Block]) -> list[Block]:
    """The blocks of the article, or of the body without menus where there is none. Names are
    not heeded where nothing else is left."""
    slots = [x for x in blocks if not x.unwanted] or [x for x in blocks if x.unwanted < 2]
    return [x for x in slots if x.in_article] or [x for x in slots if x.linked <= 0.5 or x.path.rpartition("/")[2] in PROSE] or slots


def _inside(blocks: list[Block], region: int) -> list[Block]:
    """The blocks in the template's slot, and the first heading if that stands outside."""
    known: dict[str, bool] = {"": False}

    def there(path: str) -> bool:
        if path not in known:
            known[path] = role(path) == region or there(path.rpartition("/")[0])
        return known[path]

    found = [there(x.path) for x in blocks]
    if any(found) and not any(f and x.path.endswith("/h1") for f, x in zip(found, blocks, strict=True)):
        head = next((i for i, x in enumerate(blocks) if x.path.endswith("/h1") and not x.unwanted), None)
        if head is not None:
            found[head] = True
    return [x for x, f in zip(blocks, found, strict=True) if f]


def main_text(html: str, template: frozenset[int] = frozenset(), region: int | None = None) -> tuple[str, bool]:
    """The slots of a page's article, blocks joined by an empty line, and whether the
    template's slot was there to tell them."""
    blocks, _, _ = parse(html)
    of_slot = [x for x in _inside(blocks, region) if role(x.path, x.text) not in template] if region is not None else []
    if any(not x.unwanted for x in of_slot):
        return "\n\n".join(x.text for x in _slots(of_slot)), True
    found = _slots(blocks)
    left = [x for x in found if role(x.path, x.text) not in template]
    return "\n\n".join(x.text for x in left or found), False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, by_template) of every page; by_template tells whether the slot of
    the host's template decided what the text is."""
    pages = with_host(pages.select("page_id", "url", "html"))
    found = settle(templates(pages), "template-roles")
    texts = found.where("is_text").groupBy("host").agg(F.collect_set("role").alias("template"))
    known = settle(slots(found).join(texts, "host", "left"), "templates")
    size = known.agg(F.coalesce(F.sum(8 * F.greatest(F.size("template"), F.lit(0)) + F.octet_length("host") + 48), F.lit(0))).first()[0]
    joined = pages.join(F.broadcast(known) if size <= MAX_BROADCAST_BYTES else known, "host", "left")
    return joined.select("page_id", "url", "html", "template", "region").mapInArrow(_extract, "page_id long, url string, text string, by_template boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "by_template")

