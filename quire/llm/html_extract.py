"""Main-text extraction by equivalence classes of page tokens.

Tokens are the tags of a page, told apart by the path of open elements they stand in.  Over the
pages of a host every token has an occurrence vector (how often it occurs on each page); tokens with
the same vector form an equivalence class.  A class is valid for the template if its tokens occur
at most once on a page and its opening tags bring their closing tags along; valid classes nest by
the paths of their tokens and make up the host's template (one part on every page, others on the
pages that have them).  Between neighbouring template tokens of a page lie its slots.  A slot whose
template path runs through page furniture -- head, navigation, header, footer, sidebar, form,
script, notice, advert, reader comments, by element or by the words of class, id and role (not those
of html, body, main and article, which speak of the layout) -- is dropped.  If the template has an article (or main) element, the slots inside it are the text; if
not, the innermost template element that holds most of the host's unlinked text outside furniture.
Furniture that a page has inside its slots is dropped there too.  Whole texts of the remaining slots are kept:
repetition on other pages never removes text.

Scale.  The first pass sends one small row per (page, token) into an aggregate by (host, token);
vectors are compared by order-free sums of page hashes, so a hot host is pre-aggregated in every
task.  A host's template is bounded: tokens on under one page in a hundred are left out.  The second
pass joins the templates to the pages by host, and extracts page by page; the pages of a host with
one page in 1000 or more are salted, its template copied for every 64 of them (the list of such
hosts, 1000 at most, is broadcast).

Defined cases.  A null or empty html gives an empty text.  A page alone on its host is its own
template.  A null url belongs to the empty host.  Missing closing tags close with their parent; a
stray ``<`` is text.  Repeated rows are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_of, stage, table
from quire.llm.url_filter import host_of

#: A template token occurs on this share of the host's pages at least.
MIN_SHARE = 0.01
#: Pages of a hot host (one with this share of all pages, so there are at most 1000) to one copy of its template.
HOT_SHARE, PAGES_PER_SALT = 0.001, 64
#: The main element holds this share of the host's free text, where no article is marked.
MAIN_SHARE = 0.7

_NODE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {n: re.compile(rf"</{n}[^>]*(?:>|\Z)|\Z", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose closing tag may be missing: they are blocks, but no part of a path.
LOOSE = frozenset("p li td th tr dt dd option optgroup thead tbody tfoot colgroup rp rt".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody tfoot
thead tr ul""".split())
FURNITURE = frozenset("""aside button canvas datalist dialog footer form head header iframe input label menu nav noscript object
script search select style svg template textarea title""".split())
FURNITURE_WORDS = frozenset("""ad ads adbox advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs
comment comments consent cookie cookies disclaimer footer header login masthead menu modal nav navbar navigation newsletter
notice notices popup promo promoted promotion related replies search share sharing sidebar signup social sponsor sponsored
subscribe subscription toolbar widget""".split())
ARTICLES = frozenset(["article", "main"])
#: Elements that hold a page or its text: class words speak of their layout and do not make them furniture.
WHOLE = frozenset(["html", "body", *ARTICLES])


def _words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    values = (a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
    return tuple(w for v in values for w in re.split(r"[^a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", v).lower()) if w)


class Element:
    """An open element: its path, whether it is furniture or in it, and in an article."""

    __slots__ = ("name", "path", "furniture", "article", "link")

    def __init__(self, name: str, words: tuple[str, ...], parent: Element | None):
        self.name = name
        self.path = f"{parent.path if parent else ''}/{name}{'.' + '.'.join(words) if words else ''}"
        inside = parent is not None
        named = name not in WHOLE and not FURNITURE_WORDS.isdisjoint(words)
        self.furniture = (inside and parent.furniture) or name in FURNITURE or named
        self.article = (inside and parent.article) or name in ARTICLES or "main" in words and "role" in words
        self.link = (inside and parent.link) or name == "a"


def nodes(page: str):
    """(kind, element, text) in page order; kinds: open, close (element is the one closed), text
    (element is the enclosing one, or None), break (a block boundary without an element)."""
    stack: list[Element] = []
    at, n = 0, len(page)
    while at < n:
        m = _NODE.search(page, at)
        end = m.start() if m else n
        if end > at:
            yield "text", stack[-1] if stack else None, page[at:end]
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS or name == "br":
                yield "break", None, name
            if any(e.name == name for e in stack):
                while True:
                    e = stack.pop()
                    yield "close", e, e.name
                    if e.name == name:
                        break
            continue
        if name in BLOCKS or name in ("br", "td", "th"):
            yield "break", None, name
        if name in VOID or name in LOOSE:
            continue
        words = _words(m[3])
        if m[3] and "role" in m[3]:
            words = (*words, "role")
        e = Element(name, words, stack[-1] if stack else None)
        yield "open", e, name
        if name in _RAW:
            stop = _RAW[name].search(page, at)
            at = stop.end()
            yield "close", e, name
        elif not m[3].endswith("/"):
            stack.append(e)
        else:
            yield "close", e, name


def element_id(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def tag_counts(page: str) -> list[tuple[str, int, int, int]]:
    """(path, opening tags, closing tags, free text below) of one page's elements.  Free text:
    characters outside links and furniture; 0 for furniture itself."""
    opened: Counter = Counter()
    closed: Counter = Counter()
    free: Counter = Counter()
    around: list[str] = []
    for kind, e, text in nodes(page):
        if kind == "open":
            opened[e.path] += 1
            around.append(e.path)
        elif kind == "close":
            closed[e.path] += 1
            around.pop()
        elif kind == "text" and e is not None and not e.furniture and not e.link:
            size = len(text) - text.count(" ") - text.count("\n")
            if size:
                for path in around:
                    free[path] += size
    return [(path, n, closed[path], free[path]) for path, n in opened.items()]


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, element, closing, page, n, free, path) of ``pages(host, page, html)``: how often a page
    has a tag.  A null path marks the page itself."""
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["host", "element", "closing", "page", "n", "free", "path"]

    def run(batches):
        for b in batches:
            rows = []
            for host, page, text in zip(*(column_of(b, c) for c in ("host", "page", "html"))):
                rows.append((host, 0, False, page, 1, 0, None))
                for path, opened, closed, free in tag_counts(text or ""):
                    element = element_id(path)
                    rows.append((host, element, False, page, opened, free, path))
                    if closed:
                        rows.append((host, element, True, page, closed, 0, path))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    return pages.mapInArrow(run, "host string, element long, closing boolean, page long, n long, free long, path string")


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, elements, main): the pages of a host, the ids of its template's elements, and the
    path of the one that holds the free text (null where nothing stands out)."""
    low = F.lit(0x7FFFFFFF).cast("long")
    entry = F.xxhash64("page", "n")
    stats = occurrences(pages).groupBy("host", "element", "closing", "path").agg(
        F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("free").alias("free"),
        # the occurrence vector, as order-free sums of 31-bit halves of a hash of its entries
        F.sum(entry.bitwiseAND(low)).alias("v1"), F.sum(F.shiftright(entry, 32).bitwiseAND(low)).alias("v2"))
    stats = stage(stats, "tag-vectors")
    hosts = stats.filter("path is null").select("host", F.col("pages").alias("of"))
    once = (stats.filter("path is not null and total = pages").join(hosts, "host")
            .filter(F.col("pages") >= F.col("of") * MIN_SHARE))
    # valid: both tags of the element are in the same equivalence class
    valid = (once.groupBy("host", "v1", "v2", "element", "path").agg(F.count("*").alias("tags"), F.sum("free").alias("free"))
             .filter("tags = 2"))
    body = valid.groupBy("host").agg(F.collect_list("element").alias("elements"),
                                     F.collect_list(F.struct(F.length("path").alias("depth"), "path", "free")).alias("tree"))
    most = F.array_max(F.transform("tree", lambda e: e["free"]))
    holds = F.filter("tree", lambda e: (e["free"] >= MAIN_SHARE * most) & (e["free"] > 0))
    return hosts.join(body.select("host", "elements", F.array_max(holds)["path"].alias("main")), "host", "left").select(
        "host", F.col("of").alias("pages"), "elements", "main")


def main_text(page: str, template: frozenset, main: str | None) -> str:
    """The text blocks of the page's main slots, joined by two line feeds.  ``template``: ids of
    the template's elements; ``main``: the one that holds the free text."""
    blocks: list[tuple[bool, bool, str]] = []
    parts: list[str] = []
    slots: list[Element | None] = [None]  # innermost template element around each open element
    inside = [False]  # within the main element
    here = (False, False)

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((*here, text))
        parts.clear()

    for kind, e, text in nodes(page):
        if kind == "break":
            if text in ("br", "td", "th"):
                parts.append(" ")
            else:
                flush()
        elif kind == "open":
            framed = element_id(e.path) in template
            slots.append(e if framed else slots[-1])
            inside.append(inside[-1] or framed and e.path == main)
        elif kind == "close":
            slots.pop()
            inside.pop()
        else:
            slot = slots[-1]
            if e is not None and e.furniture or slot is not None and slot.furniture:
                continue
            now = (slot is not None and slot.article or e is not None and e.article, inside[-1])
            if now != here:
                flush()
                here = now
            parts.append(entities.unescape(text))
    flush()
    for which in (0, 1):
        if any(b[which] for b in blocks):
            blocks = [b for b in blocks if b[which]]
            break
    return "\n\n".join(b[2] for b in blocks)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text."""
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    keyed = pages.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    found = stage(templates(keyed), "templates")
    total = found.agg(F.sum("pages")).first()[0] or 0
    salts = F.when((F.col("pages") >= HOT_SHARE * total) & (F.col("pages") > PAGES_PER_SALT),
                   F.ceil(F.col("pages") / PAGES_PER_SALT)).otherwise(1).cast("int")
    found = found.withColumn("salts", salts)
    hot = found.filter("salts > 1").select("host", "salts")  # at most 1 / HOT_SHARE rows
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "pages")
    spread = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")
    joined = (pages.join(F.broadcast(hot), "host", "left").withColumn("salt", spread)
              .join(copies, ["host", "salt"], "left").select("page_id", "url", "html", "elements", "main"))
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = zip(*(column_of(b, c) for c in ("html", "elements", "main")))
            texts = [main_text(page, frozenset(elements or ()), main) if page else "" for page, elements, main in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string")


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
