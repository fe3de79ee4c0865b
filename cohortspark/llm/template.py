"""Main text of web pages by site template removal.

Each page is parsed once into a tree. Every container element (menus, lists, boxes, sections, tables, ...) has a hash of
its whole subtree: tags, and text. Spark counts on how many pages of a host each subtree hash stands (combined on the
map side, so a host with a third of all pages is a few rows per task), and subtrees that recur on many pages of their
host are deleted wherever they stand. Elements that say themselves that they are no text (scripts, forms, menus,
adverts, comments, ... by tag, role or class) go at once. What stays of the article (the longest <article>, else
<main>, else the body) is the text: blocks in page order, white space inside a block turned into one space, joined by
one space.

Prose inside the article (paragraphs, headings, quotations) is never a template, nor is an element that holds more
than half of its page's words: a text that several pages of a host carry is not furniture.

Defined cases: null and empty html give an empty text; a missing URL or host is a host of its own; broken markup is
closed where the next block or the end of the page closes it; truncated references stay as they are; repeated rows and
equal page ids are counted as pages of their own; long pages are read whole; other columns are ignored.
"""

import html as references
import re

import xxhash
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, row_chunks, stored

#: A subtree is a template on a host from this many pages, and this share of the host's pages, on.
MIN_PAGES, MIN_SHARE = 5, 0.02

# The elements of HTML by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template svg math object".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split())
DROPPED = set("head script style title textarea xmp iframe noembed noframes noscript template svg math object nav footer aside form button select input dialog menu audio video canvas".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices
notification popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar
share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply pagination pager widget widgets""".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_WORD_BREAK = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("tag", "parent", "children", "dropped", "hash", "words")

    def __init__(self, tag, parent, dropped=False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children, self.hash, self.words = [], 0, 0


def _no_text(tag, raw, in_article):
    """Whether the element says that it is no main text."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not raw or raw.isspace() or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(raw):
        name = name.lower()
        value = value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and not MARKS.isdisjoint(_WORD_BREAK.split(value)):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def parse(page):
    """The tree of a page: elements with children that are elements or texts."""
    root = Element("#root", None)
    at, end, articles = 0, len(page), 0
    here = root
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while here is not up.parent:
                    articles -= here.tag == "article"
                    here = here.parent
            elif tag == "p":
                here.children.append(Element("p", here))
            continue
        if tag in BLOCK:
            up = here  # an open paragraph ends before a block
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in CLOSES:
            up = here
            while up is not root and up.tag not in FENCES[tag]:
                if up.tag in CLOSES[tag]:
                    here = up.parent
                up = up.parent
        element = Element(tag, here, _no_text(tag, found[3], articles > 0))
        here.children.append(element)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not found[3].endswith("/"):
            here = element
            articles += tag == "article"
        elif tag not in VOID and tag in ("div", "p", "section", "article", "span"):
            here = element  # HTML ignores the slash of these
            articles += tag == "article"
    return root


def measure(root):
    """Give every element the hash and the number of words of its subtree (children first, without recursion)."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if c.__class__ is Element]
    for e in reversed(order):
        parts, words = [e.tag], 0
        for c in e.children:
            if c.__class__ is Element:
                parts.append("\x01%x" % c.hash)
                words += c.words
            else:
                split = c.split()
                words += len(split)
                parts.append(" ".join(split))
        e.words = words
        e.hash = xxhash.xxh3_64_intdigest("\x02".join(parts))
    return order


def main_element(order):
    best = None
    for tags in (("article",), ("main",)):
        for e in order:
            if e.tag in tags and (best is None or e.words > best.words):
                up = e
                while up is not None and not up.dropped:
                    up = up.parent
                if up is None:
                    best = e
        if best is not None:
            return best
    return order[0]


def page_parts(page):
    """([(text, hashes of the containers that may be templates)], [subtree hashes of the page])."""
    root = parse(page or "")
    order = measure(root)
    half = root.words / 2
    main = main_element(order)
    in_article = main is not root
    subtrees = {e.hash - 2**63 for e in order if e.words and e.tag in BLOCK and e.tag not in PROSE and e.words <= half and e.tag not in ("html", "head", "body")}
    parts, text = [], []

    def flush(chain):
        if text:
            block = _SPACE.sub(" ", references.unescape("".join(text))).strip(" ")
            text.clear()
            if block:
                parts.append((block, chain))

    # each entry: an element to open, or (element, chain) to close
    stack = [(main, (), False)]
    while stack:
        e, chain, closing = stack.pop()
        if e.__class__ is str:
            text.append(e)
            continue
        if closing:
            flush(chain)
            continue
        if e.dropped and e is not main:
            continue
        if e.tag == "br":
            text.append(" ")
            continue
        inner = chain
        if e.tag in BLOCK:
            flush(chain)
            if e is not main and e.tag not in ("html", "body") and e.words <= half and not (in_article and e.tag in PROSE):
                inner = chain + (e.hash - 2**63,)
            if in_article and e.tag in PROSE:
                inner = ()
            stack.append((e, inner, True))
        if e.tag == "header" and in_article and e is not main:  # of an article's own head the headings only
            stack += [(c, inner, False) for c in reversed(e.children) if c.__class__ is Element and c.tag in HEADINGS]
        else:
            stack += [(c, inner, False) for c in reversed(e.children)]
    flush(())
    return parts, subtrees


def host_of(url):
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def parsed_pages(pages):
    """Per page: page_id, url, key, host, parts (text, chain of container hashes), subtrees."""

    def run(batch):
        for part in row_chunks(batch, 2_000_000, "html"):
            urls = part.column("url").to_pylist()
            done = [page_parts(h.as_py()) for h in part.column("html")]
            fixed = [all(not c for _, c in p) for p, _ in done]
            # a page without removable parts is its text already
            yield {"page_id": part.column("page_id"), "url": urls, "key": part.column("key"), "host": [host_of(u) for u in urls],
                   "text": [" ".join(t for t, _ in p) if f else None for (p, _), f in zip(done, fixed)],
                   "parts": [None if f else [{"text": t, "chain": list(c)} for t, c in p] for (p, _), f in zip(done, fixed)],
                   "subtrees": [list(s) for _, s in done]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64("url", "html").alias("key"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, run, "page_id long, url string, key long, host string, text string, parts array<struct<text: string, chain: array<long>>>, subtrees array<long>")


def host_templates(parsed, min_pages=MIN_PAGES, min_share=MIN_SHARE):
    """(host, subtree, pages) of the subtrees that recur on many pages of their host."""
    total = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    seen = parsed.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return seen.join(total, "host").where(F.col("pages") >= min_share * F.col("of")).select("host", "subtree", "pages")


def main_text(pages, min_pages=MIN_PAGES, min_share=MIN_SHARE):
    """One row per page: page_id, url, text, n_chars, n_removed (blocks deleted as templates)."""
    parsed = stored(parsed_pages(pages), "parsed-pages")
    whole = parsed.where("text IS NOT NULL").select("page_id", "url", "text", F.lit(0).cast("long").alias("n_removed"))
    open_ = parsed.where("text IS NULL")
    templates = stored(host_templates(parsed, min_pages, min_share), "host-templates")
    asked = open_.select("page_id", "key", "host", F.explode(F.array_distinct(F.flatten("parts.chain"))).alias("subtree"))
    hit = asked.join(templates, ["host", "subtree"]).groupBy(F.col("page_id").alias("_page"), F.col("key").alias("_key")).agg(F.collect_set("subtree").alias("_gone"))
    joined = open_.join(hit, open_["page_id"].eqNullSafe(hit["_page"]) & (open_["key"] == hit["_key"]), "left")
    stay = F.filter("parts", lambda p: F.col("_gone").isNull() | ~F.arrays_overlap(p["chain"], F.col("_gone")))
    cleared = joined.select("page_id", "url", F.array_join(stay["text"], " ").alias("text"), (F.size("parts") - F.size(stay)).cast("long").alias("n_removed"))
    return whole.unionByName(cleared).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_removed")
