"""Main text of web pages by union-free regular expressions: wrappers inferred by aligning pages of one host."""

from __future__ import annotations

import json
import re
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import arrow_batches, written

#: Wrappers that a worker keeps at hand; pages that must agree on a template's words.
KEPT, AGREE = 256, 3
#: Characters of expressions that a worker merges before it hands on what it has; words longer than WORDS characters travel as a digest.
MERGED, WORDS = 16 << 20, 32
#: Bytes of all wrappers up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

#: A comment, tag or text. Quotes count after = alone, so a stray one hides nothing; nothing is tried twice, so the time is linear.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>|<[!?/][^>]*+>|([^<]++)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag of the key closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
#: Elements and roles that never hold the article.
_OUT = set("head nav footer aside form button select textarea iframe svg object menu dialog script style noscript template title canvas audio video".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class or id that hint at other parts. They are hints only: see Wrapper.soft and label().
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead social share sharing related recommended recommendations comment comments commentlist disqus reply "
    "replies respond widget widgets toolbar pagination pager login signin signup skip hidden banner".split()
)
_SOFT, _BODY = {"header", "footer", "topbar", "bottom"}, {"article", "post", "entry", "story", "content"}
#: Names with one of these speak of a state or of a whole page's layout, as has-sidebar or menu-open; with these beside a hint it is plain.
_STATES = set("has have with without no not is layout open opened closed enabled disabled active on off page single template body theme col columns grid".split())
_PLAIN = set("area box block wrap wrapper container section list item items site left right top bottom inner outer main primary secondary the global sticky fixed text link links title id".split())


def _hint(names: str) -> str:
    """"~~" where a class or id says plainly that the element is another part, "~" where it may say so, else nothing."""
    found = ""
    for name in names.split():
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if words & _STATES or not words & (_WORDS | _SOFT) or not words & _WORDS and words & _BODY:
            continue
        found = max(found, "~~" if words <= _WORDS | _SOFT | _PLAIN else "~")
    return found


class Node:
    """An element (sig: name and classes) with its kids, or a run of text (sig "#"), of which `link` characters are in links. out: never part
    of an article; hint: the element's class or id hints at another part."""

    __slots__ = ("sig", "tag", "out", "main", "hint", "kids", "text", "link")

    def __init__(self, sig, tag="", out=False, main=False, hint=False):
        self.sig, self.tag, self.out, self.main, self.hint, self.kids, self.text, self.link = sig, tag, out, main, hint, [], "", 0


def _element(tag: str, attrs: str, inside_main: bool) -> Node:
    a = {}
    for m in _ATTR.finditer(attrs):
        a.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    role = a.get("role", "").lower()
    main = tag in ("article", "main") or role == "main" or a.get("itemprop", "").lower() == "articlebody"
    out = tag in _OUT or role in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "").lower())) or tag == "header" and not inside_main
    hint = "" if tag in ("html", "body") else _hint(f"{a.get('class', '')} {a.get('id', '')}")
    sig = ".".join([tag, *sorted(set(re.sub(r"[\d]+", "", a.get("class", "").lower()).split()))]) + "!" * out + hint + "@" * main
    return Node(sig, tag, out, main and not out, bool(hint))


def parse(html: str) -> Node:
    """The page as a tree of block elements; inline markup is dropped, each run of text between block boundaries is one text node."""
    root = Node("html", "html")
    stack, text, link, in_link, at = [root], [], 0, 0, 0

    def flush():
        nonlocal link
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                t = Node("#")
                t.text, t.link = words, min(link, len(words))
                stack[-1].kids.append(t)
            text.clear()
        link = 0

    last = html.rfind(">")
    while at < len(html):
        if at > last:  # no tag ends after this
            text.append(html[at:].partition("<!--")[0])
            break
        m = _TOKEN.match(html, at)
        if m is None:  # a < that begins no tag, or one whose last quote never ends: up to the next >, so that no part is read twice
            end = html.find(">", at) if html[at + 1 : at + 2].isalpha() else -1
            if end < 0:
                text.append("<")
                at += 1
                end = html.find("<", at)
                text.append(html[at : end if end >= 0 else len(html)])
                at = end if end >= 0 else len(html)
            else:
                at = end + 1
            continue
        at = m.end()
        if m[4] is not None:
            text.append(m[4])
            if in_link:
                link += len(m[4])
            continue
        if not m[2]:
            continue
        close, tag = m[1], m[2].lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if close else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if close:
            in_link = 0 if tag not in ("p", "br") else in_link
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in _VOID:
            continue
        if tag in ("html", "body", "head") and tag == "html":
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SCOPE.get(tag, ()):
                    break
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
        if stack[-1].tag == "head" and tag not in _RAW:
            stack.pop()
        node = _element(tag, m[3], any(s.main for s in stack))
        stack[-1].kids.append(node)
        if not m[3].endswith("/") or tag in ("p", "div", "article", "section"):
            stack.append(node)
    flush()
    return root


class Wrapper:
    """A union-free expression: an element with its kids in order, each of which may be optional, repeated, or part of a repeated group;
    a text is constant (its words; of a repeated one the lines that a page has there) or a slot (None). mass, link and pages are characters and pages seen. keep and inside are label()'s."""

    __slots__ = ("sig", "opt", "plus", "group", "words", "kids", "mass", "link", "pages", "keep", "inside")

    def __init__(self, sig, opt=False, plus=False, group=0, words=None, kids=(), mass=0, link=0, pages=1):
        self.sig, self.opt, self.plus, self.group, self.words, self.kids, self.mass, self.link, self.pages, self.keep = sig, opt, plus, group, words, list(kids), mass, link, pages, False
        self.inside = False

    def dump(self):
        words = self.words if self.words is None or len(self.words) <= WORDS else xxhash.xxh3_128_hexdigest(self.words.encode("utf-8", "surrogatepass"))
        return [self.sig, int(self.opt), int(self.plus), self.group, words, [k.dump() for k in self.kids], self.mass, self.link, self.pages]

    @classmethod
    def load(cls, x):
        return cls(x[0], bool(x[1]), bool(x[2]), x[3], x[4], [cls.load(k) for k in x[5]], x[6], x[7], x[8])

    def __str__(self):
        inner = self.sig if self.sig != "#" else "slot" if self.words is None else repr(self.words)
        inner += f"({' '.join(map(str, self.kids))})" if self.kids else ""
        return inner + "+" * self.plus + "?" * self.opt


def wrap(node: Node) -> Wrapper:
    """A page's own expression: kids of one signature become one repeated kid, and those between its occurrences a repeated group."""
    if node.sig == "#":
        return Wrapper("#", words=node.text, mass=len(node.text), link=node.link)
    order, last, group = {}, {}, 0
    kids = [wrap(k) for k in node.kids]
    for i, k in enumerate(kids):
        if k.sig in order:
            a = order[k.sig]
            if last[k.sig] != i - 1:
                group += 1
                for j in range(last[k.sig], i):
                    order[kids[j].sig].group = group
            order[k.sig] = merge(a, k, repeat=True)
            order[k.sig].group = a.group
        else:
            order[k.sig] = k
        last[k.sig] = i
    return Wrapper(node.sig, kids=order.values())


def align(a: list[Wrapper], b: list[Wrapper]) -> list[tuple[Wrapper | None, Wrapper | None]]:
    """Pairs of two token streams of one level, in order. At a mismatch, what the other stream has nowhere ahead is optional (None beside it);
    what both have, but in another order, is a pair all the same: such parts repeat in either order, and are a group."""
    ahead_a, ahead_b = {k.sig: k for k in a}, {k.sig: k for k in b}
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        x, y = a[i] if i < len(a) else None, b[j] if j < len(b) else None
        if x is not None and x.sig not in ahead_a:  # paired before, out of order
            i += 1
        elif y is not None and y.sig not in ahead_b:
            j += 1
        elif x is not None and y is not None and x.sig == y.sig:
            out.append((x, y))
            del ahead_a[x.sig], ahead_b[y.sig]
        elif x is not None and x.sig not in ahead_b:
            out.append((x, None))
            del ahead_a[x.sig]
        elif y is not None and y.sig not in ahead_a:
            out.append((None, y))
            del ahead_b[y.sig]
        else:
            out.append((x, ahead_b.pop(x.sig)))
            out[-1][0].group = out[-1][0].group or out[-1][1].group or -1
            del ahead_a[x.sig]
    return out


def merge(a: Wrapper, b: Wrapper, repeat: bool = False, within: bool = False) -> Wrapper:
    """The expression of both: their kids aligned, pairs merged, the others optional; texts that differ become a slot.

    repeat: a and b are occurrences within one page, so the result is repeated; else they are two pages. within: they are parts of such
    occurrences, whose texts are kept as a set of lines, so that a repeated part that says the same on all pages is no slot.
    """
    within = within or repeat
    words = a.words
    if a.words != b.words:
        words = "\n".join(sorted({*a.words.split("\n"), *b.words.split("\n")})) if within and a.words is not None and b.words is not None else None
    kids = []
    for x, y in align(a.kids, b.kids):
        one = x or y
        if x is not None and y is not None:
            one = merge(x, y, False, within)
            one.plus, one.opt = x.plus or y.plus, x.opt or y.opt
        else:
            one.opt = True
        kids.append(one)
    pages = max(a.pages, b.pages) if within else a.pages + b.pages
    return Wrapper(a.sig, a.opt or b.opt, repeat or a.plus or b.plus, a.group or b.group, words, kids, a.mass + b.mass, a.link + b.link, pages)


def infer(pages: list[Node]) -> Wrapper:
    """The wrapper of the pages, aligned one after the other."""
    out = wrap(pages[0])
    for p in pages[1:]:
        out = merge(out, wrap(p))
    label(out)
    return out


#: Share of a wrapper's slot text that shows an element with a hint (plain, or not so plain) to be no other part, but what holds the article.
HOLDS = {"~~": 0.9, "~": 0.5}
#: Share of a marked region's text that is slots, from which on the template's own words in it are no part of the article.
SLOTS = 0.8


def label(w: Wrapper) -> None:
    """Mark the texts of the wrapper that make up the article (keep), and the elements that hold them (inside): slots in the region that holds most of what varies from page to page.

    Hints of class names don't outweigh this: an element that has most of the slot text (HOLDS) is no other part, and one that has an
    article or main element within is only passed over for one without hints. The region is the smallest article or main element that has
    half the text of the largest; without one, the path is followed downwards while a single kid has most of the slot text that is not in
    links. Words that are the same on all pages are the template's: they are left out where there is no such element, or slots make up most
    of it. Ties are broken by depth and signature, so the order in which pages were merged doesn't matter.
    """

    def fixed(t: Wrapper) -> bool:
        return t.words is not None and t.pages >= AGREE

    def slots(x: Wrapper) -> int:
        if x.sig == "#":
            return 0 if fixed(x) or 2 * x.link > x.mass else x.mass - x.link
        return 0 if "!" in x.sig else sum(map(slots, x.kids))

    every, holders = slots(w), set()

    def hint(x: Wrapper) -> bool:
        return "~" in x.sig and id(x) not in holders

    def find_holders(x: Wrapper):
        for k in x.kids:
            if k.sig != "#" and "!" not in k.sig:
                share = HOLDS["~~" if "~~" in k.sig else "~"]
                if slots(k) > share * every:
                    holders.add(id(k))
                    find_holders(k)
                elif 2 * slots(k) > every:
                    find_holders(k)

    find_holders(w)

    def mass(x: Wrapper, all_: bool) -> int:
        if x.sig == "#":
            return x.mass if all_ else slots(x)
        return 0 if "!" in x.sig or hint(x) else sum(mass(k, all_) for k in x.kids)

    marked = []

    def find(x: Wrapper, path: tuple, hints: int):
        if "!" not in x.sig:
            if "@" in x.sig:
                own = sum(mass(k, True) for k in x.kids)
                if own:
                    marked.append((0 if not hints and not hint(x) else 1 if not hint(x) and not x.plus else 2, own, -len(path), path, x))
            for k in x.kids:
                find(k, (*path, k.sig), hints + hint(x))

    find(w, (), 0)
    tier = min((t for t, *_ in marked), default=None)
    marked = [x[1:] for x in marked if x[0] == tier]
    most = max((m for m, *_ in marked), default=0)
    inside = most > 0
    if inside:
        region = min((x for x in marked if 2 * x[0] >= most), key=lambda x: x[:3])[3]
    else:
        region = w
        while True:
            total = mass(region, False)
            best = max((k for k in region.kids if k.sig != "#" and not k.plus), key=lambda k: (mass(k, False), k.sig), default=None)
            if best is None or not total or mass(best, False) < 0.7 * total or best.sig.split(".")[0] == "p":
                break
            region = best
    whole = inside and sum(mass(k, False) for k in region.kids) < SLOTS * sum(mass(k, True) for k in region.kids)

    def mark(x: Wrapper):
        if x.sig == "#":
            x.keep = whole or not (fixed(x) or 2 * x.link > x.mass and not inside)
        elif x is region or "!" not in x.sig and not hint(x):
            x.inside = True
            for k in x.kids:
                mark(k)

    mark(region)


def extract(page: Node, wrapper: Wrapper) -> list[str]:
    """The article's blocks in page order. The page is read along the wrapper; a part that the wrapper doesn't know follows its parent:
    it belongs to the article if its parent lies in the region that label() chose, or the texts around it belong to the article."""
    out: list[str] = []

    def has(w: Wrapper) -> bool:
        return w.keep or any(has(k) for k in w.kids)

    def walk(node: Node, w: Wrapper | None, unknown: bool, header: bool):
        kids = {} if w is None else {k.sig: k for k in w.kids}
        for k in node.kids:
            own = kids.get(k.sig)
            if k.sig == "#":
                if (own.keep if own else unknown) and (not header or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
                    out.append(k.text)
            elif not k.out and not (k.hint and own is None):
                walk(k, own, unknown if own is None else own.inside or w is not None and has(own) and "@" in own.sig or (unknown and has(own)), header or k.tag == "header")

    walk(page, wrapper, wrapper.inside, False)
    return out


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The article of a page, by its host's wrapper; where that finds nothing, or there is none, by an expression of the page alone."""
    page = parse(html or "")
    blocks = extract(page, wrapper) if wrapper is not None else []
    return "\n".join(blocks or extract(page, infer([page])))


def host_of(url):
    """The host of a URL, lower-cased, without user and port; null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) for each host of pages (host, html): inferred from all its pages of different content.

    Every page becomes an expression where it is read; expressions, not pages, are shuffled. Copies of a page on one host count once: they
    go where they are read, and what is left of them by the digest of host and page. The expressions are merged in two steps, in parts that
    each hold some pages of many hosts, and then the parts of a host, so a host with a third of all pages gives a few rows to its last task.
    """
    arrow_batches(pages.sparkSession)

    def express(batches):
        seen: set[bytes] = set()
        for batch in batches:
            hosts, digests, dumped = [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                digest = xxhash.xxh3_128_digest(f"{host} {html}".encode("utf-8", "surrogatepass"))
                if digest not in seen:
                    seen.add(digest)
                    hosts.append(host)
                    digests.append(digest)
                    dumped.append(json.dumps(wrap(parse(html)).dump()))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(dumped, pa.string())], ["host", "digest", "wrapper"])

    def parts(batches):
        merged: dict[str, Wrapper] = {}
        size = 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array([json.dumps(w.dump()) for w in merged.values()], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for host, dumped in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                w = Wrapper.load(json.loads(dumped))
                merged[host] = merge(merged[host], w) if host in merged else w
                size += len(dumped)
                if size > MERGED:
                    yield done()
                    merged.clear()
                    size = 0
        yield done()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for dumped in pdf.wrapper:
            w = Wrapper.load(json.loads(dumped))
            out = w if out is None else merge(out, w)
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "wrapper": [json.dumps(out.dump())]})

    single = pages.where(F.col("host").isNotNull() & F.col("html").isNotNull()).select("host", "html").mapInArrow(express, "host string, digest binary, wrapper string")
    single = single.dropDuplicates(["digest"]).select("host", "wrapper")
    return single.mapInArrow(parts, "host string, wrapper string").groupBy("host").applyInPandas(whole, "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """The columns of pages (url, html, any others) without html, and text and n_chars (its code points), a row for each page.

    Wrappers join their pages by host, and each page is read along its wrapper. They are written once and measured: up to BROADCAST_BYTES
    they go to the pages, so that no page moves; beyond, both sides are shuffled by host, and a hot host is split by skew handling. A null
    html is an empty page, whose text is empty; a null url or one without a host has no wrapper, and the page is taken by itself. Repeated
    rows give a row each. Of an article's own header its headings stay and the rest (bylines, dates, a lead) goes, as headers are no part of
    the text. An empty table gives no rows.
    """
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    base = pages.select(*names, F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("x_host"))
    wrappers = host_wrappers(base.select(F.col("x_host").alias("host"), "html")).withColumnsRenamed({"host": "w_host", "wrapper": "x_wrapper"})
    wrappers = written(wrappers, "wrappers")
    size = wrappers.agg(F.sum(F.length("w_host") + F.length("x_wrapper"))).first()[0] or 0
    side = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    joined = base.join(side, F.col("x_host") == F.col("w_host"), "left").select(*names, "html", "x_host", "x_wrapper")
    arrow_batches(pages.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in names)

    def run(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for html, host, dumped in zip(*(batch.column(c).to_pylist() for c in ("html", "x_host", "x_wrapper")), strict=True):
                w = None
                if dumped is not None:
                    w = known.get(host)
                    if w is None:
                        if len(known) >= KEPT:
                            known.clear()
                        w = known[host] = Wrapper.load(json.loads(dumped))
                        label(w)
                texts.append(main_text(html, w))
            cols = [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "text", "n_chars"])

    return joined.mapInArrow(run, f"{schema}, text string, n_chars long")


def op4_html(spark, sf_dir):
    """page_id, url, text, n_chars of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
