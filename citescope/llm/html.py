"""Main text of web pages: a template per host from equivalence classes of tokens, and the slots that remain."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("head meta link base".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Share of a host's pages on which a token must stand exactly once to belong to its template.
SUPPORT = 0.5
#: Texts on nearly all of at least so many different pages of a host are part of the template, outside article and main.
FIXED_PAGES, FIXED_SHARE = 10, 0.9
_IN_ARTICLE = re.compile(r"(?:^|>)(?:article|main)(?:\.|>|$)")


@dataclass
class Block:
    path: str
    text: str
    aside: bool
    link_chars: int


@dataclass
class _Open:
    tag: str
    path: str
    aside: bool
    link: bool


@dataclass
class Page:
    tokens: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _label(tag: str, rest: str) -> tuple[str, bool]:
    """(name with classes and id, stands aside by its own words)."""
    attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
    names = (attributes.get("class", "") + " " + attributes.get("id", "")).lower()
    words = re.split(r"[^a-z0-9]+", names)
    aside = tag in ASIDE_TAGS or attributes.get("role", "").lower() in ASIDE_ROLES or not ASIDE_WORDS.isdisjoint(words)
    aside = aside or "hidden" in attributes.get("aria-hidden", "") or attributes.get("aria-hidden") == "true"
    return tag + "".join("." + w for w in sorted(set(names.split()))), aside


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """(places of `>` and quotes, where a tag ends that reaches such a place outside quotes): -1 where none ever does.

    Worked out once from the end of the page, so broken tags are not scanned again and again.
    """
    places = [m.start() for m in _SPECIAL.finditer(html)]
    ends = [-1] * (len(places) + 1)
    later = {'"': len(places), "'": len(places)}
    for i in range(len(places) - 1, -1, -1):
        sign = html[places[i]]
        if sign == ">":
            ends[i] = places[i]
        else:
            closing = later[sign]
            ends[i] = ends[closing + 1] if closing < len(places) else -1
            later[sign] = i
    return places, ends


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name or "", attributes) of tags, comments and declarations, in one walk over the page.

    The reader may send a later place to go on from. A `<` that starts none of these is text.
    """
    places, ends = _tag_ends(html)
    last = html.rfind(">")
    at = html.find("<")
    while 0 <= at:
        found = None
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            found = (at, len(html) if end < 0 else end + 3, "", "", "")
        elif at < last:
            named = _NAME.match(html, at)
            if named:
                end = ends[bisect_left(places, named.end())]
                if end >= 0:
                    found = (at, end + 1, named[1], named[2].lower(), html[named.end() : end])
            if not found and html[at + 1 : at + 2] in ("!", "?", "/"):
                found = (at, html.index(">", at) + 1, "", "", "")
            if not found and named:
                # The same holds for every `<` within the name, but for comments and declarations.
                inner = [i for i in (html.find("<!", at + 1, named.end()), html.find("<?", at + 1, named.end())) if i > 0]
                at = min(inner, default=html.find("<", named.end()))
                continue
        if found:
            at = html.find("<", (yield found) or found[1])
        else:
            at = html.find("<", at + 1)


def parse(html: str | None) -> Page:
    """Element paths in page order and blocks of text. Unclosed elements end where HTML lets them."""
    page = Page()
    html = html or ""
    stack = [_Open("", "", False, False)]
    words: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            holder = next((o for o in reversed(stack) if o.tag in BLOCK or not o.tag), stack[0])
            page.blocks.append(Block(holder.path, text, stack[-1].aside, links))
        links = 0

    def close_to(depth: int) -> None:
        if any(o.tag in BLOCK for o in stack[depth:]):
            flush()
        del stack[depth:]

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw)
            words.append(text)
            if stack[-1].link:
                links += len(text)

    last = html.rfind(">") + 1
    tags, go_on = _tags(html), None
    while True:
        try:
            start, end, close, tag, rest = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        add(html[at:start])
        at = end
        if not tag:
            continue
        if close:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close_to(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at, last)
                at = go_on = end.end() if end else len(html)
            continue
        if tag not in HEAD and (depth := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "head"), 0)):
            close_to(depth)
        if tag in BLOCK:
            flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if depth and not any(o.tag in BLOCK - {"p"} for o in stack[depth + 1 :]):
                close_to(depth)
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ends:
                    close_to(i)
                    break
        if tag in ("br", "hr", "img", "wbr"):
            words.append(" ")
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        label, aside = _label(tag, rest)
        above = stack[-1]
        inside_main = any(o.tag in ("article", "main") for o in stack)
        aside = above.aside or aside or tag == "header" and not inside_main
        path = f"{above.path}>{label}" if above.path else label
        page.tokens.append(path)
        stack.append(_Open(tag, path, aside, above.link or tag == "a"))
    # What looks like a tag that never ends is no text.
    rest = html[at:]
    cut = re.search(r"<[a-zA-Z/!?]", rest)
    add(rest[: cut.start()] if cut else rest)
    flush()
    return page


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 11)
    return value - (1 << 64) if value >> 63 else value


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, text, times, place, chars): how often each token stands on each page.

    `page` names a page by its content: copies of a page say nothing about a template and count once per host.

    A token is an element with its path (`token` is the path, `chars` the characters of text below it that stand
    neither aside nor in links) or a block of text with its path (`text` is its hash).
    """

    def per_batch(batch):
        out = {k: [] for k in ("host", "page", "token", "text", "times", "place", "chars")}
        for host, page_id, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = parse(html)
            seen: dict[tuple[str, int], list[int]] = {}
            for place, path in enumerate(page.tokens):
                seen.setdefault((path, 0), [0, place, 0])[0] += 1
            for block in page.blocks:
                if block.aside:
                    continue
                seen.setdefault((block.path, _hash(block.text)), [0, -1, 0])[0] += 1
                parts = block.path.split(">")
                for k in range(1, len(parts) + 1):
                    if (own := seen.get((">".join(parts[:k]), 0))) is not None:
                        own[2] += max(0, len(block.text) - block.link_chars)
            for (path, text), (times, place, chars) in seen.items():
                for k, v in zip(out, (host, page_id, path, text, times, place, chars), strict=True):
                    out[k].append(v)
        yield out

    keyed = pages.where("html is not null").select(_host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    return map_rows(keyed, per_batch, "host string, page long, token string, text long, times int, place int, chars long").dropDuplicates(
        ["host", "page", "token", "text"]
    )


def templates(tokens: DataFrame, pages_per_host: DataFrame) -> DataFrame:
    """(host, root, fixed): per host the path of the main slot and the hashes of fixed texts.

    Tokens with the same occurrence vector over the host's pages (compared by an xor of page and count) form an
    equivalence class. Classes that stand once on enough pages, in one order, are valid; they nest by their paths and
    make up the template. Text left in the slots between them is the pages' own. The main slot is the deepest template
    element that still holds nearly all of it. Counts are summed up before the shuffle, so a host may have any number
    of pages.
    """
    vectors = tokens.groupBy("host", "token", "text").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.max("times").alias("most"),
        F.min("place").alias("first"), F.max("place").alias("last"), F.sum("chars").alias("chars"), F.avg("place").alias("middle"),
    )
    supported = vectors.join(pages_per_host, "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    fixed = (
        supported.where((F.col("text") != 0) & (F.col("host_pages") >= FIXED_PAGES) & (F.col("pages") >= FIXED_SHARE * F.col("host_pages")))
        .groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("fixed"))
    )
    once = supported.where((F.col("text") == 0) & (F.col("most") == 1))
    # One class per occurrence vector. A class is ordered if no member stands before a path it is nested in.
    classes = once.groupBy("host", "pages", "vector").agg(F.count("*").alias("members"))
    nested = once.join(classes, ["host", "pages", "vector"]).where("members >= 2 or host_pages = 1")
    total = nested.groupBy("host").agg(F.max("chars").alias("all_chars"))
    depth = F.size(F.split("token", ">"))
    own_tag = F.regexp_extract("token", r"([^>.]*)[^>]*$", 1)
    holds = nested.join(total, "host").where(F.col("chars") >= 0.9 * F.col("all_chars")).withColumn(
        # An article or main element ends the descent: what it holds is the page's text as a whole.
        "rank", F.when(own_tag.isin("article", "main"), 1000 - depth).otherwise(depth)
    )
    inside_article = F.regexp_like("token", F.lit(r"(?:^|>)(?:article|main)(?:\.[^>]*)?>"))
    root = holds.where(~inside_article).groupBy("host").agg(F.max_by("token", F.struct("rank", "middle", "token")).alias("root"))
    return root.join(fixed, "host", "full_outer")


def slot_text(html: str | None, root: str | None, fixed: frozenset[int]) -> str:
    """The page's own text in the main slot; without that slot, in its article, main or body."""
    page = parse(html)
    blocks = [b for b in page.blocks if not b.aside]

    def within(path: str) -> list[Block]:
        return [b for b in blocks if b.path == path or b.path.startswith(path + ">")]

    chosen = within(root) if root and page.tokens.count(root) else []
    if not chosen:
        inner = [b for b in blocks if _IN_ARTICLE.search(b.path)]
        chosen = inner or blocks
    kept = [b.text for b in chosen if not (fixed and _hash(b.text) in fixed) or _IN_ARTICLE.search(b.path)]
    return "\n".join(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: one row per input row with page_id, url, text, n_chars, host.

    Blocks of text are joined by a line break; white space inside a block is one blank; character references are
    decoded. Elements that stand aside (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts,
    styles) are no text. Missing and empty pages give an empty text. Pages without a host, or with a missing url, are one
    host; a page that doesn't follow its host's template is read by its own structure. Pages
    of one content count once for the template, and every row gets its text. Texts inside article or main are never template.
    An empty table gives an empty result; other columns are ignored.
    """
    tokens = stored(page_tokens(pages))
    per_host = pages.where("html is not null").groupBy(_host(F.col("url")).alias("host")).agg(
        F.count_distinct(F.xxhash64("html")).alias("host_pages")
    )
    found = stored(templates(tokens, per_host))
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", _host(F.col("url")).alias("host"))

    def per_batch(batch):
        texts = []
        for html, root, fixed in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            texts.append(slot_text(html, root, frozenset(fixed or ())))
        yield {"page_id": batch.column(0), "url": batch.column(1), "host": batch.column(2), "text": texts, "n_chars": list(map(len, texts))}

    joined = keyed.join(found, "host", "left").select("page_id", "url", "host", "html", "root", "fixed")
    return map_rows(joined, per_batch, "page_id long, url string, host string, text string, n_chars long").select(
        "page_id", "url", "text", "n_chars", "host"
    )
