"""The only Python pass over pages: HTML text becomes arrays that native Spark functions read.

An Arrow UDF gets the `html` column alone (the other columns stay in the JVM) and returns one
struct per page: the elements in document order, the visible text and the JSON-LD objects. All
rules on top of it are column expressions, see `signals.py`.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.constants import REVIEW_BOX, SHELL_IDS, SOURCE_CONTAINER_CLASSES, SOURCE_CONTAINER_TAGS

# Attributes the rules read; everything else is dropped here.
ATTRIBUTES = frozenset(
    "action alt aria-label aria-labelledby cite class content datetime for href id itemprop "
    "itemtype name placeholder property rel role title type value".split()
)
# Elements whose text the rules read. `div` text is kept for leaves, any text beside an `h2`.
TEXT_TAGS = frozenset(
    "h1 h2 h3 h4 h5 h6 p li td th dd dt blockquote figcaption cite table form title caption "
    "summary strong b legend".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HEAD = frozenset("title meta link script style base noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search "
    "section summary table ul".split()
)
_CELLS = frozenset("table td th caption html template".split())
_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
# An opening tag ends these open elements, looking no further up than the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"} | _CELLS),
    "dt": ({"dt", "dd"}, {"dl"} | _CELLS),
    "dd": ({"dt", "dd"}, {"dl"} | _CELLS),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "button": ({"button"}, _CELLS),
}
# What may stand right inside a table, its sections and rows, and the elements a part goes back to.
_TABLE_INSIDES = frozenset("table thead tbody tfoot tr".split())
_FIT_TABLES = frozenset("caption colgroup col thead tbody tfoot tr td th style script template form".split())
_HOLDERS = {
    "caption": {"table"}, "colgroup": {"table"}, "col": {"colgroup", "table"}, "thead": {"table"}, "tbody": {"table"},
    "tfoot": {"table"}, "tr": {"thead", "tbody", "tfoot", "table"}, "td": _TABLE_INSIDES, "th": _TABLE_INSIDES,
}
# Elements that go on after a block cuts them off; those that never nest; those that keep outer ones from going on inside.
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_ONCE = frozenset("a nobr".split())
_MARKED = frozenset("td th caption object applet marquee template".split())
_SPECIAL = _BLOCK | _TABLE_PARTS | frozenset(
    "applet body button colgroup iframe marquee noframes noscript object script select style template textarea title".split()
)
_PLAIN = frozenset("iframe noframes noscript optgroup option script select style template textarea title".split())
_REOPENED = 32
# Where an element stands and who names it: bits of `flags`, set in the one walk over the page.
BELOW_CHROME, BELOW_SOURCE_TAG, BELOW_FORM, IN_SUP = 1, 2, 4, 8
IN_REVIEW, BELOW_SOURCE_BOX, LABELLED, REFERRED = 16, 32, 64, 128
_CHROME = frozenset("nav footer header aside".split())
_SOURCE_TAGS = frozenset(SOURCE_CONTAINER_TAGS)
_SOURCE_CLASSES = frozenset(SOURCE_CONTAINER_CLASSES)
_REVIEW = re.compile(REVIEW_BOX, re.ASCII)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# White space as in `functions.text.WS`.
_WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS_RUN = re.compile(f"[{_WS}]+")
_CONTROLS = frozenset("input select textarea button option".split())


def _place(above: dict | None, tag: str, attrs: dict) -> dict:
    """`flags` and `wrap` (the nearest label around) of a new element, from those of its parent."""
    flags, wrap = 0, None
    if above:
        flags = above["flags"] & ~IN_SUP
        up = above["tag"]
        flags |= BELOW_CHROME * (up in _CHROME) | BELOW_SOURCE_TAG * (up in _SOURCE_TAGS)
        flags |= BELOW_FORM * (up == "form") | IN_SUP * (up == "sup")
        if "class" in above["attrs"] and not _SOURCE_CLASSES.isdisjoint(_WS_RUN.split(above["attrs"]["class"])):
            flags |= BELOW_SOURCE_BOX
        wrap = above["id"] if up == "label" else above["wrap"]
    if ("class" in attrs or "id" in attrs) and _REVIEW.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
        flags |= IN_REVIEW
    return {"flags": flags, "wrap": wrap}


class _Element:
    """An element while the page is read. `children` holds elements and pieces of text."""

    __slots__ = ("tag", "attrs", "parent", "children", "is_open", "copied")

    def __init__(self, tag: str, attrs: dict, copied: bool = False) -> None:
        self.tag, self.attrs, self.parent, self.children, self.is_open, self.copied = tag, attrs, None, [], False, copied

    def again(self) -> _Element:
        return _Element(self.tag, self.attrs, True)

    def add(self, child: _Element | str, before: _Element | None = None) -> None:
        at = len(self.children)
        if before is not None:  # an open element is the last child or close to it
            while self.children[at - 1] is not before:
                at -= 1
            at -= 1
        self.children.insert(at, child)
        if isinstance(child, _Element):
            child.parent = self

    def detach(self) -> None:
        if self.parent is not None:
            siblings = self.parent.children
            del siblings[next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is self)]
            self.parent = None


class _Tree(HTMLParser):
    """Elements in document order; text pieces with their range per element.

    Misnested pages are repaired as browsers do. Formatting elements that a block or a wrong end tag cuts off go on in
    the next text (`active` lists them, with None where a cell or caption begins; at most _REOPENED go on, so that pages of
    nothing but unclosed elements stay linear). Text and elements that no table may hold move before the table.
    A `leaf` has no element of its own inside; formatting that only goes on in it doesn't count.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("html", {})
        self.body: _Element | None = None
        self.open: list[_Element] = []
        self.opened: Counter[str] = Counter()
        self.active: list[_Element | None] = []
        self.nodes: list[dict] = []
        self.pieces: list[str] = []
        self.shown: list[bool] = []
        self.body_node: dict | None = None
        self._push(self.root)

    def _push(self, element: _Element) -> None:
        self.open.append(element)
        element.is_open = True
        self.opened[element.tag] += 1

    def _pop_to(self, depth: int) -> None:
        for element in self.open[depth:]:
            element.is_open = False
            self.opened[element.tag] -= 1
            if element.tag in _MARKED:
                while self.active and self.active.pop() is not None:
                    pass
        del self.open[depth:]

    def _insert(self, child: _Element | str, into: _Element | None = None) -> None:
        """Put a child where it belongs: into the current (or a given) element, or before the table that can't hold it."""
        into = into or self.open[-1]
        if into.tag in _TABLE_INSIDES:
            if isinstance(child, str):
                fits = not child.strip()
            else:
                fits = child.tag in _FIT_TABLES or (child.tag == "input" and child.attrs.get("type", "").lower() == "hidden")
            table = None if fits else next((e for e in reversed(self.open) if e.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.add(child, before=table)
                return
        into.add(child)

    def _enter_body(self, attrs: dict | None = None) -> None:
        self._pop_to(1)
        self.body = _Element("body", attrs or {})
        self._insert(self.body)
        self._push(self.body)

    def _end_implied(self, closing, stop) -> None:
        if not any(self.opened[tag] for tag in closing):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in closing:
                self._pop_to(depth)
            elif tag in stop:
                return

    def _back_to_table(self, tag: str) -> None:
        """A part of a table ends all that is open inside the part it belongs to."""
        if self.opened["table"]:
            holders = _HOLDERS[tag]
            depth = len(self.open)
            while depth > 1 and self.open[depth - 1].tag not in holders:
                depth -= 1
            if depth > 1:
                self._pop_to(depth)

    def _go_on(self) -> None:
        """Open formatting elements again that were cut off, before text or inline content."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and not self.active[at - 1].is_open:
            at -= 1
        for i in range(at, len(self.active)):
            self.active[i] = self.active[i].again()
            self._insert(self.active[i])
            self._push(self.active[i])

    def _remember(self, element: _Element) -> None:
        since = next((i + 1 for i in range(len(self.active) - 1, -1, -1) if self.active[i] is None), 0)
        same = [i for i in range(since, len(self.active)) if self.active[i].tag == element.tag and self.active[i].attrs == element.attrs]
        if len(same) >= 3:
            del self.active[same[0]]
        elif len(self.active) - since >= _REOPENED:
            del self.active[since]
        self.active.append(element)

    def _remembered(self, tag: str) -> _Element | None:
        for element in reversed(self.active):
            if element is None or element.tag == tag:
                return element
        return None

    def _end_formatting(self, tag: str) -> bool:
        """End a formatting element. Blocks inside it move out and what they hold so far is formatted by a copy.

        False: none of that name is remembered, any end tag's rule applies.
        """
        if self.open[-1].tag == tag and self.open[-1] not in self.active:
            self._pop_to(len(self.open) - 1)
            return True
        for turn in range(8):
            ended = self._remembered(tag)
            if ended is None:
                return turn > 0
            if not ended.is_open:
                self.active.remove(ended)
                return True
            depth = len(self.open) - 1
            while self.open[depth] is not ended:
                if self.open[depth].tag in _CELLS:
                    return True
                depth -= 1
            block = next((i for i in range(depth + 1, len(self.open)) if self.open[i].tag in _SPECIAL), None)
            if block is None:
                self._pop_to(depth)
                self.active.remove(ended)
                return True
            furthest, above = self.open[block], self.open[depth - 1]
            place = self.active.index(ended)
            last, steps = furthest, 0
            for i in range(block - 1, depth, -1):
                steps += 1
                between = self.open[i]
                if steps > 3 and between in self.active:
                    at = self.active.index(between)
                    del self.active[at]
                    place -= at < place
                if between not in self.active:
                    self._leave(i)
                    continue
                copy = between.again()
                at = self.active.index(between)
                self.active[at], self.open[i] = copy, copy
                between.is_open, copy.is_open = False, True
                if last is furthest:
                    place = at + 1
                last.detach()
                copy.add(last)
                last = copy
            last.detach()
            self._insert(last, above)
            copy = ended.again()
            for child in furthest.children:
                if isinstance(child, _Element):
                    child.parent = copy
            copy.children, furthest.children = furthest.children, []
            furthest.add(copy)
            at = self.active.index(ended)
            self.active.insert(min(place, len(self.active)), copy)
            del self.active[at + (at >= place)]
            self._leave(depth)
            self.open.insert(self.open.index(furthest) + 1, copy)
            copy.is_open = True
            self.opened[tag] += 1
        return True

    def _leave(self, depth: int) -> None:
        element = self.open.pop(depth)
        element.is_open = False
        self.opened[element.tag] -= 1

    def handle_starttag(self, tag, attrs):
        kept: dict[str, str] = {}
        for name, value in attrs:
            if name in ATTRIBUTES:
                kept.setdefault(name, value or "")
        if tag == "html":
            if not self.root.attrs:
                self.root.attrs = kept
            return
        if tag == "body":
            if self.body is None:
                self._enter_body(kept)
            return
        if self.body is None:
            if tag == "head":
                return
            if tag not in _HEAD:
                self._enter_body()
        if tag == "form" and self.opened["form"]:
            return
        if tag in _BLOCK:
            self._end_implied({"p"}, _CELLS | {"button"})
        if tag in _HOLDERS:
            self._back_to_table(tag)
        if tag in _ENDS:
            self._end_implied(*_ENDS[tag])
        if tag in _HEADING and self.open[-1].tag in _HEADING:
            self._pop_to(len(self.open) - 1)
        element = _Element(tag, kept)
        if self.body is not None and not self.opened["select"]:
            if tag in _ONCE and (earlier := self._remembered(tag)):
                self._end_formatting(tag)
                if earlier in self.active:
                    self.active.remove(earlier)
                if earlier.is_open:
                    self._leave(self.open.index(earlier))
            if tag not in _SPECIAL and tag not in _HEAD or tag == "button":
                self._go_on()
        self._insert(element)
        if tag in _VOID:
            return
        self._push(element)
        if tag in _FORMATTING and self.body is not None:
            self._remember(element)
        elif tag in _MARKED:
            self.active.append(None)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "/>" means nothing on HTML elements

    def handle_endtag(self, tag):
        if tag in ("html", "body", "head"):
            return
        if tag in _FORMATTING and self._end_formatting(tag):
            return
        if not self.opened[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            here = self.open[depth].tag
            if here == tag:
                self._pop_to(depth)
                return
            if here == "body" or (here in _CELLS and tag not in _TABLE_PARTS):
                return
            if here in _BLOCK and tag not in _BLOCK and tag not in _TABLE_PARTS:
                return

    def handle_data(self, data):
        if self.body is None and len(self.open) == 1:
            if not data.strip():
                return
            self._enter_body()
        top = self.open[-1].tag
        if self.body is not None and top not in _PLAIN and (top not in _TABLE_INSIDES or data.strip()):
            self._go_on()
        self._insert(data)

    def finish(self) -> None:
        """Number the elements in document order and lay their text end to end."""
        self._pop_to(0)
        noscript = 0
        todo: list[tuple[_Element | str | None, dict | None]] = [(self.root, None)]
        while todo:
            item, above = todo.pop()
            if item is None:  # the end of an element
                above["end"] = len(self.pieces)
                noscript -= above["tag"] == "noscript"
            elif isinstance(item, str):
                tag = above["tag"]
                plain_script = tag == "script" and above["attrs"].get("type") != "application/ld+json"
                self.pieces.append(item)
                self.shown.append(not (tag == "style" or noscript or plain_script))
            else:
                node = {
                    "id": len(self.nodes), "parent": above["id"] if above else -1, "tag": item.tag, "attrs": item.attrs,
                    "start": len(self.pieces), "end": None, "leaf": True,
                    "copied": item.copied, **_place(above, item.tag, item.attrs),
                }
                holder = None if item.copied else above
                while holder:
                    holder["leaf"] = False
                    holder = self.nodes[holder["parent"]] if holder["copied"] else None
                if item is self.body:
                    self.body_node = node
                self.nodes.append(node)
                noscript += item.tag == "noscript"
                todo.append((None, node))
                todo += [(child, node) for child in reversed(item.children)]

    def text(self, node: dict, without: frozenset = frozenset()) -> str:
        if not without:
            return "".join(self.pieces[node["start"]:node["end"]])
        skip = set()
        for inner in self.nodes[node["id"] + 1:]:
            if inner["start"] >= node["end"]:
                break
            if inner["tag"] in without or inner["attrs"].get("role", "").lower() == "button":
                skip.update(range(inner["start"], inner["end"]))
        return "".join(
            self.pieces[i] for i in range(node["start"], node["end"]) if i not in skip
        )

    def visible(self, node: dict) -> str:
        return "".join(
            self.pieces[i] for i in range(node["start"], node["end"]) if self.shown[i]
        )


def _as_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _no_constant(name):
    raise ValueError(name)


def _parse_ld(raw: str) -> tuple[object, bool]:
    """(value, the parser gave up): NULL for text that isn't JSON, with one try without trailing commas."""
    gave_up = False
    for attempt in (raw, re.sub(r",(\s*[}\]])", r"\1", raw)):
        try:
            return json.loads(attempt, parse_constant=_no_constant), False
        except ValueError:
            continue
        except RecursionError:
            gave_up = True
    return None, gave_up


def _ld_object(value: dict) -> dict:
    kind = value.get("@type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    scalars: dict[str, str] = {}
    for key, item in value.items():
        if isinstance(item, dict):
            for inner, leaf in item.items():
                if leaf is not None and not isinstance(leaf, (dict, list)):
                    scalars[f"{key}.{inner}"] = _as_text(leaf)
        elif item is not None and not isinstance(item, list):
            scalars[key] = _as_text(item)
    same = value.get("sameAs")
    links = same if isinstance(same, list) else [same]
    return {
        "types": [_as_text(k) for k in kinds] if kind else None,
        "truthy": [k for k, v in value.items() if isinstance(v, (dict, list)) or v],
        "scalars": list(scalars.items()),
        "same_as": [x for x in links if isinstance(x, str)] if same else [],
    }


def _walk_ld(value, out: list[dict]) -> None:
    """One entry per object: `@graph` members first, then the object, then its members. Any depth."""
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        ready, item = todo.pop()
        if ready:
            out.append(_ld_object(item))
        elif isinstance(item, list):
            todo += [(False, x) for x in reversed(item)]
        elif isinstance(item, dict):
            inner = [x for k, x in item.items() if k != "@graph" and isinstance(x, (dict, list))]
            todo += [(False, x) for x in reversed(inner)]
            todo.append((True, item))
            if item.get("@graph"):
                todo.append((False, item["@graph"]))


def _name_controls(tree: _Tree) -> None:
    """Who names a form control: a label with its id, a label around it, texts it refers to."""
    spoken = {n["id"]: bool(tree.text(n, _CONTROLS).strip(_WS)) for n in tree.nodes if n["tag"] == "label"}
    wanted = {n["attrs"].get("for", "").strip(_WS) for n in tree.nodes if spoken.get(n["id"])}
    texts = {n["attrs"]["id"].strip(_WS) for n in tree.nodes if "id" in n["attrs"] and n["filled"]}
    for n in tree.nodes:
        if n["wrap"] is not None and not spoken[n["wrap"]]:
            n["wrap"] = None
        own = n["attrs"].get("id", "").strip(_WS)
        if own and own in wanted:
            n["flags"] |= LABELLED
        refers = n["attrs"].get("aria-labelledby", "").strip(_WS)
        if refers and not texts.isdisjoint(_WS_RUN.split(refers)):
            n["flags"] |= REFERRED


def _add_neighbours(tree: _Tree) -> None:
    """`head`: the heading before an element or, without text there, before its parent. `cite`: the first cite inside.
    `section`: the text between an h2 and the next one beside it."""
    last: dict[int, int] = {}
    before: list[int | None] = []
    running: dict[int, dict] = {}

    def worded(number: int | None) -> bool:
        return number is not None and bool(tree.nodes[number]["text"])

    for n in tree.nodes:
        parent = n["parent"]
        before.append(last.get(parent))
        own, above = before[-1], before[parent] if parent >= 0 else None
        n["head"] = own if worded(own) else above if worded(above) else None
        n["cite"] = n["section"] = None
        if n["tag"] in _HEADING:
            last[parent] = n["id"]
        if n["tag"] == "h2":
            n["section"] = []
            running[parent] = n
        elif parent in running and n["text"]:
            running[parent]["section"].append(n["text"])
        if n["tag"] == "cite":
            while parent >= 0 and tree.nodes[parent]["cite"] is None:
                tree.nodes[parent]["cite"] = n["id"]
                parent = tree.nodes[parent]["parent"]
    for n in tree.nodes:
        if n["section"] is not None:
            n["section"] = "".join(n["section"])


def shred_html(html: str) -> dict:
    """One page as a plain dict of the `_ARROW_PAGE` shape."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.finish()
    filled = [0]
    for piece in tree.pieces:
        filled.append(filled[-1] + bool(piece.strip()))
    beside_h2 = {n["parent"] for n in tree.nodes if n["tag"] == "h2"}
    ld, shells, gave_up = [], {}, False
    for n in tree.nodes:
        tag = n["tag"]
        wanted = tag in TEXT_TAGS or n["parent"] in beside_h2 or (tag == "div" and n["leaf"])
        n["text"] = tree.text(n) if wanted else None
        n["filled"] = filled[n["end"]] > filled[n["start"]]
        if tag == "script" and n["attrs"].get("type") == "application/ld+json":
            parsed, failed = _parse_ld(tree.text(n).strip())
            gave_up |= failed
            _walk_ld(parsed, ld)
        if n["attrs"].get("id") in SHELL_IDS:
            shells.setdefault(n["attrs"]["id"], []).append(tree.visible(n))
    _name_controls(tree)
    _add_neighbours(tree)
    body = tree.body_node or tree.nodes[0]
    visible = tree.visible(body) or tree.visible(tree.nodes[0])
    fields = [f.name for f in _ARROW_NODE]
    return {
        "visible": " ".join(visible.replace("\ufeff", " ").split()),
        "shell_lens": [len("".join(texts).strip()) for texts in shells.values()],
        "nodes": [{**{k: n[k] for k in fields}, "attrs": list(n["attrs"].items())} for n in tree.nodes],
        "ld": ld,
        "ld_error": gave_up,
    }


_TEXTS = pa.list_(pa.string())
_PAIRS = pa.map_(pa.string(), pa.string())
_ARROW_NODE = pa.struct([
    ("id", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", _PAIRS), ("text", pa.string()),
    ("filled", pa.bool_()), ("leaf", pa.bool_()), ("flags", pa.int32()), ("wrap", pa.int32()), ("head", pa.int32()),
    ("cite", pa.int32()), ("section", pa.string()),
])
_ARROW_PAGE = pa.struct([
    ("visible", pa.string()),
    ("shell_lens", pa.list_(pa.int32())),
    ("nodes", pa.list_(_ARROW_NODE)),
    ("ld", pa.list_(pa.struct([
        ("types", _TEXTS), ("truthy", _TEXTS), ("scalars", _PAIRS), ("same_as", _TEXTS),
    ]))),
    ("ld_error", pa.bool_()),
])


@F.arrow_udf(from_arrow_type(_ARROW_PAGE))
def shred(html: pa.Array) -> pa.Array:
    return pa.array(
        [shred_html(text or "") for text in html.to_pylist()], type=_ARROW_PAGE
    )


def shred_pages(pages: DataFrame, html: str = "html", out: str = "page") -> DataFrame:
    """Add the shredded page. Select `html` away afterwards."""
    return pages.withColumn(out, shred(F.col(html)))


def explode_nodes(shredded: DataFrame, key: str, page: str = "page") -> DataFrame:
    """The relational form: one row per page and element."""
    return shredded.select(key, F.inline(F.col(page)["nodes"]))
