"""The elements of a page from one scan of its normal form: place, depth, parent and siblings of each.

With that, selectors are tests on numbers, not copies of text: a child's parent, a sibling's neighbour, a descendant's
ancestor are looked up in arrays that are filled in page order. Every step of a selector takes time in proportion to the
number of elements. These are small helpers for Arrow functions; ``operators.elements`` applies them to page tables.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable

from pagemill.functions.markup import TAG, TAIL

# Elements without content, and elements whose start ends an open one of the same kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_KEEPS = frozenset("ul ol dl table select div section article td th li body".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = re.compile(rf"{TAG}<(/?)([a-zA-Z][^\s/>]*)({TAIL})")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'<>/=])([^\s"'<>/=]++)(?:[\t\n\r\f ]*+=[\t\n\r\f ]*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_MARKS = re.compile(f"{_TAG.pattern}|{TAG}")


class Outline:
    """Elements in page order as parallel lists; ``parent`` and ``previous`` (the sibling before) are -1 without one."""

    def __init__(self, canon: str):
        self.text = canon
        self.name: list[str] = []
        self.raw: list[str] = []
        self.start: list[int] = []
        self.inner: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.previous: list[int] = []
        self.place: list[int] = []
        self.children: list[int] = []
        self._scan(canon)

    def _scan(self, canon: str) -> None:
        stack: list[int] = []
        open_: dict[str, int] = {}
        last: dict[int, int] = {}

        def close(at: int) -> None:
            i = stack.pop()
            open_[self.name[i]] -= 1
            self.end[i] = at

        for m in _TAG.finditer(canon):
            name = m.group(2).lower()
            if m.group(1):
                if open_.get(name):
                    while self.name[stack[-1]] != name:
                        close(m.start())
                    close(m.end())
                continue
            ended = _ENDS.get(name, {"p"} if name in _BLOCK else ())
            while stack and ended and self.name[stack[-1]] in ended:
                close(m.start())
            if name in _ENDS and name != "p":  # an inline element left open inside the one before
                k = len(stack) - 1
                while k >= 0 and self.name[stack[k]] not in ended and self.name[stack[k]] not in _KEEPS:
                    k -= 1
                if k >= 0 and self.name[stack[k]] in ended:
                    while len(stack) > k:
                        close(m.start())
            i, up = len(self.name), stack[-1] if stack else -1
            self.name.append(name)
            self.raw.append(m.group(3))
            self.start.append(m.start())
            self.inner.append(m.end())
            self.end.append(m.end())
            self.parent.append(up)
            self.depth.append(len(stack))
            before = last.get(up, -1)
            self.previous.append(before)
            self.place.append(self.place[before] + 1 if before >= 0 else 1)
            self.children.append(0)
            if up >= 0:
                self.children[up] += 1
            last[up] = i
            if name not in VOID and not m.group(3).endswith("/>"):
                stack.append(i)
                open_[name] = open_.get(name, 0) + 1
        while stack:
            close(len(canon))

    def __len__(self) -> int:
        return len(self.name)

    @functools.cached_property
    def roots(self) -> int:
        return sum(p < 0 for p in self.parent)

    @functools.cached_property
    def _attributes(self) -> dict[int, dict[str, str]]:
        return {}

    def attributes(self, i: int) -> dict[str, str]:
        """Attributes of an element, names in lower case; of a repeated name the first counts."""
        known = self._attributes.get(i)
        if known is None:
            known = {}
            for m in _ATTRIBUTE.finditer(self.raw[i].rstrip("/>")):
                value = m.group(2) or ""
                known.setdefault(m.group(1).lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
            self._attributes[i] = known
        return known

    def classes(self, i: int) -> list[str]:
        return self.attributes(i).get("class", "").split()

    def outer(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def words(self, start: int, end: int) -> str:
        """Text between two places on one line."""
        return " ".join(html.unescape(_MARKS.sub(" ", self.text[start:end])).split())


# --- selectors ------------------------------------------------------------------------------

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_SIMPLE = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\#(?P<id>[\w\u0080-\U0010ffff-]+)|\.(?P<cls>{_NAME})"""
    rf"""|\[\s*(?P<key>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<w>[^\s\]"']+))\s*)?\]"""
    r"""|:(?P<pseudo>first-child|last-child|only-child|empty)(?![\w(-])|:nth-child\(\s*(?P<nth>odd|even|[+-]?\d*n(?:\s*[+-]\s*\d+)?|\+?\d+)\s*\)|:not\((?P<no>[^()]*(?:\([^()]*\)[^()]*)?)\)"""
)
_JOIN = re.compile(r"\s*([>+~])\s*|\s+")

Test = Callable[[Outline, int], bool]


class Unsupported(ValueError):
    """A selector, or a member of its list, that isn't understood."""


def _attribute_test(key: str, op: str | None, value: str) -> Test:
    key = key.lower()
    tests = {
        None: lambda v: True, "=": lambda v: v == value, "~=": lambda v: value in v.split(), "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: value != "" and v.startswith(value), "$=": lambda v: value != "" and v.endswith(value), "*=": lambda v: value != "" and value in v,
    }
    said = tests[op]
    return lambda o, i: key in (a := o.attributes(i)) and said(a[key])


def _nth(text: str) -> Test:
    text = {"odd": "2n+1", "even": "2n"}.get(text, re.sub(r"\s", "", text))
    step, n, rest = text.partition("n")
    if not n:
        return lambda o, i: o.place[i] == int(step)
    a, b = int(step + "1" if step in ("", "+", "-") else step), int(rest or 0)
    return lambda o, i: o.place[i] == b if a == 0 else (o.place[i] - b) % a == 0 and (o.place[i] - b) // a >= 0


def _last(o: Outline, i: int) -> bool:
    return o.place[i] == (o.children[o.parent[i]] if o.parent[i] >= 0 else o.roots)


_PSEUDO: dict[str, Test] = {
    "first-child": lambda o, i: o.place[i] == 1, "last-child": _last, "only-child": lambda o, i: o.place[i] == 1 and _last(o, i),
    "empty": lambda o, i: not o.children[i] and not o.words(o.inner[i], o.end[i]),
}


def _compound(text: str) -> Test:
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or (m.group("tag") and at):
            raise Unsupported(text)
        g = m.groupdict()
        if g["tag"]:
            tests.append((lambda o, i, n=g["tag"].lower(): o.name[i] == n) if g["tag"] != "*" else lambda o, i: True)
        elif g["id"]:
            tests.append(lambda o, i, v=g["id"]: o.attributes(i).get("id") == v)
        elif g["cls"]:
            tests.append(lambda o, i, v=g["cls"]: v in o.classes(i))
        elif g["key"]:
            tests.append(_attribute_test(g["key"], g["op"], next((x for x in (g["q"], g["a"], g["w"]) if x is not None), "")))
        elif g["nth"]:
            tests.append(_nth(g["nth"]))
        elif g["no"] is not None:
            no = [_compound(x.strip()) for x in g["no"].split(",")]
            tests.append(lambda o, i, no=no: not any(t(o, i) for t in no))
        else:
            tests.append(_PSEUDO[g["pseudo"]])
        at = m.end()
    if not tests:
        raise Unsupported(text)
    return lambda o, i: all(t(o, i) for t in tests)


def _split(text: str, cut: re.Pattern) -> list[str]:
    """Parts between matches of ``cut`` outside brackets and quotes, and the matches."""
    parts, last, at, deep, quote = [], 0, 0, 0, ""
    while at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            deep += 1
        elif c in ")]":
            deep -= 1
        elif not deep and (m := cut.match(text, at)):
            parts += [text[last:at], m.group()]
            last = at = m.end()
            continue
        at += 1
    return [*parts, text[last:]]


@functools.lru_cache(maxsize=512)
def compiled(selector: str) -> list[list[tuple[str, Test]]]:
    """Members of a selector list, each as steps of a combinator and a test. Raises ``Unsupported``, never skips."""
    out = []
    for member in _split(selector, re.compile(","))[::2]:
        parts = _split(member.strip(), _JOIN)
        steps = [(j.strip() or " ", _compound(c)) for j, c in zip([" ", *parts[1::2]], parts[::2], strict=True)]
        out.append(steps)
    return out


def matches(o: Outline, steps: list[tuple[str, Test]]) -> list[int]:
    """Elements that one member of a list selects, in page order."""
    hit: list[bool] | None = None
    for join, test in steps:
        n, now, via = len(o), [False] * len(o), [False] * len(o)
        for i in range(n):
            up, before = o.parent[i], o.previous[i]
            if hit is None:
                reach = True
            elif join == ">":
                reach = up >= 0 and hit[up]
            elif join == "+":
                reach = before >= 0 and hit[before]
            else:
                source = up if join == " " else before
                reach = via[i] = source >= 0 and (hit[source] or via[source])
            now[i] = reach and test(o, i)
        hit = now
    return [i for i, x in enumerate(hit or ()) if x]


def select(o: Outline, selector: str) -> list[int]:
    """Elements of the first member of the list that selects any."""
    for steps in compiled(selector):
        found = matches(o, steps)
        if found:
            return found
    return []


# --- lists ----------------------------------------------------------------------------------

#: Members of a list at least, and the share of them that must have a tag path for it to be part of the record.
LEAST_ITEMS, SHARED = 3, 0.6
_ASIDE = frozenset("nav header footer aside".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DATE = re.compile(r"\d{4}[-/.年]\s?\d{1,2}[-/.月]\s?\d{1,2}|\d{1,2}[-/. ][A-Za-z]{3,9}[-/. ,]+\d{4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}|\d{1,2}[./]\d{1,2}[./]\d{4}")


def _below(o: Outline, i: int) -> range:
    """An element and what it holds: elements stand in page order, so these are in a row."""
    j = i + 1
    while j < len(o) and o.depth[j] > o.depth[i]:
        j += 1
    return range(i, j)


def _record(o: Outline, i: int, linked: list[int]) -> dict | None:
    """Title, link, preview and date of a list's member; none without a link that has text."""
    link_of, head_of = {}, {}  # the nearest link and heading around an element, itself included
    links, headed, date, preview = [], [], None, ""
    for j in _below(o, i):
        name, up = o.name[j], o.parent[j]
        attributes = o.attributes(j)
        usable = name == "a" and attributes.get("href", "").strip() != ""
        link_of[j] = j if usable else link_of.get(up, -1)
        head_of[j] = j if name in _HEADINGS else head_of.get(up, -1)
        if usable and (said := o.words(o.inner[j], o.end[j])):
            links.append((j, said))
            if head_of[j] >= 0:
                headed.append((j, o.words(o.inner[head_of[j]], o.end[head_of[j]])))
        elif name in _HEADINGS and link_of[j] >= 0 and (said := o.words(o.inner[j], o.end[j])):
            headed.append((link_of[j], said))
        if linked[j] or link_of[j] >= 0 or head_of[j] >= 0 or (o.children[j] and name not in ("p", "time", "span")):
            continue
        said = o.words(o.inner[j], o.end[j])
        stamp = attributes.get("datetime") if name == "time" else None
        if stamp or (len(said) <= 40 and (found := _DATE.search(said))):
            date = date or stamp or found.group()
        elif len(said) > len(preview):
            preview = said
    if not links:
        return None
    link, title = headed[0] if headed else max(links, key=lambda x: len(x[1]))
    return {"title": title, "href": o.attributes(link)["href"].strip(), "preview": preview or None, "date": date}


def _signature(o: Outline, i: int) -> tuple:
    return (o.name[i], *sorted(c for c in o.classes(i) if not any(x.isdigit() for x in c) and c not in ("first", "last", "odd", "even", "active")))


def mined(o: Outline) -> list[dict]:
    """The records of a page's most regular list, in page order.

    Siblings of one tag and class form a group. Groups in navigation, header, footer and aside regions are left out. A
    group weighs as much as its members' text, links counting a quarter, times the share of tag paths that most members have.
    """
    groups: dict[tuple, list[int]] = {}
    aside, linked = [False] * len(o), [0] * len(o)
    for i in range(len(o)):
        up = o.parent[i]
        aside[i] = o.name[i] in _ASIDE or (up >= 0 and aside[up])
        if not aside[i] and o.name[i] not in ("a", "option", "td", "th"):
            groups.setdefault((up, *_signature(o, i)), []).append(i)
    for i in range(len(o) - 1, -1, -1):  # does it hold a link?
        linked[i] += o.name[i] == "a"
        if o.parent[i] >= 0:
            linked[o.parent[i]] += linked[i]
    best, weight = [], 0.0
    for members in groups.values():
        members = [i for i in members if linked[i]]
        if len(members) < LEAST_ITEMS:
            continue
        size, paths, known = 0.0, [], {}  # a tag path is its parent's number and a name
        for i in members:
            path, here = {}, set()
            text, links = len(o.words(o.inner[i], o.end[i])), 0
            for j in _below(o, i):
                path[o.depth[j]] = known.setdefault((path.get(o.depth[j] - 1, -1) if j > i else -1, o.name[j]), len(known))
                here.add(path[o.depth[j]])
                if o.name[j] == "a":
                    links += len(o.words(o.inner[j], o.end[j]))
            size += min(max(text - links, 0), 400) + min(links, 200) / 4
            paths.append(here)
        every = set().union(*paths)
        often = sum(sum(p in x for x in paths) >= SHARED * len(paths) for p in every)
        if size * often / len(every) > weight:
            best, weight = members, size * often / len(every)
    return [r for r in (_record(o, i, linked) for i in best) if r]
