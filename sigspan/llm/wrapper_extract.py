"""Main text of web pages by union-free wrappers of templates (operator 1).

Pages of a host come from templates. The wrapper of a template is a union-free regular
expression over tags and text: sequences, optional groups and repeated groups, text
slots and constant texts. It is found by aligning token streams, page by page (`align`):

* text that differs at the same place becomes a slot;
* tags that fail to match are first tried as one more round of a repeated group
  (a group that stands beside a copy of itself);
* what is still unmatched on either side becomes optional, element by element; an
  element that the same gap already offers joins it there, so a wrapper grows with the
  kinds of elements of a template and not with its pages.

A template is named by the path of its article or, without one, by the two top levels.
All distinct pages of a template are aligned: groups of `GROUP` pages, in the order of
their digests, each give a wrapper, groups of `GROUP` wrappers the next one, until one
is left. No task holds more than a group, and reruns give the same wrapper.

What the wrapper decides: a constant text that at least `LEAST_PAGES` pages have goes,
optional or not, outside of articles and in them, as long as the template's articles
have a slot left; a slot stays even if an ambiguous word of its class or id speaks
against it. A place of the wrapper is known by the path of its text; a path with slots
in an article keeps its constants, since they are part of what varies there. Marks decide alone where an
element has an unambiguous one: made for menus, headers, footers, sidebars, adverts,
forms, scripts, styles or comments by its name, role or an unmistakable word.
Everything outside an article goes if the page has one. Where the wrapper has
nothing, ambiguous words drop text outside of articles and nothing in them. Where
words would leave nothing of a page without an article, only names and roles count.

A page is read whole: for its stream, for its template's name, and with its
template's rules, which are joined by host and template. Nothing is sampled.

Defined cases: a null html gives an empty text; a page cut short gives its text up to
the cut, an unfinished tag is markup; a null url is a host of its own; repeated rows
give equal texts and are aligned once; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.llm.common import batches, release, small_batches, stored
from sigspan.session import shuffle_partitions

LEAST_PAGES = 3  #: distinct pages that must have a text before the wrapper calls it constant
GROUP = 64  #: pages, or wrappers, that are aligned in one step
MOST_CHILDREN = 24  #: of an element, that are aligned one by one

# Element names and marks of page regions.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "select", "xmp"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note"}
MARKS = set(
    "ad ads advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer discussion disqus footer form gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promoted recommended related replies respond responses search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toc toolbar topbar widget".split()
)
#: Of these, the words and pairs of words that mean the same within an article. The others are also sections, lists
#: and boxes of articles (a paper's discussion, a restaurant's menu), where they decide nothing.
CERTAIN = set("ad ads advert adverts advertisement sponsored promo promoted comment comments commentlist disqus respond replies newsletter signup subscribe gdpr paywall".split())
CERTAIN_PAIRS = [({"cookie", "cookies"}, {"banner", "bar", "consent", "notice", "popup"}), ({"header"}, {"article", "entry", "page", "post", "site"})]
MAIN = {"article", "main"}
_NOT_THE_ARTICLE = {"ad", "ads", "advert", "comment", "comments", "promo", "related", "reply", "sponsored"}
CLOSES_P = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}  #: a start tag of the name ends an open element of it

# Attributes as the HTML standard's tokeniser reads them: a quote opens a value only right after `=`; elsewhere it
# is part of a name or of an unquoted value, and the tag ends at the next `>`.
_WS = r"[\t\n\f\r ]"
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r >\"'][^\t\n\f\r >]*+"
_NAMED = rf"[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_WS}*+={_WS}*+(?:{_VALUE})?+)?+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\t\n\f\r />]*)(?P<rest>(?:[\t\n\f\r /]|{_NAMED})*+)(?P<closed>>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(rf"([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{_WS}*+={_WS}*+({_VALUE})?+)?+", re.S)


def attributes_of(rest: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of several with one name the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        quote = value[:1]
        if quote in ('"', "'"):
            value = value[1:].removesuffix(quote)
        found.setdefault(name.lower(), value)
    return found


def marked(name: str, rest: str) -> str:
    """An element's part of a path; `!!` if it is made for something other than the article, `!` if its class
    or id says so, `?` if they say so outside of articles only."""
    attributes = attributes_of(rest) if "=" in rest else {}
    words = set(re.split(r"[^a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    marks = {"html": set(), "body": set(), "main": set(), "article": _NOT_THE_ARTICLE}.get(name, MARKS)
    certain = name == "article" or words & CERTAIN or any(words & a and words & b for a, b in CERTAIN_PAIRS)
    drop = "!" if words & marks and certain else "?" if words & marks else ""
    drop = "!!" if name in DROPPED or attributes.get("role", "").lower() in ROLES else drop
    kind = ".".join(sorted(w for w in words if w and not w.isdigit()))
    main = attributes.get("role", "").lower() == "main" and name not in MAIN
    return f"{'main:' if main else ''}{name}{'.' + kind if kind else ''}{drop}"


def blocks(page: str) -> Iterator[tuple[str, str | tuple[str, ...]]]:
    """The stream of a page: ("start", path), ("end", path) and ("text", (path, raw text)).

    Only block elements have a place in the path; inline ones leave the text whole.
    """
    path: list[str] = []
    names: list[str] = []
    at, skip = 0, None
    pending: list[str] = []

    def flush():
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                yield "text", (tuple(path), text)

    while at < len(page):
        if skip:  # raw content: only its own end tag counts
            end = re.compile(rf"</{re.escape(skip)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at, skip = (end.start() if end else len(page)), None
            continue
        found = _TOKEN.search(page, at)
        if not found:
            pending.append(references.unescape(page[at:]))
            break
        if found.start() > at:
            pending.append(references.unescape(page[at : found.start()]))
        at = found.end()
        name = (found["name"] or "").lower()
        if not name or name in INLINE or not found["closed"]:
            continue
        if name in RAW:
            if not found["end"] and not found["rest"].endswith("/"):
                skip = name
            continue
        if name == "br":
            pending.append(" ")
            continue
        yield from flush()
        if name in VOID:
            continue
        if found["end"]:
            if name in names:
                while names:
                    last = names.pop()
                    yield "end", tuple(path)
                    path.pop()
                    if last == name:
                        break
            continue
        # an open paragraph ends with the next block, an item or cell with the next one
        while names and (names[-1] == "p" or names[-1] == name and name in CLOSES_P):
            yield "end", tuple(path)
            names.pop()
            path.pop()
        names.append(name)
        path.append(marked(name, found["rest"]))
        yield "start", tuple(path)
    yield from flush()


# Wrapper nodes are tuples: ("tag", sign), ("plus", body), ("opt", body), bodies being tuples of nodes, and
# ("text", address, hashes of the values that all pages show, whether it varies, pages that have it).


def stream(events: list) -> tuple:
    """A page's stream as wrapper nodes, without what marks drop anyhow.

    A child like the one before it makes a repeated group with it. An element of more
    than `MOST_CHILDREN` children keeps one repeated group for each kind of child.
    """
    frames: list[list[tuple]] = [[]]  # the bodies of the children of each open element
    tags: list[str] = []

    def add(child: tuple) -> None:
        children = frames[-1]
        if children and _kind(children[-1]) == _kind(child):
            children[-1] = _repeated(children[-1], child)
        else:
            children.append(child)

    def close() -> None:
        children, tag = frames.pop(), tags.pop()
        body = (n for child in _by_kind(children) for n in child)
        add((("tag", "<" + tag), *body, ("tag", ">" + tag)))

    for kind, value in events:
        path = value[0] if kind == "text" else value
        if dropped(path, ("!",)):
            continue
        if kind == "text":
            add((("text", address(path), (hashed(value[1]),), 0, 1),))
        elif kind == "start":
            frames.append([])
            tags.append(address(path).rsplit("/", 1)[-1])
        elif tags:
            close()
    while tags:
        close()
    return tuple(n for child in _by_kind(frames[0]) for n in child)


def _by_kind(children: list[tuple]) -> Iterable[tuple]:
    if len(children) <= MOST_CHILDREN:
        return children
    found: dict[tuple, tuple] = {}
    for child in children:
        kind = _kind(child)
        found[kind] = _repeated(found[kind], child) if kind in found else child
    return found.values()


def _repeated(a: tuple, b: tuple) -> tuple:
    both = _united(a, b, False)
    return both if both[0][0] == "plus" else (("plus", both),)


def sign(node) -> tuple:
    """What two nodes must share to match: tags their sign, texts only their place."""
    if node[0] == "tag":
        return node
    if node[0] == "text":
        return node[:2]
    return (node[0], tuple(sign(n) for n in node[1]))


def matches(a: tuple, b: tuple) -> bool:
    return len(a) == len(b) and all(sign(x) == sign(y) for x, y in zip(a, b))


def merge(a: tuple, b: tuple, pages: bool) -> tuple:
    """Two matching groups as one: of different pages, or rounds of one page.

    Rounds show the values of both. Of pages only common values are constants, and a
    text whose values differ is a slot.
    """
    found = []
    for x, y in zip(a, b):
        if x[0] == "tag":
            found.append(x)
        elif x[0] != "text":
            found.append((x[0], merge(x[1], y[1], pages)))
        elif pages:
            common = x[2] if x[2] == y[2] else tuple(sorted(set(x[2]) & set(y[2])))
            found.append(("text", x[1], common, int(x[3] or y[3] or x[2] != y[2]), x[4] + y[4]))
        else:
            values = x[2] if x[2] == y[2] else tuple(sorted(set(x[2]) | set(y[2])))
            found.append(("text", x[1], values, int(x[3] or y[3]), max(x[4], y[4])))
    return tuple(found)


def elements(nodes: tuple) -> Iterator[tuple]:
    """Whole elements and texts of a sequence, one by one; what is not whole stays together."""
    depth, begin = 0, 0
    for i, node in enumerate(nodes):
        if node[0] == "tag":
            depth += 1 if node[1][0] == "<" else -1
        if depth < 0:
            break
        if not depth:
            yield nodes[begin : i + 1]
            begin = i + 1
    if begin < len(nodes):
        yield nodes[begin:]


def _kind(body: tuple) -> tuple:
    """Bodies that can be one: elements with the same tag, texts at the same place; repeated or single."""
    inner = body[0][1] if len(body) == 1 and body[0][0] == "plus" else body
    return sign(inner[0]) if inner[0][0] in ("tag", "text") else tuple(map(sign, inner))


def _united(a: tuple, b: tuple, pages: bool) -> tuple:
    """Two bodies of one kind: repeated if either is."""
    plus = any(len(x) == 1 and x[0][0] == "plus" for x in (a, b))
    both = align(*(x[0][1] if len(x) == 1 and x[0][0] == "plus" else x for x in (a, b)), pages)
    return (("plus", both),) if plus else both


def gathered(options: list[tuple[tuple, bool]], pages: bool) -> list:
    """Optional nodes of one gap from (body, of the page) pairs: one for each kind of element."""
    sides: tuple[dict, dict] = {}, {}
    for body, of_page in options:
        for element in elements(body):
            side, kind = sides[of_page], _kind(element)
            side[kind] = _united(side[kind], element, False) if kind in side else element
    ours, theirs = sides
    for kind, element in theirs.items():
        ours[kind] = _united(ours[kind], element, pages) if kind in ours else element
    return [("opt", body) for body in ours.values()]


def _flat(wrapper: tuple) -> list[tuple[tuple, int | None]]:
    """(node, the optional group it stands in) of a wrapper."""
    nodes: list = []
    for i, node in enumerate(wrapper):
        nodes += [(n, i) for n in node[1]] if node[0] == "opt" else [(node, None)]
    return nodes


def align(wrapper: tuple, page: tuple, pages: bool = True) -> tuple:
    """The wrapper generalised so that it also accepts the page, or all that another wrapper accepts.

    pages: whether the two are of different pages, or rounds of one page.
    """
    if matches(wrapper, page):
        return merge(wrapper, page, pages)
    ours, theirs = _flat(wrapper), _flat(page)
    found: list = []  # (node, the optional group it stands in or None, whether of the page alone)
    matcher = SequenceMatcher(None, [sign(n) for n, _ in ours], [sign(n) for n, _ in theirs], autojunk=False)
    for kind, a, b, c, d in matcher.get_opcodes():
        if kind == "equal":
            for (x, mine), (y, other) in zip(ours[a:b], theirs[c:d]):
                group = ("ours", mine) if mine is not None else ("theirs", other) if other is not None else None
                found.append((merge((x,), (y,), pages)[0], group, False))
            continue
        left, more = ours[a:b], tuple(n for n, _ in theirs[c:d])
        # repeated on one side and single on the other: the group stays repeated
        at = next((i for i, (n, _) in enumerate(left) if n[0] == "plus" and matches(n[1], more)), None)
        single = tuple(n for n, _ in left)
        again = next((n for n in more if n[0] == "plus" and single and matches(n[1], single)), None)
        if at is not None:
            joined = ("plus", merge(left[at][0][1], more, pages))
            left = [(joined if i == at else n, g) for i, (n, g) in enumerate(left)]
            found += [(n, ("ours", g) if g is not None else None if i == at else ("absent", a), False) for i, (n, g) in enumerate(left)]
            continue
        if again is not None:
            found.append((("plus", merge(again[1], single, pages)), ("ours", left[0][1]) if left[0][1] is not None else None, False))
            more, left = tuple(n for n in more if n is not again), []
        found += [(n, ("ours", g) if g is not None else ("absent", a), False) for n, g in left]
        found += [(n, ("more", c), True) for n in more]
    result: list = []
    for inside, nodes in groupby(found, key=lambda x: x[1] is not None):
        if not inside:
            result += [n for n, _, _ in nodes]
            continue
        options = [(tuple(n for n, _, _ in body), key[1]) for key, body in groupby(nodes, key=lambda x: (x[1], x[2]))]
        result += gathered(options, pages)
    return tuple(result)


def infer(streams: Iterable[tuple]) -> tuple:
    """The wrapper of the streams, or wrappers, of one template."""
    wrapper: tuple = ()
    for i, other in enumerate(streams):
        wrapper = align(wrapper, other) if i else other
    return wrapper


def texts_of(wrapper: tuple) -> Iterator[tuple[str, tuple, int, int]]:
    """(address, constants, whether it varies, pages) of every text of a wrapper."""
    for node in wrapper:
        if node[0] == "text":
            yield node[1:]
        elif node[0] in ("plus", "opt"):
            yield from texts_of(node[1])


def in_article(path: tuple) -> bool:
    return any(p.split(".")[0].rstrip("!?") in MAIN or p.startswith("main:") for p in path)


def dropped(path: tuple, marks: tuple = ("!", "?")) -> bool:
    """Whether an element of the path is marked, with `?` outside of articles only; a header within one keeps its headings."""
    for i, part in enumerate(path):
        if part.endswith(marks) and not (part.endswith("?") and in_article(path[:i])):
            heading = "header" in part.rstrip("!").split(".") and re.match(r"h[1-6]\b", path[-1])
            if not (heading and in_article(path[:i])):
                return True
    return False


def address(path: tuple) -> str:
    """A path's name in the wrapper: classes of html and body often name the page, not the template."""
    return "/".join(p.split(".")[0].rstrip("!?") if p.split(".")[0] in ("html", "body") else p for p in path)


def hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def template_of(events: list) -> str:
    """The name of a page's template: the path of its first article, or else what stands on its first two levels."""
    starts = [v for k, v in events if k == "start"]
    main = next((v for v in starts if in_article(v) and not dropped(v)), None)
    tops = [main] if main else [v for v in starts if len([p for p in v if p.split(".")[0].rstrip("!?") not in ("html", "body")]) <= 2]
    return format(hashed("\n".join(sorted({address(v) for v in tops}))) & (1 << 64) - 1, "016x")


def rules_of(wrapper: tuple) -> dict:
    """What a template's wrapper decides: constant texts by address, and addresses outside articles with slots."""
    constants: dict[str, set[int]] = {}
    varied, slots = set(), set()
    for name, common, varies, pages in texts_of(wrapper):
        if varies:
            varied.add(name)
        if pages >= LEAST_PAGES:
            if varies:
                slots.add(name)
            if common:
                constants.setdefault(name, set()).update(common)
    inside = {name for name in (*constants, *slots) if in_article(tuple(name.split("/")))}
    # an article without any slot is a copy, not a template's text
    varies = bool(slots & inside)
    fixed = {name: sorted(values) for name, values in constants.items() if name not in inside or varies and name not in varied}
    return {"fixed": fixed, "slots": sorted(slots - inside)}


class Rules:
    """The rules of a template, ready to read its pages; of an unknown template, none."""

    def __init__(self, rules: dict):
        self.fixed = {name: frozenset(values) for name, values in rules.get("fixed", {}).items()}
        self.slots = frozenset(rules.get("slots", ()))

    def kept(self, events: list) -> list[tuple[tuple, str]]:
        """The texts that stay: what the wrapper says, and where it has nothing, what the marks say."""
        found = []
        for path, text in (v for k, v in events if k == "text"):
            name = address(path)
            if dropped(path, ("!",)) or dropped(path) and name not in self.slots:
                continue
            if name in self.fixed and hashed(text) in self.fixed[name]:
                continue
            found.append((path, text))
        return found


def main_text(page: str, rules: Rules) -> str:
    """The text of the article, blocks joined by one space."""
    return text_of(list(blocks(page)), rules)


def text_of(events: list, rules: Rules) -> str:
    """`main_text` of a page's stream."""
    kept = rules.kept(events)
    inside = [text for path, text in kept if in_article(path)]
    if inside or any(k == "start" and in_article(v) and not dropped(v) for k, v in events):
        return " ".join(inside)
    if not kept and not any(k == "text" and not dropped(v[0]) for k, v in events):
        # a frame around the whole page may be named after what stands in it
        kept = [v for k, v in events if k == "text" and not dropped(v[0], ("!!",))]
    return " ".join(text for _, text in kept)


@lru_cache(maxsize=4096)
def _parsed(rules: str | None) -> Rules:
    return Rules(json.loads(rules) if rules else {})


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_STREAM = "host string, template string, page binary, wrapper binary"


def _tuples(value):
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


def _dumped(value) -> str:
    return json.dumps(value, separators=(",", ":"))


def _streams(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream and the template of every page."""
    for batch in arrow:
        for part in batches(batch, "html"):
            pages = [list(blocks(h)) for h in part.column("html").to_pylist()]
            columns = [part.column("host"), pa.array(map(template_of, pages), pa.string()), part.column("page")]
            columns.append(pa.array([_dumped(stream(events)).encode() for events in pages], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["host", "template", "page", "wrapper"])
    release()


def _inferred(group: pa.Table) -> pa.Table:
    """One wrapper of a group of at most some GROUP of them, in the order of their names."""
    group = group.sort_by("page")
    wrappers = (_tuples(json.loads(data.as_py())) for data in group.column("wrapper"))
    wrapper = _dumped(infer(wrappers)).encode()
    return pa.table({
        "host": group.column("host")[:1], "template": group.column("template")[:1], "page": group.column("page")[:1],
        "wrapper": pa.array([wrapper], pa.binary()),
    })


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, wrapper) from all distinct pages of each template.

    Each level deals the wrappers of a template into groups of about GROUP by their
    names' hashes and leaves one of each; their number falls to one in a few levels.
    """
    known = small_batches(pages).where("html is not null")
    known = known.select(_host().alias("host"), F.unhex(F.md5("html")).alias("page"), "html").mapInArrow(_streams, _STREAM)
    found = stored(known.dropDuplicates(["host", "page"]), "wrapper-streams")  # copies of a page are aligned once
    key = ["host", "template"]
    while True:
        sizes = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        most = sizes.agg(F.max("_n")).first()[0] or 0
        if most <= 1:
            return found.select(*key, "wrapper")
        groups = F.ceil(F.col("_n") / GROUP)
        dealt = found.join(sizes, key).withColumn("_group", F.pmod(F.xxhash64("page"), groups))
        # dealt anew: the join may have left all groups of a template in one place
        dealt = dealt.select(*found.columns, "_group").repartition(shuffle_partitions(pages.sparkSession), *key, "_group")
        found = stored(dealt.groupBy(*key, "_group").applyInArrow(_inferred, _STREAM), "wrappers")


@lru_cache(maxsize=256)
def _parsed(rules: str | None) -> Rules:
    return Rules(json.loads(rules) if rules else {})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = small_batches(pages.select("page_id", "url", "html"))

    @F.pandas_udf("string")
    def ruled(column: pd.Series) -> pd.Series:
        return column.map(lambda w: _dumped(rules_of(_tuples(json.loads(w)))))

    @F.pandas_udf("template string, text string")
    def read(column: pd.Series) -> pd.DataFrame:
        """The template, and the text as it is where the wrapper has nothing to say."""
        pages = [list(blocks(h)) if isinstance(h, str) else [] for h in column]
        return pd.DataFrame({"template": map(template_of, pages), "text": [text_of(p, Rules({})) for p in pages]}, dtype=object)

    @F.pandas_udf("string")
    def ruled_text(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, rules in columns:
            yield pd.Series([main_text(h, _parsed(r)) if isinstance(h, str) else None for h, r in zip(html, rules)], dtype=object)
        _parsed.cache_clear()
        release()

    known = wrappers(pages).select("host", "template", ruled("wrapper").alias("rules"))
    known = stored(known.where(F.col("rules") != '{"fixed":{},"slots":[]}'), "wrapper-rules")
    found = pages.withColumn("host", _host()).withColumn("read", read("html"))
    found = found.select("page_id", "url", "html", "host", "read.template", F.col("read.text").alias("plain"))
    found = found.join(known, ["host", "template"], "left")
    html = F.when(F.col("rules").isNotNull(), F.col("html"))  # pages of other templates are not read again
    found = found.select("page_id", "url", F.coalesce(ruled_text(html, "rules"), "plain").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
