"""Main text of web pages, by place and by comparison with the page of the nearest URL; an article element's own blocks are put back."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivalent.session import materialise

from .common import bounded_batches

# Names of elements.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
PAGE = {"html", "body"}
#: Of those, the ones that may be wrapped around a whole page.
WRAPPERS = {"form", "fieldset"}
LEFT_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|footer|cookies?|consent|notice|newsletter|subscribe|"
    r"comments?|replies|related|share|social|popup|modal|login|search)(?:$|[\s_-])", re.I)
#: Names that also say what is around an article ("with-nav", "has-sidebar").
LAYOUT_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|nav\w*|menu|breadcrumbs?|sidebar|footer|notice|login|search)(?=$|[\s_-])", re.I)
OWN_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|replies)(?:$|[\s_-])", re.I)
#: Inside an article only a whole name that can say nothing else counts: "ad", "comment-list", but not "share-of-voice".
INSIDE_NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|replies)(?:[_-](?:area|banner|block|box|container|list|section|slot|thread|unit|wrapper))*", re.I)
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}

#: Comments, declarations and tags. In a tag a quote opens a value only right after an equals sign; elsewhere it is part of
#: a name. No part is read twice, whatever the page holds.
TAG = re.compile(
    r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>?+|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+|[^\s>\"'][^\s>]*+)?+)?+)*+)>?+", re.S)
#: The attributes of a tag: name and value, quoted or not.
NAMED = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s>\"'][^\s>]*+))?+)?+")
SPACE = re.compile(r"\s+")


def left_out_by_attributes(attributes: str) -> str:
    """Why attributes rule an element out: "hidden", "role", "strong" or "weak" (only layout names); empty if they do not."""
    why = ""
    for name, a, b, c in NAMED.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "hidden"
        if name in ("class", "id") and LEFT_OUT_NAMES.search(value):
            strong = LEFT_OUT_NAMES.search(LAYOUT_NAMES.sub(" ", value))
            why = "strong" if strong or why == "strong" else why or "weak"
        if name == "role" and value.lower() in LEFT_OUT_ROLES:
            why = why if why == "strong" else "role"
    return why


def own_comment_or_advert(attributes: str) -> bool:
    return any(name.lower() in ("class", "id") and OWN_NAMES.search(a or b or c) for name, a, b, c in NAMED.findall(attributes))


class Place(NamedTuple):
    """Where a block stands.

    ``chain`` is the innermost element that might rule it out and ``base`` what that
    was where the innermost article or main element began, both numbers in Marks.
    """

    kind: str = ""
    in_main: bool = False
    hidden: bool = False
    base: int = 0
    chain: int = 0


class Marks:
    """The elements that might rule out what is in them, each with the one around it; 0 is the page.

    Wrappers and layout names rule out only where they hold less than half of the page.
    """

    def __init__(self) -> None:
        self.up, self.may_be_page, self.chars = [0], [False], [0]

    def add(self, up: int, may_be_page: bool) -> int:
        self.up.append(up)
        self.may_be_page.append(may_be_page)
        self.chars.append(0)
        return len(self.up) - 1

    def counts(self) -> tuple[list[int], list[int]]:
        """For each element: how many from it upwards rule out by themselves, and how many by holding less than half of the page."""
        held = list(self.chars)
        for x in range(len(held) - 1, 0, -1):
            held[self.up[x]] += held[x]
        firm, small = [0] * len(held), [0] * len(held)
        for x in range(1, len(held)):
            page = 2 * held[x] >= held[0]
            firm[x] = firm[self.up[x]] + (not self.may_be_page[x])
            small[x] = small[self.up[x]] + (self.may_be_page[x] and not page)
        return firm, small


def blocks(html: str) -> list[tuple[str, str]]:
    """(text, place) of the blocks in page order. Places: "main", "out" (menus, adverts, forms and the like) and "open".

    Names and roles do not count on html and body, and inside an article or main element
    only names that say nothing but advert or comments. An article or main element opens
    "main" inside an element that is ruled out as well, unless it is itself a comment or
    advert. If a page has several, those with the least around them count, so teasers
    and comments beside an article stay out. A form or an element with a layout name
    that holds half of the page's characters or more is the page and rules nothing out.
    """
    found: list[tuple[str, Place]] = []
    pieces: list[str] = []
    stack: list[tuple[str, Place]] = []
    still_open: dict[str, int] = defaultdict(int)
    marks, place, at = Marks(), Place(), 0

    def close_block() -> None:
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                found.append((text, place))
                marks.chars[place.chain] += len(text)

    def leave() -> str:
        name, _ = stack.pop()
        still_open[name] -= 1
        return name

    while True:
        tag = TAG.search(html, at)
        if tag is None:
            pieces.append(html[at:])
            break
        pieces.append(html[at : tag.start()])
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        attributes = tag.group(3)
        if name in INLINE and not still_open[name] and not (attributes and why_out(attributes, place)):
            continue
        if name in VOID:
            pieces.append(" ")
            if name == "hr":
                close_block()
            continue
        close_block()
        if tag.group(1):
            if still_open[name]:
                while leave() != name:
                    pass
                place = stack[-1][1] if stack else Place()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            leave()  # these end where the next of their kind starts
            place = stack[-1][1] if stack else Place()
        why = why_out(attributes, place) if attributes else ""
        if why == "hidden":
            place = place._replace(hidden=True)
        elif name in MAIN and not own_comment_or_advert(attributes):
            around = marks.add(place.chain, False) if why else place.chain
            place = place._replace(kind=name, in_main=place.in_main or name == "main", base=around, chain=around)
        elif name in LEFT_OUT and not (name == "header" and place.kind and place.chain == place.base):
            place = place._replace(chain=marks.add(place.chain, name in WRAPPERS and why in ("", "weak")))
        elif why and name not in PAGE:
            place = place._replace(chain=marks.add(place.chain, why == "weak"))
        stack.append((name, place))
        still_open[name] += 1
    close_block()
    return placed(found, marks)


def why_out(attributes: str, place: Place) -> str:
    """:func:`left_out_by_attributes`, but inside an article or main element only what can say nothing else counts."""
    why = left_out_by_attributes(attributes)
    if not place.kind or why in ("", "hidden"):
        return why
    names = [x for name, a, b, c in NAMED.findall(attributes) if name.lower() in ("class", "id") for x in (a or b or c).split()]
    return "strong" if any(INSIDE_NAMES.fullmatch(x) for x in names) else ""


def placed(found: list[tuple[str, Place]], marks: Marks) -> list[tuple[str, str]]:
    firm, small = marks.counts()

    def around(p: Place) -> tuple[int, int]:
        return firm[p.base], small[p.base]

    kept = [not p.hidden and (firm[p.chain], small[p.chain]) == around(p) for _, p in found]
    inside = [p for (_, p), k in zip(found, kept) if k]
    least_main = min((around(p) for p in inside if p.kind == "main"), default=None)
    least = min((around(p) for p in inside if p.kind == "article"), default=None)
    out = []
    for (text, p), k in zip(found, kept):
        if k and p.kind == "main":
            k = around(p) == least_main
        elif k and p.kind:
            # Beside a main element with text of its own, an article in a menu, an advert or the like is a teaser.
            k = around(p) == least and (least_main is None or least <= least_main or p.in_main and least[0] == least_main[0])
        out.append((text, ("main" if p.kind else "open") if k else "out"))
    return out


def address(url: str | None) -> tuple[str, str]:
    """Host in lower case and path, without scheme, port, query, fragment and closing slash."""
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", (url or "").strip(), re.I)
    if not found:
        return "", (url or "").strip()
    host = found.group(1).rpartition("@")[2].partition(":")[0].lower()
    return host, found.group(2).rstrip("/")


def numbered(lines: list[int]) -> list[tuple[int, int]]:
    """Each line with its number among the lines equal to it."""
    seen: dict[int, int] = defaultdict(int)
    out = []
    for line in lines:
        out.append((line, seen[line]))
        seen[line] += 1
    return out


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Positions in ``mine`` of a longest common subsequence with ``other``.

    The n-th of equal lines pairs with the other's n-th, so every line has one
    partner at most and the subsequence is the longest rising run of partners.
    """
    where = {x: j for j, x in enumerate(numbered(other))}
    tops: list[int] = []
    ends: list[int] = []
    before: dict[int, int | None] = {}
    for i, x in enumerate(numbered(mine)):
        j = where.get(x)
        if j is None:
            continue
        k = bisect_left(tops, j)
        before[i] = ends[k - 1] if k else None
        if k == len(tops):
            tops.append(j)
            ends.append(i)
        else:
            tops[k], ends[k] = j, i
    out: set[int] = set()
    i = ends[-1] if ends else None
    while i is not None:
        out.add(i)
        i = before[i]
    return out


def page_blocks(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Of each page its id, url, host, sort key (host, path, id, digest of the html) and blocks.

    lines holds a hash of every block, outline a hash of lines, texts (packed) the blocks that
    place does not rule out, body the hash of the longest of them and spots their positions in lines. sure says that the texts
    are an article or main element's; the blocks outside it are then ruled out by place.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(
        df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"),
        F.coalesce(df[html_col].cast("string"), F.lit("")).alias("html"),
    )

    def run(batches):
        for batch in batches:
            made: dict[str, list] = {k: [] for k in ("host", "key", "lines", "outline", "body", "texts", "spots", "sure")}
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                found = blocks(html)
                host, path = address(url)
                sure = any(place == "main" for _, place in found)
                spots = [i for i, (_, place) in enumerate(found) if place == ("main" if sure else "open")]
                lines = [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t, _ in found]
                number = 0 if page_id is None else page_id + (1 << 63)
                made["host"].append(host)
                made["key"].append(f"{host}\t{path}\t{number:020d}\t{xxhash.xxh64_hexdigest(html.encode())}")
                made["lines"].append(lines)
                made["outline"].append(xxhash.xxh64_intdigest(repr(lines).encode()) - (1 << 63))
                made["body"].append(max(((len(found[i][0]), lines[i]) for i in spots), default=(0, 0))[1])
                made["texts"].append(zlib.compress(json.dumps([found[i][0] for i in spots], ensure_ascii=False).encode()))
                made["spots"].append(spots)
                made["sure"].append(sure)
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *(pa.array(v, t) for v, t in zip(made.values(), kinds))],
                names=["page_id", "url", *made],
            )

    return rows.mapInArrow(
        run,
        "page_id long, url string, host string, key string, lines array<long>, outline long, body long, texts binary, spots array<int>, sure boolean",
    )


def key_cuts(outlines: DataFrame, pieces: int) -> list[str]:
    """Sorted whole keys that part ``outlines`` into about ``pieces`` even runs; any cuts give the same result.

    They come from at most 50 times ``pieces`` rows, the first by a hash.
    """
    found = sorted(r["key"] for r in outlines.select("key", F.xxhash64("key").alias("h")).orderBy("h").limit(50 * pieces).collect())
    return sorted({found[len(found) * i // pieces] for i in range(1, pieces)}) if found else []


def beside(outlines: DataFrame, kind: str) -> DataFrame:
    """host, ``kind`` and others of each distinct ``kind`` (a hash of pages) of a host: lines of other kinds of the host.

    A kind stands at its smallest key with that page's lines. others holds the lines of
    the kind before and after it and of two of the host that a hash draws.
    """
    spark = outlines.sparkSession
    alike = outlines.groupBy("host", kind).agg(F.min(F.struct("key", "lines")).alias("first"))
    alike = materialise(alike.select("host", kind, "first.key", "first.lines"), kind)
    cuts = key_cuts(alike, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    run = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda c: c <= F.col("key")))
    alike = alike.withColumn("run", run)
    # Neighbours across two runs come from the ends of runs, of which there are few.
    in_run, over_runs = Window.partitionBy("run").orderBy("key"), Window.orderBy("run")
    near = F.struct("host", "lines")
    ends = alike.groupBy("run").agg(F.min_by(near, "key").alias("first"), F.max_by(near, "key").alias("last"))
    ends = ends.select("run", F.lag("last").over(over_runs).alias("last_before"), F.lead("first").over(over_runs).alias("first_after"))
    placed = alike.withColumn("before", F.lag(near).over(in_run)).withColumn("after", F.lead(near).over(in_run)).join(F.broadcast(ends), "run")
    before, after = F.coalesce("before", "last_before"), F.coalesce("after", "first_after")
    mark = F.struct(F.xxhash64(kind).alias("h"), kind, "lines")
    drawn = materialise(alike.groupBy("host").agg(F.min(mark).alias("low"), F.max(mark).alias("high")), "drawn")
    placed = materialise(placed.select("host", kind, before.alias("before"), after.alias("after")), "placed")
    others = F.array(
        *[F.when(F.col(f"{x}.host") == F.col("host"), F.col(f"{x}.lines")) for x in ("before", "after")],
        *[F.when(F.col(f"{x}.{kind}") != F.col(kind), F.col(f"{x}.lines")) for x in ("low", "high")],
    )
    return placed.join(drawn.hint("merge"), "host").select("host", kind, F.filter(others, lambda x: x.isNotNull()).alias("others"))


def neighbours(outlines: DataFrame) -> DataFrame:
    """host, outline, body and others: pages of the host with other blocks, then pages with another longest block."""
    pairs = outlines.select("host", "outline", "body").distinct()
    by_outline = beside(outlines, "outline").hint("merge")
    by_body = beside(outlines, "body").withColumnRenamed("others", "more").hint("merge")
    both = pairs.join(by_outline, ["host", "outline"]).join(by_body, ["host", "body"])
    return both.select("host", "outline", "body", F.concat("others", "more").alias("others"))


def left_over(lines: list[int], texts: list[str], spots: list[int], others: list[list[int]]) -> tuple[list[str], int]:
    """The texts less those of a longest common subsequence with the first of ``others`` that is not nearly the same page.

    That is the first that leaves half as many characters, or more, as the one that leaves
    most. All texts stay if every one leaves nothing: equal pages do not tell what is theirs.
    Also the length of that subsequence, 0 if all texts stay for that.
    """
    left = []
    for other in others:
        gone = shared_lines(lines, other)
        left.append(([t for t, i in zip(texts, spots) if i not in gone], len(gone)))
    sizes = [sum(map(len, x)) for x, _ in left]
    most = max(sizes, default=0)
    return next(x for x, n in zip(left, sizes) if 2 * n >= most) if most else (texts, 0)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_shared of each row of ``df``.

    Blocks of menus, adverts, forms and the like, or outside a page's article or main
    element (see :func:`blocks`), are left out. What is left of every page is compared
    with a neighbour, and lines of a longest common subsequence with it go: pages are
    sorted by host, path and id, pages of a host with equal blocks (or else with the same
    longest block) count once, and the neighbour is the one before or after that is not
    nearly the same page, or one drawn from the host (see :func:`left_over`). n_shared
    counts the page's blocks in that subsequence. A check follows: what it took out of an
    article or main element is put back, since two articles may share a line. A page without
    such a neighbour keeps its blocks. A null html is the empty page, which has the empty
    text. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    pages = page_blocks(df, id_col, url_col, html_col)
    # Pages are parsed again for their texts: that is cheaper than keeping all texts on disk.
    outlines = materialise(pages.select("host", "key", "lines", "outline", "body"), "pages")
    near = neighbours(outlines)
    # The same blocks in other places of the page may give another longest one, so both names are joined.
    names = ["host", "outline", "body"]
    ready = pages.select("page_id", "url", *names, "lines", "texts", "spots", "sure").join(near.hint("merge"), names)

    def run(batches):
        for batch in batches:
            made, shared = [], []
            for lines, texts, spots, others, sure in zip(*(batch.column(c).to_pylist() for c in ("lines", "texts", "spots", "others", "sure"))):
                texts = json.loads(zlib.decompress(texts))
                kept, n = left_over(lines, texts, spots, others)
                made.append(" ".join(texts if sure else kept))
                shared.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64()), pa.array(shared, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_shared"],
            )

    return ready.select("page_id", "url", "lines", "texts", "spots", "others", "sure").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_shared long")
