"""Main text of web pages by two passes of block rules.

Pass one looks at each block alone. Blocks in containers that are no text by their tag, role or attributes, and blocks
with many linked characters, are bad. Long blocks with enough stop words are good; inside an article or main element a
lower density is enough, and blocks below it are undecided; outside, the rest is bad or, if short, undecided. Pass two
gives each undecided block the label of its nearest decided neighbours, looking inside its own region of the page first.

A class or id that names boilerplate (as a whole or by its last part) is evidence against an element and all below it.
It is overruled where the rest of the page speaks for the element: an article or main inside shows the name to be one
of the layout; so does a name that would take more than half of an article's text, or all good blocks of a page
without article. Names of replies and recommendations, which hold texts of their own, yield only to the first article
of the page.

A page is read once from front to end, in time in proportion to its length even where its markup is broken, and with
memory in proportion to it. Null or empty html gives an empty text. Rows may repeat. Extra columns, whatever their names,
do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were there one all we can
    her has their if will would when who so no more than other what some into only its about
    le la les de des du un une et est en que qui dans pour pas sur au avec il elle ce se ne son sa ses par plus ou mais comme nous vous ils sont cette aux
    der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch
    el los las que y a del se por con una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde""".split()
)

#: Their content is no markup; without an end tag it runs to the end of the page.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "title", "textarea")}
#: Their content is dropped, up to their end tag or that of an element around them.
_DROPPED = frozenset("noscript template select iframe object svg math canvas audio video button".split())
_FOREIGN = frozenset("svg math".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\W\d_]+")

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
_BAD_TAGS = frozenset("nav footer aside menu dialog fieldset head".split())
_GOOD_TAGS = frozenset("article main".split())
_BAD_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs
    footer footers header headers masthead topbar comment comments commentlist disqus reply replies respond discussion reader-comments notice notices cookie cookies consent gdpr popup modal overlay alert
    share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets toolbar pagination pager copyright disclaimer form search tagcloud
    navigation contentinfo complementary""".split()
)
#: The label of forms: boilerplate for sure, unless the page's text stands in them.
_FORM = 3
#: Of those, the ones whose elements often hold articles that are not the page's text.
_REPLY_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion reader-comments related recommended recommendations".split())
_ABOUT = frozenset("has with without no".split())


class Rules:
    """Thresholds; lengths are characters."""

    max_link_density = 0.33
    short = 60
    long = 160
    min_stop_density = 0.12
    article_min_stop_density = 0.04
    most_taken_by_names = 0.5  # share of an article's characters
    least_words = 20  # to tell that a page's language is none of the lists'


def _named(token: str, region: int) -> int:
    """Does a class or id name boilerplate: 0 no, 1 yes, 2 replies or recommendations?"""
    *before, last = [p for p in re.split(r"[-_]+", token) if p] or [""]
    name = token if token in _BAD_NAMES else last if not (before and before[-1] in _ABOUT) else ""
    if name not in _BAD_NAMES or (region and name in ("header", "headers")):  # an article's own header is text
        return 0
    return 2 if name in _REPLY_NAMES else 1


def _attributes(text: str, region: int) -> tuple[int, bool, bool]:
    """Do class and id name boilerplate (see _named), does the role, do the attributes hide the element?"""
    named, role, hidden = 0, False, False
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            role = role or any(t in _BAD_NAMES for t in value.split())
        elif name in ("class", "id"):
            named = max([named, *(_named(t, region) for t in value.split())])
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        else:
            hidden = hidden or value != "false"
    return named, role, hidden


class _Tags:
    """Finds where tags end. Quotes count after '=', as in HTML; once a quote is seen to stay open to the end of the page,
    they count no more, so that no page is searched to its end again and again."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """Place after the '>' of the tag whose name ends at `at`; -1 without one."""
        if at > self.last:
            return -1
        i = at
        while self.quotes:
            m = _STOP.search(self.page, i)
            if m and m.group() == ">":
                return m.end()
            i = self.page.find(m[1], m.end()) + 1 if m else 0
            self.quotes = i > 0
        return self.page.find(">", at) + 1


class _Open(list):
    """The open elements, (tag, boilerplate for sure, innermost label by name, region), with the places of each tag."""

    _WALLS = frozenset("ul ol table dl div article section main body".split())

    def __init__(self):
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def put(self, *element) -> None:
        self.places.setdefault(element[0], []).append(len(self))
        if element[0] in self._WALLS:
            self.walls.append(len(self))
        self.append(element)

    def place(self, *tags: str) -> int:
        """Place of the innermost of these elements; -1 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, at: int) -> None:
        """End the element at a place and all inside it."""
        while len(self) > at:
            tag = self.pop()[0]
            self.places[tag].pop()
            if tag in self._WALLS:
                self.walls.pop()


def blocks(page: str) -> list[tuple[str, float, int, int]]:
    """(text, share of linked characters, boilerplate, region) of each block with text.

    Boilerplate is 0 for none, 1 by name, 2 by name of replies or recommendations, 3 for sure; region 0 is outside
    of articles.
    """
    out: list[tuple[str, float, bool, int, int]] = []
    stack, tags = _Open(), _Tags(page)
    names, above = [0], [0]  # labels by name and the labels around them; an article inside takes them back
    parts: list[str] = []
    linked = in_link = regions = at_token = 0
    dropped = -1  # place in the stack of the dropped element around
    inner: Counter[str] = Counter()  # inline elements open inside it

    def label(named: int, around: int) -> int:
        if not named:
            return around
        names.append(named)
        above.append(around)
        return len(names) - 1

    def taken_back(at: int) -> bool:
        """Take back the labels by name, and those of forms, around an article, if it is the page's text."""
        around = []
        while at:
            around.append(at)
            at = above[at]
        if regions and any(names[i] == 2 for i in around):
            return False
        for i in around:
            names[i] = 0
        return True

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip(" ")
        if text:
            out.append((text, linked / len(text), *(stack[-1][1:] if stack else (False, 0, 0))))
        parts.clear()
        linked = 0

    while at_token < len(page):
        if len(stack) <= dropped:
            dropped = -1
        token, m = "<", None
        if page[at_token] != "<":
            stop = page.find("<", at_token)
            token = page[at_token : stop if stop >= 0 else len(page)]
        elif page.startswith("<!--", at_token):
            stop = page.find("-->", at_token + 4)
            at_token = stop + 3 if stop >= 0 else len(page)
            continue
        elif page[at_token + 1 : at_token + 2] in ("!", "?") or (page.startswith("</", at_token) and not _TAG.match(page, at_token)):
            if at_token <= tags.last:
                at_token = page.find(">", at_token) + 1
                continue
        elif m := _TAG.match(page, at_token):
            stop = tags.end(m.end())
            m = m if stop >= 0 else None
        if m is None:
            at_token += len(token)
            if dropped < 0:
                parts.append(token)
                if in_link:
                    linked += len(token)
            continue
        (end, tag), attributes, at_token = m.groups(), page[m.end() : stop - 1], stop
        tag = tag.lower()
        closed = attributes.rstrip().endswith("/")
        if tag in _RAW:
            if not end and not (closed and dropped >= 0 and stack.place(*_FOREIGN) >= dropped):
                over = _RAW[tag].search(page, at_token)
                at_token = over.end() if over else len(page)
            continue
        if dropped >= 0 and (tag in _INLINE or tag in _VOID):
            if tag in _VOID or (not end and closed):
                continue
            if not end or inner[tag]:
                inner[tag] += -1 if end else 1
                continue
            stack.cut(dropped)  # the end of an inline element around
            dropped = -1
        if tag in _DROPPED and dropped < 0:
            if not end and not (closed and tag in _FOREIGN):
                dropped = len(stack)
                inner.clear()
                stack.put(tag, True, *(stack[-1][2:] if stack else (0, 0)))
            continue
        if dropped >= 0:
            if not end:
                if not closed:
                    stack.put(tag, *stack[-1][1:])
                continue
            i = stack.place(tag)
            if i >= dropped:
                stack.cut(i)
                continue
            if i < 0:
                continue
            stack.cut(dropped)  # the end of an element around
            dropped = -1
        if tag == "a":
            in_link = 0 if end else 1
            continue
        if tag == "img":  # stands in the line
            continue
        if tag in _INLINE:
            sure, at, region = stack[-1][1:] if stack else (False, 0, 0)
            if not end and attributes and any(found := _attributes(attributes, region)) and not closed:
                close()
                stack.put(tag, sure or found[1] or found[2], label(found[0], at), region)
            elif end and stack and stack[-1][0] == tag:
                close()
                stack.cut(len(stack) - 1)
            continue
        close()
        if tag in _VOID:
            continue
        in_link = 0 if tag in ("p", "div", "li") else in_link
        if end:
            if (i := stack.place(tag)) >= 0:
                stack.cut(i)
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # an open one of the same kind ends here
            i = stack.place(tag)
            if i > (stack.walls[-1] if stack.walls else -1):
                stack.cut(i)
        sure, at, region = stack[-1][1:] if stack else (False, 0, 0)
        if tag == "body":
            sure, at = False, 0
        if tag in _GOOD_TAGS and not region and not sure and taken_back(at):
            regions += 1
            region = regions
        if tag == "form":  # some pages stand in one as a whole
            at = label(_FORM, at)
        elif tag in _BAD_TAGS or (tag == "header" and not region):
            sure = True
        elif attributes and tag not in ("html", "body"):
            named, role, hidden = _attributes(attributes, region)
            text = tag in _GOOD_TAGS or (re.fullmatch(r"h[1-6]", tag) and region)
            sure = sure or hidden or (role and not text)
            at = at if text else label(named, at)
        stack.put(tag, sure, at, region)
    close()
    size, held = 0, Counter()
    for text, share, sure, at, _ in out:
        if not sure and share <= Rules.max_link_density:
            size += len(text)
            while at:
                held[at] += len(text)
                at = above[at]
    for i in [i for i, n in held.items() if names[i] == _FORM and 2 * n > size and n >= Rules.long]:
        names[i] = 0  # more than half of the page's text: a form around the page
    marked = [0] * len(names)
    for i in range(1, len(names)):
        marked[i] = max(names[i], marked[above[i]])
    return [(text, share, 3 if sure else marked[at], region) for text, share, sure, at, region in out]


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _overruled(found: list[tuple[str, float, int, int]], density: Callable[[str], float]) -> set[int]:
    """Regions whose names of boilerplate are those of a layout."""
    out, whole, taken, replies = set(), Counter(), Counter(), Counter()
    for text, share, bad, region in found:
        if bad != 3 and share <= Rules.max_link_density:
            whole[region] += len(text)
            taken[region] += len(text) * (bad == 1)
            replies[region] += len(text) * (bad == 2)
    for region in whole:
        if region and taken[region] > Rules.most_taken_by_names * (whole[region] - replies[region]):
            out.add(region)
    good = lambda text, share: len(text) >= Rules.long and share <= Rules.max_link_density and density(text) >= Rules.min_stop_density
    if set(whole) == {0} and not any(bad == 0 and good(text, share) for text, share, bad, _ in found):
        out.add(0)
    return out


def _unknown_language(found: list[tuple[str, float, int, int]]) -> bool:
    """Are hardly any words of the page's unlinked long blocks stop words of the list? Then length and links alone decide."""
    words = [w for text, share, bad, _ in found if bad != 3 and len(text) >= Rules.short and share <= Rules.max_link_density for w in _WORD.findall(text.lower())]
    return len(words) >= Rules.least_words and sum(w in STOP_WORDS for w in words) < Rules.article_min_stop_density * len(words)


def _first_pass(found: list[tuple[str, float, int, int]]) -> list[bool | None]:
    """Good, bad or undecided, for each block alone."""
    unknown = _unknown_language(found)
    density = lambda text: 1.0 if unknown else stop_density(text)
    layout, labels = _overruled(found, density), []
    for text, link_share, bad, region in found:
        if (bad and not (bad == 1 and region in layout)) or link_share > Rules.max_link_density:
            labels.append(False)
        elif len(text) < Rules.short:
            labels.append(None)
        elif region:
            labels.append(True if density(text) >= Rules.article_min_stop_density else None)
        elif density(text) >= Rules.min_stop_density:
            labels.append(True if len(text) >= Rules.long else None)
        else:
            labels.append(False)
    return labels


def _second_pass(found: list[tuple[str, float, int, int]], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided ones, of their own region first."""
    decided = [i for i, x in enumerate(labels) if x is not None]
    by_region: dict[int, list[int]] = {}
    for i in decided:
        if not found[i][2] or labels[i]:
            by_region.setdefault(found[i][3], []).append(i)

    def inherited(i: int) -> bool:
        region = found[i][3]
        near = by_region.get(region) or ([] if region else decided)
        if not near:
            return bool(region)  # an article of undecided blocks only
        k = bisect_left(near, i)
        left, right = near[k - 1] if k else None, near[k] if k < len(near) else None
        if left is None or right is None:
            return bool(labels[right if left is None else left])
        if labels[left] == labels[right]:
            return bool(labels[left])
        if i - left != right - i:
            return bool(labels[left if i - left < right - i else right])
        return len(found[i][0]) >= Rules.short  # between a good and a bad one: the longer undecided ones are text

    return [inherited(i) if x is None else x for i, x in enumerate(labels)]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends."""
    found = blocks(page or "")
    return "\n".join(block[0] for block, good in zip(found, _second_pass(found, _first_pass(found)), strict=True) if good)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """pages(keep, html) -> keep, text, n_chars."""
    kept = pages.select(*keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(p) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, schema)
