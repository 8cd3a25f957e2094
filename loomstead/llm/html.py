"""Main text of pages by wrappers: union-free regular expressions inferred from pages of the same host.

A page becomes a stream of tokens: block elements that begin or end, and text slots, which are known by the
block elements around them. Neighbouring repeats of a run of tokens fold into a repeated group. The streams of
a host are aligned: a longest common subsequence stays, what one side has alone becomes optional, and optional
blocks that come in any order and number become one repeated group with each kind of block once, so that a wrapper
is as long as a host has kinds of blocks, not pages. The result is the host's wrapper, a sequence of tokens each with a mark for optional and for repeated; neighbours of equal
marks are its groups (``regex_of`` writes them out).

Every page is then matched with its host's wrapper, which gives each of its texts a slot. Slots are judged by
what they hold over the host: a slot with one and the same text on all pages that have it, while those pages
differ, is the template's; a slot in an element that never holds an article (menus, asides, footers, forms; or
one whose class, id or role is exactly such a word, unless the article is inside it) is none; inside an article, a
word that may as well be its subject (``social``) counts only where the element holds links or a fixed text; of what is left, the slots in an article or main element are content,
and where the host has none, those of the smallest element that holds most of the host's varying text beside
links, and its headings. A page with no text in its host's content slots is judged by its own slots alone.

Equal streams of a host are counted first. Then groups of about ``GROUP`` streams are aligned, their number
growing with the host's streams, level by level until a host has one wrapper: a hot host is a tree of tasks.
Slot figures are sums, extremes and sketches. Wrappers go to tasks as a variable while all of them together
are at most ``most_bytes`` long, by a join on the host beyond.

Null, empty or tagless pages give the text without markup (none: empty); a null URL is a host of its own;
repeated rows have their own results, and count once where the template is told from the rest; other columns
aren't read. Pages are read in linear time; an unclosed tag, comment or script hides what follows, as in
browsers, but an unclosed menu or aside doesn't. Memory: one page, one wrapper and the streams of one group.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import col_of, kept, per_batch

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The rest of a tag, with ``>`` inside quoted values; possessive, so that one failure costs one pass.
REST = re.compile(r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>""")
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Fixed values of HTML: elements without an end, with raw text, that begin a block, that break a line, and
#: that close an open one.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
BREAK = {"br", "hr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}} | {b: {"p"} for b in BLOCK - set("body caption head html li dt dd tr td th tbody thead tfoot option optgroup legend summary".split())}
IN_HEAD = VOID | RAW | {"template"}
#: Elements that never hold a part of the article, blocks and others; and the same said by a class, id or role.
NO_CONTENT = set("nav aside footer form dialog menu head search".split())
SKIPPED = set("button select datalist svg template".split())
NO_WORDS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies footer masthead menu modal nav navbar navigation newsletter notice popup promo sidebar sponsor sponsored subscribe toolbar".split())
#: Words that say so outside of an article, but inside one may as well be what a part of it is about.
MAYBE_WORDS = set("header related search share sharing social".split())
#: Elements of the page's frame that hide the rest of a page if their end is missing; they are then taken for nothing.
UNENDED = set("nav aside dialog menu search".split())
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2"}
#: Elements of text that are not gone into when the one with most text is looked for; nor are those without blocks.
LEAVES = set("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table blockquote pre figure address details".split())
LETTERS = re.compile(r"[^a-z]+")
#: A slot remembers so many block elements from the outermost one; those further inside share the slot.
DEPTH = 32
GROUP = 16
OPTIONAL, REPEATED = 1, 2
#: A run of optional tokens that has one slot, or one tag, more often than this is a group in any order.
SLOTS, TAGS = 2, 16


def label(name: str, rest: str) -> str:
    """An element as part of a slot's name: ``tag.words``; first a ``!`` if its marks say it holds no article, a ``?`` if they may."""
    if not rest:
        return name
    words = [w for v in MARKED.findall(rest) for w in v.strip("\"'").lower().split()]
    out = ".".join([name, *sorted({x for w in words for x in LETTERS.split(w) if x})])
    if name in ("html", "body"):
        return out
    return "!" + out if not NO_WORDS.isdisjoint(words) else "?" + out if not MAYBE_WORDS.isdisjoint(words) else out


def tokens_of(page: str, ignored: frozenset[int] = frozenset()) -> list[tuple[str, str, int]]:
    """(token, text, code points in links) of a page: ``+tag``, ``-tag``, or ``#path`` with its text, undecoded.

    Where menus and the like never end, the page is read once more with these elements, by their places, ignored.
    """
    out: list[tuple[str, str, int]] = []
    names, paths, solid, skips = [""], ["#"], [0], 0  # open elements, their slots, which are blocks, and how many are skipped
    places, lost = [-1], set()  # where the open elements begin; which of the frame's never end
    open_, held, links = Counter(), [], 0
    at, n, plain = 0, len(page), False

    def flush():
        nonlocal links
        if held:
            text = "".join(held)
            if text.strip():
                out.append((paths[-1], text, links))
            held.clear()
            links = 0

    def close(k: int):
        """Ends the elements from the k-th on."""
        nonlocal skips
        whole = names[k] in ("html", "body")
        while len(names) > k:
            name = names[-1]
            begun = places.pop()
            if whole and name in UNENDED:
                lost.add(begun)
            if solid[-1] == len(names) - 1 and len(solid) > 1:
                flush()
                solid.pop()
                out.append(("-" + name, "", 0))
            names.pop()
            paths.pop()
            open_[name] -= 1
            skips -= name in SKIPPED

    while at < n:
        to = page.find("<", at)
        if to != at:
            to = n if to < 0 else to
            if not skips:
                held.append(page[at:to])
                links += (to - at) * bool(open_["a"])
            at = to
            continue
        m = NAME.match(page, at + 1)
        if not m:
            if page.startswith("<!--", at):
                end = at + 4 if page.startswith(("<!-->", "<!--->"), at) else page.find("-->", at + 4)
                at = n if end < 0 else page.index(">", end) + 1
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                if not skips:
                    held.append("<")
                at += 1
            continue
        name, begin = m[0].lower(), m.end()
        rest = None if plain else REST.match(page, begin)
        if rest:
            end = rest.end() - 1
        else:  # a quote that never ends: from here on, tags end at the next ">"
            plain, end = True, page.find(">", begin)
            if end < 0:
                break
        at = end + 1
        if name[0] == "/":
            name = name[1:]
            if open_[name]:
                k = len(names) - 1
                while names[k] != name:
                    k -= 1
                close(k)
            elif name in BREAK:
                held.append(" ")
            continue
        if name in RAW:
            found = _raw_end(name).search(page, at)
            at = n if not found else found.start()
            continue
        if name in VOID:
            if name in BREAK:
                held.append(" ")
            continue
        top = names[solid[-1]]
        if top in CLOSES.get(name, ()) or top == "head" and name not in IN_HEAD:
            close(solid[-1])
            if name == "tr" and names[solid[-1]] == "tr":
                close(solid[-1])
        block = name in BLOCK and begin not in ignored
        if block:
            flush()
            out.append(("+" + name, "", 0))
            path = paths[-1]
            solid.append(len(names))
            paths.append(f"{path}/{label(name, page[begin:end])}" if len(solid) <= DEPTH + 1 else path)
        else:
            paths.append(paths[-1])
        names.append(name)
        places.append(begin)
        open_[name] += 1
        skips += name in SKIPPED
    flush()
    lost.update(b for b, name in zip(places, names, strict=True) if name in UNENDED)
    return tokens_of(page, frozenset(lost)) if lost and not ignored else out


@functools.lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])", re.I)


def fold(tokens: list[str], longest: int = 24, passes: int = 6) -> tuple[list[str], list[int], list[list[int]]]:
    """Tokens with neighbouring equal runs as one repeated run: tokens, marks, and where each was in ``tokens``."""
    items = [(t, [[t, 0, [k]]]) for k, t in enumerate(tokens)]
    for _ in range(passes):
        before = len(items)
        for size in range(1, min(longest, before // 2) + 1):
            items = _folded(items, size)
        if len(items) == before:
            break
    flat = [x for _, leaves in items for x in leaves]
    return [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]


def _folded(items: list, size: int) -> list:
    keys, n = [x[0] for x in items], len(items)
    out, k = [], 0
    while k < n:
        end = k + size
        if end < n and keys[k] == keys[end]:
            block = keys[k:end]
            while end + size <= n and keys[end : end + size] == block:
                end += size
        if end == k + size:
            out.append(items[k])
            k += 1
            continue
        leaves = [x for item in items[k : k + size] for x in item[1]]
        for again in range(k + size, end, size):
            for mine, more in zip(leaves, (x for item in items[again : again + size] for x in item[1]), strict=True):
                mine[2] += more[2]
        for x in leaves:
            x[1] = REPEATED
        out.append((block[0] if size == 1 and isinstance(block[0], tuple) else tuple(block), leaves))
        k = end
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: rows of its table are bits of whole numbers.

    Only one row in about the square root of their number is kept; the rows between two of these are made again on
    the way back, so memory is len(b) * sqrt(len(a)) bits for lists of any length.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs: list[tuple[int, int]] = []
    if inner_a and inner_b:
        places: dict[str, int] = defaultdict(int)
        for k, t in enumerate(inner_b):
            places[t] |= 1 << k
        full, size = (1 << len(inner_b)) - 1, math.isqrt(len(inner_a)) + 1

        def rows_of(row: int, part: list[str]):
            for t in part:
                found = row & places.get(t, 0)
                row = ((row + found) | (row - found)) & full
                yield row

        first = [full]  # the rows before each part of ``size`` tokens
        for k in range(0, len(inner_a) - size, size):
            *_, last = rows_of(first[-1], inner_a[k : k + size])
            first.append(last)
        j = len(inner_b)
        for part in range(len(first) - 1, -1, -1):
            begin = part * size
            rows = [first[part], *rows_of(first[part], inner_a[begin : begin + size])]
            i = len(rows) - 1
            while i and j:
                if rows[i] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
                    if rows[i] >> (j - 1) & 1:
                        j -= 1
                        pairs.append((head + begin + i, head + j))
        pairs.reverse()
    return [(k, k) for k in range(head)] + pairs + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


Wrapper = tuple[list[str], list[int]]


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """The wrapper of two: what both have, and, marked optional, what one has alone, generalised."""
    tokens: list[str] = []
    marks: list[int] = []
    i = j = 0
    for x, y in [*common(a[0], b[0]), (len(a[0]), len(b[0]))]:
        tokens += a[0][i:x] + b[0][j:y]
        marks += [m | OPTIONAL for m in a[1][i:x] + b[1][j:y]]
        if x < len(a[0]):
            tokens.append(a[0][x])
            marks.append(a[1][x] | b[1][y])
        i, j = x + 1, y + 1
    return general((tokens, marks))


def general(wrapper: Wrapper) -> Wrapper:
    """A wrapper whose size is bounded by its kinds of blocks, however many pages it stands for.

    Where a run of optional tokens has a slot more than ``SLOTS`` times (or a tag more than ``TAGS``), its blocks come
    in any order and number: the run becomes one repeated group of optional tokens, each once. Tokens that all pages
    have stay between two such groups only if one of the groups lacks them.
    """
    runs: list[tuple[bool, list[str], list[int]]] = []  # (is a group of optional tokens, tokens, marks)
    for optional, part in itertools.groupby(zip(*wrapper, strict=True), key=lambda x: bool(x[1] & OPTIONAL)):
        tokens, marks = map(list, zip(*part, strict=True))
        runs.append((optional and _any_order(tokens, marks), tokens, marks))
    out: list[tuple[bool, list[str], list[int]]] = []
    for run in runs:
        out.append(run)
        while len(out) > 2 and out[-1][0] and out[-3][0] and set(out[-2][1]) <= set(out[-1][1]) & set(out[-3][1]):
            tokens = [t for part in out[-3:] for t in part[1]]
            out[-3:] = [(True, tokens, [OPTIONAL | REPEATED] * len(tokens))]
    tokens, marks = [], []
    for group, part, of in out:
        names = list(dict.fromkeys(part)) if group else part
        tokens += names
        marks += [OPTIONAL | REPEATED] * len(names) if group else of
    return tokens, marks


def _any_order(tokens: list[str], marks: list[int]) -> bool:
    """Whether a run has something too often; a run that is a group already, and nothing more, stays one."""
    counts = Counter(tokens)
    if any(n > (SLOTS if t[0] == "#" else TAGS) for t, n in counts.items()):
        return True
    return len(counts) == len(tokens) and all(m == OPTIONAL | REPEATED for m in marks)


def regex_of(wrapper: Wrapper) -> str:
    """A wrapper written out: groups with ``?``, ``+`` or ``*`` (optional and repeated); text slots as ``#``."""
    out, k, (tokens, marks) = [], 0, wrapper
    while k < len(tokens):
        end = k
        while end < len(tokens) and marks[end] == marks[k]:
            end += 1
        body = "".join("#" if t[0] == "#" else f"</{t[1:]}>" if t[0] == "-" else f"<{t[1:]}>" for t in tokens[k:end])
        out.append(f"({body}){['', '?', '+', '*'][marks[k]]}" if marks[k] else body)
        k = end
    return "".join(out)


def slots_of(stream: list[str], wrapper: list[str]) -> list[int]:
    """For each token of a stream its place in the wrapper: by alignment, else that of an equal token nearest to where it lies, else -1."""
    out = [-1] * len(stream)
    for i, j in common(stream, wrapper):
        out[i] = j
    places: dict[str, list[int]] = defaultdict(list)
    for k, t in enumerate(wrapper):
        if t[0] == "#":
            places[t].append(k)
    before = -1
    for k, t in enumerate(stream):
        if out[k] >= 0:
            before = out[k]
        elif t in places:
            at = bisect.bisect(places[t], before)
            out[k] = min(places[t][max(at - 1, 0) : at + 1], key=lambda p: abs(p - before))
    return out


def no_content(path: list[str]) -> bool:
    """Whether a slot's elements say that it holds no part of an article: marks, and forms, outside of the article don't count."""
    inner = next((k for k in range(len(path) - 1, -1, -1) if is_main(path[k])), -1)
    names = [p.lstrip("!?").split(".")[0] for p in path]
    marked = any(p[0] == "!" for p in path[inner + 1 :]) or inner < 0 and any(p[0] == "?" for p in path)
    return marked or "form" in names[inner + 1 :] or any(x in NO_CONTENT and x != "form" for x in names) or inner < 0 and "header" in names


def is_main(element: str) -> bool:
    """An article or main element that isn't marked as something else, such as a reader's comment."""
    name, *words = element.split(".")
    return name in MAIN or name[0] not in "!?" and words == ["main"]


def doubtful(slots: dict[int, list[str]], figures: dict[int, tuple]) -> set[int]:
    """Slots inside elements of an article that may be none of it, by their marks, and aren't by what they hold.

    Such an element is no part of the article if more than half of its text is in links, or on 3 differing pages the same.
    """
    parts: dict[tuple, list[int]] = defaultdict(list)
    for k, p in slots.items():
        inner = max((n for n, x in enumerate(p) if is_main(x)), default=-1)
        at = next((n for n in range(inner + 1, len(p)) if p[n][0] == "?"), None)
        if at is not None:
            parts[tuple(p[: at + 1])].append(k)
    out: set[int] = set()
    for of in parts.values():
        total = sum(figures[k][0] for k in of)
        fixed = sum(figures[k][0] for k in of if figures[k][2] and figures[k][3] >= 3)
        if 2 * sum(figures[k][1] for k in of) > total or 2 * fixed > total:
            out.update(of)
    return out


def content_slots(wrapper: list[str], figures: dict[int, tuple], share: float = 0.6) -> list[int]:
    """The slots of a wrapper that hold the article; figures: slot -> (code points, of these in links, one text only?, differing pages).

    A text that never varies is the template's where at least 3 differing pages have it, or 8 in an article element.
    """
    slots = {k: wrapper[k].split("/")[1:] for k in figures if wrapper[k][0] == "#"}
    slots = {k: p for k, p in slots.items() if not no_content(p)}
    doubts = doubtful(slots, figures)
    slots = {k: p for k, p in slots.items() if k not in doubts}
    inside = {k: p for k, p in slots.items() if any(map(is_main, p))}
    fixed = lambda k, least: figures[k][2] and figures[k][3] >= least
    if inside:
        return sorted(k for k in inside if not fixed(k, 8)) or sorted(inside)
    weight = {k: 0 if fixed(k, 3) else figures[k][0] - figures[k][1] for k in slots}
    region: list[str] = []
    while True:
        below: dict[str, int] = defaultdict(int)
        nested = set()
        for k, p in slots.items():
            if len(p) > len(region) and p[: len(region)] == region:
                below[p[len(region)]] += weight[k]
                if len(p) > len(region) + 1:
                    nested.add(p[len(region)])
        total = sum(w for k, w in weight.items() if slots[k][: len(region)] == region)
        best = max(sorted(below), key=below.__getitem__, default="")
        if best not in nested or below[best] < share * total or best.split(".")[0] in LEAVES:
            break
        region = [*region, best]
    blocks: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for k in slots:
        blocks[wrapper[k]][0] += figures[k][0]
        blocks[wrapper[k]][1] += figures[k][1]
    linked = lambda k: blocks[wrapper[k]][1] > 0.5 * blocks[wrapper[k]][0]
    inner = [k for k, p in slots.items() if p[: len(region)] == region or p[-1].split(".")[0] in HEADINGS]
    return sorted(k for k in inner if not fixed(k, 3) and not linked(k)) or sorted(k for k in inner if not fixed(k, 3)) or sorted(inner)


def text_of(texts: list[str]) -> str:
    """Blocks decoded, white space as one space, joined by one."""
    return " ".join(b for t in texts if (b := " ".join(entities.unescape(t).split())))


class Pages:
    """Pages as streams, matched with wrappers; streams and matches are kept for what repeats."""

    def __init__(self, most: int = 4096):
        self.folds = functools.lru_cache(most)(lambda tokens: fold(list(tokens)))
        self.matches = functools.lru_cache(most)(lambda stream, wrapper: slots_of(list(stream), self.wrapper(wrapper)[0]))
        self.wrapper = functools.lru_cache(256)(json.loads)

    def stream(self, page: str) -> tuple[list, tuple[list[str], list[int], list[list[int]]]]:
        tokens = tokens_of(page)
        return tokens, self.folds(tuple(t[0] for t in tokens))

    def slotted(self, page: str, wrapper: str) -> list[tuple[int, str, int]]:
        """(slot, text, code points in links) of a page's texts, in its order."""
        tokens, (stream, _, places) = self.stream(page)
        slots = self.matches(tuple(stream), wrapper)
        of = {k: slot for slot, at in zip(slots, places, strict=True) for k in at}
        return [(of[k], text, links) for k, (t, text, links) in enumerate(tokens) if t[0] == "#"]

    def main_text(self, page: str, wrapper: str, content: set[int], fixed: set[int]) -> str:
        got = self.slotted(page, wrapper)
        if not any(slot in content for slot, _, _ in got):
            own: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for slot, text, links in got:
                own[slot][0] += len(text)
                own[slot][1] += links
            content = set(content_slots(self.wrapper(wrapper)[0], {k: (*v, False, 1) for k, v in own.items() if k not in fixed}))
        return text_of([text for slot, text, _ in got if slot in content])


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper) from rows (host, html): one wrapper for each host, as JSON."""

    def make():
        pages = Pages()

        def step(rows):
            counts: Counter = Counter()
            for host, page in zip(rows["host"], rows["html"], strict=True):
                tokens, marks, _ = pages.stream(page)[1]
                counts[host, json.dumps([tokens, marks])] += 1
            yield {"host": [k[0] for k in counts], "wrapper": [k[1] for k in counts], "n": list(counts.values())}

        return step

    def meet(group: pa.Table) -> pa.Table:
        """One wrapper of a group's, the most frequent first."""
        rows = sorted(group.select(["host", "wrapper", "n"]).to_pylist(), key=lambda r: (-r["n"], r["wrapper"]))
        out = functools.reduce(align, (json.loads(r["wrapper"]) for r in rows))
        return pa.table({"host": [rows[0]["host"]], "wrapper": [json.dumps(out)], "n": [sum(r["n"] for r in rows)]})

    shape = "host string, wrapper string, n long"
    level = kept(per_batch(rows.select("host", "html"), make, shape).groupBy("host", "wrapper").agg(F.sum("n").alias("n")), "streams")
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("size"))
        if (sizes.agg(F.max("size")).first()[0] or 0) <= 1:
            return level.select("host", "wrapper")
        group = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("size") / GROUP))
        level = kept(level.join(sizes, "host").withColumn("group", group).groupBy("host", "group").applyInArrow(meet, shape), "wrappers")


class Known:
    """A table by host that goes to tasks as a variable while it is small, by a join beyond."""

    def __init__(self, found: DataFrame, most_bytes: int):
        self.found, self.columns = found, [c for c in found.columns if c != "host"]
        size = found.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in found.columns), F.lit(0)))).first()[0] or 0
        self.rows = {r["host"]: tuple(r[c] for c in self.columns) for r in found.collect()} if size <= most_bytes else None

    def beside(self, rows: DataFrame) -> DataFrame:
        return rows if self.rows is not None else rows.join(self.found, "host", "left")

    def of(self, rows: dict[str, list]) -> list[tuple]:
        return [self.rows[h] for h in rows["host"]] if self.rows is not None else list(zip(*(rows[c] for c in self.columns), strict=True))

    def __getstate__(self):
        return {"rows": self.rows, "columns": self.columns}


def judged(rows: DataFrame, found: DataFrame, most_bytes: int) -> DataFrame:
    """(host, wrapper, content, fixed): which slots of each wrapper hold the article, and which never vary."""
    known = Known(found, most_bytes)

    def make():
        pages = Pages()

        def step(rows):
            out: dict[str, list] = {c: [] for c in ("host", "slot", "chars", "links", "text", "page")}
            for host, page, (wrapper,) in zip(rows["host"], rows["html"], known.of(rows), strict=True):
                sums: dict[int, list[int]] = {}
                for slot, text, links in pages.slotted(page, wrapper):
                    s = sums.setdefault(slot, [0, 0, 0])
                    s[0] += len(text)
                    s[1] += links
                    s[2] = zlib.crc32(" ".join(text.split()).encode() + b"\n", s[2])
                whole = zlib.crc32(repr(sorted((k, v[2]) for k, v in sums.items())).encode())
                for slot, s in sums.items():
                    for c, v in zip(out.values(), (host, slot, *s, whole), strict=True):
                        c.append(v)
            yield out

        return step

    shape = "host string, slot int, chars long, links long, text long, page long"
    figures = per_batch(known.beside(rows.select("host", "html")), make, shape).groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), (F.min("text") == F.max("text")).alias("one"), F.approx_count_distinct("page").alias("pages"))
    by_host = figures.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links", "one", "pages")).alias("slots"))

    def choose():
        def step(rows):
            content, fixed = [], []
            for wrapper, slots in zip(rows["wrapper"], rows["slots"], strict=True):
                of = {s["slot"]: (s["chars"], s["links"], s["one"], s["pages"]) for s in slots or ()}
                content.append(content_slots(json.loads(wrapper)[0], of))
                fixed.append(sorted(k for k, f in of.items() if f[2] and f[3] >= 3))
            yield {"host": rows["host"], "wrapper": rows["wrapper"], "content": content, "fixed": fixed}

        return step

    return kept(per_batch(found.join(by_host, "host", "left"), choose, "host string, wrapper string, content array<int>, fixed array<int>"), "judged")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = 16 << 20) -> DataFrame:
    """id, url and ``text``, the main text of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(col_of(df, url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = df.select(col_of(df, id_col).alias("id"), col_of(df, url_col).alias("url"), host.alias("host"), F.coalesce(col_of(df, html_col), F.lit("")).alias("html"))
    known = Known(judged(rows, wrappers(rows), most_bytes), most_bytes)
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        pages, sets = Pages(), functools.lru_cache(256)(lambda *x: set(x))

        def step(rows):
            texts = [pages.main_text(page, wrapper, sets(*content), sets(*fixed)) for page, (wrapper, content, fixed) in zip(rows["html"], known.of(rows), strict=True)]
            yield {"id": rows["id"], "url": rows["url"], "text": texts}

        return step

    return per_batch(known.beside(rows), make, f"id {kind}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
