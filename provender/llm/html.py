"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts. A text that most of a host's pages have is a constant, a token
like a tag; other texts are slots. The wrapper of a host begins as the stream of one
page and is aligned with the streams of the others in turn: tokens that only one side has become
optional groups, and runs that repeat become repeated groups. Wrappers are aligned with each other in
the same way, so partitions infer their own and those are merged. Each slot counts its texts on the way.
A page is then matched against its host's expression, and its main text is what the match puts into the
slots that hold the article: see ``content``.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table, unwrapped, wrapped

#: A comment; a declaration; a tag, its quotes closed; a tag with a quote that never ends; a tag cut off by the end.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^<>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "canvas", "object", "video", "audio", "select", "title"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Opening one of these ends an open one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Tags and roles that say by HTML's own meaning that a part isn't the article.
AROUND = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "header", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
BODY_ROLES = {"main", "article"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold text rather than parts of a page: their class says nothing of where they stand.
TEXTUAL = HEADING | {"p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "html", "body"}
#: Names of parts around an article, a first guess about a container that its share of the text can overrule.
GUESSES = set("ad ads advert adverts advertisement sponsor sponsored banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead topbar cookie cookies consent notice notices popup newsletter login signup comment comments replies disqus widget widgets".split())

#: How often an article's text may stand in other articles of its host, and how sure it has to be that a text is none.
QUOTED, DOUBT = 0.2, 0.01


#: A name made of words; others (a letter, one with digits, a very long one) are kept apart, as they may be generated.
WORDED = re.compile(r"[^a-z0-9]*[a-z]{2,20}(?:[^a-z0-9]+[a-z]{2,20})*[^a-z0-9]*")
ODD = "~"


def symbol(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role. Names that aren't made of words follow with a mark before them:
    they count where they stand on most pages of a host, see ``stable_names``."""
    if not attributes or "=" not in attributes:
        return f"{tag}.hidden" if attributes and re.search(r"\bhidden\b", attributes) else tag
    words = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            words += [w for w in re.split(r"[^a-z]+", value) if 1 < len(w) <= 20]
            words += [ODD + re.sub(r"[./~]", "_", w) for w in value.split() if not WORDED.fullmatch(w)]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.append("hidden")
    return ".".join([tag, *dict.fromkeys(words)])


def reduced(path: str, stable: frozenset[str] = frozenset()) -> str:
    """A path without the marked names that aren't stable."""
    if ODD not in path:
        return path
    return "/".join(".".join(w for w in s.split(".") if w[:1] != ODD or w[1:] in stable) for s in path.split("/"))


def parsed(html: str) -> list[tuple[str, str, int]]:
    """The blocks of a page in order: the symbols around each, joined by /, its text with one space for
    white space, and how many of its characters stand in links."""
    blocks: list[tuple[str, str, int]] = []
    tags: list[str] = []
    path: list[str] = []
    text: list[str] = []
    link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            if joined := " ".join(entities.unescape("".join(text)).split()):
                blocks.append(("/".join(path), joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(to: int) -> None:
        del tags[to:], path[to:]

    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
            linked += link * (m.start() - at)
        at, name, ends, attributes = m.end(), m[2] or m[5], m[1] or m[4], m[3] or m[6] or ""
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                link = not ends
            continue
        flush()
        if ends:
            if name in tags:
                close(len(tags) - 1 - tags[::-1].index(name))
            continue
        if "p" in tags[-1:]:
            close(len(tags) - 1)
        for i in range(len(tags) - 1, -1, -1) if name in ENDS else ():
            if tags[i] in SCOPE.get(name, ()):
                break
            if tags[i] in ENDS[name]:
                close(i)
                break
        if name in RAW and not attributes.endswith("/"):  # runs to its own end tag, whatever stands before
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            tags.append(name)
            path.append(symbol(name, attributes))
    text.append(html[at:])
    flush()
    return blocks


def digest(text: str) -> int:
    """What is kept of a text to compare it, whatever its length: 64 bits, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))).astype(np.int64))


OPTIONAL, REPEATED = 1, 2
#: [symbol, flags, nodes inside, counts]. "#" is a slot and "=..." a constant, both with counts of pages,
#: texts, characters and characters in links; "()" is a group.
Node = list
#: A run of texts of one kind: (path, "#" or the constant).
Run = tuple[str, str]


def runs_of(paths: list[str], digests: list[int], fixed: set[int]) -> tuple[tuple[Run, ...], list[int]]:
    """The texts of a page as runs of one path and kind, and the run of each text."""
    runs: list[Run] = []
    of = []
    for path, d in zip(paths, digests):
        run = (path, f"={d:x}" if d in fixed else "#")
        if not runs or runs[-1] != run:
            runs.append(run)
        of.append(len(runs) - 1)
    return tuple(runs), of


def key(node: Node) -> str:
    """What is compared in an alignment: elements with a constant alone are told from those with a slot."""
    if node[0] == "()":
        return f"({' '.join(map(key, node[2]))})"
    return node[0] + node[2][0][0] if len(node[2]) == 1 and node[2][0][0][0] == "=" else node[0]


def merged(a: Node, b: Node, flags: int = 0) -> Node:
    return [a[0], a[1] | b[1] | flags, aligned(a[2], b[2]), [x + y for x, y in zip(a[3], b[3])]]


def folded(nodes: list[Node]) -> list[Node]:
    """Runs that repeat, of one to four nodes, become repeated groups."""
    out: list[Node] = []
    for node in nodes:
        if out and key(out[-1]) == key(node):
            out[-1] = merged(out[-1], node, REPEATED)
        else:
            out.append(node)
        for n in range(2, 5):
            last = [key(x) for x in out[-n:]]
            if len(out) > n and out[-n - 1][0] == "()" and [key(x) for x in out[-n - 1][2]] == last:
                out[-n - 1 :] = [["()", out[-n - 1][1], [merged(x, y) for x, y in zip(out[-n - 1][2], out[-n:])], []]]
                break
            if len(out) >= 2 * n and [key(x) for x in out[-2 * n : -n]] == last:
                out[-2 * n :] = [["()", REPEATED, [merged(x, y) for x, y in zip(out[-2 * n : -n], out[-n:])], []]]
                break
    return out


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Two sequences as one: what both have (a longest common subsequence) is merged, the rest is optional."""
    x, y = list(map(key, a)), list(map(key, b))
    if x == y:
        return [merged(i, j) for i, j in zip(a, b)]
    long = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            long[i][j] = long[i + 1][j + 1] + 1 if x[i] == y[j] else max(long[i + 1][j], long[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and long[i + 1][j] >= long[i][j + 1]):
            out.append([a[i][0], a[i][1] | OPTIONAL, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], b[j][1] | OPTIONAL, *b[j][2:]])
            j += 1
    return folded(out)


def stream(runs: tuple[Run, ...], counts: list[list[int]]) -> Node:
    """A page's runs as nested nodes, its root without a name."""
    root: Node = ["", 0, [], []]
    last: list[str] = []
    for (path, token), n in zip(runs, counts):
        symbols, shared, node = path.split("/") if path else [], 0, root
        while shared < len(symbols) - 1 and symbols[: shared + 1] == last[: shared + 1]:
            shared += 1
        for i, s in enumerate(symbols):
            if i >= shared:
                node[2].append([s, 0, [], []])
            node = node[2][-1]
        node[2].append([token, 0, [], list(n)])
        last = symbols
    return root


def repeats(node: Node, counted: bool = True) -> Node:
    """A page's stream with its repeated runs folded; a run of several texts repeats its element."""
    inside = folded([repeats(x) for x in node[2]])
    many = len(inside) == 1 and inside[0][3] and inside[0][3][1] > inside[0][3][0]
    return [node[0], node[1] | (REPEATED if many and node[0] else 0), inside, node[3]]


def expression(node: Node) -> str:
    """A wrapper as a union-free regular expression; # is a slot."""
    inside = "".join(map(expression, node[2]))
    out = node[0] if node[0][:1] in ("#", "=") else inside if node[0] in ("", "()") else f"<{node[0]}>{inside}</{node[0].split('.')[0]}>"
    return f"({out}){['', '?', '+', '*'][node[1]]}" if node[1] else out


def flat(nodes: list[Node]) -> tuple[list[Node], list[int]]:
    """The nodes of a sequence with groups opened, and for each the first place to which a repetition leads back."""
    out: list[Node] = []
    back: list[int] = []
    for node in nodes:
        if node[0] == "()":
            begin, (inner, at) = len(out), flat(node[2])
            out += inner
            back += [begin] * len(inner) if node[1] & REPEATED else [begin + i for i in at]
        else:
            back.append(len(out))
            out.append(node)
    return out, back


def matched(page: list[Node], nodes: list[Node]) -> list[Node | None]:
    """For each node of a page's sequence the node of the expression it stands for.

    The match with the most nodes in the order of the expression, in which repeated nodes and groups
    may come again and others may be missing; a node out of order stands for the first of its key.
    """
    pattern, back = flat(nodes)
    where: dict[str, list[int]] = {}
    for j, x in enumerate(pattern):
        where.setdefault(key(x), []).append(j)
    keys = [key(x) for x in page]
    if all(len(where.get(k, ())) <= 1 for k in keys):  # nothing to choose from
        return [pattern[where[k][0]] if k in where else None for k in keys]
    best: list[tuple[int, tuple | None]] = [(0, None)] * len(pattern)  # of matches that end in a place: nodes, and the match as a chain
    for i, k in enumerate(keys):
        new = []
        for j in where.get(k, ()):
            before = [best[p] for p in range(len(pattern)) if p < j or (back[p] <= j and (p > j or pattern[j][1] & REPEATED or back[p] < p))]
            n, chain = max(before, key=lambda b: b[0], default=(0, None))
            new.append((j, (n + 1, (i, j, chain))))
        for j, found in new:
            if found[0] > best[j][0]:
                best[j] = found
    out: list[Node | None] = [pattern[where[k][0]] if k in where else None for k in keys]
    chain = max(best, key=lambda b: b[0], default=(0, None))[1]
    while chain:
        i, j, chain = chain
        out[i] = pattern[j]
    return out


class Wrapper:
    """tree: the expression. fixed: the constants' digests. leaves: the slots and constants of the tree in order."""

    def __init__(self, tree: Node, fixed: list[int], stable: list[str] | None = None):
        self.tree, self.fixed, self.leaves, self.known = tree, set(fixed), [], {}
        self.stable = frozenset(stable or ())
        self.chains: list[list[Node]] = []
        self.number(tree, [])
        self.place = {id(x): i for i, x in enumerate(self.leaves)}
        self.main, self.rest, self.constants = content(self.leaves, self.chains)

    def number(self, node: Node, chain: list[Node]) -> None:
        for x in node[2]:
            if x[0][0] in "#=":
                self.leaves.append(x)
                self.chains.append(chain)
            else:
                self.number(x, chain if x[0] == "()" else [*chain, x])

    def match(self, runs: tuple[Run, ...]) -> list[int | None]:
        """For each run of a page the leaf of the expression that it fills."""
        if runs not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            found: list[int | None] = [None] * len(runs)

            def go(page: list[Node], nodes: list[Node]) -> None:
                for x, y in zip(page, matched(page, nodes)):
                    if y is None:
                        continue
                    if x[0][0] in "#=":
                        found[x[3][0]] = self.place[id(y)]
                    else:
                        go(x[2], y[2])

            go(stream(runs, [[i] for i in range(len(runs))])[2], self.tree[2])
            self.known[runs] = found
        return self.known[runs]

    def text(self, blocks: list[tuple[str, str, int]]) -> str:
        """A page's main text: what stands in the article's slots, or else in any that could be text, or in the article's constants."""
        runs, of = runs_of([reduced(b[0], self.stable) for b in blocks], [digest(b[1]) for b in blocks], self.fixed)
        at = self.match(runs)
        for wanted in (self.main, self.rest, self.constants):
            if own := [b[1] for b, r in zip(blocks, of) if at[r] in wanted]:
                return " ".join(own)
        return ""


def alone(blocks: list[tuple[str, str, int]]) -> Wrapper:
    """The wrapper of a page whose host isn't known: its own stream."""
    runs, of = runs_of([reduced(b[0]) for b in blocks], [0] * len(blocks), set())
    return Wrapper(repeats(stream(runs, counts_of(of, [len(b[1]) for b in blocks], [b[2] for b in blocks]))), [])


def counts_of(of: list[int], chars: list[int], linked: list[int]) -> list[list[int]]:
    """Pages (1), texts, characters and linked characters of each run."""
    out: list[list[int]] = [[1, 0, 0, 0] for _ in range(of[-1] + 1)] if of else []
    for r, c, k in zip(of, chars, linked):
        out[r][1] += 1
        out[r][2] += c
        out[r][3] += k
    return out


@lru_cache(100_000)
def outside(symbols: tuple[str, ...]) -> bool:
    """Whether a tag, a role or being hidden puts what these elements enclose out of the article."""
    inside = False
    for s in symbols:
        tag, *words = s.split(".")
        if tag in ("html", "body"):
            continue
        if tag == "header" and inside and symbols[-1].split(".")[0] in HEADING:
            continue  # the title of an article
        if tag in AROUND or not ROLES.isdisjoint(words) or "hidden" in words:
            return True
        inside |= tag in BODY_ROLES
    return False


def guessed(node: Node) -> bool:
    tag, *words = node[0].split(".")
    return tag not in TEXTUAL and not GUESSES.isdisjoint(words)


def bodied(chain: list[Node]) -> bool:
    return any(x[0].split(".")[0] in BODY_ROLES for x in chain)


def content(leaves: list[Node], chains: list[list[Node]]) -> tuple[set[int], set[int], set[int]]:
    """Of a wrapper's leaves: the article's slots, all slots that could be text, and the article's constants.

    Tags and roles come first: what they put out of the article is out, and where there is an article
    or main, that is it. A container whose name speaks of a part around the article is out too, unless
    the text says otherwise: no article or main stands outside of it, and one inside, or three quarters
    of all text. Without article or main, the part is looked for that holds the text: from the root on,
    the element inside that has 70 % of the characters outside of links. Slots there that are mostly
    links are out. Constants are on half of the host's pages and never in the text, but for pages that
    have nothing else.
    """
    free = [i for i, c in enumerate(chains) if not outside(tuple(x[0] for x in c))]
    slots = [i for i in free if leaves[i][0] == "#"]
    marks = {id(x): x for i in free for x in chains[i] if guessed(x)}
    for m in marks.values():
        within = [i for i in slots if any(x is m for x in chains[i])]
        others = [i for i in slots if i not in set(within) and not any(guessed(x) for x in chains[i] if not any(x is y for y in (chains[within[0]] if within else ())))]
        own = sum(leaves[i][3][2] for i in within if bodied(chains[i][[x is m for x in chains[i]].index(True) :]))
        out = sum(leaves[i][3][2] for i in others if bodied(chains[i]))
        size, rest = sum(leaves[i][3][2] for i in within), sum(leaves[i][3][2] for i in others)
        if within and 10 * out < size + rest and (own or 4 * size >= 3 * (size + rest)):
            marks[id(m)] = None
    barred = {k for k, m in marks.items() if m is not None}
    free = [i for i in free if not any(id(x) in barred for x in chains[i])]
    slots = [i for i in free if leaves[i][0] == "#"]
    bodies = {i for i in free if bodied(chains[i])}
    if bodies.intersection(slots):
        return bodies.intersection(slots), set(slots), bodies.difference(slots)
    part, depth = slots, 0
    while True:
        weight: dict[int, int] = {}
        for i in part:
            if len(chains[i]) > depth:
                weight[id(chains[i][depth])] = weight.get(id(chains[i][depth]), 0) + leaves[i][3][2] - leaves[i][3][3]
        most = max(weight, key=weight.get, default=None)
        if most is None or 10 * weight[most] < 7 * sum(leaves[i][3][2] - leaves[i][3][3] for i in part):
            break
        inner = [i for i in part if len(chains[i]) > depth and id(chains[i][depth]) == most]
        if all(len(chains[i]) == depth + 1 for i in inner):  # a paragraph rather than a part of the page
            break
        part, depth = inner, depth + 1
    text = {i for i in part if 2 * leaves[i][3][3] <= leaves[i][3][2]} or set(part)
    return text, set(slots), set(free).difference(slots) | bodies


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def outlines(pages: DataFrame) -> DataFrame:
    """(host, page, path, digest, chars, linked): the texts of each distinct page without their words, in arrays.

    Pages of a host with the same texts in the same places are one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, page in zip(pdf["host"], pdf["html"]):
                blocks = parsed(page)
                paths, ids = [b[0] for b in blocks], [digest(b[1]) for b in blocks]
                rows.append((host, digest("\n".join([*map(reduced, paths), *map(str, ids)])), paths, ids, [len(b[1]) for b in blocks], [b[2] for b in blocks]))
            yield pd.DataFrame(rows, columns=["host", "page", "path", "digest", "chars", "linked"])

    schema = "host string, page long, path array<string>, digest array<long>, chars array<int>, linked array<int>"
    rows = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    return rows.mapInPandas(run, schema).dropDuplicates(["host", "page"])


def constants(outline: DataFrame) -> DataFrame:
    """(host, fixed): the digests of the texts that belong to a host's template.

    At least half of the host's other pages have such a text too, and more than articles would that
    quote each other: were each page to have it by a chance of QUOTED, so many would be met with a
    probability under DOUBT (Chernoff's bound). Four pages that all have it are the fewest. A list has
    at most twice as many texts as the host's average page.
    """
    total = outline.groupBy("host").agg(F.count("*").alias("n"))
    on = outline.select("host", F.explode(F.array_distinct("digest")).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("k"))
    p = F.expr("(k - 1) / (n - 1)")
    entropy = p * F.log(p / QUOTED) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - QUOTED))).otherwise(0.0)
    sure = (p >= 0.5) & (F.expr("n - 1") * entropy >= -math.log(DOUBT))
    return on.where("k > 1").join(total, "host").where(sure).groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("fixed"))


def stable_names(outline: DataFrame) -> DataFrame:
    """(host, stable): the names that aren't made of words and stand on at least half of a host's pages, two or more.

    A letter, a name with digits or a very long one tells two parts of a page apart as any other does, if it is the host's own;
    those that pages or builds generate come and go. A list has at most twice as many names as the average page.
    """
    total = outline.groupBy("host").agg(F.count("*").alias("n"))
    names = F.array_distinct(F.flatten(F.transform("path", lambda p: F.regexp_extract_all(p, F.lit(r"~([^./]+)"), F.lit(1)))))
    on = outline.select("host", F.explode(names).alias("name")).groupBy("host", "name").agg(F.count("*").alias("k"))
    return on.where("k > 1").join(total, "host").where("2 * k >= n").groupBy("host").agg(F.sort_array(F.collect_list("name")).alias("stable"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): each host's wrapper, from all its pages, as JSON.

    Partitions infer wrappers of their own; those of a host are merged among 32 shares first and
    then all, so no task sees a host's pages together, and a wrapper is as large as its expression.
    """
    outline = settled(outlines(pages), "outlines")
    fixed = settled(constants(outline), "constants")
    stable = settled(stable_names(outline), "stable")

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes: dict[str, dict[tuple[Run, ...], list[list[int]]]] = {}
        sets: dict[str, tuple[set[int], frozenset[str]]] = {}

        def out() -> pd.DataFrame:
            trees = []
            for host, seen in shapes.items():
                tree = None
                for runs in sorted(seen):
                    page = repeats(stream(runs, seen[runs]))
                    tree = merged(tree, page) if tree else page
                trees.append(json.dumps([tree, sorted(sets[host][0]), sorted(sets[host][1])], ensure_ascii=False))
            df = pd.DataFrame({"host": list(shapes), "wrapper": trees}, dtype=object)
            shapes.clear()
            sets.clear()
            return df

        for pdf in batches:
            for host, path, ids, chars, linked, known, names in zip(*(pdf[c] for c in ("host", "path", "digest", "chars", "linked", "fixed", "stable"))):
                if host not in sets:
                    sets[host], shapes[host] = (set() if known is None else set(known.tolist()), frozenset() if names is None else frozenset(names.tolist())), {}
                runs, of = runs_of([reduced(p, sets[host][1]) for p in path], ids.tolist(), sets[host][0])
                counts = counts_of(of, chars.tolist(), linked.tolist())
                had = shapes[host].get(runs)
                shapes[host][runs] = counts if had is None else [[a + b for a, b in zip(x, y)] for x, y in zip(had, counts)]
            if sum(map(len, shapes.values())) > 2000:
                yield out()
        yield out()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, known = None, []
        for w in sorted(pdf["wrapper"]):
            one, *known = json.loads(w)
            tree = merged(tree, one) if tree else one
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [json.dumps([tree, *known], ensure_ascii=False)]})

    rows = outline.join(fixed, "host", "left").join(stable, "host", "left").drop("page").mapInPandas(infer, "host string, wrapper string")
    some = rows.withColumn("share", F.expr("pmod(spark_partition_id(), 32)")).groupBy("host", "share").applyInPandas(merge, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with ``text``, the main text: blocks in order of the page, joined by one space.

    A null or empty html gives an empty text, as does a page without text. Pages with a null or
    unreadable url have no host, so each is judged by its own stream, as is the one page of a host
    that has no other. Pages without anything in their host's article slots give what stands in slots
    that could be text. Repeated rows come back as often and alike, and so do pages that tie in all but
    their id; pages that are the same count once in their host's wrapper, so a page with many copies
    doesn't make constants of its texts. Very long pages count whole; an empty table gives an empty one;
    a ``text`` column is replaced, other columns stay whatever their names.
    """
    inner = pages.select("url", "html")
    known = settled(wrappers(inner), "wrappers")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held: dict[str, Wrapper] = {}
        for html, wrapper in batches:
            out = []
            for page, w in zip(html, wrapper):
                if not page:
                    out.append("")
                    continue
                blocks = parsed(page)
                if not w:
                    out.append(alone(blocks).text(blocks))
                    continue
                if w not in held:
                    if len(held) > 500:
                        held.clear()
                    held[w] = Wrapper(*json.loads(w))
                out.append(held[w].text(blocks))
            yield pd.Series(out, dtype=object)

    keyed = wrapped(pages).withColumn("_host", host_of(F.col("_in.url")))
    joined = keyed.join(known.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")), "_host", "left")
    return unwrapped(joined, pages, text=extract("_in.html", "_wrapper"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
