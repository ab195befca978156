"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by style path: tags and classes from the root,
containers also by their place among siblings of one style. For each node of the
merged tree the entropy, over the pages, of its presentation (the shape of its
subtree, where a list's length is no shape) and of its content (the texts below it)
is normalised by the number of pages, relative to the host's whole pages. A menu that
repeats has neither; a footer with a new text each time has content alone; an article
has both.

The tree decides first. A node whose presentation and content repeat is cut. From the
root, each page is followed into the one container that has both entropies and most
of the text that isn't in containers that lack one; those beside the way are cut. Where
the way goes below the body, no name of an article is asked. What a style names breaks
ties: where a host's pages are too few to judge or all alike, where a page's layout is
too rare or has several ways, where an article lies beside the way, and for elements
whose meaning is fixed (nav, footer, form). A class word that sets a node apart yields
to entropy. A host with pages enough of whose tree nothing is known keeps all but the
fixed elements: names don't stand in for the tree.

Node counts are summed over (host, path, digest) rows with partial sums, so a large
host is no large task. Only paths that the tree judges go back to the pages. Reading a
page takes time in proportion to its length, however deep or broken it is.

Defined cases: null or empty html gives an empty text; broken markup is read as
browsers do in the main (open elements end with their parent); text outside every
element counts; a host with fewer than ``PAGES`` pages has only its styles' names to
go by; repeated rows count as pages; ties of entropy keep a node; texts of any length
are read whole; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batch, small_rows, stored, strings

#: Weight of a style's name against entropy, and the importance that stays.
LEAN, KEEP = 0.4, 0.45
#: What names say: an element apart (never overruled), a word apart, nothing, main text.
NEVER, APART_LEAN, OPEN, TEXT = -1.0, 0.0, 0.5, 1.0
#: Pages of a host from which entropy counts.
PAGES = 4
#: Mean of both entropies from which a container is rich.
RICH = 0.8
#: Judged paths up to this number travel to the tasks; beyond it pages are joined by host.
BROADCAST_PATHS = 100_000
#: What the tree says of a path: it is unimportant, or important against its name; its
#: container is rich or poor. And of a host, at its root: its pages differ, in text too.
LOW, IS_RICH, IS_POOR, HIGH, DIFFER, ALIKE = 1, 2, 4, 8, 16, 32

# Elements and class words by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
MAIN = frozenset("article main".split())
APART = frozenset(
    "nav footer aside form button select option optgroup datalist fieldset dialog menu head script style textarea title noscript template iframe svg canvas object audio video map".split()
)
APART_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot sidebar side aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social comment comments disqus replies reply discussion related recommended recommendations "
    "widget pagination pager paging login search copyright legal skip toolbar masthead topbar".split()
)
#: Elements that hold the whole page: words in their class say nothing.
WHOLE = frozenset("html body".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that the way down from the root may enter, and ones whose number is no shape.
CONTAINERS = frozenset("# html body div section article main center nav header footer aside form td".split())
LISTED = frozenset("li tr td th dt dd option a".split())
HOLDS = frozenset("html body div section article main aside nav header footer form ul ol dl table td th blockquote fieldset figure details".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>"'])*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def _style(tag: str, attributes: str) -> tuple[str, bool]:
    """(style label, whether its words set it apart)."""
    if not attributes or "=" not in attributes:
        return tag, False
    words = sorted({w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())})
    return tag + "." + ".".join(words) if words else tag, not APART_WORDS.isdisjoint(words)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


#: Texts of a stretch of blocks are told apart by a polynomial modulo a prime.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A6C8E24


class Page:
    """Blocks of a page in order, each with its node, and the nodes in order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int]] = []
        self.tag, self.label, self.parent, self.path, self.lean = ["#"], ["#"], [-1], [0], [OPEN]
        self.kinds: list[dict[str, int]] = [{}]  # containers below, by style
        # by node: in an article; in something apart; an outermost article; in a menu,
        # footer or the like, where an article is no main text (a form may hold a page)
        self.inside, self.under, self.root, self.shut = [False], [False], [False], [False]
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._at: dict[str, list[int]] = {}  # places in the stack, by tag
        self._holds = [0]
        self._read(source)

    def _open(self, tag: str, label: str, apart: bool) -> None:
        above = self._stack[-1][1]
        node = len(self.label)
        place = ""
        if tag in CONTAINERS:
            count = self.kinds[above][label] = self.kinds[above].get(label, 0) + 1
            place = f"#{count}"
        self.kinds.append({})
        self.tag.append(tag)
        self.label.append(label)
        self.parent.append(above)
        self.path.append(_digest(f"{self.path[above]}/{label}{place}"))
        apart = apart and tag not in WHOLE
        inside, under = self.inside[above], self.under[above]
        if tag in APART or (tag == "header" and not inside):
            lean = NEVER
        elif apart:
            lean = OPEN if tag in MAIN and not inside else APART_LEAN
        elif tag in MAIN:
            lean = OPEN if under else TEXT
        else:
            lean = max(self.lean[above], OPEN)
        self.root.append(tag in MAIN and not inside and not self.shut[above])
        self.shut.append(self.shut[above] or (lean == NEVER and tag != "form"))
        self.inside.append(inside or lean == TEXT)
        self.under.append(under or apart or lean == NEVER)
        self.lean.append(lean)
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in HOLDS:
            self._holds.append(len(self._stack))
        self._stack.append((tag, node))

    def _end(self, at: int) -> None:
        """Ends the open elements from a place in the stack on."""
        while len(self._stack) > at:
            tag, _ = self._stack.pop()
            self._at[tag].pop()
            if tag in HOLDS:
                self._holds.pop()

    def _end_before(self, tags: set[str]) -> None:
        """Ends the innermost open element of ``tags``, if nothing that holds others
        stands between."""
        at = max((places[-1] for t in tags if (places := self._at.get(t))), default=0)
        if at and at >= self._holds[-1]:
            self._end(at)

    def _read(self, source: str) -> None:
        words: list[str] = []
        at, size, last = 0, len(source), source.rfind(">")
        tag_at = _TAG

        def close() -> None:
            text = " ".join("".join(words).split())
            if text:
                self.blocks.append((text, self._stack[-1][1]))
            words.clear()

        def say(piece: str) -> None:
            words.append(entities.unescape(piece) if "&" in piece else piece)

        while at < size:
            start = source.find("<", at)
            if start < 0:
                break
            if source.startswith("<!--", start):
                say(source[at:start])
                stop = source.find("-->", start + 4)
                at = stop + 3 if stop >= 0 else size
                continue
            if start > last:
                break
            if source.startswith(("<!", "<?"), start):
                say(source[at:start])
                at = source.index(">", start) + 1
                continue
            m = tag_at.match(source, start)
            if m is None and source[start + 1 : start + 2].isascii() and source[start + 1 : start + 3].lstrip("/")[:1].isalpha() and tag_at is _TAG:
                # a quote never ends: from here on tags end with the first ">"
                tag_at = _PLAIN
                m = tag_at.match(source, start)
            if m is None:
                say(source[at : start + 1])
                at = start + 1
                continue
            say(source[at:start])
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if open_ := self._at.get(tag):
                    close()
                    self._end(open_[-1])
                elif tag not in INLINE and tag != "br":
                    close()
                continue
            if tag == "br" or tag in VOID:
                if tag == "hr":
                    close()
                words.append(" ")
                continue
            label, apart = _style(tag, m[3])
            if tag in RAW:
                stop = _RAW_END[tag].search(source, at)
                stop = source.find(">", stop.end()) if stop else -1
                at = stop + 1 if stop >= 0 else size
                continue
            if tag in INLINE and not apart:
                continue
            close()
            if tag in ENDS:
                self._end_before(ENDS[tag])
            elif tag not in INLINE:
                self._end_before({"p"})
            self._open(tag, label, apart)
        if at < size:
            say(source[at:])
        close()
        self._end(1)

    def _stretches(self) -> tuple[list[int], list[int]]:
        """By node, the first block below it and the one after the last."""
        first, last = [len(self.blocks)] * len(self.label), [0] * len(self.label)
        for i, (_, node) in enumerate(self.blocks):
            first[node], last[node] = min(first[node], i), i + 1
        for node in range(len(self.label) - 1, 0, -1):
            above = self.parent[node]
            first[above], last[above] = min(first[above], first[node]), max(last[above], last[node])
        return first, last

    def _shapes(self) -> list[int]:
        """Digest of the styles below each node; equal items of a list count once."""
        below: list[list[int]] = [[] for _ in self.label]
        out = [0] * len(self.label)
        for node in range(len(self.label) - 1, -1, -1):
            out[node] = _digest(self.label[node] + str(below[node][::-1]))
            above = self.parent[node]
            if above >= 0 and not (self.tag[node] in LISTED and below[above] and below[above][-1] == out[node]):
                below[above].append(out[node])
        return out

    def merged(self) -> list[tuple[int, float, bool, int, int]]:
        """(path, lean, whether a container, presentation digest, content digest) of
        each path."""
        prefix, power = [0], [1]
        for text, _ in self.blocks:
            prefix.append((prefix[-1] * BASE + _digest(text)) % PRIME)
            power.append(power[-1] * BASE % PRIME)
        first, last = self._stretches()
        shape = self._shapes()
        out: dict[int, list] = {}
        for node, path in enumerate(self.path):
            lo, hi = first[node], last[node]
            words = (prefix[hi] - prefix[lo] * power[hi - lo]) % PRIME if hi > lo else 0
            own = out.get(path)
            if own is None:
                out[path] = [self.lean[node], self.tag[node] in CONTAINERS, shape[node], words]
            else:
                own[2] = mixed(own[2], shape[node])
                own[3] = mixed(own[3], words)
        return [(path, *own) for path, own in out.items()]

    def text(self, judged: dict[int, int]) -> str:
        """The blocks none of whose nodes is of low importance, one a line."""
        say = [judged.get(path, 0) for path in self.path]
        silent = say[0] & DIFFER and not say[0] & ALIKE and len(judged) == 1
        low = [lean == NEVER or bool(said & LOW) or (lean == APART_LEAN and not said & HIGH and not silent) for lean, said in zip(self.lean, say)]
        way = self._cut_beside(low, say)
        main = not silent and not self._settled(way, low) and any(root and inside and not cut for root, inside, cut in zip(self.root, self.inside, low))
        for node in range(1, len(low)):
            # an article stays in what is apart, unless the page has another
            stays = self.root[node] and (self.inside[node] or not main) and not silent
            low[node] = low[node] or (low[self.parent[node]] and not stays)
        return "\n".join(t for t, node in self.blocks if not low[node] and (self.inside[node] or not main))

    def _settled(self, way: int, low: list[bool]) -> bool:
        """Whether the way goes below the body, with no article beside it."""
        if self.tag[way] in WHOLE or way == 0:
            return False
        on = [False] * len(low)
        node = way
        while node > 0:
            on[node] = True
            node = self.parent[node]
        for node in range(way + 1, len(low)):
            on[node] = on[node] or (self.parent[node] >= way and on[self.parent[node]])
        return not any(root and inside and not cut and not here for root, inside, cut, here in zip(self.root, self.inside, low, on))

    def _cut_beside(self, low: list[bool], say: list[int]) -> int:
        """From the root into the one rich container with most of the text that isn't in
        poor ones, level by level; poor containers beside a rich one are marked low. The
        node where the way ends."""
        size = [0] * len(low)
        for text, node in self.blocks:
            size[node] += len(text)
        below: list[list[int]] = [[] for _ in low]
        for node in range(len(low) - 1, 0, -1):
            size[self.parent[node]] += size[node]
            if self.tag[node] in CONTAINERS:
                below[self.parent[node]].append(node)
        node = 0
        while rich := [c for c in below[node] if say[c] & IS_RICH and not low[c]]:
            poor = sum(size[c] for c in below[node] if low[c] or (say[c] & IS_POOR and self.lean[c] != TEXT))
            if 2 * sum(size[c] for c in rich) < size[node] - poor:
                break
            for c in below[node]:
                if say[c] & IS_POOR and self.lean[c] != TEXT:
                    low[c] = True
            if len(rich) > 1:
                break
            node = rich[0]
        return node


def mixed(a: int, b: int) -> int:
    """One digest of two, in order."""
    return (a * BASE + b) % PRIME


def importance(lean, entropy):
    return LEAN * lean + (1 - LEAN) * entropy


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)"


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))


def tree_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, lean, container, m, shape, words) of the merged trees' nodes: the
    pages that have the node and its entropies of presentation and content, 0 to 1."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("lean", pa.float64()), ("container", pa.bool_()), ("shape", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, source in zip(strings(b.column(0)), strings(b.column(1))):
                rows += [(host, *node) for node in Page(source).merged()]
            yield batch(schema, *(zip(*rows) if rows else ([],) * 6))

    nodes = _with_host(pages).select("host", "html").mapInArrow(run, "host string, path long, lean double, container boolean, shape long, words long")
    key = ["host", "path", "lean", "container"]
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("shape").alias("value")), F.struct(F.lit(1).alias("side"), F.col("words").alias("value")))
    counts = nodes.select(*key, F.explode(sides).alias("d")).groupBy(*key, "d.side", "d.value").agg(F.count(F.lit(1)).alias("c"))
    spread = counts.groupBy(*key, "side").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    entropy = spread.filter(F.col("m") >= PAGES).withColumn("e", 1 - F.col("s") / (F.col("m") * F.log2("m")))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("e")))
    return entropy.groupBy(*key).agg(F.max("m").alias("m"), side(0).alias("shape"), side(1).alias("words"))


def judged_paths(pages: DataFrame) -> DataFrame:
    """(host, path, said) of the nodes of which the merged trees say something: they are
    unimportant, or important against their name, or a container is rich or poor. Hosts
    whose texts are all alike are told at their root."""
    node = stored(tree_nodes(pages), "style-tree")
    whole = node.filter("path = 0 and words > 1e-9").select("host", F.col("shape").alias("all_shape"), F.col("words").alias("all_words"))
    part = lambda own, all_: F.when(F.col(all_) > 1e-9, F.least(F.col(own) / F.col(all_), F.lit(1.0)))
    ready = node.filter("path <> 0").join(whole, "host").withColumns({"rs": part("shape", "all_shape"), "rw": part("words", "all_words")})
    # where all pages of the host have one shape, content alone tells
    both = (F.coalesce("rs", "rw") + F.col("rw")) / 2
    some = F.greatest("rs", "rw")
    open_, high = F.col("lean") > APART_LEAN, importance(F.col("lean"), both) >= KEEP
    weight = F.when(open_, F.when(importance(F.col("lean"), some) < KEEP, LOW)).otherwise(F.when(high, HIGH).otherwise(LOW))
    rank = F.when(~F.col("container") | F.col("rs").isNull(), 0).when(both >= RICH, IS_RICH).otherwise(IS_POOR)
    alike = node.filter("path = 0 and words <= 1e-9").select("host", "path", F.lit(ALIKE).alias("said"))
    return ready.select("host", "path", (F.coalesce(weight, F.lit(0)) + rank).cast("int").alias("said")).filter("said > 0").unionByName(alike)


def _differing(pages: DataFrame) -> DataFrame:
    """(host, path, said): the root of each host that has ``PAGES`` pages that aren't all
    the same."""
    mark = F.xxhash64("html")
    hosts = _with_host(pages).groupBy("host").agg(F.count(F.lit(1)).alias("m"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    return hosts.filter((F.col("m") >= PAGES) & (F.col("low") != F.col("high"))).select("host", F.lit(0).cast("long").alias("path"), F.lit(DIFFER).alias("said"))


def main_text(pages: DataFrame, limit: int = BROADCAST_PATHS, judged: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page. ``judged`` may hold what earlier
    pages of the hosts have told (see ``judged_paths``)."""
    said = judged_paths(pages) if judged is None else judged
    said = stored(said.unionByName(_differing(pages)).groupBy("host", "path").agg(F.bit_or("said").alias("said")), "judged-paths")
    ready = _with_host(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host")
    rows = small_rows(said, limit)
    shared = None
    if rows is not None:
        by_host: dict[str, dict] = {}
        for r in rows:
            by_host.setdefault(r.host, {})[r.path] = r.said
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        ready = ready.withColumn("said", F.lit(None).cast("array<struct<path:bigint,said:int>>"))
    else:
        # adaptive execution splits a large host: only its pages are many
        packed = said.groupBy("host").agg(F.collect_list(F.struct("path", "said")).alias("said"))
        ready = ready.join(packed, "host", "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, host, own in zip(strings(b.column(2)), strings(b.column(3)), b.column(4).to_pylist()):
                known = shared.value.get(host, {}) if shared is not None else {x["path"]: x["said"] for x in own or ()}
                texts.append(Page(source).text(known))
            yield batch(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])

    return ready.select("page_id", "url", "html", "host", "said").mapInArrow(run, "page_id long, url string, text string, n_chars long")
