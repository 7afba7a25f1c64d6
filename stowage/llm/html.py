"""Main text of web pages by a site style tree.

The pages of one host are merged: every element path (tags with their class, id and role) counts its
pages, the texts seen at it, and the child sequences it has been presented with. The entropy of texts
and presentations over the pages is a path's importance: what all pages repeat in one form has none.
Branches of low importance are removed from each page, and what its own tags declare to be no article.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import column, prepared, released, written

# Kinds of elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption address".split())
_NO_ARTICLE = frozenset("script style noscript template iframe svg nav footer aside form button select option input textarea dialog menu head title".split())
_PROSE = _FLOW | _INLINE | frozenset(["section", "article", "main"])  # no cue removes them: their names are often the author's
_CUES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent
    notice notices gdpr popup modal overlay sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead
    comment comments reply replies respond discussion disqus share sharing social related recommended recommendations newsletter subscribe
    subscription signup login search toolbar widget widgets pagination pager skip copyright""".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_STOP = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DEPTH = 24  # paths below this depth count as their ancestor's at it
GAMMA = 0.9


class Page:
    """A page as parallel lists of elements; ``inside`` has child element numbers and strings in order."""

    def __init__(self, text: str):
        self.tag, self.sign, self.parent, self.inside, self.noise = ["#root"], ["#root"], [-1], [[]], [False]
        self._parse(text)

    def _open(self, at: int, tag: str, attributes: str) -> int:
        found = {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes and not attributes.isspace() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".lower()
        role = found.get("role", "").lower()
        words = set(re.split(r"[^a-z]+", names)) - {""} if not names.isspace() else set()
        number_free = re.sub(r"\d+", "", found.get("id", "").lower())  # an id often numbers its page
        mark = ".".join([tag, *sorted(found.get("class", "").lower().split()), *([f"#{number_free}"] if number_free else []), *([role] if role else [])])
        n = len(self.tag)
        self.tag.append(tag)
        self.sign.append(re.sub(r"[\s>]+", "", mark))
        self.parent.append(at)
        self.inside.append([])
        masthead = tag == "header" and not any(self.tag[u] in ("article", "main") for u in _ancestors(self, at))
        self.noise.append(tag in _NO_ARTICLE or masthead or role in _ROLES or tag not in _PROSE and bool(words & _CUES))
        if tag in ("article", "main") or role in ("main", "article"):
            self.containers.append(n)
        self.inside[at].append(n)
        return n

    def _parse(self, text: str) -> None:
        self.containers: list[int] = []
        at, position, tag_of, parent = 0, 0, self.tag, self.parent
        while True:
            m = _TOKEN.search(text, position)
            if m is None:
                break
            if m.start() > position:
                self.inside[at].append(text[position : m.start()])
            position = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                up = at
                while up and tag_of[up] != tag:
                    up = parent[up]
                if up:
                    at = parent[up]
                elif tag in ("p", "br"):
                    self.inside[at].append(" ")
                continue
            if tag in _CLOSES_P:
                up = at
                while up and tag_of[up] != "p" and tag_of[up] in _INLINE:
                    up = parent[up]
                if up and tag_of[up] == "p":
                    at = parent[up]
            if tag in _CLOSES:
                up = at
                last = -1
                while up and tag_of[up] not in _STOP[tag]:
                    if tag_of[up] in _CLOSES[tag]:
                        last = up
                    up = parent[up]
                if last >= 0:
                    at = parent[last]
            n = self._open(at, tag, m[3] or "")
            if tag in _VOID or (m[3] or "").endswith("/") and tag not in _INLINE | _FLOW | {"div", "section", "article", "main"}:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(text, position)
                if tag in ("textarea", "title"):
                    self.inside[n].append(text[position : end.start()])
                position = max(end.end(), position)
                continue
            at = n
        if position < len(text):
            self.inside[at].append(text[position:])

    def paths(self) -> list[str]:
        out, depth = [""], [0]
        for n in range(1, len(self.tag)):
            up = self.parent[n]
            deep = depth[up] >= DEPTH
            out.append(out[up] if deep else f"{out[up]}>{self.sign[n]}")
            depth.append(depth[up] + (not deep))
        return out

    def blocks(self, roots: list[int], removed: set[int]) -> Iterator[tuple[int, str]]:
        """(element, text) of the blocks below the roots in page order, white space as one space."""
        for root in roots:
            held: list[str] = []
            owner = root
            stack = [(root, iter(self.inside[root]))]
            while stack:
                n, children = stack[-1]
                child = next(children, None)
                if child is None:
                    stack.pop()
                    if self.tag[n] not in _INLINE:
                        if text := " ".join(references.unescape("".join(held)).split()):
                            yield owner, text
                        held, owner = [], self.parent[n]
                elif isinstance(child, str):
                    held.append(child)
                elif child not in removed:
                    if self.tag[child] in _INLINE:
                        stack.append((child, iter(self.inside[child])))
                    else:
                        if text := " ".join(references.unescape("".join(held)).split()):
                            yield owner, text
                        held, owner = [], child
                        stack.append((child, iter(self.inside[child])))

    def subtree_has(self, wanted: list[int]) -> set[int]:
        """The wanted elements and all that hold one."""
        out: set[int] = set()
        for n in wanted:
            while n > 0 and n not in out:
                out.add(n)
                n = self.parent[n]
        return out


def evidence(page: Page) -> tuple[set[str], list[tuple[str, int]], list[tuple[str, int]], dict[str, int]]:
    """What a page adds to its host's tree: its paths; (path, hash) of the texts and of the child
    sequences; children a path."""
    paths = page.paths()
    skipped = {n for n in range(1, len(page.tag)) if page.tag[n] in ("script", "style", "template", "head")}
    texts = [(paths[n], hash_of(t)) for n, t in page.blocks([0], skipped)]
    styles, children = [], {}
    for n in range(1, len(page.tag)):
        if page.tag[n] not in _INLINE:
            inner = [page.sign[c] for c in page.inside[n] if not isinstance(c, str) and page.tag[c] not in _INLINE]
            styles.append((paths[n], hash_of(" ".join(inner))))
            children[paths[n]] = max(children.get(paths[n], 0), len(inner))
    return set(paths[1:]), texts, styles, children


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def site_rules(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 4, threshold: float = 0.3) -> DataFrame:
    """(host, path, importance): the branches to remove on a host, from all its pages.

    A text seen on n of a path's m pages has entropy log n / log m; a leaf's importance is one less their
    mean. A branch's is (1 - g**l) of its presentations' entropy and g**l of its texts' importance, where
    l is its number of children that are no inline elements, none in a paragraph. Paths with fewer than
    ``least_pages`` pages, and pages without a host, give no evidence.
    """

    def count(stream):
        held: dict[tuple[str, str, int, int], int] = {}

        def flushed():
            keys = list(zip(*held, strict=True)) if held else [[], [], [], []]
            out = pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.int32()), pa.array(keys[3], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["host", "path", "kind", "feature", "n"])
            held.clear()
            return out

        for batch in stream:
            for url, text in zip(column(batch, "url").to_pylist(), column(batch, "html").to_pylist(), strict=True):
                host = host_of(url)
                if not host or not text:
                    continue
                paths, texts, styles, children = evidence(Page(text))
                rows = {(p, 0, 0) for p in paths} | {(p, 1, f) for p, f in texts} | {(p, 2, f) for p, f in styles} | {(p, 3, n) for p, n in children.items()}
                for p, kind, f in rows:
                    key = (host, p, kind, f)
                    held[key] = held.get(key, 0) + 1
                if len(held) > 200_000:
                    yield flushed()
        yield flushed()

    source = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    counts = source.mapInArrow(released(count), "host string, path string, kind int, feature long, n long").groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    spread = F.col("n") * F.log("n")
    of = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what))
    nodes = counts.groupBy("host", "path").agg(
        of(0, F.col("n")).alias("m"), of(1, F.col("n")).alias("texts"), of(1, spread).alias("text_spread"), of(2, F.col("n")).alias("styles"), of(2, spread).alias("style_spread"),
        (of(3, F.col("n") * F.col("feature")) / of(3, F.col("n"))).alias("children"),
    )
    whole = F.log(F.greatest(F.col("m"), F.lit(2)))
    nodes = nodes.withColumn("text_importance", F.col("texts") - F.least(F.col("texts"), F.col("text_spread") / whole))
    up = nodes.where("texts is not null").select("host", F.explode(F.transform(F.sequence(F.lit(2), F.size(F.split("path", ">"))), lambda i: F.concat_ws(">", F.slice(F.split("path", ">"), 1, i)))).alias("path"), "texts", "text_importance")
    below = up.groupBy("host", "path").agg((F.sum("text_importance") / F.sum("texts")).alias("content"))
    style = (F.log("m") - F.col("style_spread") / F.col("styles")) / whole
    share = F.pow(F.lit(GAMMA), F.coalesce(F.col("children"), F.lit(0)))
    scored = nodes.where(F.col("m") >= least_pages).where("styles is not null").join(below, ["host", "path"])
    last = F.regexp_extract(F.element_at(F.split("path", ">"), -1), r"^([^.]*)", 1)
    scored = scored.withColumn("importance", (1 - share) * F.greatest(style, F.lit(0.0)) + share * F.col("content"))
    return scored.where((F.col("importance") < threshold) & ~last.isin("html", "body", "article", "main")).select("host", "path", "importance")


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", url or "")
    return m[1].lower() if m else ""


def main_text(text: str, rules: frozenset[str] | set[str] = frozenset()) -> str:
    """The article of a page whose host's unimportant branches are ``rules``. What the tags declare to be
    no article goes, and containers whose class or id says so; then the branches of the rules. Inside an
    article element the rules count only if they leave half of its text: what all pages of a host repeat
    may be copies of one article."""
    page = Page(text)
    usable = [n for n in page.containers if not page.noise[n] and not any(page.noise[u] for u in _ancestors(page, n))]
    guard = page.subtree_has(usable)
    declared = {n for n in range(1, len(page.tag)) if page.noise[n] and n not in guard}
    paths = page.paths() if rules else []
    found = {n for n in range(1, len(page.tag)) if n not in guard and paths[n] in rules} if rules else set()

    def read(roots: list[int]) -> str:
        whole = " ".join(t for _, t in page.blocks(roots, declared))
        part = " ".join(t for _, t in page.blocks(roots, declared | found)) if found else whole
        return whole if roots != [0] and 2 * len(part) < len(whole) else part

    inner = [n for n in usable if page.tag[n] == "article" and not any(page.tag[u] == "article" for u in _ancestors(page, n)[1:])]
    outer = [n for n in usable if not any(u in usable for u in _ancestors(page, n)[1:])]
    best = read(inner) if inner else ""
    if outer and outer != inner:
        more = read(outer)
        if len(best) * 2 < len(more):
            best = more
    return best or read([0])


def _ancestors(page: Page, n: int) -> list[int]:
    out = []
    while n > 0:
        out.append(n)
        n = page.parent[n]
    return out


MOST_RULES = 50_000


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``: the whole main text.

    A null or empty html gives an empty text; a null url or one without a host is read without a site's
    evidence, a null id stays null. Repeated rows give repeated rows (and count as pages of the site), an
    empty table none. Other columns are ignored. Up to MOST_RULES branches to remove are sent to all
    executors; more are joined to the pages by host instead.
    """
    spark = prepared(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rules = written(site_rules(source).select("host", "path"), "rules")
    few = rules.limit(MOST_RULES + 1).collect()
    by_host: dict[str, set[str]] = {}
    if len(few) <= MOST_RULES:
        for r in few:
            by_host.setdefault(r["host"], set()).add(r["path"])
        source = source.withColumn("rules", F.lit(None).cast("array<string>"))
    else:
        own = rules.groupBy("host").agg(F.collect_set("path").alias("rules"))

        @F.arrow_udf("string")
        def host(urls: pa.Array) -> pa.Array:
            return pa.array([host_of(u) for u in urls.to_pylist()], pa.string())

        source = source.withColumn("host", host("url")).join(own, "host", "left").drop("host")
    sent = spark.sparkContext.broadcast(by_host)

    def read(stream):
        for batch in stream:
            texts = []
            for url, text, own in zip(column(batch, "url").to_pylist(), column(batch, "html").to_pylist(), column(batch, "rules").to_pylist(), strict=True):
                texts.append(main_text(text, set(own) if own else sent.value.get(host_of(url), frozenset())) if text else "")
            yield pa.RecordBatch.from_arrays([column(batch, "page_id").cast(pa.int64()), column(batch, "url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(released(read), "page_id long, url string, text string, n_chars long")
