"""Main text of HTML pages: marked articles by their markup, other pages by differencing against the page of nearest URL.

A page that marks its article (article, main, role=main) says itself where the text is; there, markup decides. On any other
page the lines of the body are aligned with those of the nearest page of its host in order of URL path, by longest common
subsequence, and the lines that both share are deleted. Pages of a host with the same lines stand for one another, so that
copies don't delete each other; a page alone on its host keeps its lines.

Differencing by itself can't give the article of pages whose menus, adverts and footers differ from page to page: see README.

A null or empty page has an empty text. A null URL is a host of its own with an empty path. Repeated rows each get a result.
Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import cut

# Elements by what they are.
DROPPED = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea option menu dialog head title audio video map".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
PARTS = frozenset("ad ads advert advertisement adverts adsense sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs header site-header page-header masthead footer site-footer page-footer comment comments comment-list reader-comments disqus respond newsletter subscribe subscription signup share sharing social related recommended pagination pager toolbar widget skip-link".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKED = r"(?is)<(article|main)[\s>/]|[\s/\"']role\s*=\s*[\"']?main[\"'\s>]"

# Where HTML ends an element without an end tag: what starts no paragraph can hold, and what ends its like up to a wall.
BLOCKS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE = frozenset("html table template".split())
SPECIAL = BLOCKS | SCOPE | frozenset("body button tr tbody thead tfoot select".split())
_LIKE = {
    "li": (frozenset(["li"]), SPECIAL - {"address", "div", "p"}), "a": (frozenset(["a"]), SPECIAL), "button": (frozenset(["button"]), SCOPE),
    **dict.fromkeys(("dd", "dt"), (frozenset(["dd", "dt"]), SPECIAL - {"address", "div", "p"})), **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), TABLE | {"tr"})),
    "tr": (frozenset(["tr", "td", "th"]), TABLE), **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot caption colgroup tr td th".split()), TABLE)),
    **dict.fromkeys(("option", "optgroup"), (frozenset(["option"]), SPECIAL | {"optgroup"})), **dict.fromkeys(("rt", "rp"), (frozenset(["rt", "rp"]), SPECIAL | {"ruby"})),
}


class Open:
    """Names of the open elements, outermost first."""

    def __init__(self):
        self.names: list[str] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def cut(self, at: int) -> None:
        self.count.subtract(self.names[at:])
        del self.names[at:]

    def nearest(self, wanted: frozenset[str], walls: frozenset[str]) -> int:
        """Place of the innermost wanted element that no wall parts from here, or -1."""
        if any(self.count[x] for x in wanted):
            for k in range(len(self.names) - 1, -1, -1):
                if self.names[k] in wanted:
                    return k
                if self.names[k] in walls:
                    break
        return -1

    def start(self, name: str) -> None:
        """End what a start tag ends."""
        if self.count["head"] and name not in IN_HEAD:
            self.cut(self.names.index("head"))
        wanted, walls = _LIKE.get(name, (frozenset(), SPECIAL))
        while (at := self.nearest(wanted, walls)) >= 0:
            self.cut(at)
        if name in BLOCKS and (at := self.nearest(frozenset(["p"]), SCOPE | {"button"})) >= 0:
            self.cut(at)

    def end(self, name: str) -> int:
        """End what an end tag ends: the place from which elements are closed, or -1."""
        if not self.count[name]:
            return -1
        walls = SCOPE
        if name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            walls = TABLE
        elif name in INLINE:
            walls = SPECIAL
        elif name in ("p", "li"):
            walls = SCOPE | ({"button"} if name == "p" else {"ul", "ol"})
        at = self.nearest(frozenset([name]), walls)
        if at >= 0:
            self.cut(at)
        return at


def _dropped(name: str, attributes: str, inside: int) -> bool:
    if name in DROPPED or (name == "header" and not inside):
        return True
    if attributes and name not in ("html", "body", "article", "main"):
        for a, x, y, z in _ATTRIBUTE.findall(attributes):
            a, value = a.lower(), (x or y or z).lower()
            if a == "hidden" or (a == "aria-hidden" and value == "true") or (a == "role" and value in ROLES):
                return True
            if a in ("class", "id") and not PARTS.isdisjoint(re.split(r"[\s_]+", value)):
                return True
    return False


def _raw_end(page: str, name: str, at: int) -> int:
    close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return close.end() if close else len(page)


def _marks(attributes: str) -> bool:
    return any(a.lower() == "role" and re.match(r"\s*main\b", x or y or z, re.I) for a, x, y, z in _ATTRIBUTE.findall(attributes))


def page_lines(page: str) -> tuple[list[str], list[str], bool]:
    """Blocks inside the marked article, blocks of the whole body, and whether an article is marked."""
    article: list[str] = []
    body: list[str] = []
    parts: list[str] = []
    inside = 0
    roots: list[str] = []
    elements, skip = Open(), -1  # skip: the place of the dropped element that is open
    marked = False
    at = 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                body.append(text)
                if inside:
                    article.append(text)

    while True:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if skip >= 0 and elements.names[-1] == "head" and not chunk.isspace() and chunk:
            elements.cut(len(elements.names) - 1)  # a head holds no text
            skip = skip if skip < len(elements.names) else -1
        if skip < 0 and chunk:
            parts.append(chunk)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        empty = attributes.rstrip().endswith("/")
        ended = -1
        if closing:
            ended = elements.end(name)
        else:
            elements.start(name)
        if skip >= 0:
            if len(elements.names) > skip:
                if not closing and name in RAW and not (empty and elements.count["svg"]):
                    at = _raw_end(page, name, at)
                elif not closing and name not in VOID and not empty:
                    elements.push(name)
                continue
            own, skip = ended == skip, -1
            if own:
                continue
        if name == "br":
            parts.append(" ")
            continue
        if name in ("td", "th"):
            parts.append(" ")
        if closing:
            if name not in INLINE:
                end_block()
                if roots and name == roots[-1]:
                    roots.pop()
                    inside -= 1
                elif name in roots:
                    roots.remove(name)
                    inside -= 1
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        if _dropped(name, attributes, inside):
            if name not in INLINE:
                end_block()
            if name in RAW:
                at = _raw_end(page, name, at)
            elif not empty:
                elements.push(name)
                skip = len(elements.names) - 1
            continue
        if not empty:
            elements.push(name)
        if name not in INLINE:
            end_block()
        if name in ("article", "main") or _marks(attributes):
            marked = True
            roots.append(name)
            inside += 1
        elif name in roots:  # same name as an open root: keep the nesting right
            roots.append(name)
            inside += 1
    end_block()
    return article, body, marked


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of lines (Hunt and Szymanski's method)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chain: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    link = chain[-1] if chain else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _differenced(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) without a marked article -> page_id, url, text."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "lines": [page_lines(x or "")[1] for x in pdf["html"]]})

    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    own = cut(pages.select("page_id", "url", "html").mapInPandas(lines, "page_id long, url string, lines array<string>").withColumn("host", F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).withColumn("sum", F.md5(F.to_json("lines"))), "lines")
    # one page for all with the same lines on a host, in order of path; ranges of the order part hosts of any size
    first = own.groupBy("host", "sum").agg(F.min(F.struct("path", F.coalesce("page_id", F.lit(-1)).alias("p"), "lines")).alias("x")).select("host", "sum", "x.path", "x.p", "x.lines")
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(first.repartitionByRange(n, "host", "path", "p").sortWithinPartitions("host", "path", "p").withColumn("id", F.monotonically_increasing_id()), "order")
    sizes = ranged.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    from pyspark.sql import Window as W

    starts = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))
    ranked = ranged.withColumn("part", F.shiftright("id", 33)).join(starts, "part").withColumn("i", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1))
    side = lambda step, name: ranked.select((F.col("i") + step).alias("i"), F.col("host").alias(f"{name}_host"), F.struct("path", "lines").alias(name))
    near = ranked.join(side(1, "before"), "i", "left").join(side(-1, "after"), "i", "left")
    near = near.select("host", "sum", "path", "lines", F.when(F.col("before_host") == F.col("host"), F.col("before")).alias("before"), F.when(F.col("after_host") == F.col("host"), F.col("after")).alias("after"))

    def same(a: str, b: str) -> int:
        x, y = a.split("/"), b.split("/")
        return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for path, lines_, before, after in zip(pdf["path"], pdf["lines"], pdf["before"], pdf["after"], strict=True):
                a = list(lines_)
                others = [x for x in (before, after) if x is not None]
                if others:
                    nearest = max(others, key=lambda x: same(path, x["path"]))
                    gone = shared_lines(a, list(nearest["lines"]))
                    a = [x for k, x in enumerate(a) if k not in gone]
                texts.append("\n".join(a))
            yield pd.DataFrame({"host": pdf["host"], "sum": pdf["sum"], "text": texts})

    done = near.mapInPandas(difference, "host string, sum string, text string")
    return own.join(done, ["host", "sum"]).select("page_id", "url", "text")


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points)."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html")
    marked = F.coalesce(F.col("html").rlike(MARKED), F.lit(True)) | (F.col("html") == "")

    def by_markup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for x in pdf["html"]:
                article, body, found = page_lines(x or "")
                texts.append("\n".join(article if found else body))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})

    out = p.where(marked).mapInPandas(by_markup, "page_id long, url string, text string")
    out = out.unionByName(_differenced(p.where(~marked)))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
