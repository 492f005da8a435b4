"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text, the links and the texts they hold.  In Spark the scores are
votes for generalised tag-and-class paths of the page's host: paths that hold most of the running text win, paths of
links, of the same text on every page or of a telling name are left out.  Every page is then read again inside its
innermost winning path, or its own best one if it lacks all, widened to what holds the rest of the same text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, staged, texts

#: Fixed facts of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BROAD = ("body", "center", "table", "tbody")
CONTAINER = frozenset("article body center div main section table tbody td tr".split())
#: What isn't main text: elements, roles, and words of class and id names.
SKIP_TAG = frozenset("head title nav header footer aside form script style noscript template iframe button select textarea svg canvas object dialog menu audio video".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
SKIP_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass(frozen=True)
class Settings:
    """``open_elements``: beyond so many, inline elements are only counted and containers belong to the outer one.
    ``running``: characters from which a block is running text.
    ``share``: of the running text of the pages that have a path, what it must hold to be a winner.
    ``minor``: a path with more of it than this is never boilerplate.
    ``linked``: of a path's characters, how many in links make it boilerplate.
    ``consensus``: pages on which the same text makes a path boilerplate.
    ``section``: of the text of what is held already, what a section beside it must hold to belong to it only if ``prose`` of it is running text.
    ``paths``: winners, and boilerplate paths, that a host hands to its pages at most, those of most pages; a page whose
    paths aren't among them is judged on its own."""

    open_elements: int = 512
    running: int = 60
    share: float = 0.5
    minor: float = 0.3
    linked: float = 0.5
    consensus: int = 3
    section: float = 0.2
    prose: float = 0.7
    paths: int = 256


@dataclass
class Node:
    """A container of a page: the outer one's place, its tag, its generalised path as a hash, whether its name tells boilerplate."""

    above: int
    tag: str
    path: int
    named: bool


def pieces(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in order."""
    pos, n, low = 0, len(source), None
    no_comment_end = False
    while pos < n:
        at = source.find("<", pos)
        if at < 0:
            yield "text", source[pos:], ""
            return
        if at > pos:
            yield "text", source[pos:at], ""
        if source.startswith("<!--", at):
            end = -1 if no_comment_end else source.find("-->", at + 4)
            no_comment_end = end < 0
            pos = n if end < 0 else end + 3
            continue
        nxt = source[at + 1 : at + 2]
        if nxt in ("!", "?"):
            end = source.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        shut = nxt == "/"
        m = NAME.match(source, at + 1 + shut)
        if not m:
            yield "text", "<", ""
            pos = at + 1
            continue
        end, tag = m.end(), m[0].lower()
        while end < n and source[end] != ">":
            if source[end] in "\"'" and source[end - 1] == "=":
                quote = source.find(source[end], end + 1)
                if quote < 0:
                    break
                end = quote
            end += 1
        attributes, pos = source[m.end() : end], min(n, end + 1)
        if shut:
            yield "close", tag, ""
            continue
        yield "open", tag, attributes
        if tag in RAW:
            low = low if low is not None else source.lower() if source.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), source)
            end = low.find(f"</{tag}", pos)
            pos = n if end < 0 else end


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}


def _skips(tag: str, names: dict[str, str]) -> bool:
    return tag in SKIP_TAG or names.get("role", "").lower() in SKIP_ROLE or "hidden" in names or names.get("aria-hidden", "").lower() == "true"


def _named(tag: str, names: dict[str, str]) -> bool:
    return tag not in ("html", "body", "article", "main") and any(w.lower() in SKIP_NAME for k in ("class", "id") for w in TOKENS.findall(names.get(k, "")))


def _step(tag: str, names: dict[str, str]) -> str:
    """A tag with its first three classes by name or, without any, its id; digits are left open."""
    general = lambda x: re.sub("[0-9]+", "#", x.lower())
    classes = sorted(map(general, names.get("class", "").split()))[:3]
    return ".".join([tag, *classes]) if classes else "#".join([tag, *filter(None, [general(names.get("id", ""))])])


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def blocks(source: str, s: Settings) -> tuple[list[tuple[str, int, int]], list[Node]]:
    """(text, of which characters in links, container) in page order, and the containers, outer ones first; the first is the page."""
    out: list[tuple[str, int, int]] = []
    nodes = [Node(-1, "", 0, False)]
    stack: list[tuple[str, int | None, bool, int]] = []  # tag, its node if it is a container, whether it is left out, place of the nearest block
    held = [0]  # nodes in the stack
    opened: Counter[str] = Counter()  # tags in the stack
    over: Counter[str] = Counter()  # inline tags that were only counted
    words, linked = [], 0

    def flush() -> None:
        nonlocal words, linked
        text = " ".join("".join(words).split())
        if text:
            out.append((text, linked, held[-1]))
        words, linked = [], 0

    def shut(upto: int) -> None:
        if stack[-1][3] >= upto:
            flush()
            over.clear()
        for tag, node, _, _ in stack[upto:]:
            opened[tag] -= 1
            if node is not None:
                held.pop()
        del stack[upto:]

    for kind, value, attributes in pieces(source):
        if kind == "text":
            if not (stack and stack[-1][2]):
                text = entities.unescape(value)
                words.append(text)
                if over["a"] or opened["a"]:
                    linked += len(text)
        elif kind == "close":
            if over[value]:
                over[value] -= 1
                continue
            for i in range(len(stack) - 1, -1, -1) if opened[value] else ():
                if stack[i][0] == value:
                    shut(i)
                    break
                if stack[i][0] in CONTAINER and value not in BLOCK:
                    break
            else:
                if value in BLOCK:
                    flush()
        else:
            if value in BLOCK:
                i = stack[-1][3] if stack else -1
                if i >= 0 and (stack[i][0] == "p" or stack[i][0] in CLOSES.get(value, ())):
                    shut(i)
                flush()
            if value == "br":
                words.append(" ")
            if value in VOID or attributes.endswith("/") and value not in BLOCK and value not in RAW:
                continue
            names = _names(attributes)
            skips = bool(stack and stack[-1][2]) or _skips(value, names)
            if len(stack) >= s.open_elements and value not in BLOCK and (not skips or stack[-1][2]):
                over[value] += value not in RAW
                continue
            node = None
            if value in CONTAINER and not skips and len(held) < s.open_elements:
                node, above = len(nodes), held[-1]
                named = _named(value, names)
                nodes.append(Node(above, value, _hash(nodes[above].path.to_bytes(8, "little", signed=True) + f"{_step(value, names)}{'!' * named}".encode("utf-8", "surrogatepass")), named))
                held.append(node)
            opened[value] += 1
            stack.append((value, node, skips, len(stack) if value in BLOCK else stack[-1][3] if stack else -1))
    flush()
    return out, nodes


def _worth(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked) + 10 * text.count(",")


@dataclass
class Sum:
    """What a path holds on a page: characters, those in links, those of running text, worth, a hash of its texts."""

    chars: int = 0
    linked: int = 0
    running: int = 0
    worth: int = 0
    same: int = 0
    node: int = 0

    def add(self, x: Sum) -> None:
        self.chars, self.linked, self.running, self.worth, self.same = self.chars + x.chars, self.linked + x.linked, self.running + x.running, self.worth + x.worth, self.same + x.same


def sums(found: list[tuple[str, int, int]], nodes: list[Node], s: Settings) -> dict[int, Sum]:
    """The sums of every path of a page; containers of one path are taken together."""
    of = [Sum() for _ in nodes]
    for text, linked, at in found:
        of[at].add(Sum(len(text), linked, len(text) if len(text) >= s.running and 2 * linked < len(text) else 0, _worth(text, linked), _hash(text.encode("utf-8", "surrogatepass"))))
    for i in range(len(nodes) - 1, 0, -1):
        of[nodes[i].above].add(of[i])
    out: dict[int, Sum] = {}
    for i, node in enumerate(nodes):
        out.setdefault(node.path, Sum(node=i)).add(of[i])
    return out


def _boilerplate(x: Sum, total: int, named: bool, s: Settings) -> bool:
    """The rule of one page, where no votes are at hand."""
    return named or x.worth <= s.minor * total and x.linked >= s.linked * x.chars > 0


def _belongs(tag: str, inside: Sum, around: Sum, s: Settings) -> bool:
    """Whether what the container around a path adds to it is headings, sections and other running text."""
    size, linked, running, worth = around.chars - inside.chars, around.linked - inside.linked, around.running - inside.running, around.worth - inside.worth
    large = worth >= s.section * inside.worth
    return size == 0 or 3 * linked <= size and ((tag not in BROAD and not large) or (large and running >= s.prose * size))


def widened(of: dict[int, Sum], nodes: list[Node], path: int, climbs: frozenset[int] | None, s: Settings) -> int:
    """The innermost article around the path, else the innermost main.  Without one, containers around it are taken in
    as long as they belong to it: by the host's votes, or by the page alone where ``climbs`` is None."""
    chain, at = [], of[path].node
    while at > 0:
        chain.append(nodes[at])
        at = nodes[at].above
    for tag in ("article", "main"):
        for node in chain:
            if node.tag == tag:
                return node.path
    for node in chain[1:]:
        if not (path in climbs if climbs is not None else _belongs(node.tag, of[path], of[node.path], s)):
            break
        path = node.path
    return path


def host_of(url: str) -> str:
    m = re.match(r"[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
    return re.sub(r"^www\.", "", m[1].lower()) if m else ""


@dataclass(frozen=True)
class Verdict:
    """What the votes of a host say: paths that win, those of them that the container around belongs to, paths left out;
    ``whole`` if no more paths are judged so."""

    winners: frozenset[int] = frozenset()
    climbs: frozenset[int] = frozenset()
    left_out: frozenset[int] = frozenset()
    whole: bool = False


def main_text(source: str, verdict: Verdict = Verdict(), s: Settings = Settings()) -> str:
    """The blocks inside the innermost winning path, or inside the page's own, but for boilerplate paths, joined by line ends.

    Paths that a partial verdict doesn't name are judged by the page.  If all is boilerplate, nothing is left out.
    """
    found, nodes = blocks(source, s)
    of, left_out = sums(found, nodes, s), verdict.left_out
    if not verdict.whole:
        left_out = left_out | {n.path for n in nodes[1:] if n.path not in verdict.winners and _boilerplate(of[n.path], of[0].worth, n.named, s)}
    out = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        out[i] = out[node.above] or node.path in left_out
    if kept := [b for b in found if not out[b[2]]]:
        found, of = kept, sums(kept, nodes, s)
    depth = [0] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        depth[i] = depth[node.above] + 1
    usable = [n for n in nodes[1:] if of[n.path].worth]
    voted = [n for n in usable if n.path in verdict.winners]
    best = voted or [n for n in usable if n.tag in ("article", "main")] or [n for n in usable if of[n.path].worth >= s.share * of[0].worth]
    path = max((depth[of[n.path].node], of[n.path].worth, n.path) for n in best)[2] if best else 0
    path = widened(of, nodes, path, verdict.climbs if voted else None, s) if path else 0
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside[i] = node.path == path or (i > 0 and inside[node.above])
    return "\n".join(text for text, _, at in found if inside[at])


VOTES = "host string, path long, above long, tag string, named boolean, pages long, chars long, linked long, running long, worth long, around long, low long, high long"
SUMS, VOTE = ("chars", "linked", "running", "worth"), 1_000_000


def _vote(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """What each host's paths hold on a batch's pages, in millionths of a page: a page has one vote however long it is."""
    names = [x.split()[0] for x in VOTES.split(", ")]
    for batch in batches:
        tally: dict[tuple[str, int], list] = {}
        for url, source in zip(texts(batch, "url"), texts(batch, "html"), strict=True):
            found, nodes = blocks(source, s)
            of, host = sums(found, nodes, s), host_of(url)
            size, worth = max(1, of[0].chars), max(1, of[0].worth)
            for path, x in of.items():
                node = nodes[x.node]
                same = _hash((x.same & (1 << 64) - 1).to_bytes(8, "little")) if x.chars else 0
                row = tally.setdefault((host, path), [nodes[node.above].path if x.node else None, node.tag, node.named, 0, 0, 0, 0, 0, 0, same, same])
                shares = (x.chars * VOTE // size, x.linked * VOTE // size, x.running * VOTE // size, x.worth * VOTE // worth)
                for i, more in enumerate((1, *shares, VOTE if of[0].worth else 0), 3):
                    row[i] += more
                row[9], row[10] = min(row[9], same), max(row[10], same)
        cols = [list(c) for c in zip(*((*k, *v) for k, v in tally.items()))] or [[] for _ in names]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 8]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _extract(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    known: dict[str, Verdict] = {}
    for batch in batches:
        got = []
        for source, host, *lists, whole in zip(texts(batch, "html"), *(batch.column(c).to_pylist() for c in ("host", "winners", "climbs", "left_out", "whole")), strict=True):
            if host not in known:
                if len(known) > 4096:
                    known.clear()
                known[host] = Verdict(*(frozenset(x or ()) for x in lists), bool(whole))
            got.append(main_text(source, known[host], s))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def verdicts(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, winners, climbs, left_out, whole): a Verdict for each host.

    Votes are sums over all pages of a host, each page's in shares of it.  A path wins if it holds ``share`` of the running text of the pages that
    have it.  One with a minor part of that text is left out for its links, for the same text on all its pages or for its
    name; where fewer than ``consensus`` pages vote, its name alone does.  A winner climbs if what the container around
    it adds, boilerplate aside, belongs to it.
    """
    s = settings
    votes = map_batches(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), _vote, VOTES, s)
    total = votes.groupBy("host", "path").agg(F.first("above").alias("above"), F.first("tag").alias("tag"), F.first("named").alias("named"), *(F.sum(c).alias(c) for c in ("pages", *SUMS, "around")), F.min("low").alias("low"), F.max("high").alias("high"))
    minor, few = F.col("worth") <= s.minor * F.col("around"), F.col("pages") < s.consensus
    dull = F.col("named") | ((F.col("linked") >= s.linked * F.col("chars")) & (F.col("chars") > 0)) | (~few & (F.col("chars") > 0) & (F.col("low") == F.col("high")))
    out = (F.col("path") != 0) & ((minor & dull) | (few & F.col("named")))
    wins = (F.col("path") != 0) & ~out & (F.col("worth") > 0) & (F.col("worth") >= s.share * F.col("around"))
    judged = staged(total.select("host", "path", "above", "tag", "pages", *SUMS, out.alias("out"), wins.alias("wins")), "votes")
    gone = judged.filter("out").groupBy(F.col("host").alias("g_host"), F.col("above").alias("g_path")).agg(*(F.sum(c).alias(f"g_{c}") for c in SUMS))
    around = judged.filter("path <> 0 and not out").join(gone, (F.col("host") == F.col("g_host")) & (F.col("path") == F.col("g_path")), "left")
    around = around.select(F.col("host").alias("a_host"), F.col("path").alias("a_path"), F.col("tag").alias("a_tag"), *((F.col(c) - F.coalesce(f"g_{c}", F.lit(0))).alias(f"a_{c}") for c in SUMS))
    size, linked, running, worth = (F.col(f"a_{c}") - F.col(c) for c in SUMS)
    large = worth >= s.section * F.col("worth")
    belongs = (size == 0) | ((3 * linked <= size) & ((~F.col("a_tag").isin(*BROAD) & ~large) | (large & (running >= s.prose * size))))
    judged = judged.filter("out or wins").join(around, (F.col("host") == F.col("a_host")) & (F.col("above") == F.col("a_path")), "left")
    ranked = judged.select("host", "path", "pages", "out", "wins", (F.col("wins") & F.coalesce(belongs, F.lit(False))).alias("climbs"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("host", "out").orderBy(F.desc("pages"), "path"))).filter(F.col("n") <= s.paths + 1)
    kept = lambda c, name: F.collect_list(F.when(F.col(c) & (F.col("n") <= s.paths), F.col("path"))).alias(name)
    return ranked.groupBy("host").agg(kept("wins", "winners"), kept("climbs", "climbs"), kept("out", "left_out"), (F.max("n") <= s.paths).alias("whole"))


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html gives the empty text; a null or odd url belongs to the host of no name; rows that repeat an id get a row
    each; of equal votes all win and the innermost on a page is taken.  Verdicts meet the pages by host; pages of a
    crowded host are split over tasks by adaptive execution.  Other columns are not looked at.
    """
    best = staged(verdicts(pages, settings), "verdicts").withColumnRenamed("host", "of_host")
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    rows = rows.join(best, rows.host == best.of_host, "left").select("page_id", "url", "html", "host", "winners", "climbs", "left_out", "whole")
    return map_batches(rows, _extract, "page_id long, url string, text string, n_chars long", settings)
