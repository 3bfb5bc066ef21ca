"""Main text of web pages by consensus paths of hosts.

Pages of a host share a layout. Each page's containers are scored by the text that they hold outside links;
the best one's generalised path (tags and classes from the body down, digits dropped) is the page's vote. Votes
are counted for each host in Spark, and every page is extracted again by its host's winning path; pages without
that path fall back to their own best container.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .url_filters import host_and_path

#: A tag: quotes count after an equals sign only, and one that never closes is a character like others; the tag ends at the next `>`. No part backtracks.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)>""")
_CLASS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LONG_REFERENCE = re.compile("&#(?:[0-9]{1000,}+|[xX][0-9a-fA-F]{1000,}+);?")
#: Fixed lists of HTML: elements without content, elements whose content is no markup, elements that break lines.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template xmp iframe".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end where one of the same kind begins, and the elements that keep them apart.
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - set("br body html tbody td tfoot th thead tr caption option legend summary".split())
APART = set("article aside body blockquote button div dl figure footer form header main nav ol section table ul".split())
#: Never main text: by element, and by a word in class, id or role.
NOT_MAIN = set("aside button dialog footer form head header menu nav object select svg canvas math".split())
NOT_MAIN_WORD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|repl(?:y|ies)|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
PARAGRAPH = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "br"}


def step(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's part of a path (without digits and what divides a path), and whether it may hold main text."""
    names = " ".join(next(filter(None, m), "") for m in _CLASS.findall(attributes)) if attributes else ""
    classes = ".".join(sorted({re.sub(r"[\d>]+", "", c) for c in names.lower().split()}))
    return f"{tag}.{classes}" if classes else tag, tag not in NOT_MAIN and not (names and NOT_MAIN_WORD.search(names))


def unescaped(text: str) -> str:
    """Character references decoded; numbers too long for any character become the replacement character."""
    return html.unescape(_LONG_REFERENCE.sub("\ufffd", text) if "&#" in text else text) if "&" in text else text


class Layout:
    """Runs of text of a page in page order, and the paths they lie at, as a tree: each node is an element's part of
    a path below its parent's, so that depth costs nothing. Node 0 is the page itself.

    Unclosed and stray tags are put right as browsers do for paragraphs, items and cells. A tag or an element of raw text that
    never ends is dropped, and so is all after it. The time is proportional to the page's length."""

    def __init__(self, page: str):
        self.parent, self.part, self.depth, self.length = [0], [""], [0], [0]
        self.main, self.own, self.around = [True], [0], [0]  # own: the innermost element that keeps text apart; around: the one outside that
        self.children: dict[tuple[int, str], int] = {}
        self.runs: list[tuple[int, bool, bool, str, bool]] = []  # node, main, in a link, text, block ends before
        self._read(page)

    def _child(self, node: int, part: str) -> int:
        found = self.children.get((node, part))
        if found is None:
            found = self.children[node, part] = len(self.parent)
            self.parent.append(node)
            self.part.append(part)
            self.depth.append(self.depth[node] + 1)
            self.length.append(self.length[node] + len(part) + (node > 0))
            apart = part.split(".")[0] in APART
            self.own.append(found if apart else self.own[node])
            self.around.append(self.own[node] if apart else self.around[node])
        return found

    def path(self, node: int) -> str:
        parts = []
        while node:
            parts.append(self.part[node])
            node = self.parent[node]
        return ">".join(reversed(parts))

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, node, may be main, links around
        places: dict[str, list[int]] = defaultdict(list)  # of each tag in the stack
        apart: list[int] = []  # places of elements that keep text apart
        at, n, breaks = 0, len(page), True

        def close(place: int) -> None:
            while len(stack) > place:
                tag = stack.pop()[0]
                places[tag].pop()
                if tag in APART:
                    apart.pop()

        def text(first: int, last: int) -> bool:
            if last > first:
                top = stack[-1] if stack else ("", 0, True, 0)
                self.runs.append((top[1], top[2], top[3] > 0, unescaped(page[first:last]), breaks))
            return breaks and last <= first

        begin = 0  # of the text not yet given out
        while True:
            at = page.find("<", at)
            follows = page[at + 1 : at + 2] if at >= 0 else ""
            if at < 0:
                text(begin, n)
                return
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                breaks, begin = text(begin, at), end + 3 if end >= 0 else n
                at = begin
                continue
            if follows and follows in "!?":
                end = page.find(">", at)
                if end < 0:
                    text(begin, at)
                    return
                breaks, begin = text(begin, at), end + 1
                at = begin
                continue
            if not (follows == "/" or follows.isascii() and follows.isalpha()):
                at += 1
                continue
            m = _TAG.match(page, at)
            if not m:
                if follows == "/" and not (page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()):
                    at += 1
                    continue
                text(begin, at)
                return
            breaks, begin = text(begin, at), m.end()
            at = begin
            closing, tag, attributes = m[1], m[2].lower(), m[3]
            breaks = breaks or tag in BLOCK
            last_apart = apart[-1] if apart else -1
            if closing:
                if places[tag] and (tag in APART or places[tag][-1] > last_apart):
                    close(places[tag][-1])
            elif tag in RAW:
                found = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                end = page.find(">", found.end()) if found else -1
                if end < 0:
                    return
                at = begin = end + 1
            elif tag not in VOID and not ends_itself(attributes):
                place = max((places[t][-1] for t in (*ENDS_ITSELF.get(tag, ()), *(("p",) if tag in CLOSES_P else ())) if places[t]), default=-1)
                if place > last_apart:
                    close(place)
                part, main = step(tag, attributes)
                around = stack[-1] if stack else ("", 0, True, 0)
                places[tag].append(len(stack))
                if tag in APART:
                    apart.append(len(stack))
                stack.append((tag, self._child(around[1], part), main and around[2], around[3] + (tag == "a")))

    def scored(self) -> dict[int, float]:
        """Containers' scores: characters of main text outside links, all of it for the container that holds it
        and a half for the one around; text in links counts against them."""
        out: dict[int, float] = defaultdict(float)
        for node, main, link, text, _ in self.runs:
            size = len(text.strip())
            if main and size:
                worth = -size if link else size
                own = self.own[node]
                out[own] += worth
                if own:
                    out[self.around[node]] += worth / 2
        return out

    def best(self) -> tuple[str, float]:
        """The best container's path and score; of equals the shorter path, then the last by name."""
        found = self.scored()
        if not found:
            return "", 0.0
        most = max(found.values())
        equal = [node for node, score in found.items() if score == most]
        shortest = min(self.length[node] for node in equal)
        return max(self.path(node) for node in equal if self.length[node] == shortest), most

    def text_inside(self, path: str) -> str:
        """Main text inside elements of the path, blocks joined by one space."""
        steps = path.split(">") if path else []
        inside = [0 if steps else -1]  # steps matched so far; -1: all of them, -2: another path
        for node in range(1, len(self.parent)):
            k = inside[self.parent[node]]
            if k >= 0:
                k = (k + 1 if k + 1 < len(steps) else -1) if self.part[node] == steps[k] else -2
            inside.append(k)
        parts = [" " + text if breaks else text for node, main, _, text, breaks in self.runs if main and inside[node] == -1]
        return " ".join("".join(parts).split())


def ends_itself(attributes: str) -> bool:
    """`/` before the end of the tag, but not as the end of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    last = attributes.rsplit(None, 1)[-1]
    return "=" not in last or last[-2:-1] in ("'", '"')


def best(page: str) -> tuple[str, float]:
    return Layout(page).best()


def main_text(page: str, chosen: str | None) -> str:
    """Main text inside elements of the path `chosen`; by the page's own best container if there is none."""
    layout = Layout(page)
    text = layout.text_inside(chosen or "")
    if not text and chosen:
        own, _ = layout.best()
        if own != chosen:
            text = layout.text_inside(own)
    return text


def votes(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes, then most text, then first by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best(h or "") for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([int(s) for _, s in found], pa.int64())], ["host", "path", "score"])

    cast = pages.select(host_and_path(F.col("url"))[0].alias("host"), "html").mapInArrow(run, "host string, path string, score long")
    counted = cast.where("score > 0").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of `pages` (page_id, url, html).

    The pages meet their hosts' paths in one join; a host with very many pages is split by adaptive execution, as the paths
    are one row a host. Null or empty html: empty text. Null url, or one without a host: pages of the empty host. Repeated rows:
    extracted alike (and each votes). Very long pages are taken whole. Empty table: no rows. Other columns
    are not looked at."""
    chosen = written(votes(bounded_batches(pages)), "host-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h or "", p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    base = pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host")).join(chosen, "host", "left")
    return base.select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
