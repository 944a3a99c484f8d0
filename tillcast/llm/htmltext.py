"""Main text of web pages by a site style tree.

Pages of one host are merged to a tree of presentation nodes (the path of tags
and classes), their styles (what pages put below them) and content nodes (the
texts that stand there).  The importance of a content node is 1 minus the
entropy of its spread over the pages that have its presentation node, scaled to
0..1: a notice that every page repeats has 0, a paragraph that one page has of
its own has 1.  A presentation node's importance is the entropy of its styles;
its composite importance takes in those of all nodes below it.  Presentation
nodes that the markup names as navigation, advert, form or the like go whatever
their importance; article and main elements are a prior, in them only what
nearly all pages repeat is cut.  Branches in which every node has a low
composite importance go whole, and contents of low importance are cut one by
one from each page; the text of what is left is the result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import written

# fixed values: elements by what they stand for
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title nav menu header footer aside form button input select textarea "
                    "option iframe object embed svg canvas audio video dialog map datalist fieldset".split())
MAIN = frozenset("article main".split())
# words of class and id values that name a branch as no main text
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
                  "consent copyright disqus footer header menu nav navbar navigation newsletter notice notices popup promo "
                  "promoted related replies reply respond share sharing sidebar signup social sponsor sponsored "
                  "subscribe subscription toolbar widget".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: An element that opens closes these open ones, up to the nearest holder of such lists.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("article aside body div dl footer form header main nav ol section table td th ul blockquote".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                  "nav ol pre section table ul".split())

#: Share of a node's composite importance that the nodes below it give, for one style.
BELOW = 0.9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """Style name of an element (tag and classes) and whether its markup names it as noise."""
    name, noise = tag, tag in DROPPED
    if attributes and not attributes.isspace():
        for kind, *values in ATTRIBUTE.findall(attributes):
            words = next((v for v in values if v), "").lower().split()
            if kind.lower() == "role":
                noise |= bool(NOISE_ROLES.intersection(words))
                continue
            if kind.lower() == "class":
                name += "." + ".".join(words).replace("/", "|")      # a path is parted by /
            if tag == "article":       # themes name articles by topic and state, so only a whole word counts
                noise |= bool(NOISE.intersection(words))
            elif tag not in ("main", "body", "html"):
                noise |= any(part in NOISE for w in words for part in re.split(r"[-_]+", w))
        if re.search(r"\bhidden\b(?!\s*=)|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
            noise = True
    return name, noise


class Page:
    """Blocks of a page: style path, whether under noise, whether under an article, text."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool, str]] = []
        self.stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]   # tag, path, noise, main
        self.parts: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        if self.parts:
            # references are decoded in the whole block, as markup may part them from nothing
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip(" ")
            self.parts = []
            if text:
                _, path, noise, main = self.stack[-1]
                self.blocks.append((path, noise, main, text))

    def _pop_to(self, depth: int) -> None:
        self._flush()
        del self.stack[depth:]

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                self.parts.append(source[at:])
                break
            if m.start() > at:
                self.parts.append(source[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag)
                continue
            at = self._open(tag, m[3], source, at)
        self._flush()

    def _open(self, tag: str, attributes: str, source: str, at: int) -> int:
        if tag in INLINE:
            noise = _named(tag, attributes)[1] if attributes else False
            if noise:
                self._flush()
                self._push(tag, attributes)
            return at
        self._flush()
        if tag in VOID:
            return at
        if tag in BLOCK or tag in CLOSES:
            gone = CLOSES.get(tag, set()) | {"p"}
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth][0] in gone:
                    self._pop_to(depth)
                    if tag not in ("tr",):
                        break
                elif self.stack[depth][0] in HOLDERS:
                    break
        if attributes.rstrip().endswith("/"):
            return at
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            return end.end() if end else len(source)
        self._push(tag, attributes)
        return at

    def _push(self, tag: str, attributes: str) -> None:
        name, noise = _named(tag, attributes)
        _, path, under_noise, main = self.stack[-1]
        self.stack.append((tag, f"{path}/{name}", noise or under_noise, main or tag in MAIN))

    def _close(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self._pop_to(depth)
                return
            if tag == "p" and self.stack[depth][0] in HOLDERS:
                break
        if tag not in INLINE:
            self._flush()


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _content(path: str, text: str) -> int:
    return _key(f"{path}\n{text}")


def _chain(path: str) -> list[int]:
    """Keys of the element nodes from the root to ``path``, and last of the texts that stand right in it."""
    keys = [0]
    for name in [*path.split("/")[1:], "#text"]:
        keys.append(xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), seed=keys[-1]))
    return [k - (1 << 63) for k in keys]


def _tree(pages: DataFrame) -> DataFrame:
    """``(host, node, main, content, children, page)``: what each page puts at its nodes.

    A row with ``children`` is the style of an element node on the page: the
    nodes below it in page order, elements of one name merged.  Texts that stand
    right in an element are a leaf below it; a row with a ``content`` is one of
    its texts, a row without says that the page has the leaf.  ``page`` stands
    for the page's text, so copies of a page are one page.
    """
    names = ["host", "node", "main", "content", "children", "page"]

    def work(batches):
        for batch in batches:
            seen: set = set()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks = [b for b in Page(source or "").blocks if not b[1]]       # noise goes whatever its importance
                page = _key("\n".join(text for *_, text in blocks))
                below: dict[int, dict[int, None]] = {}
                mains: dict[int, bool] = {}
                chains: dict[str, list[int]] = {}
                for path, _, main, text in blocks:
                    if path not in chains:
                        chains[path] = chain = _chain(path)
                        under = False
                        for node, child, name in zip(chain, chain[1:], path.split("/")):
                            under |= name.split(".")[0] in MAIN
                            below.setdefault(node, {})[child] = None
                            mains[node] = under
                    leaf = chains[path][-1]
                    seen.add((host, leaf, main, None, None, page))
                    seen.add((host, leaf, main, _content(path, text), None, page))
                seen.update((host, node, mains[node], None, tuple(children), page) for node, children in below.items())
            if seen:
                host, node, main, content, children, page = zip(*seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host, pa.string()), pa.array(node, pa.int64()), pa.array(main, pa.bool_()),
                     pa.array(content, pa.int64()), pa.array(children, pa.list_(pa.int64())), pa.array(page, pa.int64())], names=names)

    return pages.select("host", "html").mapInArrow(
        work, "host string, node long, main boolean, content long, children array<long>, page long")


def _tree_counts(pages: DataFrame) -> DataFrame:
    """The rows of :func:`_tree` with ``n``, the pages that have each."""
    return written(_tree(pages).distinct().groupBy("host", "node", "main", "content", "children").agg(F.count("*").alias("n")),
                   "contents")


def _upward(tree: DataFrame, gathered: Column, joined: Column) -> DataFrame:
    """``tree(host, node, value, up, w)`` with each value joined with those of all nodes below.

    ``up`` is the node above and ``w`` its weight for this node.  Each round
    doubles the reach of ``up``, so the rounds are the logarithm of the depth.
    """
    while tree.filter("up is not null").take(1):
        got = tree.filter("up is not null").groupBy("host", F.col("up").alias("node")).agg(gathered.alias("got"))
        above = tree.select("host", F.col("node").alias("up"), F.col("up").alias("next"), F.col("w").alias("w_up"))
        tree = written(tree.join(got, ["host", "node"], "left").join(above, ["host", "up"], "left")
                       .select("host", "node", joined.alias("value"), F.col("next").alias("up"),
                               (F.col("w") * F.col("w_up")).alias("w")), "tree")
    return tree.select("host", "node", "value")


def style_tree(counts: DataFrame, least_pages: int, threshold: float, main_threshold: float) -> DataFrame:
    """``(host, node, up, main, pages, importance, composite, noisy)``: the site style tree of each host.

    With m the pages that have a node:

    * the importance of an element node is the entropy (base m) of its pages'
      styles; a leaf's is 1 minus the mean over its contents of ln(pages that
      have the content) / ln(m).
    * the composite importance of a leaf is its importance; an element node
      with l styles has (1 - 0.9^l) times its importance plus 0.9^l times the
      mean over its pages of the mean composite importance of the nodes in the
      page's style.
    * nodes on fewer than ``least_pages`` pages are not judged: importance 1.

    A node is noisy if its composite importance and those of all nodes below it
    are under the threshold (``main_threshold`` in article and main elements).
    """
    m, styles = F.col("pages"), F.col("styles")
    judged = m >= max(2, least_pages)
    leaf = F.max(F.col("children").isNull())
    own = counts.groupBy("host", "node").agg(
        F.max("main").alias("main"), leaf.alias("leaf"), F.sum(F.when(F.col("content").isNull(), F.col("n"))).alias("pages"),
        F.count("content").alias("texts"), F.count("children").alias("styles"),
        F.sum(F.when(F.col("content").isNotNull(), F.log("n"))).alias("text_logs"),
        F.sum(F.when(F.col("children").isNotNull(), F.col("n") * F.log("n"))).alias("style_logs"))
    entropy = F.greatest(F.lit(0.0), 1 - F.col("style_logs") / (m * F.log(m)))
    of_texts = 1 - F.col("text_logs") / (F.col("texts") * F.log(m))
    own = own.select("host", "node", "main", "leaf", "pages", "styles",
                     F.when(~judged, 1.0).when(F.col("leaf"), of_texts).otherwise(entropy).alias("importance"))
    shares = (counts.filter("children is not null")
              .select("host", "node", (F.col("n") / F.size("children")).alias("share"), F.explode("children").alias("child"))
              .groupBy("host", "node", "child").agg(F.sum("share").alias("share")))
    edges = (shares.join(own.filter(judged).select("host", "node", "pages", "styles"), ["host", "node"])
             .select("host", F.col("child").alias("node"), F.col("node").alias("up"),
                     (F.pow(F.lit(BELOW), styles) * F.col("share") / m).alias("w")))
    tree = written(own.join(edges, ["host", "node"], "left"), "tree")
    start = F.when(~judged | F.col("leaf"), F.col("importance")).otherwise((1 - F.pow(F.lit(BELOW), styles)) * F.col("importance"))
    composite = _upward(tree.select("host", "node", start.alias("value"), "up", "w"), F.sum(F.col("w") * F.col("value")),
                        F.col("value") + F.coalesce(F.col("got"), F.lit(0.0)))
    tree = written(tree.join(composite.withColumnRenamed("value", "composite"), ["host", "node"]), "tree")
    high = F.col("composite") >= F.when(F.col("main"), main_threshold).otherwise(threshold)
    some_high = _upward(tree.select("host", "node", high.alias("value"), "up", F.lit(1.0).alias("w")), F.max("value"),
                        F.col("value") | F.coalesce(F.col("got"), F.lit(False)))
    return (tree.join(some_high, ["host", "node"])
            .select("host", "node", "up", "main", "pages", "importance", "composite", (~F.col("value")).alias("noisy")))


def low_importance(pages: DataFrame, least_pages: int, threshold: float, main_threshold: float) -> DataFrame:
    """``(host, low)``: for each host what is of low importance, a sorted array.

    In it are the topmost noisy nodes of the host's style tree (see
    :func:`style_tree`), whose branches go whole, and single contents.  A
    content is a text at a node.  Its importance is 1 minus the logarithm of
    the pages that have it over that of the pages that have the node; copies of
    a page are one page.  Nodes on fewer than ``least_pages`` pages are not
    judged.  A content in the array stands on at least
    ``pages ** (1 - threshold)`` pages of its node, and a noisy node on at
    least ``least_pages`` pages, which bounds the array.
    """
    counts = _tree_counts(pages)
    tree = written(style_tree(counts, least_pages, threshold, main_threshold), "tree")
    noisy = tree.filter("noisy")
    top = noisy.join(noisy.select("host", F.col("node").alias("up")), ["host", "up"], "left_anti").select("host", F.col("node").alias("key"))
    nodes = tree.select("host", "node", "pages")
    judged = (counts.filter("content is not null and n >= 2").join(nodes, ["host", "node"])
              .filter(F.col("pages") >= max(2, least_pages)))
    least = F.when(F.col("main"), main_threshold).otherwise(threshold)
    contents = judged.filter(F.expr("1 - ln(n) / ln(pages)") < least).select("host", F.col("content").alias("key"))
    return contents.union(top).groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("low"))


def main_text(pages: DataFrame, least_pages: int = 4, threshold: float = 0.5, main_threshold: float = 0.1) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row.

    A page's text is its blocks in page order, joined by one space, without
    those under noise markup and those of low importance on their host.  Text
    in article or main elements must have ``main_threshold``, other text
    ``threshold``.  Character
    references are decoded, and white space in a block becomes one space.  Null
    and empty pages, and pages without main text, give the empty text.  Pages
    with a null url, or one without ``://``, share the empty host.  Unclosed and
    misplaced elements are mended; comments never count.  An empty table gives
    no rows.
    """
    base = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.coalesce(F.lower(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)), F.lit("")).alias("host"))
    low = written(low_importance(base, least_pages, threshold, main_threshold), "low_contents")
    joined = base.join(low, "host", "left").select("page_id", "url", "html", "low")

    def work(batches):
        for batch in batches:
            texts = []
            for source, contents in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                blocks = Page(source or "").blocks
                low = set(contents or ())
                gone = {path: not low.isdisjoint(_chain(path)) for path in {b[0] for b in blocks}} if low else {}
                kept = [text for path, noise, _, text in blocks
                        if not noise and not gone.get(path) and _content(path, text) not in low]
                texts.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(work, "page_id long, url string, text string, n_chars long")
