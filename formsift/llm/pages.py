"""Main text of web pages by a site style tree.

A page is parsed once into elements and text blocks. Pages of a host share a
style tree: a node is a chain of elements (tag, words of class, id and role), so
equal chains of different pages are merged. What pages show at a node is its
presentation (the elements below it, in order) and its content (the block's text).

Importance of a node is a sum of evidence in log-odds:

* content: the entropy of the texts that the host's pages show there, over its
  largest value, from -2 (always the same) to 2 (always another);
* presentation: the entropies of the styles of the node and of UP - 1 elements
  above it, each worth half of the one below, from -0.75 to 0.75;
* marks: article and main, tags and class words of menus, headers, footers, side
  bars, notices, adverts, forms and comments (MARKS).

Entropies of few observations are drawn to what is usual. Pages of a host whose
marked or unmarked content is equal count once. Branches with negative importance
are removed from each page, and the rest is joined in page order. So an article's
block that a host repeats goes, and a paragraph under a class word of layout stays
if its texts differ; what is said in menus, adverts and comments differs from page
to page as main text does, so there the marks weigh most.

Scripts, styles, comments of the markup, the head's title and what browsers don't
show never make blocks; formulas and drawings are part of the line they stand in.
Elements that never end are ended by their parents or by the page.

Null html gives an empty text; a null url is a host of its own; repeated pages stay
separate rows with equal results. A page of any length is parsed in one pass, and
nodes are hashes, so deep trees cost no more than flat ones. Equal texts of a page
stay both. An empty table gives an empty result; columns of any names stay. If a
page marks an article or main element, blocks outside all of them start as
template; so they do below a wrapper that only has class words of layout, if no
article stands outside one."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift.llm.bpe import slices
from formsift.llm.common import Scratch, prepare, staged

#: Marks of a block, and their evidence.
CONTENT, LAYOUT_IN, UNKNOWN, LAYOUT, NOISE, OUTSIDE, NOISE_OUT = range(7)
MARKS = (2.3, 0.8, 0.3, -1.2, -2.6, -1.7, -4.0)
#: Observations that the usual entropy is worth, and the usual entropies of content and presentation.
WORTH, USUAL_CONTENT, USUAL_STYLE = 3, 0.6, 0.5
#: Elements whose presentation counts for a block: its own and those next above it.
UP = 4
#: Removed nodes whose keys are sent to all tasks, at 8 bytes each; beyond it they are joined.
MOST_SENT = 2_000_000
#: Parts of a page that are no content, by tag and by words of class, id or role (fixed values).
NOISE_TAGS = frozenset("nav header footer aside form menu dialog button select option label fieldset".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe annotation annotation-xml".split())
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs
    header masthead footer sidebar side aside widget related recommended share sharing social comment comments reply
    replies discussion notice notices cookie cookies consent gdpr alert popup modal newsletter subscribe signup login
    form search pagination pager copyright legal disclaimer""".split()
)
#: Of these, words of layout. What they mark repeats on a host's pages; if it doesn't, they name something else.
LAYOUT_WORDS = frozenset(
    """banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget
    notice notices cookie cookies consent gdpr alert popup modal form search pagination pager copyright legal disclaimer""".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end the block they stand in.
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold another language, all of it part of a line until an element of pages begins.
FOREIGN = frozenset(["svg", "math"])
#: A start of the first kind ends an open element of the second.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
#: Elements whose end is not looked for beyond them.
SCOPES = frozenset("html body table td th article section div main ul ol nav aside footer header form blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>?|([^<]+|<)", re.S)
NAMES = re.compile(r"(?:^|[\s/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
UNMARKED = frozenset("html body article main".split())
ANY_TAG = re.compile(r"</?[a-zA-Z]")


def name_words(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, in lower case and without numbers."""
    if "=" not in attributes:
        return ()
    found = {w.lower() for m in NAMES.finditer(attributes) for w in WORD.findall(m[1] or m[2] or m[3] or "")}
    return tuple(sorted(found))


def signed(*parts: int | str) -> int:
    """A 64-bit hash of the parts, as a signed number."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Open:
    """An open element: its node, the nodes next above, its style so far, and the
    marks that hold inside it (place: 0 outside articles, 1 in one, 2 in noise;
    layout: class words of layout below the last article; deep: such wrappers
    above an article that may come, or -1)."""

    __slots__ = ("tag", "label", "up", "style", "place", "layout", "deep", "level")

    def __init__(self, tag: str, label: str, up: tuple[int, ...], place: int, layout: bool, deep: int, level: int):
        self.tag, self.label, self.up, self.style = tag, label, up, 0
        self.place, self.layout, self.deep, self.level = place, layout, deep, level


def parse(html: str, host: str = "") -> tuple[list[tuple[tuple[int, ...], int, str]], Counter]:
    """Blocks in page order as (nodes from the own one upwards, mark, text), and how
    often each (node, style) occurs. Nodes are hashes of the host and the chain."""
    found: list[tuple[tuple[int, ...], int, bool, int, str]] = []
    styles: Counter = Counter()
    stack = [Open("", "", (signed(host),), 0, False, 0, -1)]
    parts: list[str] = []
    endless: set[str] = set()
    at, n, foreign = 0, len(html), 0

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                found.append((top.up, top.place, top.layout, top.level, text))
            parts.clear()

    def close(k: int):
        for e in stack[k:]:
            styles[e.up[0], e.style] += 1
        del stack[k:]

    while at < n:
        m = TOKEN.match(html, at)
        if m is None:
            break
        at = m.end()
        if m[6] is not None:
            parts.append(entities.unescape(m[6]) if "&" in m[6] else m[6])
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = bool(m[1] or m[4])
        if not ends and tag in RAW_TAGS:
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            if end is None:  # only what comes before the next tag is lost
                endless.add(tag)
                end = ANY_TAG.search(html, at)
                at = end.start() if end else n
            else:
                at = end.end()
            continue
        if foreign and (tag in CLOSES or tag in ("body", "b", "i", "span", "br", "img")):
            foreign = 0
        if tag in FOREIGN:
            if ends:
                foreign = max(0, foreign - 1)
            elif not (m[3] or "").rstrip().endswith("/"):
                foreign += 1
            continue
        if foreign:
            continue
        if ends:
            if tag in INLINE_TAGS:
                if stack[-1].tag == tag:  # one that holds noise
                    flush()
                    close(len(stack) - 1)
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag == "p" and stack[k].tag in SCOPES:
                    break
            continue
        names = name_words(m[3] or "")
        top = stack[-1]
        # An article inside another may be a reader's comment; an outer one's class words say nothing.
        named = tag not in UNMARKED or (tag == "article" and top.place == 1)
        said = NOISE_WORDS.intersection(names) if named else frozenset()
        noisy = tag in NOISE_TAGS or bool(said)
        if tag in VOID_TAGS:
            if tag not in INLINE_TAGS:
                flush()
            continue
        if tag in INLINE_TAGS and not noisy:
            if top.tag == tag:
                stack.append(Open(tag, top.label, top.up, top.place, top.layout, top.deep, top.level))
            continue
        flush()
        closes = CLOSES.get(tag, ())
        while len(stack) > 1 and stack[-1].tag in closes:
            close(len(stack) - 1)
        top = stack[-1]
        label = f"{tag}.{'.'.join(names)}"
        up = (signed(top.up[0], label), *top.up[: UP - 1])
        place, layout, deep, level = top.place, top.layout, top.deep, top.level
        if noisy:
            if tag not in NOISE_TAGS and said <= LAYOUT_WORDS:
                layout, deep = True, deep + 1 if deep >= 0 else -1
            else:
                place, deep = 2, -1
        elif tag in CONTENT_TAGS and place == 0 and (deep == 0 or (deep > 0 and NOISE_WORDS.intersection(names) <= LAYOUT_WORDS)):
            place, layout, level, deep = 1, False, deep, -1
        top.style = signed(top.style, label)
        stack.append(Open(tag, label, up, place, layout, deep, level))
    flush()
    close(1)
    levels = [level for _, place, _, level, _ in found if place == 1]
    low = min(levels, default=0)
    main = [place == 1 and level == low for _, place, _, level, _ in found]
    # Below layout words, only the outermost articles count, and only if they are not less than the unmarked rest.
    rest = sum(len(t) for _, place, layout, _, t in found if place == 0 and not layout)
    marked = any(main) and not (low and sum(len(x[4]) for x, inside in zip(found, main) if inside) < rest)
    out = []
    for (up, place, layout, level, text), inside in zip(found, main):
        if marked and inside:
            mark = LAYOUT_IN if layout else CONTENT
        elif marked:
            mark = NOISE if place == 2 and level == low else OUTSIDE if place == 0 and not layout else NOISE_OUT
        else:
            mark = NOISE if place == 2 else LAYOUT if layout or place == 1 else UNKNOWN
        out.append((up, mark, text))
    return out, styles


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


PARSED = "page bigint, keys array<bigint>, texts array<string>, nodes array<struct<key:bigint,mark:int,up:array<bigint>,texts:array<bigint>>>, styles array<struct<node:bigint,style:bigint,n:int>>"
NODES_ARROW = pa.list_(pa.struct([("key", pa.int64()), ("mark", pa.int32()), ("up", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))]))
STYLES_ARROW = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("n", pa.int32())]))


def tree_parts(html: str, host: str) -> tuple[int, list[int], list[str], list[dict], list[dict]]:
    """What a page gives to its host's tree: a hash of its content, the key (node
    and mark) and text of each block, its nodes and its styles."""
    found, styles = parse(html, host)
    nodes: dict[int, dict] = {}
    keys = []
    for up, mark, text in found:
        key = signed(up[0], mark)
        keys.append(key)
        nodes.setdefault(key, {"key": key, "mark": mark, "up": list(up), "texts": []})["texts"].append(signed(text))
    content = [h for x in nodes.values() if x["mark"] <= LAYOUT for h in x["texts"]] or [h for x in nodes.values() for h in x["texts"]]
    return signed(host, *content), keys, [t for *_, t in found], list(nodes.values()), [{"node": a, "style": b, "n": k} for (a, b), k in styles.items()]


def parse_pages(pages: DataFrame, kept: list[str], url: str, html: str) -> DataFrame:
    """The kept columns as k0, k1, ..., a row number, and the parts of the tree."""
    prepare(pages.sparkSession)
    source = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("row"), host_of(f"`{url}`").alias("host"), F.col(f"`{html}`").alias("html"))
    head = source.drop("host", "html")
    schema = head.sparkSession.createDataFrame([], PARSED).schema
    for field in reversed(head.schema.fields):
        schema.fields.insert(0, field)
    schema.names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = [tree_parts(h or "", host) for host, h in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), NODES_ARROW, STYLES_ARROW]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *[pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]], schema.names)

    return source.mapInArrow(run, schema)


def _entropy(n: str, clogc: str):
    """Entropy of counts over its largest value; of one observation 1."""
    return F.when(F.col(n) > 1, 1 - F.col(clogc) / (F.col(n) * F.log(n))).otherwise(F.lit(1.0))


def importance(parts: DataFrame) -> DataFrame:
    """(key, importance) of the nodes of all hosts' trees.

    Observations are counted by (node, text) and (node, style) before nodes are
    summed, both on the map side first, so a host with very many pages meets nowhere."""
    with Scratch(parts.sparkSession, "tree") as scratch:
        once = scratch.write(parts.select("page", "nodes", "styles").dropDuplicates(["page"]), "pages")
        both = lambda n: [F.sum(n).alias("n"), F.sum(F.col(n) * F.log(n)).alias("clogc")]
        drawn = lambda usual: (F.col("n") * _entropy("n", "clogc") + WORTH * usual) / (F.col("n") + WORTH)
        shown = once.select(F.explode("nodes").alias("x")).select("x.key", "x.mark", "x.up", F.explode("x.texts").alias("text"))
        shown = shown.groupBy("key", "mark", "up", "text").agg(F.count(F.lit(1)).alias("c"))
        nodes = scratch.write(shown.groupBy("key", "mark", "up").agg(*both("c")).select("key", "mark", "up", drawn(USUAL_CONTENT).alias("content")), "content")
        styled = once.select(F.explode("styles").alias("x")).groupBy("x.node", "x.style").agg(F.sum("x.n").alias("c"))
        styles = scratch.write(styled.groupBy("node").agg(*both("c")).select("node", drawn(USUAL_STYLE).alias("style")), "styles")
        weight = F.pow(F.lit(0.5), F.col("place"))
        above = nodes.select("key", F.posexplode("up").alias("place", "node")).join(styles, "node", "left")
        shape = above.groupBy("key").agg((F.sum(weight * F.coalesce("style", F.lit(USUAL_STYLE))) / F.sum(weight)).alias("shape"))
        mark = F.array(*[F.lit(m) for m in MARKS])[F.col("mark")]
        total = mark + 4 * (F.col("content") - 0.5) + 1.5 * (F.col("shape") - 0.5)
        return staged(nodes.join(shape, "key").select("key", F.round(total, 9).alias("importance")), "importance")


def kept_texts(parsed: DataFrame, low: DataFrame, columns: list[str], most: int = MOST_SENT) -> DataFrame:
    """The columns and `main`: the texts whose keys aren't in low, joined. Up to
    `most` keys go to all tasks; more are joined by key, and texts brought back by row."""
    if low.count() <= most:
        gone = np.sort(low.toArrow()["key"].to_numpy())
        source = parsed.select(*columns, "keys", "texts")
        schema = parsed.select(*columns, F.lit("").alias("main")).schema

        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    out = []
                    for keys, texts in zip(part.column(part.num_columns - 2), part.column(part.num_columns - 1).to_pylist()):
                        keys = keys.values.to_numpy()
                        at = np.searchsorted(gone, keys)
                        hit = gone[np.minimum(at, len(gone) - 1)] == keys if len(gone) else np.zeros(len(keys), bool)
                        out.append(" ".join([t for t, h in zip(texts, hit.tolist()) if not h]))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(out, pa.string())], schema.names)

        return source.mapInArrow(run, schema)
    blocks = parsed.select("row", F.posexplode(F.arrays_zip("keys", "texts")).alias("at", "x")).select("row", "at", F.col("x.keys").alias("key"), F.col("x.texts").alias("text"))
    rest = blocks.join(low, "key", "left_anti").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("x"))
    joined = parsed.select(*columns, "row").join(rest, "row", "left")
    return joined.select(*columns, F.coalesce(F.concat_ws(" ", F.col("x")["text"]), F.lit("")).alias("main"))


def extract_main(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", most: int = MOST_SENT) -> DataFrame:
    """pages with the main text in place of html; an older column `text` goes too."""
    kept = [c for c in pages.columns if c not in (html, text)]
    parsed = staged(parse_pages(pages, kept, url, html), "pages")
    low = staged(importance(parsed).where("importance < 0").select("key"), "low")
    columns = [f"k{i}" for i in range(len(kept))]
    return kept_texts(parsed, low, columns, most).select(*[F.col(k).alias(c) for k, c in zip(columns, kept)], F.col("main").alias(text))


def main_texts(pages: DataFrame) -> DataFrame:
    found = extract_main(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: Independent of the parser: right for pages whose article holds paragraphs, headings, breaks and bold text.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages
), t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a
), d AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g') AS x FROM t
), r AS (
  SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM d
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM r
"""
