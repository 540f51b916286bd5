"""Main text of web pages: structure first, then what a host repeats from page to page.

Tags say of most blocks whether they are the article (inside `article` or `main`) or not (menus, footers,
adverts and so on). A page without any article leaves its remaining blocks open. The
token streams of all of a host's pages are taken as one text, whose suffixes are put together by
their first RUN tokens, as in a suffix array cut at that depth: suffixes of different pages with
one prefix are a repeated substring of at least RUN tokens. Tokens covered by such substrings go;
the runs between them stay. An article is evidence against that: in it only what most of the host's
pages repeat goes, and never half of it or more.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from minutary.llm import batches, decontaminate, hashing
from minutary.session import remove, settle, work_dir

# Tokens that make a repeated substring long, and pages of a host that make it boilerplate.
RUN = 8
PAGES = 3
# Share of a host's pages that makes it so within an article too.
SHARE = 0.5
PAGES_IN_HAND = 64
PAGES_REMEMBERED = 1 << 18
# Bits of a counted key that tell hosts apart; hosts that share them share the smallest bound.
HOST_BITS = 24
BASES = hashing.P4, hashing.P5

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?][^>]*+>",
    re.I | re.S,
)
# Elements whose content holds no tags, and their ends.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in "script style textarea title iframe noscript noframes noembed xmp".split()}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)

# HTML's elements and the usual names of parts of pages (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
NOT_MAIN = set("nav footer aside form button select dialog menu head object canvas audio video datalist svg template".split())
PART_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus replies respond "
    "share sharing social related newsletter subscribe subscription popup modal overlay toolbar pagination complementary contentinfo "
    "search dialog masthead adsbygoogle advertorial commentlist commentform discussion reviews".split()
)
# What may stand beside them in the name of such a part.
BESIDE_NAMES = set(
    "area bar block blocks body bottom box button buttons content container desktop form group holder inner item items left link links list "
    "main mobile outer page panel placeholder post posts primary right row secondary section site slot social star stories sub text title "
    "top unit user users widget widgets wrap wrapper".split()
)
HEAD_NAMES = set("header banner masthead".split())

# HTML's rules for end tags that may be left out (fixed values).
SPECIAL = BLOCKS | NOT_MAIN
IN_HEAD = set("base link meta title script style noscript template".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = set("table caption colgroup thead tbody tfoot tr td th".split())
END_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
# A start tag ends the nearest of the first tags that is not beyond one of the second.
ENDS = {
    "li": ({"li"}, SPECIAL - {"address", "div", "p"}),
    "dd": ({"dd", "dt"}, SPECIAL - {"address", "div", "p"}),
    "option": ({"option"}, SPECIAL),
    "button": ({"button"}, {"table", "td", "th", "caption"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
ENDS |= {"dt": ENDS["dd"], "th": ENDS["td"], "thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Tags that cannot stand in svg and end it.
END_SVG = (BLOCKS | FORMATTING | {"br", "img", "span", "embed", "sub", "sup", "var", "ruby"}) - {"a", "font"}


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name in lower case; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(text):
        found.setdefault(match[1].lower(), match[2] or match[3] or match[4] or "")
    return found


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """Names in class, id and role, each as its parts in lower case."""
    found = []
    for name in " ".join(attributes.get(each, "") for each in ("class", "id", "role")).split():
        found.append([part for part in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if part])
    return found


def _is_part(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is a part of the page that is not its main text."""
    if tag in NOT_MAIN or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    named = _attributes(attributes)
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(named.get("style", "")):
        return True
    for parts in _names(named):
        names = PART_NAMES if in_article else PART_NAMES | HEAD_NAMES
        # All of a name has to speak of such a part: "related-links", not "related-work".
        if names & set(parts) and set(parts) <= names | BESIDE_NAMES:
            return tag != "article" or bool({"comment", "comments"} & set(parts))
    return False


class _Open:
    """Open elements, outermost first, and which of them is skipped with all that it holds."""

    def __init__(self):
        self.tags: list[str] = []
        self.counts: dict[str, int] = {}
        self.skipped: int | None = None

    def has(self, tag: str) -> bool:
        return self.counts.get(tag, 0) > 0

    def push(self, tag: str, skip: bool) -> None:
        if skip and self.skipped is None:
            self.skipped = len(self.tags)
        self.tags.append(tag)
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def cut(self, at: int) -> None:
        for tag in self.tags[at:]:
            self.counts[tag] -= 1
        del self.tags[at:]
        if self.skipped is not None and self.skipped >= at:
            self.skipped = None

    def nearest(self, wanted: set[str], bounds: set[str]) -> int | None:
        if any(map(self.has, wanted)):
            for at in range(len(self.tags) - 1, -1, -1):
                if self.tags[at] in wanted:
                    return at
                if self.tags[at] in bounds:
                    return None
        return None

    def start(self, tag: str) -> None:
        """Ends what the start tag `tag` ends."""
        if self.has("head") and tag not in IN_HEAD:
            self.cut(self.tags.index("head"))
        if tag in END_SVG and self.has("svg"):
            at = self.nearest({"svg"}, {"foreignobject", "desc"})
            if at is not None:
                self.cut(at)
        if tag in ENDS:
            at = self.nearest(*ENDS[tag])
            if at is not None:
                self.cut(at)
        if tag in END_P:
            at = self.nearest({"p"}, {"table", "td", "th", "caption", "button", "object", "template", "svg"})
            if at is not None:
                self.cut(at)
        if tag in HEADINGS and self.tags and self.tags[-1] in HEADINGS:
            self.cut(len(self.tags) - 1)

    def end(self, tag: str) -> None:
        """The end tag `tag`, which also ends all elements within. One without a start is passed over."""
        if not self.has(tag):
            return
        if tag in FORMATTING:
            at = self.nearest({tag}, {"table", "td", "th", "caption"})
            if at is not None:
                self._take_out(at)
            return
        if tag in TABLE_PARTS:
            bounds = {"table"} - {tag}
        elif tag not in SPECIAL:
            bounds = SPECIAL
        elif self.skipped is not None:
            # The end of what holds a skipped element ends that too.
            bounds = set()
        else:
            bounds = {"table", "td", "th", "caption"} | ({"ul", "ol"} if tag == "li" else {"button"} if tag == "p" else set())
        at = self.nearest({tag}, bounds)
        if at is not None:
            self.cut(at)

    def _take_out(self, at: int) -> None:
        """One element goes; those within stay open."""
        self.counts[self.tags.pop(at)] -= 1
        if self.skipped is not None and at <= self.skipped:
            self.skipped = None if at == self.skipped else self.skipped - 1


def page_parts(html: str) -> tuple[list[str], list[str], bool]:
    """The texts of a page's main blocks and of its other unskipped blocks, in order, and whether
    its tags name the main ones.

    Where there are both, `article` is the main text if it holds at least as much text as `main` holds
    outside of articles; else `main` with all in it.
    """
    found: list[tuple[bool, bool, str]] = []
    parts: list[str] = []
    tree = _Open()
    inside = False, False

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((*inside, text))

    def read(text: str) -> None:
        nonlocal inside
        if tree.has("head") and text.strip():
            tree.cut(tree.tags.index("head"))
        if tree.skipped is None:
            if not parts:
                inside = tree.has("article"), tree.has("main")
            parts.append(unescape(text) if "&" in text else text)

    at = 0
    while match := _MARKUP.search(html, at):
        if match.start() > at:
            read(html[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if not tag:
            continue
        attributes = match["rest"]
        if match["close"]:
            if tag not in ("html", "body"):
                tree.end(tag)
            if tag in BLOCKS and tree.skipped is None:
                flush()
            continue
        if tag in RAW and not (tree.has("svg") and attributes.endswith("/")):
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        tree.start(tag)
        if tag in BLOCKS and tree.skipped is None:
            flush()
        if tag == "br":
            read(" ")
        if tag in VOID or tag in ("html", "body") or (tag == "head" and tree.tags):
            continue
        if attributes.endswith("/") and (tag == "svg" or tree.has("svg")):
            continue
        part = tree.skipped is None and _is_part(tag, attributes, tree.has("article"))
        if part and tag not in ("svg", "template"):
            flush()
        tree.push(tag, part)
    read(html[at:])
    flush()

    in_articles = sum(len(text) for article, _, text in found if article)
    in_main = sum(len(text) for article, main, text in found if main and not article)
    known = in_articles + in_main > 0
    chosen = [not known or (article if in_articles >= in_main else main) for article, main, _ in found]
    blocks = [text for (_, _, text), own in zip(found, chosen) if own]
    return blocks, [text for (_, _, text), own in zip(found, chosen) if not own], known


def page_blocks(html: str) -> tuple[list[str], bool]:
    """The texts of a page's main blocks in order, and whether its tags name them so."""
    blocks, _, known = page_parts(html)
    return blocks, known


def _packed(pages: DataFrame) -> DataFrame:
    """(rest, host, html) for every page; `rest` holds all columns but html."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    others = [F.col(name) for name in pages.columns if name != "html"]
    return pages.select(F.struct(*others).alias("rest"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def _parsed(source):
    """Slices of packed pages: the batch, hosts, `page_parts`, and a number for each page's text (its main blocks)."""
    for batch in batches.pieces(source, PAGES_IN_HAND):
        parts = [page_parts(html) for html in batch.column("html").to_pylist()]
        texts = np.array([xxhash.xxh64_intdigest("\n".join(blocks)) for blocks, _, _ in parts], dtype=np.uint64).view(np.int64)
        yield batch, batch.column("host").to_pylist(), parts, texts


def _told(source):
    """Slices of pages that have a text, as (hosts, parts, texts), without those that the task had before. What it
    remembers is bounded; a page told twice counts once in the end."""
    had: set[tuple[str, int, int]] = set()
    for _, hosts, parts, texts in _parsed(source):
        new = []
        for row, (host, (blocks, others, known), text) in enumerate(zip(hosts, parts, texts.tolist())):
            same = host, text, xxhash.xxh64_intdigest("\n".join(others), known)
            if blocks and same not in had:
                had.add(same)
                new.append(row)
        if len(had) > PAGES_REMEMBERED:
            had.clear()
        if new:
            yield [hosts[row] for row in new], [parts[row] for row in new], texts[new]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * hashing.P1
    values = (values ^ (values >> np.uint64(29))) * hashing.P2
    return values ^ (values >> np.uint64(32))


def _tokens(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of lists of blocks, one list after the other, and which list each is of."""
    words = [" ".join(blocks).encode("utf-8").lower().split() for blocks in texts]
    owner = np.repeat(np.arange(len(words)), [len(own) for own in words])
    if not len(owner):
        return np.zeros(0, dtype=np.uint64), owner
    joined, starts, ends, _ = hashing.shingle_spans(words, 1)
    return hashing.xxh64_spans(joined, starts, ends, 0), owner


def _prefixes(tokens: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of the `size` tokens that begin at each token, as far as there are so many."""
    starts = max(len(tokens) - size + 1, 0)
    found = np.zeros(starts, dtype=np.uint64)
    for nth in range(size):
        found = found * base + tokens[nth : nth + starts]
    return _mixed(found)


def _whole(owner: np.ndarray, run: int) -> np.ndarray:
    """Where `run` tokens of one list begin."""
    return np.flatnonzero(owner[: max(len(owner) - run + 1, 0)] == owner[run - 1 :])


def _least_inner(tokens: np.ndarray, run: int) -> np.ndarray:
    """For every run of tokens the least hash of the shorter runs within, which half of the tokens make.
    Equal runs have equal ones, and neighbours mostly share theirs."""
    short = max(run // 2, 1)
    inner = _prefixes(tokens, short, hashing.P3)
    width = run - short + 1
    if len(inner) < width:
        return np.zeros(0, dtype=np.uint64)
    return np.lib.stride_tricks.sliding_window_view(inner, width).min(axis=1)


def _bucket(host: str) -> int:
    return xxhash.xxh64_intdigest(host) >> (64 - HOST_BITS)


def _keys(hosts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The buckets of hosts above the first bits of hashes."""
    return (hosts << np.uint64(64 - HOST_BITS)) | (_mixed(least) >> np.uint64(HOST_BITS))


def _runs_of(hosts: list[str], parts: list, run: int) -> tuple[np.ndarray, ...]:
    """(page, tokens, start, key) of all runs in the blocks of pages, main or other."""
    tokens, owner = _tokens([blocks for own in parts for blocks in own[:2]])
    starts = _whole(owner, run)
    page = owner[starts] // 2
    buckets = np.array([_bucket(host) for host in hosts], dtype=np.uint64)
    return page, tokens, starts, _keys(buckets[page], _least_inner(tokens, run)[starts])


def _slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter."""
    mask, high = np.uint64(decontaminate.FILTER_BITS - 1), key >> np.uint64(64 - HOST_BITS)
    return (key ^ high) & mask, ((key >> np.uint64(16)) ^ high) & mask


def _passes(flags: np.ndarray, key: np.ndarray) -> np.ndarray:
    first, second = (flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) for at in _slots(key))
    return (first & second & np.uint8(1)) == 1


def _counted(pages: DataFrame, run: int) -> DataFrame:
    """Rows to count: (key, n) for the keys of runs, and (key, host, text, open) for each text, where the
    key has the bucket of the host alone."""

    def step(source):
        for hosts, parts, texts in _told(source):
            page, _, _, key = _runs_of(hosts, parts, run)
            order = np.lexsort((key, page))
            page, key = page[order], key[order]
            once = batches.run_starts(page, key)
            keys, counts = np.unique(key[once], return_counts=True)
            buckets = np.array([_bucket(host) for host in hosts], dtype=np.uint64) << np.uint64(64 - HOST_BITS)
            none = [None] * len(keys)
            yield {
                "key": np.concatenate([keys, buckets]).view(np.int64),
                "n": np.concatenate([counts, np.ones(len(hosts), dtype=np.int64)]),
                "host": [*none, *hosts],
                "text": pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(texts)]),
                "open": [*none, *(not known for _, _, known in parts)],
            }

    return batches.map_arrow(_packed(pages), step, "key long, n long, host string, text long, open boolean")


def _repeats(pages: DataFrame, run: int, flags: np.ndarray) -> DataFrame:
    """(first, second, host, text): two hashes of each run whose key passes the filter, and where it is."""
    shared = pages.sparkSession.sparkContext.broadcast(flags)

    def step(source):
        for hosts, parts, texts in _told(source):
            page, tokens, starts, key = _runs_of(hosts, parts, run)
            hits = np.flatnonzero(_passes(shared.value, key))
            own = [_of_host(host) for host in hosts]
            first, second = (
                _prefixes(tokens, run, base)[starts[hits]] ^ np.array([pair[nth] for pair in own], dtype=np.uint64)[page[hits]]
                for nth, base in enumerate(BASES)
            )
            yield {
                "first": first.view(np.int64),
                "second": second.view(np.int64),
                "host": pa.array(hosts).take(pa.array(page[hits])),
                "text": texts[page[hits]],
            }

    return batches.map_arrow(_packed(pages), step, "first long, second long, host string, text long")


def _of_host(host: str) -> tuple[int, int]:
    """What makes two hashes a host's own."""
    return xxhash.xxh64_intdigest(host, 1), xxhash.xxh64_intdigest(host, 2)


def _without_repeats(host: str, blocks: list[str], repeated: np.ndarray, run: int) -> list[str]:
    """The blocks without the tokens that repeated runs cover; blocks left empty go."""
    sizes = [len(block.split()) for block in blocks]
    tokens, _ = _tokens([blocks])
    prefixes = _prefixes(tokens, run, BASES[0]) ^ np.uint64(_of_host(host)[0])
    hits = np.flatnonzero(np.isin(prefixes.view(np.int64), repeated))
    change = np.zeros(sum(sizes) + 1, dtype=np.int64)
    np.add.at(change, hits, 1)
    np.add.at(change, hits + run, -1)
    covered = np.cumsum(change) > 0
    left, at = [], 0
    for block, size in zip(blocks, sizes):
        kept = [word for word, gone in zip(block.split(), covered[at : at + size]) if not gone]
        at += size
        if kept:
            left.append(" ".join(kept))
    return left


def _words_in(blocks: list[str]) -> int:
    return sum(len(block.split()) for block in blocks)


def main_text(pages: DataFrame, run: int = RUN, least_pages: int = PAGES) -> DataFrame:
    """(rest, text) for every row of `pages` (url, html, anything else); `rest` holds all columns but html.

    Blocks are joined by one line feed; white space within a block is one space; character references are
    decoded; a line break within a block is white space. Every page of a host takes part in the search
    with all its blocks but the skipped ones; pages with equal text count as one. Where neither
    `article` nor `main` names the text (`page_parts`), tokens covered by a substring of `run` or more
    tokens found on `least_pages` pages go. Where one does, only those of substrings on SHARE of the host's
    pages as well, and the text stays whole if no more than half of it would be left, as in copies of an article.
    Pages without a host share one. Null and empty pages have an empty text; repeated rows are
    each returned. An empty table gives an empty one.

    Pages are parsed once per pass rather than written: one pass counts short runs, of which every run of
    `run` tokens contains the least, and a filter of fixed size keeps those that can matter; the second sends the runs that
    pass it, which are then counted exactly; the third cuts.
    """
    spark = pages.sparkSession
    narrow = pages.select("url", "html")
    counts_path, rows_path = work_dir(spark, "html-counts"), work_dir(spark, "html-rows")
    counted = _counted(narrow, run).groupBy("key", "host", "text").agg(F.sum("n").alias("n"), F.max("open").alias("open"))
    counts = settle(counted.filter(F.col("host").isNotNull() | (F.col("n") >= least_pages)), counts_path)
    texts = counts.filter(F.col("host").isNotNull())
    hosts = settle(texts.groupBy("key", "host").agg(F.count("*").alias("pages"), F.max("open").alias("open")))

    # A run is of use if some page of its host would lose it.
    bucket = F.shiftrightunsigned("key", 64 - HOST_BITS)
    least = F.when(F.col("open"), F.lit(float(least_pages))).otherwise(F.col("pages") * SHARE)
    bounds = hosts.groupBy(bucket.alias("bucket")).agg(F.min(least).alias("least"))
    keys = counts.filter(F.col("host").isNull()).select("key", "n", bucket.alias("bucket"))
    useful = keys.join(bounds, "bucket").filter("n >= least")
    mask = F.lit(decontaminate.FILTER_BITS - 1)
    first = F.col("key").bitwiseXOR(F.col("bucket")).bitwiseAND(mask)
    second = F.shiftrightunsigned("key", 16).bitwiseXOR(F.col("bucket")).bitwiseAND(mask)
    flags = decontaminate.shingle_filter(useful.select(first.alias("slot"), second.alias("second")))
    remove(spark, counts_path)

    rows = settle(_repeats(narrow, run, flags).distinct(), rows_path)
    often = rows.groupBy("first", "second").agg(F.count("*").alias("seen")).filter(F.col("seen") >= least_pages)
    # A page's repeated runs, never more than the page's tokens.
    repeats = F.collect_list(F.struct("first", "seen")).alias("repeated")
    marked = rows.join(often, ["first", "second"]).groupBy("host", "text").agg(repeats)
    marked = settle(marked.join(hosts.select("host", "pages"), "host"))
    remove(spark, rows_path)

    def parse(source):
        for batch, _, parts, texts in _parsed(source):
            yield {
                "rest": batch.column("rest"),
                "host": batch.column("host"),
                "text": texts,
                "blocks": [blocks for blocks, _, _ in parts],
                "settled": [known for _, _, known in parts],
            }

    def cut(source):
        for batch in batches.pieces(source, PAGES_IN_HAND):
            names = ("host", "blocks", "settled", "pages")
            texts = []
            for row, (host, own, known, of_host) in enumerate(zip(*(batch.column(name).to_pylist() for name in names))):
                repeated = batch.column("repeated")[row].values
                if repeated is not None and own:
                    seen = repeated.field("seen").to_numpy()
                    enough = seen >= SHARE * of_host if known else seen >= least_pages
                    gone = repeated.field("first").to_numpy()[enough]
                    left = _without_repeats(host, own, gone, run) if len(gone) else own
                    # What repeats most of an article is a copy of it.
                    own = own if known and 2 * _words_in(left) <= _words_in(own) else left
                texts.append("\n".join(own))
            yield {"rest": batch.column("rest"), "text": texts}

    parsed = batches.with_fields(_packed(pages), ["rest", "host"], parse, "text long, blocks array<string>, settled boolean")
    opened = parsed.join(marked, ["host", "text"], "left").select("rest", "host", "blocks", "settled", "pages", "repeated")
    return batches.with_fields(opened, ["rest"], cut, "text string")
