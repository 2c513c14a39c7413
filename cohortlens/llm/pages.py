"""Main text of web pages: page structure first, then a suffix array over the pages of a host.

**Structure.** A page is read once into blocks of visible text. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
reader comments and the like are told by their elements, classes, ids and roles. If a page marks its article or its main element, the
main text is in there.

**Host suffix array.** The token streams of a host's pages, with all their visible blocks, are concatenated; suffixes are sorted by their
first `run` tokens (prefix doubling, so three sorts for eight tokens), and neighbours that agree on them from at least `pages` different
pages mark boilerplate. Of the candidate blocks the covered tokens go, the unique runs between them stay. What a page marks as its article
is not touched: articles quote and copy each other, and all of an article is main text.

**Hot hosts.** A host of more than `host_pages` pages is dealt to groups of about that many, so no task holds a whole host. A run that few
pages of such a host share need not come often enough in any group: for the pages that are cleaned at all, those without a marked article,
the hashes of their `run`-token windows are counted over all different pages of the host first, and what `pages` of them have goes, too. So
the result does not depend on how a host is dealt.
"""

from __future__ import annotations

import html as html_module
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import joined_on
from ..session import pinned
from .common import sized_broadcast

RUN, PAGES, HOST_PAGES = 8, 3, 512

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z][\w:.-]*)")
WORDS = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements whose content no reader sees as text.
UNSEEN = frozenset("head script style noscript template svg math canvas object iframe audio video datalist textarea title xmp noembed noframes".split())
#: Elements whose content is never main text.
OUTSIDE = frozenset(
    "head script style noscript template svg math canvas object iframe audio video nav menu header footer aside form fieldset button "
    "select datalist input textarea dialog title xmp noembed noframes".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "head"}
#: Words in class, id or role that tell a block outside the main text.
MARKS = frozenset(
    "ad ads adbox adsbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar sidebar sidenav complementary footer "
    "header masthead contentinfo notice notices cookie cookies consent gdpr popup modal overlay alert alertdialog dialog "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search searchbox skiplink widget widgets form".split()
)
COMMENT_MARKS = frozenset("comment comments reply ad advert sponsored promo related teaser".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NEVER_BY_CLASS = frozenset(("html", "body", "main"))


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c, bare in ATTRIBUTE.findall(text):
        found.setdefault((name or bare).lower(), a or b or c)
    return found


def _outside(name: str, attrs: dict[str, str], in_article: bool, by_class: bool) -> bool:
    if name in OUTSIDE and not (name == "header" and in_article):
        return True
    if not attrs:
        return False
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if not by_class or name in NEVER_BY_CLASS:
        return False
    named = set(WORDS.findall(" ".join(attrs.get(a, "") for a in ("class", "id", "role")).lower()))
    if name == "article":
        return bool(named & COMMENT_MARKS)
    if name in HEADINGS or in_article and name == "header":
        named -= {"header", "masthead"}  # the head of the article, not of the site
    return bool(named & MARKS)


def blocks(page: str | None, by_class: bool = True) -> list[tuple[int, str]]:
    """The visible blocks of a page in order: (2 in an article, 1 in a main element, 0 elsewhere, -1 outside the main text; text)."""
    page = page or ""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # element, not shown to a reader, level

    def end() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            found.append((stack[-1][2], text))

    def close(name: str) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] == name:
                if any(s[0] in BLOCKS for s in stack[at:]) or stack[at][2] != stack[at - 1][2]:
                    end()
                del stack[at:]
                return

    at = 0
    while True:
        match = MARKUP.search(page, at)
        upto = match.start() if match else len(page)
        if upto > at and not stack[-1][1]:
            held.append(html_module.unescape(page[at:upto]))
        if not match:
            break
        at = match.end()
        if match["data"] is not None and not stack[-1][1]:
            held.append(match["data"])
        name = (match["name"] or match["name2"] or "").lower()
        if not name:
            continue
        attrs = match["attrs"] if match["name"] else match["attrs2"]
        if match["close"] or match["close2"]:
            if name == "p" and not any(s[0] == "p" for s in stack):
                end()
            close(name)
            continue
        if name in ENDS_P and any(s[0] == "p" for s in stack[-12:]):
            close("p")
        if name == "li" and stack[-1][0] == "li" or name == "option" and stack[-1][0] == "option":
            close(name)
        if name in BLOCKS:
            end()
        if name in VOID:
            continue
        _, unseen, level = stack[-1]
        unseen = unseen or name in UNSEEN
        if level >= 0:
            known = _attributes(attrs) if attrs.strip(" /\n\t") else {}
            if _outside(name, known, level == 2, by_class):
                if name not in BLOCKS:  # the text around an inline element is in another block than its own
                    end()
                level = -1
            elif name == "article" or known.get("itemprop", "").lower() == "articlebody":
                level = 2
            elif name == "main" or known.get("role", "").lower() == "main":
                level = max(level, 1)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if not attrs.rstrip().endswith("/") or name in BLOCKS or name in OUTSIDE:
            stack.append((name, unseen, level))
    end()
    return found


def page_blocks(page: str | None) -> tuple[int, list[tuple[int, str]]]:
    """The level of the page's main text, and all its visible blocks with theirs."""
    found: list[tuple[int, str]] = []
    for by_class in (True, False):  # a layout whose outermost class looks like a sidebar must not cost the page
        found = blocks(page, by_class)
        level = max((kind for kind, _ in found), default=-1)
        if level >= 0:
            return level, found
    return -1, found


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """Per stream, which tokens lie in a run of `run` tokens that at least `pages` different streams have. Equal streams count once."""
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum())
    if total < run:
        return [np.zeros(n, bool) for n in sizes]
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(tuple(s), len(kinds)) for s in streams], np.int64)
    # One number for each token, and one of its own for the end of each stream, so no run goes past an end.
    words: dict[str, int] = {}
    numbers, owner = np.empty(total + len(streams), np.int64), np.empty(total + len(streams), np.int64)
    at, starts = 0, []
    for i, stream in enumerate(streams):
        starts.append(at)
        numbers[at:at + len(stream)] = [words.setdefault(t, len(words)) for t in stream]
        numbers[at + len(stream)] = -1 - i
        owner[at:at + len(stream) + 1] = i
        at += len(stream) + 1
    rank = np.unique(numbers, return_inverse=True)[1]
    length = 1
    while length < run:  # prefix doubling: ranks of the first `length` tokens of each suffix
        step = min(length, run - length)
        later = np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
        rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)[1]
        length += step
    suffixes = np.argsort(rank, kind="stable")
    ordered, kinds_there = rank[suffixes], kind[owner[suffixes]]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1])])
    group = np.cumsum(new) - 1
    pairs = np.unique(group * (len(kinds) + 1) + kinds_there)
    different = np.bincount(pairs // (len(kinds) + 1), minlength=group[-1] + 1)
    hit = suffixes[different[group] >= pages]
    change = np.zeros(len(numbers) + run + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + run, -1)
    covered = np.cumsum(change)[:len(numbers)] > 0
    return [covered[s:s + n] for s, n in zip(starts, sizes)]


def main_texts(pages_html: list[str | None], run: int = RUN, pages: int = PAGES, known: list | None = None) -> list[str]:
    """The main text of each page of one host, or of a group of its pages: `known` has the begins of runs that are known to be repeated, or None."""
    read = [page_blocks(p) for p in pages_html]
    tokens = [[text.split(" ") for _, text in found] for _, found in read]
    covered = repeated([[t for block in page for t in block] for page in tokens], run, pages)
    for mask, begins in zip(covered, known or []):
        if begins is not None:
            for begin in begins:
                mask[begin:begin + run] = True
    texts = []
    for (level, found), page, mask in zip(read, tokens, covered):
        at, kept = 0, []
        for (kind, _), block in zip(found, page):
            if kind == level == 2:
                kept += block
            elif kind == level >= 0:
                kept += [t for t, gone in zip(block, mask[at:at + len(block)]) if not gone]
            at += len(block)
        texts.append(" ".join(kept))
    return texts


def host_of(url: str) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def windows(tokens: list[str], run: int = RUN) -> np.ndarray:
    """A 64-bit hash of each run of `run` tokens."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hashed = np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    total = np.zeros(n, np.uint64)
    for at in range(run):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[at:at + n]
    return total.view(np.int64)


def _page_tokens(page: str | None) -> tuple[int, list[str]]:
    level, found = page_blocks(page)
    return level, [t for _, text in found for t in text.split(" ")]


def host_wide(rows: DataFrame, run: int = RUN, min_pages: int = PAGES) -> DataFrame | None:
    """Begins of the runs that at least `min_pages` different pages of a host have, for the pages without a marked article; None without such pages.

    `rows` has (host, html); the result (host, m1, m2, begins), where m1 and m2 are hashes of the page. A page sends the hashes of windows, and
    only those that such a page has are counted.
    """
    marked = rows.select("host", "html", F.xxhash64("html").alias("m1"), F.xxhash64(F.lit(1), "html").alias("m2"))

    def to_clean(batches):
        for batch in batches:
            found = [_page_tokens(h) for h in batch["html"]]
            batch = batch.drop(columns="html").assign(windows=[windows(t, run) if 0 <= level < 2 else None for level, t in found])
            yield batch[batch["windows"].notna()]

    needed = pinned(marked.mapInPandas(to_clean, "host string, m1 long, m2 long, windows array<long>"))
    needed = needed.dropDuplicates(["host", "m1", "m2"])
    hosts = needed.select("host").distinct()
    if hosts.isEmpty():
        return None

    def streams(batches):
        for batch in batches:
            found = [_page_tokens(h)[1] for h in batch["html"]]
            yield pd.DataFrame({
                "host": batch["host"], "stream": [xxhash.xxh64(" ".join(t)).intdigest() - (1 << 63) for t in found],
                "windows": [np.unique(windows(t, run)) for t in found],
            })

    wanted = needed.select("host", F.explode("windows").alias("w")).distinct()
    every = marked.join(sized_broadcast(pinned(hosts)), "host").select("host", "html").mapInPandas(streams, "host string, stream long, windows array<long>")
    shared = every.select("host", "stream", F.explode("windows").alias("w")).join(wanted, ["host", "w"]).distinct()
    often = shared.groupBy("host", "w").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).drop("n")
    places = needed.select("host", "m1", "m2", F.posexplode("windows").alias("at", "w")).join(often, ["host", "w"])
    return pinned(places.groupBy("host", "m1", "m2").agg(F.collect_list("at").alias("begins")))


#: Pages of a task, about: the number of tasks follows the number of pages.
TASK_PAGES = 4096


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = RUN, min_pages: int = PAGES,
              host_pages: int = HOST_PAGES) -> DataFrame:
    """`key`, `url`, `text`, `n_chars` for each row.

    Null and empty pages have an empty text; pages without a host are those of one host; null keys and repeated rows stay; an empty table
    gives an empty result. Other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(url).alias("host"))
    sizes = pinned(rows.groupBy("host").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = pinned(sizes.filter(F.col("n") > host_pages).select("host", F.ceil(F.col("n") / host_pages).alias("parts")))
    known = None
    if not hot.isEmpty():
        known = host_wide(rows.join(sized_broadcast(hot.select("host")), "host").select("host", "html"), run, min_pages)
    # Repeated rows are dealt by their place in the table, too.
    mixed = F.xxhash64("url", "id", F.monotonically_increasing_id())
    dealt = rows.join(sized_broadcast(hot), "host", "left").withColumn("part", F.pmod(mixed, F.coalesce("parts", F.lit(1))))
    if known is not None:
        named = dealt.withColumns({"m1": F.xxhash64("html"), "m2": F.xxhash64(F.lit(1), "html")})
        dealt = joined_on(named, sized_broadcast(known), ["host", "m1", "m2"], "left")
    else:
        dealt = dealt.withColumn("begins", F.lit(None).cast("array<int>"))
    # Small hosts share groups, so that there are not as many groups as hosts.
    groups = max(1, -(-total // host_pages)) * 4
    grouped = dealt.withColumn("at", F.pmod(F.xxhash64("host", "part"), F.lit(groups))).select("id", "url", "html", "host", "part", "at", "begins")
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PAGES))

    def extract(group: pd.DataFrame) -> pd.DataFrame:
        texts = pd.Series("", index=group.index, dtype=object)
        for _, one in group.groupby(["host", "part"], sort=True):
            texts[one.index] = main_texts(one["html"].tolist(), run, min_pages, one["begins"].tolist())
        return pd.DataFrame({"id": group["id"], "url": group["url"], "text": texts, "n_chars": texts.str.len().astype("int64")})

    kind = rows.schema["id"].dataType.simpleString()
    done = grouped.repartition(tasks, "at").groupBy("at").applyInPandas(extract, f"id {kind}, url string, text string, n_chars long")
    return done.withColumnRenamed("id", key)
