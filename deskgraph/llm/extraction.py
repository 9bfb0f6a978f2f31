"""Main text of web pages: marked-up page furniture goes, and so do long runs that a host repeats across its pages.

1. A page is cut into blocks.  A block in an article or main element is text; one in an element that names itself
   furniture (menus, footers, adverts, forms, comments, ...) is not; any other is open, also on a page with an article.
2. The words of all blocks outside the article are the page's stream.  The streams of a host's pages are concatenated, in
   several parts for a host with many, and each part gets a suffix array.  Suffixes that share their first ``run`` words are
   neighbours in it; each such group is one row with its number of distinct pages.  Groups of the host's parts are
   merged by a digest of these words, so a run that several parts hold is counted over all of them.
3. Equal pages count once, and so do near copies among the pages with open blocks; copies stand in one part.
4. A run of ``run`` or more words on ``LEAST`` distinct pages or more, and as many as the share ``SHARE`` of the host's distinct pages with
   open blocks, is boilerplate.  Open blocks lose the words it covers and keep the rest.

Text in an explicit article stays whatever it repeats: the same paragraph may well stand in the articles of many pages, and
the suffix array alone would cut it out of all of them.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph.llm.common import stored
from deskgraph.llm.neardup import near_duplicates

RUN = 8
PART_WORDS = 400_000
LEAST = 3
SHARE = 0.5

# HTML elements by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title"  # without an end tag they run to the end of the page
EMBEDDED = "noscript|template|iframe|svg|math|canvas|object|audio|video|select"  # dropped up to their end tag, if there is one
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
LEAVES = set("p li dt dd tr td th option b i em strong small u s tt font br".split())
FURNITURE = set("nav aside footer form button menu dialog head".split())
ARTICLE = {"article", "main"}
RESET = {"nav", "header", "footer", "form", "head", "button", "menu"}
# Words of class, id and role attributes that name page furniture.
NAMES = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus "
    "footer login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion "
    "recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget complementary contentinfo alert alertdialog dialog".split()
)
PAGE_NAMES = {"header"}

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    rf"|<(?P<odd>{EMBEDDED})(?=[\s/>])(?P<rest>[^>]*)>|<[!?/a-zA-Z][^>]*>",
    re.S | re.I,
)
EMBEDDED_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in EMBEDDED.split("|")}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
FURNISHED, TEXT, OPEN = 0, 1, 2


def _furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    if "=" not in attributes or name in ("html", "body") or name in ARTICLE:
        return False
    for found in ATTRIBUTE.finditer(attributes):
        words = set(re.split(r"[^a-z0-9]+", (found[1] or found[2] or found[3] or "").lower()))
        if words & NAMES or (not in_article and words & PAGE_NAMES):
            return True
    return False


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order; texts are decoded and their white space is single spaces."""
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []
    furniture, article, parts, at = False, False, [], 0
    endless: set[str] = set()  # names without an end tag in the rest of the page

    def close() -> None:
        text = " ".join(html_module.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append((FURNISHED if furniture else TEXT if article else OPEN, text))

    while tag := TAG.search(page, at):
        if tag.start() > at:
            parts.append(page[at : tag.start()])
        at = tag.end()
        name, attributes = (tag["name"] or tag["odd"] or "").lower(), tag["attributes"] or tag["rest"] or ""
        if not name:
            continue
        if name in EMBEDDED_END and not tag["end"] and name not in endless:
            if attributes.endswith("/"):
                continue
            if found := EMBEDDED_END[name].search(page, tag.start()):
                at = found.end()
                continue
            endless.add(name)
        marks = not tag["end"] and "=" in attributes and _furniture(name, attributes, article)
        if name in INLINE and not marks and not (tag["end"] and stack and stack[-1][0] == name):
            continue
        close()
        if tag["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    _, furniture, article = stack[depth]
                    del stack[depth:]
                    break
        elif name not in VOID and not attributes.endswith("/") and (name not in LEAVES or marks):
            if name in ARTICLE or name == "body":
                # an article does not stand in a menu: the menu's end tag is missing
                for depth, (opened, before, _) in enumerate(stack):
                    if opened in RESET and not before:
                        furniture = False
                        del stack[depth:]
                        break
            stack.append((name, furniture, article))
            furniture = furniture or marks or _furniture(name, "", article)
            article = article or name in ARTICLE
    parts.append(page[at:])
    close()
    return blocks


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` tokens or more, and a number that equal beginnings share.

    Prefix doubling: after each round the rank orders suffixes by twice as many tokens.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, width = len(tokens), 1
    while width < depth:
        step = min(width, depth - width)
        behind = np.full(n, -1, np.int64)
        behind[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 2) + behind + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    return np.argsort(rank, kind="stable"), rank


def _digests(words: list[str], starts: np.ndarray, run: int) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(" ".join(words[s : s + run]).encode()) - (1 << 63) for s in starts]


def part_runs(rows: np.ndarray, streams: list[str], opened: np.ndarray, votes: np.ndarray, run: int) -> list[tuple]:
    """(digest, distinct votes, None, None) of every run in a part, and (digest, None, page, place) for pages with open blocks."""
    words: list[str] = []
    page, place, vote = [], [], []
    for row, key, stream in zip(rows, np.unique(votes, return_inverse=True)[1], streams, strict=True):
        own = stream.split(" ") if stream else []
        page += [row] * len(own)
        place += range(len(own))
        vote += [key] * len(own)
        words += own
    if not words:
        return []
    pages, places = np.array(page, np.int64), np.array(place, np.int64)
    order, rank = suffix_array(np.unique(np.array(words, dtype=object), return_inverse=True)[1], run)
    whole = np.zeros(len(words), bool)
    whole[: len(words) - run + 1] = pages[run - 1 :] == pages[: len(words) - run + 1] if len(words) >= run else False
    order = order[whole[order]]
    if not len(order):
        return []
    first = np.append(True, rank[order][1:] != rank[order][:-1])
    begin = np.flatnonzero(first)
    digest = _digests(words, order[begin], run)
    group, ballot = np.cumsum(first) - 1, np.array(vote, np.int64)[order]
    cast = np.lexsort((ballot, group))
    new = np.append(True, (group[cast][1:] != group[cast][:-1]) | (ballot[cast][1:] != ballot[cast][:-1]))
    out = [(d, int(n), None, None) for d, n in zip(digest, np.bincount(group[cast][new]), strict=True)]
    with_open = np.isin(pages[order], rows[opened])
    out += [(digest[group[k]], None, int(pages[order[k]]), int(places[order[k]])) for k in np.flatnonzero(with_open)]
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """One stored row per page: page_id, url, host, its article text, all blocks if some are open, and its stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                texts, blocks, streams = [], [], []
                for page in part.column(3).to_pylist():
                    found = page_blocks(page or "")
                    texts.append(" ".join(t for k, t in found if k == TEXT))
                    undecided = any(k == OPEN for k, _ in found)
                    blocks.append([{"kind": k, "text": t} for k, t in found] if undecided else None)
                    streams.append(" ".join(t for k, t in found if k != TEXT))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(texts, pa.string()), pa.array(blocks, kind), pa.array(streams, pa.string())],
                    names=["row", "page_id", "url", "text", "blocks", "stream"],
                )

    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    )
    made = rows.mapInArrow(
        run, "row long, page_id long, url string, text string, blocks array<struct<kind:int,text:string>>, stream string"
    ).withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    return stored(made, "pages")


def voted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``vote``: equal for pages of equal words, and for near copies among the pages with open blocks."""
    votes = pages.withColumn("vote", F.xxhash64("text", "stream"))
    opened = votes.where(F.col("blocks").isNotNull())
    if opened.isEmpty():
        return votes
    docs = opened.select(F.col("row").alias("doc_id"), F.concat_ws(" ", "text", "stream").alias("text"))
    groups = near_duplicates(stored(docs, "open-pages")).where(F.col("component_id") != F.col("doc_id"))
    heads = votes.select(F.col("row").alias("component_id"), F.col("vote").alias("_vote"))
    moved = groups.select("doc_id", "component_id").join(heads, "component_id").select(F.col("doc_id").alias("row"), "_vote")
    return votes.join(moved, "row", "left").withColumn("vote", F.coalesce("_vote", "vote")).drop("_vote")


def repeated_runs(pages: DataFrame, run: int = RUN, part_words: int = PART_WORDS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(row, place) where a run of ``run`` words begins that enough distinct pages of the host hold, for pages with open blocks."""

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        opened = np.array(table["opened"].to_pylist(), bool)
        found = part_runs(table["row"].to_numpy(), table["stream"].to_pylist(), opened, table["vote"].to_numpy(), run)
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.Table.from_arrays(
            [pa.array([table["host"][0].as_py()] * len(found), pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
            names=["host", "digest", "votes", "page", "place"],
        )

    streams = voted(pages).where(F.col("stream") != "").select("row", "host", "stream", "vote", F.col("blocks").isNotNull().alias("opened"))
    sizes = streams.groupBy("host").agg(F.sum(F.size(F.split("stream", " "))).alias("words"))
    parts = sizes.select("host", F.ceil(F.col("words") / F.lit(part_words)).cast("int").alias("parts"))
    dealt = streams.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("vote"), F.col("parts"))).repartition("host", "part")
    runs = stored(dealt.groupBy("host", "part").applyInArrow(find, "host string, digest long, votes long, page long, place long"), "page-runs")
    asked = streams.where("opened").select("host", "vote").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    common = (
        runs.where(F.col("place").isNull())
        .groupBy("host", "digest")
        .agg(F.sum("votes").alias("votes"))
        .where(F.col("votes") >= F.lit(least))
        .join(asked, "host")
        .where(F.col("votes") >= F.col("of") * F.lit(share))
        .select("host", "digest")
    )
    return runs.where(F.col("place").isNotNull()).join(common, ["host", "digest"]).select(F.col("page").alias("row"), "place")


def main_text(pages: DataFrame, run: int = RUN, part_words: int = PART_WORDS) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages have the text "" and 0 characters; a null or odd url belongs to the host "".  Copies of a page are
    rows of their own.  Nothing is cut short, whatever a page's length.
    """
    rows = parsed(pages)
    covered = repeated_runs(rows, run, part_words).groupBy(F.col("row").alias("_row")).agg(F.collect_set("place").alias("places"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                hit = {p + i for p in row["places"] or () for i in range(run)}
                at, kept = 0, []
                for block in row["blocks"]:
                    words = block["text"].split(" ")
                    if block["kind"] == TEXT:  # not in the stream
                        kept += words
                        continue
                    if block["kind"] == OPEN:
                        kept += [w for i, w in enumerate(words, at) if i not in hit]
                    at += len(words)
                out.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    plain = rows.where(F.col("blocks").isNull()).select("page_id", "url", "text")
    open_pages = rows.where(F.col("blocks").isNotNull()).select("row", "page_id", "url", "blocks").join(covered, F.col("row") == F.col("_row"), "left")
    kept = open_pages.select("page_id", "url", "blocks", "places").mapInArrow(keep, "page_id long, url string, text string")
    return plain.unionByName(kept).withColumn("n_chars", F.char_length("text").cast("long"))
