"""Main text of web pages.

A page is read into blocks.  Markup protects the article (or the main part): its blocks are kept whole.  All other text of a
page, menus, adverts and footers included, goes into its host's token stream: the streams of a host's pages are concatenated and
their suffixes sorted; a stretch of ``LENGTH`` tokens or more that pages with ``PAGES`` different streams share is boilerplate.
Where a page marks no article, its blocks that no mark drops lose the tokens of boilerplate, and the unique runs stay; text
that markup drops stays out, but counts as evidence of what a host repeats.  Blocks of a marked article are never cut, since
articles are copied between pages and nothing else may be dropped.  Inside an article only what the text isn't to hold goes,
by class words: "post-comments" goes, "share-price" is no share button and "comment-free" no comment.

A host of up to ``SHARE`` different streams and ``BYTES`` characters is read in one task.  A larger one spreads: each of its
streams gives its stretches once, as 64-bit hashes of host and tokens, those that ``PAGES`` streams give are counted out over
the whole host and go back to their streams, so the outcome doesn't depend on the size of a host.
Defined cases: null or empty html has an empty text; a null url is a host of its own; markup may be cut off or unclosed anywhere;
repeated pages give repeated rows, and count as one in the suffix array; pages of any length work, in memory of a few
times one page; other columns, whatever their names, don't matter; no pages give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

LENGTH, PAGES, SHARE, BYTES = 8, 3, 256, 4_000_000

#: Elements of HTML by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form dialog menu search label".split()) | RAW
#: Class, id and role words of menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead topbar comment comments disqus respond replies share sharing complementary contentinfo dialog alert".split())
#: Words that only say what a marked part is made of; "share-buttons" is marked, "share-price" isn't.
PARTS = frozenset("site page main top bottom left right inner outer box bar block area section slot unit list item items link links button buttons icon icons wrapper container holder content text form widget panel toolbar thread".split())
#: Words that mark at either end of a class, whatever stands beside them ("google-ads", "post-footer"), and what undoes that ("ad-free", "no-sidebar").
ENDS = frozenset("comments ads ad adverts advert advertisement sidebar footer newsletter signup disqus".split())
UNDONE = frozenset("free no not non without has with hoc lib less price period policy".split())
#: Single words that mark only together with others: they name ordinary things too.
WEAK = frozenset("header banner share sharing promotion".split())
MAIN = frozenset("articlebody article-body main".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _kind(name: str, attributes: str) -> str:
    """keep (an article begins), drop, or an empty string."""
    if name in DROPPED:
        return "drop"
    marked, main = False, False
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            marked = marked or any(map(_marks, value.split()))
        value = value.lower()
        main = main or (key in ("role", "itemprop") and value in MAIN)
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "drop"
    if name in ("article", "main") or main:
        return "keep"
    return "drop" if name not in ("html", "body") and marked else ""


def _marks(token: str) -> bool:
    """True for a class word that is a mark as a whole, made of marks and words for parts only, or has an unambiguous mark at an end.

    Its words are parted by signs and by capitals ("adBanner").
    """
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", token)]
    if len(words) == 1:
        return words[0] in MARKS and words[0] not in WEAK
    if words and all(w in MARKS or w in PARTS or w.isdigit() for w in words) and any(w in MARKS for w in words):
        return True
    return bool(words) and (words[0] in ENDS or words[-1] in ENDS) and not any(w in UNDONE for w in words)


def _open_p(stack: list[tuple[str, str]]) -> int | None:
    """Place of the open ``p`` that a block closes: the innermost block, with only inline elements in it."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            return k
        if stack[k][0] in BLOCKS or stack[k][0] == "button":
            return None
    return None


def parsed(page: str | None) -> tuple[list[str], bool, list[str]]:
    """Text blocks in page order, whether they are an article's (else undecided), and the blocks of all other text."""
    article: list[str] = []
    other: list[str] = []
    away: list[str] = []
    parts: list[str] = []
    gone: list[str] = []
    stack: list[tuple[str, str]] = []
    dropped = kept = 0
    seen = False

    def flush(from_: list[str], to: list[str]) -> None:
        text = " ".join(html.unescape("".join(from_)).split())
        from_.clear()
        if text:
            to.append(text)

    at, size, page = 0, len(page or ""), page or ""
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            (gone if dropped else parts).append(page[at:end])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name in BLOCKS:
            flush(gone, away)
            if not dropped:
                flush(parts, article if kept else other)
        elif name == "br":
            (gone if dropped else parts).append(" ")
        if closing:
            names = [x for x, _ in stack]
            if name in names:
                while stack:
                    last, kind = stack.pop()
                    dropped -= kind == "drop"
                    kept -= kind == "keep"
                    if last == name:
                        break
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in BLOCKS and (open_p := _open_p(stack)) is not None:
            for _, kind in stack[open_p:]:
                dropped -= kind == "drop"
                kept -= kind == "keep"
            del stack[open_p:]
        kind = _kind(name, m[3])
        if name == "header" and not kept:
            kind = "drop"
        dropped += kind == "drop"
        kept += kind == "keep"
        seen = seen or (kind == "keep" and not dropped)
        stack.append((name, kind))
    flush(gone, away)
    if not dropped:
        flush(parts, article if kept else other)
    return (article, True, other + away) if seen and article else (other, False, away)


def blocks(page: str | None) -> tuple[list[str], bool]:
    """Text blocks in page order; and whether they are an article's (else undecided)."""
    return parsed(page)[:2]


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``tokens`` in the order of their first ``depth`` tokens (rounded up to a power of 2), and the rank of each suffix by these."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[:-step or None] = rank[step:] if step < len(rank) else 0
        if step >= depth:
            break
        order = np.lexsort((behind, rank))
        change = np.ones(len(rank), np.int64)
        change[1:] = (rank[order][1:] != rank[order][:-1]) | (behind[order][1:] != behind[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(change)
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def boilerplate_starts(pages: list[list[str]], length: int = LENGTH, least: int = PAGES) -> list[np.ndarray]:
    """For each page (a list of tokens): where a stretch of ``length`` begins that pages with ``least`` different texts share."""
    texts: dict[tuple[str, ...], int] = {}
    which = [texts.setdefault(tuple(p), len(texts)) for p in pages]
    numbers: dict[str, int] = {}
    flat, owner = [], []
    for text, k in texts.items():
        flat += [numbers.setdefault(t, len(numbers)) for t in text] + [-1 - k]  # a mark of its own ends each text
        owner += [k] * (len(text) + 1)
    tokens, owner = np.array(flat, np.int64), np.array(owner, np.int64)
    order, rank = suffix_array(tokens, length)
    group = np.cumsum(np.concatenate(([1], rank[order][1:] != rank[order][:-1]))) - 1 if len(order) else order
    pairs = np.unique(np.column_stack((group, owner[order])), axis=0)
    shared = np.bincount(pairs[:, 0]) >= least if len(pairs) else np.zeros(0, bool)
    begins = np.zeros(len(tokens), bool)
    begins[order[shared[group]] if len(order) else order] = True
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return [begins[bounds[k] : bounds[k + 1] - 1] for k in which]


def boilerplate(pages: list[list[str]], length: int = LENGTH, least: int = PAGES) -> list[np.ndarray]:
    """For each page: which tokens lie in a stretch of ``length`` that pages with ``least`` different texts share."""
    out = []
    for begins in boilerplate_starts(pages, length, least):
        edges = np.zeros(len(begins) + length + 1, np.int64)
        at = np.flatnonzero(begins)
        edges[at] += 1
        edges[at + length] -= 1
        out.append(np.cumsum(edges)[: len(begins)] > 0)
    return out


def cut(page: list[str], gone: np.ndarray, length: int = LENGTH) -> str:
    """A page of blocks without the tokens ``gone``: whole blocks that are covered, and covered runs of ``length`` tokens in others."""
    at, kept = 0, []
    for block in page:
        words = block.split()
        flags = gone[at : at + len(words)]
        at += len(words)
        if flags.all():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
        keep = np.ones(len(words), bool)
        for first, end in zip(edges[::2], edges[1::2], strict=True):
            keep[first:end] = end - first < length
        kept.append(" ".join(w for w, k in zip(words, keep, strict=True) if k))
    return "\n".join(kept)


def unique_runs(pages: list[list[str]], length: int = LENGTH, least: int = PAGES) -> list[str]:
    """Texts of pages given as blocks, without boilerplate."""
    return [cut(page, gone, length) for page, gone in zip(pages, boilerplate([[w for b in page for w in b.split()] for page in pages], length, least), strict=True)]


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stretch, named, first, at) of (host, text, named): each stretch of ``LENGTH`` tokens, whether the text has it for the first time, where it starts."""
    for batch in batches:
        for host, text, named in zip(*(batch.column(x).to_pylist() for x in ("host", "text", "named")), strict=True):
            words = text.split()
            n = max(0, len(words) - LENGTH + 1)
            hashes = np.array([xxhash.xxh3_64_intdigest("\n".join((host, *words[k : k + LENGTH]))) for k in range(n)], np.uint64).view(np.int64)
            first = np.zeros(n, bool)
            first[np.unique(hashes, return_index=True)[1]] = True
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([named] * n, pa.binary()), pa.array(first), pa.array(np.arange(n), pa.int32())], names=["stretch", "named", "first", "at"])


def host_of(url: str | None) -> str:
    return re.split(r"[/?#]", (url or "").partition("://")[2], maxsplit=1)[0].lower()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, article, own, stream, host) of (id, url, html): ``article`` null where undecided, then the stream begins with ``own`` undecided blocks."""
    for batch in batches:
        got = [parsed(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1),
                pa.array(["\n".join(b) if sure else None for b, sure, _ in got], pa.string()),
                pa.array([0 if sure else len(b) for b, sure, _ in got], pa.int32()),
                pa.array(["\n".join(away if sure else b + away) for b, sure, away in got], pa.string()),
                pa.array(list(map(host_of, batch.column(1).to_pylist())), pa.string()),
            ],
            names=["id", "url", "article", "own", "stream", "host"],
        )


def shared_stretches(streams: DataFrame) -> DataFrame:
    """(named, starts) of ``streams`` (named, host, text, none twice): where stretches of boilerplate begin, in tokens; only streams that have some."""

    def by_suffixes(rows: pa.Table) -> pa.Table:
        pages = [t.split() for t in rows.column("text").to_pylist()]
        starts = [np.flatnonzero(x).tolist() for x in boilerplate_starts(pages, LENGTH, PAGES)]
        return pa.table({"named": rows.column("named").combine_chunks(), "starts": pa.array(starts, pa.list_(pa.int32()))})

    size = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)), F.ceil(F.sum(F.length("text")) / F.lit(BYTES)))
    shares = stored(streams.groupBy("host").agg(size.alias("shares")), "shares")
    dealt = streams.join(shares, "host")
    small = dealt.where("shares = 1").select("host", "named", "text").groupBy("host").applyInArrow(by_suffixes, "named binary, starts array<int>")
    large = dealt.where("shares > 1").select("host", "text", "named")
    found = large.mapInArrow(stretches, "stretch long, named binary, first boolean, at int")
    shared = found.where("first").groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES).select("stretch")
    counted = found.select("stretch", "named", "at").join(stored(shared, "shared"), "stretch").groupBy("named").agg(F.collect_list("at").alias("starts"))
    return stored(small.where("size(starts) > 0").unionByName(counted), "marks")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_around, n_repeated) of each row of ``pages``.

    ``n_around``: tokens outside a marked article, ``n_repeated``: those of them that the host's suffix array finds repeated.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, around, repeated = [], [], []
            for article, own, stream, starts in zip(*(batch.column(x).to_pylist() for x in ("article", "own", "stream", "starts")), strict=True):
                gone = np.zeros(len(stream.split()), bool)
                for k in starts or ():
                    gone[k : k + LENGTH] = True
                texts.append(article if article is not None else cut(stream.split("\n")[:own], gone))
                around.append(len(gone))
                repeated.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(around, pa.int64()), pa.array(repeated, pa.int64())], names=["id", "url", "text", "n_around", "n_repeated"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_read, f"id {kind}, url string, article string, own int, stream string, host string")
    named = rows.withColumn("named", F.unhex(F.md5(F.concat_ws("\n", "host", F.replace("stream", F.lit("\n"), F.lit(" "))))))
    once = stored(named.where("stream <> ''").groupBy("named").agg(F.first("host").alias("host"), F.first("stream").alias("text")), "streams")
    out = named.select("id", "url", "article", "own", "stream", "named").join(shared_stretches(once), "named", "left").select("id", "url", "article", "own", "stream", "starts")
    out = out.mapInArrow(finish, f"id {kind}, url string, text string, n_around long, n_repeated long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_around", "n_repeated")
