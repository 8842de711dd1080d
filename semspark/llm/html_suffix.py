"""Main text of web pages: a suffix array over the pages of a host, beside the pages' structure.

Markup is cut into blocks of visible words. Blocks inside an article or main element are content. Elements whose tag,
role or class says that they are menus, adverts, notices, forms or comments are chrome. Inside content an element is
doubtful if the name is as well a subject to write about ("reviews", "menu"), if it is a comment that is a mere paragraph,
or if its class or id shares but a part with a name ("related-work"); the suffix array decides on it.

The word streams of a host's pages, without their content, are concatenated, and a suffix array shows the long runs of
words that recur on several pages. Large hosts have a suffix array for each group of pages; these only propose runs,
whose pages are then counted over the whole host. Words covered by runs on enough pages are boilerplate and go. Of what
is left, the unique runs, those in chrome go as well, as an advert or a comment may be on one page only; the others
stay. Content is not cut, as what an author put into the article counts more than that other pages quote it. On a page
with content nothing outside it is main text.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime.shared import written
from .texthash import U, buffers, mix, word_hashes

#: Words of a recurring run, and pages it must be on: at least so many, and this share of the host's pages.
RUN_WORDS, RUN_PAGES, RUN_SHARE = 6, 3, 0.05
#: Pages of a host that share a suffix array, about; larger hosts are dealt out to several.
GROUP_PAGES = 256
#: Hosts whose numbers of pages and groups are broadcast, and frequent runs that each task gets; more are joined by
#: shuffles.
BROADCAST_HOSTS, BROADCAST_RUNS = 100_000, 500_000

_RAW = r"script|style|template|noscript|svg|math|iframe|object|canvas|audio|video|select|textarea|title"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"} | {"li"}
_CHROME = frozenset("nav footer aside form menu button dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments comments-area commentlist cookie cookies consent disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup popover promo promoted promotion related recommended replies respond reviews share sharing sidebar signup skip-link social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Names that an article's own part may well have, as they are subjects too.
_SUBJECTS = frozenset("menu navigation notification notifications overlay replies respond reviews sharing social widget widgets".split())
_REMARKS = frozenset(("comment", "comments"))
#: Parts that say nothing of an element: a name of these and of parts in _NAMES alone tells as much as those.
_PLAIN = frozenset("area articles bar block bottom box button buttons container content footer form header icons inline inner items left link links list main outer page panel posts right section site slot text title top unit wrap wrapper".split())
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARKS = frozenset(("article", "main"))
_NAME = re.compile(r"\s+")
_PART = re.compile(r"[_-]+")


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _named(classes: str, ident: str, inside: bool, tag: str) -> int:
    """1 if a class or id says that the element is not main text, 3 if it is doubtful, 0 if it says nothing.

    A class tells by its last part ("top-ad"); an id, which may be made from a title, only as a whole. Inside content a
    name that is as well a subject to write about, a part of an id, and a comment that is a mere paragraph or words in a
    line are doubtful at most: there the words' recurrence on the host decides.
    """
    doubtful = 0
    for name, last in (*((c, True) for c in _NAME.split(classes)), *((i, False) for i in _NAME.split(ident))):
        parts = [p for p in _PART.split(name) if p]
        if _NAMES.isdisjoint((name, *parts)):
            continue
        if inside and (name not in _NAMES and not last or name in _SUBJECTS or parts[-1] in _SUBJECTS or parts[-1] in _REMARKS and (tag == "p" or tag not in _BLOCK)):
            doubtful = 3
        elif name in _NAMES or not inside or parts[-1] in _NAMES or all(p in _NAMES or p in _PLAIN for p in parts):
            return 1
        else:
            doubtful = 3
    return doubtful


def _role(tag: str, rest: str, inside: bool) -> int:
    """1: chrome, 2: marks content, 3: doubtful, 4: not visible, 0: none of these."""
    if tag == "head":
        return 4
    if rest and not rest.isspace():
        a = _attributes(rest)
        role = a.get("role", "").lower()
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return 4
        if tag in _CHROME or tag == "header" and not inside or role in _ROLES:
            return 1
        if tag not in ("html", "body", "article", "main"):
            ident = "" if tag in _TITLES and inside else a.get("id", "")
            if kind := _named(a.get("class", "").lower(), ident.lower(), inside, tag):
                return kind
        if role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody":
            return 2
    if tag in _CHROME or tag == "header" and not inside:
        return 1
    return 2 if tag in _LANDMARKS else 0


#: Kinds of blocks.
PLAIN, CONTENT, DOUBTFUL, CHROME = range(4)


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block of visible words, in page order; words of chrome inside a block make one of their own
    after it.

    White space within a block is one space; character references are decoded. Unclosed and misnested elements are
    closed by the elements around them, as browsers do.
    """
    out: list[tuple[str, int]] = []
    if not page:
        return out
    stack: list[tuple[str, int]] = []
    hidden = chrome = marked = doubtful = 0
    current: list[str] = []
    other: list[str] = []
    at = 0

    def flush():
        for parts, kind in ((current, (DOUBTFUL if doubtful else CONTENT) if marked else PLAIN), (other, CHROME)):
            if parts:
                words = " ".join(htmllib.unescape("".join(parts)).split())
                if words:
                    out.append((words, kind))
                parts.clear()

    def close(k: int):
        nonlocal hidden, chrome, marked, doubtful
        while len(stack) > k:
            kind = stack.pop()[1]
            hidden -= kind == 4
            chrome -= kind == 1
            marked -= kind == 2
            doubtful -= kind == 3

    def innermost(tags, stops=()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stops:
                return -1
        return -1

    for m in _PIECE.finditer(page):
        if m.start() > at and not hidden:
            (other if chrome else current).append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            current.append(" ")
            other.append(" ")
        if tag in _VOID:
            continue
        if m["end"]:
            k = innermost((tag,))
            if k >= 0 and (tag in _BLOCK or not any(stack[j][0] in _BLOCK for j in range(k + 1, len(stack)))):
                close(k)
            continue
        if tag in _CLOSES_P and (k := innermost(("p",), ("article", "main", "section", "div", "td", "th", "li", "blockquote", "nav", "aside", "form"))) >= 0:
            close(k)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            group = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if (k := innermost(group, ("ul", "ol", "dl", "table", "menu"))) >= 0:
                close(k)
        if m["rest"].endswith("/") and tag not in _BLOCK:
            continue
        if tag == "body":  # an open head ends here
            close(0)
        kind = _role(tag, m["rest"], marked > 0)
        stack.append((tag, kind))
        hidden += kind == 4
        chrome += kind == 1
        marked += kind == 2
        doubtful += kind == 3
    if at < len(page) and not hidden:
        (other if chrome else current).append(page[at:])
    flush()
    return out


def suffix_ranks(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank): suffixes in the order of their first ``depth`` tokens, by prefix doubling.

    Suffixes that agree on these tokens have equal ranks. A depth that is no power of two joins two overlapping
    prefixes of the last power.
    """
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    n, k = len(stream), 1
    while k < depth:
        step = min(k, depth - k)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:] if step < n else later[:0]
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        k += step
    return np.argsort(rank, kind="stable"), rank


def _laid_out(words: np.ndarray, block: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word in the stream, place of each block's token, place of each page's token)."""
    opens = np.concatenate([[True], block[1:] != block[:-1]])
    starts = np.concatenate([[True], page[1:] != page[:-1]])
    place = np.arange(len(words)) + np.cumsum(opens | starts) + np.cumsum(starts)
    return place, place[opens | starts] - 1, place[starts] - 2


def _covered(at: np.ndarray, run: int, place: np.ndarray) -> np.ndarray:
    """Which words lie in one of the runs that begin at ``at``."""
    mark = np.zeros(int(place[-1]) + 2, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + run, -1)
    return np.cumsum(mark)[place] > 0


def _recurring(words: np.ndarray, block: np.ndarray, page: np.ndarray, owner: np.ndarray, run: int, pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array's beginnings of runs, interval of each, owners of each interval): of all runs on ``pages`` owners or more.

    Each block begins with a token of its own, the same for all, so that short blocks in a row can make a run; pages
    are kept apart by unique tokens. owner: what counts as one page, for each page in order.
    """
    place, _, firsts = _laid_out(words, block, page)
    size = int(place[-1]) + 1
    stream = np.zeros(size, np.int64)
    stream[place] = np.unique(words, return_inverse=True)[1] + 1
    stream[firsts] = int(stream.max()) + 1 + np.arange(len(firsts))
    owner = np.unique(owner, return_inverse=True)[1]
    total = int(owner.max()) + 1
    owner = np.repeat(owner, np.diff(np.append(firsts, size)))
    order, rank = suffix_ranks(stream, run)
    # Equal ranks stand together in the suffix array: an interval for each run of tokens.
    distinct = np.bincount(np.unique(rank * total + owner) // total, minlength=int(rank.max()) + 1)
    at = order[distinct[rank[order]] >= pages]
    apart = np.zeros(size + 1, np.int64)
    apart[firsts + 1] = 1
    apart = np.cumsum(apart)
    at = at[at + run <= size]
    at = at[apart[at + run] == apart[at]]
    return at, rank[at], distinct


def repeated_words(words: np.ndarray, block: np.ndarray, page: np.ndarray, run: int = RUN_WORDS, pages: int = RUN_PAGES) -> np.ndarray:
    """Which words lie in a run of ``run`` or more tokens that is on ``pages`` distinct pages or more.

    words: hashes, in page order; block and page: the block and page of each.
    """
    if not len(words):
        return np.zeros(0, bool)
    place, _, firsts = _laid_out(words, block, page)
    return _covered(_recurring(words, block, page, np.arange(len(firsts)), run, pages)[0], run, place)


def run_hashes(words: np.ndarray, block: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the stream, number of the page, 64-bit hash) of each run of ``run`` tokens within a page."""
    place, blocks, firsts = _laid_out(words, block, page)
    size = int(place[-1]) + 1
    stream = np.zeros(size, U)
    stream[place] = words
    stream[blocks] = U(0x632BE59BD9B4E019)
    number = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, size)))
    first = np.zeros(size, bool)
    first[firsts] = True
    at = np.arange(max(0, size - run + 1))
    at = at[(number[at] == number[at + run - 1]) & ~first[at]]
    value = np.zeros(len(at), U)
    with np.errstate(over="ignore"):
        for k in range(run):
            value = mix(value + stream[at + k]) + U(k + 1)
    return at, number[at], value.view(np.int64)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            found = [blocks_of(h) for h in part.column(3).to_pylist()]
            yield pa.record_batch(
                {
                    "page_id": part.column(0),
                    "url": part.column(1),
                    "host": part.column(2),
                    "tie": part.column(4),
                    "same": pa.array([_digest("\0".join(t for t, _ in f)) for f in found], pa.int64()),
                    "blocks": pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())),
                    "kinds": pa.array([[m for _, m in f] for f in found], pa.list_(pa.int32())),
                }
            )


def _words(group: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, first word of each block, hash, block and row of each word) of a table with a column ``blocks``."""
    blocks = group.column("blocks").combine_chunks()
    flat = blocks.flatten()
    hashes, index = word_hashes(*buffers(flat))
    block = np.repeat(np.arange(len(flat)), np.diff(index))
    edge = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
    return flat, index, hashes, block, np.searchsorted(edge, block, "right") - 1


def _owners(group: pa.Table, row: np.ndarray) -> np.ndarray:
    """The page of each row that has words, in order."""
    return np.asarray(group.column("page"))[row[np.concatenate([[True], row[1:] != row[:-1]])]]


_RUNS = "host string, run long, pages long"


def _runs_of(group: pa.Table, runs: np.ndarray, pages: np.ndarray) -> pa.Table:
    host = pa.repeat(pa.scalar(group.column("host")[0].as_py() if len(group) else "", pa.string()), len(runs))
    return pa.table({"host": host, "run": pa.array(runs, pa.int64()), "pages": pa.array(pages, pa.int64())})


def _proposed(run: int):
    def propose(group: pa.Table) -> pa.Table:
        _, _, words, block, row = _words(group)
        if not len(words):
            return _runs_of(group, [], [])
        at, interval, distinct = _recurring(words, block, row, _owners(group, row), run, group.column("least")[0].as_py())
        interval, one = np.unique(interval, return_index=True)
        places, _, values = run_hashes(words, block, row, run)
        return _runs_of(group, values[np.searchsorted(places, at[one])], distinct[interval])

    return propose


def _counted(run: int):
    def count(group: pa.Table, proposed: pa.Table) -> pa.Table:
        if not len(group) or not len(proposed):
            return _runs_of(group, [], [])
        _, _, words, block, row = _words(group)
        if not len(words):
            return _runs_of(group, [], [])
        _, number, values = run_hashes(words, block, row, run)
        known = np.isin(values, np.asarray(proposed.column("run")))
        owner = np.unique(_owners(group, row), return_inverse=True)[1]
        runs, which = np.unique(values[known], return_inverse=True)
        pairs = np.unique(which * (len(owner) + 1) + owner[number[known]])
        return _runs_of(group, runs, np.bincount(pairs // (len(owner) + 1), minlength=len(runs)))

    return count


def _host_runs(hosts: list[str], runs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each run of a host."""
    code = {h: _digest(h) for h in set(hosts)}
    with np.errstate(over="ignore"):
        return mix(mix(np.array([code[h] for h in hosts], np.int64).view(U)) + runs.view(U))


def _cleaned(rows: pa.Table, often: np.ndarray, run: int) -> pa.Table:
    """Text and number of words cut of each page. often: sorted keys of the frequent runs of the pages' hosts."""
    blocks, kinds = rows.column("blocks").to_pylist(), rows.column("kinds").to_pylist()
    others = [[t for t, k in zip(b, m, strict=True) if k != CONTENT] for b, m in zip(blocks, kinds, strict=True)]
    flat = pa.array([t for b in others for t in b], pa.string())
    words, index = word_hashes(*buffers(flat))
    block = np.repeat(np.arange(len(flat)), np.diff(index))
    edge = np.concatenate([[0], np.cumsum([len(b) for b in others])]).astype(np.int64)
    row = np.searchsorted(edge, block, "right") - 1
    covered = np.zeros(len(words), bool)
    if len(words) and len(often):
        at, number, values = run_hashes(words, block, row, run)
        hosts = rows.column("host").to_pylist()
        owner = row[np.concatenate([[True], row[1:] != row[:-1]])]  # the row of each page that has words
        keys = _host_runs([hosts[k] for k in owner[number].tolist()], values)
        found = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        covered = _covered(at[often[found] == keys], run, _laid_out(words, block, row)[0])
    texts, removed, b = [], [], 0
    for own, marks in zip(blocks, kinds, strict=True):
        kept, gone, content = [], 0, any(k in (CONTENT, DOUBTFUL) for k in marks)
        for text, kind in zip(own, marks, strict=True):
            if kind == CONTENT:
                kept.append(text)
                continue
            cut = covered[index[b] : index[b + 1]]
            b += 1
            gone += int(cut.sum())
            if kind == CHROME or kind == PLAIN and content:
                continue
            if cut.any():
                # Words here are those of ``word_hashes``; blocks hold single spaces only, but for odd spaces.
                left = [w for w, c in zip(re.findall(r"[^\x20\x09-\x0D]+", text), cut.tolist(), strict=True) if not c]
                text = " ".join(left)
            if text:
                kept.append(text)
        texts.append("\n\n".join(kept))
        removed.append(gone)
    return pa.table({"page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(texts, pa.string()), "n_removed_tokens": pa.array(removed, pa.int64())})


_CLEAN = "page_id long, url string, text string, n_removed_tokens long"


def _clean_batches(often: np.ndarray, run: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                yield from _cleaned(pa.Table.from_batches([batch.slice(start, 256)]), often, run).combine_chunks().to_batches()

    return clean


def _clean_groups(run: int):
    def clean(group: pa.Table, often: pa.Table) -> pa.Table:
        hosts = often.column("host").to_pylist()
        return _cleaned(group, np.sort(_host_runs(hosts, np.asarray(often.column("run"), np.int64))) if hosts else np.zeros(0, U), run)

    return clean


def frequent_runs(pages: DataFrame, run: int, least_pages: int, share: float, group_pages: int) -> tuple[DataFrame, DataFrame, bool]:
    """((host, run) of the runs that are on enough pages of their host, (host, groups), whether hosts are few).

    pages: (host, page, blocks); rows of one ``page`` count once. A run on n pages of a host of g groups is on n / g
    pages of one group at least, so runs below that in each group need no count over the host.
    """
    n = F.count_distinct("page")
    needed = F.greatest(F.lit(least_pages), F.ceil(n * share - 1e-9))
    hosts = pages.groupBy("host").agg(F.ceil(n / group_pages).alias("groups"), needed.alias("needed"))
    hosts = written(hosts.withColumn("least", F.ceil(F.col("needed") / F.col("groups"))), "hosts")
    few = hosts.count() <= BROADCAST_HOSTS
    with_host = F.broadcast(hosts) if few else hosts
    dealt = pages.join(with_host, "host").withColumn("part", F.pmod("page", "groups"))
    proposed = dealt.select("host", "part", "page", "blocks", "least").groupBy("host", "part").applyInArrow(_proposed(run), _RUNS)
    proposed = written(proposed, "proposed").join(with_host, "host")
    # A host of one group is counted whole already.
    wide = proposed.where("groups > 1").select("host", "run", "groups").distinct()
    spread = wide.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), "run")
    left = dealt.where("groups > 1").select("host", "part", "page", "blocks").groupBy("host", "part")
    counts = left.cogroup(spread.groupBy("host", "part")).applyInArrow(_counted(run), _RUNS)
    sums = counts.groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(with_host, "host").where("pages >= needed")
    often = proposed.where("groups = 1").select("host", "run").union(sums.select("host", "run"))
    return written(often, "often"), hosts.select("host", "groups"), few


def extract_text(pages: DataFrame, run: int = RUN_WORDS, least_pages: int = RUN_PAGES, share: float = RUN_SHARE, group_pages: int = GROUP_PAGES, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(page_id, url, text, n_removed_tokens) of each row of ``pages`` (page_id, url, html).

    Blocks are joined by two line feeds. n_removed_tokens counts the words, all of them outside content, that recurring
    runs covered. Rows that repeat are all returned; rows of one page_id and url, and pages of the same blocks, count as
    one page. Null or empty html, and pages without visible words, give an empty text. Pages without a url share a
    host. A run is cut if it is on ``least_pages`` pages and on the given share of the host's pages that have words.
    Hosts with more than ``group_pages`` pages are dealt out to groups of about that size, so a task's memory is
    bounded; pages are counted over the whole host. Up to ``broadcast_runs`` frequent runs are given to every task, more
    meet the pages of their host in a shuffle. An empty table gives no rows. Extra columns are ignored.
    """
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"),
        F.col("html").cast("string").alias("html"),
        F.xxhash64("page_id", "url").alias("tie"),
    )
    parsed = written(plain.mapInArrow(_parse, "page_id long, url string, host string, tie long, same long, blocks array<string>, kinds array<int>"), "parsed")
    others = F.transform(F.filter(F.arrays_zip("blocks", "kinds"), lambda b: b["kinds"] != CONTENT), lambda b: b["blocks"])
    # Pages of equal words count once, under the least of their ties; so do the rows of one page_id and url.
    seen = parsed.where(F.size("blocks") > 0).select("host", "same", "tie", others.alias("blocks"))
    streams = seen.groupBy("host", "same").agg(F.min("tie").alias("page"), F.first("blocks").alias("blocks")).select("host", "page", "blocks")
    often, sizes, few = frequent_runs(written(streams, "streams"), run, least_pages, share, group_pages)
    rows = parsed.select("page_id", "url", "host", "tie", "blocks", "kinds")
    if often.count() <= broadcast_runs:
        known = often.toPandas()  # ``broadcast_runs`` rows at most
        keys = np.sort(_host_runs(known["host"].tolist(), known["run"].to_numpy(np.int64))) if len(known) else np.zeros(0, U)
        return rows.mapInArrow(_clean_batches(keys, run), _CLEAN)
    sizes = F.broadcast(sizes) if few else sizes
    dealt = rows.join(sizes, "host", "left").withColumn("part", F.pmod("tie", F.coalesce("groups", F.lit(1))))
    spread = often.join(sizes, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), "run")
    return dealt.groupBy("host", "part").cogroup(spread.groupBy("host", "part")).applyInArrow(_clean_groups(run), _CLEAN)
