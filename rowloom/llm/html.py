"""HTML extraction (operator 7): the suffix array of a host finds boilerplate, what remains is the page.

The visible tokens of all pages of a host are one token stream.  Substrings of ``MIN_TOKENS`` or more tokens that
distinct pages of the host share are boilerplate, and so are shorter runs, of ``MIN_BLOCK_TOKENS`` or more, if they
are whole blocks on both pages: a navigation or a footer of a few words, but no few words that two articles have in
common.  The runs of tokens that are left uncovered are the page's own.
The suffix array is that of ``rowloom.llm.pfp``, with token hashes salted by the host: its shards cut across hosts,
so a host with most of the pages is as parallel as the rest.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Table, Words, mix, pieces, release, shards_for, text_bytes, with_row_key
from rowloom.llm.pfp import repeated_spans

MIN_TOKENS = 12
#: Shared runs of whole blocks are boilerplate from so many tokens.
MIN_BLOCK_TOKENS = 4
TRIGGER_TOKENS, TRIGGER_MODULUS = 2, 3
#: A run of the page's own tokens must be so long to be kept; shorter ones are scraps between two boilerplates.
MIN_RUN = 1

#: The rest of a tag: values in quotes may hold ">"; a quote that does not close, or stands elsewhere, counts for nothing.
_REST = r"(?:(?:[^<>=]++|=\s*+(?:\"[^\"<]*+\"|'[^'<]*+')?+)*+>|[^>]*>)"
#: Comments, and elements whose content is no text: they open here, and ``_without`` looks for their ends.
_OPEN = re.compile(rf"<!--|<(script|style|noscript|template|svg|title)\b{_REST}", re.I)
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "title")}
#: Of these the rest of the page goes if they do not close, as a browser has it; of the others only the tag.
_TO_THE_END = ("script", "style")
_BLOCK = re.compile(rf"</?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|main|aside|h[1-6]|table|tr|td|th|dl|dt|dd|pre|blockquote|form|hr|body|head|html|title|figure|figcaption|option|select|button)\b{_REST}", re.I)
_TAG = re.compile(rf"<[/!?a-zA-Z]{_REST}")
_HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """The lower-cased host of an address; "" if it has none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _without(page: str) -> str:
    """The page without comments and elements whose content is no text, each a space; one look at each character."""
    out, at, open_ended = [], 0, set()
    while (m := _OPEN.search(page, at)) is not None:
        kind = (m[1] or "").lower()
        out.append(page[at : m.start()])
        at = m.end()
        if not kind:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif kind not in open_ended:
            close = _CLOSE[kind].search(page, at)
            if close:
                at = close.end()
            elif kind in _TO_THE_END:
                at = len(page)
            else:
                open_ended.add(kind)
        out.append(" ")
    out.append(page[at:])
    return "".join(out)


def blocks_of(page: str | None) -> list[list[str]]:
    """The visible tokens of a page by block, without blocks that have none; line ends of the source end no block."""
    if not page:
        return []
    lines = _TAG.sub("", _BLOCK.sub("\n", _without(page).replace("\n", " "))).replace("\0", "").split("\n")
    return [w for x in lines if (w := (_html.unescape(x) if "&" in x else x).replace("\0", "").split())]


def tokens_of(page: str | None) -> list[str]:
    """The visible tokens of a page: scripts, styles, comments and the title are no text."""
    return [t for b in blocks_of(page) for t in b]


def block_windows(ends: np.ndarray, least: int, most: int) -> np.ndarray:
    """(start, end) of the shortest runs of whole blocks of ``least`` tokens or more from each block on and up to
    each block, without those of ``most`` or more.  They cover every longer run.  Blocks end at ``ends``."""
    cuts = np.concatenate(([0], ends))
    first = np.searchsorted(cuts, cuts[:-1] + least)
    ok = first < len(cuts)
    on = np.stack((cuts[:-1][ok], cuts[first[ok]]), 1)
    last = np.searchsorted(cuts, cuts[1:] - least, side="right") - 1
    ok = last >= 0
    both = np.unique(np.concatenate((on, np.stack((cuts[last[ok]], cuts[1:][ok]), 1))), axis=0)
    return both[both[:, 1] - both[:, 0] < most]


def _stream(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, content digests, offsets, and token hashes salted by the host, of parsed pages."""
    words = Words(part.column("body"), sep=True)
    salts = np.array([xxhash.xxh3_64_intdigest(h) for h in part.column("host").to_pylist()], np.uint64)
    flat = mix(words.hashes() ^ np.repeat(salts, np.diff(words.off)))
    digest = np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes()) for a, b in pairwise(words.off.tolist())], np.uint64).view(np.int64)
    return part.column("id").to_numpy(zero_copy_only=False), digest, words.off, flat


def parsed(rows: DataFrame) -> DataFrame:
    """(id, host, body) of pages (k0, k1, k2): the visible tokens, a space after each and a line end after each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "k2"):
                bodies = ["\n".join(map(" ".join, blocks_of(x))) for x in part.column("k2").to_pylist()]
                yield pa.record_batch({"id": part.column("k0").cast(pa.int64()), "host": pa.array(map(host_of, part.column("k1").to_pylist()), pa.string()), "body": pa.array(bodies, pa.string())})

    return rows.mapInArrow(run, "id long, host string, body string")


def shared_blocks(src: DataFrame, least: int, most: int, n_shards: int) -> DataFrame:
    """(id, start, length) of the windows of whole blocks that distinct pages of a host share."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "body"):
                h = xxhash.xxh3_64_intdigest
                page, at, key, digest = [], [], [], np.zeros(part.num_rows, np.int64)
                for i, (host, text) in enumerate(zip(part.column("host").to_pylist(), part.column("body").to_pylist())):
                    tok, size = [], []
                    for b in text.split("\n") if text else ():
                        words = b.split(" ")
                        tok += words
                        size.append(len(words))
                    salt = h(host)
                    digest[i] = h(" ".join(tok)) - (1 << 63)
                    for a, b in block_windows(np.cumsum(size), least, most).tolist() if size else ():
                        page.append(i)
                        at.append((a, b))
                        key.append(h(" ".join(tok[a:b]), salt))
                if not at:
                    continue
                page, at, key = np.array(page), np.array(at), np.array(key, np.uint64)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                shard = (key % np.uint64(n_shards)).astype(np.int64)
                for s in np.unique(shard).tolist():
                    own = np.flatnonzero(shard == s)
                    rows, where = np.unique(page[own], return_inverse=True)
                    cols = [key[own], ids[rows], digest[rows], where.astype(np.int32), at[own].astype(np.int32)]
                    yield pa.record_batch([pa.array([s], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], names=["shard", "keys", "ids", "docs", "page", "spans"])

    def search(t: pa.Table) -> pa.Table:
        got = [[np.frombuffer(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("keys", np.uint64), ("ids", np.int64), ("docs", np.int64), ("page", np.int32), ("spans", np.int32))]
        keys, spans = np.concatenate(got[0]), np.concatenate(got[4]).reshape(-1, 2).astype(np.int64)
        ids, docs = (np.concatenate([x[p] for x, p in zip(got[i], got[3])]) for i in (1, 2))
        order = np.argsort(keys, kind="stable")
        run = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        shared = np.minimum.reduceat(docs[order], run) != np.maximum.reduceat(docs[order], run)
        hit = order[np.repeat(shared, np.diff(np.append(run, len(order))))]
        a, b = spans[hit, 0], spans[hit, 1]
        return pa.table({"id": pa.array(ids[hit]), "start": pa.array(a), "length": pa.array(b - a)})

    return src.mapInArrow(windows, "shard int, keys binary, ids binary, docs binary, page binary, spans binary").groupBy("shard").applyInArrow(search, "id long, start long, length long")


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_run: int = MIN_RUN, w: int = TRIGGER_TOKENS, p: int = TRIGGER_MODULUS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_block: int = MIN_BLOCK_TOKENS) -> DataFrame:
    """(page_id, host, text, n_tokens, n_boilerplate): each page without what it shares with other pages of its host.

    Every ``min_tokens`` tokens in a row that another page of the host has too are boilerplate, and every run of whole
    blocks of ``min_block`` tokens or more that another page has as whole blocks; runs of at least
    ``min_run`` other tokens are kept, a line each.  Pages with the same tokens are one page: copies do not make
    each other boilerplate.  Titles, scripts, styles and comments are no text.  Broken markup is read as far as
    it goes: an unclosed comment, script or style hides the rest, any other unclosed tag only itself; optional end tags,
    that of the head included, may be missing.  Values in quotes may hold ">", but not "<".

    NULL or empty pages give an empty text with 0 tokens.  A NULL or odd url belongs to the host "".  Rows with a
    NULL id bear on no other page and are returned with all their tokens.  Rows that repeat an id are searched each
    and lose the spans of both.  Other columns are ignored.  An empty table gives an empty result.
    """
    rows = with_row_key(pages, [id_col, url_col, html_col])
    # The search reads the tokens of parsed pages; they go, and what found the spans goes, before the pages themselves move.
    tokens = Table(parsed(rows.where("k0 is not null and k2 is not null")))
    known = tokens.df.where("body <> ''")
    n_shards = shards_for(text_bytes(known, "body"))
    long = Table(repeated_spans(known, "body", _stream, min_tokens, w, p, n_shards)).df
    release(pages.sparkSession)
    short = Table(shared_blocks(known, min_block, min_tokens, n_shards)).df
    tokens.drop()
    release(pages.sparkSession)
    spans = long.union(short)
    # Both sides come to a page's bucket in packed form: one compressed row for each bucket of a batch.
    bucket = F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in pieces(batch, "k2"):
                home = np.array(part.column("bucket").to_pylist())
                ids, urls, texts = (part.column(c).to_pylist() for c in ("k0", "k1", "k2"))
                for s in np.unique(home).tolist():
                    own = np.flatnonzero(home == s).tolist()
                    body = "\0".join(" ".join(tokens_of(texts[i])) for i in own)
                    yield pa.record_batch({"bucket": pa.array([s], pa.int32()), "ids": pa.array([[ids[i] for i in own]], pa.list_(pa.int64())), "hosts": pa.array([[host_of(urls[i]) for i in own]], pa.list_(pa.string())), "body": pa.array([pack.compress(body.encode())], pa.binary())})

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        at: dict[int, list[tuple[int, int]]] = {}
        for i, a, n in zip(right.column("id").to_pylist(), right.column("start").to_pylist(), right.column("length").to_pylist()):
            at.setdefault(i, []).append((a, a + n))
        out: list[tuple] = []
        unpack = zstandard.ZstdDecompressor()
        for ids, hosts, body in zip(left.column("ids").to_pylist(), left.column("hosts").to_pylist(), left.column("body").to_pylist()):
            for i, host, text in zip(ids, hosts, unpack.decompress(body).decode().split("\0")):
                tok, lines, done, covered = text.split(" ") if text else [], [], 0, 0
                for a, b in [*sorted(at.get(i, [])), (len(tok), len(tok))]:
                    if a - done >= min_run and a > done:
                        lines.append(" ".join(tok[done:a]))
                    covered += max(0, b - max(a, done))
                    done = max(done, b)
                out.append((i, host, "\n".join(lines), len(tok), covered))
        c = list(zip(*out)) or [()] * 5
        return pa.table({"page_id": pa.array(c[0], pa.int64()), "host": pa.array(c[1], pa.string()), "text": pa.array(c[2], pa.string()), "n_tokens": pa.array(c[3], pa.int64()), "n_boilerplate": pa.array(c[4], pa.int64())})

    packed = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("k0").cast("long")), F.lit(n_shards)).cast("int")).mapInArrow(squeeze, "bucket int, ids array<long>, hosts array<string>, body binary")
    return packed.groupBy("bucket").cogroup(spans.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(cut, "page_id long, host string, text string, n_tokens long, n_boilerplate long")
