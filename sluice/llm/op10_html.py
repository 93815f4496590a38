"""Main-text extraction from raw pages, with a suffix array over each host's token streams.

A page is read into blocks of text. Menus, headers, footers, sidebars, notices, adverts, forms and comments that the
markup names are left out, as are scripts, styles and markup. The token streams of the blocks of all pages of a host are put together,
their suffixes are ordered by their first ``RUN`` tokens, and neighbours that agree on all of these in two distinct
pages mark a repeated substring. Covered tokens go; runs of uncovered tokens stay.

A check by the markup follows. Where a page declares its article (``article``, else ``main``), the blocks of it are the text, whole:
articles may repeat across pages and are no boilerplate for that, so covered tokens of it are put back and what lies outside goes.
Elsewhere a repeated substring goes if two pages have it outside declared articles; what else only an article holds is a copy of it.

The suffixes are ordered by a hash of (host, first RUN tokens). The pages of a host of up to ``HOST_BYTES`` of html are dealt to one task, which
orders the suffixes there, so that only the pages travel. A larger host lies on many tasks: its suffixes travel as packed arrays, a row for
each batch of pages and part of the hashes, and the repeated ones come back, a row for each part and bucket of pages.

Defined cases: null or empty html gives an empty text; html may end anywhere; a null url is a host of its own; rows with
one page_id are one page to the suffix array, and each keeps its row; other columns stay as they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark, _text

RUN = 8  # tokens that a repeated substring has at least
HOST_BYTES, CHUNK_BYTES = 16 << 20, 8 << 20  # of html: of a host within one task; of hosts that a task takes together

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = frozenset("script style noscript template textarea title iframe svg math head select object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACE = frozenset(("br", "td", "th", "img", "wbr"))
_DROPPED = frozenset("nav footer aside form menu dialog button".split())
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related "
    "recommended recommendations comment comments commentlist disqus reply replies respond popup modal overlay copyright disclaimer widget widgets toolbar "
    "pagination pager contentinfo complementary search form".split()
)


def _role(name: str, attributes: str, inside: bool) -> str:
    """'drop', 'article', 'main' or '' for an element; ``inside``: within an article."""
    if name in _DROPPED or name == "header" and not inside:
        return "drop"
    if name in ("article", "main"):
        named = ""
    else:
        named = " ".join(m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)) if attributes else ""
    words = set(re.split(r"[\s_\-]+", named.lower())) if named else ()
    if words and not _DROPPED_NAMES.isdisjoint(words) or "header" in words and not inside:
        return "drop"
    return name if name in ("article", "main") else "main" if "main" in words and "role" in attributes.lower() else ""


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(role, text) of the blocks of a page that are not left out; role is 'article', 'main' or 'open'."""
    out: list[tuple[str, str]] = []
    if not page:
        return out
    parts: list[str] = []
    stack: list[tuple[str, str]] = []
    inside = {"drop": 0, "article": 0, "main": 0, "": 0}
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(("article" if inside["article"] else "main" if inside["main"] else "open", text))

    def say(text: str) -> None:
        if not inside["drop"]:
            parts.append(text)

    def enter(name: str, role: str) -> None:
        stack.append((name, role))
        inside[role] += 1

    def leave(k: int) -> None:
        for _, role in stack[k:]:
            inside[role] -= 1
        del stack[k:]

    def close(names: tuple[str, ...], within_block: bool) -> None:
        """Close the nearest of ``names`` and what is open in it; ``within_block``: only if no block lies between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return leave(k)
            if within_block and stack[k][0] in _BLOCK:
                return

    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            say(entities.unescape(page[at:i]))
        if i >= n:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i):
            end = page.find(">", i)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, i)
        if not m:
            nxt = page[i + 1 : i + 2]
            if not (nxt.isalpha() or nxt == "/"):
                say("<")
                at = i + 1
                continue
            end = page.find(">", i)
            at = n if end < 0 else end + 1
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if name in _RAW and not closing:
            if attributes.rstrip().endswith("/") and name in ("svg", "math", "iframe", "object"):
                continue
            if name in ("head", "object", "select", "svg", "math", "template", "noscript"):
                end = re.compile(rf"</{name}\s*>|<body[\s>]" if name == "head" else rf"</{name}\s*>", re.I).search(page, at)
                at = n if not end else end.end() if page[end.start() + 1] == "/" else end.start()
            else:
                end = re.compile(rf"</{name}[\s>/]", re.I).search(page, at)
                at = n if not end else (page.find(">", end.start()) + 1 or n)
            say(" ")
            continue
        if name in _SPACE:
            say(" ")
        if name not in _BLOCK:  # inline elements do not part a block, whether or not they are left out
            if closing:
                close((name,), True)
            elif name not in _VOID and not attributes.rstrip().endswith("/"):
                enter(name, "drop" if name in _DROPPED or attributes and _role(name, attributes, True) == "drop" else "")
            continue
        flush()
        if closing:
            close((name,), False)
            continue
        close(("p",), True)
        if name == "li":
            close(("li",), True)
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            enter(name, _role(name, attributes, inside["article"] > 0))
    flush()
    return out


def declared(blocks: list[tuple[str, str]]) -> list[str] | None:
    """The blocks of the article that the page declares, or null if it declares none."""
    for role in ("article", "main"):
        if own := [t for r, t in blocks if r == role]:
            return own
    return None


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def stream(blocks: list[tuple[str, str]], host: str, run_length: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the suffixes of a page's tokens by their first RUN, the lowest bit set if these are not all in the declared article; and their places."""
    texts = [t for _, t in blocks]
    raw = np.frombuffer(" ".join(texts).encode("utf-8", "replace"), np.uint8)
    tokens = _text.Words(raw, np.array([0, len(raw)]), lower=False).hashes()
    roles = {r for r, _ in blocks}
    own = "article" if "article" in roles else "main"
    outside = np.repeat([r != own for r, _ in blocks], [t.count(" ") + 1 for t in texts])
    h, at = _text.shingles(tokens, np.array([0, len(tokens)]), run_length)
    upto = np.append(0, np.cumsum(outside))
    open_ = upto[at + run_length] > upto[at]
    return _text.mix(h ^ np.uint64(hash64(host))) & ~np.uint64(1) | open_.astype(np.uint64), at


def hash64(text: str) -> int:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return int(_text.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def suffixes(pages: DataFrame, parts: int, run_length: int = RUN) -> DataFrame:
    """part, pages, counts, keys: of the pages of a batch, the keys that fall into a part of all hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stream(blocks_of(page), host_of(url), run_length)[0] for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            keys = np.concatenate([np.zeros(0, np.uint64), *found])
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            part = ((keys >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = []
            for p in np.flatnonzero(np.diff(edge)):
                own = order[edge[p] : edge[p + 1]]
                some, counts = np.unique(of[own], return_counts=True)
                rows.append((int(p), ids[some].tobytes(), counts.astype(np.int32).tobytes(), keys[own].tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "pages", "counts", "keys"])

    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "part int, pages binary, counts binary, keys binary")


def repeated(page: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Pages, and of each its keys that another page has too, the lowest bit set if two pages have it outside declared articles."""
    order = np.lexsort((page, key >> np.uint64(1)))
    page, key = page[order], key[order]
    one, out = key >> np.uint64(1), (key & np.uint64(1)).astype(bool)

    def shared(use: np.ndarray) -> np.ndarray:
        k, p = one[use], page[use]
        return np.unique(k[1:][(k[1:] == k[:-1]) & (p[1:] != p[:-1])])  # by key and page: two pages are neighbours somewhere

    every, open_ = shared(np.ones(len(key), bool)), shared(out)
    at = np.flatnonzero(np.isin(one, every))
    value = (one[at] << np.uint64(1)) | np.isin(one[at], open_).astype(np.uint64)
    by = np.argsort(page[at], kind="stable")
    ids, first = np.unique(page[at][by], return_index=True)
    return ids, [x.tobytes() for x in np.split(value[by], first[1:])] if len(ids) else []


def covered_places(pages: DataFrame, run_length: int = RUN) -> DataFrame:
    """_page, _places: keys of the repeated substrings of a page, the lowest bit set if two pages have it outside declared articles."""
    n = _spark.partitions(pages.sparkSession)

    def of_part(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, list[bytes]]:
        page = np.concatenate([np.repeat(np.frombuffer(p, np.int64), np.frombuffer(c, np.int32)) for p, c, _ in rows])
        return repeated(page, np.concatenate([np.frombuffer(k, np.uint64) for _, _, k in rows]))

    def packed(found: list[tuple[np.ndarray, list[bytes]]]) -> pa.RecordBatch:
        """A row for each bucket of pages: pages, counts of keys, keys."""
        ids = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
        keys = [k for _, own in found for k in own]
        bucket = (_text.mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)
        rows = []
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            rows.append((int(b), ids[own].tobytes(), np.array([len(keys[k]) for k in own], np.int32).tobytes(), b"".join(keys[k] for k in own)))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "pages", "counts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, found, size = None, [], [], 0
        for b in batches:
            for p, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if p != last and rows:
                    found.append(of_part(rows))
                    size += sum(map(len, found[-1][1]))
                    rows = []
                    if size > CHUNK_BYTES:
                        yield packed(found)
                        found, size = [], 0
                last = p
                rows.append(row)
        if rows:
            found.append(of_part(rows))
        if found:
            yield packed(found)

    def by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[bytes]] = {}
        for b in batches:
            for ids, counts, keys in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                upto = np.cumsum(np.frombuffer(counts, np.int32))
                for page, k, size in zip(np.frombuffer(ids, np.int64).tolist(), upto.tolist(), np.frombuffer(counts, np.int32).tolist(), strict=True):
                    own.setdefault(page, []).append(keys[k - size : k])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(own.values(), pa.list_(pa.binary()))], ["_page", "_places"])

    dealt = suffixes(pages, 4 * n, run_length).repartition(n, "part").sortWithinPartitions("part")
    back = dealt.mapInArrow(run, "bucket int, pages binary, counts binary, keys binary").repartition(n, "bucket")
    return back.mapInArrow(by_page, "_page long, _places array<binary>")


def unique_runs(blocks: list[tuple[str, str]], host: str, repeated: list[bytes] | None, run_length: int = RUN) -> list[str]:
    """The blocks less the tokens that repeated substrings cover; of a declared article all of it, and no more."""
    own = declared(blocks)
    if own is not None:  # the check: what is covered in it is put back
        return own
    keys, at = stream(blocks, host, run_length)
    found = np.frombuffer(b"".join(repeated or ()), np.uint64)
    gone: set[int] = set()
    for p in at[np.isin(keys | np.uint64(1), found)]:  # keys without the lowest bit are repeated in articles alone: put back too
        gone.update(range(p, p + run_length))
    out, n = [], 0
    for _, text in blocks:
        tokens = text.split(" ")
        kept = " ".join(t for k, t in enumerate(tokens, n) if k not in gone)
        n += len(tokens)
        if kept:
            out.append(kept)
    return out


def main_text(pages: DataFrame, run_length: int = RUN) -> DataFrame:
    """All columns of ``pages`` with text and n_chars (which replace columns of these names)."""
    kept = pages.drop("text", "n_chars")
    width, cols = len(kept.columns), kept.columns
    at, url_at = cols.index("html"), cols.index("url")
    page_name, places_name = _spark.fresh(cols, "_page", "_places")
    schema = kept.select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(at).to_pylist(), b.column(url_at).to_pylist(), b.column(width).to_pylist(), strict=True)
            texts = ["\n\n".join(unique_runs(blocks_of(page), host_of(url), places, run_length)) for page, url, places in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    host_name = _spark.fresh([*cols, page_name, places_name], "_host")[0]
    id_at = cols.index("page_id")

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_signed(host_of(u)) for u in b.column(url_at).to_pylist()], pa.int64())], [*cols, host_name])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_signed(host_of(u)) for u in b.column(0).to_pylist()], pa.int64()), b.column(1)], ["host", "bytes"])

    def chunk(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [[blocks_of(page) for page in b.column(at).to_pylist()] for b in parts]
        names = [[host_of(url) for url in b.column(url_at).to_pylist()] for b in parts]
        ids = [b.column(id_at).to_pylist() for b in parts]
        keys = [stream(x, host, run_length)[0] for own, of in zip(blocks, names, strict=True) for x, host in zip(own, of, strict=True)]
        page = np.repeat(np.array([i for own in ids for i in own], np.int64), [len(x) for x in keys])
        found, packed = repeated(page, np.concatenate(keys))
        places = dict(zip(found.tolist(), packed, strict=True))
        for b, own, of, pages_ in zip(parts, blocks, names, ids, strict=True):
            texts = ["\n\n".join(unique_runs(x, host, [places[i]] if i in places else None, run_length)) for x, host, i in zip(own, of, map(int, pages_), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    def whole_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for b in batches:
            host = b.column(width).to_numpy()
            length = np.cumsum(np.append(0, [len(x or "") for x in b.column(at).to_pylist()]))
            edge = np.append(np.flatnonzero(np.append(True, host[1:] != host[:-1])), len(host)) if len(host) else np.zeros(1, np.int64)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if size > CHUNK_BYTES and host[i] != last:  # keys hold the host, so hosts may go together, but each whole
                    yield from chunk(parts)
                    parts, size = [], 0
                parts.append(b.slice(i, j - i))
                size, last = size + int(length[j] - length[i]), host[i]
        if parts:
            yield from chunk(parts)

    named = kept.where(F.col("page_id").isNotNull())
    nameless = kept.where(F.col("page_id").isNull()).withColumn(places_name, F.lit(None).cast("array<binary>"))
    html_size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    size_of = named.select("url", html_size.alias("bytes")).mapInArrow(sizes, "host long, bytes long").groupBy("host").agg(F.sum("bytes").alias("bytes"))
    large = [r["host"] for r in size_of.where(F.col("bytes") > HOST_BYTES).select("host").collect()]  # no more than HOST_BYTES go into the html
    tagged = named.mapInArrow(hosts, named.withColumn(host_name, F.lit(0).cast("long")).schema)
    is_large = F.col(host_name).isin(large) if large else F.lit(False)
    near = tagged.where(~is_large).repartition(_spark.partitions(pages.sparkSession), host_name).sortWithinPartitions(host_name)
    out = near.mapInArrow(whole_hosts, schema)
    rest = nameless
    if large:
        far = tagged.where(is_large).drop(host_name)
        places = covered_places(far, run_length).withColumnsRenamed({"_page": page_name, "_places": places_name})
        joined = far.join(places, far["page_id"].cast("long") == places[page_name], "left").select(*[far[c] for c in cols], places_name)
        rest = joined.unionByName(nameless)
    return out.unionByName(rest.mapInArrow(runs, schema))


def _signed(host: str) -> int:
    return hash64(host) - (1 << 63)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_spark.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
