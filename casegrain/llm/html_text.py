"""Main text of web pages: markup protects and seeds, each host's suffix array decides.

Markup names what it knows. Text inside an article or main element is
protected. Forms, reader comments, adverts, lists of other articles and
embedded objects never are main text. Menus, headers, footers, sidebars and
notices are only *presumed* boilerplate: boilerplate is what a site repeats.

So the page token streams of a host, articles included, are concatenated and
their suffixes sorted; neighbours in that order with ``RUN`` or more tokens in
common are one class of windows, and a class that reaches outside articles on
pages of different content is repeated. Repeats decide twice:

* Outside articles, tokens that a repeat covers are removed and unique runs kept.
* A presumed kind of furniture is removed, unique runs too, while the repeats
  of the whole table bear the presumption out: ``PRIOR`` pages count for it, and
  of the pages that have it a share of at least ``BORNE_OUT`` must be repeats.

A host's pages are dealt by ranges of hosts to groups of bounded size, each with
its own suffix array. Where a host is in several groups, the windows that reach
outside articles and that no group sees repeated meet by 128-bit digests, so the
result doesn't depend on the dealing.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, read_table, sized_slices, stage

RUN = 8
#: Text that shares a suffix array, and that one task holds.
GROUP_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: Text that one packed row holds, so that ranges of rows are ranges of bytes.
PACK_BYTES = 128 << 10
#: Pages that count for a kind of furniture from the start, and the share that must bear it out.
PRIOR = 20
BORNE_OUT = 0.1

#: Kinds that repeats must bear out, by their number; ``NEVER`` is no main text whatever repeats.
SOFT = ("menu", "header", "footer", "sidebar", "notice")
NEVER = len(SOFT) + 1

# fixed values: element names of HTML, and names that sites give to parts of pages
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
_INLINE = set(
    "a abbr acronym applet area audio b base basefont bdi bdo big blink br button canvas cite code col colgroup data datalist del dfn em embed font frame i iframe img input ins kbd keygen label link map mark marquee math meta meter "
    "nobr noembed noframes noscript object output param picture plaintext portal progress q rb rp rt rtc ruby s samp script search select slot small source spacer span strike strong style sub sup svg template textarea time track tt u "
    "var video wbr xmp".split()
)
_RAW = "script style textarea title xmp iframe noembed noframes".split()
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_LOOSE = set("p li dt dd tr td th thead tbody tfoot option b i em strong a span small u s sub sup font code abbr cite q label mark time".split())
_ELEMENTS = {
    **dict.fromkeys("nav menu".split(), "menu"), "footer": "footer", "aside": "sidebar",
    **dict.fromkeys("form dialog search noscript template svg math object canvas audio video select button datalist applet".split(), "never"),
}
_ROLES = {
    **dict.fromkeys("navigation menu menubar".split(), "menu"), "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "alert": "notice",
    **dict.fromkeys("search form dialog alertdialog".split(), "never"),
}
_NAMES = {
    **dict.fromkeys("nav navbar navigation menu menus breadcrumb breadcrumbs pagination toolbar".split(), "menu"),
    **dict.fromkeys("header masthead topbar".split(), "header"),
    **dict.fromkeys("footer copyright".split(), "footer"),
    **dict.fromkeys("sidebar sidebars widget widgets".split(), "sidebar"),
    **dict.fromkeys("banner banners consent cookie cookies gdpr modal notice notices popup share sharing shares social tags".split(), "notice"),
    **dict.fromkeys(
        "ad ads adv advert adverts advertisement advertising promo promos sponsor sponsored comment comments disqus reply replies respond form login newsletter recommended related search signup subscribe".split(), "never"
    ),
}
#: Words that leave a compound name what its other words make it: "site-header" is one, "with-sidebar" and "entry-header" are not.
_NEUTRAL = set("area bar block box btn button buttons container bottom global google group icons inner item items left link links list main page posts primary right secondary section site slot top unit wrap wrapper".split())

_ATTRIBUTES = r"""(?:[^'"<>]|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^<>]*>?|" + "|".join(rf"<{n}(?=[\s/>]){_ATTRIBUTES}>.*?</{n}(?=[\s/>])[^>]*>" for n in _RAW) + rf"|</?[a-z]{_ATTRIBUTES}>|<|[^<]+", re.S | re.I
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_NUMBER = {"": 0, **{k: i + 1 for i, k in enumerate(SOFT)}, "never": NEVER}


@lru_cache(4096)
def name_kind(name: str) -> str:
    """The kind that a class or id of this name has, or none."""
    if name.lower() in _NAMES:
        return _NAMES[name.lower()]
    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    kinds = [_NAMES[p] for p in parts if p in _NAMES]
    return kinds[-1] if kinds and all(p in _NAMES or p in _NEUTRAL for p in parts) else ""


@lru_cache(4096)
def _markup(name: str, tag: str, inside: bool) -> tuple[int, bool]:
    """(kind, whether it holds an article) of a start tag."""
    found = _ELEMENTS.get(name, "header" if name == "header" and not inside else "")
    article = name in ("article", "main")
    if not found and "=" in tag:
        for key, *values in _ATTRIBUTE.findall(tag):
            key, value = key.lower(), "".join(values)
            if key == "role":
                found = found or _ROLES.get(value.strip().lower(), "")
                article |= value.strip().lower() in ("main", "article")
            elif key in ("class", "id") and name not in ("html", "body", "article", "main"):
                found = found or next((k for k in map(name_kind, value.split()) if k), "")
    return _NUMBER[found], article


def blocks(page: str | None) -> list[tuple[str, bool, int]]:
    """(text, inside an article, kind) of each block in page order."""
    found: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, int, bool]] = []  # name, kind, article
    pieces: list[str] = []
    kinds: list[int] = []
    article = 0

    def close():
        text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            found.append((text, article > 0, NEVER if NEVER in kinds else kinds[0] if kinds else 0))

    def leave():
        nonlocal article
        _, kind, holds = stack.pop()
        article -= holds
        if kind:
            kinds.pop()

    for token in _TOKEN.findall(page or ""):
        if token[0] != "<" or len(token) == 1:
            pieces.append(token)
            continue
        if token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if name in _BLOCKS:
            close()
        elif name not in _INLINE and "-" not in name and ":" not in name:  # no element of HTML, so text
            pieces.append(token)
            continue
        if name in _RAW:  # with all it holds, or without an end tag alone
            continue
        if name == "br":
            pieces.append(" ")
        if name in _VOID:
            continue
        if token[1] != "/":
            if stack and (stack[-1][0] == "p" and name in _BLOCKS or stack[-1][0] == name and name in _LOOSE):  # an end tag left out
                leave()
            kind, holds = _markup(name, token, article > 0)
            if not token.endswith("/>") and (name not in _LOOSE or kind or holds):
                if name not in _BLOCKS and (kind or holds):
                    close()
                stack.append((name, kind, holds))
                article += holds
                if kind:
                    kinds.append(kind)
        elif any(x[0] == name for x in stack):
            at = max(k for k, x in enumerate(stack) if x[0] == name)
            if any(kind or holds for _, kind, holds in stack[at:]):
                close()
            while len(stack) > at:
                leave()
    close()
    return found


def _digest(*parts: str) -> bytes:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _parsed(batches):
    """Each page's blocks; ``content`` is the same for pages of one text outside furniture, or of one text where all is furniture."""
    for batch in sized_slices(batches, "html"):
        known: dict[str, tuple] = {}
        rows = []
        for page, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist()):
            if page not in known:
                found = blocks(page)
                free = {kind for _, inside, kind in found if not inside}
                known[page] = (
                    "\n".join(t for t, _, _ in found), bytes(2 * kind + inside for _, inside, kind in found),
                    " ".join(t for t, _, kind in found if not kind) or " ".join(t for t, _, _ in found), 0 in free, sum(1 << k for k in free if 0 < k < NEVER),
                )
            text, codes, content, unnamed, soft = known[page]
            rows.append((text, codes, _digest(host, codes.hex(), text), _digest(content), unnamed, soft))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, ("page_id", "url", "host")), *columns], names=["page_id", "url", "host", "text", "codes", "key", "content", "unnamed", "soft"])


_PARSED = "page_id bigint, url string, host string, text string, codes binary, key binary, content binary, unnamed boolean, soft int"


def _starts(tokens: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys that order suffixes by their first tokens, names of their first 1, 2 ... tokens).

    As many tokens as fit into 64 bits: four, or two of a large vocabulary. Past
    a stream's end there is 0.
    """
    size = int(tokens.max()) + 2
    names, width = [tokens.astype(np.uint64) + np.uint64(1)], 1
    while width < 4 and size ** (2 * width) < 1 << 64:
        last = names[-1]
        after = np.zeros(len(last), dtype=np.uint64)
        after[:-width] = np.where(left[:-width] > width, last[width:], 0)
        names.append(last * np.uint64(size**width) + after)
        width *= 2
    return names[-1], names


def suffix_order(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of each place with the one before) of streams that end at ``ends``.

    Suffixes stop where their stream does. Prefix doubling from the order by the
    first few tokens: ranks by w tokens give ranks by 2 w, and only suffixes
    that still share a rank are sorted again. The names of every width are kept
    and give the LCPs.
    """
    n = len(tokens)
    lcp = np.zeros(n, dtype=np.int64)
    if not n:
        return lcp, lcp
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # tokens to the stream's end
    key, levels = _starts(tokens, left)
    base, width = len(levels) - 1, 1 << (len(levels) - 1)
    order = np.argsort(key)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    while True:
        sizes = np.diff(np.append(heads, n))
        slots = ragged(heads[sizes > 1], sizes[sizes > 1])
        some = order[slots]
        go = left[some] > width
        if not go.any():
            break
        second = np.zeros(len(some), dtype=np.int64)
        second[go] = rank[some[go] + width] + 1
        key = rank[some] * (n + 1) + second
        moved = np.argsort(key)
        some, key = some[moved], key[moved]
        order[slots] = some
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rank = rank.copy()
        rank[some] = np.repeat(slots[at], np.diff(np.append(at, len(some))))
        heads = np.sort(np.concatenate((heads[sizes == 1], slots[at])))
        width *= 2
        levels.append(rank)
    # longer names are equal only where those of the base are
    place = np.arange(1, n)
    a, b = order[:-1].copy(), order[1:].copy()
    deep = np.flatnonzero(levels[base][a] == levels[base][b])
    for k in [*range(len(levels) - 1, base - 1, -1), *range(base - 1, -1, -1)]:
        if k >= base:
            on = deep[(a[deep] < n) & (b[deep] < n)]
        else:
            on = np.flatnonzero((a < n) & (b < n))
        same = on[levels[k][a[on]] == levels[k][b[on]]]
        step = np.minimum(1 << k, left[a[same]])
        lcp[place[same]] += step
        over = (left[a[same]] <= step) | (left[b[same]] <= step)
        a[same], b[same] = np.where(over, n, a[same] + step), np.where(over, n, b[same] + step)
    return order, lcp


def repeated(tokens: np.ndarray, ends: np.ndarray, content: np.ndarray, is_open: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(class, whether it is repeated) of the ``run`` tokens from each place.

    ``content`` has a number for each stream, and ``is_open`` says which windows
    reach outside articles: such windows under two contents make a class
    repeated. A place that has fewer tokens to its stream's end is in a class
    with its equals, and never repeated.
    """
    order, lcp = suffix_order(tokens, ends)
    if not len(order):
        return order, np.zeros(0, dtype=bool)
    number = np.repeat(content, np.diff(ends, prepend=0))[order]
    counts = is_open[order]
    heads = np.flatnonzero(lcp < run)
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.cumsum(lcp < run) - 1
    least = np.minimum.reduceat(np.where(counts, number, len(ends)), heads)
    many = least < np.maximum.reduceat(np.where(counts, number, -1), heads)
    return kind, many[kind]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, where each stream ends, vocabulary) of the tokens of texts."""
    lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64), coded.dictionary


def _runs(places: np.ndarray) -> bytes:
    """Ascending places as packed (first, last) of each run."""
    if not len(places):
        return b""
    cuts = np.flatnonzero(np.diff(places) != 1)
    return np.stack([places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)]], axis=1).astype("<i4").tobytes()


def _marks(text: str, codes: bytes) -> bytes:
    """Packed (first token, token after, kind) of each block of presumed furniture."""
    out, at = [], 0
    for block, code in zip(text.split("\n"), codes):
        n = block.count(" ") + 1
        if 0 < code >> 1 < NEVER:
            out.append((at, at + n, code >> 1))
        at += n
    return np.array(out, dtype="<i4").tobytes()


_FOUND = pa.schema(
    [("id", pa.int64()), ("key", pa.binary()), ("host", pa.string()), ("content", pa.binary()), ("marks", pa.binary()), ("again", pa.binary()),
     ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]
)
_FOUND_DDL = "id bigint, key binary, host string, content binary, marks binary, again binary, high array<bigint>, low array<bigint>, places array<int>"


def _open_tokens(text: str, codes: bytes) -> np.ndarray:
    """Whether each token is outside articles or in furniture."""
    sizes = [block.count(" ") + 1 for block in text.split("\n")]
    return np.repeat(np.array([code != 1 for code in codes], dtype=bool), sizes)


def _group(host: str, rows: dict, split: bool, first_id: int) -> pa.RecordBatch:
    """A group's streams, the windows that repeat in it and, if it isn't the whole host, what to look up in other groups."""
    keys, texts = list(rows), [r[1] for r in rows.values()]
    numbers: dict[bytes, int] = {}
    content = np.array([numbers.setdefault(r[0], len(numbers)) for r in rows.values()])
    codes, ends, vocabulary = _words(texts)
    starts, at = np.concatenate(([0], ends[:-1])), np.arange(len(codes))
    after = np.cumsum(np.concatenate(([0], np.concatenate([_open_tokens(*r[1:]) for r in rows.values()]))))
    whole = np.repeat(ends, ends - starts) - at >= RUN
    is_open = whole & (after[np.minimum(at + RUN, len(codes))] > after[:-1])
    kind, again = repeated(codes, ends, content, is_open)
    asked: list[tuple] = [(None, None, None)] * len(keys)
    if split:
        # windows that repeat here are told of once a class
        first = np.zeros(len(codes), dtype=bool)
        first[np.unique(kind, return_index=True)[1]] = True
        words = vocabulary.to_pylist()
        asked = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            look, tell = (np.flatnonzero(x[a:b]) for x in (is_open & ~again, first & again))
            some = np.concatenate((look, tell)) + a
            digests = b"".join(_digest(host, *(words[c] for c in codes[k : k + RUN])) for k in some.tolist())
            pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
            asked.append((pairs[:, 0].tolist(), pairs[:, 1].tolist(), [*look.tolist(), *[-1] * len(tell)]))
    table = {
        "id": list(range(first_id, first_id + len(keys))), "key": keys, "host": [host] * len(keys), "content": [r[0] for r in rows.values()], "marks": [_marks(r[1], r[2]) for r in rows.values()],
        "again": [_runs(np.flatnonzero(again[a:b])) for a, b in zip(starts, ends)], "high": [x[0] for x in asked], "low": [x[1] for x in asked], "places": [x[2] for x in asked],
    }
    return pa.RecordBatch.from_pydict(table, schema=_FOUND)


def _packs(batches):
    """The distinct streams of each host in a batch, compressed together."""
    for batch in sized_slices(batches, "text"):
        columns = [batch.column(c).to_pylist() for c in ("host", "key", "content", "text", "codes")]
        hosts: dict[str, dict[bytes, tuple]] = {}
        for host, key, *rest in zip(*columns):
            if rest[1]:
                hosts.setdefault(host, {})[key] = (key, *rest)
        rows = []
        for host, streams in hosts.items():
            some, size = [], 0
            for key, stream in sorted(streams.items()):
                some.append(stream)
                size += len(stream[2])
                if size >= PACK_BYTES:
                    rows.append((host, some[0][0], zstandard.compress(pickle.dumps(some), 3)))
                    some, size = [], 0
            if some:
                rows.append((host, some[0][0], zstandard.compress(pickle.dumps(some), 3)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary()))], names=["host", "least", "pack"])


def _arrays(group_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        host, rows, size, split, made = None, {}, 0, True, TaskContext.get().partitionId() << 36
        for batch in batches:
            for h, pack in zip(batch.column("host").to_pylist(), batch.column("pack").to_pylist()):
                if h != host:
                    if rows:
                        yield _group(host, rows, split, made)
                        made += len(rows)
                    # the first host of a partition may have begun in the one before
                    host, rows, size, split = h, {}, 0, host is None
                for key, content, text, codes in pickle.loads(zstandard.decompress(pack)):
                    if key in rows:
                        continue
                    if rows and size + len(text) > group_bytes:
                        yield _group(host, rows, True, made)
                        made += len(rows)
                        rows, size, split = {}, 0, True
                    rows[key] = (content, text, codes)
                    size += len(text)
        if rows:
            yield _group(host, rows, True, made)  # and the last go on in the next

    return run


def _cover(batches):
    """Covered tokens of each stream, and the kinds of presumed furniture that it has and that repeats cover."""
    for batch in batches:
        spans, has, borne = [], [], []
        for runs, places, marks in zip(*(batch.column(c).to_pylist() for c in ("runs", "places", "marks"))):
            pairs = np.concatenate([np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2), np.repeat(np.array(places, dtype="<i4"), 2).reshape(-1, 2)]).astype(np.int64)
            covered = np.unique(ragged(pairs[:, 0], pairs[:, 1] - pairs[:, 0] + RUN))
            spans.append(_runs(covered))
            total, hit = [0] * NEVER, [0] * NEVER
            for a, b, kind in np.frombuffer(marks, "<i4").reshape(-1, 3).tolist():
                total[kind] += b - a
                hit[kind] += int(np.searchsorted(covered, b) - np.searchsorted(covered, a))
            has.append(sum(1 << k for k in range(NEVER) if total[k]))
            borne.append(sum(1 << k for k in range(NEVER) if total[k] and 2 * hit[k] >= total[k]))
        yield pa.RecordBatch.from_arrays([*map(batch.column, ("key", "host", "content")), pa.array(spans, pa.binary()), pa.array(has, pa.int32()), pa.array(borne, pa.int32())], names=["key", "host", "content", "spans", "has", "borne"])


def repeats(parsed: DataFrame) -> DataFrame:
    """(key, host, content, spans, has, borne) of every distinct stream of parsed pages."""
    size = parsed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    packs = parsed.select("host", "key", "content", "text", "codes").mapInArrow(_packs, "host string, least binary, pack binary")
    dealt = packs.repartitionByRange(parts, "host", "least").sortWithinPartitions("host", "least").select("host", "pack")
    found = stage(dealt.mapInArrow(_arrays(GROUP_BYTES), _FOUND_DDL), "page-repeats")
    # a window is named by 128 bits over host and tokens; contents are compared by 64 bits
    asked = found.where("size(places) > 0").select("id", F.xxhash64("content").alias("c"), F.explode(F.arrays_zip("high", "low", "places")).alias("w")).select("id", "c", "w.*")
    shared = asked.groupBy("high", "low").agg(((F.min("c") != F.max("c")) | (F.min("places") < 0) & (F.count("*") > 1)).alias("many")).where("many").select("high", "low")
    more = asked.where("places >= 0").select("high", "low", "id", "places").join(stage(shared, "shared-windows"), ["high", "low"], "left_semi").groupBy("id").agg(F.collect_list("places").alias("place"))
    both = found.select("id", "key", "host", "content", "marks", "again").join(more, "id", "left")
    merged = both.groupBy("key").agg(F.max("host").alias("host"), F.max("content").alias("content"), F.max("marks").alias("marks"), F.collect_list("again").alias("runs"), F.flatten(F.collect_list("place")).alias("places"))
    return stage(merged.mapInArrow(_cover, "key binary, host string, content binary, spans binary, has int, borne int"), "page-cover")


def furniture(cover: DataFrame) -> list[int]:
    """The presumed kinds that the repeats of the whole table bear out.

    Hosts with pages of one content have nothing to say.
    """
    count = lambda c, k: F.sum(F.col(c).bitwiseAND(1 << k) / (1 << k)).alias(f"{c}{k}")
    kinds = range(1, NEVER)
    hosts = cover.groupBy("host").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), *(count(c, k) for c in ("has", "borne") for k in kinds)).where("lo <> hi")
    totals = hosts.agg(*(F.sum(f"{c}{k}").alias(f"{c}{k}") for c in ("has", "borne") for k in kinds)).first()
    return [k for k in kinds if PRIOR + (totals[f"borne{k}"] or 0) >= BORNE_OUT * (PRIOR + (totals[f"has{k}"] or 0))]


def _kept(dropped: list[int]):
    gone = {*dropped, NEVER}

    def run(batches):
        for batch in batches:
            texts = []
            for text, codes, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "codes", "spans"))):
                runs = np.frombuffer(spans or b"", "<i4").reshape(-1, 2).astype(np.int64)
                covered = set(ragged(runs[:, 0], runs[:, 1] - runs[:, 0] + 1).tolist()) if len(runs) else ()
                kept, at = [], 0
                for block, code in zip(text.split("\n"), codes):
                    tokens = block.split(" ") if covered else ()
                    if code >> 1 not in gone:
                        left = block if code & 1 or not covered else " ".join(w for k, w in enumerate(tokens, at) if k not in covered)
                        if left:
                            kept.append(left)
                    at += len(tokens)
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars.

    Null and empty html give an empty text; a null url is its own host; pages
    of a host with one text outside presumed furniture, whatever their ids and
    markup, count once as evidence and each in the result; extra columns are
    ignored; an empty table gives an empty result.
    """
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = plain.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))
    parsed = stage(keyed.mapInArrow(_parsed, _PARSED), "page-blocks")
    cover = repeats(parsed)
    dropped = furniture(cover)
    # pages whose text outside articles is all dropped don't need to know what is covered
    asks = F.col("unnamed") | (F.col("soft").bitwiseAND(~sum(1 << k for k in dropped)) != 0)
    columns = "page_id bigint, url string, text string, n_chars bigint"
    sure = parsed.where(~asks).withColumn("spans", F.lit(None).cast("binary")).mapInArrow(_kept(dropped), columns)
    return sure.unionByName(parsed.where(asks).join(cover.select("key", "spans"), "key", "left").mapInArrow(_kept(dropped), columns))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
