"""Benchmark decontamination with the q-gram lemma.

Texts are normalised: A-Z lower-cased, runs of ASCII characters other than letters and digits become one space.
A document leaks an item if some ``window`` bytes of it, at whatever place of the item (``step`` = 1), or all of an item that
is shorter, occur in the document with at most k edits. With 80 bytes and k = 8 the shortest verbatim passage that counts has
72 bytes, as the 8 that lack are edits; with e edits inside it has 72 + e. A place in a document that is within k edits of
a window of w bytes shares at least ``w - q + 1 - k * q`` of its q-grams with it, on diagonals that differ by
at most k. So the document's q-grams (q = 8: one 64-bit word each, compared exactly) are looked up among those of
the items, and hits are counted in overlapping diagonal bands, 2(k + 1) wide and k + 1 apart, so that one band
holds all hits of a match. What the bound counts are places of the window, so a place hit on several diagonals of a band counts
once, and only where as many of them as the bound asks for lie within one window. Windows that begin within ``SPAN`` bytes are counted together over the stretch they cover; in
bands that reach the bound each of them is counted alone, and those that reach it are verified by banded alignment, with
free ends in the document, neighbours first by the bytes they share, which can need no more edits than the whole.

From ``min_bytes`` = 16 bytes on the bound is at least one, so an item of that size is searched with its edits like any window. A
shorter one is found where its normalised text stands, unchanged, as whole words.

The documents are never shuffled: a block of the benchmark's windows, at most ``block_bytes`` of text by a size check, is
broadcast (its index takes some 60 bytes a byte of it, 256 MB at most, in each Python worker); a larger benchmark is taken block by block over the documents, a stated query set against all rows.

Edge cases: a null or empty text leaks nothing; an item that is null, or empty when normalised, is never found; repeated items are each reported; repeated documents each get their leaks; an empty table on
either side gives no leaks; other columns of the documents are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
CHUNK = 1 << 18
COUNTERS = 21
SPAN = 80                      # starts of windows that are counted together
BASE = 0x9E3779B97F4A7C15      # of the hashes of short items; odd
LEAD = 1 << 20                 # keeps band numbers above zero; more than any window
LEAK = "struct<item_id:bigint,n_windows:int,of_windows:int,edits:int,first_byte:int,last_byte:int>"
PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(PLAIN).split())


def grams(raw: np.ndarray) -> np.ndarray:
    """Every 8 consecutive bytes as one 64-bit number."""
    x = raw.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


def budget(size: int, rate: float) -> tuple[int, int]:
    """Edits allowed for a window and the q-grams that a match must share: the bound stays at least one."""
    k = min(int(rate * size), max(0, (size - Q) // Q))
    return k, size - Q + 1 - k * Q


class Index:
    """Stretches of a block of items, with the windows in them and their q-grams, sorted, and a bit table that rules most others out."""

    def __init__(self, items: list[tuple[int, bytes]], window: int, step: int, rate: float, min_bytes: int, exact: bool = False):
        self.item, self.text, self.starts, self.width, self.of, self.short = [], [], [], [], {}, {}
        for place, (_, text) in enumerate(items):
            t = normalise(text)
            if len(t) < max(min_bytes, Q):
                if exact and t:
                    self.short.setdefault(t, []).append(place)
                    self.of[place] = 1
                continue
            last = max(0, len(t) - window)
            starts = np.array(sorted({*range(0, last, step), last}))
            self.of[place] = len(starts)
            for part in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1):
                self.item.append(place), self.text.append(t[part[0]:part[-1] + window])
                self.starts.append(part - part[0]), self.width.append(min(window, len(t)))
        self.ids = [i for i, _ in items]
        self.bound = np.array([budget(w, rate) for w in self.width], dtype=np.int64).reshape(-1, 2)
        parts = [grams(np.frombuffer(t, dtype=np.uint8)) for t in self.text]
        codes = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int32)
        at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]) if parts else owner
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes)).astype(np.int64)
        self.owner, self.at = owner[order], at[order]
        self.bits = min(28, max(16, int(max(1, len(self.codes)) * 64 - 1).bit_length()))
        self.maybe = np.zeros(1 << self.bits - 3, dtype=np.uint8)
        slot = self._slot(self.codes)
        np.bitwise_or.at(self.maybe, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        self.least = int(self.bound[:, 1].min(initial=1 << 20))
        self.reach = int((self.bound[:, 0] + self.width).max(initial=Q)) - Q
        self.longest = max(map(len, self.short), default=0)
        self.words = max((t.count(b" ") + 1 for t in self.short), default=0)
        self.sizes = np.isin(np.arange(self.longest + 1), list(map(len, self.short)))
        power = np.full(CHUNK + self.longest if self.short else 0, BASE, dtype=np.uint64)
        self.power = np.cumprod(np.append(np.uint64(1), power))
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full_like(power, pow(BASE, -1, 2**64))))
        self.hashes = np.unique(np.array([(np.frombuffer(t, dtype=np.uint8) * self.power[:len(t)]).sum() for t in self.short], dtype=np.uint64))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the bytes and numbers of the window q-grams found there."""
        place, code = [], []
        for s in range(0, len(raw) - Q + 1, CHUNK):
            g = grams(raw[s:s + CHUNK + Q - 1])
            slot = self._slot(g)
            p = np.flatnonzero(self.maybe[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if len(p):
                i = np.searchsorted(self.codes, g[p])
                ok = self.codes[np.minimum(i, len(self.codes) - 1)] == g[p]
                place.append(p[ok] + s), code.append(i[ok])
        if not place:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        place, code = np.concatenate(place), np.concatenate(code)
        # a match holds as many hits as the least bound within the bytes it can take
        run = self.least - 1
        open_ = np.flatnonzero(place[run:] - place[:len(place) - run] <= self.reach) if run < len(place) else np.empty(0, dtype=np.int64)
        turn = np.zeros(len(place) + 1, dtype=np.int32)
        turn[open_] += 1
        turn[open_ + run + 1] -= 1
        keep = np.cumsum(turn[:-1]) > 0
        return place[keep], code[keep]

    def whole(self, raw: np.ndarray, joined: bytes):
        """(first byte, byte after the last, item) wherever a short item stands as whole words."""
        if not self.short:
            return
        border = np.concatenate(([True], (raw == 0x20) | (raw == 0)))          # the bytes end with a border
        first = np.flatnonzero(border[:-1] & ~border[1:])
        end = np.flatnonzero(~border[:-1] & border[1:])
        for c in range(0, len(raw), CHUNK):
            part = raw[c:c + CHUNK + self.longest]
            total = np.append(np.uint64(0), np.cumsum(part * self.power[:len(part)]))
            word = np.arange(*np.searchsorted(first, (c, c + CHUNK)))
            for n in range(self.words):
                word = word[word + n < len(end)]
                word = word[end[word + n] - first[word] <= self.longest]
                w = word[self.sizes[end[word + n] - first[word]]]
                s, e = first[w], end[w + n]
                found = np.isin((total[e - c] - total[s - c]) * self.inverse[s - c], self.hashes)
                for s, e in zip(s[found].tolist(), e[found].tolist()):
                    for item in self.short.get(joined[s:e], ()):
                        yield s, e, item


def align(windows: list[bytes], regions: list[bytes]) -> np.ndarray:
    """Least edits of each window against any part of its region, on diagonals 0 .. len(region) - len(window).

    Row i holds text places i .. i + band; all pairs step together through the windows' bytes.
    """
    w = max(map(len, windows))
    band = max(len(r) - len(p) for p, r in zip(windows, regions))
    band = max(band, 0) + 1
    p = np.zeros((len(windows), w), dtype=np.uint8)
    r = np.full((len(regions), w + band), 255, dtype=np.uint8)        # 255: in no UTF-8 text
    for i, (a, b) in enumerate(zip(windows, regions)):
        p[i, :len(a)] = np.frombuffer(a, dtype=np.uint8)
        r[i, :len(b)] = np.frombuffer(b, dtype=np.uint8)
    size = np.array([len(a) for a in windows])
    d = np.zeros((len(windows), band), dtype=np.int32)
    best = np.full(len(windows), 1 << 20, dtype=np.int32)
    ramp = np.arange(band, dtype=np.int32)
    for i in range(w):
        new = d + (r[:, i:i + band] != p[:, i:i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(new - ramp, axis=1) + ramp
        done = size == i + 1
        if done.any():
            best[done] = d[done].min(axis=1)
    return best


def _region(text: bytes, s: int, e: int) -> bytes:
    """text[s:e], filled up where it reaches beyond the text with a byte that nothing matches."""
    return b"\xff" * max(0, -s) + text[max(0, s):max(0, e)] + b"\xff" * max(0, e - max(len(text), s))


def _aligned(index: Index, clean: list[bytes], begin: np.ndarray, cases: list[tuple]):
    """Each case (stretch, lowest diagonal, any, first, past the last byte) with every text its region meets, and the least edits."""
    k = index.bound[:, 0]
    todo = []
    for case in cases:
        o, lo, _, x, end = case
        s, e = lo + x - int(k[o]), lo + end + 2 * (int(k[o]) + 1) + int(k[o])      # all diagonals that a match here can take
        for d in range(np.searchsorted(begin, max(s, 0), side="right") - 1, np.searchsorted(begin, e)):
            if d < len(clean):
                todo.append((case, d, s - int(begin[d]), e - int(begin[d])))
    for i in range(0, len(todo), 512):
        part = todo[i:i + 512]
        edits = align([index.text[c[0]][c[3]:c[4]] for c, *_ in part], [_region(clean[d], s, e) for _, d, s, e in part])
        for (case, d, _, _), y in zip(part, edits.tolist()):
            yield case, d, y


def _bands(index: Index, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bands, of hits sorted by band and place in the stretch, in which some window's length holds the bound's number of places."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    key, at = key[new], at[new]
    owner = key >> 40
    other = np.arange(len(key)) + index.bound[owner, 1] - 1
    ok = np.flatnonzero(other < len(key))
    other = other[ok]
    ok = ok[(key[other] == key[ok]) & (at[other] - at[ok] <= np.array(index.width, dtype=np.int64)[owner[ok]] - Q)]
    return np.unique(key[ok])


def find(index: Index, texts: list[bytes]) -> list[list[tuple]]:
    """For each text its leaks (item, windows found, windows, edits, first byte, last byte)."""
    out: list[dict] = [{} for _ in texts]
    if not index.of:
        return [[] for _ in texts]
    clean = [normalise(t) for t in texts]
    begin = np.cumsum([0] + [len(t) + 1 for t in clean])
    joined = b"\x00".join(clean) + b"\x00"
    raw = np.frombuffer(joined, dtype=np.uint8)

    def add(d: int, item: int, which: int, x: int, lo: int, hi: int) -> None:
        was = out[d].setdefault(item, [set(), x, lo, hi])
        was[0].add(which)
        was[1:] = [min(was[1], x), min(was[2], lo), max(was[3], hi)]

    for s, e, item in index.whole(raw, joined):
        d = int(np.searchsorted(begin, s, side="right")) - 1
        add(d, item, 0, 0, s - int(begin[d]), e - int(begin[d]))
    place, code = index.hits(raw)
    n = index.first[code + 1] - index.first[code]
    slot = np.arange(n.sum()) + np.repeat(index.first[code] - np.cumsum(n) + n, n)
    owner = index.owner[slot]
    at = index.at[slot].astype(np.int64)
    diagonal = np.repeat(place, n) - at
    # a band is named by its stretch and number; places in the joined texts tell documents apart as well
    low = (diagonal + LEAD) // (index.bound[:, 0] + 1)[owner]
    key = (owner.astype(np.int64) << 40) | low
    # counts of hashed bands rule out nearly all bands, none that reaches its bound
    bucket = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - COUNTERS)).astype(np.int64)
    before = (((key - 1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - COUNTERS)).astype(np.int64)
    count = np.bincount(bucket, minlength=1 << COUNTERS) + np.bincount(before, minlength=1 << COUNTERS)
    bound = index.bound[:, 1][owner]
    here, also = np.flatnonzero(count[bucket] >= bound), np.flatnonzero(count[before] >= bound)
    hit = np.concatenate((here, also))
    key = np.concatenate((key[here], key[also] - 1))
    order = np.lexsort((at[hit], key))
    hit, key = hit[order], key[order]
    bands = _bands(index, key, at[hit])
    owner, first, last = bands >> 40, np.searchsorted(key, bands), np.searchsorted(key, bands, side="right")
    cases = []
    for o, band, f, c in zip(owner.tolist(), (bands & ((1 << 40) - 1)).tolist(), first.tolist(), (last - first).tolist()):
        k, least = index.bound[o].tolist()
        lo, size, text, mine = band * (k + 1) - LEAD, index.width[o], index.text[o], hit[f:f + c]
        x = index.starts[o]
        a = np.unique(at[mine])
        x = x[np.searchsorted(a, x + size - Q + 1) - np.searchsorted(a, x) >= least]
        if not len(x):
            continue
        ways, votes = np.unique(diagonal[mine], return_counts=True)
        most = int(ways[votes.argmax()])
        left = []
        for x in x.tolist():
            place = most + x
            if place >= 0 and joined[place:place + size] == text[x:x + size]:      # unchanged: no need to align
                d = int(np.searchsorted(begin, place, side="right")) - 1
                b = int(begin[d])
                add(d, index.item[o], (o, x), 0, max(0, lo + x - k - b), min(len(clean[d]), lo + x + 3 * k + 2 + size - b))
            else:
                left.append(x)
        while left:                                          # neighbours are tried by the bytes they share first
            some = [x for x in left if x - left[0] < size // 3]
            cases.append((o, lo, some, some[-1], some[0] + size))
            left = left[len(some):]
    likely = []
    for (o, lo, some, _, _), d, edits in _aligned(index, clean, begin, cases):
        if edits <= index.bound[o, 0]:
            likely += [(o, lo, d, x, x + index.width[o]) for x in some]
    for (o, lo, of, x, _), d, edits in _aligned(index, clean, begin, likely):
        k, b = int(index.bound[o, 0]), int(begin[d])
        if d == of and edits <= k:
            add(d, index.item[o], (o, x), edits, max(0, lo + x - k - b), min(len(clean[d]), lo + x + 3 * k + 2 + index.width[o] - b))
    return [[(index.ids[i], len(v[0]), index.of[i], v[1], v[2], v[3]) for i, v in sorted(x.items())] for x in out]


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 80, step: int = 1, rate: float = 0.1, min_bytes: int = 16,
          text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` with an array column ``leaks``: the items found, with how many of their windows, the fewest edits of
    one, and the bytes of the normalised text between which they lie."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    sc, own, out = docs.sparkSession.sparkContext, docs.columns, docs
    parts = []
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()     # at most a block, by hash
        index = sc.broadcast(Index([(r.item, r.text.encode()) for r in sorted(part, key=lambda r: (r.item is None, r.item, r.text))],
                                   window, step, rate, min_bytes, exact=True))
        out = _search(out, own, parts, text_col, f"__leaks{b}", index)
        parts.append(f"__leaks{b}")
    return out.select(*[F.col(f"`{c}`") for c in own], F.concat(*parts).alias("leaks"))


def _search(df: DataFrame, own: list[str], parts: list[str], text_col: str, name: str, index) -> DataFrame:
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text_col}`").alias("text"), *parts)

    def search(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            found, at = [], 0
            while at < len(texts):                  # 2 MB of text at a time, or one long text
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 2_000_000):
                    size, end = size + len(texts[end]), end + 1
                found += find(index.value, texts[at:end])
                at = end
            kind = pa.list_(pa.struct([("item_id", pa.int64()), *((c, pa.int32()) for c in (
                "n_windows", "of_windows", "edits", "first_byte", "last_byte"))]))
            names = [f.name for f in kind.value_type]
            leaks = pa.array([[dict(zip(names, x)) for x in y] for y in found], kind)
            yield pa.record_batch([b.column(0), *b.columns[2:], leaks], names=["row", *parts, name])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{p} array<{LEAK}>" for p in [*parts, name])
    return rows.mapInArrow(search, schema).select("row.*", *parts, name)
