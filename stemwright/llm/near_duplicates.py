"""Near-duplicate texts by an exact set-similarity join of their shingles.

Each text's different shingles stand in one order for all texts, the rarest first. Two texts at or above the similarity
have their first common shingle early in both (prefix filter), at places their sizes bound; the same holds for
the second, third and so on, so a list too long to compare is split by the next common shingle. No pair is
left out: lists are only split, and a pair is dropped only where its sizes, the places of the common shingle or its sketches
(bits that each shingle flips) prove it out of reach. What stands before the first common shingle is in one text alone, so
sketches of the rest are compared, with what that leaves of the shingles that may differ: the later the place, the fewer
bits are enough. The sets are written once and every task reads them for its share of the shingles, so neither sets nor
pairs go through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemwright.session import cut

COUNTERS = 1 << 17  # of the frequency sketch
BITS = 512  # of a text's sketch
WIDTHS = (64, 128, 256, BITS)  # to which sketches are folded for products of matrices
BATCH = 1 << 14  # most texts whose shingles are sorted at once
POSTINGS = 400_000  # about as many (shingle, text) a task takes
FEW = 64  # lists of no more texts are compared by pairs, longer ones by products
MANY = 1 << 14  # longer lists are split by the next common shingle
STEP = 256  # rows of a product
TILE = 1024  # most columns of a product
BEFORE = 1 << 21  # about as many tokens are taken out of sketches, and bits made, at once
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_ALNUM = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def normalised(text: Column) -> Column:
    """The words (runs of a-z and 0-9 of the lower-cased text) with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many each text has; the words are those of normalised()."""
    raw = [t.lower().encode("utf-8", "ignore") + b" " if t else b" " for t in texts]
    chars = np.frombuffer(b"".join(raw).translate(_ALNUM), dtype=np.uint8)
    within = chars != 32
    edge = np.flatnonzero(within[1:] != within[:-1]) + 1
    if len(within) and within[0]:
        edge = np.concatenate([[0], edge])
    begin, size = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), counts
    first = np.cumsum(size) - size
    power = np.full(int(size.max()), _M3, dtype=np.uint64)
    power = np.cumprod(power)
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = np.add.reduceat(chars[within] * power[place], first)
    return _mix(value ^ _mix(size.astype(np.uint64))), counts


def text_hashes(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's words in their order."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(words * _M2) * _odd_powers(lengths), dtype=np.uint64)])
    ends = np.cumsum(lengths)
    return _mix((sums[ends] - sums[ends - lengths]) ^ _mix(lengths.astype(np.uint64))).view(np.int64)


def _odd_powers(lengths: np.ndarray) -> np.ndarray:
    """For each word its place in its text as a power of an odd number."""
    most = int(lengths.max()) if len(lengths) else 0
    power = np.cumprod(np.full(most, _M1, dtype=np.uint64))
    return power[np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)]


def only_texts(words: np.ndarray, lengths: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and lengths of the texts kept (a mask)."""
    return words[np.repeat(keep, lengths)], lengths[keep]


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words and the text each belongs to; texts shorter than n have none."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = ends[doc] - np.arange(len(words))
    code = words.copy()
    for i in range(1, n):
        code[: len(words) - i] = _mix(code[: len(words) - i] * _M3 + words[i:])
    keep = left >= n
    return code[keep], doc[keep]


def _slots(token: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each token (32 bits of a shingle's hash)."""
    return (_mix(token.astype(np.uint64) * np.uint64(3)) % np.uint64(counters)).astype(np.int64)


def _bit(token: np.ndarray, width: int) -> np.ndarray:
    """The bit that each token flips in a sketch of `width` bits, a power of two."""
    return token & np.uint32(width - 1)


def _tokens(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(32)).astype(np.uint32)


class FirstSeen:
    """Which texts a task meets for the first time, among the last `most` of them at least."""

    def __init__(self, most: int = 500_000):
        self.most, self.seen = most, set()

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen.clear()
        new = np.zeros(len(hashes), dtype=bool)
        every = hashes.tolist()
        some = set(every)
        if len(some) == len(every) and self.seen.isdisjoint(some):
            self.seen |= some
            return ~new
        for i, h in enumerate(every):
            if h not in self.seen:
                self.seen.add(h)
                new[i] = True
        return new


def ranks(counts: np.ndarray) -> np.ndarray:
    """For each counter 18 bits that grow with its count."""
    return (np.log2(np.maximum(counts[:-1], 1)) * 4096).astype(np.uint64)


def ordered_sets(words: np.ndarray, lengths: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sizes, sketches): the different tokens of each text by rank and value, and BITS bits of each text; at most BATCH texts."""
    code, doc = shingle_hashes(words, lengths, n)
    token = _tokens(code)
    key = np.sort((doc.astype(np.uint64) << np.uint64(50)) | (rank[_slots(token, len(rank))] << np.uint64(32)) | token)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    token, doc = key.astype(np.uint32), (key >> np.uint64(50)).astype(np.int64)
    flips = np.bincount(doc * BITS + _bit(token, BITS), minlength=len(lengths) * BITS).astype(np.uint8) & 1
    return token, np.bincount(doc, minlength=len(lengths)), np.packbits(flips.reshape(-1, BITS), axis=1)


def _set_rows(texts: DataFrame, counts: np.ndarray, n: int) -> DataFrame:
    """The written (h, s, k): tokens in order and sketch of every text, once for the copies a task meets."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = FirstSeen()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                words, lengths = word_hashes(whole.column("text").slice(at, BATCH).to_pylist())
                h = text_hashes(words, lengths)
                keep = new(h) & (lengths >= n)
                if keep.any():
                    token, sizes, bits = ordered_sets(*only_texts(words, lengths, keep), shared.value, n)
                    ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
                    sets = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(token)])
                    every = pa.py_buffer((np.arange(len(sizes) + 1) * (BITS // 8)).astype(np.int32))
                    sketch = pa.Array.from_buffers(pa.binary(), len(sizes), [None, every, pa.py_buffer(bits)])
                    yield pa.RecordBatch.from_arrays([pa.array(h[keep]), sets, sketch], names=["h", "s", "k"])

    return cut(texts.select("text").mapInArrow(run, "h long, s binary, k binary"), "text-sets")


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _true_places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of a mask with few true values, eight at a time."""
    whole = len(mask) & ~7
    eights = np.flatnonzero(mask[:whole].view(np.uint64))
    some = (8 * eights[:, None] + np.arange(8))[mask[:whole].reshape(-1, 8)[eights]]
    return np.concatenate([some, whole + np.flatnonzero(mask[whole:])])


def _bytes_of(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many each row has) of a binary column without NULL."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _longs_of(column: pa.Array) -> np.ndarray:
    """The values of a 64-bit column without NULL."""
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column)]


class Lists:
    """The texts that have one of a part's tokens in their prefix, and the pairs among them."""

    def __init__(self, files: list[str], part: int, parts: int, similarity: float):
        self.least = similarity
        self.apart = (1 - similarity) / (1 + similarity)  # of the sum of two sizes at most so many are in one text alone
        low, high = (np.uint32(-(-(part + i) * 2**32 // parts) - i) for i in (0, 1))  # of the part's tokens
        new, held, count = FirstSeen(1 << 40), [], 0
        for uri in files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=BATCH, columns=["h", "s", "k"]):
                    token, size = _bytes_of(batch.column("s"), np.uint32)
                    begin, early = np.cumsum(size) - size, self.prefix(size)
                    mine = _true_places(token - low <= high - low)
                    text = np.searchsorted(begin, mine, side="right") - 1
                    good = mine - begin[text] < early[text]
                    mine, text = mine[good], text[good]
                    some = np.zeros(len(size), dtype=bool)
                    some[text] = True
                    at = np.flatnonzero(some)
                    h = _longs_of(batch.column("h"))[at]
                    some[at] = first = new(h)  # copies that several tasks wrote
                    good, at = some[text], at[first]
                    mine, text = mine[good], text[good]
                    number = np.cumsum(some) - 1 + count
                    bits = _bytes_of(batch.column("k"), np.uint64)[0].reshape(-1, BITS // 64)
                    sets = token if some.all() else token[np.repeat(some, size)]
                    held.append((h[first], size[at], sets, bits[at], token[mine], number[text], mine - begin[text]))
                    count += int(some.sum())
        if not count:
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros((0, BITS // 64), np.uint64), *[np.zeros(0, np.int64)] * 3)]
        self.h, self.size, self.token, self.bits, *postings = (np.concatenate(x) for x in zip(*held))
        self.size = self.size.astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.postings = postings
        self.room = np.empty(STEP * TILE, dtype=np.float32)

    def prefix(self, size: np.ndarray, depth: int = 0) -> np.ndarray:
        """How many tokens can be the first common one (depth 0), the second and so on, with a partner of any size."""
        return np.minimum(size, size - np.ceil(self.least * size - 1e-9).astype(np.int64) + 1 + depth)

    def meet(self, token: np.ndarray, text: np.ndarray, place: np.ndarray, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts (x, y) of the pairs with a common token at these places, as their common one number depth + 1, unless proved out of reach."""
        order = np.sort((token.astype(np.uint64) << np.uint64(32)) | np.arange(len(token), dtype=np.uint64)).astype(np.uint32)
        token, text, place = token[order], text[order], place[order]
        size = self.size[text]
        # The overlap is depth plus the tokens from here at most, and s / (1 + s) of both sizes at least.
        reach = np.floor((1 + self.least) / self.least * (size - place + depth) - size + 1e-6).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))[: len(token)]
        long = np.diff(np.append(first, len(token)))
        few = np.repeat(long <= FEW, long)
        run, who, far = np.repeat(np.arange(len(long)), long)[few], text[few], reach[few]
        for i, j in _equal_pairs(run):
            x, y = who[i], who[j]
            good = (self.size[y] <= far[i]) & (self.size[x] <= far[j])
            yield x[good], y[good]
        for begin, end in zip(first[long > FEW].tolist(), (first + long)[long > FEW].tolist()):
            if end - begin <= MANY:
                yield from self.products(text[begin:end], place[begin:end], reach[begin:end], depth)
            else:
                yield from self.split(text[begin:end], place[begin:end], reach[begin:end], depth + 1)

    def split(self, text: np.ndarray, place: np.ndarray, reach: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a long list by their next common token, if that takes at most half the work; texts so small that they need none are compared with all."""
        last = np.ceil(self.least * self.size[text] - 1e-9) <= depth
        whole = text, place, reach, depth - 1
        text, place = text[~last], place[~last]
        more = np.maximum(0, self.prefix(self.size[text], depth) - place - 1)
        who = np.repeat(text, more)
        then = np.repeat(place + 1, more) + _steps(more)
        token = self.token[self.begin[who] + then]
        long = np.unique(token, return_counts=True)[1]
        # A list takes as long as some pairs to set up, and each text in it as long as some.
        work = (long**2).sum() + MANY // 16 * long.sum() + (MANY // 24) ** 2 * (long > FEW).sum()
        if 2 * work > len(text) ** 2:  # else many near-copies would be split again and again
            yield from self.products(*whole)
            return
        if last.any():
            yield from self.products(*whole, last)
        yield from self.meet(token, who, then, depth)

    def products(self, text: np.ndarray, place: np.ndarray, reach: np.ndarray, depth: int, last: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a list by matrix products; last: a mask, of which one text of a pair must be."""
        size = self.size[text]
        small = reach >= size  # may be the smaller text of a pair
        if not small.any():
            return
        some = np.flatnonzero(reach >= size[small].min())
        order = some[np.argsort(size[some], kind="stable")]
        text, place, reach, size, small = text[order], place[order], reach[order], size[order], np.flatnonzero(small[order])
        last = None if last is None else last[order]
        # Of the tokens in one text alone, at most `apart` of both sizes, each text has place - depth before here.
        free = self.apart * size - (place - depth)
        width = self._width(size - place, free)
        least_product = width - 2.1 - 1e-6 * np.abs(free).max()
        whole = len(text) <= MANY
        for to in range(0, len(text), MANY):
            right = self._signs(text[to : to + MANY], place[to : to + MANY], free[to : to + MANY], width)
            for at in range(0, len(small), STEP):
                a = small[at : at + STEP]
                least, most = size[a[0]], reach[a].max()
                begin, end = (np.searchsorted(size[to : to + MANY], v, side) for v, side in ((least, "left"), (most, "right")))
                b = begin + np.flatnonzero(reach[to + begin : to + end] >= least)
                if not len(b):
                    continue
                left = right[a] if whole else self._signs(text[a], place[a], free[a], width)
                left[:, -2:] = left[:, :-3:-1]  # what a text may differ by stands against a one of the other
                for tile in range(0, len(b), TILE):
                    c = b[tile : tile + TILE]
                    product = np.matmul(left, right[c].T, out=self.room[: len(a) * len(c)].reshape(len(a), len(c)))
                    i, j = np.divmod(_true_places(product.ravel() >= least_product), len(c))
                    i, j = a[i], to + c[j]
                    good = (i != j) & (size[j] <= reach[i]) & (size[i] <= reach[j])
                    if last is not None:
                        good &= last[i] | last[j]
                    yield text[i[good]], text[j[good]]

    @staticmethod
    def _width(rest: np.ndarray, free: np.ndarray) -> int:
        """The least width at which the sketches of two average texts of a list, most of their rests different, are out of reach."""
        differ, may = 1.7 * rest.mean(), 2 * free.mean()
        for width in WIDTHS[:-1]:
            if width / 2 * (1 - np.exp(-2 * differ / width)) - 1.6 * width**0.5 >= may:
                return width
        return BITS

    def _signs(self, text: np.ndarray, place: np.ndarray, free: np.ndarray, width: int) -> np.ndarray:
        """Rows whose products are width - 2, less two for each bit but the last two in which the texts' sketches from these places on differ, plus what the texts may differ by."""
        if len(text) > 1 and max(place.sum(), width * len(text)) > BEFORE:
            return np.concatenate([self._signs(text[x], place[x], free[x], width) for x in (slice(len(text) // 2), slice(len(text) // 2, None))])
        folded = self.bits[text]
        while (half := folded.shape[1] // 2) >= width // 64:
            folded = folded[:, :half] ^ folded[:, half:]
        flips = np.unpackbits(folded.view(np.uint8), axis=1)
        before = self.token[np.repeat(self.begin[text], place) + _steps(place)]
        row = np.repeat(np.arange(len(text)) * width, place)
        flips ^= np.bincount(row + _bit(before, width), minlength=flips.size).astype(np.uint8).reshape(flips.shape) & 1
        out = 1 - 2 * flips.astype(np.float32)
        out[:, -2], out[:, -1] = 1, 2 * free
        return out

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs whose whole sketches are within reach; each token of one text alone flips one bit at most."""
        flips = np.bitwise_count(self.bits[x] ^ self.bits[y]).astype(np.float32) @ np.ones(BITS // 64, dtype=np.float32)
        return flips <= self.apart * (self.size[x] + self.size[y]) + 0.01

    def jaccard(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The similarity of each pair."""
        parts = []
        for side in (x, y):
            k = self.size[side]
            number = np.repeat(np.arange(len(side), dtype=np.uint64), k)
            parts.append((number << np.uint64(32)) | self.token[np.repeat(self.begin[side], k) + _steps(k)])
        both = np.sort(np.concatenate(parts))
        shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(x))
        return shared / (self.size[x] + self.size[y] - shared)

    def pairs(self, most: int = 20_000) -> Iterator[pa.RecordBatch]:
        """(h_a < h_b, jaccard) at or above the similarity; a pair may come more than once."""
        held: list[np.ndarray] = []

        def taken() -> Iterator[pa.RecordBatch]:
            every = np.unique(np.concatenate(held))
            held.clear()
            for at in range(0, len(every), most):
                some = every[at : at + most]
                x, y = some >> 32, some & 0xFFFFFFFF
                jaccard = self.jaccard(x, y)
                good = jaccard >= self.least
                a, b = self.h[x[good]], self.h[y[good]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(jaccard[good])], names=["h_a", "h_b", "jaccard"])

        for x, y in self.meet(*self.postings):
            if len(x):
                good = self.near(x, y)
                if good.any():
                    x, y = x[good].astype(np.int64), y[good].astype(np.int64)
                    held.append((np.minimum(x, y) << 32) | np.maximum(x, y))
                    if sum(map(len, held)) >= 5 * most:
                        yield from taken()
        if held:
            yield from taken()


def _equal_pairs(key: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of equal values in a sorted array, at most about `most` at a time."""
    if len(key) < 2:
        return
    last = np.searchsorted(key, key, side="right")  # behind the run each place is in
    rest = last - np.arange(len(key)) - 1  # partners after each place
    some = np.flatnonzero(rest)
    start = 0
    while start < len(some):
        sums = np.cumsum(rest[some[start:]][:most])
        stop = start + max(1, int(np.searchsorted(sums, most, side="right")))
        at = some[start:stop]
        left = np.repeat(at, rest[at])
        step = np.arange(len(left)) - np.repeat(np.cumsum(rest[at]) - rest[at], rest[at])
        yield left, left + 1 + step
        start = stop


def text_classes(texts: DataFrame, carry: list[str], n: int, counters: int = COUNTERS) -> tuple[DataFrame, np.ndarray]:
    """The written (row_id, carried columns, h) of texts of n words or more, and shingle frequencies.

    Copies share h. The frequencies are a sketch of fixed size over all texts: how often the shingles of each counter
    occur, the number of texts last; tasks count in arrays and leave out the copies they have met.
    """
    names, numbers = ["row_id", *carry], ["h"]
    schema = T.StructType([*texts.select(*names).schema.fields, *(T.StructField(c, T.LongType()) for c in [*numbers, "slot", "n"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, new, types = np.zeros(counters + 1, dtype=np.int64), FirstSeen(), None
        for batch in batches:
            types = [batch.column(c).type for c in names]
            words, lengths = word_hashes(batch.column("text").to_pylist())
            keep = lengths >= n
            if keep.any():
                words, lengths = only_texts(words, lengths, keep)
                hashes, (code, doc) = text_hashes(words, lengths), shingle_hashes(words, lengths, n)
                first = new(hashes)
                counts[:-1] += np.bincount(_slots(_tokens(code[first[doc]]), counters), minlength=counters)
                counts[-1] += first.sum()
                kept, none = batch.filter(pa.array(keep)), pa.nulls(len(lengths), pa.int64())
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(hashes), none, none], names=[*names, *numbers, "slot", "n"])
        used = np.flatnonzero(counts)
        if len(used):
            blank = [*(pa.nulls(len(used), t) for t in types), *(pa.nulls(len(used), pa.int64()) for _ in numbers)]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(used), pa.array(counts[used])], names=[*names, *numbers, "slot", "n"])

    both = cut(texts.select(*names, "text").mapInArrow(run, schema), "text-classes")
    total = np.zeros(counters + 1, dtype=np.int64)
    for slot, k in both.filter("slot is not null").groupBy("slot").agg(F.sum("n")).collect():  # at most counters + 1 rows
        total[slot] = k
    return both.filter("h is not null").select(*names, *numbers), total


def similar_texts(classes: DataFrame, counts: np.ndarray, texts: DataFrame, similarity: float = 0.5, n: int = 3) -> DataFrame:
    """All pairs (h_a < h_b, jaccard) of different texts whose shingle sets have at least the given similarity.

    texts: (row_id, text); classes, counts: text_classes() of them. Copies share h and count once; two texts with
    equal 64-bit h would count as copies. The counts set the order of shingles only, on which the pairs don't depend.
    Shingles are compared by 32 bits of their hashes: in about one pair of 100,000 two of them coincide,
    which moves the similarity by less than a hundredth. NULL, empty and shorter texts are in no pair; an empty table gives none.
    """
    spark = texts.sparkSession
    files = _set_rows(texts, counts, n).inputFiles()
    parts = max(2 * spark.sparkContext.defaultParallelism, int(counts[-1]) * 55 // POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                yield from Lists(files, part, parts, similarity).pairs()

    found = spark.range(0, parts, 1, parts).mapInArrow(run, "h_a long, h_b long, jaccard double")
    return cut(found.dropDuplicates(["h_a", "h_b"]), "text-links")


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(h, component): the smallest h reachable, by label passing with pointer jumping; nodes (h), edges (h_a, h_b).

    Labels stay distributed; each round ends in a table of the shared folder. Raises if `rounds` don't suffice.
    """
    both = cut(edges.select("h_a", "h_b").union(edges.select("h_b", "h_a")), "cc-edges")
    labels = cut(nodes.select("h").distinct().withColumn("component", F.col("h")), "cc-labels")
    for _ in range(rounds):
        least = (
            both.join(labels, both.h_b == labels.h).groupBy("h_a").agg(F.min("component").alias("seen"))
        )
        hooked = labels.join(least, labels.h == least.h_a, "left").select(
            "h", F.col("component").alias("old"), F.least("component", F.coalesce("seen", "component")).alias("near")
        )
        # One jump: a label takes the label of the node it names.
        names = hooked.select(F.col("h").alias("name"), F.col("near").alias("further"))
        step = cut(
            hooked.join(names, hooked.near == names.name).select(
                "h", "old", F.least("near", "further").alias("component")
            ),
            "cc-labels",
        )
        labels = step.select("h", "component")
        if step.filter("component != old").isEmpty():
            return labels
    raise RuntimeError(f"components need more than {rounds} rounds")
