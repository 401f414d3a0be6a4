"""Alike sets of two blocks of sets, in arrays: the work of one task of the set join.

A block holds its sets as inverted lists and a parity sketch of each set. Two blocks meet on the shingles both have,
ordered by the product of their frequencies in the two blocks (any order that holds for both sides of a pair will do);
a set's head is what must hold one shared shingle if the pair is alike. Nothing is left out but by bounds that hold for
every alike pair, and what remains is compared on the whole sets.
"""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq

BITS = 1024  # of a sketch
CHUNK = 1 << 21  # pairs looked at together
MOST = 1 << 16  # sets of a block: their numbers take 16 bits of a key


class Block(NamedTuple):
    grams: np.ndarray  # distinct, ascending
    start: np.ndarray  # of each gram's list in ids; one more than grams
    ids: np.ndarray  # sets of each list, ascending, in 16 bits; sets are numbered by size
    n: np.ndarray  # shingles of each set
    set_id: np.ndarray
    sketch: np.ndarray  # bit k of a set: parity of the number of its shingles of class k


class Side(NamedTuple):
    """A block's entries for the shingles that the other block has too, by (rank, set)."""

    block: Block
    rank: np.ndarray
    ids: np.ndarray
    pos: np.ndarray  # place among the set's shared shingles
    m: np.ndarray  # shared shingles of each set
    forward: np.ndarray  # set * ranks + rank, ascending
    first: np.ndarray  # of each set in forward
    ranks: int


def read(files: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set ids, sizes, shingles one set after the other) of the rows marked in each file's bitmap."""
    ids, sizes, values = [], [], []
    for uri, marks in files:
        at = urlparse(uri)
        fs, path = (pafs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else pafs.FileSystem.from_uri(uri)
        t = pq.ParquetFile(fs.open_input_file(path)).read(columns=["set_id", "grams"])
        keep = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little")[: t.num_rows])
        t = t.take(keep) if len(keep) < t.num_rows else t
        lists = t.column("grams").combine_chunks()
        ids.append(t.column("set_id").to_numpy())
        sizes.append(lists.value_lengths().to_numpy(zero_copy_only=False))
        values.append(lists.flatten().to_numpy())
    return np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(values)


def block(set_id: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> Block:
    assert len(set_id) <= MOST
    by_size = np.argsort(sizes, kind="stable")
    number = np.empty(len(sizes), np.int64)
    number[by_size] = np.arange(len(sizes))
    owner = np.repeat(number, sizes)
    sketch = np.zeros((len(sizes), BITS // 64), np.uint64)
    bit = values & (BITS - 1)
    np.bitwise_xor.at(sketch.reshape(-1), owner * (BITS // 64) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    order = np.argsort(values)
    values = values[order]
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    lists = np.sort(((np.cumsum(new) - 1) << 16) | owner[order])  # the sets of a list in ascending order
    start = np.append(np.flatnonzero(new), len(values))
    return Block(values[new], start, lists.astype(np.uint16), sizes[by_size], set_id[by_size], sketch)


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one run after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _side(b: Block, shared: np.ndarray) -> Side:
    """``shared``: places of the shared shingles, in the order of their ranks."""
    count = b.start[shared + 1] - b.start[shared]
    short, rank = b.ids[spans(b.start[shared], count)], np.repeat(np.arange(len(shared)), count)
    m = np.bincount(short, minlength=len(b.n))
    first = np.append(0, np.cumsum(m))
    order, ids = np.argsort(short, kind="stable"), short.astype(np.int64)
    pos = np.empty(len(ids), np.int64)
    pos[order] = np.arange(len(ids)) - np.repeat(first[:-1], m)
    ranks = max(len(shared), 1)
    return Side(b, rank, ids, pos, m, ids[order] * ranks + rank[order], first, ranks)


def _up(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def alike(a: Block, b: Block, threshold: float, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set id of the smaller, of the larger, shingles in common, in either) of every alike pair of a set of a and one of b;
    of every pair of two sets of a if b is a."""
    if a is b:
        places = np.flatnonzero(np.diff(a.start) > 1)
        places = places[np.argsort(np.diff(a.start)[places], kind="stable")]
        own = _side(a, places)
        found = [_met(own, own, np.arange(len(a.n)) + 1, threshold, chunk)]
    else:
        _, i, j = np.intersect1d(a.grams, b.grams, assume_unique=True, return_indices=True)
        order = np.argsort(np.diff(a.start)[i] * np.diff(b.start)[j], kind="stable")
        x, y = _side(a, i[order]), _side(b, j[order])
        found = [  # a pair of equal sizes is met once
            _met(x, y, np.searchsorted(b.n, a.n, "left"), threshold, chunk),
            _met(y, x, np.searchsorted(a.n, b.n, "right"), threshold, chunk),
        ]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _met(small: Side, large: Side, low: np.ndarray, threshold: float, chunk: int):
    """Alike pairs whose larger set has a number of at least ``low`` of the smaller one."""
    ns, nl = small.block.n, large.block.n
    high = np.maximum(low, np.searchsorted(nl, np.floor(ns / threshold + 1e-9), "right"))
    least = np.maximum(1, _up(ns * (2 * threshold / (1 + threshold))))
    head = np.where(small.m >= least, ns - least + 1 - (ns - small.m), 0)  # shingles that the other block hasn't stand before all others
    head_large = np.where(large.m >= _up(nl * threshold), nl - np.maximum(1, _up(nl * threshold)) + 1 - (nl - large.m), 0)
    s, t = np.flatnonzero(small.pos < head[small.ids]), np.flatnonzero(large.pos < head_large[large.ids])
    keys = (large.rank[t] << 16) + large.ids[t]
    begin = np.searchsorted(keys, (small.rank[s] << 16) + low[small.ids[s]])
    count = np.searchsorted(keys, (small.rank[s] << 16) + high[small.ids[s]]) - begin
    # a set whose lists hold more than there are sets of fitting size meets each of these once instead
    heavy = np.bincount(small.ids[s], weights=count, minlength=len(ns)) > high - low
    light = ~heavy[small.ids[s]] & (count > 0)
    s, begin, count = s[light], begin[light], count[light]
    kept = []
    for at in _chunks(count, chunk):
        i, j = np.repeat(s[at], count[at]), t[spans(begin[at], count[at])]
        x, y = small.ids[i], large.ids[j]
        p, q = small.pos[i], large.pos[j]
        most = np.minimum(p, q) + np.minimum(small.m[x] - p, large.m[y] - q)
        kept.append(_sketched(small, large, x, y, most >= _least(ns[x] + nl[y], threshold), threshold))
    each = np.flatnonzero(heavy)
    for at in _chunks((high - low)[each], chunk):
        x = np.repeat(each[at], (high - low)[each[at]])
        y = spans(low[each[at]], (high - low)[each[at]])
        kept.append(_sketched(small, large, x, y, np.minimum(small.m[x], large.m[y]) >= _least(ns[x] + nl[y], threshold), threshold))
    return _whole(small, large, np.unique(np.concatenate([np.zeros(0, np.int64), *kept])), threshold, chunk)


def _least(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """What two sets of these sizes together must have in common."""
    return np.maximum(1, _up(sizes * (threshold / (1 + threshold))))


def _chunks(count: np.ndarray, chunk: int):
    """Slices of about ``chunk`` in all."""
    ends = np.cumsum(count)
    cuts = np.searchsorted(ends, np.arange(chunk, ends[-1], chunk)) if len(ends) else []
    edges = np.unique([0, *cuts, len(ends)])
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _sketched(small: Side, large: Side, x, y, may: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of the pairs that may be alike: sketches differ in no more bits than the sets in shingles."""
    x, y = x[may], y[may]
    apart = np.zeros(len(x), np.int64)
    for k in range(BITS // 64):
        apart += np.bitwise_count(small.block.sketch[x, k] ^ large.block.sketch[y, k])
    sizes = small.block.n[x] + large.block.n[y]
    near = apart <= sizes - 2 * _least(sizes, threshold)
    return np.unique((x[near] << 16) | y[near])


def _whole(small: Side, large: Side, pairs: np.ndarray, threshold: float, chunk: int):
    """The pairs that are alike on the whole sets."""
    x, y = pairs >> 16, pairs & (MOST - 1)
    common = np.zeros(len(pairs), np.int64)
    for at in _chunks(small.m[x], chunk):
        m = small.m[x[at]]
        rank = small.forward[spans(small.first[x[at]], m)] - np.repeat(x[at], m) * small.ranks
        want = np.repeat(y[at], m) * large.ranks + rank
        place = np.minimum(np.searchsorted(large.forward, want), len(large.forward) - 1)
        common[at] = np.bincount(np.repeat(np.arange(len(m)), m), weights=large.forward[place] == want, minlength=len(m))
    either = small.block.n[x] + large.block.n[y] - common
    is_alike = common >= threshold * either - 1e-9
    x, y = x[is_alike], y[is_alike]
    return small.block.set_id[x], large.block.set_id[y], common[is_alike], either[is_alike]
