"""Near-duplicate passages by compact windows.

A document is a sequence of word shingles. For each of a few hash functions, the Cartesian
tree over the shingles' hashes gives compact windows (l, c, r): every subsequence within
l..r that holds c has its minimum at c. So one row stands for all subsequences that share
a minimum, and windows shorter than the least passage are left out. Windows with equal
minima in several documents are joined: relative to c, a common passage lies within both
windows, which gives an interval in each document; intervals on one diagonal are merged
over the hash functions, and where enough of them agree, both stretches are compared.

A group of windows is compared with its leader (the smallest member), not pair by pair.
A window whose minimum lies in no passage found is still open. For groups with open
windows the shingles around all minima are brought together; what no other member can
share is put aside by exact bounds, and each open window is compared with the members that
are left, until a passage around its minimum is found or there is none. Copies of a whole
text take no part in that: they are rows of their own.

Defined cases: null, empty and short texts hold no passage; rows with a null doc_id take
no part; rows equal in doc_id and text are one document; copies of a document count as
passages; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, mix, release, saved, shingle_hashes, slices, tidy

SNAP = 64


def compact_windows(h: np.ndarray, least: int, ties: bool = True) -> list[tuple[int, int, int]]:
    """(l, c, r), ends included, of the windows of at least `least` places; ties go left.

    Equal minima of a stretch are taken in one go, so repetitive texts cost no more. ties:
    False if all hashes differ.
    """
    out: list[tuple[int, int, int]] = []
    stack = [(0, len(h))] if len(h) >= least else []
    push, pop, add = stack.append, stack.pop, out.append
    while stack:
        l, r = pop()
        part = h[l:r]
        c = l + int(part.argmin())
        add((l, c, r - 1))
        if c - l >= least:
            push((l, c))
        if r - c <= least:
            continue
        low = h[c]
        if ties and c + 1 < r and h[c + 1 : r].min() == low:
            for d in (c + 1 + np.flatnonzero(h[c + 1 : r] == low)).tolist():
                if r - c - 1 < least:
                    break
                add((c + 1, d, r - 1))
                if d - c - 1 >= least:
                    push((c + 1, d))
                c = d
        if r - c > least:
            push((c + 1, r))
    return out


def bundled(keys: np.ndarray, w: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (l, c, r) with one key whose minima lie within `near` places of the one before, as one: (l, first c, last c, r)."""
    order = np.lexsort((w[:, 1], keys))
    keys, w = keys[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (w[1:, 1] - w[:-1, 1] >= near)]))
    last = np.append(first[1:], len(w)) - 1
    return keys[first], np.stack([np.minimum.reduceat(w[:, 0], first), w[first, 1], w[last, 1], np.maximum.reduceat(w[:, 2], first)], axis=1)


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def window_rows(texts: DataFrame, least: int, words: int, hashes: int, near: int) -> DataFrame:
    """(key, node, l, c, d, r) of the compact windows of every document; the key's last bits number its hash function."""
    salts = np.random.default_rng(17).integers(0, 1 << 63, hashes, dtype=np.uint64)
    bits = np.uint64((1 << hash_bits(hashes)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in slices(batches, 4 << 20):
            keys, rows, count = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_hashes(hasher(text), words)
                n = 0
                if len(s) >= least:
                    found, at = [], []
                    ties = len(np.unique(s)) < len(s)
                    for k, salt in enumerate(salts):
                        h = (mix(s ^ salt) & ~bits) | np.uint64(k)
                        w = np.array(compact_windows(h, least, ties), dtype=np.int32)
                        found.append(h[w[:, 1]])
                        at.append(w)
                    key, w = np.concatenate(found), np.concatenate(at)
                    key, w = bundled(key, w, near) if ties else (key, w[:, [0, 1, 1, 2]])
                    keys.append(key)
                    rows.append(w)
                    n = len(w)
                count.append(n)
            if keys:
                node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), count)
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node), *(pa.array(np.ascontiguousarray(x)) for x in np.concatenate(rows).T)], names=["key", "node", "l", "c", "d", "r"])

    return texts.select("node", "text").mapInArrow(run, "key long, node long, l int, c int, d int, r int")


def hash_bits(hashes: int) -> int:
    return max(1, (hashes - 1).bit_length())


def stretches(texts: DataFrame, want: DataFrame, words: int) -> DataFrame:
    """(node, doc_id, s, e, shingles): the wanted stretches (node, s, e) of documents, ends exclusive. texts: (node, doc_id, text).

    Shingles are 32-bit hashes: a stray match of one shingle does not make a passage.
    """
    spans = want.groupBy("node").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    rows = texts.join(spans, "node")
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("shingles", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in slices(batches, 4 << 20):
            cols: list[list] = [[] for _ in range(5)]
            size = 0
            for node, doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                s = (shingle_hashes(hasher(text), words) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for x in spans:
                    part = s[max(0, x["s"]) : x["e"]]
                    for c, v in zip(cols, (node, doc_id, x["s"], x["e"], part)):
                        c.append(v)
                    size += len(part)
                if size > 1_000_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
                    cols, size = [[] for _ in range(5)], 0
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return rows.select("node", "doc_id", "text", "spans").mapInArrow(run, "node long, doc_id long, s int, e int, shingles array<int>")


def dense(same: np.ndarray, penalty: float) -> Iterator[tuple[int, int]]:
    """Stretches, left to right, of greatest score with 1 for a match and a penalty for a miss."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -penalty))])
    hits, k = np.flatnonzero(same), 0
    while (at := np.searchsorted(hits, k)) < len(hits):
        start = int(hits[at])
        stop, low, size = len(same), start + 1, 64
        while low < len(total):  # in steps that double, so that the work follows the stretch's length
            below = total[low : low + size] < total[start]
            if below.any():
                stop = low + int(below.argmax()) - 1
                break
            low, size = low + size, 2 * size
        k = stop - int(np.argmax(total[start + 1 : stop + 1][::-1]))
        yield start, k


def places(first: np.ndarray, last: np.ndarray, b: np.ndarray, x: np.ndarray, penalty: float) -> Iterator[tuple[int, int]]:
    """Where in b the counterpart of a stretch with the shingles x may lie, given their first and last places."""
    yield int(first.min()), int(first.max()) + 1
    yield int(first.min()), int(last.max()) + 1
    if (first != last).any():
        yield int(last.min()), int(last.max()) + 1
        yield from dense(np.isin(b, x), penalty)


def passages(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) of the stretches of a and b that reach the similarity, ends exclusive.

    A stretch begins and ends with shingles that occur in b. It is taken where enough of
    them do; it and its counterpart are then compared as sets. What does not reach the
    similarity as a whole is searched for its places of `least` shingles that can: first
    for all of them that overlap, then for one after another, the fullest first.
    """
    if len(a) < least or len(b) < least:
        return []
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    first = order[np.minimum(np.searchsorted(sorted_b, a), len(b) - 1)]
    last = order[np.maximum(np.searchsorted(sorted_b, a, side="right") - 1, 0)]
    same = b[first] == a
    sums = np.concatenate([[0], np.cumsum(same)])
    need = -(-2 * least * percent // (100 + percent))
    out: list[tuple[int, int, int, int]] = []

    def reaches(start: int, end: int) -> bool:
        hit = np.flatnonzero(same[start:end]) + start
        x = np.unique(a[start:end])
        if 100 * len(np.unique(a[hit])) < percent * len(x):  # wherever the counterpart lies, no more are common
            return False
        for s, e in places(first[hit], last[hit], b, x, 0.2):
            if e - s < least:
                s = max(0, min(s, len(b) - least))
                e = s + least
            y = np.unique(b[s:e])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((start, end, s, e))
                return True
        return False

    for low, high in dense(same, 0.2):  # a match outweighs the shingles of one edited word
        if high - low < least or reaches(low, high):
            continue
        full = sums[low + least : high + 1] - sums[low : high + 1 - least]
        good = np.flatnonzero((full >= need) & same[low : high + 1 - least] & same[low + least - 1 : high])
        for run in np.split(good, np.flatnonzero(np.diff(good) >= least) + 1) if len(good) else []:
            if reaches(low + int(run[0]), low + int(run[-1]) + least):
                continue
            free = run
            while len(free):
                at = int(free[np.argmax(full[free])])
                reaches(low + at, low + at + least)
                free = free[np.abs(free - at) >= least]
    return sorted(out)


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists in a row, and where each list begins, with the end."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def chosen(x: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists given flat those of some numbers, flat."""
    size = np.diff(ends)
    mask = np.zeros(len(size), dtype=bool)
    mask[which] = True
    return x[np.repeat(mask, size)], np.concatenate([[0], np.cumsum(size[which])])


def possible(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, least: int, percent: int) -> np.ndarray:
    """The numbers of the pairs of shingle lists, given flat, that may hold a passage: an exact bound, for all pairs at once.

    Each side of a passage has `least` places or more, and `percent` of its distinct
    shingles are common to both; so are as many of its places, less those that its list
    repeats. First whole lists are held against that, then stretches.
    """

    def numbered(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles with the pair's number before; the distinct ones, ordered; and how many of a pair are repeats."""
        size = np.diff(ends)
        keys = (np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(32)) | x.view(np.uint32).astype(np.uint64)
        once = np.sort(keys)
        once = once[np.concatenate([[True], once[1:] != once[:-1]])] if len(once) else once
        return keys, once, size - np.bincount((once >> np.uint64(32)).astype(np.int64), minlength=len(size))

    def reaching(keys: np.ndarray, ends: np.ndarray, other: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Whether some stretch of `least` places or more of each pair, which are at least as long, has enough of them in the other list."""
        hit = other[np.minimum(np.searchsorted(other, keys), len(other) - 1)] == keys
        score = np.concatenate([[0], np.cumsum(100 * hit.astype(np.int64) - percent)])
        pair = np.repeat(np.arange(len(ends) - 1), np.diff(ends) + 1)  # a place more than shingles in each
        at = np.arange(len(pair)) - pair
        score = score[at] - pair * (100 * len(keys) + 1)  # those of later pairs lie below all before
        low = np.minimum.accumulate(score)
        late = np.flatnonzero(at - ends[pair] >= least)
        gain = score[late] - low[late - least]
        starts = np.searchsorted(pair[late], np.arange(len(ends) - 1))
        return np.maximum.reduceat(gain, starts) >= -percent * again

    which = np.flatnonzero((np.diff(a_ends) >= least) & (np.diff(b_ends) >= least))
    for step in (0, 1):
        if not len(which):
            return which
        (a1, a1_ends), (b1, b1_ends) = chosen(a, a_ends, which), chosen(b, b_ends, which)
        (x, u, u_again), (y, v, v_again) = numbered(a1, a1_ends), numbered(b1, b1_ends)
        if step:
            return which[reaching(x, a1_ends, v, u_again) & reaching(y, b1_ends, u, v_again)]
        both = np.sort(np.concatenate([u, v]))
        both = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(which))
        which = which[(both > 0) & (100 * both >= percent * (least - np.minimum(u_again, v_again)))]
    return which


def verified(pairs: DataFrame, pieces: DataFrame, least: int, words: int, percent: int) -> DataFrame:
    """(x, lead, doc_id, start_word, end_word, lead_id, lead_start, lead_end) of the pairs' passages."""
    own = pieces.select(F.col("node").alias("x"), "s", "e", "doc_id", F.col("shingles").alias("a"))
    led = pieces.select(F.col("node").alias("lead"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("doc_id").alias("lead_id"), F.col("shingles").alias("b"))
    rows = pairs.join(own, ["x", "s", "e"]).join(led, ["lead", "s2", "e2"]).select("x", "lead", "doc_id", "lead_id", "s", "s2", "a", "b")
    names = ["x", "lead", "doc_id", "lead_id", "start_word", "end_word", "lead_start", "lead_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8 << 20):
            out = []
            x, lead, doc_id, lead_id, s, s2 = (c.to_numpy() for c in part.columns[:6])
            (a, a_ends), (b, b_ends) = flat(part.column(6)), flat(part.column(7))
            for k in possible(a, a_ends, b, b_ends, least, percent).tolist():
                for i, j, i2, j2 in passages(a[a_ends[k] : a_ends[k + 1]], b[b_ends[k] : b_ends[k + 1]], least, percent):
                    s0, t0 = max(0, int(s[k])), max(0, int(s2[k]))
                    out.append((int(x[k]), int(lead[k]), int(doc_id[k]), int(lead_id[k]), s0 + i, s0 + j + words - 1, t0 + i2, t0 + j2 + words - 1))
            yield pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(8)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def copied(docs: DataFrame, min_words: int) -> DataFrame:
    """(node, doc_id, lead, lead_id, n): documents whose text has a smaller node, with the number of its words."""
    rows = keyed(docs)
    same = rows.select("node", "doc_id", F.md5("text").alias("same"))
    first = same.groupBy("same").agg(F.min(F.struct("node", "doc_id")).alias("first"), F.max("node").alias("high")).where("first.node < high").select("same", "first")
    pairs = saved(same.join(first, "same").where("node > first.node").select("node", "doc_id", F.col("first.node").alias("lead"), F.col("first.doc_id").alias("lead_id")).distinct(), "same")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x.encode("utf-8", "surrogatepass").split()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int32())], names=["node", "n"])

    texts = rows.select("node", "text").join(pairs.select("node").hint("broadcast"), "node", "left_semi")
    return pairs.join(texts.mapInArrow(counted, "node long, n int").where(F.col("n") >= min_words).distinct(), "node")


def covered_by(got: DataFrame) -> DataFrame:
    """(node, start_word, end_word) of the passages found, on both sides."""
    return got.select(F.col("x").alias("node"), "start_word", "end_word").unionByName(got.select(F.col("lead").alias("node"), F.col("lead_start").alias("start_word"), F.col("lead_end").alias("end_word"))).distinct()


def left_open(members: DataFrame, covered: DataFrame, words: int, block: int = 1024) -> DataFrame:
    """(g, p, q, node, l, c, d, r, open, i): the members but for leaders of groups that still have an open window.

    Groups of more than about `block` members are dealt into blocks i, and each pair of
    blocks (p, q) is a group of its own.
    """
    within = (F.col("c") >= F.col("start_word")) & (F.col("d") + words <= F.col("end_word"))
    members = members.where("not leads").drop("leads")
    closed = members.alias("m").join(covered.alias("p"), (F.col("m.node") == F.col("p.node")) & within, "left_semi").select("g", "node", "c", F.lit(False).alias("open")).distinct()
    rows = saved(members.join(closed, ["g", "node", "c"], "left").withColumn("open", F.coalesce("open", F.lit(True))), "state")
    sizes = rows.groupBy("g").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("open").alias("any"), F.count("*").alias("n")).where("any and low < high")
    sizes = saved(sizes.select("g", F.ceil(F.col("n") / block).cast("int").alias("n")), "sizes")  # read again, a hot group can be split
    rows = rows.join(sizes.hint("shuffle_hash"), "g").withColumn("i", F.pmod(F.xxhash64("node"), "n").cast("int"))
    rows = rows.withColumn("j", F.explode(F.expr("sequence(0, n - 1)")))
    return rows.select("g", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "node", "l", "c", "d", "r", "open", "i")


def surroundings(rows: DataFrame, texts: DataFrame, words: int, least: int, slack: int) -> DataFrame:
    """rows of left_open with doc_id, s and the shingles from s on within `least` places of their minima; c and d count from s."""
    spans = rows.select("node", F.struct("g", "p", "q", "i", "open", "c", "d", F.greatest(F.col("l") - slack, F.col("c") - least + 1, F.lit(0)).alias("s"), (F.least(F.col("r") + slack, F.col("d") + least - 1) + 1).alias("e")).alias("span"))
    spans = spans.groupBy("node").agg(F.collect_list("span").alias("spans"))
    kinds = {"g": pa.int64(), "p": pa.int32(), "q": pa.int32(), "i": pa.int32(), "open": pa.bool_(), "c": pa.int32(), "d": pa.int32(), "s": pa.int32()}
    schema = pa.schema([*kinds.items(), ("node", pa.int64()), ("doc_id", pa.int64()), ("shingles", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in slices(batches, 2 << 20):
            spans = b.column(3)
            flat_spans, size = spans.flatten(), np.diff(spans.offsets.to_numpy())
            s, e = (flat_spans.field(k).to_numpy() for k in ("s", "e"))
            at, parts, done = 0, [], 0
            row = np.repeat(np.arange(b.num_rows), size)
            for text, n in zip(b.column(2).to_pylist(), size.tolist()):
                h = (shingle_hashes(hasher(text), words) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for k in range(at, at + n):
                    parts.append(h[s[k] : e[k]])
                at += n
                if sum(map(len, parts[-n:])) > 200_000 or len(parts) > 10_000 or at == len(s):
                    some = slice(done, at)
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                    cols = {k: flat_spans.field(k).slice(done, at - done) for k in kinds}
                    for k in "cd":
                        cols[k] = pa.array(cols[k].to_numpy() - s[some])
                    cols |= {k: b.column(c).take(pa.array(row[some])) for c, k in enumerate(("node", "doc_id"))}
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))
                    yield pa.record_batch([*(cols[n] for n in schema.names[:-1]), lists], schema=schema)
                    parts, done = [], at

    shown = ", ".join(f"{n} {'boolean' if n == 'open' else 'int' if n not in ('g', 'node', 'doc_id') else 'long'}" for n in schema.names[:-1])
    return texts.join(spans, "node").select("node", "doc_id", "text", "spans").mapInArrow(run, shown + ", shingles array<int>")


def gains(score: np.ndarray, c: np.ndarray, d: np.ndarray, least: int) -> np.ndarray:
    """The greatest sum of each row over `least` places or more with a place of c..d among them; rows of equal length."""
    total = np.zeros((score.shape[0], score.shape[1] + 1), dtype=np.int64)
    np.cumsum(score, axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    end = np.arange(max(c + 1, least), total.shape[1])
    return (total[:, end] - low[:, np.minimum(end - least, d)]).max(axis=1) if len(end) else np.full(len(score), -(1 << 40))


def aligned(place: np.ndarray, same: np.ndarray, c: int, d: int, least: int, percent: int) -> np.ndarray:
    """Whether each row may have a passage with a place of c..d, where no shingle repeats on either side.

    place: where the other side holds each shingle. Its stretch spans the places of the
    first and of the last common shingle, and `least` places at least; so many distinct
    shingles it has.
    """
    total = np.zeros((same.shape[0], same.shape[1] + 1), dtype=np.int64)
    np.cumsum(np.where(same, 100, -percent), axis=1, out=total[:, 1:])
    end = np.arange(max(c, least - 1), same.shape[1])
    if not len(end):
        return np.zeros(len(same), dtype=bool)
    first, never = np.minimum(end - least + 1, d), 1 << 40
    low = np.minimum.accumulate(np.where(same, total[:, :-1], never), axis=1)
    wide = (np.where(same[:, end], total[:, end + 1], -never) - low[:, first]).max(axis=1) >= percent * least
    ahead = percent * place.astype(np.int64)
    low = np.minimum.accumulate(np.where(same, total[:, :-1] - ahead, never), axis=1)
    return wide & ((np.where(same[:, end], total[:, end + 1] - ahead[:, end], -never) - low[:, first]).max(axis=1) >= percent)


def hopeful(score: np.ndarray, ends: np.ndarray, c: np.ndarray, d: np.ndarray, least: int) -> np.ndarray:
    """gains() for rows given flat."""
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size + 1)
    start = ends[:-1] + np.arange(len(size))
    total = np.concatenate([[0], np.cumsum(score)])[np.arange(len(row)) - row]
    low = np.minimum.accumulate(total - row * (200 * len(score) + 1)) + row * (200 * len(score) + 1)
    at = np.arange(len(row)) - start[row]
    ok = np.flatnonzero((at >= least) & (at > c[row]))
    out = np.full(len(size), -(1 << 40))
    gain = total[ok] - low[start[row[ok]] + np.minimum(at[ok] - least, d[row[ok]])]
    np.maximum.at(out, row[ok], gain)
    return out


def countable(row: np.ndarray, at: np.ndarray, code: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places count in bounds on distinct shingles, as common ones and as others. row, at, code: of each place; c, d: of each row.

    A stretch with the place c holds, of a shingle's places to one side of it, the nearest
    or none; so further ones never count. Others count where that is the only side. With
    c < d all places count as common, and the first as others.
    """
    far, side = np.where(c == d, np.abs(at - c), at), np.where(c == d, at > c, False)
    order = np.lexsort((far, side, code, row))
    r, x, z = row[order], code[order], side[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
    near = new | np.concatenate([[True], z[1:] != z[:-1]])
    whole = np.cumsum(new) - 1
    sides = np.bincount(whole[near])[whole]
    common, other = np.empty(len(row), dtype=bool), np.empty(len(row), dtype=bool)
    common[order], other[order] = near, near & (sides == 1)
    return common | (c < d), other


def partners(rows: DataFrame, least: int, words: int, percent: int) -> DataFrame:
    """(x, lead, doc_id, lead_id, start_word, end_word, lead_start, lead_end): a passage around each open minimum with another member of its group.

    rows: those of surroundings. Shingles that one document of a group holds alone cannot
    be common; members that have no stretch around their minimum with enough others are
    put aside, and then those for which it holds shingle by shingle in no other member.
    Others are compared, the smallest document first, until a passage has the minimum.
    """
    names = ["x", "lead", "doc_id", "lead_id", "start_word", "end_word", "lead_start", "lead_end"]
    cols = ["g", "p", "q", "i", "open", "c", "d", "s", "node", "doc_id"]

    def meet(v: dict[str, np.ndarray], lists: list[np.ndarray], counts: list[tuple[np.ndarray, np.ndarray]], cross: bool) -> Iterator[tuple]:
        """One group: its members in order of nodes."""
        _, code = np.unique(np.concatenate(lists), return_inverse=True)
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        codes = np.split(code, cuts)
        where = np.full((len(lists), int(code.max()) + 1), -1, dtype=np.int32)
        for k, x in enumerate(codes):
            where[k, x] = np.arange(len(x))
        once = np.array([len(np.unique(x)) == len(x) for x in codes])
        for k in np.flatnonzero(v["open"]).tolist():
            others = np.flatnonzero((v["node"] != v["node"][k]) & (~cross | (v["i"] != v["i"][k])))
            c, d, (common, other) = int(v["c"][k]), int(v["d"][k]), counts[k]
            gain, loss = (100 - percent) * common.astype(np.int64), -percent * other.astype(np.int64)
            step, taken = max(1, (4 << 20) // len(common)), []
            for at in range(0, len(others), step):
                some = others[at : at + step]
                place = where[some[:, None], codes[k][None, :]]
                same = place >= 0
                good = gains(np.where(same, gain, loss), c, d, least) >= 0
                if once[k]:
                    good &= ~once[some] | aligned(place, same, c, d, least, percent)
                for y in some[good].tolist():
                    s, s2 = int(v["s"][k]), int(v["s"][y])
                    for i, j, i2, j2 in passages(lists[k], lists[y], least, percent):
                        if all(j <= low or i >= high for low, high in taken) or i <= d and j > c:
                            taken.append((i, j))
                            yield int(v["node"][k]), int(v["node"][y]), int(v["doc_id"][k]), int(v["doc_id"][y]), s + i, s + j + words - 1, s2 + i2, s2 + j2 + words - 1
                    if any(low <= d and high > c for low, high in taken):
                        break
                else:
                    continue
                break

    def several(b: pa.Table) -> Iterator[tuple]:
        """Whole groups."""
        b = b.combine_chunks().to_batches()[0]
        v = {n: b.column(n).to_numpy(zero_copy_only=False) for n in cols}
        x, ends = flat(b.column("shingles"))
        size = np.diff(ends)
        new = np.concatenate([[True], (v["g"][1:] != v["g"][:-1]) | (v["p"][1:] != v["p"][:-1]) | (v["q"][1:] != v["q"][:-1])])
        group = np.cumsum(new) - 1
        keys = (np.repeat(group.astype(np.uint64), size) << np.uint64(32)) | x.view(np.uint32).astype(np.uint64)
        _, code = np.unique(keys, return_inverse=True)
        low, high = np.full(int(code.max(initial=0)) + 1, np.iinfo(np.int64).max), np.full(int(code.max(initial=0)) + 1, np.iinfo(np.int64).min)
        node = np.repeat(v["node"], size)
        np.minimum.at(low, code, node)
        np.maximum.at(high, code, node)
        shared = (low < high)[code]
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(code)) - ends[row]
        common, other = countable(row, at, code, v["c"][row], v["d"][row])
        keep = hopeful(np.where(shared, (100 - percent) * common, -percent * other), ends, v["c"], v["d"], least) >= 0
        keep = np.flatnonzero(keep)
        keep = keep[np.isin(group[keep], group[keep[v["open"][keep]]])]
        for part in np.split(keep, np.flatnonzero(np.diff(group[keep])) + 1) if len(keep) else []:
            part = part[np.argsort(v["node"][part], kind="stable")]
            if v["node"][part[0]] < v["node"][part[-1]]:
                some = {n: a[part] for n, a in v.items()}
                spans = [slice(ends[k], ends[k + 1]) for k in part.tolist()]
                yield from meet(some, [x[k] for k in spans], [(common[k], other[k]) for k in spans], bool(some["p"][0] != some["q"][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        rows_of = lambda t: pa.record_batch([pa.array([r[c] for r in t], pa.int64()) for c in range(8)], names=names)
        for b in batches:
            if not b.num_rows:
                continue
            g, p, q = (b.column(n).to_numpy() for n in "gpq")
            last = int(np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))[-1])
            fresh = bool(left) and any(left[-1].column(n)[-1].as_py() != b.column(n)[0].as_py() for n in "gpq")
            if last or fresh:
                whole = [*left, b.slice(0, last)] if last else left
                yield rows_of(list(several(pa.Table.from_batches(whole))))
                left = []
            left.append(b.slice(last))
        if left:
            yield rows_of(list(several(pa.Table.from_batches(left))))

    rows = rows.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    return rows.select(*cols, "shingles").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def chained(rows: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """rows with a column `name` that numbers, within the keys, the chains of overlapping intervals."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)))
    return rows.withColumn(name, F.count_if("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def candidate_pairs(members: DataFrame, agree: int, slack: int, shortest: float, hashes: int) -> DataFrame:
    """(x, lead, s, e, s2, e2): stretches of a member and of a leader of its group that may hold a common passage.

    members: (g, node, l, c, d, r, leads). Around a shared minimum a common passage lies
    within both windows, so these must have `shortest` places in common. Every window of
    the member is held against every one of a leader. A pair needs shared windows of `agree` hash functions; intervals that
    overlap in the member and in the leader are merged. Bundles of windows are compared
    over their whole range.
    """
    front = members.where("leads").select("g", F.col("node").alias("lead"), F.struct("c", "d", "l", "r").alias("f"))
    rows = members.join(front.hint("shuffle_hash"), "g").where("node > lead or not leads and node < lead")
    bundle = (F.col("c") < F.col("d")) | (F.col("f.c") < F.col("f.d"))
    left = F.least(F.col("c") - F.col("l"), F.col("f.c") - F.col("f.l"))
    right = F.least(F.col("r") - F.col("c"), F.col("f.r") - F.col("f.c")) + 1
    rows = rows.where(bundle | (left + right >= shortest))
    pick = lambda whole, part: F.when(bundle, whole).otherwise(part)
    diagonal = F.when(~bundle, F.col("c") - F.col("f.c"))
    rows = rows.select(
        F.col("node").alias("x"), "lead", diagonal.alias("diagonal"), F.expr(f"shiftleft(1, cast(pmod(g, {1 << hash_bits(hashes)}) AS int))").alias("f"),
        pick(F.col("l"), F.col("c") - left - slack).alias("s"), pick(F.col("r") + 1, F.col("c") + right + slack).alias("e"),
        pick(F.col("f.l"), F.col("f.c") - left - slack).alias("s2"), pick(F.col("f.r") + 1, F.col("f.c") + right + slack).alias("e2"),
    )
    alone = F.when(F.col("diagonal").isNull(), F.xxhash64("s", "e", "s2", "e2"))
    rows = rows.groupBy("x", "lead", "diagonal", alone.alias("alone")).agg(F.bit_or("f").alias("f"), F.min("s").alias("s"), F.max("e").alias("e"), F.min("s2").alias("s2"), F.max("e2").alias("e2"))
    rows = rows.withColumn("all", F.bit_or("f").over(Window.partitionBy("x", "lead"))).where(F.bit_count("all") >= agree)
    rows = chained(chained(rows, ["x", "lead"], "s", "e", "part"), ["x", "lead", "part"], "s2", "e2", "copy")
    out = rows.groupBy("x", "lead", "part", "copy").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("s2").alias("s2"), F.max("e2").alias("e2"))
    low = F.greatest(F.col("s2"), F.lit(0))
    return out.select("x", "lead", F.greatest("s", F.lit(0)).alias("s"), "e", (F.floor(low / SNAP) * SNAP).cast("int").alias("s2"), (F.ceil(F.col("e2") / SNAP) * SNAP).cast("int").alias("e2"))


def repeated_passages(docs: DataFrame, min_words: int = 50, words: int = 5, percent: int = 80, hashes: int = 4, agree: int = 2, slack: int = 16, near: int = 512) -> DataFrame:
    """doc_id, start_word, end_word, class_id, class_start, class_end: passages that documents share.

    class_id is the document that leads a group, with the place of its copy; the leader's
    own passage is a row as well. near: windows of a document with one key whose minima
    are less than this apart are taken together.
    """
    least = min_words - words + 1
    shortest = least * percent / 100
    copies = saved(copied(docs, min_words), "copies")
    texts = keyed(docs).join(copies.select("node").hint("broadcast"), "node", "left_anti")
    windows = saved(window_rows(texts, least, words, hashes, near), "windows")
    keys = windows.groupBy(F.col("key").alias("g")).agg(F.min("node").alias("lead"), F.max("node").alias("high")).where("lead < high").drop("high")
    keys = saved(keys, "keys")  # read again, both sides of the join are dealt anew, so that a hot key can be split
    hits = windows.withColumnRenamed("key", "g").join(keys.hint("shuffle_hash"), "g")
    members = saved(hits.select("g", "node", "l", "c", "d", "r", (F.col("node") == F.col("lead")).alias("leads")), "members")
    release(windows)
    release(keys)
    tidy(docs.sparkSession)

    pairs = saved(candidate_pairs(members, agree, slack, shortest, hashes), "pairs")
    want = pairs.select(F.col("x").alias("node"), "s", "e").unionByName(pairs.select(F.col("lead").alias("node"), F.col("s2").alias("s"), F.col("e2").alias("e")))
    pieces = saved(stretches(texts, want, words), "pieces")
    found = saved(verified(pairs, pieces, least, words, percent), "passages")
    release(pairs)
    release(pieces)
    tidy(docs.sparkSession)
    rest = saved(left_open(members, covered_by(found), words), "rest")
    release(members)
    tidy(docs.sparkSession)
    others = saved(partners(surroundings(rest, texts, words, least, slack), least, words, percent), "passages")
    release(rest)
    tidy(docs.sparkSession)
    whole = copies.select(F.col("node").alias("x"), "lead", "doc_id", "lead_id", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), F.lit(0).alias("lead_start"), F.col("n").alias("lead_end"))
    found = found.unionByName(whole)
    # those around single minima stay as verified: merged with others they might no longer be similar
    return merged_spans(both_sides(found)).unionByName(both_sides(others)).distinct()


def both_sides(found: DataFrame) -> DataFrame:
    """The passages found as rows of their class, with the leader's own."""
    lead = [F.col("lead_id").alias("class_id"), F.col("lead_start").alias("class_start"), F.col("lead_end").alias("class_end")]
    own = [F.col("lead_id").alias("doc_id"), F.col("lead_start").alias("start_word"), F.col("lead_end").alias("end_word")]
    return found.select("doc_id", "start_word", "end_word", *lead).unionByName(found.select(*own, *lead)).distinct()


def merged_spans(rows: DataFrame) -> DataFrame:
    """Passages of one document in one class that overlap, there and in the class copy, as one."""
    before = Window.partitionBy("doc_id", "class_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start_word") < F.coalesce(reach, F.lit(-1)), 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rows = chained(rows, ["doc_id", "class_id", "part"], "class_start", "class_end", "copy")
    out = rows.groupBy("doc_id", "class_id", "part", "copy").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("class_start").alias("class_start"), F.max("class_end").alias("class_end"))
    return out.select("doc_id", "start_word", "end_word", "class_id", "class_start", "class_end")
