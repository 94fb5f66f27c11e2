"""Similarity joins on sets: trigrams of characters and rule words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import fixed
from lodestrata.functions.text import normalized
from lodestrata.tables import written


def _folded(texts: DataFrame) -> DataFrame:
    return texts.select("id", normalized(F.col("text")).alias("text"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.string()))], ["id", "grams"])


def trigrams(texts: DataFrame) -> DataFrame:
    """id and the set of character trigrams of the normalised text; texts under three characters have none."""
    return _folded(texts).filter("text IS NOT NULL").mapInArrow(_grams, "id long, grams array<string>")


def _gram_numbers(texts: list[str]) -> Iterator[np.ndarray]:
    """The set of trigrams of each text, each as one number, in order."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = 0
    for t in texts:
        p = points[at : at + len(t)]
        at += len(t)
        g = np.sort(p[:-2] << 42 | p[1:-1] << 21 | p[2:])
        yield g[np.concatenate([[True], g[1:] != g[:-1]])]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams, n = np.unique(np.concatenate([np.empty(0, np.int64), *_gram_numbers(b.column("text").to_pylist())]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "n"])


def _blocked(held, block: int):
    """Blocks of sets of about one size: how many grams the sets have at least and at most, and ids, sizes and codes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = held.value
        ids, sets = [], []

        def cut() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
            for lo in range(0, len(order), block):
                own = order[lo : lo + block]
                sizes = np.array([len(sets[i]) for i in own], np.int32)
                data = np.array([ids[i] for i in own], np.int64).tobytes() + sizes.tobytes() + np.concatenate([sets[i] for i in own]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(sizes[0])], pa.int32()), pa.array([int(sizes[-1])], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([data], pa.binary())], ["low", "high", "m", "data"])
            ids.clear()
            sets.clear()

        for b in batches:
            ids += b.column("id").to_pylist()
            sets += [np.sort(rank[np.searchsorted(known, g)]) for g in _gram_numbers(b.column("text").to_pylist())]
            if len(ids) >= 8 * block:
                yield from cut()
        yield from cut()

    return run


def _opened(data: bytes, m: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.int64, m), np.frombuffer(data, np.int32, m, 8 * m), np.frombuffer(data, kind, -1, 12 * m)


def _needed(most: int, least: float) -> np.ndarray:
    """For sets of 0, 1, ... ``most`` grams the smallest number of common ones that is ``least`` of them."""
    n = np.arange(most + 1)
    c = np.maximum(np.ceil(least * n).astype(np.int64) - 1, 0)
    return np.where(c / np.maximum(n, 1) >= least, c, c + 1)


def _comparing(least: float, kind, what: str, near: float, chunk: int = 128):
    """Compares the sets of two blocks.  ``what``: "pairs" that are similar, or "counts" of similar and near ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at = {c: b.column(c)[r].as_py() for c in b.schema.names}
                out = compared(_opened(at["xdata"], at["xm"], kind), _opened(at["ydata"], at["ym"], kind), at["same"])
                for lo in range(0, len(out[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 18)]) for x in out], ["a", "near", "related"] if what == "counts" else ["a", "b", "similarity"])

    def compared(x, y, same: bool) -> list[np.ndarray]:
        (xid, xn, xc), (yid, yn, yc) = x, y
        width, space = len(yid), int(max(xc.max(), yc.max())) + 1
        need, closer = (_needed(int(max(xn.max(), yn.max())), s) for s in (least, near))
        own, own_near = need[yn], closer[yn]
        # Grams of many texts are rows of ones, the others lists of texts.
        df = np.bincount(yc, minlength=space)
        of = np.repeat(np.arange(width, dtype=np.int32), yn)
        common = np.argsort(-df, kind="stable")[: (96 << 20) // width]
        common = common[df[common] >= max(2, width // 200)]
        row = np.full(space, -1)
        row[common] = np.arange(len(common))
        ones = np.zeros((len(common), width), np.uint8)
        many = row[yc] >= 0
        ones[row[yc[many]], of[many]] = 1
        order = np.argsort(yc[~many], kind="stable")
        listed = of[~many][order]
        df[common] = 0
        start = np.cumsum(df) - df
        xs, ys = np.cumsum(xn) - xn, np.cumsum(yn) - yn
        flag = np.zeros(space, bool)
        counts = [np.zeros(len(xid), np.int64), np.zeros(len(xid), np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)]
        found = []
        for u in range(0, len(xid), chunk):
            part = np.arange(u, min(u + chunk, len(xid)))
            n = xn[part]
            # At least need[n] of a set's n grams are common, so of its rarest n - need[n] + c at least c are.
            c = need[n] if least < 0.6 else np.minimum(need[n], 2 + n // 16)
            first = n - need[n] + c
            table = np.zeros((len(part), width), np.uint8 if first.max() < 256 else np.uint16)
            which = np.repeat(np.arange(len(part)), first)
            codes = xc[np.repeat(xs[part], first) + np.arange(len(which)) - np.repeat(np.cumsum(first) - first, first)]
            k = df[codes]
            w = np.repeat(np.arange(len(codes)), k)
            met = which[w] * width + listed[np.repeat(start[codes], k) + np.arange(len(w)) - np.repeat(np.cumsum(k) - k, k)]
            if len(met):
                np.add.at(table.reshape(-1), met, table.dtype.type(1))
            low, high = np.searchsorted(yn, np.ceil(n * least - 1e-9)), np.searchsorted(yn, np.floor(n / least + 1e-9), "right")
            limit = np.minimum(own, np.iinfo(table.dtype).max).astype(table.dtype)
            rows, ends = row[codes].tolist(), [0, *np.cumsum(first).tolist()]
            for i, at in enumerate(part):
                lo, hi = low[i], high[i]
                if same:
                    lo = max(lo, at + 1)
                if lo >= hi:
                    continue
                line = table[i, lo:hi]
                for g in rows[ends[i] : ends[i + 1]]:
                    if g >= 0:
                        np.add(line, ones[g, lo:hi], out=line)
                if first[i] == n[i]:
                    hit = np.flatnonzero(line >= np.maximum(limit[lo:hi], line.dtype.type(need[n[i]])))
                    c_hit = line[hit].astype(np.int64)
                    hit += lo
                else:
                    hit = np.flatnonzero(line >= c[i]) + lo
                    if not len(hit):
                        continue
                    flag[xc[xs[at] : xs[at] + n[i]]] = True
                    size = yn[hit]
                    ends_hit = np.cumsum(size)
                    there = flag[yc[np.repeat(ys[hit] - ends_hit + size, size) + np.arange(ends_hit[-1])]]
                    c_hit = np.add.reduceat(there, ends_hit - size, dtype=np.int64)
                    flag[xc[xs[at] : xs[at] + n[i]]] = False
                    keep = c_hit >= np.maximum(need[n[i]], own[hit])
                    hit, c_hit = hit[keep], c_hit[keep]
                if not len(hit):
                    continue
                if what == "counts":
                    close = c_hit >= np.maximum(closer[n[i]], own_near[hit])
                    counts[0][at] += close.sum()
                    counts[1][at] += len(close) - close.sum()
                    counts[2][hit[close]] += 1
                    counts[3][hit[~close]] += 1
                    continue
                similar = c_hit / np.maximum(n[i], yn[hit])
                found.append((np.full(len(hit), xid[at]), yid[hit], similar))
        if what == "counts":
            ids, near_by, related = np.concatenate([xid, yid]), np.concatenate(counts[::2]), np.concatenate(counts[1::2])
            some = near_by + related > 0
            return [ids[some], near_by[some], related[some]]
        return [np.concatenate([np.empty(0, t), *(f[i] for f in found)]) for i, t in enumerate((np.int64, np.int64, np.float64))]

    return run


def _compared(texts: DataFrame, other: DataFrame | None, least: float, what: str, near: float = 1.0, block: int = 16384) -> DataFrame:
    """The sets of trigrams of ``texts(id, text)`` compared with one another, block by block; with those of ``other`` see ``_met``.

    Sets are written once, as numbers by rarity, in blocks of sets of about one
    size; every two blocks whose sizes are within the factor ``least`` meet in one
    task, which passes on what was found.  No pair is moved before it is known to
    be similar.  What reaches the driver is the number of texts of each trigram.
    """
    if other is not None:
        return _met(_folded(texts), _folded(other), least, what == "best", block)
    texts = _folded(texts).filter("length(text) >= 3")
    df = texts.mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    known = df["gram"].to_numpy()
    kind = np.uint16 if len(known) <= 1 << 16 else np.uint32
    rank = np.empty(len(known), kind)
    rank[np.lexsort((known, df["n"].to_numpy()))] = np.arange(len(known))  # what is rare comes first in every set
    held = texts.sparkSession.sparkContext.broadcast((known, rank))
    blocks = written(texts.mapInArrow(_blocked(held, block), "low int, high int, m int, data binary").withColumn("block", F.monotonically_increasing_id()), "grams", "zstd")
    x, y = (blocks.select(*(F.col(c).alias(side + c) for c in blocks.columns)) for side in "xy")
    meet = (F.col("xlow") * least <= F.col("yhigh") + 1e-6) & (F.col("ylow") * least <= F.col("xhigh") + 1e-6) & (F.col("xblock") <= F.col("yblock"))
    pairs = x.join(y, meet).select("xm", "xdata", "ym", "ydata", (F.col("xblock") == F.col("yblock")).alias("same"))
    return pairs.mapInArrow(_comparing(least, kind, what, near), "a long, near long, related long" if what == "counts" else "a long, b long, similarity double")


#: What the search for similar texts projects on: so many of the commonest grams, directions for kinds, kinds, directions of a kind, texts to find them by.
_COMMON, _COARSE, _KINDS, _OWN, _SHOWN = 4096, 16, 6, 128, 6000


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of a million letters at most, if there are several."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and (total + len(t) > 1 << 20 or i - lo == 4096):
            yield texts[lo:i]
            lo, total = i, 0
        total += len(t)
    if texts:
        yield texts[lo:]


def _gram_sets(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: how many, their trigrams as numbers in order, in how many texts each is, and these texts gram by gram."""
    for part in _slices(texts):
        points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        seen = np.flatnonzero(np.bincount(points, minlength=1))
        letter, of = len(seen).bit_length(), len(part).bit_length()
        if 3 * letter + of > 62 and len(part) > 1:  # more letters than any writing has
            yield from _gram_sets(part[: len(part) // 2])
            yield from _gram_sets(part[len(part) // 2 :])
            continue
        small = np.searchsorted(seen, points).astype(np.int64)
        size = np.array([len(t) for t in part])
        text = np.repeat(np.arange(len(part)), size)
        whole = np.flatnonzero(text[2:] == text[:-2])
        keys = np.sort((((small[whole] << letter | small[whole + 1]) << letter | small[whole + 2]) << of) | text[whole])
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        gram = keys >> of
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
        g, low = gram[first], (1 << letter) - 1
        grams = seen[g >> 2 * letter].astype(np.int64) << 42 | seen[g >> letter & low].astype(np.int64) << 21 | seen[g & low]
        yield len(part), grams, np.diff(np.append(first, len(gram))), keys & ((1 << of) - 1)


def _gram_set_counts(numbered: int):
    """In how many texts each trigram is; under the number ``numbered``, which no trigram has, how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, grams, n, _ in _gram_sets(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.append(grams, numbered)), pa.array(np.append(n, m))], ["gram", "n"])

    return run


def _bits(known: np.ndarray, rank: np.ndarray, width: int, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: bits of the ``width`` commonest grams, and text and rank of all others in order of the texts."""
    for m, grams, n, text in _gram_sets(texts):
        ranks = np.repeat(rank[np.searchsorted(known, grams)], n).astype(np.int64) - (len(known) - width)
        common = ranks >= 0
        ones = np.zeros((m, -(-width // 64) * 64), bool)
        ones[text[common], ranks[common]] = True
        of, others = text[~common], ranks[~common] + len(known) - width
        order = np.argsort(of, kind="stable")
        yield np.packbits(ones, axis=1, bitorder="little"), of[order], others[order]


def _dense(bits: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=width, bitorder="little").astype(np.float32)


def _directions(ones: np.ndarray, n: int, rng) -> np.ndarray:
    """At most ``n`` orthonormal columns on which the rows have the most of their length."""
    q = rng.standard_normal((ones.shape[1], min(n + 8, *ones.shape)))
    for _ in range(4):
        q = np.linalg.qr((ones.T @ (ones @ q.astype(np.float32))).astype(np.float64))[0]
    inner = (ones @ q.astype(np.float32)).astype(np.float64)
    return (q @ np.linalg.eigh(inner.T @ inner)[1][:, ::-1])[:, :n].astype(np.float32)


def _kinds(known: np.ndarray, rank: np.ndarray, texts: list[str]) -> dict:
    """Kinds of texts (languages, forms) by those shown: their centres, directions of each and, of each gram, the kind that has it most.

    Only the time depends on how well they fit, as all bounds hold for any directions and kinds.
    """
    width, rng = min(_COMMON, len(known)), np.random.default_rng(0)
    bits = np.concatenate([np.zeros((0, -(-width // 64) * 8), np.uint8), *(b for b, _, _ in _bits(known, rank, width, texts))])
    ones = _dense(bits, width)
    if not len(ones):
        return {"known": known, "rank": rank, "width": width, "coarse": np.zeros((width, 0), np.float32), "centres": np.zeros((1, 0), np.float32), "own": [np.zeros((width, 0), np.float32)], "group": np.zeros(width, np.int64)}
    coarse = _directions(ones, _COARSE, rng)
    at = ones @ coarse / np.sqrt(np.maximum(ones.sum(1), 1))[:, None]
    centres = at[rng.choice(len(at), max(1, min(_KINDS, len(at) // 50)), replace=False)]
    for _ in range(15):
        kind = (2 * at @ centres.T - (centres**2).sum(1)).argmax(1)
        centres = np.stack([at[kind == j].mean(0) if (kind == j).any() else c for j, c in enumerate(centres)])
    kind = (2 * at @ centres.T - (centres**2).sum(1)).argmax(1)
    own = [_directions(ones[kind == j] if (kind == j).any() else ones, _OWN, rng) for j in range(len(centres))]
    share = np.stack([ones[kind == j].sum(0) / max((kind == j).sum(), 1) for j in range(len(centres))])
    return {"known": known, "rank": rank, "width": width, "coarse": coarse, "centres": centres, "own": own, "group": share.argmax(0)}


def _lengths(bits: np.ndarray, n: np.ndarray, width: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets projected on the columns of ``own``, and the length of what is left of each."""
    out = [_dense(bits[lo : lo + 1024], width) @ own for lo in range(0, len(bits), 1024)]
    p = np.concatenate([np.zeros((0, own.shape[1]), np.float32), *out])
    return p, np.sqrt(np.maximum(n - (p.astype(np.float64) ** 2).sum(1), 0) + 1e-5 * n).astype(np.float32)


def _kept(held, block: int, projected: bool):
    """Blocks of sets, of one kind and about one size if ``projected``: arrays one behind the other as bytes, see ``_unpacked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = held.value
        width, member = k["width"], (k["group"][:, None] == np.arange(len(k["centres"]))).astype(np.float32)
        rows = []  # of each run of texts: ids, kind, size, grams by group, bits, number of rare grams, rare grams

        def cut() -> Iterator[pa.RecordBatch]:
            ids, kind, n, by, bits, few, rare = (np.concatenate(x) for x in zip(*rows))
            start = np.cumsum(few) - few
            for j in np.unique(kind):
                own = np.flatnonzero(kind == j)
                own = own[np.argsort(n[own], kind="stable")]
                for lo in range(0, len(own), block):
                    at = own[lo : lo + block]
                    others = rare[np.repeat(start[at] - np.cumsum(few[at]) + few[at], few[at]) + np.arange(few[at].sum())]
                    arrays = [ids[at], bits[at], n[at], by[at], few[at], others]
                    if projected:
                        p, r = _lengths(bits[at], n[at], width, k["own"][j])
                        arrays += [r, p.astype(np.float16)]
                    data = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
                    yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int32()) for x in (j, n[at[0]], n[at[-1]], len(at), len(others))] + [pa.array([data], pa.binary())], ["kind", "low", "high", "m", "rare", "data"])
            rows.clear()

        for b in batches:
            ids, texts, done = b.column("id").to_numpy(), b.column("text").to_pylist(), 0
            for bits, of, rare in _bits(k["known"], k["rank"], width, texts):
                m = len(bits)
                few = np.bincount(of, minlength=m).astype(np.int32)
                ones = _dense(bits, width)
                by = np.concatenate([ones @ member, few[:, None]], 1).astype(np.int32)
                n = by.sum(1).astype(np.int32)
                near = ones @ k["coarse"] / np.sqrt(np.maximum(n - few, 1))[:, None]
                kind = (2 * near @ k["centres"].T - (k["centres"] ** 2).sum(1)).argmax(1) if projected else np.zeros(m, np.int64)
                rows.append((ids[done : done + m].astype(np.int64), kind, n, by, bits, few, rare.astype(np.int32)))
                done += m
            if sum(len(r[0]) for r in rows) >= (48 if projected else 8) * max(block, 128) // 8:
                yield from cut()
        if rows:
            yield from cut()

    return run


def _unpacked(data: bytes, m: int, rare: int, kinds: int, width: int, own: int | None = None) -> list[np.ndarray]:
    """The arrays of a block: ids, bits, sizes, grams by group, numbers of rare grams, these; with ``own`` directions also what they leave and the projections."""
    kept = [(np.int64, (m,)), (np.uint64, (m, -(-width // 64))), (np.int32, (m,)), (np.int32, (m, kinds + 1)), (np.int32, (m,)), (np.int32, (rare,))]
    at, out = 0, []
    for t, shape in kept if own is None else [*kept, (np.float32, (m,)), (np.float16, (m, own))]:
        size = int(np.prod(shape))
        out.append(np.frombuffer(data, t, size, at).reshape(shape))
        at += size * np.dtype(t).itemsize
    return out


def _meeting(held, least: float, best: bool, tile: int = 512, chunk: int = 512):
    """Pairs of two blocks of sets that are similar, or only the best one of each left set.

    Two sets have at most as many grams in common as the smaller numbers of
    each group add up to, and at most their product on some orthonormal
    directions plus the product of the lengths of what is left (Cauchy and
    Schwarz).  What passes both is counted on bits, then on the rare grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = held.value
        x, at, shown = None, None, {}
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names if c != "xdata"}
                if row["xblock"] != at:
                    at, shown = row["xblock"], {}
                    x = _unpacked(b.column("xdata")[r].as_py(), row["xm"], row["xrare"], len(k["centres"]), k["width"])
                j = row["ykind"]
                if j not in shown:
                    shown[j] = (np.zeros((len(x[0]), k["own"][j].shape[1] + 1), np.float32), np.zeros(len(x[0]), bool))
                y = _unpacked(row["ydata"], row["ym"], row["yrare"], len(k["centres"]), k["width"], k["own"][j].shape[1])
                out = met(x, y, k["width"], k["own"][j], *shown[j])
                for lo in range(0, len(out[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 18)]) for c in out], ["a", "b", "similarity"])

    def met(x, y, width: int, own: np.ndarray, xp: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
        (xid, xbits, xn, xby, xfew, xrare), (yid, ybits, yn, yby, yfew, yrare, yleft, yp) = x, y
        yp = np.concatenate([yp.astype(np.float32), yleft[:, None]], 1)
        xs, ys = np.cumsum(xfew) - xfew, np.cumsum(yfew) - yfew
        slack = 1e-3 / least  # halves of 11 bits; the shares compared with 1 are of ``least`` of a size
        found = []
        for lo in range(0, len(yn), tile):
            hi = min(lo + tile, len(yn))
            small, large = yn[lo], yn[hi - 1]
            some = np.flatnonzero((xn >= least * small - 1e-6) & (xn * least <= large + 1e-6))
            some = some[np.minimum(xby[some], yby[lo:hi].max(0)).sum(1) >= least * np.maximum(xn[some], small) - 1e-6]
            new = some[~known[some]]
            if len(new):
                xp[new, :-1], xp[new, -1] = _lengths(xbits[new].view(np.uint8), xn[new], width, own)
                known[new] = True
            # The larger size is at least the left one, or at least the right one.
            for part, by_left in ((some[xn[some] >= large], True), (some[xn[some] < large], False)):
                right = np.ascontiguousarray((yp[lo:hi] if by_left else yp[lo:hi] / (least * yn[lo:hi, None]).astype(np.float32)).T)
                for u in range(0, len(part), chunk):
                    own_x = part[u : u + chunk]
                    left = xp[own_x] / (least * xn[own_x, None]).astype(np.float32) if by_left else xp[own_x]
                    hit = np.flatnonzero((left @ right).reshape(-1) >= np.float32(1 - slack))
                    for v in range(0, len(hit), 8192):
                        i, j = np.divmod(hit[v : v + 8192], hi - lo)
                        i, j = own_x[i], j + lo
                        most = np.maximum(xn[i], yn[j])
                        c = np.bitwise_count(xbits[i] & ybits[j]).sum(1, dtype=np.int64)
                        keep = (c + np.minimum(xfew[i], yfew[j])) / most >= least
                        if keep.any():
                            found.append(rest(i[keep], j[keep], c[keep], most[keep], xs, xfew, xrare, ys, yfew, yrare))
        i, j, similar = (np.concatenate([np.empty(0, t), *(f[c] for f in found)]) for c, t in enumerate((np.int64, np.int64, np.float64)))
        if best:
            order = np.lexsort((yid[j], -similar, i))
            order = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order
            i, j, similar = i[order], j[order], similar[order]
        return [xid[i], yid[j], similar]

    def rest(i, j, c, most, xs, xfew, xrare, ys, yfew, yrare) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The common rare grams added, and what is similar then."""
        keys = []
        for at, start, few, rare in ((i, xs, xfew, xrare), (j, ys, yfew, yrare)):
            n = few[at]
            pair = np.repeat(np.arange(len(at)), n)
            keys.append(pair << 32 | rare[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(len(pair))])
        keys = np.sort(np.concatenate(keys))
        c = c + np.bincount(keys[1:][keys[1:] == keys[:-1]] >> 32, minlength=len(c))
        similar = c / most
        keep = similar >= least
        return i[keep], j[keep], similar[keep]

    return run


def _met(texts: DataFrame, other: DataFrame, least: float, best: bool, block: int = 16384) -> DataFrame:
    """The sets of trigrams of normalised ``texts(id, text)`` compared with those of ``other``, block by block.

    As ``_compared``, but few pairs are counted: kinds of texts and the
    directions in which they differ, found by some of the texts, bound what two
    sets have in common.  Every pair is held against the bounds.
    """
    spark = texts.sparkSession
    sides = [t.filter("length(text) >= 3") for t in (texts, other)]
    counted = sides[0].mapInArrow(_gram_set_counts(-2), "gram long, n long").unionByName(sides[1].mapInArrow(_gram_set_counts(-1), "gram long, n long"))
    df = counted.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    known, n = df["gram"].to_numpy(), df["n"].to_numpy()
    total = int(n[known == -1].sum())
    n, known = n[known >= 0], known[known >= 0]
    rank = np.empty(len(known), np.int32)
    rank[np.lexsort((known, n))] = np.arange(len(known))  # what is common comes last
    shown = sides[1].filter(F.pmod(F.xxhash64("id"), F.lit(-(-total // _SHOWN) or 1)) == 0).limit(2 * _SHOWN).toArrow()["text"].to_pylist()
    held = spark.sparkContext.broadcast(_kinds(known, rank, shown))
    x, y = (written(t.mapInArrow(_kept(held, block if side == "x" else max(block // 2, 1), side == "y"), "kind int, low int, high int, m int, rare int, data binary").withColumn("block", F.monotonically_increasing_id()), "grams", "zstd") for side, t in zip("xy", sides))
    x, y = (t.select(*(F.col(c).alias(side + c) for c in t.columns)) for side, t in (("x", x), ("y", y)))
    # A left block is projected once in each task, so right ones come in few parts.
    tasks = max(2 * spark.sparkContext.defaultParallelism // max(x.rdd.getNumPartitions(), 1), total >> 17, 1)
    meet = (F.col("xlow") * least <= F.col("yhigh") + 1e-6) & (F.col("ylow") * least <= F.col("xhigh") + 1e-6)
    pairs = x.join(y.coalesce(tasks).hint("shuffle_replicate_nl"), meet).select("xblock", "xm", "xrare", "xdata", "ykind", "ym", "yrare", "ydata")
    # Pairs of blocks are of some 20 MB: more than one at a time is more than workers have room for.
    at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(at_once)
    spark.conf.set(at_once, 1)
    try:
        return written(pairs.mapInArrow(_meeting(held, least, best), "a long, b long, similarity double"), "met")
    finally:
        spark.conf.set(at_once, usual)


def similar_pairs(texts: DataFrame, least: float) -> DataFrame:
    """a < b and their similarity, |A and B| / max(|A|, |B|), where it is at least ``least``."""
    return _compared(texts, None, least, "pairs").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def against(incoming: DataFrame, existing: DataFrame, least: float, best: bool = False) -> DataFrame:
    """a of ``incoming(id, text)``, b of ``existing(id, text)`` and their similarity, where it is at least ``least``.

    As ``similar_pairs``, but only between the two.  Null and short texts are
    similar to none.  With ``best`` only the most similar of each two blocks, of
    several the smallest id.
    """
    return _met(_folded(incoming), _folded(existing), least, best)


def _heads(keyed: DataFrame, keys: DataFrame, most: int = 200_000) -> DataFrame:
    """id and text of the rows of ``keyed(id, text, key)`` that stand for their text in ``keys(key, head, n, ids)``.

    Texts stay where they are unless there are more than ``most`` others.
    """
    n = keys.agg(F.max("n")).first()[0]
    others = written(keyed.select("id", "key").join(keys, "key", "left").filter("head IS NULL OR id <> head").select("id", "key"), "copies")
    if (n or 1) == 1 and others.count() <= most:
        return keyed.join(F.broadcast(others), ["id", "key"], "left_anti").select("id", "text")
    return keyed.join(keys.select("key", F.col("head").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key", "id"]).select("id", "text")


def _keyed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts folded, with a digest that moves in their place; and of each digest the smallest id, how often that has it, and the number of ids."""
    keyed = _folded(texts.filter("text IS NOT NULL")).withColumn("key", F.unhex(F.sha2("text", 256)))
    return keyed, _keys(keyed)


def _keys(keyed: DataFrame) -> DataFrame:
    each = keyed.select("key", "id").groupBy("key", "id").agg(F.count("*").alias("n"))
    return written(each.groupBy("key").agg(F.min("id").alias("head"), F.min_by("n", "id").alias("n"), F.count("*").alias("ids")), "keys")


def screened_against(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """What becomes of each of ``incoming(id, text)`` beside ``existing(id, text)``: id, action, match_id, similarity.

    ``skip`` where a stored text is equal but for case and spaces, or nearly the
    same (three quarters of the trigrams); else ``keep``.  The match is the most
    similar stored text, of several the smallest id.  Null and blank texts are
    skipped without a match; incoming ones are not compared with each other.
    """
    # Folded once: the texts are read several times.
    folded = (_folded(t.select("id", F.coalesce("text", F.lit("")).alias("text"))) for t in (incoming, existing))
    come, there = (written(t.select("id", "text", F.unhex(F.sha2("text", 256)).alias("key"), (F.col("text") == "").alias("blank")), "folded", "zstd") for t in folded)
    new, old = (t.filter("NOT blank").select("id", "text", "key") for t in (come, there))
    new_keys, old_keys = _keys(new), _keys(old)
    held = old_keys.select("key", F.col("head").alias("match_id"))
    # One of each text is compared, whatever the copies.
    rest = written(new_keys.join(held, "key", "left_anti"), "rest")
    pairs = _met(_heads(new, rest), _heads(old, old_keys), fixed.NEAR_DUPLICATE, True)
    best = pairs.groupBy(F.col("a").alias("head")).agg(F.max(F.struct("similarity", (-F.col("b")).alias("minus"))).alias("m")).select("head", (-F.col("m.minus")).alias("match_id"), "m.similarity")
    near = rest.join(best, "head").select("key", "match_id", "similarity")
    found = new_keys.join(held, "key").select("key", "match_id", F.lit(1.0).alias("similarity")).unionByName(near)
    told = come.select("id", "blank", "key").join(found, "key", "left")
    action = F.when(F.col("blank") | F.col("match_id").isNotNull(), "skip").otherwise("keep")
    return told.select("id", action.alias("action"), "match_id", F.round("similarity", 6).alias("similarity"))


def links_per_text(texts: DataFrame) -> DataFrame:
    """id, class_id of equal texts, number of near duplicates and of contradiction candidates among the other classes.

    Equal normalised texts form one class; only its smallest id is compared.
    """
    keyed, keys = _keyed(texts)
    counts = _compared(_heads(keyed, keys), None, fixed.CONTRADICTION, "counts", fixed.NEAR_DUPLICATE)
    sums = counts.groupBy(F.col("a").alias("head")).agg(F.sum("near").alias("near"), F.sum("related").alias("related"))
    of = keyed.select("id", "key").join(keys.select("key", "head"), "key")
    return of.join(sums, "head", "left").select("id", F.col("head").alias("class_id"), F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("related", F.lit(0)).alias("related"))


def shared_words(left: DataFrame, right: DataFrame, least: int = 2, top: int = 3) -> DataFrame:
    """For each left row the right rows with at least ``least`` words in common: left_id, right_id, shared, rank.

    Both have id and words (arrays of distinct words).
    """
    x = left.select(F.col("id").alias("left_id"), F.explode("words").alias("word"))
    y = right.select(F.col("id").alias("right_id"), F.explode("words").alias("word"))
    met = x.join(y, "word").groupBy("left_id", "right_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    w = Window.partitionBy("left_id").orderBy(F.desc("shared"), "right_id")
    return met.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < top)
