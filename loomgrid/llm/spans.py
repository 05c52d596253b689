"""Long exact spans shared between records, by compact windows.

Tokens are the k-character grams of a text, one at each position, under one
64-bit hash.  Among all stretches of at least ``w`` consecutive tokens, those
whose smallest hash sits at the same position c form a compact window
[l, c, r]: the node of c in the Cartesian tree over the hashes.  A text of n
tokens has about 2n/w such windows.  If two texts share a stretch of at least
w + k - 1 characters, its smallest hash is at the same place of the stretch in
both, so both have a window with that hash that covers the stretch.  An
equality join on the hash therefore finds every shared stretch with one hash
function; the position c pins the alignment, and the intervals decide at once
whether the two windows can hold a common stretch of the asked length.

Only windows whose interval meets that of a window of another text under the same
hash are carried on, with the characters around their centre, so stretches are
verified in the group of their hash, without joining texts to pairs: the token
itself by its 64-bit hash, everything around it character by character.  What a
document shares at all needs no pairs: in each group only the furthest agreement of
a member with any other one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.workspace import Workspace

MIN_CHARS = 400
#: Characters of a token. The longer, the fewer chance partners, and the more windows: 2n / (MIN_CHARS - GRAM + 1).
GRAM = 240
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Different surroundings in a group up to which all are compared with all.
FEW = 64
#: Rows of a hash that one task pairs; larger groups are cut into blocks of this size, paired block by block.
BLOCK = 2000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        p = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        q = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inv)]), dtype=np.uint64)
    return p, q


_POW = _powers(1 << 12)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of an array of code points, by a rolling polynomial."""
    global _POW
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    if len(_POW[0]) <= n:
        _POW = _powers(max(n, 2 * len(_POW[0])))
    with np.errstate(over="ignore"):
        acc = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POW[0][:n], dtype=np.uint64)
        h = acc[k - 1 :].copy()
        h[1:] -= acc[: n - k]
        h *= _POW[1][: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def compact_windows(h: np.ndarray, w: int) -> list[tuple[int, int, int, bool]]:
    """(l, c, r, tie) of the compact windows of at least w tokens; c is the leftmost smallest hash of every stretch it serves.

    The top of the Cartesian tree is built by splitting at the minimum; parts
    shorter than w are never entered.  In a stretch that repeats with a period,
    equal minima follow each other; of such a run the first two and the last two are kept,
    which align whatever two texts share of it; such an alignment may reach beyond the
    interval of its window, which ``tie`` says.
    """
    out: list[tuple[int, int, int, bool]] = []
    todo = [(0, len(h))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < w:
            continue
        c = lo + int(h[lo:hi].argmin())
        ties = np.flatnonzero(h[c:hi] == h[c]) + c
        if len(ties) == 1:
            out.append((lo, c, hi - 1, False))
            todo += [(lo, c), (c + 1, hi)]
            continue
        gap = np.diff(ties)
        for j, t in enumerate(ties.tolist()):
            left = lo if j == 0 else int(ties[j - 1]) + 1
            inside = 1 < j < len(ties) - 2 and gap[j - 1] == gap[j] and gap[j] <= w
            if not inside and hi - left >= w:
                out.append((left, t, hi - 1, True))
            if t - left >= w:
                todo.append((left, t))
        todo.append((int(ties[-1]) + 1, hi))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, k: int) -> DataFrame:
    """(key, doc, c, before, after) of every compact window of every text.

    before and after: how many characters a shared stretch may reach to the left of c
    and to the right of c + k inside the window, at most min_chars - k, since a
    stretch of min_chars reaches no further.
    """
    w, side = min_chars - k + 1, min_chars - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, doc, pos, before, after = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = gram_hashes(_codes(t), k)
                for lo, c, r, tie in compact_windows(h, w):
                    key.append(h[c])
                    doc.append(i)
                    pos.append(c)
                    before.append(side if tie else min(c - lo, side))
                    after.append(side if tie else min(r - c, side))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (pos, before, after))],
                names=["key", "doc", "c", "before", "after"],
            )

    src = docs.where(F.length(text_col) >= min_chars).select(F.col(id_col).cast("long"), F.col(text_col))
    return src.mapInArrow(run, "key long, doc long, c int, before int, after int")


def _common(a: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a with ``row``; code 0 is beyond a text's end and matches nothing."""
    diff = (a != row) | (row == 0)
    return np.where(diff.any(axis=1), diff.argmax(axis=1), a.shape[1])


def _array(texts: list[str], side: int, left: bool) -> np.ndarray:
    out = np.zeros((len(texts), side), np.uint32)
    for i, x in enumerate(texts):
        v = _codes(x) + 1
        out[i, : len(v)] = v[::-1] if left else v
    return out


class _Group:
    """Windows of one hash, or of two of its cells, that one task compares: (key, p, q, cell, doc, c, left, right)."""

    def __init__(self, rows: list[tuple], min_chars: int, k: int):
        rows.sort(key=lambda r: (r[4], r[5]))
        self.k, self.least, self.across = k, min_chars, rows[0][1] != rows[0][2]
        self.doc, self.pos, self.cell = (np.array([r[i] for r in rows]) for i in (4, 5, 3))
        # Equal surroundings are compared once.
        ids: dict = {}
        self.cid = np.array([ids.setdefault((r[3], r[6], r[7]), len(ids)) for r in rows])
        self.ctx_cell = np.array([u[0] for u in ids])
        self.left, self.right = _array([u[1] for u in ids], min_chars - k, True), _array([u[2] for u in ids], min_chars - k, False)

    def agreements(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(surroundings, agreement to the left and to the right with all others, which reach the asked length)"""
        for u in range(len(self.left)):
            ln, rn = _common(self.left, self.left[u]), _common(self.right, self.right[u])
            ok = ln + rn + self.k >= self.least
            yield u, ln, rn, ok & (self.ctx_cell != self.ctx_cell[u]) if self.across else ok

    def pairs(self) -> list[tuple]:
        res = []
        for u, ln, rn, ok in self.agreements():
            yours = np.flatnonzero(ok[self.cid])
            for i in np.flatnonzero(self.cid == u).tolist():
                j = yours[self.doc[yours] > self.doc[i]]
                if len(j):
                    lo = ln[self.cid[j]]
                    res.append((np.full(len(j), self.doc[i]), self.doc[j], self.pos[i] - lo, self.pos[j] - lo, lo + self.k + rn[self.cid[j]]))
        return res

    def extents(self) -> list[tuple]:
        """(doc, start, end) of the furthest agreement of each window with one of another document.

        Few surroundings are compared with each other, many by sorting: both give the same pieces.
        """
        if len(self.left) > FEW:
            return self.extents_by_sorting()
        res = []
        n = len(self.left)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(first, self.cid, self.doc)
        np.maximum.at(last, self.cid, self.doc)
        one = first == last
        for u, ln, rn, ok in self.agreements():
            v = np.flatnonzero(ok)
            many, single = v[~one[v]], v[one[v]]
            l0, r0 = (int(ln[many].max()), int(rn[many].max())) if len(many) else (-1, -1)
            mine = np.flatnonzero(self.cid == u)
            for part in range(0, len(mine), 256):
                m = mine[part : part + 256]
                other = first[single][None, :] != self.doc[m][:, None]
                hit = other.any(axis=1) if len(single) else np.zeros(len(m), bool)
                lo = np.maximum(np.where(other, ln[single][None, :], -1).max(axis=1, initial=-1), l0)
                hi = np.maximum(np.where(other, rn[single][None, :], -1).max(axis=1, initial=-1), r0)
                got = hit | (l0 >= 0)
                res.append((self.doc[m][got], self.pos[m][got] - lo[got], self.pos[m][got] + self.k + hi[got]))
        return res


    def extents_by_sorting(self) -> list[tuple]:
        """The same in time linear in the windows: x characters to the left and the rest to the right make a stretch of the asked length, and windows that agree in it lie next to each other when sorted by its hash."""
        side = self.least - self.k
        u = self.cid
        ends = [(a != 0).sum(axis=1) for a in (self.left, self.right)]
        hashes = []
        with np.errstate(over="ignore"):
            for a in (self.left, self.right):
                h = np.zeros((len(a), side + 1), np.uint64)
                for j in range(side):
                    h[:, j + 1] = (h[:, j] + a[:, j].astype(np.uint64) + np.uint64(1)) * _BASE
                    h[:, j + 1] ^= h[:, j + 1] >> np.uint64(29)
                hashes.append(h)
            best_l, best_r = np.full(len(u), -1), np.full(len(u), -1)
            for x in range(side + 1):
                rows = np.flatnonzero((ends[0][u] >= x) & (ends[1][u] >= side - x))
                if len(rows) < 2:
                    continue
                key = (hashes[0][u[rows], x] * np.uint64(0xBF58476D1CE4E5B9)) ^ hashes[1][u[rows], side - x]
                o = np.argsort(key, kind="stable")
                rows, key = rows[o], key[o]
                same = (key[1:] == key[:-1]) & (self.left[u[rows[1:]], :x] == self.left[u[rows[:-1]], :x]).all(axis=1) & (self.right[u[rows[1:]], : side - x] == self.right[u[rows[:-1]], : side - x]).all(axis=1)
                start = np.flatnonzero(np.concatenate([[True], ~same]))
                size = np.diff(np.concatenate([start, [len(rows)]]))
                # A window has a partner where its run holds another document, and across two cells one of the other cell.
                lo, hi = (np.repeat(f.reduceat(self.doc[rows], start), size) for f in (np.minimum, np.maximum))
                hit = lo != hi
                if self.across:
                    lo, hi = (np.repeat(f.reduceat(self.cell[rows], start), size) for f in (np.minimum, np.maximum))
                    hit &= lo != hi
                best_l[rows[hit]] = x
                first = rows[hit & (best_r[rows] < 0)]
                best_r[first] = side - x
        got = np.flatnonzero(best_l >= 0)
        return [(self.doc[got], self.pos[got] - best_l[got], self.pos[got] + self.k + best_r[got])] if len(got) else []


def _groups(docs: DataFrame, id_col: str, text_col: str, min_chars: int, k: int, ws: Workspace | None, what: str, schema: str) -> DataFrame:
    """Compare the windows of each hash and give what ``_Group.<what>`` says."""
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "spans")
    side = min_chars - k
    keys = ws.write(window_keys(docs, id_col, text_col, min_chars, k), "keys")
    # Keys seen in one text only are nobody's; min and max tell without a distinct count, with map-side partials.
    many = keys.groupBy("key").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi"), F.count("*").alias("n")).where("_lo < _hi").select("key", "n")
    shared = ws.write(keys.join(many, "key"), "shared", replaces="keys")
    # The interval join: two windows may hold a common stretch only if their intervals around the centre have that
    # length in common. It joins the shapes of windows, of which a hash has at most side * side, not the windows.
    shapes = shared.groupBy("key", "before", "after").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    other = shapes.select("key", F.col("before").alias("_b"), F.col("after").alias("_a"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    reach = F.least("before", "_b") + F.least("after", "_a") >= side
    alone = (F.col("lo") == F.col("hi")) & (F.col("_lo") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    met = shapes.join(other, "key").where(reach & ~alone).select("key", "before", "after").distinct()
    shared = shared.join(met, ["key", "before", "after"], "left_semi")
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_t"))
    # Characters around the token; those of a document are bounded by its length.
    at = shared.groupBy("doc").agg(F.collect_list(F.struct("key", "c", "n")).alias("at"))
    ctx = text.join(at, "doc").select("doc", "_t", F.explode("at").alias("a")).select(
        F.col("a.key").alias("key"), "doc", F.col("a.c").alias("c"), F.col("a.n").alias("n"),
        F.substring("_t", F.greatest(F.col("a.c") - side, F.lit(0)) + 1, F.least(F.col("a.c"), F.lit(side))).alias("lctx"),
        F.substring("_t", F.col("a.c") + k + 1, F.lit(side)).alias("rctx"),
    )
    # A group larger than BLOCK is cut into cells, and every pair of cells meets in one task.
    cells = F.ceil(F.col("n") / BLOCK).cast("int")
    cell = F.pmod(F.xxhash64("doc"), cells).cast("int")
    met = ctx.withColumn("cell", cell).withColumn("o", F.explode(F.sequence(F.lit(0), cells - 1)))
    met = met.select("key", F.least("cell", "o").alias("p"), F.greatest("cell", "o").alias("q"), "cell", "doc", "c", "lctx", "rctx")
    fields = [x.split() for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(g: list[tuple]) -> pa.RecordBatch | None:
            if len(g) < 2:
                return None
            group = _Group(g, min_chars, k)
            res = getattr(group, what)() if group.doc[0] != group.doc[-1] else []
            if not res:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), types[t]) for x, (_, t) in zip(zip(*res, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        now, g = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:3] != now:
                    if (out := flush(g)) is not None:
                        yield out
                    now, g = r[:3], []
                g.append(r)
        if (out := flush(g)) is not None:
            yield out

    return met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, schema)


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, k: int = GRAM, ws: Workspace | None = None) -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, length): stretches of at least min_chars equal characters, doc_a < doc_b.

    length stops at min_chars beyond the pinned token on either side; the whole
    extent follows from ``merge_spans``.  Each stretch may come out once per
    window that covers it.  Null, empty and shorter texts share nothing; exact
    copies share their whole text; texts of any length are processed whole.
    """
    return _groups(docs, id_col, text_col, min_chars, k, ws, "pairs", "doc_a long, doc_b long, start_a int, start_b int, length int")


def shared_extents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, k: int = GRAM, ws: Workspace | None = None) -> DataFrame:
    """(doc, s, e): pieces of each document that stand in some other document, without naming it.

    As many rows as ``shared_spans`` has windows, not pairs, so a text in a million documents gives a million rows.
    """
    return _groups(docs, id_col, text_col, min_chars, k, ws, "extents", "doc long, s int, e int")


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, length): the pieces of ``shared_spans`` united to whole stretches.

    Pieces of one pair that lie on one alignment and overlap or touch are one stretch.
    """
    from pyspark.sql import Window as W

    pair = ["doc_a", "doc_b", "shift"]
    one = spans.withColumn("shift", F.col("start_a") - F.col("start_b")).groupBy(*pair, "start_a").agg(F.max(F.col("start_a") + F.col("length")).alias("end"))
    by = W.partitionBy(*pair).orderBy("start_a")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    opens = one.withColumn("opens", F.coalesce((F.col("start_a") > before).cast("int"), F.lit(1)))
    runs = opens.withColumn("run", F.sum("opens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*pair, "run").agg(F.min("start_a").alias("start_a"), F.max("end").alias("end"))
    return out.select("doc_a", "doc_b", "start_a", (F.col("start_a") - F.col("shift")).alias("start_b"), (F.col("end") - F.col("start_a")).alias("length"))


def span_pairs(spans: DataFrame) -> DataFrame:
    """(doc_a, doc_b), each pair once."""
    return spans.select("doc_a", "doc_b").distinct()


def shared_portion(extents: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shared_chars, n_chars, portion) of every document that shares a stretch with another.

    Pieces of one document are united by a running maximum of their ends.
    """
    from pyspark.sql import Window as W

    iv = extents.groupBy("doc", "s").agg(F.max("e").alias("e"))
    seen = F.coalesce(F.max("e").over(W.partitionBy("doc").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cover = iv.withColumn("_seen", seen).groupBy("doc").agg(F.sum(F.greatest(F.col("e") - F.greatest("s", "_seen"), F.lit(0))).alias("shared_chars"))
    size = docs.select(F.col(id_col).cast("long").alias("doc"), F.length(text_col).cast("long").alias("n_chars"))
    out = cover.join(size, "doc")
    return out.select(F.col("doc").alias("doc_id"), "shared_chars", "n_chars", (F.col("shared_chars") / F.col("n_chars")).alias("portion"))
