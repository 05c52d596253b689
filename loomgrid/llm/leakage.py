"""Evaluation texts leaking into training text.

Both sides are sequences of words.  Query windows (every run of ``window`` words
of an item, or the whole item) are embedded by the CGK random walk: the walk
reads a symbol, writes it, and moves on or stays by a random bit that depends on
step and symbol, so sequences at a small edit distance soon walk in step and end
at a small Hamming distance.  A key is a sample of positions of the embedding;
``reps`` independent walks and samples give as many keys, and their number is
chosen by simulated edits until the asked recall is reached (with no edits
allowed, equal windows have equal keys and one key finds them all).  Corpus
windows with an equal key are then verified by their exact edit distance.

The corpus is read in one pass and never shuffled.  The keys of the items are
broadcast in blocks of at most ITEM_CHARS characters of passages, one pass over
the corpus for each block, so the broadcast is bounded whatever the items.
Before the walk, windows are dropped that cannot match: of n words with e edits a
run of (n - e) / (e + 1) stays untouched, so a window without such a run of any
query window around it is no match, nor is one with more words unknown to all
items than edits allowed.  This loses nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Simulated copies that measure the recall for a window length, whatever the number of its windows.
COPIES = 400
#: Bound on the passages whose windows are broadcast at once.
ITEM_CHARS = 1_000_000
#: Corpus windows that walk at once, at most.
WALK = 50_000
#: Characters of texts that are matched together; a longer text is matched alone.
PART_CHARS = 16_000_000
MIN_WORDS = 12
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def cgk(x: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings (rows x 3L) of rows of L word numbers; 0 fills up when a walk has read all."""
    n, length = x.shape
    padded = np.concatenate([x, np.zeros((n, 1), x.dtype)], axis=1)
    at, out, rows = np.zeros(n, np.int64), np.empty((n, 3 * length), x.dtype), np.arange(n)
    for j in range(3 * length):
        s = padded[rows, at]
        out[:, j] = s
        at = np.minimum(at + (_mix(s, seed * 1_000_003 + j) & np.uint64(1)).astype(np.int64), length)
    return out


def window_keys(x: np.ndarray, rep: int, sample: int) -> np.ndarray:
    """One 64-bit key for each row: a hash of ``sample`` positions of its embedding in repetition ``rep``."""
    e = cgk(x, rep + 1)
    pos = np.random.default_rng(7919 * (rep + 1) + x.shape[1]).choice(e.shape[1], size=min(sample, e.shape[1]), replace=False)
    h = np.zeros(len(x), np.uint64)
    for p in np.sort(pos):
        h = _mix(h ^ e[:, p].astype(np.uint64), int(p) + 17)
    return h


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the smallest number of word edits that turn ``a`` into some stretch of ``b``; negative numbers in ``b`` match nothing."""
    prev, cols = np.zeros((len(a), b.shape[1] + 1), np.int32), np.arange(b.shape[1] + 1, dtype=np.int32)
    for i in range(a.shape[1]):
        cur = np.empty_like(prev)
        cur[:, 0] = i + 1
        np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (b != a[:, i : i + 1]), out=cur[:, 1:])
        # Insertions run along the row: a running minimum of value minus column.
        prev = np.minimum.accumulate(cur - cols, axis=1) + cols
    return prev.min(axis=1)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """As ``edit_distances`` for one pair; more than ``most`` counts as most + 1."""
    return min(int(edit_distances(np.array([a]), np.array([b], np.int64))[0]), most + 1)


@dataclass
class Index:
    """Query windows of one block of items, by window length."""

    vocab: dict[str, int]
    by_len: dict[int, dict]
    #: Words of a run, and the hashes of the runs of all windows.
    gram: int
    grams: np.ndarray


def _reps_for(x: np.ndarray, edits: int, sample: int, recall: float, most: int) -> tuple[int, int]:
    """(repetitions, sampled positions) after which simulated copies with ``edits`` random edits share a key with at least the asked recall.

    A length with few windows has several copies of each.  Where ``most`` repetitions
    do not reach the recall, keys of fewer positions are taken, which meet more often
    and leave more to verify; where none reach it, that is an error.
    """
    if edits == 0:
        return 1, sample
    rng = np.random.default_rng(5)
    src = x[np.resize(rng.permutation(len(x)), COPIES)]
    top = int(x.max()) + 1
    noisy = src.copy()
    for r in noisy:
        for _ in range(edits):
            p, kind = rng.integers(len(r)), rng.integers(3)
            if kind == 0:
                r[p] = rng.integers(1, top)
            elif kind == 1:
                r[p:-1] = r[p + 1 :].copy()
                r[-1] = rng.integers(1, top)
            else:
                r[p + 1 :] = r[p:-1].copy()
                r[p] = rng.integers(1, top)
    while True:
        hit = np.zeros(len(src), bool)
        for rep in range(most):
            hit |= window_keys(src, rep, sample) == window_keys(noisy, rep, sample)
            if hit.mean() >= recall:
                return rep + 1, sample
        if sample == 1:
            raise ValueError(f"{most} repetitions find {hit.mean():.2f} of simulated copies of {x.shape[1]} words with {edits} edits; {recall} are asked")
        sample = max(1, sample * 3 // 4)


def build_index(items: list[tuple[int, str]], window: int | None, edit_rate: float, recall: float, most_reps: int = 48) -> Index:
    """Index the windows of the items; window None takes each item whole."""
    vocab: dict[str, int] = {}
    rows: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
    for item, passage in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(passage)]
        n = window or len(ids)
        if n == 0:
            continue
        for p in range(len(ids) - n + 1):
            rows[n].append((item, p, ids[p : p + n]))
    edits_of = {n: int(n * edit_rate) for n in rows}
    # One length of untouched runs serves all windows: the shortest that any of them must keep.
    gram = min((-(-(n - e) // (e + 1)) for n, e in edits_of.items()), default=1)
    by_len = {}
    for n, r in rows.items():
        x, edits = np.array([v for *_, v in r], np.int64), edits_of[n]
        sample = 3 * n if edits == 0 else max(6, (3 * n) // (2 * edits + 2))
        reps, sample = _reps_for(x, edits, sample, recall, most_reps)
        keys = []
        for rep in range(reps):
            k = window_keys(x, rep, sample)
            o = np.argsort(k, kind="stable")
            keys.append((k[o], o))
        grams = np.unique(_run_hashes(x.ravel(), gram)[(np.arange(len(x))[:, None] * n + np.arange(n - gram + 1)).ravel()])
        by_len[n] = {"x": x, "item": np.array([v[0] for v in r]), "pos": np.array([v[1] for v in r]), "edits": edits, "sample": sample, "keys": keys, "grams": grams}
    every = np.unique(np.concatenate([np.empty(0, np.uint64), *(q["grams"] for q in by_len.values())]))
    return Index(vocab, by_len, gram, every)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _run_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k numbers."""
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k if len(h) else 0):
        h = _mix(h ^ ids[j : j + len(h)].astype(np.uint64), j + 3)
    return h


def match_all(ix: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """For each text its verified windows (item_id, item_pos, doc_pos, edits).

    edits is 0 only where the window itself equals that of the item.  All texts
    lie in one array of word numbers, each followed by as many blanks (0) as edits
    are allowed, so a copy that lost its last words still fills a window.
    """
    get = ix.vocab.get
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not ix.by_len:
        return out
    pad = max(q["edits"] for q in ix.by_len.values())
    lists = [[get(w, 0) for w in words(t)] for t in texts]
    size = np.array([len(a) for a in lists])
    ids = np.array([v for a in lists for v in (*a, *[0] * pad)], np.int64)
    start = np.cumsum(size + pad) - size - pad
    owner = np.repeat(np.arange(len(texts)), size + pad)
    first, last = start[owner], (start + size)[owner]
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    h = _run_hashes(ids, ix.gram)
    runs = np.flatnonzero(_among(h, ix.grams))
    for n, q in ix.by_len.items():
        e = q["edits"]
        own = runs[_among(h[runs], q["grams"])]
        # Windows that may hold such a run, up to the edits before and after it, in the run's text.
        at = own[:, None] + np.arange(-(n - ix.gram) - e, e + 1)
        keep = (at >= first[own][:, None]) & (at + n <= last[own][:, None] + e) & (own[:, None] + ix.gram <= last[own][:, None])
        at = np.unique(at[keep])
        at = at[unknown[np.minimum(at + n, last[at])] - unknown[at] + np.maximum(at + n - last[at], 0) <= e] if len(at) else at
        for part in range(0, len(at), WALK):
            _walk(q, ids, at[part : part + WALK], owner, start, start + size, out)
    return out


def _walk(q: dict, ids: np.ndarray, at: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray, out: list) -> None:
    """Embed the windows at the given places, meet equal keys, and verify."""
    e, n = q["edits"], q["x"].shape[1]
    x = np.concatenate([ids, np.zeros(n, np.int64)])[at[:, None] + np.arange(n)]
    met = [np.empty(0, np.int64)]
    for rep, (keys, order) in enumerate(q["keys"]):
        k = window_keys(x, rep, q["sample"])
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        n_met = hi - lo
        i = np.repeat(np.arange(len(x)), n_met)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n_met) - n_met, n_met) + np.repeat(lo, n_met)]
        met.append(i * len(q["x"]) + j)
    pairs = np.unique(np.concatenate(met))
    for part in range(0, len(pairs), WALK):
        i, j = np.divmod(pairs[part : part + WALK], len(q["x"]))
        equal = (q["x"][j] == x[i]).all(axis=1)
        edits = np.where(equal, 0, e + 1)
        near = np.flatnonzero(~equal) if e else np.empty(0, np.int64)
        if len(near):
            s = at[i[near]]
            place = s[:, None] + np.arange(-e, n + e)
            inside = (place >= start[owner[s]][:, None]) & (place < stop[owner[s]][:, None])
            b = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], -1)
            d = edit_distances(q["x"][j[near]], b)
            edits[near] = np.where(d > 0, d, e + 1)  # an equal window a step aside comes out itself
        for w in np.flatnonzero(edits <= e).tolist():
            s, row = int(at[i[w]]), int(j[w])
            d = int(owner[s])
            out[d].append((int(q["item"][row]), int(q["pos"][row]), s - int(start[d]), int(edits[w])))


def match(ix: Index, text: str | None) -> list[tuple[int, int, int, int]]:
    return match_all(ix, [text])[0]


def _in_parts(ix: Index, ids: list, texts: list[str | None]) -> Iterator[tuple]:
    """(id, matches) of each text, taken together up to PART_CHARS characters."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= PART_CHARS):
            size += len(texts[b] or "")
            b += 1
        yield from zip(ids[a:b], match_all(ix, texts[a:b]), strict=True)
        a = b


def leak_matches(
    docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", window: int | None = MIN_WORDS, edit_rate: float = 0.0, recall: float = 0.95
) -> DataFrame:
    """(item_id, doc_id, n_windows, n_exact, item_from, item_to, doc_from, edits) for each item and document with a verified window.

    n_exact of the n_windows verified windows are equal word by word.  item_from and
    item_to bound the leaked words of the passage (0 and 0 where it was sought
    whole) over equal windows where there are any, else over edited ones; doc_from
    is the first leaking word of the document, likewise; edits the least number of edits.
    Null and empty texts and passages, and passages shorter than the window,
    match nothing; repeated items and documents come out under each id.
    """
    spark = docs.sparkSession
    p = items.where(F.col(passage_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(passage_col).alias("passage"))
    total = p.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-int(total) // ITEM_CHARS))
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "item_id long, doc_id long, n_windows int, n_exact int, item_from int, item_to int, doc_from int, edits int"

    def one(ix_b):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = ix_b.value
            for b in batches:
                rows = []
                for i, all_ in _in_parts(ix, b.column(0).to_pylist(), b.column(1).to_pylist()):
                    got = defaultdict(list)
                    for m in all_:
                        got[m[0]].append(m)
                    for item, ms in got.items():
                        best = [m for m in ms if m[3] == 0] or ms
                        lo, hi = min(m[1] for m in best), max(m[1] for m in best)
                        rows.append((item, i, len(ms), sum(m[3] == 0 for m in ms), lo, hi + (window or 0), min(m[2] for m in best), min(m[3] for m in ms)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                types = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        return run

    out = None
    for k in range(blocks):
        part = p.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k).collect()
        ix = spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in part], window, edit_rate, recall))
        got = src.mapInArrow(one(ix), schema)
        out = got if out is None else out.unionByName(got)
    return out


def planted(items: DataFrame, copies: int, edit_rate: float, item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """(doc_id, item_id, n_words, text): documents that each hold one passage with int(n * edit_rate) random edits between other words.

    doc_id tells item and copy apart; the edits follow from the item's id and the
    copy's number, so the same items always give the same documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, passage in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(passage)
                for c in range(copies if w else 0):
                    rng = np.random.default_rng([abs(item), c])
                    v = list(w)
                    for _ in range(int(len(w) * edit_rate)):
                        p, kind = int(rng.integers(len(v))), int(rng.integers(3))
                        v[p : p + (kind != 2)] = [] if kind == 1 else [w[int(rng.integers(len(w)))]]
                    around = [[w[int(rng.integers(len(w)))] for _ in range(20)] for _ in range(2)]
                    rows.append((item * copies + c, item, len(w), " ".join([*around[0], *v, *around[1]])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "item_id", "n_words", "text"])

    src = items.where(F.col(passage_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(passage_col).alias("passage")).distinct()
    return src.mapInArrow(run, "doc_id long, item_id long, n_words int, text string")


def recall_of(items: DataFrame, copies: int = 5, edit_rate: float = 0.1, recall: float = 0.95) -> DataFrame:
    """(n_words, n_planted, n_found, recall) of whole passages sought in documents with edited copies of them, by length."""
    docs = planted(items, copies, edit_rate)
    got = leak_matches(docs, items, window=None, edit_rate=edit_rate, recall=recall).select("item_id", "doc_id").distinct().withColumn("_hit", F.lit(1))
    j = docs.select("item_id", "doc_id", "n_words").join(got, ["item_id", "doc_id"], "left")
    out = j.groupBy("n_words").agg(F.count("*").alias("n_planted"), F.count("_hit").alias("n_found"))
    return out.withColumn("recall", F.col("n_found") / F.col("n_planted"))


def leaked_items(matches: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_docs, leaked_from, leaked_to) of the items that leaked."""
    m = matches.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("item_from").alias("leaked_from"), F.max("item_to").alias("leaked_to"))
    return m.join(items.select("item_id", "suite"), "item_id").select("item_id", "suite", "n_docs", "leaked_from", "leaked_to")
