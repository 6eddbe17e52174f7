"""Operator 13: runs of words that repeat with a period, by harmonic grid probing.

A run of period p and at least 2p words holds two neighbouring points jp and (j + 1)p of the grid of p. So for every p up to
n / 2 only the grid is probed (n / p words, n log n in all), in blocks of bounded size for many texts at once; hits that can
belong to a run long enough survive a look at a few words beside them, and survivors are extended both ways by comparing
arrays in growing chunks. Periods come in ascending order, and grid points within a run that is already found, whose
period divides p, are skipped: they belong to the same run. A text is one row and never leaves its task.

Defined results: a null or empty text, or one without words, has no words and no runs; its collapsed text is empty. A null
doc_id takes no rewriting by `looped`. Repeated rows give equal rows; an empty table gives an empty result; extra
columns are ignored by the query. Words are compared by 64-bit hashes, as written (no lower-casing).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import pick, table
from skyloom.llm.words import Reader, slabs

#: Least words of a run, and least repetitions of its period.
LEAST, TIMES = 12, 2
#: Grid points probed at once, words compared first when a hit is extended, words looked at beside a hit.
BLOCK, CHUNK, BESIDE = 1 << 20, 64, 3


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """The original word that stands at each place of a rewritten text of n words; None if the text stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def stretch(w: np.ndarray, lo: int, hi: int, at: int, p: int) -> tuple[int, int]:
    """The longest [s, e) around `at` in which w[i] == w[i + p] for all i, within the text [lo, hi)."""
    e, step = at, CHUNK
    while e < hi - p:
        to = min(hi - p, e + step)
        bad = np.flatnonzero(w[e:to] != w[e + p : to + p])
        if len(bad):
            e += int(bad[0])
            break
        e, step = to, 2 * step
    s, step = at, CHUNK
    while s > lo:
        to = max(lo, s - step)
        bad = np.flatnonzero(w[to:s] != w[to + p : s + p])
        if len(bad):
            s = to + int(bad[-1]) + 1
            break
        s, step = to, 2 * step
    return s, e


def grid(sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, period) in blocks whose grids hold about BLOCK points, in the order of text and period."""
    periods = sizes // times
    bounds = np.r_[0, np.cumsum(periods)]
    at = 0
    while at < bounds[-1]:
        # periods of a block: as many as fit, at least one
        to = min(int(bounds[-1]), at + BLOCK // 8)
        number = np.arange(at, to)
        text = np.searchsorted(bounds, number, "right") - 1
        p = number - bounds[text] + 1
        ends = np.cumsum((sizes[text] - 1) // p)
        fits = max(1, int(np.searchsorted(ends, BLOCK, "right")))
        yield text[:fits], p[:fits]
        at += fits


def survivors(w: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place of jp): grid hits that may belong to a long enough run, by text, period and place."""
    sizes = np.diff(bounds)
    for text, p in grid(sizes, times):
        points = (sizes[text] - 1) // p
        of = np.repeat(np.arange(len(p)), points)
        j = np.arange(len(of)) - np.repeat(np.cumsum(points) - points, points)
        at = bounds[text[of]] + j * p[of]
        hit = w[at] == w[at + p[of]]
        at, of = at[hit], of[hit]
        lo, hi, q = bounds[text[of]], bounds[text[of] + 1], p[of]
        # the words that equal those a period on form a stretch of `want` around the hit: half of it lies on one side
        want = np.maximum(least - q, (times - 1) * q)
        half = want // 2
        right, left = np.ones(len(at), bool), np.ones(len(at), bool)
        for step in [np.minimum(half, k) for k in range(1, BESIDE + 1)] + [half // 4, half // 2, half]:
            r, l = at + step, at - step  # noqa: E741
            right &= (r + q < hi) & (w[np.minimum(r, len(w) - 1)] == w[np.minimum(r + q, len(w) - 1)])
            left &= (l >= lo) & (w[np.maximum(l, 0)] == w[np.maximum(l, 0) + q])
        ok = right | left
        yield text[of[ok]], q[ok], at[ok]


def runs_of_texts(w: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """For each text that has any, its runs (start, length, period), by start and period; words are numbers in `w`."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for text, period, place in survivors(w, bounds, least, times):
        live = np.ones(len(text), bool)
        if not len(text):
            continue
        edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        for begin, end in zip(edges.tolist(), np.r_[edges[1:], len(text)].tolist(), strict=True):
            t = int(text[begin])
            lo, hi = int(bounds[t]), int(bounds[t + 1])
            part_p, part_at, part_live = period[begin:end], place[begin:end], live[begin:end]

            def skip(s: int, e: int, q: int, part_p=part_p, part_at=part_at, part_live=part_live) -> None:
                part_live &= ~((part_at >= s) & (part_at + part_p < e) & (part_p % q == 0))

            # runs of this text from an earlier block
            for s, n, q in found.get(t, []):
                skip(lo + s, lo + s + n, q)
            k = 0
            while True:
                later = np.flatnonzero(part_live[k:])
                if not len(later):
                    break
                k += int(later[0])
                p, at = int(part_p[k]), int(part_at[k])
                s, e = stretch(w, lo, hi, at, p)
                n = e - s + p
                if n >= max(least, times * p):
                    found.setdefault(t, []).append((s - lo, n, p))
                    skip(s, s + n, p)
                else:
                    # other hits of the same stretch belong to the same run, which is too short
                    part_live &= ~((part_p == p) & (part_at >= s) & (part_at < e))
                k += 1
    return {t: sorted(r, key=lambda x: (x[0], x[2])) for t, r in found.items()}


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: not those that a run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        depth[s + q] += 1
        depth[s + length] -= 1
    return np.cumsum(depth[:n]) == 0


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, rewrite: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The runs of each text of `docs` (doc_id, text): how many, the longest, digests of all and of the text without repeats, and `runs` and `collapsed`.

    `rewrite` has `looped` applied to the words first. Columns that are not asked for are not built.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        reader.lower = np.arange(256, dtype=np.uint8)
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                ids = batch.column("doc_id")[slice(*slab.rows)].to_pylist()
                w, bounds = slab.hashes.copy(), slab.bounds
                source = {}
                if rewrite:
                    for t, doc_id in enumerate(ids):
                        at = looped(int(bounds[t + 1] - bounds[t]), doc_id)
                        if at is not None:
                            source[t] = at + bounds[t]
                            w[bounds[t] : bounds[t + 1]] = slab.hashes[source[t]]
                runs = runs_of_texts(w, bounds, least, times)
                data, rows = slab.raw.tobytes(), []
                starts, stops = slab.starts, slab.stops
                edge = np.r_[0, slab.ends]
                for t, doc_id in enumerate(ids):
                    own = runs.get(t, [])
                    if t in source or own:
                        words = source.get(t, np.arange(bounds[t], bounds[t + 1]))[kept_words(int(bounds[t + 1] - bounds[t]), own)]
                        text = b" ".join([data[a:b] for a, b in zip(starts[words].tolist(), stops[words].tolist(), strict=True)])
                    else:
                        text = b" ".join(data[edge[t] : edge[t + 1]].split())
                    best = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                    rows.append((doc_id, len(own), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
                types = [pa.int64()] * 6 + [pa.string()] * 2
                names = [c.split()[0] for c in REPORT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(report, REPORT)


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, `runs` (start, length, period of each) and `text` with every run cut to its first period, for the texts of `docs`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        reader.lower = np.arange(256, dtype=np.uint8)
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                runs = runs_of_texts(slab.hashes, slab.bounds, least, times)
                data, lists, texts = slab.raw.tobytes(), [], []
                for t in range(len(slab.bounds) - 1):
                    words = np.arange(slab.bounds[t], slab.bounds[t + 1])[kept_words(int(slab.bounds[t + 1] - slab.bounds[t]), runs.get(t, []))]
                    texts.append(b" ".join([data[a:b] for a, b in zip(slab.starts[words].tolist(), slab.stops[words].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
                    lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.get(t, [])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[slice(*slab.rows)], pa.array(lists, pa.list_(kind)), pa.array(texts, pa.string())], ["doc_id", "runs", "text"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), rewrite=True)
