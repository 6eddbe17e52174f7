"""Exact set-similarity join of classes that share join keys.

A class is a set of tokens in one fixed order, rarest first. Two classes meet if they share a key (a token of both
prefixes, or a band). Inside a key the rows are ordered by size, so each looks only at partners within the length filter;
place and signature filters follow. Where keys are tokens of prefixes, a pair is asked for only at the first token that both
share, so a partner is no longer than what stands from there on allows: most of the pairs of a group are never looked at.
Rows of prefixes travel in blocks, many tokens to one, since they are as many as the words of the prefixes.

Groups in which few pairs survive give these pairs, and each is verified by a join with
the whole sets. A group in which most pairs survive (near copies of one text), or with more than `MOST` rows, never
gives pairs: its classes are dealt out as pairs of chunks of bounded size, verified inside these by products of their
token matrices, and only counts of links or links that join two parts leave them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import by_runs, discard, lean, pieces_of_runs, release, small, stored
from skyloom.llm.components import connected_components

#: Rows of a group that may give pairs (places known, and not); surviving pairs a row from which a group counts as dense; classes of a chunk.
MOST, MOST_UNPLACED, DENSE, CHUNK = 1 << 16, 2048, 16, 1024
#: Pairs looked at together.
BLOCK = 1 << 20
#: Bytes of a token in a packed set: two words of a pair of sets meet in one less than once in 10**8 pairs.
WIDTH = 5
LOW = (1 << 8 * WIDTH) - 1


def packed(tokens: np.ndarray) -> bytes:
    """The low 40 bits of tokens, five bytes each, in their order."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").ravel()


#: Words of a signature, 64 bits each, and their columns.
WIDE = 4
BITS = tuple(f"b{k}" for k in range(WIDE))


def signatures(tokens: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """WIDE * 64 bits for each set (sets begin at `first`), each the parity of the tokens that hash to it: sets differ in at least as many tokens as bits."""
    if not len(first):
        return [np.zeros(0, np.int64)] * WIDE
    word, bit = (tokens >> np.uint64(6)) & np.uint64(WIDE - 1), np.uint64(1) << (tokens & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), first).view(np.int64) for k in range(WIDE)]


def shared_at_least(size_a, size_b, threshold: float):
    """Tokens that two sets of these sizes must share to reach the Jaccard similarity."""
    return np.ceil(threshold / (1 + threshold) * (size_a + size_b) - 1e-9)


def reached(common, size_a, size_b, threshold: float):
    return common >= threshold * (size_a + size_b - common) - 1e-9


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens of the prefix; 0 for sets so small that only an equal one reaches the threshold."""
    k = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    return np.where(np.ceil(threshold * (size + 1) - 1e-9) > size, 0, k)


#: Rounds of the join, by the tokens' remainders: a round shuffles that share of the prefixes.
ROUNDS = 4


#: Columns of the rows that `candidates` takes.
KEYED = "token long, class long, shape long" + "".join(f", {b} long" for b in BITS)


def prefix_arrays(batches: Iterator[pa.RecordBatch], threshold: float, turn: int, rounds: int) -> Iterator[np.ndarray]:
    """The columns of KEYED, a line each, for the prefixes of batches of class, size, signature and tokens; only tokens whose remainder by `rounds` is `turn`."""
    for batch in batches:
        if not len(batch):
            continue
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        k = prefix_length(size, threshold)
        begin = np.cumsum(size) - size
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        data = batch.column("tokens").cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        packed_tokens = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, WIDTH)
        token = unpacked(packed_tokens[np.repeat(begin, k) + place].tobytes()).view(np.int64)
        at = np.flatnonzero(token % rounds == turn)
        row = np.repeat(np.arange(len(k)), k)[at]
        of, *bits = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("class", *BITS))
        yield np.stack([token[at], of, size[row] << 32 | place[at], *bits])


def asked(table: DataFrame) -> DataFrame:
    return table.where("tokens is not null").select("class", "size", *BITS, "tokens")


def prefix_rows(table: DataFrame, threshold: float, turn: int = 0, rounds: int = 1) -> DataFrame:
    """token, class, shape (size and place) and signature for the prefix of each set of a table of class, size, signature and tokens (null: not asked).

    Only tokens whose remainder by `rounds` is `turn`.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in prefix_arrays(batches, threshold, turn, rounds):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["token", "class", "shape", *BITS])

    return asked(table).mapInArrow(lean(prefixes, at_once=False), KEYED)


#: Rows of prefixes in a block as planned, those that a task holds before it sends them on, and those of a block from which too frequent tokens are let go.
BLOCK_ROWS, SENT_ROWS, HELD_ROWS = 1 << 15, 1 << 17, 1 << 19


def block_count(table: DataFrame, threshold: float, rounds: int) -> int:
    """Into how many blocks of tokens the prefixes of one round are dealt."""
    words = table.where("size is not null").agg(F.sum("size")).first()[0] or 0
    return max(4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((1 - threshold) * words / rounds / BLOCK_ROWS))


def prefix_blocks(table: DataFrame, threshold: float, blocks: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """The rows of `prefix_rows`, packed: block (of a token's hash) and rows (their columns one after the other, 64-bit numbers)."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        block = rows[0] // rounds % blocks
        order = np.argsort(block, kind="stable")
        rows, block = rows[:, order], block[order]
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]].astype(np.int32)), pa.array([rows[:, a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())], ["block", "rows"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in prefix_arrays(batches, threshold, turn, rounds):
            if rows.shape[1]:
                held.append(rows)
                n += rows.shape[1]
            if n >= SENT_ROWS:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return asked(table).mapInArrow(lean(dealt, at_once=False), "block int, rows binary")


def surviving(of: np.ndarray, g: np.ndarray, shape: np.ndarray, bits: list[np.ndarray], threshold: float, placed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by group and shape: the pairs (i, j) that survive the filters, and whether each row's group is crowded and so gives none."""
    run = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    rows_of_run = np.bincount(run)
    most = MOST if placed else MOST_UNPLACED
    size = shape >> 32
    # of what a pair shares, its first token is this one and all else stands after it in both
    rest = size - (shape & 0xFFFFFFFF) if placed else size
    longest = np.maximum(np.floor(rest * ((1 + threshold) / threshold) - size + 1e-6).astype(np.int64), 0)
    stop = np.searchsorted(run << 32 | size, run << 32 | longest, "right")
    partners = np.where(rows_of_run[run] > most, 0, np.maximum(stop - np.arange(len(of)) - 1, 0))
    ends, hits, survivors, at = np.cumsum(partners), [], np.zeros(len(rows_of_run), np.int64), 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        # a group that is known to be dense is looked at no further
        n = np.where(survivors[run[at:to]] > DENSE * rows_of_run[run[at:to]], 0, partners[at:to])
        i = np.repeat(np.arange(at, to), n)
        j = np.repeat(np.arange(at, to) + 1 - (np.cumsum(n) - n), n) + np.arange(len(i))
        want = shared_at_least(size[i], size[j], threshold)
        ok = np.minimum(rest[i], rest[j]) >= want
        i, j, want = i[ok], j[ok], want[ok]
        room = (size[i] + size[j] - 2 * want).astype(np.int64)
        for word in bits:
            room = room - np.bitwise_count(word[i] ^ word[j])
            ok = room >= 0
            i, j, room = i[ok], j[ok], room[ok]
        survivors += np.bincount(run[i], minlength=len(survivors))
        keep = survivors[run[i]] <= DENSE * rows_of_run[run[i]]
        hits.append((i[keep], j[keep]))
        at = to
    i, j = (np.concatenate(x) if hits else np.zeros(0, np.int64) for x in (list(zip(*hits, strict=True)) or [[], []]))
    crowded = ((survivors > DENSE * rows_of_run) | (rows_of_run > most))[run]
    keep = ~crowded[i]
    return i[keep], j[keep], crowded


def candidates(keyed: DataFrame, threshold: float, placed: bool = True) -> DataFrame:
    """(a, b, token, at) of pairs (a < b) that survive the filters, and (a, null, token, null) of the classes of crowded groups.

    `keyed` has token, class, shape (size << 32 | place of the token in the set) and a signature (zeros tell nothing); places tell
    nothing unless `placed`. `at` is the token's place in a.
    """

    def crowd(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": rows["class"].to_numpy(), "b": pd.array([pd.NA] * len(rows), "Int64"), "token": rows["token"].to_numpy(), "at": pd.array([pd.NA] * len(rows), "Int32")})

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        of, g, shape = (rows[c].to_numpy() for c in ("class", "token", "shape"))
        fresh = np.r_[True, (g[1:] != g[:-1]) | (of[1:] != of[:-1]) | (shape[1:] != shape[:-1])]
        of, g, shape, bits = of[fresh], g[fresh], shape[fresh], [rows[b].to_numpy()[fresh].view(np.uint64) for b in BITS]
        i, j, crowded = surviving(of, g, shape, bits, threshold, placed)
        i, j = np.where(of[i] < of[j], i, j), np.where(of[i] < of[j], j, i)
        pairs = pd.DataFrame({"a": of[i], "b": pd.array(of[j], "Int64"), "token": g[i], "at": pd.array((shape[i] & 0xFFFFFFFF).astype(np.int32), "Int32")})
        if not crowded.any():
            return pairs
        return pd.concat([pairs, crowd(pd.DataFrame({"class": of, "token": g})[crowded])])

    def handle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, whole in pieces_of_runs(batches, "token", MOST if placed else MOST_UNPLACED):
            # a piece of a run that is too long to be held: its classes are dealt out whatever their partners
            yield found(rows) if whole else crowd(rows)

    ordered = keyed.repartition("token").sortWithinPartitions("token", "shape", "class")
    return ordered.mapInPandas(lean(handle, at_once=False), "a long, b long, token long, at int")


def block_candidates(blocks: DataFrame, threshold: float) -> DataFrame:
    """What `candidates` gives, from the packed rows of `prefix_blocks`."""

    def batch_of(a: np.ndarray, b: np.ndarray, token: np.ndarray, at: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~pair), pa.array(token), pa.array(at.astype(np.int32), mask=~pair)], ["a", "b", "token", "at"])

    def crowd(rows: np.ndarray) -> pa.RecordBatch:
        return batch_of(rows[1], rows[1], rows[0], rows[0], np.zeros(rows.shape[1], bool))

    def found(rows: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((rows[1], rows[2], rows[0]))
        key = rows[:3, order]
        order = order[np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]]
        # a token of one set alone has no pair
        same = rows[0, order[1:]] == rows[0, order[:-1]]
        rows = rows[:, order[np.r_[False, same] | np.r_[same, False]]]
        g, of, shape, *bits = rows
        if not len(g):
            return crowd(rows)
        i, j, crowded = surviving(of, g, shape, [b.view(np.uint64) for b in bits], threshold, True)
        i, j = np.where(of[i] < of[j], i, j), np.where(of[i] < of[j], j, i)
        rest = np.flatnonzero(crowded)
        return batch_of(np.r_[of[i], of[rest]], np.r_[of[j], of[rest]], np.r_[g[i], g[rest]], np.r_[shape[i] & 0xFFFFFFFF, rest], np.arange(len(i) + len(rest)) < len(i))

    def handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, n, limit, over = None, [], 0, HELD_ROWS, np.zeros(0, np.int64)
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != block:
                    if n:
                        yield found(np.concatenate(parts, axis=1))
                    block, parts, n, limit, over = number, [], 0, HELD_ROWS, over[:0]
                rows = np.frombuffer(data.as_buffer(), np.int64).reshape(3 + WIDE, -1)
                if len(over):
                    often = np.isin(rows[0], over)
                    yield crowd(rows[:, often])
                    rows = rows[:, ~often]
                parts.append(rows.copy())
                n += rows.shape[1]
                if n > limit:
                    # classes of a token that is too frequent to be held are dealt out whatever their partners
                    rows = np.concatenate(parts, axis=1)
                    tokens, counts = np.unique(rows[0], return_counts=True)
                    over = np.union1d(over, tokens[counts > MOST])
                    often = np.isin(rows[0], over)
                    yield crowd(rows[:, often])
                    parts = [rows[:, ~often]]
                    n = parts[0].shape[1]
                    limit = max(HELD_ROWS, 2 * n)
        if n:
            yield found(np.concatenate(parts, axis=1))

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(lean(handle, at_once=False), "a long, b long, token long, at int")


def prefix_candidates(table: DataFrame, threshold: float, rounds: int) -> Callable[[int], DataFrame]:
    """`block_candidates` of the prefixes of a table of sets, for each of `rounds` turns."""
    blocks = block_count(table, threshold, rounds)
    return lambda turn: block_candidates(prefix_blocks(table, threshold, blocks, turn, rounds), threshold)


def overlaps(flat_a: np.ndarray, sizes_a: np.ndarray, flat_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sets one after another: how many tokens they share, and the place in a of the first (or the size of a)."""
    pair_a, pair_b = (np.repeat(np.arange(len(z), dtype=np.uint64), z) << np.uint64(8 * WIDTH) for z in (sizes_a, sizes_b))
    own = pair_a | flat_a
    every = np.concatenate([own, pair_b | flat_b])
    every.sort()
    common = every[:-1][every[1:] == every[:-1]]
    count = np.bincount((common >> np.uint64(8 * WIDTH)).astype(np.int64), minlength=len(sizes_a))
    at = np.searchsorted(common, own)
    is_common = np.zeros(len(own), bool)
    is_common[at < len(common)] = common[at[at < len(common)]] == own[at < len(common)]
    begin = np.cumsum(sizes_a) - sizes_a
    place = np.arange(len(own)) - np.repeat(begin, sizes_a)
    first = np.minimum.reduceat(np.where(is_common, place, np.repeat(sizes_a, sizes_a)), begin) if len(begin) else begin
    return count, first


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b, at) that reach the threshold and share no token before `at` (null: not asked)."""
    one, two = (sets.select(F.col("class").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in "ab")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series, at: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for k in range(0, len(a), 512):
            x, y = a.iloc[k : k + 512].tolist(), b.iloc[k : k + 512].tolist()
            sizes_a, sizes_b = (np.array([len(s) // WIDTH for s in z], np.int64) for z in (x, y))
            common, place = overlaps(unpacked(b"".join(x)), sizes_a, unpacked(b"".join(y)), sizes_b)
            due = at.iloc[k : k + 512].fillna(-1).to_numpy(np.int64)
            out[k : k + 512] = reached(common, sizes_a, sizes_b, threshold) & ((due < 0) | (place == due))
        return pd.Series(out)

    return pairs.join(one, "a").join(two, "b").where(similar("a_tokens", "b_tokens", "at")).select("a", "b")


#: Tokens from which 256 bits tell little, and words (64 bits) of the signature that such sets get.
LARGE, LARGE_WORDS = 200, 64


def with_large_signatures(sets: DataFrame) -> DataFrame:
    """`sets` (class, tokens) with n and, for large sets, `wide`: 4,096 bits of signature."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, wide = [], []
            for data in batch.column("tokens").to_pylist():
                sizes.append(len(data) // WIDTH)
                if sizes[-1] <= LARGE:
                    wide.append(None)
                    continue
                token, own = unpacked(data), np.zeros(LARGE_WORDS, np.uint64)
                np.bitwise_xor.at(own, ((token >> np.uint64(6)) % np.uint64(LARGE_WORDS)).astype(np.int64), np.uint64(1) << (token & np.uint64(63)))
                wide.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("tokens"), pa.array(sizes, pa.int32()), pa.array(wide, pa.binary())], ["class", "tokens", "n", "wide"])

    return sets.select("class", "tokens").mapInArrow(lean(signed), "class long, tokens binary, n int, wide binary")


def likely(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the signatures of large sets do not rule out: these move instead of the sets."""
    one, two = (sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")

    @F.pandas_udf("boolean")
    def may(n_a: pd.Series, n_b: pd.Series, wide_a: pd.Series, wide_b: pd.Series) -> pd.Series:
        out = np.ones(len(n_a), bool)
        both = np.flatnonzero(wide_a.notna().to_numpy() & wide_b.notna().to_numpy())
        if len(both):
            x, y = (np.frombuffer(b"".join(z.iloc[both]), np.uint64).reshape(-1, LARGE_WORDS) for z in (wide_a, wide_b))
            size_a, size_b = (z.to_numpy(np.int64)[both] for z in (n_a, n_b))
            out[both] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= size_a + size_b - 2 * shared_at_least(size_a, size_b, threshold)
        return pd.Series(out)

    return pairs.join(one, "a").join(two, "b").where(may("n_a", "n_b", "wide_a", "wide_b")).select("a", "b")


def link_matrix(left: list[bytes], right: list[bytes], token: int, threshold: float, counted: bool) -> np.ndarray:
    """Which of the packed sets of `left` and `right` are linked; if `counted`, only pairs whose first common token is `token`.

    Tokens are taken a slice of the hash values at a time, so what is held beside the sets does not grow with them.
    """
    sizes = np.array([len(x) // WIDTH for x in (*left, *right)], np.int64)
    flat = unpacked(b"".join((*left, *right)))
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    total = np.zeros((len(left), len(right)), np.float32)
    earlier = total.copy() if counted else None
    if counted:
        place = np.flatnonzero(flat == np.uint64(token))
        limit = np.full(len(sizes), -1)
        limit[row[place]] = place
    parts = -(-len(flat) // BLOCK)
    for part in range(parts):
        own = np.flatnonzero(flat % np.uint64(parts) == np.uint64(part))
        own = own[np.argsort(flat[own], kind="stable")]
        sorted_tokens = flat[own]
        begin = np.flatnonzero(np.r_[True, sorted_tokens[1:] != sorted_tokens[:-1]]) if len(own) else np.zeros(0, np.int64)
        often = np.diff(np.r_[begin, len(own)])
        shared = np.repeat(often > 1, often)
        own, column = own[shared], np.repeat(np.arange(np.count_nonzero(often > 1)), often[often > 1])
        ends = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + CHUNK, CHUNK))
        for at, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            for out, kept in ((total, own[i:j]), *([(earlier, own[i:j])] if counted else [])):
                of, which = row[kept], column[i:j] - at * CHUNK
                if out is earlier:
                    before = kept < limit[of]
                    of, which = of[before], which[before]
                x = np.zeros((len(sizes), CHUNK), np.float32)
                x[of, which] = 1
                out += x[: len(left)] @ x[len(left) :].T
    linked = reached(total, sizes[: len(left), None].astype(np.float32), sizes[None, len(left) :].astype(np.float32), threshold)
    return linked & (earlier == 0) if counted else linked


def wide_bits(sets: list[bytes]) -> np.ndarray:
    """64 * LARGE_WORDS bits for each packed set, each the parity of the tokens that hash to it."""
    places = 64 * LARGE_WORDS
    rows = [np.packbits((np.bincount((unpacked(x) % np.uint64(places)).astype(np.int64), minlength=places) & 1).astype(bool)) for x in sets]
    return np.stack(rows).view(np.uint64) if rows else np.zeros((0, LARGE_WORDS), np.uint64)


def shared_with(one: bytes, others: list[bytes]) -> np.ndarray:
    """How many tokens each of the packed sets `others` shares with `one`."""
    own, ends = np.sort(unpacked(one)), np.cumsum([len(x) // WIDTH for x in others])
    parts, at = [], 0
    while at < len(others):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        flat = unpacked(b"".join(others[at:to]))
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        parts.append(np.diff(np.r_[0, np.cumsum(hit)[ends[at:to] - (ends[at - 1] if at else 0) - 1]]))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def spanning(sets: list[bytes], threshold: float, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of packed sets (none empty), from each set reached to all that are not reached yet.

    Sets of one `part` count as linked before: one that is reached reaches all of them. Every set that is not reached is compared with every one that is; whole sets only where sizes and wide signatures leave a link possible.
    """
    sizes, bits = np.array([len(x) // WIDTH for x in sets], np.int64), wide_bits(sets)
    # a parity of parities differs in fewer places: a quarter of the words rules out most pairs
    folded = np.bitwise_xor.reduce(bits.reshape(len(bits), 4, LARGE_WORDS // 4), axis=1)
    left, out = np.arange(len(sets)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            if part is not None:
                own = part[left] == part[x]
                front, left = front + left[own].tolist(), left[~own]
            want = shared_at_least(sizes[x], sizes[left], threshold)
            may = np.flatnonzero(np.minimum(sizes[x], sizes[left]) >= want)
            for signature in (folded, bits):
                differing = np.bitwise_count(signature[left[may]] ^ signature[x]).sum(axis=1, dtype=np.uint16)
                may = may[differing <= sizes[x] + sizes[left[may]] - 2 * want[may]]
            others = left[may]
            linked = reached(shared_with(sets[x], [sets[y] for y in others.tolist()]), sizes[x], sizes[others], threshold)
            new = others[linked].tolist()
            out += [(x, y) for y in new]
            front += new
            left = np.delete(left, may[linked])
    return out


def crowd_chunks(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of crowded groups (class, token) with their sets, dealt out as pairs of chunks: token, g, own, i, j, class, tokens and the rest of `sets`."""
    chunks = crowds.groupBy("token").count().select("token", F.ceil(F.col("count") / CHUNK).cast("int").alias("c"))
    own = F.pmod(F.xxhash64("class", "token"), F.col("c")).cast("int")
    dealt = crowds.join(chunks, "token").withColumn("own", own)
    pair = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    spread = dealt.select("class", "token", "own", F.explode(pair).alias("ij")).select("class", "token", "own", "ij.i", "ij.j", F.xxhash64("token", "ij.i", "ij.j").alias("g"))
    return spread.join(sets, "class")


def crowd_counts(crowds: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(class, n, earlier): links of each class whose first common token is the group's, and whether one has a smaller `first`."""

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        tokens = rows["tokens"].tolist()
        j, own, of = int(rows["j"].iloc[0]), rows["own"].to_numpy(), rows["class"].to_numpy()
        same = int(rows["i"].iloc[0]) == j
        left = np.flatnonzero(own != j) if not same else np.arange(len(rows))
        right = np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return pd.DataFrame({"class": [], "n": [], "earlier": []})
        linked = link_matrix([tokens[k] for k in left], [tokens[k] for k in right], int(rows["token"].iloc[0]), threshold, True)
        if same:
            np.fill_diagonal(linked, False)
        before = left[:, None] < right[None, :]
        parts = [(right, linked.sum(axis=0), (linked & before).any(axis=0))]
        if not same:
            parts.append((left, linked.sum(axis=1), (linked & ~before).any(axis=1)))
        out = pd.DataFrame({"class": np.concatenate([of[p[0]] for p in parts]), "n": np.concatenate([p[1] for p in parts]).astype(np.int64), "earlier": np.concatenate([p[2] for p in parts])})
        return out[out["n"] > 0]

    return crowd_chunks(crowds, sets.select("class", "tokens", "first")).groupBy("g").applyInPandas(counted, "class long, n long, earlier boolean")


def crowd_links(crowds: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join two parts, among the classes of crowded groups."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, of, g = rows["tokens"].tolist(), rows["class"].to_numpy(), rows["g"].to_numpy()
        edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]).tolist()
        links = [(lo + x, lo + y) for lo, hi in zip(edges[:-1], edges[1:], strict=True) for x, y in spanning(tokens[lo:hi], threshold)]
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": of[ends[:, 0]], "b": of[ends[:, 1]]})

    # many groups are small: a batch takes all that it holds
    dealt = crowd_chunks(crowds, sets.select("class", "tokens")).select("g", "class", "tokens")
    return dealt.repartition("g").sortWithinPartitions("g").mapInPandas(lean(lambda batches: by_runs(batches, "g", found)), "a long, b long")


def split_candidates(spark: SparkSession, candidates_of: Callable[[int], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored pairs (a, b, at), each once with its earliest place; crowds (class, token); and all classes of both.

    `candidates_of(turn)` gives the candidates of one round's share of the keys; rounds keep the shuffles small.
    """

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("a", "b", "crowd").agg(F.min("at").alias("at"))

    parts = []
    for turn in range(ROUNDS):
        found = candidates_of(turn).withColumn("crowd", F.when(F.col("b").isNull(), F.col("token")))
        # a pair of several tokens is summed once over all rounds, not in each round too
        parts.append(stored(found.select("a", "b", "crowd", "at"), "candidates"))
        del found
        release(spark)
    every = stored(summed(reduce(DataFrame.union, parts)), "pairs")
    discard(*parts)
    release(spark)
    pairs = every.where("b is not null").select("a", "b", "at")
    crowds = every.where("b is null").select(F.col("a").alias("class"), F.col("crowd").alias("token"))
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("class")).union(crowds.select("class")).distinct(), "wanted")
    return pairs, crowds, wanted


def sets_among(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and tokens of the classes in `wanted`, once each."""
    return table.where("tokens is not null").select("class", "tokens").join(small(wanted, 2_000_000), "class", "left_semi").dropDuplicates(["class"])


#: Rounds that verify one candidate of each class, and of crowds one token of each class, before all that are left are verified.
FIRST_ROUNDS = 2


def apart(left: DataFrame, crowd: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that `parts` does not connect, and the crowds (class, token) whose classes are not all of one part."""
    of_a, of_b = (parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")) for c in "ab")
    pairs = left.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
    whose = crowd.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("part", F.coalesce("component", "class"))
    open_ = whose.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token")
    return pairs, stored(crowd.join(open_, "token", "left_semi").select("class", "token"), "crowd")


def linked_classes(spark: SparkSession, candidates_of: Callable[[int], DataFrame], sets_of: Callable[[DataFrame], DataFrame], threshold: float, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of the classes that some chain of similar pairs links to another class.

    `sets_of` gives class and tokens for the column `class` of a table. Candidates are narrow, but verifying one moves two
    sets, so the first rounds verify one candidate of each class; what is connected by then needs no verification, and
    all else gets it in the end. `known` are verified links (a, b) found before: what they connect is not verified again.
    """
    pairs, crowds, wanted = split_candidates(spark, candidates_of)
    sets = stored(with_large_signatures(sets_of(wanted)), "sets")
    release(spark)
    left, crowd, links, parts = pairs.select("a", "b"), crowds, known, None
    if known is not None:
        parts = stored(connected_components(known), "parts")
        left, crowd = apart(left, crowd, parts)
    left = stored(likely(left, sets, threshold), "likely")
    release(spark)
    for turn in range(FIRST_ROUNDS + 1):
        last = turn == FIRST_ROUNDS
        asked = left if last else stored(left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "asked")
        some = crowd if last else crowd.groupBy("class").agg(F.min("token").alias("token"))
        # one after the other: together they would hold the Python workers of both at once
        new = stored(verified(asked.withColumn("at", F.lit(None).cast("int")), sets, threshold), "links").union(stored(crowd_links(some, sets, threshold), "links"))
        links = stored(new if links is None else links.union(new), "links")
        release(spark)
        before, parts = parts, stored(connected_components(links), "parts")
        discard(*([before] if before is not None else []))
        if last:
            break
        fewer, crowd = apart(left.join(asked, ["a", "b"], "left_anti"), crowd, parts)
        left = stored(fewer, "left")
        release(spark)
    discard(sets, wanted, links)
    return parts
