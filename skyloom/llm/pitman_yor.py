"""Operator 6: language-model scoring by a hierarchical Pitman-Yor model.

Every word is the context of the next: a context is a restaurant whose customers are the words that follow it in the
training texts, all of them. The restaurants of all contexts share one parent, the corpus-wide restaurant of words, whose
customers are their tables. Its own tables order from a spelling model, a hierarchy of restaurants over the bytes of
words: one for each context of up to `LONGEST` bytes, whose parent is the context without its first byte, down to the empty
context over a uniform base. The end of a text is a word, and is the context of the first word of a text.

Seating is sampled by Gibbs sweeps of the Chinese-restaurant rule: a sweep takes all customers of a dish away and seats
them again one after another, given the other tables of the restaurant and the parent's predictive probability; the
tables that result are counted into the parent, level by level. Up to `SINGLY` customers of a dish are drawn one by one,
those beyond in blocks of a thirty-second of the seated, by the binomial law of the block.
Predictive probabilities are averaged over the sweeps after `BURN`; a text's score is the sum of their logarithms. (For a pair
of words that is not kept, see below, the averages of the context's and of the word's part are multiplied.)

How it runs. The documents are cut into pieces of `ROWS` rows by their place in their files, which no later read can change.
Each piece sends its distinct words, and its distinct pairs of words with their counts, to parts by hash, packed in a few
bytes each; parts sum them. A pair that stands once has one customer and one table, whatever is drawn, so what its
context and its word get by it follows from their counts, and only pairs that stand twice or more, or once and in a held-out
text too, are kept, with the pieces that hold them. They lie in blocks of bounded size, by hash, so a context or word however frequent is split, and stay
there: in each sweep words send what a pair needs of them to the blocks that hold them, once a block, and blocks send back sums for their words. In the end
words and blocks send probabilities to the pieces that hold them, where texts are scored. What is kept and
moved grows with the documents, in proportion. The spelling model is broadcast while it has at most `MOST` entries, and
joined by key beyond.

Words of a pair are known by 40 bits of their hash: two words share them in less than one of 10**11 pairs of words, and then share
their contexts; the counts of words, and the base score, rest on 64 bits.

Defined results: a null text is empty and has the one token "end"; a null doc_id counts as the empty text in the split;
repeated rows are scored alike; without training documents probabilities come from the uniform base; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import discard, give_back, lean, pick, pieces_of_runs, release, remainder, stored, table
from skyloom.llm.similarity import packed, unpacked
from skyloom.llm.words import BASE, Reader, Slab, mixed, slabs

LONGEST, BURN, SAMPLES, MOST = 4, 1, 2, 4_000_000
#: Rows of a piece, pairs of a part, customers drawn one by one, words of a flush of answers.
ROWS, PART, SINGLY, FLUSH = 4096, 1_500_000, 64, 1_000_000
#: Kept pairs from which a block is closed; rounds in which pieces are scored.
BLOCK, ROUNDS = 400_000, 4
#: Turns in which the pairs of a piece, and those of a part, are sorted and summed.
SHARES = 8
WORD_DISCOUNT, WORD_STRENGTH = 0.7, 100.0
CONTEXT_DISCOUNT, CONTEXT_STRENGTH = 0.8, 5.0
#: By length of the context, 0 to LONGEST.
DISCOUNT, STRENGTH = (0.5, 0.6, 0.7, 0.75, 0.8), (5.0, 2.0, 1.0, 0.5, 0.5)
#: Symbols: 256 bytes, the end of a word, and the padding before it.
SYMBOLS, END, PAD = 258, 256, 257
#: Hash of the end of a text.
STOP = 0x5BD1E995C6A4A793
digest64 = xxhash.xxh64_intdigest


def uniform(key: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but these arguments, so a task that runs again seats alike."""
    x = key.astype(np.uint64) ^ np.uint64((sweep * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def binomial(n: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The binomial number at which the distribution function reaches `draw`; of means above 20 its normal form."""
    out, mean = np.zeros(len(n), np.int64), n * p
    live = np.flatnonzero(mean <= 20)
    term = (1 - p[live]) ** n[live]
    below, k = term.copy(), 0
    while len(live):
        up = (draw[live] > below) & (k < n[live])
        live, term, below = live[up], term[up], below[up]
        out[live] += 1
        k += 1
        term = term * (n[live] - k + 1) / k * p[live] / np.maximum(1 - p[live], 1e-12)
        below = below + term
        if k > 200:
            break
    many = np.flatnonzero(mean > 20)
    if len(many):
        # logistic form of the normal quantile: off by less than 0.02
        z = np.log(np.clip(draw[many], 1e-9, 1 - 1e-9) / (1 - np.clip(draw[many], 1e-9, 1 - 1e-9))) / 1.702
        out[many] = np.clip(np.floor(mean[many] + z * np.sqrt(mean[many] * (1 - p[many])) + 0.5), 0, n[many])
    return out


def seated(key: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength, sweep: int) -> np.ndarray:
    """Tables of each dish: its customers take their seats anew, `others` are the tables of other dishes in the restaurant."""
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    n, step = np.ones(len(live), np.int64), 0
    while len(live):
        t = tables[live]
        more = np.minimum(customers[live] - n, np.where(n < SINGLY, 1, n // 32))
        new = (strength + discount * (others[live] + t)) * parent[live]
        share = new / (new + n - discount * t)
        draw = uniform(key[live], sweep, step)
        got = (draw < share).astype(np.int64)
        far = more > 1
        if far.any():
            got[far] = binomial(more[far], share[far], draw[far])
        tables[live] = t + got
        n = n + more
        step += 1
        left = n < customers[live]
        live, n = live[left], n[left]
    return tables


def spelling_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of the words: a number for it with the LONGEST symbols before it, and the word it belongs to."""
    pads, parts = [PAD] * LONGEST, []
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    total = int(lengths.sum()) + LONGEST * len(words)
    symbols = np.full(total, PAD, np.int64)
    starts = np.cumsum(lengths + LONGEST) - lengths
    at = np.repeat(starts, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined = np.frombuffer(b"\x00".join(words) + b"\x00", np.uint8).astype(np.int64)
    joined[np.cumsum(lengths) - 1] = END
    symbols[at] = joined
    key = np.zeros(len(at), np.int64)
    for back in range(LONGEST, -1, -1):
        key = key * SYMBOLS + symbols[at - back]
    return key, np.repeat(np.arange(len(words)), lengths)


#: Predictive probabilities of the longest contexts: sorted keys and log probabilities. Plain arrays, for broadcasting.
Spelling = tuple[np.ndarray, np.ndarray]


def spelled(spelling: Spelling | None, words: list[bytes]) -> np.ndarray:
    """Probability of each word's spelling."""
    key, owner = spelling_keys(words)
    if spelling is None:
        return np.bincount(owner, np.full(len(key), -np.log(SYMBOLS - 1.0)), len(words))
    return np.bincount(owner, spelling[1][np.searchsorted(spelling[0], key)], len(words))


def with_spelling(words: DataFrame, shared, model: DataFrame | None) -> DataFrame:
    """`words` with `spell`, the log probability of the spelling, from the broadcast model or else by a join."""
    columns = words.columns
    if shared is None and model is not None:

        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                key, owner = spelling_keys([bytes(w) for w in batch["word"]])
                yield pd.DataFrame({"word": batch["word"].to_numpy()[owner], "key": key})

        per = words.select("word").mapInPandas(lean(keys), "word binary, key long").join(model.select("key", "p"), "key").groupBy("word").agg(F.sum(F.log("p")).alias("spell"))
        return words.join(per, "word")

    @F.pandas_udf("double")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series(spelled(shared.value if shared else None, [bytes(w) for w in column]))

    return words.select(*columns, of("word").alias("spell"))


def reseat_words(words: DataFrame, shared, model: DataFrame | None, total: int, tables: int, sweep: int) -> DataFrame:
    """`words` (word, w, n, m, room, t) with `p`, the predictive probability of this state, its logarithm `lp`, and `t` seated anew.

    A word without customers has its spelling's share alone, which is smaller than any number for a long word: only `lp` tells it.
    """
    discount, strength = WORD_DISCOUNT, WORD_STRENGTH

    @F.pandas_udf("p double, lp double, t long")
    def sweep_of(w: pd.Series, m: pd.Series, t: pd.Series, spell: pd.Series) -> pd.DataFrame:
        spell, m, t = spell.to_numpy(), m.to_numpy(), t.to_numpy()
        base, own = np.exp(spell), m - discount * t
        p = (own + (strength + discount * tables) * base) / (strength + total)
        lp = np.logaddexp(np.log(own, out=np.full(len(own), -np.inf), where=own > 0), np.log(strength + discount * tables) + spell) - np.log(strength + total)
        return pd.DataFrame({"p": p, "lp": lp, "t": seated(w.to_numpy(np.int64).view(np.uint64), m, np.maximum(tables - t, 0), base, discount, strength, sweep)})

    return with_spelling(words, shared, model).withColumn("x", sweep_of("w", "m", "t", "spell")).select("word", "w", "n", "m", "room", "x.p", "x.lp", "x.t")


def spelling_customers(words: DataFrame) -> DataFrame:
    """(key, c): customers of the longest contexts, one for each table of a word; keys of words without tables count 0."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, owner = spelling_keys([bytes(w) for w in batch["word"]])
            keys, at = np.unique(key, return_inverse=True)
            yield pd.DataFrame({"key": keys, "c": np.bincount(at, batch["t"].to_numpy()[owner], len(keys)).astype(np.int64)})

    return words.select("word", "t").mapInPandas(lean(counted), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def tables_of(level: int, sweep: int):
    """Seating of one level's dishes, from key, customers, other tables and the parent's probability."""

    @F.pandas_udf("long")
    def tables(key: pd.Series, c: pd.Series, others: pd.Series, parent: pd.Series) -> pd.Series:
        return pd.Series(seated(key.to_numpy() * 8 + level, c.to_numpy(), others.to_numpy(), parent.to_numpy(), DISCOUNT[level], STRENGTH[level], sweep))

    return tables


def reseat_spelling(customers: DataFrame, before: list[DataFrame] | None, sweep: int) -> list[DataFrame]:
    """One sweep of the spelling restaurants, longest contexts first; then probabilities from the empty context up.

    Level k has a row for each context of k symbols and symbol: key, c customers, t tables, sums of both over the
    restaurant (at most 258 rows), p and the parent's probability.
    """
    levels: list[DataFrame] = [customers] * (LONGEST + 1)
    current = customers
    for k in range(LONGEST, -1, -1):
        tables = tables_of(k, sweep)
        room = Window.partitionBy(F.expr(f"key div {SYMBOLS}"))
        if before is None:
            known = current.withColumn("others", F.count_if(F.col("c") > 0).over(room) - 1).withColumn("parent", F.lit(1.0 / (SYMBOLS - 1)))
        else:
            last = before[k].select("key", (F.col("st") - F.col("t")).alias("others"), "parent")
            known = current.join(last, "key")
        seat = known.select("key", "c", tables("key", "c", F.greatest("others", F.lit(0)), "parent").alias("t"))
        seat = seat.withColumn("sc", F.sum("c").over(room)).withColumn("st", F.sum("t").over(room))
        levels[k] = stored(seat, "seating")
        current = levels[k].groupBy((F.col("key") % SYMBOLS**k).alias("key")).agg(F.sum("t").alias("c"))
    done: list[DataFrame] = []
    for k in range(LONGEST + 1):
        own = (F.greatest(F.col("c") - DISCOUNT[k] * F.col("t"), F.lit(0.0)) + (STRENGTH[k] + DISCOUNT[k] * F.col("st")) * F.col("parent")) / (STRENGTH[k] + F.col("sc"))
        if k:
            parent = done[-1].select(F.col("key").alias("up"), F.col("p").alias("parent"))
            rows = levels[k].join(parent, F.col("key") % SYMBOLS**k == F.col("up")).drop("up")
        else:
            rows = levels[0].withColumn("parent", F.lit(1.0 / (SYMBOLS - 1)))
        done.append(stored(rows.withColumn("p", own), "spelling"))
    discard(*levels)
    return done


def spelling_model(words: DataFrame, before: list[DataFrame] | None, sweep: int):
    """Levels of the spelling restaurants seated anew from the words' tables, and the model as a broadcast if it is small."""
    customers = stored(spelling_customers(words), "customers")
    levels = reseat_spelling(customers, before, sweep)
    discard(customers, *(before or []))
    release(words.sparkSession)
    model = levels[-1]
    if model.count() > MOST:
        return levels, None
    rows = model.select("key", F.log("p").alias("l")).toArrow()
    key, log = rows["key"].to_numpy(), rows["l"].to_numpy()
    order = np.argsort(key)
    return levels, words.sparkSession.sparkContext.broadcast((key[order], log[order]))


def with_piece(scan: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of a Parquet scan with `piece`: `ROWS` rows that follow one another in a file. Pieces that share a number are one."""
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / ROWS))
    return scan.select(*columns, F.shiftrightunsigned(place, 33).cast("int").alias("piece"))


def with_ends(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slab with the end of each text, and the hash of the word before each."""
    after = slab.bounds[1:]
    words = np.insert(slab.hashes, after, np.uint64(STOP))
    return words, np.r_[np.uint64(STOP), words[:-1]]


def short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(24)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A number for a pair of words by their 40 bits."""
    return mixed(mixed(before * np.uint64(BASE) + np.uint64(1)) + word)


def piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one piece after another; a piece that a batch cuts is gathered first."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        pieces = batch.column("piece").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, pieces[1:] != pieces[:-1]]) if len(pieces) else []
        for a, b in zip(cut, np.r_[cut[1:], len(pieces)] if len(pieces) else [], strict=True):
            if last is not None and pieces[a] != last:
                yield last, pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
            last = int(pieces[a])
            rest.append(batch.slice(int(a), int(b - a)))
    if rest:
        yield last, pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def summed_runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def shares(number: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the numbers with one remainder by SHARES after another: what is sorted and summed at once stays small."""
    own = (number % np.uint64(SHARES)).astype(np.uint8)
    for k in range(SHARES):
        at = np.flatnonzero(own == k)
        if len(at):
            yield at


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one buffer and the places where its values begin and end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_table(docs: DataFrame, parts: int) -> DataFrame:
    """(w, word, n, pieces): every word of `docs` (text, held_out, piece), its tokens in training documents and the pieces that hold it."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for piece, batch in piece_batches(batches):
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            found, counts, sizes, spelling = [], [], [], []
            for slab in slabs(batch.column("text"), reader, 4 << 20):
                training = ~held[slab.rows[0] : slab.rows[1]].astype(bool)
                w, first, at = np.unique(slab.hashes, return_index=True, return_inverse=True)
                n = np.bincount(at, training[slab.text], len(w)).astype(np.int64)
                size = slab.stops[first] - slab.starts[first]
                raw = reader.lower[slab.raw[np.repeat(slab.starts[first], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]]
                found += [w, np.array([STOP], np.uint64)]
                counts += [n, np.array([training.sum()])]
                sizes += [size, np.array([0])]
                spelling.append(raw)
            w, n, size = np.concatenate(found), np.concatenate(counts), np.concatenate(sizes)
            raw, begin = np.concatenate(spelling), np.cumsum(size) - size
            part = (w % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((w, part))
            cut = summed_runs(part[order])
            columns = []
            for own in np.split(order, cut[1:]):
                letters = raw[np.repeat(begin[own], size[own]) + np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])]
                columns.append((int(part[own[0]]), piece, w[own].tobytes(), n[own].tobytes(), size[own].astype("<u4").tobytes(), letters.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["part", "piece", "w", "n", "size", "letters"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for rows, _ in pieces_of_runs(batches, "part"):
            w = np.frombuffer(b"".join(rows["w"]), np.uint64)
            n, size = np.frombuffer(b"".join(rows["n"]), np.int64), np.frombuffer(b"".join(rows["size"]), "<u4").astype(np.int64)
            letters = np.frombuffer(b"".join(rows["letters"]), np.uint8)
            piece = np.repeat(rows["piece"].to_numpy(np.int32), [len(x) // 8 for x in rows["w"]])
            begin = np.cumsum(size) - size
            order = np.lexsort((piece, w))
            cut = summed_runs(w[order])
            one = order[cut]
            text = letters[np.repeat(begin[one], size[one]) + np.arange(size[one].sum()) - np.repeat(np.cumsum(size[one]) - size[one], size[one])]
            yield pd.DataFrame({
                "w": w[one].view(np.int64), "word": binaries(text, np.r_[0, np.cumsum(size[one])]).to_pylist(), "n": np.add.reduceat(n[order], cut),
                "pieces": binaries(piece[order].astype("<i4").view(np.uint8), np.r_[cut, len(order)] * 4).to_pylist(),
            })

    blobs = docs.select("text", "held_out", "piece").mapInArrow(lean(sent), "part int, piece int, w binary, n binary, size binary, letters binary")
    return blobs.repartition("part").sortWithinPartitions("part").mapInPandas(lean(merged), "w long, word binary, n long, pieces binary")


def pair_blobs(docs: DataFrame, parts: int) -> DataFrame:
    """(part, piece, u, w, c): the distinct pairs of words of each piece with their counts in training documents, packed by part and in the order of parts."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for piece, batch in piece_batches(batches):
            held, us, ws, train = batch.column("held_out").to_numpy(zero_copy_only=False), [], [], []
            for slab in slabs(batch.column("text"), reader):
                word, before = with_ends(slab)
                us.append(short(before))
                ws.append(short(word))
                train.append(np.repeat(~held[slab.rows[0] : slab.rows[1]].astype(bool), np.diff(slab.bounds) + 1))
            u, w, train = np.concatenate(us), np.concatenate(ws), np.concatenate(train)
            del us, ws
            key = pair_key(u, w)
            for share in shares(key % np.uint64(parts)):
                order = share[np.argsort(key[share])]
                cut = summed_runs(key[order])
                c = np.add.reduceat(train[order].astype(np.int64), cut)
                one = order[cut]
                # a count is one byte; a greater one takes several entries
                entries = np.maximum(1, -(-c // 255))
                # held-out texts ask too: where training texts of the piece hold the pair as well, by an entry of its own that counts 0
                entries += (c > 0) & (np.diff(np.r_[cut, len(order)]) > c)
                step = np.arange(entries.sum()) - np.repeat(np.cumsum(entries) - entries, entries)
                count = np.clip(np.repeat(c, entries) - 255 * step, 0, 255).astype(np.uint8)
                one = np.repeat(one, entries)
                part = (key[one] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = summed_runs(part[order])
                rows = [(int(part[own[0]]), piece, packed(u[one[own]]), packed(w[one[own]]), count[own].tobytes()) for own in np.split(order, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "piece", "u", "w", "c"])

    blobs = docs.select("text", "held_out", "piece").mapInArrow(lean(sent), "part int, piece int, u binary, w binary, c binary")
    return blobs.repartition("part").sortWithinPartitions("part")


def pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
    """u, w, c, the number of pieces and the pieces of pairs to keep, from the blobs of one part after another."""
    for rows, _ in pieces_of_runs(batches, "part"):
        u, w, c = unpacked(b"".join(rows["u"])), unpacked(b"".join(rows["w"])), np.frombuffer(b"".join(rows["c"]), np.uint8)
        piece = np.repeat(rows["piece"].to_numpy(np.int32), [len(x) for x in rows["c"]])
        del rows
        key = pair_key(u, w)
        for share in shares(key >> np.uint64(32)):
            order = share[np.argsort(key[share])]
            cut = summed_runs(key[order])
            total = np.add.reduceat(c[order].astype(np.int64), cut)
            size = np.diff(np.r_[cut, len(order)])
            kept = (total > 1) | (total == 1) & (size > 1)
            often, row = np.flatnonzero(kept), order[np.repeat(kept, size)]
            one = order[cut[often]]
            yield u[one], w[one], total[often], size[often], piece[row]


def pair_table(docs: DataFrame, parts: int) -> DataFrame:
    """(u, w, c, pieces): pairs of words that stand `c` times in training documents, and the pieces that hold them.

    Pairs that only one text holds, once, are left out: their text knows as much.
    """

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for u, w, c, size, piece in pair_sums(batches):
            yield pd.DataFrame({"u": u.view(np.int64), "w": w.view(np.int64), "c": c, "pieces": binaries(piece.astype("<i4").view(np.uint8), np.r_[0, np.cumsum(size)] * 4).to_pylist()})

    return pair_blobs(docs, parts).mapInPandas(lean(merged), "u long, w long, c long, pieces binary")


#: A block of pairs: their words, counts, numbers of pieces and pieces, each packed.
BLOCKS = "piece int, u binary, w binary, c binary, size binary, held_by binary"


def in_blocks(sums: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
    """Blocks of what `pair_sums` gives; the number of a block, `piece`, tells the task and its place there."""
    task, made, rest, n = TaskContext.get(), 0, [], 0

    def closed() -> pd.DataFrame:
        u, w, c, size, piece = (np.concatenate(x) for x in zip(*rest, strict=True))
        number = (task.partitionId() if task else 0) * 1024 + made
        return pd.DataFrame({"piece": [number], "u": [packed(u)], "w": [packed(w)], "c": [c.astype("<i8").tobytes()], "size": [size.astype("<i4").tobytes()], "held_by": [piece.astype("<i4").tobytes()]})

    for x in sums:
        rest.append(x)
        n += len(x[0])
        if n >= BLOCK:
            yield closed()
            made, rest, n = made + 1, [], 0
    if n:
        yield closed()


def pair_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """The pairs of `pair_table` in blocks; to be stored, since the number of a block depends on its task."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_blocks(pair_sums(batches))

    return pair_blobs(docs, parts).mapInPandas(lean(merged), BLOCKS)


def blocks_of(pairs: DataFrame) -> DataFrame:
    """Blocks of rows (u, w, c), without pieces."""

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int32)
        return in_blocks((rows["u"].to_numpy(np.int64).view(np.uint64), rows["w"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64), np.zeros(len(rows), np.int32), none) for rows in batches)

    return pairs.select("u", "w", "c").mapInPandas(lean(gathered), BLOCKS)


def words_of_block(u: np.ndarray, w: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words of pairs, and the sums of `less` over the pairs in which each comes first and second."""
    ids, at = np.unique(np.r_[u, w], return_inverse=True)
    return ids.view(np.int64), *(np.bincount(x, less, len(ids)).astype(np.int64) for x in (at[: len(u)], at[len(u) :]))


def members(blocks: DataFrame) -> DataFrame:
    """(id, pieces, less_u, less_w): the blocks that hold a word, and its sums of customers less tables with one table for each dish."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, u, w, c in zip(batch["piece"], batch["u"], batch["w"], batch["c"], strict=True):
                n = np.frombuffer(c, "<i8")
                ids, less_u, less_w = words_of_block(unpacked(u), unpacked(w), n - np.minimum(n, 1))
                yield pd.DataFrame({"id": ids, "piece": np.full(len(ids), number, np.int32), "less_u": less_u, "less_w": less_w})

    rows = blocks.select("piece", "u", "w", "c").mapInPandas(lean(found), "id long, piece int, less_u long, less_w long")
    return rows.groupBy("id").agg(F.collect_list("piece").alias("pieces"), F.sum("less_u").alias("less_u"), F.sum("less_w").alias("less_w"))


#: What a block is told of its words; kinds of what it says: probabilities for pieces, its state, sums for its words, pairs with probabilities.
ID_FIELDS = [("id", "<i8"), ("n", "<i8"), ("room", "<i8"), ("p", "<f8")]
STATE_FIELDS, SUM_FIELDS, HELD_FIELDS = [("t", "<i8"), ("p", "<f8")], [("id", "<i8"), ("less_u", "<i8"), ("less_w", "<i8")], [("u", "<i8"), ("w", "<i8"), ("p", "<f8")]
ASKED, ANSWER, STATE, SUMS, HELD = range(5)
SAID = "piece int, kind int, data binary"


def seat_blocks(blocks: DataFrame, words: DataFrame, state: DataFrame | None, sweep: int, states: int, end: int | None) -> DataFrame:
    """(piece, kind, data): the pairs of each block seated anew, their probabilities of this state added to those before after BURN.

    `words` has id, n, room (tables of the context), p (of the corpus) and pieces, one row for each id. The result holds the
    STATE of blocks and SUMS for words, or, in the last sweep, what `end` names: the means of `states` probabilities as
    ANSWER for the pieces that hold a pair, or HELD.
    """
    before = state is not None

    def seat(block: pa.Table, told_of: pa.Table) -> pa.Table:
        try:
            return seated_block(block, told_of)
        finally:
            give_back()

    def seated_block(block: pa.Table, told_of: pa.Table) -> pa.Table:
        u, w = unpacked(block["u"][0].as_py()), unpacked(block["w"][0].as_py())
        c = np.frombuffer(block["c"][0].as_py(), "<i8")
        kind, data = told_of["kind"].to_pylist(), told_of["data"].to_pylist()
        ids, n, room, parent = told([x for x, k in zip(data, kind, strict=True) if k == ASKED], ID_FIELDS)
        t, p = told([x for x, k in zip(data, kind, strict=True) if k == STATE], STATE_FIELDS) if before else (np.minimum(c, 1), np.zeros(len(c)))
        del data
        order = np.argsort(ids.view(np.uint64))
        first, second = (order[np.searchsorted(ids.view(np.uint64), x, sorter=order)] for x in (u, w))
        room, parent = room[first], parent[second]
        own = (c - CONTEXT_DISCOUNT * t + (CONTEXT_STRENGTH + CONTEXT_DISCOUNT * room) * parent) / (CONTEXT_STRENGTH + n[first])
        p, key, number = p + own if sweep >= BURN else p, pair_key(u, w), block["piece"][0].as_py()
        if end == ANSWER:
            size = np.frombuffer(block["size"][0].as_py(), "<i4")
            made = list(dealt(np.frombuffer(block["held_by"][0].as_py(), "<i4"), np.repeat(np.arange(len(size), dtype=np.int32), size), ANSWER, [key.view(np.int64), (p / states).astype("<f4")]))
            return pa.Table.from_batches(made) if made else said([])
        if end == HELD:
            return said([(number, HELD, u.tobytes() + w.tobytes() + (p / states).tobytes())])
        t = seated(key, c, np.maximum(room - t, 0), parent, CONTEXT_DISCOUNT, CONTEXT_STRENGTH, sweep)
        return said([(number, STATE, t.astype("<i8").tobytes() + p.astype("<f8").tobytes()), (number, SUMS, b"".join(x.tobytes() for x in words_of_block(u, w, c - t)))])

    replies = answers(words, ASKED, ID_FIELDS)
    if before:
        replies = replies.union(state.where(F.col("kind") == STATE))
    asked = blocks if end == ANSWER else blocks.select("piece", "u", "w", "c")
    return asked.groupBy("piece").cogroup(replies.groupBy("piece")).applyInArrow(seat, SAID)


def opened(rows: DataFrame, kind: int, fields: list[tuple[str, str]]) -> DataFrame:
    """The rows that are packed in those of one kind."""

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["data"]:
                yield pd.DataFrame(dict(zip([c for c, _ in fields], told([blob], fields), strict=True)))

    return rows.where(F.col("kind") == kind).select("data").mapInPandas(lean(columns), ", ".join(f"{c} {'double' if 'f' in t else 'long'}" for c, t in fields))


def by_id(words: DataFrame) -> DataFrame:
    return words.withColumn("id", F.shiftrightunsigned("w", 24))


def fitted(words: DataFrame, pairs: DataFrame | None, sweeps: int = BURN + SAMPLES - 1) -> tuple[DataFrame, DataFrame | None]:
    """`fitted_blocks` for pairs as rows: (u, w, c) are given, (u, w, p) returned."""
    if pairs is None:
        return fitted_blocks(words, None, sweeps)
    every, held = fitted_blocks(words, stored(blocks_of(pairs), "blocks"), sweeps, HELD)
    return every, opened(held, HELD, HELD_FIELDS)


def fitted_blocks(words: DataFrame, blocks: DataFrame | None, sweeps: int = BURN + SAMPLES - 1, end: int = ANSWER) -> tuple[DataFrame, DataFrame | None]:
    """Stored words (w, n, lp, back, p), `lp` the logarithm of p, and what `end` names of the pairs: averages over the states after BURN sweeps.

    `words` has word, w and n (and m, its customers, where there are no pairs), `blocks` holds the pairs and is deleted. `back` is the share that the
    context of a word leaves to the corpus.
    """
    state = levels = shared = model = held = None
    kept: list[DataFrame] = []
    done_tables: list[DataFrame] = []
    if blocks is not None:
        known = stored(members(blocks), "members")
        less = known.select("id", "less_u", "less_w")
    tables = words.select("word", "w", (F.col("n" if blocks is not None else "m") > 0).cast("long").alias("t"))
    for sweep in range(sweeps + 1):
        again = sweep < sweeps
        if blocks is None:
            now = words.select("word", "w", "n", "m", F.lit(0).alias("room")).join(tables.select("w", "t"), "w")
        else:
            joined = by_id(words).join(tables.select("w", "t"), "w").join(less, "id", "left")
            of_word = [F.greatest(F.col("n") - F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("less_w", "less_u")]
            now = joined.select("word", "w", "n", of_word[0].alias("m"), of_word[1].alias("room"), "t")
        now = stored(now.select("word", "w", "n", "m", "room", F.least("t", "m").alias("t")), "state")
        total, seats = (x or 0 for x in now.agg(F.sum("m"), F.sum("t")).first())
        done = stored(reseat_words(now, shared, model, total, seats, sweep), "words")
        if sweep >= BURN:
            kept.append(done.select("w", "n", "lp", "room"))
            done_tables.append(done)
        if blocks is not None:
            ids = by_id(done).groupBy("id").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("room").alias("room")).join(known.select("id", "pieces"), "id")
            if not again:
                # nothing reads these any more, and the answers to come take room
                discard(now, *(levels or []))
            release(words.sparkSession)
            last, held = held, stored(seat_blocks(blocks, ids, held, sweep, len(kept), None if again else end), "pairs")
            less = opened(held, SUMS, SUM_FIELDS).groupBy("id").agg(F.sum("less_u").alias("less_u"), F.sum("less_w").alias("less_w"))
            discard(*[x for x in (last, None if again else blocks) if x is not None])
        release(words.sparkSession)
        if again:
            tables = done.select("word", "w", "t")
            if shared is not None:
                shared.unpersist()
            levels, shared = spelling_model(tables, levels, sweep)
            model = levels[-1]
        discard(now, *([state] if state is not None and sweep <= BURN else []))
        state = done
    every = kept[0]
    for other in kept[1:]:
        every = every.union(other)
    back = (CONTEXT_STRENGTH + CONTEXT_DISCOUNT * F.col("room")) / (CONTEXT_STRENGTH + F.col("n"))
    # the mean of the states' probabilities around the largest; there are as many entries as states
    states = every.groupBy("w", "n").agg(F.collect_list("lp").alias("l"), F.max("lp").alias("most"), F.avg(back).alias("back"))
    mean = F.aggregate("l", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("most"))) / F.size("l")
    averaged = stored(states.select("w", "n", (F.col("most") + F.log(mean)).alias("lp"), "back").withColumn("p", F.exp("lp")), "averages")
    discard(*done_tables, *(levels or []), *([known] if blocks is not None else []))
    release(words.sparkSession)
    return averaged, held


def word_probabilities(words: DataFrame) -> DataFrame:
    """(w, n, p, lp, back) of the corpus restaurant alone, from words (word, w, n, m)."""
    return fitted(words, None)[0]


def said(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["piece", "kind", "data"])


def dealt(piece: np.ndarray, row: np.ndarray, kind: int, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(piece, kind, data): for each piece the `values` of its rows, column after column; a row that a piece names twice is sent once."""
    for share in shares(piece.view("<u4")):
        order = share[np.lexsort((row[share], piece[share]))]
        own, of = piece[order], row[order]
        once = np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])]
        own, of = own[once], of[once]
        cut = summed_runs(own)
        yield from said([(int(own[a]), kind, b"".join(v[of[a:b]].tobytes() for v in values)) for a, b in zip(cut, np.r_[cut[1:], len(own)], strict=True)]).to_batches()


def answers(rows: DataFrame, kind: int, columns: list[tuple[str, str]]) -> DataFrame:
    """(piece, kind, data): `columns` (name, numpy type) of `rows`, sent to each of the row's `pieces` (an array, or packed), column after column."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in tables]).astype(t) for c, t in columns]
            lists = pa.concat_arrays([b.column("pieces") for b in tables])
            if pa.types.is_list(lists.type):
                size, piece = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype("<i4")
            else:
                lists = lists.cast(pa.large_binary())
                ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1] // 4
                size, piece = np.diff(ends), np.frombuffer(lists.buffers()[2] or b"", "<i4")[ends[0] : ends[-1]]
            yield from dealt(piece, np.repeat(np.arange(len(lists), dtype=np.int32), size), kind, values)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return rows.select(*[c for c, _ in columns], "pieces").mapInArrow(lean(sent), SAID)


#: What a piece is told of its words and of its pairs.
WORD_FIELDS = [("w", "<i8"), ("n", "<i8"), ("lp", "<f4"), ("back", "<f4")]
PAIR_FIELDS = [("k", "<i8"), ("p", "<f4")]


def told(data: list[bytes], fields: list[tuple[str, str]]) -> list[np.ndarray]:
    """The columns that `answers` packed."""
    width, out = sum(np.dtype(t).itemsize for _, t in fields), [[] for _ in fields]
    for blob in data:
        n, at = len(blob) // width, 0
        for k, (_, t) in enumerate(fields):
            out[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, (_, t) in zip(out, fields, strict=True)]


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of `docs` (doc_id, text, held_out, piece)."""
    spark = docs.sparkSession
    words = stored(word_table(docs, max(1, docs.count() // ROWS)), "counts")
    total, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first())
    release(spark)
    blocks = stored(pair_blocks(docs, max(1, total // PART)), "blocks")
    release(spark)
    every, of_pairs = fitted_blocks(words, blocks)
    low = np.log10(total + 0.1 * (distinct + 1))
    of_words = stored(answers(every.join(words.select("w", "pieces"), "w"), ASKED, WORD_FIELDS), "answers")
    discard(words, every)
    release(spark)
    replies = of_words.union(of_pairs)

    def score(texts: pa.Table, answer: pa.Table) -> pa.Table:
        reader, kind, data = Reader(), answer["kind"].to_pylist(), answer["data"].to_pylist()
        w, n, lp, back = told([x for x, k in zip(data, kind, strict=True) if k == ASKED], WORD_FIELDS)
        order = np.argsort(w.view(np.uint64))
        w, n, lp, back = w.view(np.uint64)[order], n[order], lp[order].astype(np.float64), np.log(back[order].astype(np.float64))
        base, alone, stop = np.log10(n + 0.1) - low, np.log((1.0 - CONTEXT_DISCOUNT) / (CONTEXT_STRENGTH + n)), np.searchsorted(w, np.uint64(STOP))
        key, q = told([x for x, k in zip(data, kind, strict=True) if k == ANSWER], PAIR_FIELDS)
        del data
        order = np.argsort(key.view(np.uint64))
        key, q = key.view(np.uint64)[order], np.log(q[order].astype(np.float64))
        held = texts["held_out"].to_numpy().astype(bool)
        out = []
        for slab in slabs(pa.concat_arrays(texts["text"].chunks) if len(texts) else pa.array([], pa.string()), reader):
            word, before = with_ends(slab)
            of = np.searchsorted(w, word)
            prior = np.r_[stop, of[:-1]]
            text = np.repeat(np.arange(len(slab.ends)), np.diff(slab.bounds) + 1)
            left, logs = np.arange(len(word)), np.zeros(len(word))
            if len(key):
                k = pair_key(short(before), short(word))
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                kept = key[at] == k
                logs[kept], left = q[at[kept]], np.flatnonzero(~kept)
            own = np.where(held[slab.rows[0] : slab.rows[1]][text[left]], -np.inf, alone[prior[left]])
            logs[left] = np.logaddexp(own, back[prior[left]] + lp[of[left]])
            rows = len(slab.ends)
            out.append([np.bincount(text, minlength=rows), np.bincount(text, n[of] > 0, rows), np.bincount(text, base[of], rows), np.bincount(text, logs / np.log(10.0), rows)])
        made = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        give_back()
        return pa.table([texts["doc_id"], texts["held_out"], pa.array(made[0].astype(np.int64)), pa.array(made[1].astype(np.int64)), pa.array(made[2]), pa.array(made[3])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    texts = docs.select("doc_id", "text", "held_out", "piece")
    rounds = []
    for k in range(ROUNDS):
        # texts and answers are shuffled a share of the pieces at a time
        own, of_own = (x.where(F.col("piece") % ROUNDS == k).groupBy("piece") for x in (texts, replies))
        rounds.append(stored(own.cogroup(of_own).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores"))
        release(spark)
    discard(of_words, of_pairs)
    made = rounds[0]
    for other in rounds[1:]:
        made = made.union(other)
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_documents(docs: DataFrame) -> DataFrame:
    """`scores` of any table with doc_id, text and held_out: it is stored first, since pieces are places in files."""
    return scores(with_piece(stored(docs.select("doc_id", "text", "held_out"), "texts"), "doc_id", "text", "held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "documents")
    names = [f"_c{i}" for i in range(len(scan.columns))]
    doc_id, text = (F.col(names[scan.columns.index(c)]).alias(c) for c in ("doc_id", "text"))
    docs = with_piece(scan.select("*", "_metadata").toDF(*names, "_metadata"), doc_id, text)
    return scores(docs.withColumn("held_out", remainder(F.col("doc_id"), 10) == 0))
