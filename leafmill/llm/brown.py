"""LM scoring with Brown's class-based bigrams, learned over all training texts.

Every word has one class. The chance of a word is that of its class after the class before, times that of the word in
its class; exchange clustering moves each word to the class that makes the training texts most likely. Words move at once,
given the class bigrams of the round before, so a round is one exchange between blocks of documents and shards of
words: blocks send what stands left and right of each word, by class, and shards answer with the new classes. Moves made
at once can spoil one another, so the likelihood of each round's classes is worked out, and the most likely ones are used.
The class bigrams, whose number is fixed, go to every shard. All of it is one plan, so the texts are shuffled once
and nothing passes through the driver but the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.blocks import block_count, text_size
from leafmill.llm.words import find_words, mix, slices

_WORD = "shard int, block int, words binary, values binary"
_ANSWER = "block int, shard int, bits binary"
#: Kinds of what a block is told; classes and class bigrams of round r have _ROUND * r added.
_COUNTS, _CLASSES, _FACTS, _GRID = range(4)
_ROUND = 4


class _Block:
    """Tokens of a block. number: each token's place among the block's distinct words, sorted by hash."""

    def __init__(self, table: pa.Table, shard_bits: int):
        self.keys, texts = table["key"].combine_chunks(), table["text"].combine_chunks()
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            words = find_words(texts.slice(a, b - a), lower=True)
            hashes.append(words.hashes())
            counts.append(words.counts())
        self.counts = np.concatenate(counts)
        self.words, self.number = np.unique(np.concatenate(hashes), return_inverse=True)
        self.held_out = table["held_out"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.trained = ~self.held_out[self.owner]
        self.cuts = np.append(np.searchsorted(self.words, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)), len(self.words))

    def shards(self) -> list[tuple[int, int, int]]:
        return [(s, a, b) for s, (a, b) in enumerate(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)) if b > a]

    def gathered(self, side: dict[int, bytes], kind: str) -> np.ndarray:
        """Answers of all shards, one for each distinct word."""
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(side[s], kind) for s, _, _ in self.shards())])

    def neighbours(self, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes before and after each token; texts begin after an end and are followed by one."""
        own = classes[self.number]
        before, after = np.full(len(own), end, np.int64), np.full(len(own), end, np.int64)
        inside = self.owner[1:] == self.owner[:-1]
        before[1:][inside], after[:-1][inside] = own[:-1][inside], own[1:][inside]
        return before, after

    def bigrams(self, classes: np.ndarray, end: int) -> np.ndarray:
        """Counts of (class, class after it) in training texts, ends among them."""
        before, after = self.neighbours(classes, end)
        own, n, t = classes[self.number].astype(np.int64), end + 1, self.trained
        out = np.bincount(before[t] * n + own[t], minlength=n * n)
        last = t.copy()
        last[:-1] &= self.owner[1:] != self.owner[:-1]
        out += np.bincount(own[last] * n + end, minlength=n * n)
        out[end * n + end] += int(((self.counts == 0) & ~self.held_out).sum())
        return out


def _first_classes(words: np.ndarray, top: np.ndarray, classes: int) -> np.ndarray:
    """Where clustering starts: the most frequent words alone, all others dealt out to the classes that are left."""
    out = (len(top) + (mix(words) % np.uint64(max(1, classes - len(top))))).astype(np.uint8)
    if len(top):
        order = np.argsort(top)
        at = np.minimum(np.searchsorted(top[order], words), len(top) - 1)
        hit = top[order][at] == words
        out[hit] = order[at[hit]]
    return out


def likelihood(grid: np.ndarray) -> float:
    """Log-likelihood of the training texts under the class bigrams of grid (from row to column), but for the sum of
    n * log n over all words, which doesn't hang on their classes."""
    part = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return part(grid) - part(grid.sum(axis=0)) - part(grid.sum(axis=1))


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return kind[-1].encode() + x.astype(kind).tobytes()


def _large(x: bytes, offset: int = 0) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[offset : offset + 1].decode()}", offset=offset + 1).astype(np.int64)


def _rows(columns: str, rows: list[tuple], key: pa.DataType | None = None) -> pa.Table:
    """rows under a schema that Spark reads as columns; one named key has the type given."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    named = [c.split() for c in columns.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], key if n == "key" else kinds[k]) for i, (n, k) in enumerate(named)})


def _joined(table: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Blocks, where the words of each begin, the distinct words of the shard, and the place of each word among them."""
    words = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
    distinct, number = np.unique(np.concatenate(words), return_inverse=True)
    return table["block"].to_pylist(), np.cumsum([0, *map(len, words)]).tolist(), distinct, number


def _side(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["shard"].to_pylist(), table["bits"].to_pylist(), strict=True))


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", classes: int = 64, rounds: int = 2, weight: float = 0.9, block_chars: int = 8_000_000) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each text.

    Tokens are words (runs of anything but ASCII white space, A-Z in lower case) and one end. The model learns from rows
    where held_out isn't true. base_score is that of add-one unigrams over all known words and one unknown. score is
    log10 of the chance of the text: weight * class bigrams + (1 - weight) * relative frequencies, of what is left after
    the chance of an unknown word, the share of words seen once. Null and empty texts are an end alone. Words are told
    apart by 64-bit hashes. Without training rows each token has chance 1.
    """
    if not 2 <= classes <= 254:
        raise ValueError("classes must be from 2 to 254")
    blocks = block_count(text_size(docs, text), block_chars)
    shard_bits, end, kind = max(5, (blocks - 1).bit_length()), classes, docs.schema[key].dataType
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int")
    texts = docs.select(block.alias("block"), F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")).repartition("block").groupBy("block")

    def count(table: pa.Table) -> pa.Table:
        b, name = _Block(table, shard_bits), table["block"][0].as_py()
        n = np.bincount(b.number[b.trained], minlength=len(b.words))
        rows = [(s, name, b.words[x:y].tobytes(), _small(n[x:y])) for s, x, y in b.shards()]
        return _rows(_WORD, [*rows, (1 << shard_bits, name, b"", np.int64((~b.held_out).sum()).tobytes())])

    def total(table: pa.Table) -> pa.Table:
        """Counts over all blocks. Under block -1, facts of the shard: tokens, words, words seen once, ends, and its most
        frequent words with their counts. The shard after the last has the ends."""
        shard = table["shard"][0].as_py()
        if shard == 1 << shard_bits:
            ends = sum(int(np.frombuffer(x, np.int64)[0]) for x in table["values"].to_pylist())
            return _rows(_ANSWER, [(-1, shard, np.array([ends, bool(ends), 0, ends], np.int64).tobytes())])
        names, cuts, distinct, number = _joined(table)
        n = np.bincount(number, weights=np.concatenate([_large(x) for x in table["values"].to_pylist()]), minlength=len(distinct)).astype(np.int64)
        top = np.lexsort((distinct, -n))[: classes // 2]
        facts = np.array([n.sum(), (n > 0).sum(), (n == 1).sum(), 0], np.int64).tobytes() + n[top].tobytes() + distinct[top].tobytes()
        return _rows(_ANSWER, [(names[i], shard, n[number[x:y]].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))] + [(-1, shard, facts)])

    def all_facts(table: pa.Table) -> pa.Table:
        """Facts of all shards as one: the four sums and the most frequent words. A kilobyte a shard at most."""
        sums, n, words = np.zeros(4, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for x in table["bits"].to_pylist():
            m = (len(x) - 32) // 16
            sums += np.frombuffer(x, np.int64, 4)
            n.append(np.frombuffer(x, np.int64, m, 32))
            words.append(np.frombuffer(x, np.uint64, m, 32 + 8 * m))
        n, words = np.concatenate(n), np.concatenate(words)
        top = np.lexsort((words, -n))[: int(min(classes // 2, (n > 0).sum()))]
        return pa.table({"bits": pa.array([sums.tobytes() + words[top].tobytes()], pa.binary())})

    counted = texts.applyInArrow(count, _WORD).groupBy("shard").applyInArrow(total, _ANSWER)
    facts = counted.filter("block = -1").groupBy("block").applyInArrow(all_facts, "bits binary")
    everywhere = lambda df, n, name: df.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name), "bits")
    side = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), F.col("shard") if "shard" in df.columns else F.lit(0).alias("shard"), "bits")
    known_everywhere = side(everywhere(facts, blocks, "block"), _FACTS)

    def over_blocks(run: Callable[[_Block, int, np.ndarray, dict], pa.Table], columns: str, *sides: DataFrame) -> DataFrame:
        """run on each block that has documents, with all that sides have for it and the classes of its words: those of
        the most likely round, if the class bigrams of rounds are among it, else those of the last round."""

        def both(t: pa.Table, told: pa.Table) -> pa.Table:
            if not t.num_rows:
                return _rows(columns, [], t.schema.field("key").type)
            b = _Block(t, shard_bits)
            of = {_COUNTS: {}} | {k: _side(told.filter(pc.equal(told["kind"], k))) for k in told["kind"].unique().to_pylist()}
            grids = {k // _ROUND: np.frombuffer(of[k][0], np.float64).reshape(end + 1, end + 1) for k in sorted(of) if k % _ROUND == _GRID}
            step = max(grids, key=lambda r: likelihood(grids[r])) if grids else max(k // _ROUND for k in of)
            of[_GRID] = grids.get(step)
            top = np.frombuffer(of[_FACTS][0], np.uint64, offset=32)
            own = b.gathered(of.get(_ROUND * step + _CLASSES, {}), "u1") if step else _first_classes(b.words, top, classes)
            return run(b, t["block"][0].as_py(), own, of)

        told = known_everywhere
        for more in sides:
            told = told.unionByName(more)
        return texts.cogroup(told.groupBy("block")).applyInArrow(both, columns)

    def pairs(b: _Block, name: int, own: np.ndarray, _: dict) -> pa.Table:
        return _rows("block int, counts binary", [(name, b.bigrams(own, end).tobytes())])

    def contexts(b: _Block, name: int, own: np.ndarray, _: dict) -> pa.Table:
        before, after = b.neighbours(own, end)
        n, t = 2 * (end + 1), b.trained
        codes, many = np.unique(np.concatenate([b.number[t] * n + before[t], b.number[t] * n + end + 1 + after[t]]), return_counts=True)
        word, place = codes // n, codes % n
        cuts = np.searchsorted(word, b.cuts)
        rows = []
        for s, x, y in b.shards():
            at = slice(cuts[s], cuts[s + 1])
            parts = _small(np.diff(word[at], prepend=x)), _small(place[at]), _small(many[at])
            rows.append((s, name, b.words[x:y].tobytes(), np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)))
        return _rows(_WORD, rows)

    def exchange(table: pa.Table, grid: pa.Table) -> pa.Table:
        """The best class of each word of a shard, given the class bigrams so far."""
        if not table.num_rows:
            return _rows(_ANSWER, [])
        counts = np.frombuffer(grid["bits"][0].as_py(), np.float64).reshape(end + 1, end + 1)
        size = counts.sum(axis=0)
        share = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * (end + 1)))
        left, right = share[:, :end].astype(np.float32), share[:end].T.astype(np.float32)
        log_size = np.where(size[:end] > 0, np.log(np.maximum(size[:end], 1)), 1e9).astype(np.float32)  # nothing moves to an empty class
        names, cuts, distinct, number = _joined(table)
        n = end + 1
        seen = np.zeros((len(distinct), 2 * n), np.float32)
        for first, data in zip(cuts, table["values"].to_pylist(), strict=False):
            sizes = np.frombuffer(data, "<u4", 3)
            a, b = 12 + int(sizes[0]), 12 + int(sizes[0]) + int(sizes[1])
            word, place, many = np.cumsum(_large(data[12:a])), _large(data[a:b]), _large(data[b:])
            np.add.at(seen, (number[first + word], place), many)
        best = (seen[:, :n] @ left + seen[:, n:] @ right - seen[:, :n].sum(axis=1, keepdims=True) * log_size).argmax(axis=1)
        best = np.where(seen.any(axis=1), best, 0).astype(np.uint8)
        shard = table["shard"][0].as_py()
        return _rows(_ANSWER, [(names[i], shard, best[number[x:y]].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])

    def grid_of(*sides: DataFrame) -> DataFrame:
        return _summed(over_blocks(pairs, "block int, counts binary", *sides), end + 1)

    sides: list[DataFrame] = []
    grids = [grid_of()]
    for step in range(rounds):
        grid = everywhere(grids[-1], 1 << shard_bits, "shard")
        moved = over_blocks(contexts, _WORD, *sides[-1:]).groupBy("shard").cogroup(grid.groupBy("shard")).applyInArrow(exchange, _ANSWER)
        sides.append(side(moved, _ROUND * (step + 1) + _CLASSES))
        grids.append(grid_of(sides[-1]))

    def result(b: _Block, _: int, own: np.ndarray, of: dict) -> pa.Table:
        tokens, known, once, trained = np.frombuffer(of[_FACTS][0], np.int64, 4).tolist()
        unseen = (once + 1) / (tokens + 1)
        n = b.gathered(of[_COUNTS], "<i8")
        grid = of[_GRID]
        used = (grid.sum(axis=0) > 0).astype(float)
        chance = (grid + 0.5 * used) / np.maximum(1e-9, grid.sum(axis=1, keepdims=True) + 0.5 * used.sum())
        size = np.maximum(1, grid.sum(axis=0))
        before, _ = b.neighbours(own, end)
        c, k = n[b.number], own[b.number].astype(np.int64)
        base = np.log10((c + 1) / (tokens + known + 1))
        with np.errstate(divide="ignore"):
            mine = np.log10(np.where(c > 0, (1 - unseen) * (weight * chance[before, k] * c / size[k] + (1 - weight) * c / max(1, tokens)), unseen))
        last = np.full(len(b.counts), end, np.int64)
        full = b.counts > 0
        last[full] = k[np.cumsum(b.counts)[full] - 1]
        end_base = np.log10((trained + 1) / (tokens + known + 1))
        ends = np.log10((1 - unseen) * (weight * chance[last, end] + (1 - weight) * trained / max(1, tokens))) if trained else np.full(len(last), np.log10(unseen))
        per = lambda x: np.bincount(b.owner, weights=x, minlength=len(b.counts))
        total = per(mine) + ends
        return pa.table({"key": b.keys, "held_out": pa.array(b.held_out), "n_tokens": pa.array(b.counts + 1), "n_known": pa.array(per(c > 0).astype(np.int64) + bool(trained)), "train_tokens": pa.array(np.full(len(total), tokens, np.int64)), "base_score": pa.array(per(base) + end_base), "score": pa.array(total), "perplexity": pa.array(10.0 ** np.minimum(300, -total / (b.counts + 1)))})

    columns = f"key {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    told = [side(everywhere(grid, blocks, "block"), _ROUND * step + _GRID) for step, grid in enumerate(grids)]
    return over_blocks(result, columns, side(counted.filter("block >= 0"), _COUNTS), *told, *sides).withColumnRenamed("key", key)


def _summed(parts: DataFrame, n: int) -> DataFrame:
    """One row (bits): the sum of all blocks' bigrams. Tasks add up first, so n * n numbers of each go on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    def grid(table: pa.Table) -> pa.Table:
        out = np.zeros(n * n)
        out[table["at"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"bits": pa.array([out.tobytes()], pa.binary())})

    sums = parts.select("counts").mapInArrow(rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return sums.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(grid, "bits binary")
