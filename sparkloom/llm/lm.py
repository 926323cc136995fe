"""Language-model scoring with sharded Elias-Fano n-gram tries.

Documents are tokenized once, into *blocks* of about ``BLOCK_TOKENS`` tokens with a dictionary of their own. Words
are dealt out by hash; each shard sums up the blocks' counts and answers every block with its words' counts and
ids. Then neighbouring pairs, as ids, are dealt out by context, each with the quantised unigram probability of its
second word; each shard sums up the training counts, builds a memory-mapped trie of the smoothed probabilities and
answers every block with that of each pair it asked for. A block asks once for each distinct word and pair, so that
frequent ones cost no more than rare ones, and contexts with over ``1 / HOT`` of all tokens are dealt out by successor
too. Nothing that grows with the corpus is gathered on the driver or sent to all executors.

A token's probability is ``(1 - l) c(u w) / c(u) + l P(w)``, with the smoothed unigram ``P(w) = (c + a) / (N + a (V + 1))``
and the back-off weight ``l = (1 + c(u)) ** -POWER``, which falls as the share of new words after a context does (Heaps'
law): for a pair in the trie it is the pair's entry, for another one the context's weight times ``P(w)``. Before its
first word a text has the context "end".

Defined results: a null text counts as empty and has its end as only token; ids may be of any type; a null id is never
held out; repeated rows are counted and scored as often as they occur; with nothing to learn from all scores are 0;
extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, partitions, slices, table, written
from .eliasfano import Trie, quantised, restored

BLOCK_TOKENS = 2_000_000
ADD = 0.1
HOT = 1024
#: The power by which a context's back-off weight falls with its count.
POWER = 0.25
END = b"\n"  # no word has it

BLOCK = "block long, ids array<{}>, held array<boolean>, lengths binary, tokens binary, places binary, words binary, counts binary"
#: A message of one block to one shard, or an answer; its arrays are compressed.
MESSAGE = "shard int, block long, a binary, b binary, c binary, d binary"


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers, each of their bytes on its own as far as any is set: the first bytes of all, then the
    second ones, compressed. Hashes of 64 bits come back as negative numbers and are viewed as unsigned."""
    wide = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    bytes_of = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = [pa.compress(bytes_of[:, k].tobytes(), codec="zstd", asbytes=True) for k in range(wide)]
    return np.array([len(values), *map(len, planes)], "<u8").tobytes().ljust(72, b"\0") + b"".join(planes)


def unpacked(data: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(data, "<u8", 9).tolist()
    out, at = np.zeros(n, "<i8"), 72
    for k, size in enumerate(sizes if n else ()):
        if size:
            out.view(np.uint8).reshape(-1, 8)[:, k] = np.frombuffer(pa.decompress(data[at : at + size], n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return out


def rises(values: np.ndarray) -> np.ndarray:
    """Steps from one to the next; ``np.cumsum`` takes them back."""
    return np.diff(values, prepend=values.dtype.type(0))


def folded(values: np.ndarray) -> np.ndarray:
    """Integers of either sign as small non-negative ones."""
    return values << 1 ^ values >> 63


def unfolded(values: np.ndarray) -> np.ndarray:
    return values >> 1 ^ -(values & 1)


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenized documents, many to a row. Token 0 is the end; the others are numbered from frequent to rare. ``words``
    has their hashes, rising, as steps, ``counts`` their training counts in that order, ``places`` their numbers."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId(), 0
        ids, held, tokens, lengths, known, total = [], [], [], [], {END: 0}, 0

        def row() -> pa.RecordBatch:
            nonlocal number
            flat = np.concatenate(tokens).astype(np.int64)
            size = np.array(lengths, np.int64)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            order = np.argsort(-np.bincount(flat, minlength=len(known))[1:], kind="stable") + 1
            numbers = np.zeros(len(known), np.int64)
            numbers[order] = np.arange(1, len(known))
            flat = numbers[flat]
            counts = np.bincount(flat[np.repeat(~np.array(held, bool), size)], minlength=len(known))
            by_hash = np.argsort(hashes)
            places = numbers[by_hash]
            columns = [[place << 32 | number], [ids], [held], *([packed(x)] for x in (size, flat, places, rises(hashes[by_hash]), counts[places]))]
            number += 1
            kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), *[pa.binary()] * 5]
            names = ["block", "ids", "held", "lengths", "tokens", "places", "words", "counts"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for part in (piece for batch in parts for piece in slices(batch, 2)):
            kind = part.column(0).type
            for doc_id, is_held, text in zip(part.column(0), part.column(1), part.column(2), strict=True):
                found = WORD_BYTES.findall((text.as_py() or "").encode("utf-8", "replace").lower())
                own = [known.setdefault(w, len(known)) for w in found]
                own.append(0)
                ids.append(doc_id.as_py())
                held.append(is_held.as_py())
                tokens.append(np.array(own, np.int32))
                lengths.append(len(own))
                total += len(own)
                if total >= block_tokens:
                    yield row()
                    ids, held, tokens, lengths, known, total = [], [], [], [], {END: 0}, 0
        if ids:
            yield row()

    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", out.alias("held"), "text")
    return written(rows.mapInArrow(cut, BLOCK.format(dict(docs.dtypes)["doc_id"])), "blocks")


def by_shard(shard: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A permutation by shard, then by the other keys; the shards that occur, and where each begins."""
    places = np.lexsort((*order[::-1], shard))
    found, first = np.unique(shard[places], return_index=True)
    return places, found, np.append(first, len(places))


def messages(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "block", "a", "b", "c", "d"])


def ask_words(parts: DataFrame, shards: int) -> DataFrame:
    """Each block's words, as steps of their hashes, and training counts, to the words' shards, which are ranges of the
    hash."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(k) for k in range(3)), strict=True):
                w, c = np.cumsum(unpacked(words.as_py())).view(np.uint64), unpacked(counts.as_py())
                shard = ((w >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                found, first = np.unique(shard, return_index=True)
                rows = [
                    (int(s), block.as_py(), packed(rises(w[x:y])), packed(c[x:y]), None, None)
                    for s, x, y in zip(found, first, np.append(first[1:], len(w)), strict=True)
                ]
                yield from messages(rows).to_batches()

    return parts.select("block", "words", "counts").mapInArrow(ask, MESSAGE)


def answer_words(asked: DataFrame, shards: int) -> DataFrame:
    """Per message, the ranks of its words in the shard (``b``), from frequent to rare, and their corpus counts, as steps
    down in order of rank (``a``). In the first row of a shard ``c`` holds its sums: tokens and distinct words."""

    def answer(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        words = [np.cumsum(unpacked(x.as_py())).view(np.uint64) for x in group.column("a")]
        counts = np.concatenate([unpacked(x.as_py()) for x in group.column("b")])
        distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        falling = np.lexsort((distinct, -total))
        rank = np.empty(len(distinct), np.int64)
        rank[falling] = np.arange(len(distinct))
        total = total[falling]
        ends = np.cumsum([len(w) for w in words])
        rows = []
        for k, (block, own) in enumerate(zip(group.column("block"), np.split(rank[inverse], ends[:-1]), strict=True)):
            sums = packed(np.array([total.sum(), (total > 0).sum()])) if k == 0 else None
            rows.append((shard, block.as_py(), packed(np.abs(rises(total[np.sort(own)]))), packed(own), sums, None))
        return messages(rows)

    return asked.groupBy("shard").applyInArrow(answer, MESSAGE)


class Block:
    """A block with its words' corpus counts and ids filled in; ids are small for frequent words and set shards apart."""

    #: The columns that it is made of.
    COLUMNS = ("block", "held", "lengths", "tokens", "places")

    def __init__(self, row: pa.Table, answers: pa.Table, shards: int):
        get = lambda name: row.column(name)[0].as_py()
        self.number, self.held = get("block"), get("held")
        self.lengths, self.tokens, places = (unpacked(get(x)) for x in ("lengths", "tokens", "places"))
        self.count, self.id = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        answers, at = answers.sort_by("shard"), 0
        for shard, a, b in zip(*(answers.column(x) for x in ("shard", "a", "b")), strict=True):
            steps, rank = unpacked(a.as_py()), unpacked(b.as_py())
            own, at = places[at : at + len(rank)], at + len(rank)
            self.count[own[np.argsort(rank)]] = 2 * steps[:1] - np.cumsum(steps)
            self.id[own] = rank * shards + shard.as_py()
        if at < len(places):
            raise ValueError(f"block {self.number} got {at} answers to {len(places)} words")
        self.before = np.concatenate([[0], self.tokens[:-1]])  # a text begins after an end

    def pairs(self, shards: int, hot: float):
        """Distinct pairs of known words in order of their shards, with the training count of each and the counts of
        both words; which pair each token is (or -1), and the shards with their bounds."""
        u, w = self.before, self.tokens
        asked = np.flatnonzero((self.count[u] > 0) & (self.count[w] > 0))
        keys, inverse = np.unique(u[asked] << 32 | w[asked], return_inverse=True)
        trains = np.repeat(~np.array(self.held, bool), self.lengths)[asked]
        n = np.bincount(inverse, trains, len(keys)).astype(np.int64)
        of_u, of_w = self.count[keys >> 32], self.count[keys & 0xFFFFFFFF]
        context, successor = self.id[keys >> 32], self.id[keys & 0xFFFFFFFF]
        mixed = context * 0x9E3779B1 + np.where(of_u > hot, successor * 0x85EBCA77, 0)
        places, found, first = by_shard((mixed >> 7) % shards, context, successor)
        rank = np.empty(len(keys), np.int64)
        rank[places] = np.arange(len(keys))
        which = np.full(len(w), -1, np.int64)
        which[asked] = rank[inverse]
        return context[places], successor[places], n[places], of_u[places], of_w[places], which, found, first


def unigram(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return (count + ADD) / (n + ADD * (v + 1))


def backoff(count: np.ndarray) -> np.ndarray:
    return (1.0 + count) ** -POWER


def ask_pairs(parts: DataFrame, words: DataFrame, shards: int, hot: float, n: int, v: int) -> DataFrame:
    """Each block's distinct pairs to their shards: contexts with their counts and numbers of successors, packed
    together (``a``), successors (``b``) as places in a list of the distinct ones, training counts (``c``), and that list:
    ids and codes of their unigram, as steps (``d``)."""

    def ask(row: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(row, answers, shards)
        context, successor, seen, of_u, of_w, _, found, first = block.pairs(shards, hot)
        lower = quantised(unigram(of_w, n, v))
        rows = []
        for s, x, y in zip(found, first[:-1], first[1:], strict=True):
            start = np.flatnonzero(np.diff(context[x:y], prepend=-1))
            many = np.diff(np.append(start, y - x))
            own = np.concatenate([np.diff(context[x:y][start], prepend=0), many, of_u[x:y][start]])
            ids, one, place = np.unique(successor[x:y], return_index=True, return_inverse=True)
            listed = np.concatenate([rises(ids), folded(rises(lower[x:y][one].astype(np.int64)))])
            rows.append((int(s), block.number, *map(packed, (own, place, seen[x:y], listed))))
        return messages(rows)

    return parts.select(*Block.COLUMNS).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(ask, MESSAGE)


def answer_pairs(asked: DataFrame) -> DataFrame:
    """Per message the code of each pair (``a``) from the shard's trie."""

    def answer(group: pa.Table) -> pa.Table:
        asked, counts = [], []
        for a, b, c, d in zip(*(group.column(x) for x in "abcd"), strict=True):
            step, many, of_u = np.split(unpacked(a.as_py()), 3)
            place, (ids, codes) = unpacked(b.as_py()), np.split(unpacked(d.as_py()), 2)
            own, lower = np.cumsum(ids)[place], np.cumsum(unfolded(codes))[place]
            asked.append((np.repeat(np.cumsum(step), many), own, unpacked(c.as_py()), lower))
            counts.append(np.repeat(of_u, many))
        u, w, n, lower = map(np.concatenate, zip(*asked, strict=True))
        trained = np.flatnonzero(n)
        trained = trained[np.lexsort((w[trained], u[trained]))]
        u, w, of_u, p = u[trained], w[trained], np.concatenate(counts)[trained], restored(lower[trained])
        # of each pair's run of rows, the first
        first = np.flatnonzero((np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        total = np.add.reduceat(n[trained], first) if len(first) else n[:0]
        u, w, of_u, p = u[first], w[first], of_u[first], p[first]
        rows = []
        with tempfile.TemporaryFile() as file:
            rest = backoff(of_u)
            heads = np.flatnonzero(np.diff(u, prepend=-1))
            Trie.write(file, u, w, (1 - rest) * total / of_u + rest * p, rest[heads])
            trie = Trie.mapped(file)
            for k, (shard, block) in enumerate(zip(group.column("shard"), group.column("block"), strict=True)):
                context, successor, _, own = asked[k]
                codes = trie.lookup(context, successor, own)
                rows.append((shard.as_py(), block.as_py(), packed(codes), None, None, None))
        return messages(rows)

    return asked.groupBy("shard").applyInArrow(answer, MESSAGE)


SCORED = (
    "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def scored(parts: DataFrame, answers: DataFrame, shards: int, hot: float, n: int, v: int) -> DataFrame:
    """Every document's scores, from its block and all that its block was answered."""

    def score(row: pa.Table, got: pa.Table) -> pa.Table:
        of_words = got.filter(pa.compute.equal(got.column("kind"), 0))
        block = Block(row, of_words, shards)
        *_, which, _, _ = block.pairs(shards, hot)
        of_pairs = got.filter(pa.compute.equal(got.column("kind"), 1)).sort_by("shard")
        codes = [unpacked(x.as_py()) for x in of_pairs.column("a")]
        codes = np.concatenate([*codes, [0]])  # -1, no pair, takes the last
        alone = unigram(block.count, n, v)
        of_u = block.count[block.before]
        # words or contexts that were never seen
        without = backoff(of_u) * alone[block.tokens]
        p = np.where(which >= 0, restored(codes[which]), without)
        starts = np.cumsum(block.lengths) - block.lengths
        sums = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            {
                "doc_id": row.column("ids").combine_chunks().flatten(),
                "held_out": block.held,
                "n_tokens": block.lengths,
                "n_known": sums((block.count[block.tokens] > 0).astype(np.int64)),
                "train_tokens": np.full(len(starts), n),
                "base_score": sums(np.log10(alone)[block.tokens]),
                "score": sums(np.log10(p)),
            }
        )

    rows = parts.select(*Block.COLUMNS, "ids")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED.format(dict(parts.dtypes)["ids"][6:-1]))


def sums_of(answers: DataFrame, column: str, size: int) -> list[int]:
    """Sums over the shards' arrays in a column: one short row a shard is added up, on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += unpacked(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["k", "n"])

    rows = answers.filter(F.col(column).isNotNull()).select(column).mapInArrow(add, "k int, n long")
    found = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(size)]


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    shards = shards or partitions(docs.sparkSession)
    parts = blocks(docs, block_tokens)
    words = written(answer_words(ask_words(parts, shards), shards), "word-answers")
    n, v = sums_of(words, "c", 2)
    hot = n / HOT
    pairs = written(answer_pairs(ask_pairs(parts, words, shards, hot, n, v)), "pair-answers")
    answers = words.withColumn("kind", F.lit(0)).unionByName(pairs.withColumn("kind", F.lit(1)))
    return scored(parts, answers.select("block", "shard", "kind", "a", "b"), shards, hot, n, v)


def op2_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
