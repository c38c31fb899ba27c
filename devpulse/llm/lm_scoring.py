"""Language-model scores from a backoff automaton whose n-grams are counted over the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.llm import words
from devpulse.plans.files import staged

#: added to every token's count, and for one unknown token
ADDED = 0.5
#: taken off every kept bigram's count
DISCOUNT = 0.75
#: bigrams seen less often are no arcs of the automaton; their mass goes to the failure arc
LEAST_COUNT = 2
#: text bytes of one block of documents, and of the documents for one shard of the counts
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20

END, START = (np.uint64(xxhash.xxh3_64_intdigest(name, seed=1)) for name in (b"end", b"start"))


class Model(NamedTuple):
    """What every task must know: sizes, and the contexts whose followers are dealt over several shards."""

    tokens: int
    types: int
    shards: int
    spread: dict[int, int]

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram probability."""
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.types + 1)))


class _Block:
    """The tokens of a block's texts: every word, then one end."""

    def __init__(self, texts: pa.Array, train: np.ndarray) -> None:
        found = words.split(texts, words.LOWER)
        n = len(found.offsets) - 1
        self.starts = found.offsets + np.arange(n + 1)
        size = int(self.starts[-1])
        last = self.starts[1:] - 1
        self.end, self.start = len(found.vocab), len(found.vocab) + 1
        self.hash_of = np.concatenate((words.hashes(found.vocab), [END, START])).astype(np.uint64)
        self.token = np.full(size, self.end, dtype=np.int64)
        inside = np.ones(size, bool)
        inside[last] = False
        self.token[inside] = found.ids
        self.before = np.empty(size, np.int64)
        self.before[1:] = self.token[:-1]
        self.before[self.starts[:-1]] = self.start
        self.train = np.repeat(train, np.diff(self.starts))

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Local tokens in use, in the order of their hashes, and their training counts."""
        counts = np.bincount(self.token[self.train], minlength=len(self.hash_of))
        used = np.unique(self.token)
        used = used[np.argsort(self.hash_of[used])]
        return used, counts[used]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and followers (local tokens), 32 bits of the follower's hash, training counts; in the order of the hashes."""
        rank = np.argsort(np.argsort(self.hash_of))
        short = (words.mixed(self.hash_of) >> np.uint64(32)).astype(np.uint64)
        code = (rank[self.before].astype(np.uint64) << np.uint64(32)) | short[self.token]
        _, at, inverse = np.unique(code, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, weights=self.train, minlength=len(at)).astype(np.int64)
        return self.before[at], self.token[at], short[self.token[at]], counts


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs; the first byte says how many."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


_PIECE = "shard int, block long, contexts binary, sizes binary, followers binary, counts binary"


def _piece_rows(shards: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(shards[part[0]]), {k: v[part] for k, v in columns.items()}


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate((starts, [len(values)])))


class _Requests:
    """A block's bigrams as dealt to the shards; the same each time it is made."""

    def __init__(self, block: _Block, model: Model) -> None:
        self.context, self.follower, short, counts = block.bigrams()
        context_hash = block.hash_of[self.context]
        here = set(context_hash[np.isin(context_hash, _u64(model.spread))].tolist())
        self.spread = [(h, size) for h, size in model.spread.items() if h in here]
        first = (words.mixed(context_hash) % np.uint64(model.shards)).astype(np.int64)
        shard = first.copy()
        for h, size in self.spread:
            mine = context_hash == np.uint64(h)
            shard[mine] = (first[mine] + (short[mine] % np.uint64(size)).astype(np.int64)) % model.shards
        self.pair_shard = shard
        self._pairs = {"context": context_hash, "short": short.astype(np.uint32), "count": counts}
        self.shards = model.shards

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, contexts, followers of each, the followers, their training counts)."""
        met: set[int] = set()
        for shard, part in _piece_rows(self.pair_shard, self._pairs):
            starts, sizes = _runs(part["context"])
            met.add(shard)
            yield shard, *self._with_spread(shard, part["context"][starts], sizes), part["short"], part["count"]
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for shard in sorted({s for h, size in self.spread for s in self._shards_of(h, size)} - met):
            yield shard, *self._with_spread(shard, *nothing), np.zeros(0, np.uint32), nothing[1]

    def _shards_of(self, context: int, size: int) -> list[int]:
        first = int(words.mixed(np.array([context], np.uint64))[0] % np.uint64(self.shards))
        return [(first + k) % self.shards for k in range(size)]

    def _with_spread(self, shard: int, contexts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spread contexts are asked of all their shards, also of those without a follower of theirs."""
        more = [h for h, size in self.spread if shard in self._shards_of(h, size)]
        more = np.setdiff1d(np.array(more, np.uint64), contexts)
        return np.concatenate((contexts, more)), np.concatenate((sizes, np.zeros(len(more), np.int64)))


def _u64(values) -> np.ndarray:
    return np.array(list(values), dtype=np.uint64)


def _train_of(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["train"], False).to_numpy(zero_copy_only=False).astype(bool)


def _asked(model: Model):
    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        made = _Requests(_Block(table["text"].combine_chunks(), _train_of(table)), model).pieces()
        rows = [(shard, block, c.tobytes(), packed(s), f.tobytes(), packed(n)) for shard, c, s, f, n in made]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["shard", "block", "contexts", "sizes", "followers", "counts"]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return ask


_REPLY = "block long, shard int, stats binary, totals binary"


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]


def _answer(table: pa.Table) -> pa.Table:
    """All blocks' pieces of one shard to what each block asked for, in its order.

    For each context: its training followers in this shard, how many of them are
    kept pairs, and the number of kept pairs; for each pair its training count
    over all blocks, 0 for one that is not kept.
    """
    blocks, shards = table["block"].to_pylist(), table["shard"].to_pylist()
    contexts = _arrays(table["contexts"], np.uint64)
    sizes, counts = ([unpacked(x) for x in table[c].to_pylist()] for c in ("sizes", "counts"))
    _, context = np.unique(np.concatenate(contexts), return_inverse=True)
    of = np.repeat(context, np.concatenate(sizes)).astype(np.uint64)
    code = (of << np.uint64(32)) | np.concatenate(_arrays(table["followers"], np.uint32))
    unique, inverse = np.unique(code, return_inverse=True)
    sums = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
    kept = np.where(sums >= LEAST_COUNT, sums, 0)
    owner, n = (unique >> np.uint64(32)).astype(np.int64), int(context.max()) + 1
    stats = [np.bincount(owner, weights=x, minlength=n).astype(np.int64) for x in (sums, kept, kept > 0)]
    asked = np.split(context, np.cumsum([len(c) for c in contexts])[:-1])
    totals = np.split(kept[inverse], np.cumsum([len(c) for c in counts])[:-1])
    return pa.table(
        {
            "block": pa.array(blocks, pa.int64()),
            "shard": pa.array(shards, pa.int32()),
            "stats": pa.array([packed(np.concatenate([x[own] for x in stats])) for own in asked], pa.binary()),
            "totals": pa.array([packed(t) for t in totals], pa.binary()),
        }
    )


class BackoffAutomaton:
    """States are the last word read.  An arc spells a kept bigram; any other word takes the failure arc to the root first."""

    def __init__(self, size: int, start: int, root: np.ndarray, fail: np.ndarray, arcs: dict[int, float]) -> None:
        self.size, self.start = size, start
        self.root, self.fail, self.arcs = root.tolist(), fail.tolist(), arcs

    def score(self, tokens: list[int]) -> float:
        """log10 of the probability of a sequence, read once from left to right."""
        arcs, root, fail, size = self.arcs, self.root, self.fail, self.size
        state, total = self.start, 0.0
        for token in tokens:
            arc = arcs.get(state * size + token)
            total += fail[state] + root[token] if arc is None else arc
            state = token
        return total


def _built(block: _Block, asked: _Requests, model: Model, replies: pa.Table) -> tuple[BackoffAutomaton, np.ndarray]:
    """The automaton of the n-grams that a block can meet, and the training count of each of its tokens."""
    size = len(block.hash_of)
    kept = np.zeros(len(asked.context), np.int64)
    stats: dict[int, np.ndarray] = {}
    contexts = {shard: c for shard, c, *_ in asked.pieces()}
    for shard, numbers, totals in zip(*(replies[c].to_pylist() for c in ("shard", "stats", "totals"))):
        kept[asked.pair_shard == shard] = unpacked(totals)
        for h, row in zip(contexts[shard].tolist(), unpacked(numbers).reshape(3, -1).T):
            stats[h] = stats[h] + row if h in stats else row
    of_state = np.zeros((size, 3), np.int64)
    for i, h in enumerate(block.hash_of.tolist()):
        if h in stats:
            of_state[i] = stats[h]
    # a word has as many followers as it has places; there are as many ends as starts
    counts = of_state[:, 0].copy()
    counts[block.end] = counts[block.start]
    root = model.base(counts)
    seen = np.maximum(of_state[:, 0], 1)
    left = 1.0 - (of_state[:, 1] - DISCOUNT * of_state[:, 2]) / seen
    own = np.flatnonzero(kept)
    context, follower = asked.context[own], asked.follower[own]
    weight = np.log10((kept[own] - DISCOUNT) / seen[context] + left[context] * 10.0 ** root[follower])
    arcs = dict(zip((context * size + follower).tolist(), weight.tolist()))
    return BackoffAutomaton(size, block.start, root, np.log10(left), arcs), counts


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model):
    def score(docs: pa.Table, replies: pa.Table) -> pa.Table:
        train = _train_of(docs)
        block = _Block(docs["text"].combine_chunks(), train)
        automaton, counts = _built(block, _Requests(block, model), model, replies)
        known = counts[block.token] > 0
        base = np.asarray(automaton.root)[block.token]
        starts = block.starts.tolist()
        each = [(a, b) for a, b in zip(starts, starts[1:])]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array(~train),
                "n_tokens": pa.array(np.diff(block.starts), pa.int64()),
                "n_known": pa.array([int(known[a:b].sum()) for a, b in each], pa.int64()),
                "train_tokens": pa.array([model.tokens] * len(each), pa.int64()),
                "base_score": pa.array([float(base[a:b].sum()) for a, b in each], pa.float64()),
                "score": pa.array([automaton.score(block.token[a:b].tolist()) for a, b in each], pa.float64()),
            }
        )

    return score


def _word_counts(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            block = _Block(batch["text"], np.ones(batch.num_rows, bool))
            used, counts = block.unigrams()
            hashed = block.hash_of[used]
            parts = list(_piece_rows((words.mixed(hashed) % np.uint64(shards)).astype(np.int64), {"hash": hashed, "count": counts}))
            yield pa.record_batch(
                {
                    "shard": pa.array([s for s, _ in parts], pa.int32()),
                    "words": pa.array([p["hash"].tobytes() for _, p in parts], pa.binary()),
                    "counts": pa.array([packed(p["count"]) for _, p in parts], pa.binary()),
                }
            )

    return count


def _totals(most: int):
    def total(table: pa.Table) -> pa.Table:
        hashed, inverse = np.unique(np.concatenate(_arrays(table["words"], np.uint64)), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([unpacked(x) for x in table["counts"].to_pylist()])).astype(np.int64)
        top = np.argsort(-sums, kind="stable")[:most]
        rows = {"word": hashed[top].view(np.int64), "n": sums[top], "types": np.zeros(len(top), np.int64)}
        whole = {"word": [0], "n": [int(sums.sum())], "types": [len(hashed)]}
        return pa.table({k: pa.array(np.concatenate((whole[k], rows[k])), pa.int64()) for k in rows})

    return total


def learn(train: DataFrame, shards: int, text: str = "text") -> Model:
    """The sizes of the training text and the contexts that need several shards; at most two for each shard."""
    most = 2 * shards
    counted = train.select(F.col(text).alias("text")).mapInArrow(_word_counts(shards), "shard int, words binary, counts binary")
    found, _ = staged(counted.groupBy("shard").applyInArrow(_totals(most), "word long, n long, types long"), "totals")
    # per shard one row of sums and its most frequent words
    sums = found.withColumn("whole", F.col("types") > 0)
    tokens, types = sums.agg(F.sum(F.when(F.col("whole"), F.col("n"))), F.sum("types")).first()
    tokens, types = tokens or 0, types or 0
    frequent = sums.where(~F.col("whole") & (F.col("n") * most > tokens)).select("word", "n").limit(most).collect()
    spread = {r.word % (1 << 64): min(shards, -(-r.n * most // tokens)) for r in frequent}
    return Model(tokens, types, shards, {h: s for h, s in sorted(spread.items()) if s > 1})


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    ``train`` is a condition: the model learns from the rows where it is true,
    the others are held out.  Tokens are the words between ASCII white space, A-Z
    lower-cased, and one end for each text.  ``base_score`` sums log10 of the
    unigram probabilities (c + 0.5) / (N + 0.5 (V + 1)); ``score`` is log10 of
    the probability of the text under an interpolated bigram model with absolute
    discounting, read from a backoff automaton in one pass: bigrams seen twice or
    more in training are arcs, the rest of a word's mass is its failure arc.

    The model grows with the corpus and is never held in one place.  Documents
    are dealt into blocks of about 8 MB; each block sends its distinct n-grams
    with their training counts, as packed arrays, to shards dealt by context,
    and gets back the sums over all blocks for its own n-grams, from which it
    builds the part of the automaton that its texts can reach.  A context with
    more than its share of the text is dealt over several shards.  Within a
    context, followers are told apart by 32 bits of their hash.

    Null and empty texts are one end token.  A row whose condition is null is
    held out.  Each row gives one row; rows may repeat and ids may be null.  With
    nothing to learn from, all probabilities are 1.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = 1 + size // BLOCK_BYTES, 1 + size // SHARD_BYTES
    model = learn(plain.where("train"), shards)
    dealt = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    pieces = dealt.groupBy("block").applyInArrow(_asked(model), _PIECE)
    replies = pieces.groupBy("shard").applyInArrow(_answer, _REPLY)
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scored(model), _SCORE)
