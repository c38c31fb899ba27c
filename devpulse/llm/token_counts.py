"""Token counts (operator 12): how many tokens a public byte-level BPE tokenizer makes of each text.

Method: whole-token shortcut.  The driver proves once, by merging each of them alone, which
vocabulary strings come out as one token.  Executors cut texts into pre-tokens and
count those strings as one token by a lookup; only the rest is merged.  A pre-token's
count does not depend on its neighbours, so the sum is the library's count.

The proof, the merges and the character classes in which the library differs from the
regular expressions used here are sent to the executors; their size is that of the
tokenizer file, whatever the corpus.  A null text is empty and has no token; rows stay
apart even if their ids are equal or null; columns other than the id and the text are
not read, so their names do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: the pre-tokens of the tokenizer family read here (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: counts of merged pre-tokens that a worker remembers; beyond it starts to remember anew
MOST_REMEMBERED = 300_000
#: from this length on pre-tokens are made one at a time and not as a list
LONG_TEXT = 1 << 20
#: symbols of a pre-token up to which the lowest pair is looked for in a plain loop
SHORT = 48
_NONE = 1 << 63
_SYMBOL = (1 << 32) - 1


@dataclass
class Rules:
    """What executors need of a tokenizer."""

    #: pre-tokens proven to be one token
    whole: frozenset[str]
    #: the symbol of each byte
    symbols: list[int]
    #: (left symbol << 32 | right symbol) to (rank + 1 << 32 | merged symbol)
    merges: dict[int, int]
    #: special strings, each one token
    special: list[str]
    #: a class of the characters that `regex` and the library see differently, or None
    odd: str | None
    #: the tokenizer without its vocabulary, for texts with such characters
    pre_tokenizer: str

    @cached_property
    def splitter(self):
        return regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.pre_tokenizer)

    @cached_property
    def odd_found(self):
        return re.compile(self.odd).search if self.odd else lambda text: None

    @cached_property
    def cut(self):
        longest_first = sorted(self.special, key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, longest_first))).finditer if longest_first else lambda text: ()

    @cached_property
    def costs(self) -> Costs:
        return Costs(self)

    def count(self, text: str) -> int:
        """Tokens of a text."""
        n, at = 0, 0
        for found in self.cut(text):
            n += 1 + sum(map(self.costs.__getitem__, self._pre_tokens(text[at : found.start()])))
            at = found.end()
        return n + sum(map(self.costs.__getitem__, self._pre_tokens(text[at:] if at else text)))

    def _pre_tokens(self, text: str) -> Iterable[str]:
        if not text.isascii() and self.odd_found(text):
            return (text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
        findall, finditer = self.splitter
        return findall(text) if len(text) < LONG_TEXT else (m.group() for m in finditer(text))


class Costs(dict):
    """Tokens of each pre-token: 1 where proven, else merged when first met."""

    def __init__(self, rules: Rules):
        super().__init__(dict.fromkeys(rules.whole, 1))
        self.rules = rules
        self.most = len(self) + MOST_REMEMBERED

    def __missing__(self, pre_token: str) -> int:
        n = merged_size([self.rules.symbols[b] for b in pre_token.encode()], self.rules.merges)
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(self.rules.whole, 1))
        if len(pre_token) <= 64:
            self[pre_token] = n
        return n


def merged_size(symbols: list[int], merges: dict[int, int]) -> int:
    """How many symbols are left when the pair of the lowest rank, of equals the leftmost, is merged until none is known."""
    if len(symbols) > SHORT:
        return _merged_size_long(symbols, merges)
    known = merges.get
    pairs = [known(a << 32 | b, _NONE) for a, b in zip(symbols, symbols[1:])]
    while pairs and (best := min(pairs)) != _NONE:
        at = pairs.index(best)
        made = best & _SYMBOL
        symbols[at : at + 2] = [made]
        del pairs[at]
        if at:
            pairs[at - 1] = known(symbols[at - 1] << 32 | made, _NONE)
        if at < len(pairs):
            pairs[at] = known(made << 32 | symbols[at + 1], _NONE)
    return len(symbols)


def _merged_size_long(symbols: list[int], merges: dict[int, int]) -> int:
    """The same with a heap of pairs and linked places, for pre-tokens of any length."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(p, i) for i in range(n - 1) if (p := merges.get(symbols[i] << 32 | symbols[i + 1]))]
    heapq.heapify(heap)
    left = n
    while heap:
        pair, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] < 0 or merges.get(symbols[i] << 32 | symbols[j]) != pair:
            continue  # one of the two has been merged since
        made = pair & _SYMBOL
        symbols[i], symbols[j] = made, -1
        left -= 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if p := merges.get(made << 32 | symbols[after[i]]):
                heapq.heappush(heap, (p, i))
        if (k := before[i]) >= 0 and (p := merges.get(symbols[k] << 32 | made)):
            heapq.heappush(heap, (p, k))
    return left


def _letters_of_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, with the byte.

    Bytes that print stand for themselves, the others follow from code point 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def read_rules(path: str) -> Rules:
    """The rules in a tokenizer file; a ValueError names what is not byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, pre = told["model"], told["pre_tokenizer"] or {}
    unknown = [
        name
        for name, wrong in {
            "model": model.get("type") != "BPE",
            "normalizer": told["normalizer"] is not None,
            "pre_tokenizer": pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True),
            "model options": any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")),
            "added tokens": any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }.items()
        if wrong
    ]
    vocab, of_letter = model["vocab"], _letters_of_bytes()
    if unknown or not all(c in vocab for c in of_letter):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer: {', '.join(unknown) or 'bytes are missing'}")
    symbols = [0] * 256
    for letter, byte in of_letter.items():
        symbols[byte] = vocab[letter]
    merges: dict[int, int] = {}
    for rank, pair in enumerate(model["merges"], 1):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
    whole = []
    for token in vocab:
        data = bytes(of_letter[c] for c in token if c in of_letter)
        if len(data) == len(token) and merged_size([symbols[b] for b in data], merges) == 1:
            try:
                whole.append(data.decode())
            except UnicodeDecodeError:
                pass  # a part of a character is no pre-token
    # the same pre-tokenizer with a vocabulary of nothing
    bare = json.dumps(told | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None})
    return Rules(frozenset(whole), symbols, merges, [t["content"] for t in told["added_tokens"]], _odd_class(bare), bare)


def _odd_class(tokenizer: str) -> str | None:
    """The characters that the library and `regex` put into different classes, found over all code points.

    Both cut the text of all characters into runs of one class; one character of each piece
    of such a run is then tried between a letter, a digit and a sign.
    """
    library = Tokenizer.from_str(tokenizer).pre_tokenizer
    pattern = regex.compile(PATTERN)

    def spans(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in pattern.finditer(text)]

    def library_spans(text: str) -> list[tuple[int, int]]:
        return [span for _, span in library.pre_tokenize_str(text)]

    every = "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]))
    edges = {0, len(every), *(x for cut in (spans(every), library_spans(every)) for span in cut for x in span)}
    edges = sorted(edges)
    pieces = [(c, c + 1) for c in range(128)]
    pieces += [(ord(every[a]), ord(every[b - 1]) + 1) for a, b in zip(edges, edges[1:])]
    odd = []
    for a, b in pieces:
        tried = "a{0}1{0}!{0}".format(chr(a))
        if spans(tried) != library_spans(tried):
            odd.append(f"\\U{a:08x}-\\U{b - 1:08x}")
    return f"[{''.join(odd)}]" if odd else None


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of each row; ``path`` is the tokenizer's file, read by the driver only.

    ``over_limit`` tells texts of more than ``limit`` tokens.
    """
    return docs.select(id, F.coalesce(text, F.lit("")).alias("_text")).select(
        id,
        F.octet_length("_text").cast("long").alias("n_bytes"),
        n_tokens(docs.sparkSession, "_text", path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def n_tokens(spark: SparkSession, text: str | Column, path: str) -> Column:
    """The number of tokens of a text column."""
    rules = spark.sparkContext.broadcast(read_rules(path))

    @F.arrow_udf("long")
    def counted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = rules.value.count
        for part in parts:
            yield pa.array((count(x.as_py() or "") for x in part), pa.int64())

    return counted(text)
