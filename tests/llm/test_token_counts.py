"""Token counts against the library."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from devpulse.llm import token_counts
from devpulse.llm.queries import TOKENIZER

from odd_documents import ODD_TEXTS, no_docs, odd_docs, rows  # noqa: F401

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def rules():
    return token_counts.read_rules(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_random_texts(rules, library):
    rng = random.Random(5)
    pool = ["a", "b", " ", "  ", "\n", "\r\n", "'s", "'LL", "'ll", "1", "23", "!", "--", "<|endoftext|>", "<|endoftext", "|>", "é", "中文", " ", " "]
    pool += ["\x00", "\x1c", "\x85", "​", "don't", " the", "The", "😀", "́", "՘", "࢏", "\U00010940", "\U0003134f", "\U0010ffff", "ſ", "Ⅷ", "²"]
    for _ in range(5000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        assert rules.count(text) == n_tokens(library, text), repr(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 9_000, "=-" * 5_000, "\n" * 9_999, "é" * 7_777, " " * 3_000 + "x", "<|endoftext|>" * 500])
def test_long_pre_tokens(rules, library, text):
    assert rules.count(text) == n_tokens(library, text)


def test_a_long_text_is_cut_one_pre_token_at_a_time(rules, library, monkeypatch):
    text = " ".join(f"word{i}, don't" for i in range(2_000))
    wanted = n_tokens(library, text)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 100)
    assert rules.count(text) == wanted


def test_counts_survive_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_REMEMBERED", 3)
    rules = token_counts.read_rules(PATH)
    for text in ["qzx wvk jjq xqz zzk qqp wvk jjq", "qzx wvk jjq the of"]:
        assert rules.count(text) == n_tokens(library, text)
    assert len(rules.costs) <= len(rules.whole) + 3


def test_the_two_ways_to_merge_agree(rules):
    rng = random.Random(2)
    for _ in range(300):
        symbols = [rules.symbols[b] for b in bytes(rng.choice(b"theinganers ") for _ in range(rng.randrange(1, 45)))]
        assert token_counts.merged_size(list(symbols), rules.merges) == token_counts._merged_size_long(list(symbols), rules.merges)


def test_proven_strings_are_one_token(rules, library):
    for text in random.Random(1).sample(sorted(rules.whole), 3000):
        assert len(library.model.tokenize("".join(t for t, _ in library.pre_tokenizer.pre_tokenize_str(text)))) == 1


def test_odd_documents(odd_docs, no_docs, library):
    got = rows(token_counts.token_counts(odd_docs, PATH, limit=100))
    wanted = [(i, len((t or "").encode()), n := n_tokens(library, t), n > 100) for i, t in ODD_TEXTS]
    assert got == sorted(wanted, key=lambda r: [str(v) for v in r])
    assert rows(token_counts.token_counts(no_docs, PATH)) == []


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="no plain byte-level BPE"):
        token_counts.read_rules(public_tokenizers.path("word_bpe_49k.json"))
    told = json.load(open(PATH, encoding="utf-8"))
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="pre_tokenizer"):
        token_counts.read_rules(str(tmp_path / "t.json"))
