"""URL filter: rules for hosts and paths, else a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms and their weights.  A url goes when the weights of its distinct terms reach 1.
STRICT_TERMS = ("porn", "xxx", "casino", "viagra", "escort", "hentai", "camgirl", "jackpot", "malware", "phishing", "warez")
SOFT_TERMS = (
    "adult", "ads", "bet", "bets", "bonus", "cheap", "click", "dating", "discount", "free", "gambling", "hot", "loan",
    "nude", "pills", "poker", "sex", "slots", "spam", "torrent", "track", "win",
)
VOCABULARY = dict.fromkeys(STRICT_TERMS, 1.0) | dict.fromkeys(SOFT_TERMS, 0.5)
MOST_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """``block`` or ``allow``, and a host with a path, such as ``example.net/en/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


@lru_cache(maxsize=8)
def _automaton(vocabulary: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _bounded(text: str, start: int, end: int) -> bool:
    """No ASCII letter or digit touches text[start:end]."""
    around = (text[start - 1] if start else ""), text[end : end + 1]
    return not any(c.isascii() and c.isalnum() for c in around)


def terms_in(url: str, vocabulary: tuple[tuple[str, float], ...]) -> dict[str, float]:
    """The distinct terms that stand in a lower-cased url as whole words, with their weights."""
    hits = _automaton(vocabulary).iter(url) if vocabulary else ()
    return {term: weight for last, (term, weight) in hits if _bounded(url, last + 1 - len(term), last + 1)}


def term_weight(vocabulary: Mapping[str, float]):
    """A column function: the summed weight of the distinct terms of a url."""
    fixed = tuple(sorted(vocabulary.items()))

    @F.pandas_udf("double")
    def weigh(urls: pd.Series) -> pd.Series:
        return pd.Series([sum(terms_in(u, fixed).values()) if u else 0.0 for u in urls], dtype=float)

    return weigh


def _lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def judge(
    pages: DataFrame, rules: Iterable[Rule] = (), vocabulary: Mapping[str, float] = VOCABULARY, url: str = "url"
) -> DataFrame:
    """The columns of ``pages`` plus ``host``, ``path``, ``rule``, ``term_weight`` and ``verdict``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; the path goes on from there up to ``?``, ``#`` or the
    end.  Of the rules whose host is the url's or a parent domain of it and whose
    path begins the url's path, the one with the longest text decides.  Without
    one, terms of the vocabulary that stand in the lower-cased url with no ASCII
    letter or digit beside them are added up, each once: a weight of 1 (one
    strict term, or two soft ones) blocks.

    A null url or one without ``://`` has an empty host and path; a null or empty
    url meets no rule and no term and is allowed.  Rows are judged one by one, so
    repeated rows and empty tables need no care; columns of ``pages`` that have
    the name of a result are replaced.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.verdict))
    if len(ranked) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if len({r.text for r in ranked}) < len(ranked):
        raise ValueError("a host and path has two verdicts")
    source = F.col(url)
    out = pages.withColumns(
        {
            "host": F.coalesce(_lowered(F.regexp_extract(source, _URL, 1)), F.lit("")),
            "path": F.coalesce(F.regexp_extract(source, _URL, 2), F.lit("")),
            "term_weight": term_weight(vocabulary)(_lowered(source)),
        }
    )
    fits = [((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path)) for r in ranked]
    chosen, said = F.lit(None).cast("string"), F.when(F.col("term_weight") >= 1, "block").otherwise("allow")
    for r, fit in reversed(list(zip(ranked, fits))):
        chosen, said = F.when(fit, r.text).otherwise(chosen), F.when(fit, r.verdict).otherwise(said)
    return out.withColumns({"rule": chosen, "verdict": said})
