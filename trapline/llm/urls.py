"""URL filter with a weighted vocabulary and host rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of unwanted sites. One strict term rejects; soft terms have weights and reject together.
STRICT = ("adult-video", "casino", "cheap-pills", "escort", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = {"bet": 0.5, "bonus": 0.5, "cheap": 0.5, "cracked": 0.75, "farm": 0.5, "free": 0.5, "jackpot": 0.75, "keygen": 0.75, "loans": 0.5, "pills": 0.75, "poker": 0.75, "spam": 0.75, "torrent": 0.75, "win": 0.5}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double"


@dataclass(frozen=True)
class Vocabulary:
    """Terms (lower case) and limits: a url is rejected on one strict term, or on several soft ones.

    Soft terms reject when at least ``soft_terms`` different ones are found and their weights sum
    to ``soft_weight`` or more.
    """

    strict: tuple[str, ...] = STRICT
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_terms: int = 2
    soft_weight: float = 1.0


def _ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path_end = min((i for i in (rest.find("?", end), rest.find("#", end)) if i >= 0), default=len(rest))
    return _ascii_lower(rest[:end]), rest[end:path_end]


def longest_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest fitting rule and its verdict. ``rules``: by host, the (path, verdict) pairs."""
    best, found = -1, None
    labels = host.split(".")
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start) and len(suffix) + len(start) > best:
                best, found = len(suffix) + len(start), (suffix + start, verdict)
    return found


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term in {*vocabulary.strict, *vocabulary.soft}:
        machine.add_word(term, term)
    machine.make_automaton()
    return machine


def terms_in(text: str, machine: ahocorasick.Automaton) -> set[str]:
    """Terms of the vocabulary that stand in ``text`` (lower case) with no ASCII letter or digit beside them."""
    inside = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    return {term for last, term in machine.iter(text) if not inside(last + 1) and not inside(last - len(term))}


def judge(url: Column, vocabulary: Vocabulary | None = None, rules: list[tuple[str, str]] = ()) -> Column:
    """Struct of host, path, rule, verdict and the hits of each url.

    ``rules`` are (``allow`` or ``block``, ``host/path``); a rule fits its host and all subdomains
    if the url's path starts with the rule's, and the longest one decides. Without one the
    vocabulary does, over the whole url in lower case: ``block`` or ``allow``.

    Null, empty and schemeless urls have an empty host and path and fit no rule; a null has no
    terms and is allowed. Very long urls are read whole. No shuffle: a url is judged by itself.
    """
    vocabulary = vocabulary or Vocabulary()
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(_ascii_lower(host), []).append(("/" + path, verdict))

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine, strict = (automaton(vocabulary) if vocabulary.strict or vocabulary.soft else None), set(vocabulary.strict)

        def one(url):
            host, path = split_url(url)
            found = terms_in(_ascii_lower(url), machine) if url and machine is not None else set()
            hard, soft = found & strict, sorted(found - strict)
            weight = sum(vocabulary.soft[t] for t in soft)
            rejected = bool(hard) or (len(soft) >= vocabulary.soft_terms and weight >= vocabulary.soft_weight)
            rule, verdict = longest_rule(host, path, by_host) or (None, "block" if rejected else "allow")
            return host, path, rule, verdict, len(hard), len(soft), float(weight)

        names = [c.split()[0] for c in RESULT.split(", ")]
        for urls in batches:
            yield pd.DataFrame([one(u if isinstance(u, str) else None) for u in urls], columns=names)

    return judged(url)


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", vocabulary: Vocabulary | None = None, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """``id_col`` and the parts of :func:`judge`, one row per row of ``pages``; other columns are left out."""
    return pages.select(F.col(id_col), judge(F.col(url_col), vocabulary, rules).alias("_judged")).select(id_col, "_judged.*")
