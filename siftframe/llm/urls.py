"""URL verdicts: host and path rules first, else a weighted vocabulary found by Aho-Corasick.

A *rule* names a host and the beginning of a path. It fits its host and all subdomains when the
path of the url starts with the rule's; the longest fitting rule (host and path together; of equally
long ones that with the longer host) gives the verdict. Urls without one are read once, whole, by an
Aho-Corasick automaton of all terms. A hit counts where no ASCII letter stands directly before or
after it, so that ``bets`` hits ``free-bets24`` but not ``alphabets``. Every *distinct* term adds its
weight once: a strict term weighs LIMIT and blocks alone, soft ones block from several on.

Rules and terms are lists of the caller, sent to every executor as one broadcast. They are bounded
by what a driver holds (a public blocklist has some million hosts), not by the urls. Urls are judged
where they lie: nothing shuffles, and a host with any share of the rows is no group.

Defined results: a null url is judged as the empty text; without ``://`` host and path are empty and
the vocabulary still applies to the whole url; only A-Z is lower-cased, %-escapes and international
names are taken as they are written; user names and ports belong to the host; an empty table gives an
empty table; repeated rows are judged alike; columns of the input with names of the result are
replaced by it, all others are carried.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import filled, fresh

ADDED = ("host", "path", "rule", "verdict", "weight", "terms")
LIMIT = 4
STRICT = 4
SOFT = 2
WEAK = 1

#: Terms that tell what a site is by themselves.
STRICT_TERMS = (
    "porn porno pornos xxx hentai milf camgirl camgirls escort escorts sexcam sexcams nsfw adult casino casinos sportsbook"
    " viagra cialis levitra warez keygen malware phishing spam spammer linkfarm"
).split()
#: Terms that clean urls have now and then, but rarely two of them.
SOFT_TERMS = (
    "sex sexy nude nudes erotic fetish hookup dating bet bets betting poker slots jackpot roulette lottery gambling"
    " pill pills pharmacy drugs weightloss payday loan loans crypto forex cheap free bonus coupon coupons discount"
    " replica crack cracked torrent torrents ad ads adserver advert adverts track tracker tracking click clicks popup popunder affiliate"
).split()
#: Terms of many clean urls, which only add up with others.
WEAK_TERMS = "win winner online best hot live deal deals offer offers buy sale prize cash money farm download".split()

VOCABULARY: dict[str, int] = {**dict.fromkeys(WEAK_TERMS, WEAK), **dict.fromkeys(SOFT_TERMS, SOFT), **dict.fromkeys(STRICT_TERMS, STRICT)}

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_LETTERS = frozenset(string.ascii_lowercase)


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """``example.org/en/1`` is the host ``example.org`` with paths from ``/en/1`` on."""
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {verdict!r}")
        host, slash, path = text.partition("/")
        return cls(verdict, host.translate(_FOLD), slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of urls as columns."""
    after = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


class Judge:
    """Rules by host and the automaton of the terms."""

    def __init__(self, rules: Sequence[Rule], vocabulary: Mapping[str, int], limit: int = LIMIT):
        self.limit, self.by_host = limit, {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)
        self.automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            folded = term.translate(_FOLD)
            if folded:
                self.automaton.add_word(folded, (folded, int(weight)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        best, suffix = None, host
        while suffix:
            for rule in self.by_host.get(suffix, ()):
                if path.startswith(rule.path) and (best is None or (len(rule.host) + len(rule.path), len(rule.host)) > (len(best.host) + len(best.path), len(best.host))):
                    best = rule
            suffix = suffix.partition(".")[2]
        return best

    def terms(self, url: str) -> dict[str, int]:
        """Distinct terms of a url that stand between other characters than letters, with their weights."""
        text, found = url.translate(_FOLD), {}
        if not len(self.automaton):
            return found
        for last, (term, weight) in self.automaton.iter(text):
            first = last - len(term) + 1
            if (first == 0 or text[first - 1] not in _LETTERS) and (last + 1 == len(text) or text[last + 1] not in _LETTERS):
                found[term] = weight
        return found

    def judge(self, url: str, host: str, path: str) -> tuple[str | None, str, int, str]:
        """(rule, verdict, weight of the distinct terms, the terms)."""
        found = self.terms(url)
        weight = sum(found.values())
        rule = self.rule(host, path)
        verdict = rule.verdict if rule else "block" if weight >= self.limit else "allow"
        return rule and rule.host + rule.path, verdict, weight, " ".join(sorted(found))


def judge(pages: DataFrame, rules: Sequence[Rule], vocabulary: Mapping[str, int] = VOCABULARY, url: str = "url", limit: int = LIMIT) -> DataFrame:
    """The rows with host, path, rule, verdict, weight and terms; only urls visit Python."""
    shared = pages.sparkSession.sparkContext.broadcast((list(rules), dict(vocabulary), limit))

    @F.pandas_udf("rule string, verdict string, weight long, terms string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = Judge(*shared.value)
        for urls, hosts, paths in batches:
            yield pd.DataFrame([judge.judge(*x) for x in zip(urls, hosts, paths)], columns=["rule", "verdict", "weight", "terms"])

    host, path = host_and_path(filled(url))
    # a deterministic function may be run once for every field that is taken from it
    result = judged.asNondeterministic()(filled(url), host, path)
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ADDED]
    (name,) = fresh(pages, "judged")
    found = pages.select(*kept, host.alias("host"), path.alias("path"), result.alias(name))
    return found.select(*kept, "host", "path", *[F.col(name)[c].alias(c) for c in ADDED[2:]])
