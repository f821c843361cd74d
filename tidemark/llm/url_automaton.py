"""URL filter: a bit-parallel wildcard automaton (multiword Shift-And with gaps).

All glob rules are compiled into one bit string of states, kept in as many 64-bit words as it takes.
One step for a byte ``c`` of the text is ``D = ((D << 1) & B[c]) | (D & S[c])``: ``B`` holds the states
that ``c`` leads into, ``S`` the states before a wildcard in which ``c`` is swallowed. So every rule is
followed at once, and a whole batch of URLs advances together, one byte a step.

Globs are matched against the canonical text ``.host/path``. ``*`` stands for any run without ``/``
(and so never leaves the host), ``**`` for any run, ``?`` for one byte other than ``/``; everything else
stands for itself.

Canonical form: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z in lower case; the path follows it up to ``?``, ``#`` or the end. Null and URLs without ``://``
have an empty host and path, fit no host rule and get the method's verdict. Very long URLs are
followed to their end. Repeated rows are judged alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, ship


@dataclass(frozen=True)
class HostRule:
    """Fits a host and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, ...]:
        return (f"*.{self.host}{self.path}**",)


# The host rules of the contract.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)

# Wildcard rules for URLs that no host rule fits; the rest is allowed.
BLOCK_GLOBS = (
    "*casino**", "*-bets.**", "*.bets.**", "*poker**", "*porn**", "*.xxx.**", "*.adult.**", "*.adult-**", "*-adult.**",
    "*pills**", "*viagra**", "*spam**", "*torrent**", "*.ads.**", "*.ads-**", "*adserver**", "*.tracker.**", "*.track.**",
    "**/ads/**", "**/adult/**", "**/casino/**", "**/login", "**/login/**", "**/cart", "**/cart/**", "**/cgi-bin/**",
    "**.exe", "**.zip", "**.gz", "**.apk", "**.jpg", "**.jpeg", "**.png", "**.gif", "**.mp3", "**.mp4", "**.css", "**.js",
)

_PARTS = re.compile(r"([^/?#]*)([^?#]*)")
_UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "page_id long, host string, path string, rule string, verdict string, glob string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, both empty for null or where there is no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_UPPER), path


class Automaton:
    """Many globs, anchored at both ends."""

    def __init__(self, globs: tuple[str, ...]):
        into: list[set[int]] = []
        stay: list[set[int]] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        anything, segment = set(range(256)), set(range(256)) - {0x2F}
        for g in globs:
            self.starts.append(len(into))
            into.append(set())
            stay.append(set())
            for part in re.findall(rb"\*\*|.", g.encode(), re.S):
                if part == b"**":
                    stay[-1] |= anything
                elif part == b"*":
                    stay[-1] |= segment
                else:
                    into.append(set(segment) if part == b"?" else {part[0]})
                    stay.append(set())
            self.ends.append(len(into) - 1)
        self.words = max(1, -(-len(into) // 64))
        self.B, self.S = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for table, sets in ((self.B, into), (self.S, stay)):
            for state, chars in enumerate(sets):
                for c in chars:
                    table[c, state // 64] |= np.uint64(1 << (state % 64))
        self.start = np.zeros(self.words, np.uint64)
        for s in self.starts:
            self.start[s // 64] |= np.uint64(1 << (s % 64))

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text, which globs match all of it: a boolean matrix."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        longest_first = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begins = (np.cumsum(sizes) - sizes)[longest_first]
        sizes = sizes[longest_first]
        D = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -i, side="left"))  # texts longer than i
            c = flat[begins[:live] + i]
            d = D[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            D[:live] = (moved & self.B[c]) | (d & self.S[c])
        out = np.zeros((n, len(self.ends)), bool)
        for g, e in enumerate(self.ends):
            out[longest_first, g] = (D[:, e // 64] >> np.uint64(e % 64)) & one > 0
        return out


def _judge(rules: tuple[HostRule, ...], block: tuple[str, ...]):
    # Longest rule first; of two as long, the one that blocks.
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(tuple(g for r in ranked for g in r.globs) + block)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hit = automaton.match([f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in parts])
            none = np.ones((len(parts), 1), bool)
            rule = np.hstack([hit[:, : len(ranked)], none]).argmax(axis=1) if parts else []
            glob = np.hstack([hit[:, len(ranked) :], none]).argmax(axis=1) if parts else []
            names = [ranked[k].name if k < len(ranked) else None for k in rule]
            globs = [block[k] if k < len(block) else None for k in glob]
            verdicts = [ranked[k].verdict if k < len(ranked) else "allow" if g is None else "block" for k, g in zip(rule, globs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], names, verdicts, globs))],
                names=["page_id", "host", "path", "rule", "verdict", "glob"],
            )

    return run


def judge(pages: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES, block: tuple[str, ...] = BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule (the host rule that won, else null), verdict, and the wildcard rule
    that matches, if any. A host rule decides before the wildcard rules."""
    ship(pages.sparkSession)
    return only(pages, "page_id", "url").mapInArrow(_judge(rules, block), SCHEMA)
