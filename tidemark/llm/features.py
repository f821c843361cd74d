"""Statistics of whole texts, counted on UTF-8 bytes and words."""

from __future__ import annotations

import numpy as np

#: What ``text_statistics`` returns, in order.
NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "repeats", "longest_run",
    "letters", "digits", "marks", "symbols", "upper", "lines_per_word", "distinct_lines", "stops_per_word", "capital_words", "one_letter_words",
)

_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = (
        1 if _c >= 0x80 or _ch.islower() else 2 if "A" <= _ch <= "Z" else 3 if _ch.isdigit() else 4 if _ch in ".,;:!?'\"()-" else 0 if _ch in " \t\n\r\v\f" else 5
    )


def _logit(share: float, n: int) -> float:
    """A share as smoothed log odds, which are closer to normal than shares are."""
    return float(np.log((share * n + 0.5) / (n - share * n + 0.5)))


def text_statistics(text: str | None) -> list[float]:
    """Numbers that tell prose from tables, symbol noise and repetition; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(NAMES) - 1)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, m)
    same = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, m - 1)
    run = int(np.diff(np.flatnonzero(np.concatenate(([True], ~same, [True])))).max())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    capital = sum(w[:1].isupper() for w in words)
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(np.log(sizes.mean())), float(np.log1p(sizes.std())),
        _logit(len(counts) / m, m), _logit(max(counts.values()) / m, m), _logit(int(same.sum()) / m, m), float(np.log(run)),
        _logit(kinds[1] / n, n), _logit(kinds[3] / n, n), _logit(kinds[4] / n, n), _logit(kinds[5] / n, n), _logit(kinds[2] / n, n),
        float(np.log((len(lines) + 0.5) / m)), _logit(len(set(lines)) / max(1, len(lines)), max(1, len(lines))),
        float(np.log((ends + 0.5) / m)), _logit(capital / m, m), _logit(int((sizes == 1).sum()) / m, m),
    ]
