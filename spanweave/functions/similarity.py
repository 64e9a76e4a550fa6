"""String similarities used by the span search and the validator."""

from __future__ import annotations

from difflib import SequenceMatcher


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows (one machine-independent big integer)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); two empty strings are alike."""
    total = len(a) + len(b)
    return 1.0 if not total else 2.0 * lcs_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio between the common tokens and the common tokens with each side's rest."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both = " ".join(sorted(s & t))
    left, right = " ".join(sorted(s - t)), " ".join(sorted(t - s))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel_ratio(one, two)]
    if both:
        scores += [indel_ratio(both, one), indel_ratio(both, two)]
    return max(scores)


def token_similarity(a: str, b: str) -> float:
    """Mean of the token-sort and token-set ratios."""
    return (token_sort_ratio(a, b) + token_set_ratio(a, b)) / 2


def sequence_ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's ratio."""
    return SequenceMatcher(None, a, b).ratio()


def best_possible(la: int, lb: int) -> float:
    """No indel ratio of strings of these lengths can be greater."""
    return 1.0 if not la + lb else 2.0 * min(la, lb) / (la + lb)
