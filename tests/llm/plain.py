"""Plain forms of operators over a few texts in memory."""

import itertools
import re


def shingles(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def least_of_links(texts):
    """For each id the smallest one that links reach."""
    sets, least = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def kept_bytes(texts, size=100):
    """Each text's bytes without those covered by a string of so many bytes that starts earlier, texts in order."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            part = raw[i : i + size]
            if part in seen:
                gone[i : i + size] = [True] * size
            seen.add(part)
        out.append(bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out
