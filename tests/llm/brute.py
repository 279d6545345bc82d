"""Plain versions of the operators, for small inputs: loops over whole lists, no Spark."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def components(rows, size, up, down):
    """(doc_id, set size, least doc_id of the component) of rows (doc_id, text), by all pairs; and the components."""
    sets = []
    for _, t in rows:
        w = spaced(ascii_lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and down * len(sets[i] & sets[j]) >= up * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = spaced(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def ballot(text):
    """The eight rules' votes on a text."""
    text = text or ""
    words, chars, symbols, dup, repeats, _ = measures(text)
    lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    upper, letters = len(re.findall(r"(?u)[^\W\d_]", "".join(c for c in text if c.isupper()))), sum(c.isalpha() for c in text)
    distinct = len(set(spaced(text)))
    w, c, a, k = max(words, 1), max(chars, 1), max(letters, 1), max(lines, 1)
    pairs = [
        (3 * w <= c <= 10 * w, c < 2 * w or c > 14 * w), (100 * symbols <= c, 20 * symbols >= c), (100 * symbols <= 5 * w, 100 * symbols >= 20 * w), (100 * letters >= 90 * c, 100 * letters < 86 * c),
        (10 * dup <= k, 10 * dup > 3 * k), (10 * repeats <= 2 * w, 10 * repeats > 4 * w), (10 * upper <= 2 * a, 10 * upper > 5 * a), (10 * distinct >= 3 * w, 10 * distinct < w),
    ]
    return [-1 if bad else 1 if good else 0 for good, bad in pairs]


def posteriors(ballots, rounds=30, prior=20.0):
    """Expectation-maximisation over single texts: the probability of each of being good."""
    share, right = 0.8, [(0.95, 0.8)] * 8

    def expect(votes):
        good, bad = share, 1 - share
        for v, (g, b) in zip(votes, right, strict=True):
            good *= {1: g, -1: 1 - g, 0: 1}[v]
            bad *= {1: 1 - b, -1: b, 0: 1}[v]
        return good / (good + bad)

    for _ in range(rounds):
        p = [expect(v) for v in ballots]
        new = []
        for k in range(8):
            up = [(q, v[k]) for q, v in zip(p, ballots, strict=True)]
            g = (math.fsum(q for q, v in up if v == 1) + 0.95 * prior) / (math.fsum(q for q, v in up if v) + prior)
            b = (math.fsum(1 - q for q, v in up if v == -1) + 0.8 * prior) / (math.fsum(1 - q for q, v in up if v) + prior)
            g = min(0.999, max(0.5, g))
            new.append((g, min(0.999, max(b, 1.02 - g))))
        share, right = min(0.99, max(0.3, (math.fsum(p) + 0.8 * prior) / (len(p) + prior))), new
    return [expect(v) for v in ballots]


def keeps(texts):
    p = posteriors([ballot(t) for t in texts])
    return [q >= 0.5 and not measures(t)[5] for q, t in zip(p, texts, strict=True)]


def hits(text, items, size=10):
    """n_words, n_hit, n_items, items_sha256 of a text against items (item_id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    own, hit, found = words(text), set(), set()
    places = {}
    for i, w in enumerate(own):
        places.setdefault(w, []).append(i)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            window = w[i : i + size]
            for at in places.get(window[0], []):
                if own[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


ALPHABETS = [
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxyz",
    *("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more for more in ("", "+/", "-_")),
]


def p_random(token):
    """The battery's p-value, from the definitions of its three statistics."""
    body = token.rstrip("=")
    alphabet = next((a for a in ALPHABETS if set(body) <= set(a)), None)
    n = len(body)
    if alphabet is None or n < 16:
        return None
    k, at = len(alphabet), [alphabet.index(c) for c in body]
    chi = sum((at.count(i) - n / k) ** 2 / (n / k) for i in range(k))
    p_chi = 0.5 * math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n) / math.sqrt(2))
    high = [2 * x >= k for x in at]
    a, b = sum(high), n - sum(high)
    if not a or not b:
        p_runs = 0.5 ** (n - 1)
    else:
        runs = sum(x != y for x, y in zip(high, high[1:])) + 1
        mean = 1 + 2 * a * b / n
        p_runs = math.erfc(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(2 * max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    middle = sum(at) / n
    power = sum((x - middle) ** 2 for x in at)
    serial = sum((x - middle) * (y - middle) for x, y in zip(at, at[1:])) / power if power else 1.0
    p_serial = math.erfc(abs(serial + 1 / n) * math.sqrt(n / 2))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def thresholds(found, level):
    """Length class -> largest bin that keeps the expected share of natural strings, from single finds (class, bin, natural)."""
    out = {}
    for c in {f[0] for f in found}:
        null = [b for k, b, natural in found if natural and k <= c]
        mixed = [b for k, b, natural in found if not natural and k == c]
        out[c] = -1
        some = min(1.0, (sum(b >= 8 for b in mixed) + 1) / max(sum(b >= 8 for b in null) / (len(null) + 1), 0.05) / max(len(mixed), 1))
        for t in range(64):
            false = (sum(b <= t for b in null) + 0.5) / (len(null) + 1) * len(mixed) * some
            if t in mixed and false <= level * sum(b <= t for b in mixed):
                out[c] = t
    return out
