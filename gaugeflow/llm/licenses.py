"""License scan by patience alignment.

A template is aligned with a text on the words that both have exactly once:
the longest increasing subsequence of their places anchors it, and the gaps
between anchors are aligned the same way. Coverage is the share of the
template's words that are aligned. A text can hold a notice many times, so
windows around the template's rarest words are aligned; what lies between the
places found so is aligned whole with longer templates.

Coverage alone can't tell near licences apart, as they differ in a word. So a
notice's own words (of its name, and its numbers) must be aligned, words that
make another licence of it (``VARIANTS``) may not stand among them, and where
templates overlap the one with most aligned words has the place.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, tidy, written
from .decontaminate import original_spans, words_of
from .license_texts import TEMPLATES

#: Words from which on a template is also aligned with a whole text.
LONG = 30
#: Words that name a variant of a licence.
VARIANTS = frozenset(("affero", "lesser", "library", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike"))


def own_words(name: str, template: list[str]) -> frozenset[str]:
    """Words that a notice can't lack: those of its licence's name and of
    variants that its text has, and in one-line notices its numbers. Whole
    texts have none, as they seldom name their licence."""
    if name.endswith("-text"):
        return frozenset()
    named = {*words_of(name.removesuffix("-notice")), *VARIANTS}
    return frozenset(w for w in template if w in named or (len(template) < LONG and w.isdigit()))


def names_it(words: list[str], pairs: list[tuple[int, int]], template: list[str], own: frozenset[str]) -> bool:
    """Whether aligned words have all of a notice's own words, and no word of a variant stands among them unaligned."""
    if not own:
        return True
    places = {i for i, _ in pairs}
    return own <= {template[j] for _, j in pairs} and not any(words[i] in VARIANTS and i not in places for i in range(pairs[0][0], pairs[-1][0] + 1))


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, last, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
        last[k : k + 1] = [i]
        before.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(place in text, place in template) of aligned words, both increasing."""
    out, stack = [], [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        both = [(j, place[w]) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        anchors = [both[i] for i in increasing([p for _, p in both])]
        for (j, i), (j2, i2) in zip([(c - 1, a - 1), *anchors], [*anchors, (d, b)], strict=True):
            if anchors and i + 1 < i2 and j + 1 < j2:
                stack.append((i + 1, i2, j + 1, j2))
        out += [(i, j) for j, i in anchors]
    return sorted(out)


def find(words: list[str], template: list[str], least: float, own: frozenset[str] = frozenset()) -> list[tuple[int, int, float]]:
    """(first word, end, coverage) of places that reach ``least`` and have the
    words ``own``, best first where they overlap.

    A place that reaches it has most template words, so windows around each
    place of the template word that is rarest in the text are aligned, all of
    them. Should that word itself be missing there, the next rarest serve, as
    many as may be missing."""
    count = Counter(words)
    allowed = len(template) - -int(-least * len(template) // 1)
    if sum(1 for w in template if count[w]) < len(template) - allowed:
        return []
    # the rarest template places: one of any allowed + 1 is aligned
    rare = {template[k] for k in sorted(range(len(template)), key=lambda k: (count[template[k]], k))[: allowed + 1]}
    reach = len(template) + allowed
    found, done = {}, 0
    for at in (i for i, w in enumerate(words) if w in rare):
        if at < done:  # in a place that has the whole template
            continue
        lo, hi = max(0, at - reach), min(len(words), at + reach + 1)
        pairs = align(words[lo:hi], template)
        if len(pairs) >= len(template) - allowed and names_it(words[lo:hi], pairs, template, own):
            a, b = lo + pairs[0][0], lo + pairs[-1][0] + 1
            found[a, b] = len(pairs) / len(template)
            done = b if len(pairs) == len(template) == b - a else done
    taken: list[tuple[int, int, float]] = []
    for (a, b), share in sorted(found.items(), key=lambda x: (-x[1], x[0][1] - x[0][0], x[0])):
        # What is taken is in order and apart, so only its neighbours can overlap.
        k = bisect_left(taken, (a,))
        if (k == len(taken) or b <= taken[k][0]) and (k == 0 or taken[k - 1][1] <= a):
            taken.insert(k, (a, b, share))
    if len(template) >= LONG:
        ends = [(0, 0, 0.0), *taken, (len(words), len(words), 0.0)]
        for (_, lo, _), (hi, _, _) in zip(ends, ends[1:], strict=False):
            taken += spread_out(words[lo:hi], template, allowed, own, lo)
    return sorted(taken)


def spread_out(words: list[str], template: list[str], allowed: int, own: frozenset[str] = frozenset(), first: int = 0) -> list[tuple[int, int, float]]:
    """A template whose parts other text parts by more than a window holds, as
    comments between clauses do: all of ``words`` (from the ``first`` of a
    text) are aligned, and then what lies on either side. Half of the words or
    more must follow each other, as words of a long text could also be met one
    here and one there."""
    if len(words) < len(template) - allowed:
        return []
    pairs = align(words, template)
    runs = sum(i + 1 == k and j + 1 == m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    if len(pairs) < len(template) - allowed or 2 * runs < len(pairs) or not names_it(words, pairs, template, own):
        return []
    a, b = pairs[0][0], pairs[-1][0] + 1
    here = [(first + a, first + b, len(pairs) / len(template))]
    return spread_out(words[:a], template, allowed, own, first) + here + spread_out(words[b:], template, allowed, own, first + b)


def winners(hits: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float, int]]:
    """Of places (name, first word, end, coverage, aligned words) that overlap,
    those with most aligned words, the better covered of two: one that has half
    of its words or more within a place of another template goes."""
    out: list[tuple[str, int, int, float, int]] = []
    for hit in sorted(hits, key=lambda h: (-h[4], -h[3], h[0], h[1])):
        name, a, b, *_ = hit
        if all(2 * (min(b, d) - max(a, c)) < b - a or name == other for other, c, d, *_ in out):
            out.append(hit)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id``, ``n_licenses``
    (different ones found), ``licenses`` (their names, sorted, comma-joined),
    ``coverage`` (the best, 0 if none) and ``spans`` (``name:start:end`` in code
    points, comma-joined).

    ``templates`` (name -> text; those of ``license_texts`` if not given) are
    few and go with the code to the tasks. Names that end in ``-text`` or
    ``-notice`` tell which form was found; overlapping forms and licences give
    the one with most aligned words (see ``winners``). Null, empty and wordless texts have
    none; repeated and null ids give a row each; extra columns are ignored; an
    empty table gives none.
    """
    shapes = [(k, w, own_words(k, w)) for k, t in sorted((templates or TEMPLATES).items()) for w in [words_of(t)]]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"].tolist():
                words = words_of(text)
                have, hits = set(words), []
                for name, template, own in shapes:
                    if template and own <= have and sum(w in have for w in template) >= least * len(template):
                        hits += [(name, a, b, share, round(share * len(template))) for a, b, share in find(words, template, least, own)]
                hits = winners(hits) if len(hits) > 1 else hits
                places = original_spans(text, [(a, b) for _, a, b, *_ in hits]) if hits else []
                names = sorted({h[0] for h in hits})
                spans = sorted((a, b, h[0]) for h, (a, b) in zip(hits, places, strict=True))
                rows.append((len(names), ",".join(names), max((h[3] for h in hits), default=0.0), ",".join(f"{k}:{a}:{b}" for a, b, k in spans)))
            out = pd.DataFrame(rows, columns=["n_licenses", "licenses", "coverage", "spans"])
            out.insert(0, "doc_id", pd.array(pdf["doc_id"], "string").astype("Int64"))
            yield out

    keyed = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    return written(keyed.mapInPandas(tidy(each), "doc_id long, n_licenses long, licenses string, coverage double, spans string"), "licenses")
