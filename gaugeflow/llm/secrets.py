"""Secret scan: fixed patterns, and a battery of randomness tests.

The battery takes runs of token characters with letters, infers each one's
encoding from its characters, and tests whether it looks like uniform draws
from that alphabet: chi-squared uniformity, runs above and below the alphabet's
middle, and serial correlation. Natural strings fail, but short ones may pass
by chance, words of one case above all. So every candidate has controls: as
many letters of the ordinary words around it, tested under its own alphabet. A
threshold a group (encoding, make-up, length class) keeps the expected share of
natural strings among the finds under a level.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, tidy, written

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: '=' is padding at the end; inside it parts a name from its value.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: No alphabet has symbols of both kinds, so a run that has both is cut at either.
_CUTS = [re.compile(r"[A-Za-z0-9+/]{16,}=*"), re.compile(r"[A-Za-z0-9_-]{16,}=*")]
#: Alphabets by name, each in the order of its digits; the first that has all characters is inferred.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = [(frozenset(a), {c: i for i, c in enumerate(a)}) for a in ALPHABETS.values()]
#: Words of fewer letters than any candidate, with no token character at either side.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{1,15}(?![A-Za-z0-9+/_=-])")
#: Control strings a candidate has at most, each of its own length.
CONTROLS = 16
#: Controls of one length class that are a null distribution by themselves.
ENOUGH = 256
BINS = 64
#: From this bin on (p-values of 0.01 or less) a token fails the battery clearly.
TAIL = 8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, in code points."""
    out = []
    low = text.lower() if not text.isascii() else text.casefold()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(body: str) -> int | None:
    """Number of the first alphabet that has all of the characters."""
    chars = frozenset(body)
    return next((k for k, (own, _) in enumerate(_SETS) if chars <= own), None)


def p_random(token: str) -> float | None:
    """Combined p-value of the battery under uniform draws; None if no alphabet
    has all of the token's characters ('=' padding aside)."""
    body = token.rstrip("=")
    k = encoding(body)
    return None if k is None or len(body) < 16 else p_drawn(body, k)


def p_drawn(body: Sequence[str], k: int) -> float:
    """Combined p-value of the battery under uniform draws from alphabet ``k``."""
    index, n = _SETS[k][1], len(body)
    size = len(index)
    values = np.fromiter(map(index.__getitem__, body), np.float64, n)
    counts = np.bincount(values.astype(np.int64), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    # mean size - 1; the variance of multinomial counts, exact for small n too
    z_chi = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    upper = values >= size / 2
    k = int(upper.sum())
    if k in (0, n):
        p_runs = 2.0 ** (1 - n)
    else:
        runs = 1 + int((upper[1:] != upper[:-1]).sum())
        mean = 1 + 2 * k * (n - k) / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = math.erfc(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(2 * var))
    centred = values - values.mean()
    power = float(centred @ centred)
    serial = float(centred[1:] @ centred[:-1]) / power if power else 1.0
    p_serial = math.erfc(abs(serial + 1 / n) * math.sqrt(n / 2))
    p_chi = 0.5 * math.erfc(z_chi / math.sqrt(2))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def length_class(n: int) -> int:
    """Token lengths that share a null distribution: half octaves, up to 128."""
    return min(6, int(2 * math.log2(n / 16)))


def tokens(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, p-value) of runs that an alphabet has. Of overlapping parts
    of a run with both kinds of symbols, the likeliest stays."""
    for m in TOKEN.finditer(text):
        p = p_random(m[0])
        if p is not None:
            yield m.start(), m.end(), p
            continue
        parts = {(m.start() + x.start(), m.start() + x.end()) for cut in _CUTS for x in cut.finditer(m[0])}
        tested = [(p, a, b) for a, b in parts if (p := p_random(text[a:b])) is not None]
        taken: list[tuple[int, int, float]] = []
        for p, a, b in sorted(tested, key=lambda t: (-t[0], t[1] - t[2], t[1])):
            # What is taken is in order and apart, so only its neighbours can overlap.
            k = bisect_left(taken, (a,))
            if (k == len(taken) or b <= taken[k][0]) and (k == 0 or taken[k - 1][1] <= a):
                taken.insert(k, (a, b, p))
        yield from taken


def p_bin(p: float) -> int:
    return min(BINS - 1, int(-4 * math.log10(max(p, 1e-300))))


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, group, p-value bin) of tokens with letters.

    A group is a length class within an encoding and a make-up: letters alone,
    letters and symbols, or digits too."""
    out = []
    for start, end, p in tokens(text):
        body = text[start:end].rstrip("=")
        if not any(map(str.isalpha, body)):
            continue
        make = 0 if body.isalpha() else 2 if any(map(str.isdigit, body)) else 1
        out.append((start, end, (make * len(_SETS) + encoding(body)) * 8 + length_class(end - start), p_bin(p)))
    return out


def controls(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(group, p-value bin) of the candidates' controls: strings of a candidate's
    length, of the letters that its encoding has of the words before and after it.
    Where it has both cases, capitals are where the candidate has one after
    something else, as names in one word have them."""
    out = []
    for start, end, group, _ in found:
        body = text[start:end].rstrip("=")
        k, n = group // 8 % len(_SETS), len(body)
        index, reach = _SETS[k][1], 20 * n
        words = [m[0] for a, b in ((max(0, start - reach), start), (end, min(len(text), end + reach))) for m in WORD.finditer(text, a, b) if m.end() < b or b == len(text)]
        letters = "".join(words).lower() if "a" in index else "".join(words).upper()
        if len(index) <= 16:
            letters = "".join(c for c in letters if c in index)
        humps = [i for i, c in enumerate(body) if c.isupper() and not body[max(0, i - 1) : i].isupper()] if "a" in index and "A" in index else []
        for i in range(0, min(CONTROLS * n, len(letters) - n + 1), n):
            control = list(letters[i : i + n])
            for at in humps:
                control[at] = control[at].upper()
            out.append((group, p_bin(p_drawn(control, k))))
    return out


def examined(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, int]]]:
    """Base spans, and the candidates that overlap none of them. Both are in
    order of their starts, so a search and the furthest end so far tell."""
    spans = base_spans(text) if text else []
    starts, furthest = [a for a, _, _ in spans], list(accumulate((b for _, b, _ in spans), max))

    def overlaps(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and furthest[k - 1] > a

    return spans, [c for c in candidates(text or "") if not overlaps(c[0], c[1])]


def thresholds(counts: list[tuple[int, int, bool, int]], level: float, estimate: bool = True) -> dict[int, int]:
    """length class -> largest p-value bin at which the expected share of
    natural strings among the finds is at most ``level``. Classes with few
    natural strings borrow those of all shorter classes. Without ``estimate``
    all that is tested counts as natural, not just the share that its failures tell."""
    out = {}
    for c in {x[0] for x in counts}:
        null, found = np.zeros(BINS), np.zeros(BINS)
        for cls, b, natural, n in counts:
            if natural and cls <= c:
                null[b] += n
            elif not natural and cls == c:
                found[b] += n
        share = (np.cumsum(null) + 0.5) / (null.sum() + 1)
        # Natural strings among the mixed ones: those that fail clearly, over the share of natural ones that do.
        some = not estimate or min(1.0, (found[TAIL:].sum() + 1) / max(null[TAIL:].sum() / (null.sum() + 1), 0.05) / max(found.sum(), 1))
        false = share * found.sum() * some
        fits = np.flatnonzero((false <= level * np.cumsum(found)) & (found > 0))
        out[c] = int(fits[-1]) if len(fits) else -1
    return out


def limits_of(counts: list[tuple[int, int, bool, int]], level: float) -> dict[int, int]:
    """group -> largest p-value bin that counts as a find, from rows (group,
    bin, control, number).

    Length classes with few controls take those of the encoding's shorter ones
    too, which pass more easily. Strings with digits are held against the
    strings of letters alone that are no finds, besides their controls."""
    families: dict[int, list[tuple[int, int, bool, int]]] = defaultdict(list)
    for group, b, control, n in counts:
        families[group // 8].append((group % 8, b, control, n))
    out, letters = {}, []
    for family, rows in sorted(families.items()):
        digits = family >= 2 * len(_SETS)
        null = [r for r in rows if r[2]] + letters * digits
        tested = [r for r in rows if not r[2]]
        for c in {r[0] for r in tested}:
            own = [r for r in null if r[0] == c]
            enough = sum(r[3] for r in own) >= ENOUGH
            out[family * 8 + c] = thresholds((own if enough else null) + [r for r in tested if r[0] == c], level, digits)[c]
        if family < len(_SETS):
            letters += [(c, b, True, n) for c, b, _, n in tested if b > out[family * 8 + c]]
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id``, ``n_assign``,
    ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``, ``spans``.

    Spans are of whole matches, in code points, end exclusive. Base spans stay;
    the battery adds tokens that overlap none of them. Null and empty texts
    have none; repeated and null ids give a row each; extra columns are
    ignored; an empty table gives no rows. ``level`` bounds the expected share
    of natural strings among what is added, in each group; a text without words
    around a candidate gives no controls.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"].tolist():
                spans, free = examined(text)
                joined = _joined(spans)
                null = controls(text, free) if free else []
                kinds = [k for _, _, k in spans]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined.encode()).hexdigest(), joined, free, [g * BINS + b for g, b in null]))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "free", "null"])
            out.insert(0, "doc_id", pd.array(pdf["doc_id"], "string").astype("Int64"))
            yield out

    shape = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, free array<array<int>>, null array<int>"
    keyed = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    found = written(keyed.mapInPandas(tidy(each), shape), "secret-scan")
    null = found.select(F.explode("null").alias("c")).groupBy("c").agg(F.count("*").alias("n")).select(F.floor(F.col("c") / BINS).cast("int").alias("cls"), (F.col("c") % BINS).alias("bin"), F.lit(True).alias("control"), "n")
    free = found.select(F.explode("free").alias("c")).groupBy(F.col("c")[2].alias("cls"), F.col("c")[3].alias("bin")).agg(F.count("*").alias("n")).select("cls", "bin", F.lit(False).alias("control"), "n")
    # At most groups x bins x 2 rows (24,576), whatever the input.
    limits = limits_of(sorted(tuple(r) for r in null.union(free).collect()), level)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans, n_random = [], []
            for base, free in zip(pdf["base"], pdf["free"], strict=True):
                own = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                more = [(int(a), int(b), "random") for a, b, c, at in free if at <= limits.get(int(c), -1)]
                spans.append(_joined(sorted(own + more, key=lambda s: (s[0], KINDS.index(s[2])))))
                n_random.append(len(more))
            pdf["spans"], pdf["n_random"] = spans, n_random
            pdf["doc_id"] = pd.array(pdf["doc_id"], "string").astype("Int64")
            yield pdf.drop(columns=["base", "free"])

    final = found.drop("null").withColumn("doc_id", F.col("doc_id").cast("string"))
    return final.mapInPandas(tidy(add), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with base and random finds replaced by ``mark`` in ``text``, and
    ``n_chars``, where there is one, counted anew. All rows stay.

    The spans are those of ``scan`` over all of ``docs``, with the same
    thresholds. Null and empty texts stay as they are; repeated and null ids
    are rows of their own; an empty table stays empty."""
    numbered = need(docs, "text").withColumn("doc_id", F.lit(None).cast("long"))
    found = scan_limits(numbered)
    sent = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        limits = sent.value

        def one(text):
            if not text:
                return text
            base, free = examined(text)
            spans = [(a, b) for a, b, _ in base] + [c[:2] for c in free if c[3] <= limits.get(c[2], -1)]
            out, at = [], 0
            for a, b in sorted(spans):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]]) if spans else text

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def scan_limits(docs: DataFrame, level: float = 0.05) -> dict[int, int]:
    """The thresholds alone, from counts over all documents."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"].tolist():
                free = examined(text)[1]
                rows += [(*c[2:], False) for c in free]
                rows += [(*c, True) for c in controls(text, free)] if free else []
            yield pd.DataFrame(rows, columns=["cls", "bin", "control"])

    found = need(docs, "text").mapInPandas(tidy(each), "cls int, bin int, control boolean")
    rows = written(found.groupBy("cls", "bin", "control").agg(F.count("*").alias("n")), "secret-counts").collect()
    return limits_of(sorted((r["cls"], r["bin"], r["control"], r["n"]) for r in rows), level)
