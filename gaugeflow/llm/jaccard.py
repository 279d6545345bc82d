"""N-gram Jaccard self-join with rare-first prefixes.

Documents with equal shingle sets form one class, so copies never make pairs.
Between classes:

1. Shingle frequencies are counted over all documents; those above a bound
   chosen so that the list stays under ``heavy_limit`` entries are sent to the
   tasks. The common order is: rarer first (all below the bound count as
   equally rare), ties by hash.
2. Two sets that reach the threshold share a shingle in their prefixes. Sets
   are joined on prefix shingles, under the length and positional filters.
3. A bucket of m sets isn't expanded into its pairs: its sets meet the bucket's
   hub, are verified and linked, and only sets left in other components than
   the hub's meet the rest of the bucket. Nothing is capped, and each pair is
   verified once, after a suffix filter.

Shingles, and classes, are known by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hot_keys, join_hot, need, tidy, written

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        x = (x ^ (x >> U(31))) * U(k)
    return x ^ (x >> U(29))


#: A random number for each byte, and an odd base with its inverse modulo 2 ** 64.
_BYTES = _mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of the base and of its inverse."""
    out = np.full((2, 1 << bits), 1, U)
    out[0, 1:], out[1, 1:] = _BASE, _BACK
    return tuple(np.multiply.accumulate(out, axis=1))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending. A-Z are lower-cased,
    words are runs of other than white space; fewer words than ``size`` are one
    shingle, none are none.

    A shingle is hashed as the bytes from its first word to its last: a sum of
    bytes' numbers times powers of the base, as a difference of running sums.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    data = np.frombuffer(b" ".join(words), np.uint8)
    forth, back = _powers(max(17, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * forth[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    size = min(size, len(words))
    starts = np.concatenate([[0], gaps + 1])[: len(words) - size + 1]
    ends = np.concatenate([gaps, [len(data)]])[size - 1 :]
    found = _mix((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(U))
    found.sort()
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``up / down``, in whole numbers."""

    up: int = 90
    down: int = 100

    def least(self, n):
        """Least overlap of a set of n with any partner; also least partner size."""
        return -(-self.up * n // self.down)

    def prefix(self, n):
        return n - self.least(n) + 1

    def overlap(self, a, b):
        """Least overlap of sets of a and b: up (a + b) / (up + down), rounded up."""
        return -(-self.up * (a + b) // (self.up + self.down))


def class_of(s: np.ndarray) -> int:
    """A class's number: a hash of the whole set, as a signed long."""
    return int(np.int64(U(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))


def spread(s: np.ndarray, parts: int = 64) -> np.ndarray:
    """How many of a set's shingles fall to each part of the hash space, at
    most 127. Two sets differ in at least as many shingles as their counts."""
    return np.minimum(np.bincount((s >> U(58)).astype(np.int64), minlength=parts), 127).astype(np.int8)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, class, parts of each row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, size) for t in pdf["text"].tolist()]
            yield pd.DataFrame({"doc_id": pd.array(pdf["doc_id"], "string").astype("Int64"), "n_shingles": [len(s) for s in sets], "class": [class_of(s) for s in sets], "parts": [spread(s) for s in sets]})

    keyed = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    return keyed.mapInPandas(tidy(each), "doc_id long, n_shingles long, class long, parts array<tinyint>")


def _heavy(docs: DataFrame, size: int, total: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles: the upper 40 bits of their hashes, ascending, and
    their document counts. At most ``limit`` of them.

    Tasks count their own documents and send sorted runs, cut by the hash's
    upper bits into as many ranges as keep one at about a million entries."""
    bits = max(8, (total // 1_000_000).bit_length())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, seen = [], 0, set()

        def runs() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U) << U(40 - bits))
            low = (keys & U((1 << 40 - bits) - 1)).astype("<u4")
            parts = list(zip(np.split(low, cuts), np.split(counts.astype("<u4"), cuts), strict=True))
            return pd.DataFrame([(r, k.tobytes(), c.tobytes()) for r, (k, c) in enumerate(parts) if len(k)], columns=["range", "keys", "counts"])

        for pdf in batches:
            for text in pdf["text"].tolist():
                s = shingles(text, size)
                if len(s) and (own := class_of(s)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(own)
                    held.append(s >> U(24))
                    n += len(s)
            if n >= 1_500_000:
                yield runs()
                held, n = [], 0
        if held:
            yield runs()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["keys"]), "<u4")
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u4")
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts.astype(np.int64), first)
        often = sums >= 16
        high = np.int64(pdf["range"].iloc[0]) << (40 - bits)
        return pd.DataFrame({"key": keys[first][often].astype(np.int64) + high, "n": sums[often]})

    runs_ = need(docs, "text").mapInPandas(tidy(count), "range int, keys binary, counts binary")
    often = written(runs_.groupBy("range").applyInPandas(merge, "key long, n long"), "shingle-counts")
    by_size = {r["e"]: r["c"] for r in often.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("c")).collect()}
    bound, kept = 64, 0
    for e in sorted(by_size, reverse=True):
        kept += by_size[e]
        if kept > limit or e < 4:
            break
        bound = e
    got = often.where(F.col("n") >= F.lit(2.0) ** bound).toPandas().sort_values("key")
    discard(docs.sparkSession, often)
    return got["key"].to_numpy(np.int64).astype(U), got["n"].to_numpy(np.int64)


def _prefixes(docs: DataFrame, size: int, limit: Threshold, heavy: tuple[np.ndarray, np.ndarray], split_from: int = 4096, split_into: int = 64) -> DataFrame:
    """token, salt, class, n, pos: the prefix shingles of each class, once a
    task. Tokens of very many documents are salted by class, from 1 on; others
    have salt 0."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = sent.value
        seen = set()
        for pdf in batches:
            out = []
            for text in pdf["text"].tolist():
                s = shingles(text, size)
                if not len(s) or (own := class_of(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(own)
                often = np.zeros(len(s), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s >> U(24)), len(keys) - 1)
                    often = np.where(keys[at] == s >> U(24), counts[at], 0)
                order = np.argsort(often, kind="stable")[: limit.prefix(len(s))]
                out.append((s[order].view(np.int64), np.where(often[order] >= split_from, 1 + own % split_into, 0), np.full(len(order), own), np.full(len(order), len(s)), np.arange(len(order))))
            if out:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("token", "salt", "class", "n", "pos"), zip(*out, strict=True), strict=True)})

    return need(docs, "text").mapInPandas(tidy(each), "token long, salt int, class long, n int, pos int")


def _may_link(limit: Threshold, a: str, b: str):
    """Length and positional filters for two prefix rows of one token."""
    na, nb, pa, pb = (F.col(f"{x}.{c}").cast("long") for c in ("n", "pos") for x in (a, b))
    least = F.ceil(F.lit(limit.up) * (na + nb) / F.lit(limit.up + limit.down))
    sizes = F.least(na, nb) * limit.down >= F.greatest(na, nb) * limit.up
    return sizes & (F.least(na - pa, nb - pb) >= least)


def _near_enough(limit: Threshold, a: str, b: str):
    """The suffix filter in the join: what two sets' counts by part of the hash
    space differ is no more than sets that link may differ."""
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    least = F.ceil(F.lit(limit.up) * (na + nb) / F.lit(limit.up + limit.down))
    apart = F.zip_with(f"{a}.parts", f"{b}.parts", lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    return F.aggregate(apart, F.lit(0), lambda t, x: t + x) <= na + nb - 2 * least


#: A bit map over classes: three bits a class, cut from its hash, of 2 ** 26 (8 MB, whatever the input).
_BITS, _SHIFTS = 26, (0, 19, 38)


def _bit_map(keys: DataFrame) -> np.ndarray:
    """The bits of all classes in ``keys``; past tens of millions of them it
    holds fewer and fewer sets back, but never one that is asked for."""
    places = keys.select(F.explode(F.array(*[F.shiftrightunsigned("class", k).bitwiseAND((1 << _BITS) - 1) for k in _SHIFTS])).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("word"))
    out = np.zeros(1 << _BITS - 5, "<u4")
    # At most 256 rows of 8,192 words; each partition is a job of its own, so they are few.
    for chunk in words.groupBy(F.shiftright("at", 13)).agg(F.collect_list(F.struct("at", "word")).alias("w")).coalesce(8).toLocalIterator():
        at, word = np.array([tuple(x) for x in chunk["w"]], np.int64).T
        out[at] = word
    return out


def _in_map(bits: np.ndarray, own: int) -> bool:
    """False only for classes that aren't in the map."""
    for k in _SHIFTS:
        p = own >> k & (1 << _BITS) - 1
        if not int(bits[p >> 5]) >> (p & 31) & 1:
            return False
    return True


def _sets_of(docs: DataFrame, size: int, keys: DataFrame) -> DataFrame:
    """class, set (its shingles' bytes) of the classes in ``keys``, once each."""
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(keys))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, seen = sent.value, set()
        for pdf in batches:
            rows = []
            for text in pdf["text"].tolist():
                s = shingles(text, size)
                if len(s) and _in_map(bits, own := class_of(s)) and own not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(own)
                    rows.append((own, s.tobytes()))
            yield pd.DataFrame(rows, columns=["class", "set"])

    made = need(docs, "text").mapInPandas(tidy(each), "class long, set binary")
    return made.join(keys, "class", "left_semi").dropDuplicates(["class"])


def suffix_reject(a: np.ndarray, b: np.ndarray, differ: int, depth: int = 3) -> bool:
    """Whether two sorted sets surely differ in more than ``differ`` places: cut
    both at a middle element and add up what their parts' sizes differ."""
    if abs(len(a) - len(b)) > differ:
        return True
    if not depth or not len(a) or not len(b):
        return False
    middle = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, middle))
    left, right = abs(i - j), abs((len(a) - i) - (len(b) - j))
    if left + right > differ:
        return True
    return suffix_reject(a[:i], b[:j], differ - right, depth - 1) or suffix_reject(a[i:], b[j:], differ - left, depth - 1)


def _verified(docs: DataFrame, size: int, limit: Threshold, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that reach the threshold."""
    pairs = written(pairs.distinct(), "candidates")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    keys = written(keys, "candidate-classes")
    sets = written(_sets_of(docs, size, keys), "candidate-sets")
    discard(docs.sparkSession, keys)
    # A hub has a pair with each of its near copies: such pairs are dealt out, and the hub's set is repeated for each share.
    both = join_hot(pairs, sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a", F.col("b"), hot_keys(pairs, "a"), "inner")
    both = join_hot(both, sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b", F.col("a"), hot_keys(pairs, "b"), "inner")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                least = limit.overlap(len(x), len(y))
                keep.append(not suffix_reject(x, y, len(x) + len(y) - 2 * least) and len(np.intersect1d(x, y, assume_unique=True)) >= least)
            yield pdf.loc[keep, ["a", "b"]]

    links = written(both.mapInPandas(tidy(each), "a long, b long"), "links")
    discard(docs.sparkSession, pairs, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """class, root: for each end of ``links`` (a, b) the least class it reaches.

    Labels pass along links and jump over labels until none changes; every
    round's table is written, so rounds don't pile up. The links of a hub, and
    the members of a large component, are dealt out to many tasks."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links-both")
    hubs = hot_keys(both, "a")
    labels = written(both.groupBy(F.col("a").alias("class")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    table = labels
    while True:
        near = join_hot(both, labels.select(F.col("class").alias("a"), "root"), "a", F.col("b"), hubs).groupBy(F.col("b").alias("class")).agg(F.min("root").alias("near"))
        lower = written(labels.join(near, "class").select("class", F.col("root").alias("old"), F.least("root", "near").alias("root")), "lower")
        jump = labels.select(F.col("class").alias("root"), F.col("root").alias("over"))
        new = written(join_hot(lower, jump, "root", F.col("class"), hot_keys(lower, "root")).select("class", "old", F.least("root", "over").alias("root")), "labels")
        changed = new.where("root <> old").limit(1).count()
        discard(links.sparkSession, table, lower)
        labels, table = new.select("class", "root"), new
        if not changed:
            discard(links.sparkSession, both)
            return labels


def jaccard_components(docs: DataFrame, size: int = 3, up: int = 90, down: int = 100, heavy_limit: int = 500_000) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id``, ``n_shingles``,
    ``component_id``, ``class`` (of equal sets) and ``root`` (the component's).

    Two documents link when their sets' Jaccard similarity is ``up / down`` or
    more; ``component_id`` is the least ``doc_id`` reachable by links. Null,
    empty and wordless texts have no shingles and are their own components.
    Rows with equal ids are separate documents; null ids are kept and are the
    component's id only where it has no other. Extra columns are ignored; an
    empty table gives no rows.
    """
    limit = Threshold(up, down)
    rows = written(_sets(docs, size), "shingle-sets")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    heavy = _heavy(docs, size, total, heavy_limit)
    bucket = Window.partitionBy("token", "salt")
    # The hub is the set that has the shingle earliest: least of it is rare, so it lies in the middle of its near copies.
    own = F.struct("pos", "n", "class")
    # The same class may come from several tasks; so members are told apart by the least and greatest class.
    found = _prefixes(docs, size, limit, heavy).select("*", F.min(own).over(bucket).alias("hub"), F.max("class").over(bucket).alias("top"), F.min("class").over(bucket).alias("bottom"))
    kept = written(found.where("salt <> 0 or top <> bottom").drop("top", "bottom").dropDuplicates(["token", "class"]), "prefixes")
    discard(docs.sparkSession)
    # Hubs of the salts of one token meet the least of them.
    hubs = kept.groupBy("token", "salt").agg(F.min("hub").alias("hub"))
    chief = hubs.groupBy("token").agg(F.min("hub").alias("chief"), F.count("*").alias("salts")).where("salts > 1")
    upward = hubs.join(chief, "token").select("hub", "chief").where("hub.class <> chief.class").where(_may_link(limit, "hub", "chief"))
    inward = kept.select(own.alias("own"), "hub").where("own.class <> hub.class").where(_may_link(limit, "own", "hub"))

    def pair(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.least(f"{a}.class", f"{b}.class").alias("a"), F.greatest(f"{a}.class", f"{b}.class").alias("b"))

    tried = written(pair(inward, "own", "hub").union(pair(upward, "hub", "chief")).distinct(), "tried")
    links = _verified(docs, size, limit, tried)
    roots = components(links)
    # What isn't in its token's leading component meets all of that token's sets in other components.
    labelled = kept.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lead = kept.groupBy("token").agg(F.min("hub").alias("hub")).select("token", F.col("hub.class").alias("class"))
    lead = lead.join(roots, "class", "left").select("token", F.coalesce("root", "class").alias("lead"))
    parts = rows.groupBy("class").agg(F.first("parts").alias("parts"))
    member = F.struct("n", "class", "pos", "parts")
    often = hot_keys(kept, "token")
    labelled = join_hot(labelled, lead, "token", F.col("class"), often, "inner")
    labelled = written(labelled.join(parts, "class").select("token", member.alias("own"), "root", "lead"), "labelled")
    minor = labelled.where("root <> lead").select("token", F.col("own").alias("x"), F.col("root").alias("x_root"))
    rest = join_hot(labelled.select("token", F.col("own").alias("y"), F.col("root").alias("y_root"), "lead"), minor, "token", F.col("y"), often, "inner")
    rest = rest.where("x_root <> y_root and (y_root = lead or x.class < y.class)").where(_may_link(limit, "x", "y") & _near_enough(limit, "x", "y"))
    rest = written(pair(rest, "x", "y").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    discard(docs.sparkSession, kept, labelled, tried)
    if rest.limit(1).count():
        more = _verified(docs, size, limit, rest)
        if more.limit(1).count():
            roots = components(links.union(more))
    placed = join_hot(rows.drop("parts"), roots, "class", F.col("doc_id"), hot_keys(rows, "class"))
    placed = written(placed.withColumn("root", F.coalesce("root", "class")), "placed")
    discard(docs.sparkSession, rows)
    least = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = join_hot(placed, least, "root", F.col("doc_id"), hot_keys(placed, "root"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "class", "root")


def keep_one(docs: DataFrame, size: int = 5, up: int = 80, down: int = 100) -> DataFrame:
    """``docs``, with their own columns, but of each component only the row of
    least ``doc_id`` (of equal ids one). Documents without words all stay; a row with
    a null id stays only if its component has no other; an empty table stays
    empty. Columns of any name are kept."""
    class_, id_, none = (f"__{c}_{uuid.uuid4().hex}" for c in ("class", "id", "none"))
    found = written(jaccard_components(docs, size, up, down).where("n_shingles > 0").select("doc_id", "class", "root"), "components")
    best = found.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "class"))), F.min(F.struct("doc_id", "class"))).alias("c"))
    chosen = written(best.select(F.col("c.class").alias(class_), F.coalesce("c.doc_id", F.lit(0)).alias(id_), F.col("c.doc_id").isNull().alias(none)), "chosen")
    # A class of one document, which is chosen, is sure to stay. Texts of other classes meet the list of chosen ones.
    of_class = found.groupBy("class").agg(F.count("*").alias("n")).join(chosen.select(F.col(class_).alias("class"), F.lit(True).alias("stays")), "class", "left")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(of_class.where("n > 1 or stays is null").select("class")))
    discard(docs.sparkSession, found)

    @F.pandas_udf("long")
    def open_class(texts: pd.Series) -> pd.Series:
        """The class of a text, or null if it is sure to stay."""
        own = [class_of(shingles(t, size)) for t in texts]
        return pd.Series([c if _in_map(sent.value, c) else None for c in own], dtype="Int64")

    # Else the filter below would be moved under the column, and each text be hashed twice.
    open_class = open_class.asNondeterministic()
    worded = F.coalesce(F.col("`text`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    key = F.col("`doc_id`").cast("long")
    sure = docs.where(worded).where(open_class(F.col("`text`")).isNull())
    marked = docs.where(worded).withColumn(class_, open_class(F.col("`text`"))).where(F.col(class_).isNotNull()).withColumns({id_: F.coalesce(key, F.lit(0)), none: key.isNull()})
    rest = marked.join(chosen, [class_, id_, none], "left_semi").dropDuplicates([class_, id_, none])
    return docs.where(~worded).unionByName(sure).unionByName(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))
