"""Web archives, token rollups, the pipeline, and all SQL."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeflow.llm import secrets, token_rollup, warc
from gaugeflow.llm.common import new_path, written
from gaugeflow.llm.queries import QUERIES, SQL, rollup

from ..compare import rows, sql_rows
from ..conftest import SF
from . import brute


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols, want = sql_rows(duck, SQL[name])
    assert rows(df.select(*cols)) == (cols, want)


def page_rows():
    big = "<p>é" * 400
    return [(1, "http://a", big), (3, "http://b\r\nX: y", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "x" * 1000), (3, "again", big), (8, "", "y" * 999), (9, "http://a/%20b é?\u200b=%", "y" * 999)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(page_rows())
    for r in got:
        same = [h for i, _, h in page_rows() if i == r["page_id"]]
        assert (r["page_id"], r["url"]) in {(i, u) for i, u, _ in page_rows()}
        payload = (same[0] or "").encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        revisit = r["page_id"] in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert bytes(r["payload"]) == (b"" if revisit else payload)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_broken_archives_are_refused():
    good = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Date", "d")], b"hello" * i) for i in range(30)]
    data = warc.archive(good, warc.make_dictionary(good))
    assert [b for _, b in warc.records(data)] == [b"hello" * i for i in range(30)]
    with pytest.raises(warc.BadArchive):
        list(warc.records(data[:-3]))
    with pytest.raises(warc.BadArchive):
        list(warc.records(data[8:]))
    with pytest.raises(warc.BadArchive):
        warc.parse(good[3].replace(b"Content-Length: 15", b"Content-Length: 14"))
    with pytest.raises(warc.BadArchive):
        warc.parse(good[3].replace(b"WARC-Date", b"X-Date"))


SCHEMA = "source string, lang string, tokenizer string, kind string, n_tokens long, was_tokens long"


def totals(spark, folder):
    return sorted(((r["source"], r["lang"], r["docs"], r["tokens"]) for r in token_rollup.totals(spark, folder).collect()), key=str)


def test_rollup(spark):
    folder = new_path(spark, "rollup")
    assert totals(spark, folder) == [] and list(token_rollup.committed(spark, folder)) == []
    first = spark.createDataFrame([("a", "en", "v", "insert", 10, None), ("a", "en", "v", "insert", 5, None), (None, "en", "v", "insert", 1, 0), ("b", None, "v", "insert", None, 0)], SCHEMA)
    second = spark.createDataFrame([("a", "en", "v", "delete", None, 5), ("a", "en", "v", "revise", 12, 10), (None, "en", "v", "delete", 0, 1)], SCHEMA).withColumn("docs", F.lit(9))
    assert [token_rollup.commit(folder, batch, events) for batch, events in (("1", first), ("a/b=2 %", second), ("a/b=2 %", second), ("1", first))] == [True, True, False, False]
    assert totals(spark, folder) == [("a", "en", 1, 12), ("b", None, 1, 0)]
    assert token_rollup.commit(folder, "none", first.limit(0)) and list(token_rollup.committed(spark, folder)) == ["1", "a/b=2 %", "none"]
    with pytest.raises(Exception, match="not a kind"):
        token_rollup.commit(folder, "odd", spark.createDataFrame([("a", "en", "v", "odd", 1, 1)], SCHEMA))
    assert totals(spark, folder) == [("a", "en", 1, 12), ("b", None, 1, 0)]


def test_broken_off_commit_leaves_the_state_before(spark, monkeypatch):
    folder = new_path(spark, "rollup")
    events = spark.createDataFrame([("a", "en", "v", "insert", 10, None)], SCHEMA)
    token_rollup.commit(folder, "1", events)
    # What a commit that ends between its two tables leaves behind.
    spark.createDataFrame([("a", "en", "v", 99, 99)], token_rollup._TOTALS).write.parquet(f"{folder}/totals/state=2")
    assert totals(spark, folder) == [("a", "en", 1, 10)]
    for batch in ("2", "3", "2", "4"):
        token_rollup.commit(folder, batch, events)
    assert totals(spark, folder) == [("a", "en", 4, 40)]


def test_rollup_of_documents_against_the_library(spark):
    paths = {n: public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k")}
    texts = ["a b\na b\nc <|endoftext|>", "a b\na b\nc <|endoftext|>", None, None, "", "x", "x", "x", "one\ntwo\none"]
    rows = [(i, t, None if i == 5 else f"s{i % 2}", "en") for i, t in enumerate(texts)]
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), paths).collect()}
    want = {}
    for name, path in paths.items():
        count = lambda t, library=Tokenizer.from_file(path): len(library.encode(t, add_special_tokens=False).ids)
        for i, t, source, lang in rows:
            if t is None or i == texts.index(t):
                docs, tokens = want.get((source, lang, name), (0, 0))
                want[source, lang, name] = docs + 1, tokens + (count("\n".join(dict.fromkeys(t.split("\n")))) if t is not None else 0)
    assert got == want


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"]: r for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(P.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]

    def check(name, before):
        after = stages[name](spark, before, SF)
        assert after.columns == docs.columns
        return written(after, "stage"), {r["doc_id"]: r for r in after.collect()}

    frame, rows_ = check("quality rules", docs)
    good = brute.keeps([r["text"] for r in left.values()])
    assert rows_ == {i: r for (i, r), k in zip(left.items(), good, strict=True) if k}

    left = rows_
    frame, rows_ = check("n-gram Jaccard join", frame)
    assert rows_ == {i: left[i] for i, n, least in brute.components([(i, r["text"]) for i, r in left.items()], 5, 80, 100) if i == least}

    left = rows_
    frame, rows_ = check("benchmark decontamination", frame)
    assert rows_ == {i: r for i, r in left.items() if not brute.hits(r["text"], items)[1]}

    left = rows_
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(frame).collect()}
    frame, rows_ = check("secret scans", frame)
    for i, r in left.items():
        text, want, at = r["text"], "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if a >= at:
                want += text[at:a] + "[secret]"
            at = max(at, b)
        want += text[at:]
        assert (rows_[i]["text"], rows_[i]["n_chars"], rows_[i]["lang"]) == (want, len(want), r["lang"])
    assert rows_.keys() == left.keys()

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages["best-fit packing"](spark, frame, SF).collect()
    whole = {i: 1 + len(library.encode(r["text"], add_special_tokens=False).ids) for i, r in rows_.items()}
    of_doc, of_sequence = {}, {}
    for r in packed:
        of_doc[r["doc_id"]] = of_doc.get(r["doc_id"], 0) + r["length"]
        of_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert of_doc == whole
    for places in of_sequence.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(of_sequence) <= -(-sum(whole.values()) // 2048) * 1.05 + 2
    assert sorted(map(str, P.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(str(Row(**{c: r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")})) for r in packed)


def test_stages_on_odd_documents(spark):
    import corpus_pipeline as P

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, "en", "s", 0), (None, "some words here", None, None, None), (3, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 1), (4, "again and again", "en", "s", 15), (4, "again and again", "en", "s", 15)]
    for rows_ in (odd, []):
        frame = spark.createDataFrame(rows_, schema)
        for name, stage in P.STAGES[:-1]:
            after = stage(spark, frame, SF)
            assert after.columns == frame.columns and after.count() <= len(rows_)
        assert P.STAGES[-1][1](spark, frame, SF).select("doc_id", "piece").count() >= len(rows_)
