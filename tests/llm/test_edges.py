"""Empty tables, repeated rows, very long texts and clashing columns through every operator, and the pipeline against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_brute import _classes, _grams, table
from test_ops import _contaminated, _reference, _repeats

from registrum.llm import bpe, catalogue, chat, decontam, langid, linededup, minhash, quality, secrets, shards, warc

CLASHING = ("key", "node", "k", "found", "shard", "tie_", "w", "body", "lang_pred", "text_key", "its_id", "row", "position", "spans", "score")


def _model():
    return langid.fit([("en", "the quick brown fox and the other dogs " * 5), ("de", "der schnelle braune fuchs und die anderen hunde " * 5)])


def _operators(spark):
    path, pattern, *_ = _reference()
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    return {
        "bpe": lambda d: bpe.bpe_roundtrip(d, path, pattern),
        "shards": lambda d: shards.shard_documents(d, 4),
        "minhash": lambda d: minhash.near_duplicates(d)[0],
        "linededup": lambda d: linededup.dedup_units(d),
        "decontam": lambda d: decontam.decontaminate(d, items),
        "quality": lambda d: quality.apply_policy(quality.ledger(d), quality.POLICIES[1]),
        "secrets": lambda d: secrets.scan_secrets(d),
        "langid": lambda d: langid.identify(d, _model()),
    }


OPERATORS = ("bpe", "shards", "minhash", "linededup", "decontam", "quality", "secrets", "langid")


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    """An empty table gives no rows; repeated rows, nulls and very long texts each give a row, whatever other columns there are, and what
    is told of a text does not depend on those."""
    run = _operators(spark)[name]
    assert run(table(spark, [])).count() == 0
    rng = random.Random(5)
    words = ["the", "quick", "fuchs", "hund", "a", "zz9"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, None), (None, None), (2, ""), (3, "the quick fox"), (3, "the quick fox"), (None, "x y z"), (4, long), (4, long), (5, "q" * 200_000), (6, "\n" * 5000)]
    plain = table(spark, rows)
    wide = plain.select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHING))
    told = [sorted(str(tuple(r)) for r in run(d).collect()) for d in (plain, wide)]
    assert len(told[0]) == len(rows)
    if name not in ("minhash", "shards"):  # of repeated rows one is kept, and each has a place of its own
        assert told[0] == told[1]
    if name == "quality":
        found = {r.doc_id: r.n_repeat_words for r in run(plain).collect()}
        assert found[4] == _repeats(long.split()) if len(long) < 10_000 else found[4] > 0


def test_warc_and_chat_edges(spark):
    schema = spark.createDataFrame(catalogue.TOOLS, chat.SCHEMA)
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link_tools(messages, schema).count() == 0
    call = '{"tool_calls": [{"id": "c", "name": "search", "arguments": {"query": "c"}}]}'
    rows = [(None, 5, "assistant", call), (5, None, "assistant", call), (5, None, "assistant", call), (5, 1, "tool", '{"tool_call_id": "c"}'), (5, 2, None, "x" * 300_000), (5, 3, "user", '["no object"]'), (5, 4, "user", "{")]
    wide = spark.createDataFrame(rows, messages.schema).select("*", *(F.lit(c).alias(c) for c in CLASHING))
    out = chat.link_tools(wide, schema).collect()
    assert len(out) == len(rows) and sorted(r.position for r in out if r.conv_id == 5) == list(range(6))
    # a call that uses its own answer waits for itself
    assert [r.status for r in out if r.turn is None] == ["cycle", "cycle"] and next(r for r in out if r.conv_id is None).status == "call"
    assert next(r for r in out if r.turn == 4).message == '{"content":"{","conv_id":5,"role":"user","turn":4}'
    pages = [(1, "u", "z" * 300_000), (1, "u", "z" * 300_000), (2, "u", "z" * 300_000), (None, None, None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").select("*", *(F.lit(c).alias(c) for c in CLASHING))
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.refers_to) for r in warc.archive_pages(d).collect())
    assert got == [("1", "response", 300_000, None), ("1", "response", 300_000, None), ("2", "revisit", 300_000, 1), ("None", "response", 0, None)]


def test_crc_of_shards(spark):
    import zlib

    texts = [None, "", "é", "abc" * 1000]
    out = {r.doc_id: r.text_crc32 for r in shards.shard_documents(table(spark, list(enumerate(texts))), 2).collect()}
    assert [out[k] for k in range(4)] == [zlib.crc32((t or "").encode()) for t in texts]


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "c" * 50), (3, "d")]
    d = table(spark, rows).withColumn("shard", F.lit("own"))
    plan = shards.write_shards(d, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    key = lambda r: (str(r.doc_id), str(r.text), r.shard)
    assert sorted(map(key, back.collect())) == sorted((str(k), str(t), "own") for k, t in rows) and set(back.columns) == {*d.columns, "shard_"}
    count = lambda df, c: sorted((r[0], r[1]) for r in df.groupBy(c).count().collect())
    assert count(plan, "shard") == count(back, "shard_") and plan.count() == len(rows)


# ---- the pipeline


def _plain_pipeline(rows, items, count):
    """What is left of rows (doc_id, text, lang) and how many tokens: languages are told by their words, copies by shingles, leaks by windows,
    secrets by their place."""
    english, german = {"the", "and", "of", "house", "river"}, {"der", "und", "das", "haus", "fluss"}
    kept = []
    for k, t in rows:
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        if w and max(sum(x[:5] in english or x.startswith("en") for x in w), sum(x[:5] in german or x.startswith("de") for x in w)) >= 0.4 * len(w):
            kept.append((k, t))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    sets = [set(_grams(t)) for _, t in kept]
    pairs = [(a, b) for a in range(len(kept)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = _classes(len(kept), pairs)
    kept = [r for n, r in enumerate(kept) if group[n] == n]
    hit = [c for *_, c in _contaminated([t for _, t in kept], items)]
    kept = [r for r, c in zip(kept, hit, strict=True) if not c]
    clean = [(k, re.sub(r"password=\w+", "[ASSIGN]", t)) for k, t in kept]
    return sorted((str(k), count(t)) for k, t in clean)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)

    def said(lang, n):
        small = {"en": ["the", "and", "of", "house", "river"], "de": ["der", "und", "das", "haus", "fluss"]}[lang]
        return [rng.choice(small) if rng.random() < 0.5 else lang + "".join(rng.choices("abcdeghilmnorstu", k=6)) for _ in range(n)]

    def near(w):
        return [*w[:40], "changed", *w[41:]]

    base = [said(rng.choice(["en", "de"]), 120) for _ in range(60)]
    items = [(1, " ".join(base[0][10:30])), (2, None)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    rows += [(None, " ".join(base[3])), (3, " ".join(base[3])), (100, " ".join(near(base[4]))), (101, " ".join(near(base[5]))), (None, " ".join(said("en", 90))), (7, " ".join(said("de", 90)))]
    rows += [(200, None), (201, ""), (202, "123 456"), (203, " ".join(base[6][:60]) + " password=Xq7vR2pL9zAb " + " ".join(said("en", 60))), (0, " ".join(said("en", 70)))]
    langs = {"en": 0, "de": 0}
    docs = [(k, t, None if not t or t[0].isdigit() else "de" if sum(x.startswith("de") or x in ("und", "das", "haus", "fluss") for x in t.split()) > 0.5 * len(t.split()) else "en", "s", 0) for k, t in rows]
    assert all(any(d[2] == x for d in docs) for x in langs)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHING))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    library = _reference()[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = _plain_pipeline([(k, t) for k, t, *_ in docs], items, lambda t: len(library.encode_ordinary(t)))
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == want
    assert all(r.decoded_sha256 != hashlib.sha256(b"").hexdigest() for r in out)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
